"""Every stage against a plain version, on what the stage before it kept."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dedup import plain_lines
from test_packing import plain

import corpus_pipeline as cp
from folioframe.llm import language_id, mixing, packing
from folioframe.llm.common import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in cp.STAGES:
        out.append(stored(stage(spark, out[-1], SF), name))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(tables):
    assert all(t.columns == tables[0].columns for t in tables[:-1])


def test_language(spark, tables):
    kept, docs = rows(tables[1]), rows(tables[0])
    got = {r.doc_id: r for r in language_id.identify(tables[0]).collect()}
    assert kept == {i: d for i, d in docs.items() if got[i].lang_pred != "und" and got[i].score >= cp.LEAST_SCORE}


def test_lines(tables):
    docs, kept = rows(tables[1]), rows(tables[2])
    want = {i: t for i, t in plain_lines([(i, d.text) for i, d in docs.items()], 1, 20) if t == docs[i].text or t.strip(" \t\r\n")}
    assert {i: d.text for i, d in kept.items()} == want
    assert all(d.n_chars == len(d.text) for i, d in kept.items() if d.text != docs[i].text)


def test_near_copies(tables):
    docs = rows(tables[2])
    want = brute.jaccard_components([(i, d.text) for i, d in docs.items()], 5, 80)
    assert rows(tables[3]) == {i: d for i, d in docs.items() if want[i][1] == i}


def test_mixing(spark, tables):
    labels = mixing.label_domains(spark.read.parquet(f"{SF}/labels.parquet"))
    rates = {r.doc_id: r for r in mixing.mix(tables[3], labels, cp.WEIGHTS).collect()}
    docs, kept = rows(tables[3]), rows(tables[4])
    assert all(kept.get(i) == d for i, d in docs.items() if rates[i].rate >= 1) and kept.keys() <= docs.keys()
    assert not any(rates[i].rate <= 0 for i in kept)


def brute_rates(p, n, weights):
    """Rates nearest to 1 that meet the targets of a whole first domain, by small steps up the dual."""
    have = n @ p
    targets = np.minimum(have, np.array(weights) * have[0] / weights[0])
    pull = np.zeros(p.shape[1])
    for _ in range(20_000):
        pull += 0.5 * (targets - (n * np.maximum(0, 1 + p @ pull)) @ p) / n.sum()
    return np.maximum(0, 1 + p @ pull)


@pytest.mark.parametrize("n_toxic", [1, 0])
def test_mixing_keeps_clean_when_toxic_is_scarce(spark, tmp_path, n_toxic):
    sf = "/root/testdata/sf0.01"
    labels = mixing.label_domains(spark.read.parquet(f"{sf}/labels.parquet"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels, "doc_id")
    toxic = docs.where("domain = 'toxic'").orderBy("doc_id").limit(n_toxic)
    docs = stored(docs.where("domain != 'toxic'").unionByName(toxic), "scarce")
    named = docs.select("doc_id", F.expr("int(domain != 'low')").alias("quality"), F.expr("int(domain = 'toxic')").alias("toxic"))
    named.write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in cp.mix_domains(spark, docs.drop("domain"), str(tmp_path)).collect()}
    clean = {r.doc_id for r in docs.where("domain = 'clean'").collect()}
    assert len(clean) > 200 and len(clean & kept) >= 0.97 * len(clean)
    # the same rows as a plain fit on the same posteriors
    soft = mixing.mix(docs, mixing.label_domains(named), cp.WEIGHTS)
    draw = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    soft = soft.withColumn("draw", draw).toPandas()
    want = brute_rates(np.stack(soft["posterior"]), soft["tokens"].to_numpy(float), list(cp.WEIGHTS.values()))
    sure = np.abs(want - soft["draw"]) > 0.02  # the fit stops within a tolerance
    assert sure.mean() > 0.9
    assert set(soft["doc_id"][sure & (soft["draw"] < want)]) == kept & set(soft["doc_id"][sure])


def test_packing(tables):
    docs = packing.with_copies(tables[4]).toPandas().rename(columns={"doc_id": "id"})
    docs["length"], docs["cluster"] = docs["text"].str.len(), docs["cluster"].map(lambda v: None if v != v or v is None else str(int(v)))
    pieces = tables[5].toPandas()
    shard = pieces.drop_duplicates("doc_id").set_index("doc_id")["shard"]
    assert pieces.groupby("doc_id")["length"].sum().to_dict() == docs.set_index("id")["length"].to_dict()
    for s in shard.unique():
        want = plain(docs[docs["id"].map(shard) == s].reset_index(drop=True), cp.CAPACITY)
        last = {(r.doc_id, r.piece): (r.bin, r.offset) for r in pieces[pieces["shard"] == s].itertuples()}
        assert want == {k: v for k, v in last.items() if k in want}
