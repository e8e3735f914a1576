"""Language identification and mixing."""

import numpy as np
from pyspark.sql import functions as F

from folioframe.llm import language_id as li
from folioframe.llm import mixing as mx

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = li.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 200 and (got["lang"] == got["lang_pred"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_odd_texts(spark):
    rows = [(i, "the quick brown fox and the dog " * 3, "en", 1) for i in range(12)] + [(20 + i, "der schnelle braune Fuchs und der Hund " * 3, "de", 1) for i in range(12)]
    rows += [(50, None, "en", 1), (51, "", "de", 1), (52, "123 !?²", None, 1), (53, "der Hund", None, 1), (None, "the fox", "fr", 1), (53, "der Hund", None, 1), (54, "the dog " * 60_000, "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").repartition(2)
    got = {(r.doc_id, r.lang_pred) for r in li.identify(docs).collect()}
    assert {(50, "und"), (51, "und"), (52, "und"), (53, "de"), (None, "en"), (54, "en")} <= got
    assert li.identify(docs).count() == len(rows) and li.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in li.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = li.keep_identified(docs, 0.4)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} & {50, 51, 52} == set()


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.2, 0.2, 0.2], 500)
    n = rng.integers(1, 900, 500).astype(float)
    soft = spark.createDataFrame([(float(a), list(map(float, b))) for a, b in zip(n, p)], "_tokens double, _p array<double>")
    for goal in ((0.9, 0.3, 0.2), (1.5, 1.0, 0.5), (0.5, 0.5, 2.0)):
        targets = np.array(goal) * (p * n[:, None]).sum(axis=0)
        r = np.maximum(0, 1 + p @ mx.fit_rates(soft, targets.tolist()))
        assert np.abs((p * (n * r)[:, None]).sum(axis=0) - targets).max() <= 1e-3 * targets.sum()
        got = [x[0] for x in soft.select(mx.rate(soft["_p"], mx.fit_rates(soft, targets.tolist()))).collect()]
        assert np.allclose(sorted(got), sorted(r))


def test_classifier_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = mx.label_domains(spark.read.parquet(f"{SF}/labels.parquet"))
    weights = {"clean": 0.94, "low": 0.04, "toxic": 0.02}
    out = mx.mix(docs, labels, weights)
    got = out.join(labels.withColumnRenamed("domain", "true"), "doc_id").toPandas()
    assert out.count() == docs.count() and (got["domain"] == got["true"]).mean() > 0.95
    assert got[got["true"] == "clean"]["rate"].mean() > 0.9 > 0.5 > got[got["true"] == "toxic"]["rate"].mean()
    rows = [(1, None, 1), (2, "", 1), (None, "word " * 100_000, 1), (2, "", 1), (3, "ugly words", 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, rate int")
    named = spark.createDataFrame([(1, "clean"), (3, "toxic"), (3, "toxic"), (9, None), (None, "low")], "doc_id long, domain string")
    assert mx.mix(odd, named, weights).count() == 5
    assert mx.mix(odd.limit(0), named, weights).count() == 0 and mx.mix(odd, named.limit(0), weights).count() == 5
    assert mx.keep_by_rate(odd, mx.mix(odd, named, weights)).columns == odd.columns


def test_fit_keeps_rows_packed():
    """The driver fits: 1,600 rows of presence unpacked, and their matrices in double, took 169 MB."""
    import tracemalloc

    label = np.repeat(np.arange(4), 400)
    some = np.random.default_rng(0).random((1600, li.SLOTS), dtype=np.float32) < np.where(np.arange(li.SLOTS) % 4 == label[:, None], 0.11, 0.06)
    packed = np.packbits(some, axis=1)
    tracemalloc.start()
    model = li.fit(packed, ["abcd"[i] for i in label])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    assert ((some[::40].astype(np.float32) @ model.weights).argmax(axis=1) == label[::40]).all()
