import random
import re
from collections import Counter, defaultdict

import pytest

from folioframe.llm import source_audit as sa
from folioframe.llm.queries import op11_source_divergence_audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=30, top=50):
    """Rows of the contract, term by term, for (lang, source, text)."""
    docs, counts = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for lang, source, text in rows:
        terms = TERM.findall((text or "").translate(FOLD))
        counts[lang or ""][source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    for lang, by in counts.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode)
        v = len(kept)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * v) for t in kept}

        p = {s: shares(c) for s, c in by.items()}
        q = shares(sum(by.values(), Counter()))
        for s in by:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in by if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if by[s][t] > 0 and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(items, 1)}
    return out


def got(df):
    rows = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{path}/documents.parquet").select("lang", "source", "text").collect()
    df = op11_source_divergence_audit(spark, path)
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert got(df) == plain(map(tuple, rows))


@pytest.mark.parametrize("block, tile, flush", [(2048, 64, 200_000), (3, 2, 5), (70, 3, 50)])
def test_odd_rows(spark, monkeypatch, block, tile, flush):
    """Blocks, tiles and flushes of every size give the same; nulls are empty strings."""
    for name, value in (("BLOCK_TERMS", block), ("TILE", tile), ("FLUSH", flush), ("CELLS", 64)):
        monkeypatch.setattr(sa, name, value)
    rng = random.Random(5)
    words = ["the", "The", "été", "ÉTÉ", "日本", "x1y", "a-b", "ß", " z", "the's"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    weights = [30 if i < 12 else 1 for i in range(len(words))]
    rows = [
        (rng.choice(["en", "en", "fr", None]), rng.choice([None, "", "s1", "s2", "s3", "Ω", "z" * 50]), " ".join(rng.choices(words, weights, k=rng.randrange(0, 30))))
        for _ in range(400)
    ]
    rows += [("en", "void", None), ("en", "void", ""), ("one", "only", "a b c"), ("two", "p", "x"), ("two", "q", "y")]
    rows += [("en", "long", "the " * 200_000 + "été")] + [("en", "s1", "same text the")] * 40
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "lang string, source string, text string, term string, n int")
    want = plain(rows)
    assert {r[2] for r in want} == {"pair", "term"} and ("two", "p", "pair", "q", 0, 1) in want
    assert got(sa.divergence(df.repartition(3))) == want


def test_empty(spark):
    assert sa.divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_shares_are_exact_for_large_counts():
    import numpy as np

    counts = np.array([0, 7, 10**14, 9 * 10**14], np.int64)
    assert sa.shares(counts, 10**15, 1000).tolist() == [1 + 10**9 * (int(c) + 5) // (10**15 + 5000) for c in counts]
