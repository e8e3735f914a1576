"""Matches found by the words of a chunk are those found by comparing its text."""

import random

import pytest
from pyspark.sql import functions as F

from folioframe.operators import matching as mt
from folioframe.operators import postings as po
from folioframe.operators import retrieval as rt


@pytest.fixture(scope="module")
def search(spark):
    rng = random.Random(5)
    words = ["the", "The", "of", "на", "Ёлка", "елка", "ёж", "Alpha", "alpha", "BETA", "beta-gamma", "gamma", "ог-1", "Ограждение", "проминвест", "nponis",
             "İx", "Kelvin", "Σας", "x1", "alphabet", "зелёный", "b"]
    texts = ["".join(w + rng.choice([" ", " ", ", ", "\n", "/"]) for w in rng.choices(words, k=rng.randrange(1, 12))) for _ in range(400)] + ["", None, "§ !", "ёж " * 40]
    rows = [(f"c{k:03}", f"d{k // 3}", rng.choice(["l1", "l2", "l3"]), t) for k, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, label_id string, content string").repartition(3)
    asks = words + [" ".join(rng.choices(words, k=n)) for n in (2, 2, 2, 3, 4, 8) for _ in range(6)]
    asks += ["ограждение 1", "Alpha,", "alpha  of", "елка зеленый", "zzzz", "zzzz the", "§", "", "a", "the the of", "elvin Alpha", "ёж ёж", "bet gam"]
    rows = [(f"{s}:{k}", q, s) for k, q in enumerate(asks) for s in (1, 2)] + [("none", "the", None)]
    scopes = spark.createDataFrame([(1, "l1"), (1, "l2"), (1, "l3"), (2, "l2")], "scope_id bigint, label_id string")
    return spark.createDataFrame(rows, "trace_id string, query string, scope_id bigint"), po.build_index(chunks), scopes


CALLS = {
    "all": lambda s: rt.keyword_matches(*s, answers=True).select("trace_id", "query", "required", "chunk_id", "content", "answer", "score"),
    "top": lambda s: rt.top_matches(*s, 5).select("trace_id", "rank", "chunk_id", "score"),
    "hybrid": lambda s: rt.hybrid_search(*s, 7).select("trace_id", "rank", "chunk_id", "keyword", "cosine", "score"),
    "fulltext": lambda s: rt.fulltext_hybrid(*s, 6).select("trace_id", "rank", "chunk_id", "score"),
}


@pytest.mark.parametrize("name", CALLS)
def test_words_find_what_the_text_holds(spark, search, monkeypatch, name):
    monkeypatch.setattr(mt, "SLICE", 50)
    monkeypatch.setattr(mt, "BLOCK", 13)
    got = sorted(map(str, CALLS[name](search).collect()))
    monkeypatch.setattr(mt, "special", lambda forms: F.col("form") >= 0)  # every form by columns
    assert got == sorted(map(str, CALLS[name](search).collect())) and len(got) > 100


def test_a_chunk_is_not_compared_with_every_anchor(spark, search):
    requests, index, scopes = search
    plain = requests.where(F.col("query").isin("the", "Alpha,", "alpha  of", "zzzz the"))
    plan = rt.keyword_matches(plain, index, scopes).select("trace_id", "chunk_id", "score")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "hashpartitioning" not in plan
