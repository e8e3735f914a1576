"""One registered query per operator, with the parameters of production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import ann
from folioframe.llm import conversation_repair as cr
from folioframe.llm import cover_search as cs
from folioframe.llm import exact_dedup as ex
from folioframe.llm import language_id as li
from folioframe.llm import line_dedup as ld
from folioframe.llm import mixing as mx
from folioframe.llm import ngram_join as nj
from folioframe.llm import packing as pk
from folioframe.llm import secrets as sx
from folioframe.llm import source_audit as sa
from folioframe.llm import suffix_dedup as sd
from folioframe.llm import token_output as to
from folioframe.llm.registry import register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@register(
    "op1_exact_dedup",
    """
    WITH t AS (
      SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
      FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.exact_dedup(table(spark, sf_dir, "documents"), with_digest=True)


@register(
    "op7_line_dedup",
    """
    WITH raw AS (
      SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS body FROM documents),
    cut AS (
      SELECT doc_id, unnest(body) AS line, unnest(range(len(body))) AS n FROM raw),
    rows AS (
      SELECT doc_id, n, line, translate(trim(line, ' ' || chr(9) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM cut),
    part AS (SELECT doc_id, n, t FROM rows WHERE length(t) >= 20),
    uniq AS (
      SELECT t, length(t) AS c, min(doc_id * 10000000 + n) AS first FROM part GROUP BY t),
    halves AS (
      SELECT t, c, first, m, 'a' || left(t, m // 2) AS k FROM (SELECT *, c AS m FROM uniq UNION ALL SELECT *, c + 1 AS m FROM uniq)
      UNION ALL
      SELECT t, c, first, m, 'b' || right(t, m - m // 2) AS k FROM (SELECT *, c AS m FROM uniq UNION ALL SELECT *, c + 1 AS m FROM uniq)),
    pairs AS (
      SELECT DISTINCT a.t AS a, b.t AS b, a.c AS ac, b.c AS bc, a.first AS af, b.first AS bf
      FROM halves a JOIN halves b ON a.m = b.m AND a.k = b.k AND a.t <> b.t AND a.c = a.m),
    near AS (
      SELECT CASE WHEN af > bf THEN a ELSE b END AS t FROM pairs
      WHERE len(list_filter(range(1, ac + 1), lambda i: left(a, i - 1) || substr(a, i + 1) =
            CASE WHEN bc = ac THEN left(b, i - 1) || substr(b, i + 1) ELSE b END
            AND (bc < ac OR (left(a, i - 1) = left(b, i - 1)))) ) > 0),
    gone AS (
      SELECT p.doc_id, p.n FROM part p JOIN uniq u ON p.t = u.t
      WHERE p.doc_id * 10000000 + p.n <> u.first OR p.t IN (SELECT t FROM near)),
    marked AS (
      SELECT r.doc_id, r.n, r.line, g.n IS NOT NULL AS gone FROM rows r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.n = g.n)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    counts = [F.col(c).cast("long").alias(n) for c, n in (("lines_total", "n_lines"), ("lines_removed", "n_removed"))]
    return ld.line_dedup(docs).select("doc_id", *counts, digest.alias("kept_sha256"))


@register("op2_ngram_jaccard_join")
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nj.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=90)


@register("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return li.identify(table(spark, sf_dir, "documents"))


#: Wanted shares of tokens per domain.
WEIGHTS = {"clean": 0.94, "low": 0.04, "toxic": 0.02}


@register("op9_mixing_rates")
def op9_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = mx.label_domains(table(spark, sf_dir, "labels"))
    out = mx.mix(table(spark, sf_dir, "documents"), labels, WEIGHTS, whole="clean")
    shares = [F.round(F.col("posterior")[k], 6).alias(f"p_{d}") for k, d in enumerate(WEIGHTS)]
    return out.select("doc_id", "tokens", *shares, "domain", F.round("rate", 6).alias("rate"))


#: Characters that a bin holds.
CAPACITY = 8192


@register("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pk.pack(pk.with_copies(docs), CAPACITY)


@register("op3_token_output")
def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    return to.read_back(to.write_token_files(table(spark, sf_dir, "documents"), vocabulary))


@register("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = sx.find_secrets(docs, sx.infer(docs))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in sx.KINDS],
        F.sha2(shown("base"), 256).alias("base_sha256"),
        shown("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_format"),
    )


@register("op4_approximate_nearest")
def op4_approximate_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors.where(F.col("vec_id") % 50 == 0), vectors, 5)


@register("op8_suffix_array_dedup")
def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sd.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@register(
    "op11_source_divergence_audit",
    r"""
    WITH d AS (
      SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents),
    w AS (SELECT lang, source, id, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
    l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
    cell AS (
      SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS ln
      FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    p AS (
      SELECT cell.*, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p,
             1 + (1000000000::HUGEINT * (ln + 5)) // (total + 5 * v)::HUGEINT AS q
      FROM cell JOIN l USING (lang)),
    pair AS (
      SELECT a.lang, a.source, b.source AS item,
             coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
                       WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
    term AS (SELECT lang, source, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
    SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value,
           (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pair
    UNION ALL
    SELECT lang, source, 'term', item, value::BIGINT,
           (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS r FROM term QUALIFY r <= 50
    """,
)
def op11_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


@register("op12_conversation_structure_repair")
def op12_conversation_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cr.digests(cr.repair(cr.damaged(table(spark, sf_dir, "conversations"))))


@register(
    "op13_exact_topk_search",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS y
      FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.y, x.y), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v x ON q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
    FROM s QUALIFY rank <= 5
    """,
)
def op13_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return cs.top_products(vectors.where(F.col("vec_id") % 50 == 0), vectors, 5)
