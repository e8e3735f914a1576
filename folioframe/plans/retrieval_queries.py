"""Retrieval operators over the document chunks; requests are the benchmark passages."""

from pyspark.sql import functions as F

from folioframe.functions import scoring as sc
from folioframe.functions import text as tx
from folioframe.functions import vectors as vx
from folioframe.operators import chunking as ch
from folioframe.operators import ingest as ig
from folioframe.operators import retrieval as rt
from folioframe.operators import vectors as vs
from folioframe.plans import bindings as b
from folioframe.plans.registry import register
from folioframe.session import reuse

T2 = "[а-яёa-z0-9]{2,}"

# --- SQL building blocks ---------------------------------------------------------------------

OPEN_ASKS = """
asks AS (SELECT CAST(item_id AS VARCHAR) AS trace_id, '0' AS sk, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS q FROM benchmark),
vis AS (SELECT '0' AS sk, chunk_id FROM chunks)
"""
USER_ASKS = b.sql_visible() + """,
asks AS (SELECT item_id || ':' || employee_id AS trace_id, employee_id AS sk,
                regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS q
         FROM benchmark, (SELECT DISTINCT employee_id FROM visible)),
vis AS (SELECT employee_id AS sk, chunk_id FROM visible)
"""
REQUIRED = f"""
tk AS (SELECT *, regexp_extract_all(lower(q), '{T2}') AS toks FROM asks),
allt AS (SELECT DISTINCT unnest(toks) AS tok FROM tk),
tc AS (SELECT tok, chunk_id FROM allt, chunks WHERE contains(lower(content), tok)),
pres AS (SELECT DISTINCT sk, tok FROM tc JOIN vis USING (chunk_id)),
has AS (SELECT trace_id, list(DISTINCT u.tok) AS p
        FROM (SELECT trace_id, sk, unnest(toks) AS tok FROM tk) u JOIN pres USING (sk, tok) GROUP BY 1),
req AS (SELECT tk.*, CASE WHEN len(toks) < 2 OR p IS NULL THEN toks
                     ELSE list_filter(toks, lambda x: list_contains(p, x)) END AS required
        FROM tk LEFT JOIN has USING (trace_id))
"""


#: The same for the first 1, 2, 4 and 8 words of each passage, and for every user.
OPEN_SHORT = b.SQL_SHORT + """,
asks AS (SELECT CAST(item_id AS VARCHAR) AS trace_id, '0' AS sk, text AS q FROM short),
vis AS (SELECT '0' AS sk, chunk_id FROM chunks)
"""
USER_SHORT = b.sql_visible() + ", " + b.SQL_SHORT + """,
asks AS (SELECT item_id || ':' || employee_id AS trace_id, employee_id AS sk, text AS q FROM short, users),
vis AS (SELECT employee_id AS sk, chunk_id FROM visible)
"""


def sql_match_score(q: str, c: str) -> str:
    toks = f"regexp_extract_all(lower({q}), '{T2}')"
    spelled = f"regexp_extract_all({q}, '[а-яёА-ЯЁa-zA-Z0-9]{{2,}}')"
    n = f"len({toks})"
    hits = f"len(list_filter({toks}, lambda x: contains(lower({c}), x)))"
    exact = f"len(list_filter({spelled}, lambda x: contains({c}, x)))"
    return f"""CASE WHEN {q} = '' OR {c} = '' THEN 0.0::DOUBLE WHEN contains({c}, {q}) THEN 1.0
      WHEN contains(lower({c}), lower({q})) THEN 0.93 WHEN {n} = 0 THEN 0.0
      WHEN {hits} = {n} AND {exact} = {n} THEN 0.88 WHEN {hits} = {n} THEN 0.80::DOUBLE + 0.06::DOUBLE * ({exact}::DOUBLE / {n})
      WHEN {n} >= 2 THEN least(0.52::DOUBLE, 0.28::DOUBLE + 0.24::DOUBLE * ({hits}::DOUBLE / {n})) ELSE 0.0 END"""


MATCHES = f"""
hits AS (SELECT r.trace_id, r.q, r.toks, r.required, r.sk, c.chunk_id, c.doc_id, c.classification, c.content,
                round({sql_match_score('r.q', 'c.content')}, 6) AS score
         FROM req r JOIN vis USING (sk) JOIN chunks c USING (chunk_id)
         WHERE NOT (len(required) >= 1 AND len(toks) >= 2)
            OR len(list_filter(required, lambda x: contains(lower(c.content), x))) = len(required))
"""
BM25 = f"""
cterms AS (SELECT chunk_id, CASE WHEN len(t) > 0 THEN t ELSE ['_'] END AS terms
           FROM (SELECT chunk_id, regexp_extract_all(replace(lower(content), 'ё', 'е'), '{T2}') AS t FROM chunks)),
post AS (SELECT chunk_id, len(terms) AS dl, unnest(terms) AS term FROM cterms),
tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM post GROUP BY 1, 2, 3),
tot AS (SELECT sk, count(*) AS n_chunks, sum(len(terms)) / count(*) AS avgdl FROM vis JOIN cterms USING (chunk_id) GROUP BY 1),
dfs AS (SELECT sk, term, count(*) AS n FROM vis JOIN tf USING (chunk_id) GROUP BY 1, 2),
raw AS (SELECT sk, term, ln(n_chunks - n + 0.5::DOUBLE) - ln(n + 0.5::DOUBLE) AS raw, avgdl FROM dfs JOIN tot USING (sk)),
mean AS (SELECT sk, avg(raw) AS m FROM raw GROUP BY 1),
idf AS (SELECT sk, term, avgdl, CASE WHEN raw < 0 THEN 0.25::DOUBLE * m ELSE raw END AS idf FROM raw JOIN mean USING (sk)),
qt AS (SELECT trace_id, sk, term, count(*) AS qtf
       FROM (SELECT trace_id, sk, unnest(regexp_extract_all(replace(lower(q), 'ё', 'е'), '{T2}')) AS term FROM asks) GROUP BY 1, 2, 3),
bm AS (SELECT trace_id, chunk_id,
              round(sum(qtf * idf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))), 6) AS score
       FROM qt JOIN idf USING (sk, term) JOIN tf USING (term) JOIN vis USING (sk, chunk_id) GROUP BY 1, 2)
"""


def _rank(group: str = "trace_id") -> str:
    return f"row_number() OVER (PARTITION BY {group} ORDER BY score DESC, chunk_id)"


FULLTEXT = f"""
kw AS (SELECT trace_id, chunk_id, rank FROM (
         SELECT *, {_rank()} AS rank FROM hits
         WHERE score > 0 AND len(list_filter(toks, lambda x: contains(lower(content), x))) = len(toks)) WHERE rank <= 64),
bmall AS (SELECT trace_id, chunk_id, score
          FROM bm JOIN req USING (trace_id) JOIN chunks USING (chunk_id)
          WHERE score > 0 AND (NOT (len(required) >= 1 AND len(toks) >= 2)
             OR len(list_filter(required, lambda x: contains(lower(content), x))) = len(required))),
bmk AS (SELECT trace_id, chunk_id, rank FROM (SELECT *, {_rank()} AS rank FROM bmall) WHERE rank <= 64),
fused AS (SELECT *, {_rank()} AS rank FROM (
            SELECT trace_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score
            FROM (SELECT * FROM kw UNION ALL SELECT * FROM bmk) GROUP BY 1, 2)),
full_text AS (SELECT * FROM fused WHERE rank <= 64)
"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(p.strip().rstrip(",") for p in parts)


# --- scoring ---------------------------------------------------------------------------------


@register(
    "match_score",
    _with(b.SQL_CHUNKS, OPEN_ASKS, REQUIRED, MATCHES) + " SELECT trace_id, chunk_id, score FROM hits WHERE score > 0",
)
def match_score(spark, sf):
    asks, scopes = b.open_requests(spark, sf)
    return rt.keyword_matches(asks, b.index(spark, sf), scopes).select("trace_id", "chunk_id", "score")


@register(
    "match_score_same_source",
    f"""SELECT d.doc_id, b.item_id, round({sql_match_score("regexp_replace(b.text, '^\\s+|\\s+$', '', 'g')", "d.text")}, 6) AS score
        FROM documents d JOIN benchmark b ON d.doc_id = b.item_id""",
)
def match_score_same_source(spark, sf):
    docs, bench = b.table(spark, sf, "documents"), b.table(spark, sf, "benchmark")
    pairs = docs.join(bench.withColumnRenamed("text", "query"), F.col("doc_id") == F.col("item_id"))
    return pairs.select("doc_id", "item_id", F.round(sc.match_score(F.col("query"), F.col("text")), 6).alias("score"))


@register(
    "required_optional_tokens",
    _with(b.SQL_SECURE, USER_ASKS, REQUIRED)
    + """ SELECT trace_id, array_to_string(list_sort(list_distinct(required)), ' ') AS required,
                 array_to_string(list_sort(list_distinct(list_filter(toks, lambda x: NOT list_contains(required, x)))), ' ') AS optional
          FROM req""",
)
def required_optional_tokens(spark, sf):
    asks, scopes = b.requests(spark, sf)
    asked = rt.required_tokens(asks, b.index(spark, sf), scopes)
    words = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), " ").alias(c)
    return asked.select("trace_id", words("required"), words("optional"))


@register(
    "all_tokens_filter",
    _with(b.SQL_CHUNKS, OPEN_ASKS, REQUIRED, MATCHES)
    + " SELECT trace_id, count(*) AS chunks, count(DISTINCT doc_id) AS docs FROM hits GROUP BY 1",
)
def all_tokens_filter(spark, sf):
    asks, scopes = b.open_requests(spark, sf)
    rows = rt.keyword_matches(asks, b.index(spark, sf), scopes)
    return rows.groupBy("trace_id").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"))


@register(
    "query_chunk_candidates",
    _with(b.SQL_SECURE, USER_ASKS, REQUIRED)
    + f""", need AS (SELECT trace_id, sk, required FROM req WHERE len(toks) >= 2)
        SELECT trace_id, chunk_id FROM need JOIN vis USING (sk) JOIN chunks USING (chunk_id)
        WHERE len(list_filter(required, lambda x: contains(lower(content), x))) = len(required)""",
)
def query_chunk_candidates(spark, sf):
    asks, scopes = b.requests(spark, sf)
    rows = rt.keyword_matches(asks, b.index(spark, sf), scopes)
    return rows.where(F.size(tx.tokens(F.col("query"))) >= 2).select("trace_id", "chunk_id")


@register(
    "bm25",
    _with(b.SQL_CHUNKS, OPEN_ASKS, BM25)
    + f" SELECT * FROM (SELECT trace_id, chunk_id, score, {_rank()} AS rank FROM bm WHERE score > 0) WHERE rank <= 20",
)
def bm25(spark, sf):
    asks, scopes = b.open_requests(spark, sf)
    return rt.bm25(asks, b.index(spark, sf), scopes, pool=20)


@register(
    "bm25_by_scope",
    _with(b.SQL_SECURE, USER_ASKS, BM25)
    + f" SELECT * FROM (SELECT trace_id, chunk_id, score, {_rank()} AS rank FROM bm WHERE score > 0) WHERE rank <= 5",
)
def bm25_by_scope(spark, sf):
    asks, scopes = b.requests(spark, sf)
    return rt.bm25(asks, b.index(spark, sf), scopes, pool=5)


@register(
    "rrf",
    _with(b.SQL_CHUNKS, OPEN_ASKS, BM25)
    + f""", a AS (SELECT trace_id, chunk_id, {_rank()} AS rank FROM bm WHERE score > 0),
        l1 AS (SELECT * FROM a WHERE rank <= 30),
        l2 AS (SELECT trace_id, chunk_id, row_number() OVER (PARTITION BY trace_id ORDER BY length(content) DESC, chunk_id) AS rank
               FROM l1 JOIN chunks USING (chunk_id)),
        f AS (SELECT trace_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score
              FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY 1, 2)
        SELECT * FROM (SELECT trace_id, chunk_id, score, {_rank()} AS rank FROM f) WHERE rank <= 10""",
)
def rrf(spark, sf):
    asks, scopes = b.open_requests(spark, sf)
    index = b.index(spark, sf)
    first = reuse(rt.bm25(asks, index, scopes, pool=30).select("trace_id", "chunk_id", "rank"))
    by_len = rt.with_texts(first.drop("rank"), index).select("trace_id", "chunk_id", F.length("content").alias("n"))
    second = rt.rank_by_score(by_len, ["trace_id"], score="n").select("trace_id", "chunk_id", "rank")
    return rt.rrf(first.unionByName(second), ["trace_id"], 10)


@register(
    "fulltext_hybrid",
    _with(b.SQL_SECURE, USER_ASKS, REQUIRED, MATCHES, BM25, FULLTEXT) + " SELECT trace_id, chunk_id, score, rank FROM full_text",
)
def fulltext_hybrid(spark, sf):
    asks, scopes = b.requests(spark, sf)
    return rt.fulltext_hybrid(asks, b.index(spark, sf), scopes)


SEARCH = f"""
ranked AS (SELECT *, {_rank()} AS rank FROM hits WHERE score > 0),
results AS (SELECT trace_id, rank, chunk_id, doc_id, round(score, 4) AS score, classification, substr(content, 1, 280) AS snippet, q
            FROM ranked WHERE rank <= 8)
"""


@register(
    "rag_search",
    _with(b.SQL_SECURE, USER_ASKS, REQUIRED, MATCHES, SEARCH)
    + " SELECT trace_id, rank, chunk_id, doc_id, score, classification, snippet FROM results",
)
def rag_search(spark, sf):
    asks, scopes = b.requests(spark, sf)
    return rt.rag_search(asks, b.index(spark, sf), scopes)


@register(
    "rag_fusion",
    _with(b.SQL_CHUNKS)
    + """, q0 AS (SELECT CAST(item_id AS VARCHAR) AS tid, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS q FROM benchmark),
        q1 AS (SELECT *, trim(regexp_replace(q, '\\s+', ' ', 'g')) AS norm FROM q0),
        q2 AS (SELECT *, regexp_extract_all(norm, '(?i)[а-яёa-z0-9]{3,}') AS ks FROM q1),
        q3 AS (SELECT *, CASE WHEN len(ks) >= 3 THEN array_to_string(ks[1:12], ' ') END AS kw FROM q2),
        q4 AS (SELECT tid, q, CASE WHEN norm <> '' AND lower(norm) <> lower(q) THEN norm END AS v2, kw FROM q3),
        q5 AS (SELECT tid, q, v2, CASE WHEN lower(kw) <> lower(q) AND (v2 IS NULL OR lower(kw) <> lower(v2)) THEN kw END AS v3 FROM q4),
        asks AS (SELECT tid || '#' || i AS trace_id, '0' AS sk, regexp_replace(v, '^\\s+|\\s+$', '', 'g') AS q
                 FROM (SELECT tid, unnest(list_filter([q, v2, v3], lambda x: x IS NOT NULL)) AS v,
                       generate_subscripts(list_filter([q, v2, v3], lambda x: x IS NOT NULL), 1) - 1 AS i FROM q5)),
        vis AS (SELECT '0' AS sk, chunk_id FROM chunks),"""
    + ", ".join(p.strip() for p in (REQUIRED, MATCHES, BM25, FULLTEXT.replace(" WHERE rank <= 64", "")))
    + f""", fz AS (SELECT trace_id, chunk_id, score, {_rank()} AS rank FROM (
            SELECT split_part(trace_id, '#', 1) AS trace_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score
            FROM full_text GROUP BY 1, 2)),
        pick AS (SELECT trace_id, chunk_id FROM fz),
        fin AS (SELECT h.*, split_part(h.trace_id, '#', 1) AS tid FROM hits h WHERE split_part(h.trace_id, '#', 2) = '0' AND h.score > 0),
        fin2 AS (SELECT tid AS trace_id, f.chunk_id, doc_id, round(score, 4) AS score,
                 row_number() OVER (PARTITION BY tid ORDER BY score DESC, f.chunk_id) AS rank
                 FROM fin f JOIN pick p ON p.trace_id = f.tid AND p.chunk_id = f.chunk_id)
        SELECT trace_id, rank, chunk_id, doc_id, score FROM fin2 WHERE rank <= 8""",
)
def rag_fusion(spark, sf):
    asks, scopes = b.open_requests(spark, sf)
    return rt.rag_fusion(asks, b.index(spark, sf), scopes)


@register(
    "expand_query",
    """WITH q1 AS (SELECT conv_id || ':' || turn AS trace_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS q FROM conversations),
      q2 AS (SELECT *, trim(regexp_replace(q, '\\s+', ' ', 'g')) AS norm FROM q1 WHERE q <> ''),
      q3 AS (SELECT *, regexp_extract_all(norm, '(?i)[а-яёa-z0-9]{3,}') AS ks FROM q2),
      q4 AS (SELECT *, CASE WHEN len(ks) >= 3 THEN array_to_string(ks[1:12], ' ') END AS kw,
             CASE WHEN norm <> '' AND lower(norm) <> lower(q) THEN norm END AS v2 FROM q3),
      q5 AS (SELECT trace_id, list_filter([q, v2, CASE WHEN lower(kw) <> lower(q) AND (v2 IS NULL OR lower(kw) <> lower(v2)) THEN kw END],
             lambda x: x IS NOT NULL) AS vs FROM q4)
      SELECT trace_id, CAST(i - 1 AS INT) AS variant, vs[i] AS query FROM q5, unnest(range(1, len(vs) + 1)) t(i)""",
)
def expand_query(spark, sf):
    turns = b.table(spark, sf, "conversations")
    return rt.expand_queries(turns.select(F.concat_ws(":", "conv_id", "turn").alias("trace_id"), F.col("text").alias("query")))


def sql_quality(t: str) -> str:
    """Text quality with the Latin letter class, on stripped text."""
    n = f"length({t})"
    let = f"(({n} - length(regexp_replace({t}, '{b.LATIN}', '', 'g')))::DOUBLE / {n})"
    dig = f"(({n} - length(regexp_replace({t}, '[0-9]', '', 'g')))::DOUBLE / {n})"
    return f"""CASE WHEN {t} = '' THEN 0.0::DOUBLE WHEN {n} < 24 THEN 0.15
      WHEN regexp_matches(substr({t}, 1, 120), '^[0-9\\s.,\\-+]+$') THEN 0.05
      WHEN {dig} > 0.55 AND {let} < 0.08 THEN 0.1 WHEN {let} < 0.12 AND {dig} > 0.25 THEN 0.2
      ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.35::DOUBLE + least({let}, 0.55::DOUBLE) + least({n} / 400.0::DOUBLE, 0.25::DOUBLE)
           - CASE WHEN {dig} > 0.4 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END)) END"""


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@register(
    "quality_score",
    _with(b.SQL_CHUNKS, OPEN_ASKS, REQUIRED, MATCHES)
    + f""", z AS (SELECT trace_id, chunk_id, score, {_STRIP.format('content')} AS t FROM hits WHERE score > 0),
       y AS (SELECT *, {sql_quality('t')} AS quality FROM z)
       SELECT trace_id, chunk_id, round(quality, 6) AS quality,
              round(CASE WHEN quality < 0.12 THEN 0.0::DOUBLE ELSE score * (0.5::DOUBLE + 0.5::DOUBLE * quality) + 0.2::DOUBLE * score END, 6) AS quality_score
       FROM y""",
)
def quality_score(spark, sf):
    asks, scopes = b.open_requests(spark, sf)
    rows = rt.keyword_matches(asks, b.index(spark, sf), scopes)
    quality = tx.text_quality(F.col("content"), b.LATIN)
    return rows.select(
        "trace_id",
        "chunk_id",
        F.round(quality, 6).alias("quality"),
        F.round(sc.quality_score(F.col("score"), quality, F.col("score")), 6).alias("quality_score"),
    )


@register(
    "quality_rerank",
    _with(b.SQL_SECURE, USER_ASKS, REQUIRED, MATCHES, SEARCH)
    + f""", z AS (SELECT *, regexp_extract_all(lower(q), '{T2}') AS qt, {_STRIP.format('snippet')} AS t FROM results),
       k AS (SELECT *, {sql_quality('t')} AS quality FROM z
             WHERE len(qt) < 2 OR len(list_filter(qt, lambda x: contains(lower(snippet), x))) = len(qt)),
       s AS (SELECT trace_id, chunk_id, doc_id, round(score * (0.45::DOUBLE + 0.55::DOUBLE * quality)
               + 0.35::DOUBLE * {sql_match_score('q', 'snippet')}
               - CASE WHEN row_number() OVER (PARTITION BY trace_id, doc_id ORDER BY rank) > 1 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END, 4) AS score
             FROM k WHERE quality >= 0.12),
       n AS (SELECT trace_id, chunk_id, doc_id, score, {_rank()} AS rank FROM s)
       SELECT * FROM n WHERE rank <= 8
       UNION ALL
       SELECT trace_id, chunk_id, doc_id, score, rank FROM results WHERE trace_id NOT IN (SELECT trace_id FROM n)""",
)
def quality_rerank(spark, sf):
    asks, scopes = b.requests(spark, sf)
    results = rt.rag_search(asks, b.index(spark, sf), scopes).join(asks.select("trace_id", "query"), "trace_id")
    return rt.quality_rerank(results, script=b.LATIN)


@register(
    "search_response",
    _with(b.SQL_SECURE, USER_ASKS, REQUIRED, MATCHES, SEARCH.replace("rank <= 8", "rank <= 32"))
    + f""", z AS (SELECT *, regexp_extract_all(lower(q), '{T2}') AS qt, {_STRIP.format('snippet')} AS t FROM results),
       k AS (SELECT *, {sql_quality('t')} AS quality FROM z
             WHERE len(qt) < 2 OR len(list_filter(qt, lambda x: contains(lower(snippet), x))) = len(qt)),
       s AS (SELECT trace_id, chunk_id, round(score * (0.45::DOUBLE + 0.55::DOUBLE * quality)
               + 0.35::DOUBLE * {sql_match_score('q', 'snippet')}
               - CASE WHEN row_number() OVER (PARTITION BY trace_id, doc_id ORDER BY rank) > 1 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END, 4) AS score
             FROM k WHERE quality >= 0.12),
       n AS (SELECT trace_id, chunk_id, score, {_rank()} AS rank FROM s),
       fin AS (SELECT * FROM n WHERE rank <= 8 UNION ALL
               SELECT trace_id, chunk_id, score, rank FROM results WHERE rank <= 8 AND trace_id NOT IN (SELECT trace_id FROM n)),
       every AS (SELECT item_id || ':' || employee_id AS trace_id, u.* FROM benchmark, users u)
       SELECT e.trace_id, f.rank, f.chunk_id, c.doc_id, f.score, c.classification,
              substr(c.content, 1, 280) AS snippet, c.source_relative_path AS relative_path,
              coalesce(e.clearance, 'internal') AS max_clearance, e.project_role,
              (SELECT count(*) FROM chunks) AS candidates_before_rls,
              CAST(count(f.chunk_id) OVER (PARTITION BY e.trace_id) AS BIGINT) AS results_after_rls,
              {b.SQL_SCOPE.format(r='e.project_role')} = 'S_dept' AND coalesce(e.department_id, '') = '' AS denied_by_policy
       FROM every e LEFT JOIN fin f USING (trace_id) LEFT JOIN chunks c USING (chunk_id)""",
)
def search_response(spark, sf):
    """Every passage asked by every user, with those who may see nothing."""
    people = b.users(spark)
    asked = b.table(spark, sf, "benchmark").join(people.select("employee_id")).select(
        F.concat_ws(":", "item_id", "employee_id").alias("trace_id"), F.col("text").alias("query"), "employee_id"
    )
    out = rt.search_response(asked, people, b.access(spark, sf), b.index(spark, sf), script=b.LATIN)
    return out.select(
        "trace_id", "rank", "chunk_id", "doc_id", "score", "classification", "citation.snippet", "citation.relative_path",
        "filter_applied.max_clearance", "filter_applied.project_role", "candidates_before_rls", "results_after_rls", "denied_by_policy",
    )


@register(
    "model_rerank",
    _with(b.SQL_CHUNKS, OPEN_ASKS, REQUIRED, MATCHES, SEARCH)
    + """, s AS (SELECT trace_id, chunk_id, round(1.0::DOUBLE - abs(length(q) - length(snippet)) / 1000.0::DOUBLE, 4) AS score FROM results)
       SELECT * FROM (SELECT trace_id, chunk_id, score, row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, chunk_id) AS rank
                      FROM s WHERE score >= 0.0) WHERE rank <= 5""",
)
def model_rerank(spark, sf):
    asks, scopes = b.open_requests(spark, sf)
    results = rt.rag_search(asks, b.index(spark, sf), scopes).join(
        asks.select("trace_id", tx.strip(F.col("query")).alias("query")), "trace_id"
    )
    closeness = lambda q, s: F.round(1.0 - F.abs(F.length(q) - F.length(s)) / 1000.0, 4)
    return rt.model_rerank(results, closeness, top_k=5).select("trace_id", "chunk_id", "score", "rank")


@register(
    "topk_per_query",
    _with(b.SQL_CHUNKS, OPEN_ASKS, BM25)
    + f" SELECT * FROM (SELECT trace_id, chunk_id, score, {_rank()} AS rank FROM bm WHERE score > 0) WHERE rank <= 3",
)
def topk_per_query(spark, sf):
    asks, scopes = b.open_requests(spark, sf)
    return rt.bm25(asks, b.index(spark, sf), scopes, pool=3)


@register(
    "rank_from_score",
    _with(b.SQL_CHUNKS, OPEN_ASKS, REQUIRED, MATCHES) + f" SELECT trace_id, chunk_id, {_rank()} AS rank FROM hits WHERE score > 0",
)
def rank_from_score(spark, sf):
    asks, scopes = b.open_requests(spark, sf)
    rows = rt.keyword_matches(asks, b.index(spark, sf), scopes)
    return rt.rank_by_score(rows, ["trace_id"]).select("trace_id", "chunk_id", "rank")


@register(
    "best_chunk_per_doc",
    _with(b.SQL_CHUNKS, OPEN_ASKS, BM25)
    + """, d AS (SELECT trace_id, doc_id, chunk_id, score, row_number() OVER (PARTITION BY trace_id, doc_id ORDER BY score DESC, chunk_id) AS n
              FROM bm JOIN chunks USING (chunk_id) WHERE score > 0)
       SELECT * FROM (SELECT trace_id, doc_id, chunk_id, score,
                      row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, chunk_id) AS rank FROM d WHERE n = 1) WHERE rank <= 8""",
)
def best_chunk_per_doc(spark, sf):
    asks, scopes = b.open_requests(spark, sf)
    return rt.bm25_per_document(asks, b.index(spark, sf), scopes).select("trace_id", "doc_id", "chunk_id", "score", "rank")


@register(
    "search_stats",
    _with(b.SQL_SECURE, USER_ASKS, REQUIRED, MATCHES, SEARCH)
    + """ SELECT a.trace_id, (SELECT count(*) FROM chunks) AS candidates_before_rls, count(r.chunk_id) AS results_after_rls
         FROM asks a LEFT JOIN results r USING (trace_id) GROUP BY 1""",
)
def search_stats(spark, sf):
    asks, scopes = b.requests(spark, sf)
    index = b.index(spark, sf)
    return rt.search_stats(asks, rt.rag_search(asks, index, scopes), index.chunks)


@register(
    "diversity_penalty",
    _with(b.SQL_CHUNKS, OPEN_ASKS, BM25)
    + f""", t AS (SELECT trace_id, chunk_id, score, {_rank()} AS rank FROM bm WHERE score > 0),
       u AS (SELECT trace_id, doc_id, chunk_id, rank FROM t JOIN chunks USING (chunk_id) WHERE rank <= 20)
       SELECT trace_id, chunk_id, CASE WHEN row_number() OVER (PARTITION BY trace_id, doc_id ORDER BY rank) > 1 THEN 0.08 ELSE 0.0 END::DOUBLE AS penalty FROM u""",
)
def diversity_penalty(spark, sf):
    asks, scopes = b.open_requests(spark, sf)
    index = b.index(spark, sf)
    top = rt.with_texts(reuse(rt.bm25(asks, index, scopes, pool=20)), index)
    zero = F.lit(0.0)
    penalty = sc.rerank_score(zero, zero, zero, F.lit(False)) - sc.rerank_score(zero, zero, zero, F.col("repeat"))
    return top.withColumn("repeat", rt.repeats_document()).select("trace_id", "chunk_id", penalty.alias("penalty"))


# --- vectors ---------------------------------------------------------------------------------

PROTOTYPES = """
pr AS (SELECT CAST(label AS VARCHAR) AS query_id, i, avg(CAST(embedding[i] AS DOUBLE)) AS v
       FROM embeddings, unnest(range(1, len(embedding) + 1)) t(i) GROUP BY 1, 2),
pq AS (SELECT query_id, list(v ORDER BY i) AS q FROM pr GROUP BY 1),
cosines AS (SELECT query_id, vec_id, label,
            round(list_sum(list_transform(list_zip(q, embedding), lambda z: z[1] * CAST(z[2] AS DOUBLE)))
                  / (sqrt(list_sum(list_transform(q, lambda x: x * x)))
                     * sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6) AS score
            FROM pq, embeddings)
"""


def prototypes(spark, sf):
    """Mean vector of each label, as query vectors."""
    rows = b.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    means = rows.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    packed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))
    return packed.select(F.col("label").cast("string").alias("query_id"), F.transform("s", lambda x: x["v"]).alias("vector"))


@register(
    "vector_topk",
    _with(PROTOTYPES)
    + """ SELECT query_id, vec_id, score, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cosines) WHERE rank <= 20""",
)
def vector_topk(spark, sf):
    return vs.vector_topk(prototypes(spark, sf), b.table(spark, sf, "embeddings"), 20)


@register(
    "vector_topk_by_scope",
    _with(PROTOTYPES)
    + """ SELECT query_id, 'v' || vec_id AS chunk_id, score, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 'v' || vec_id) AS rank FROM cosines
          WHERE (CAST(query_id AS BIGINT) + vec_id % 7) % 3 <> 0) WHERE rank <= 20""",
)
def vector_topk_by_scope(spark, sf):
    """Each query sees its own labels only; ids are strings, as in the chunk table."""
    rows = b.table(spark, sf, "embeddings").select(
        F.concat(F.lit("v"), "vec_id").alias("chunk_id"), "embedding", (F.col("vec_id") % 7).alias("label_id"), "label"
    )
    asked = prototypes(spark, sf).withColumn("scope_id", F.col("query_id").cast("bigint"))
    held = rows.select("label_id").distinct().join(
        rows.select(F.col("label").cast("bigint").alias("scope_id")).distinct(), (F.col("scope_id") + F.col("label_id")) % 3 != 0
    )
    return vs.vector_topk(asked, rows, 20, "chunk_id", scopes=held.select("scope_id", "label_id"))


@register(
    "cosine",
    _with(PROTOTYPES) + " SELECT vec_id, score FROM cosines WHERE query_id = CAST(label AS VARCHAR)",
)
def cosine(spark, sf):
    own = b.table(spark, sf, "embeddings").withColumn("query_id", F.col("label").cast("string"))
    return own.join(prototypes(spark, sf), "query_id").select(
        "vec_id", F.round(vx.cosine(F.col("vector"), F.col("embedding")), 6).alias("score")
    )


HASH_EMBED = """
toks AS (SELECT id, unnest(regexp_extract_all(lower(txt), '[a-zа-яё0-9]{3,}')) AS tok FROM src),
bk AS (SELECT id, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS bucket, count(*) AS c FROM toks GROUP BY 1, 2),
nm AS (SELECT id, sqrt(sum(c * c)::DOUBLE) AS n FROM bk GROUP BY 1)
"""


@register(
    "hash_embedding",
    "WITH src AS (SELECT doc_id AS id, text AS txt FROM documents), " + HASH_EMBED.strip()
    + " SELECT id AS doc_id, bucket, round(c / n, 6) AS weight FROM bk JOIN nm USING (id)",
)
def hash_embedding(spark, sf):
    vec = vx.hash_embedding(F.col("text"))
    rows = b.table(spark, sf, "documents").select("doc_id", F.posexplode(vec).alias("bucket", "weight"))
    return rows.where("weight > 0").select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.round("weight", 6).alias("weight"))


@register(
    "hybrid_score",
    "WITH src AS (SELECT 'd' || doc_id AS id, text AS txt FROM documents UNION ALL SELECT 'b' || item_id, text FROM benchmark), "
    + HASH_EMBED.strip()
    + f""", cs AS (SELECT d.id AS did, q.id AS qid, sum(d.c * q.c)::DOUBLE AS dp FROM bk d JOIN bk q USING (bucket)
                 WHERE d.id LIKE 'd%' AND q.id LIKE 'b%' AND substr(d.id, 2) = substr(q.id, 2) GROUP BY 1, 2),
       p AS (SELECT d.doc_id, round({sql_match_score("regexp_replace(b.text, '^\\s+|\\s+$', '', 'g')", "d.text")}, 6) AS kw,
                    round(coalesce(dp / (n1.n * n2.n), 0.0), 6) AS cosine
             FROM documents d JOIN benchmark b ON d.doc_id = b.item_id
             LEFT JOIN cs ON did = 'd' || d.doc_id LEFT JOIN nm n1 ON n1.id = did LEFT JOIN nm n2 ON n2.id = qid)
       SELECT doc_id, cosine, round(CASE WHEN kw >= 0.99 THEN kw ELSE 0.85::DOUBLE * kw + (1.0::DOUBLE - 0.85::DOUBLE) * cosine END, 6) AS score FROM p""",
)
def hybrid_score(spark, sf):
    docs, bench = b.table(spark, sf, "documents"), b.table(spark, sf, "benchmark")
    pairs = docs.join(bench.withColumnRenamed("text", "query"), F.col("doc_id") == F.col("item_id"))
    kw = F.round(sc.match_score(F.col("query"), F.col("text")), 6)
    cos = F.round(vx.cosine(vx.hash_embedding(F.col("query")), vx.hash_embedding(F.col("text"))), 6)
    rows = pairs.select("doc_id", kw.alias("kw"), cos.alias("cosine"))
    return rows.select("doc_id", "cosine", F.round(sc.hybrid_score(F.col("kw"), F.col("cosine")), 6).alias("score"))


@register(
    "embed_stale",
    "WITH src AS (SELECT d.doc_id AS id, text AS txt FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL), "
    + HASH_EMBED.strip()
    + """ SELECT s.id AS doc_id, count(bucket) AS used_buckets, coalesce(CAST(max(c) AS BIGINT), 0) AS top_count
         FROM src s LEFT JOIN bk USING (id) GROUP BY 1""",
)
def embed_stale(spark, sf):
    # documents with labels stand for those embedded before
    docs = b.table(spark, sf, "documents")
    done = b.table(spark, sf, "labels").select("doc_id", F.array_repeat(F.lit(0.125), 64).alias("embedding"))
    stale = vs.stale_embeddings(docs.join(done, "doc_id", "left"), 64)
    fresh = vs.embed(stale.drop("embedding"), "text")
    used = F.filter("embedding", lambda v: v > 0)
    norm_unit = F.array_min(used)
    toks = F.regexp_extract_all(F.lower("text"), F.lit("[a-zа-яё0-9]{3,}"), F.lit(0))
    # counts come back from the unit vector through its length
    counts = F.sqrt(F.aggregate(used, F.lit(0.0), lambda a, v: a + v * v))
    total = F.aggregate(used, F.lit(0.0), lambda a, v: a + v)
    scale = F.when(total > 0, F.size(toks) / total)
    return fresh.select(
        "doc_id",
        F.when(norm_unit.isNull(), 0).otherwise(F.size(used)).cast("bigint").alias("used_buckets"),
        F.coalesce(F.round(F.array_max(used) * scale * counts, 0), F.lit(0.0)).cast("bigint").alias("top_count"),
    )


# --- lookups ---------------------------------------------------------------------------------

SQL_NAMES = """
nq AS (SELECT CAST(page_id AS VARCHAR) AS trace_id, 'File ' || page_id || ' ' || regexp_extract(url, '//([^./]+)', 1) AS q FROM pages)
"""


def _name_requests(spark, sf):
    host = F.regexp_extract("url", "//([^./]+)", 1)
    return b.table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("trace_id"),
        F.concat(F.lit("File "), F.col("page_id"), F.lit(" "), host).alias("query"),
    )


def sql_path_score(q: str, p: str) -> str:
    toks = f"regexp_extract_all(lower({q}), '{T2}')"
    name = f"regexp_extract({p}, '[^/]*$')"
    n, h = f"len({toks})", f"len(list_filter({toks}, lambda x: contains(lower({p}), x)))"
    nh = f"len(list_filter({toks}, lambda x: contains(lower({name}), x)))"
    return f"""CASE WHEN contains({name}, {q}) THEN 10.0::DOUBLE WHEN contains(lower({name}), lower({q})) THEN 8.0 WHEN {n} = 0 OR {h} = 0 THEN 0.0
       WHEN {n} >= 2 AND {h} < {n} THEN {h}::DOUBLE / {n} * 3.0 + 0.5 * {nh} ELSE {h} + 0.5 * {nh} + 0.25 END"""


PATHS = f"""
px AS (SELECT trace_id, q, source_relative_path AS relative_path, corpus_id,
              round({sql_path_score('q', 'source_relative_path')}, 3) AS score FROM nq, docs)
"""


@register(
    "path_search",
    _with(b.SQL_DOCS, SQL_NAMES, PATHS)
    + """ SELECT trace_id, rank, relative_path, regexp_extract(relative_path, '[^/]*$') AS file_name, score FROM (
          SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, relative_path) AS rank FROM px WHERE score > 0) WHERE rank <= 10""",
)
def path_search(spark, sf):
    manifest = b.documents(spark, sf).select(F.col("source_relative_path").alias("relative_path"))
    return rt.path_search(_name_requests(spark, sf), manifest)


@register(
    "cross_corpus_suggest",
    _with(b.SQL_DOCS, SQL_NAMES, PATHS)
    + """, m AS (SELECT trace_id, corpus_id, max(score) AS score FROM px WHERE corpus_id <> 'north' GROUP BY 1, 2)
        SELECT trace_id, corpus_id, score FROM (
          SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, corpus_id) AS n FROM m) WHERE n = 1 AND score >= 2.0""",
)
def cross_corpus_suggest(spark, sf):
    manifest = b.documents(spark, sf).select(F.col("source_relative_path").alias("relative_path"), "corpus_id")
    asks = _name_requests(spark, sf).withColumn("corpus_id", F.lit("north"))
    return rt.cross_corpus_suggest(asks, manifest)


@register(
    "rank_for_content",
    """WITH r AS (SELECT page_id, 'текст ' || regexp_extract(url, '([0-9]+)', 1) AS q, lower(url || ' ' || regexp_extract(url, '[^/]*$')) AS target FROM pages)
       SELECT page_id, round(1.0::DOUBLE + CASE WHEN regexp_matches(target, 'письм|правк|letter|correspondence|корреспонд') THEN 4.0::DOUBLE
          WHEN contains(target, 'замечан') THEN -2.5::DOUBLE ELSE 0.0::DOUBLE END
          + 2.0::DOUBLE * len(list_filter(regexp_extract_all(q, '[а-яёa-z0-9]{2,}'), lambda x: regexp_matches(x, '[0-9]') AND contains(target, x)))
          + CASE WHEN regexp_matches(target, 'черт[её]ж|кмд|кж|схем|dwg|\\.dxf') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, 3) AS score FROM r""",
)
def rank_for_content(spark, sf):
    q = F.concat(F.lit("текст "), F.regexp_extract("url", "([0-9]+)", 1))
    return b.table(spark, sf, "pages").select(
        "page_id", F.round(sc.content_rank_score(q, F.col("url"), F.lit(1.0)), 3).alias("score")
    )


@register(
    "small_doc_search",
    _with(b.SQL_DOCS)
    + f""", sq AS (SELECT CAST(item_id AS VARCHAR) AS trace_id, lower({_STRIP.format('text')}) AS q FROM benchmark),
       st AS (SELECT *, list_filter(regexp_split_to_array(replace(q, ',', ' '), '\\s+'), lambda x: length(x) > 2) AS ws FROM sq),
       sx AS (SELECT trace_id, q, source_relative_path AS relative_path, text,
              CASE WHEN contains(lower(regexp_extract(source_relative_path, '[^/]*$')), q) THEN 5 ELSE 0 END
              + CASE WHEN contains(lower(source_relative_path), q) THEN 3 ELSE 0 END + CASE WHEN contains(lower(text), q) THEN 2 ELSE 0 END
              + len(list_filter(ws, lambda x: contains(lower(source_relative_path), x) OR contains(lower(text), x))) AS score
              FROM st, docs)
       SELECT trace_id, rank, relative_path, CAST(score AS INT) AS score,
              {_STRIP.format("replace(substr(text, CAST(CASE WHEN instr(lower(text), q) > 0 THEN greatest(instr(lower(text), q) - 40, 1) ELSE 1 END AS BIGINT), 120), chr(10), ' ')")} AS snippet
       FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, relative_path) AS rank FROM sx WHERE score > 0) WHERE rank <= 20""",
)
def small_doc_search(spark, sf):
    asks = b.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("trace_id"), F.col("text").alias("query"))
    docs = b.documents(spark, sf).select(F.col("source_relative_path").alias("relative_path"), F.col("text").alias("content"))
    return rt.small_doc_search(asks, docs)


@register(
    "doc_chunks",
    _with(b.SQL_CHUNKS)
    + """, tg AS (SELECT 'd' || doc_id AS target_id, 'doc_' || doc_id AS t_doc, NULL AS t_path FROM labels
             UNION ALL SELECT 'p' || n_nationkey, NULL, 'src' || n_nationkey || '/en' FROM nation)
       SELECT DISTINCT target_id, chunk_id FROM tg JOIN chunks ON chunks.doc_id = tg.t_doc
       UNION SELECT DISTINCT target_id, chunk_id FROM tg JOIN chunks ON contains(lower(source_relative_path), t_path)""",
)
def doc_chunks(spark, sf):
    by_id = b.table(spark, sf, "labels").select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("target_id"),
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("doc_id"),
        F.lit(None).cast("string").alias("relative_path"),
    )
    by_path = b.table(spark, sf, "nation").select(
        F.concat(F.lit("p"), F.col("n_nationkey")).alias("target_id"),
        F.lit(None).cast("string").alias("doc_id"),
        F.concat(F.lit("src"), F.col("n_nationkey"), F.lit("/en")).alias("relative_path"),
    )
    return rt.doc_chunks(by_id.unionByName(by_path), b.chunks(spark, sf))


@register(
    "scoped_search",
    _with(b.SQL_CHUNKS, OPEN_ASKS, REQUIRED, MATCHES)
    + """, ok AS (SELECT DISTINCT trace_id, score, chunk_id FROM hits JOIN chunks USING (chunk_id)
             WHERE score > 0 AND contains(lower(source_relative_path), 'src' || (CAST(trace_id AS BIGINT) % 20) || '/'))
       SELECT trace_id, rank, chunk_id, round(score, 4) AS score FROM (
         SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, chunk_id) AS rank FROM ok) WHERE rank <= 8""",
)
def scoped_search(spark, sf):
    asks, scopes = b.open_requests(spark, sf)
    folder = F.concat(F.lit("src"), F.col("trace_id").cast("bigint") % 20, F.lit("/"))
    paths = asks.select("trace_id", folder.alias("relative_path"))
    return rt.scoped_search(asks, paths, b.index(spark, sf), scopes)


ANALYSIS = f"""
aw AS (SELECT *, {_STRIP.format('content')} AS t FROM chunks),
aq AS (SELECT doc_id, chunk_id, length(t) AS len, t, {sql_quality('t')} AS quality FROM aw),
am AS (SELECT *, round(quality * least(len, 800), 6) AS weight, t <> '' AND quality >= 0.15 AS ok FROM aq),
ar AS (SELECT doc_id, chunk_id, row_number() OVER w AS rank,
              CAST(sum(len) OVER (PARTITION BY doc_id ORDER BY weight DESC, chunk_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_chars
       FROM am WHERE ok WINDOW w AS (PARTITION BY doc_id ORDER BY weight DESC, chunk_id)),
ag AS (SELECT * FROM ar WHERE (running_chars <= 12000 OR rank = 1) AND rank <= 12),
ao AS (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS rank, NULL::BIGINT AS running_chars
       FROM am WHERE doc_id NOT IN (SELECT doc_id FROM ag)),
picked AS (SELECT * FROM ag UNION ALL SELECT * FROM ao WHERE rank <= 6)
"""


@register("running_char_budget", _with(b.SQL_CHUNKS, ANALYSIS) + " SELECT doc_id, chunk_id, rank, running_chars FROM picked")
def running_char_budget(spark, sf):
    return rt.select_for_analysis(b.chunks(spark, sf), ["doc_id"], script=b.LATIN)


@register(
    "doc_profile_select",
    _with(b.SQL_CHUNKS, ANALYSIS)
    + """ SELECT p.doc_id, p.rank, substr(c.content, 1, 1200) AS snippet, c.source_relative_path AS relative_path,
             regexp_extract(c.source_relative_path, '[^/]*$') AS file_name
         FROM picked p JOIN chunks c USING (chunk_id) JOIN labels l ON p.doc_id = 'doc_' || l.doc_id""",
)
def doc_profile_select(spark, sf):
    wanted = b.table(spark, sf, "labels").select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("doc_id"))
    mine = b.chunks(spark, sf).join(wanted, "doc_id", "left_semi")
    picked = rt.select_for_analysis(mine, ["doc_id"], script=b.LATIN)
    rows = picked.select("chunk_id", "rank").join(mine, "chunk_id").withColumn("c", ch.analysis_citation())
    return rows.select("c.doc_id", "rank", "c.snippet", "c.relative_path", "c.file_name")


MERGED = f"""
ct AS (SELECT trace_id, source_relative_path AS relative_path, min(rank) AS rank FROM (
               SELECT h.*, c.source_relative_path, row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, h.chunk_id) AS rank
               FROM hits h JOIN chunks c USING (chunk_id) WHERE score > 0) WHERE rank <= 8 GROUP BY 1, 2),
       nq AS (SELECT CAST(item_id AS VARCHAR) AS trace_id, 'File ' || item_id AS q FROM benchmark),
       px AS (SELECT trace_id, q, source_relative_path AS relative_path, round({sql_path_score('q', 'source_relative_path')}, 3) AS score FROM nq, docs),
       p0 AS (SELECT trace_id, relative_path, rank, length(trace_id) >= 2 AND regexp_matches(regexp_extract(relative_path, '[^/]*$'), '(№|#|^|[^a-zA-Z0-9_])' || trace_id || '([^a-zA-Z0-9]|$)') AS hit
              FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, relative_path) AS rank FROM px WHERE score > 0) WHERE rank <= 12),
       pt AS (SELECT * FROM (SELECT *, bool_or(hit) OVER (PARTITION BY trace_id) AS any_hit FROM p0) WHERE hit OR NOT any_hit),
       un AS (SELECT trace_id, relative_path, rank, 0 AS part FROM ct
              UNION ALL SELECT p.trace_id, p.relative_path, p.rank, 1 FROM pt p LEFT JOIN ct USING (trace_id, relative_path) WHERE ct.rank IS NULL),
       sc AS (SELECT *, regexp_extract(relative_path, '[^/]*$') || ' ' || relative_path AS nm FROM un),
       sd AS (SELECT *, CASE WHEN regexp_matches(nm, '(№|#|^|[^a-zA-Z0-9_])' || trace_id || '([^a-zA-Z0-9]|$)') AND length(trace_id) >= 2 THEN 100 ELSE 0 END
              - 40 * len(list_filter(regexp_extract_all(nm, '[0-9]{{2,}}'), lambda x: x <> trace_id)) AS s0 FROM sc),
       merged AS (SELECT trace_id, position, relative_path, CAST(number_score AS INT) AS number_score, CAST(part AS INT) AS part FROM (
         SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY number_score DESC, part, rank, relative_path) AS position
         FROM (SELECT *, CASE WHEN length(trace_id) >= 2 THEN s0 ELSE 0 END AS number_score FROM sd)) WHERE position <= 8)
"""


@register(
    "append_path_matches",
    _with(b.SQL_CHUNKS, OPEN_ASKS, REQUIRED, MATCHES, MERGED) + " SELECT * FROM merged",
)
def append_path_matches(spark, sf):
    return _merged(spark, sf)


def _merged(spark, sf):
    asks, scopes = b.open_requests(spark, sf)
    top = rt.top_matches(asks, b.index(spark, sf), scopes, 8)
    content = top.groupBy("trace_id", F.col("source_relative_path").alias("relative_path")).agg(F.min("rank").alias("rank"))
    named = asks.select("trace_id", F.concat(F.lit("File "), F.col("trace_id")).alias("query"))
    manifest = b.documents(spark, sf).select(F.col("source_relative_path").alias("relative_path"))
    by_path = rt.path_search(named, manifest, 12)
    numbers = named.select("trace_id", F.regexp_extract_all("query", F.lit(r"(\d{2,})"), F.lit(1)).alias("numbers"))
    return rt.merge_path_matches(content, by_path, numbers)


@register(
    "search_hit_counts",
    _with(b.SQL_CHUNKS, OPEN_ASKS, REQUIRED, MATCHES, MERGED)
    + """, n AS (SELECT trace_id, count(*) FILTER (part = 0) AS c, count(*) FILTER (part = 1) AS p FROM merged GROUP BY 1)
       SELECT CAST(item_id AS VARCHAR) AS trace_id, coalesce(c, 0) AS content_hits, coalesce(p, 0) AS path_only_hits,
              CASE WHEN item_id % 5 = 0 THEN 'file_list' WHEN coalesce(p, 0) > 0 AND coalesce(c, 0) = 0 THEN 'path_only' ELSE 'content' END AS search_mode
       FROM benchmark LEFT JOIN n ON n.trace_id = CAST(item_id AS VARCHAR)""",
)
def search_hit_counts(spark, sf):
    """Every fifth passage is taken as a request for files."""
    asks, _ = b.open_requests(spark, sf)
    return rt.hit_counts(asks, _merged(spark, sf), F.col("trace_id").cast("bigint") % 5 == 0)


@register(
    "merge_citations",
    f"""WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'file_preview' WHEN role = 'user' THEN 'index' END AS source, {_STRIP.format('text')} AS s FROM conversations),
        k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, coalesce(source, 'index'), length(s), substr(s, 1, 120) ORDER BY turn) AS n FROM c WHERE s <> ''),
        f AS (SELECT *, CASE WHEN source = 'file_preview' AND row_number() OVER (PARTITION BY conv_id, coalesce(source = 'file_preview', false) ORDER BY turn) = 1 THEN 0 ELSE 1 END AS lead FROM k WHERE n = 1)
        SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY lead, turn) AS position FROM f""",
)
def merge_citations(spark, sf):
    source = F.when(F.col("role") == "system", "file_preview").when(F.col("role") == "user", "index")
    rows = b.table(spark, sf, "conversations").select("conv_id", "turn", source.alias("source"), F.col("text").alias("snippet"))
    return rt.merge_citations(rows, ["conv_id"], ["turn"]).select("conv_id", "turn", "position")


@register(
    "doc_path_enrich",
    _with(b.SQL_DOCS)
    + """ SELECT l.doc_id, CASE WHEN l.quality = 1 THEN 'kept/' || l.doc_id || '.txt' ELSE d.source_relative_path END AS relative_path,
            regexp_extract(CASE WHEN l.quality = 1 THEN 'kept/' || l.doc_id || '.txt' ELSE d.source_relative_path END, '[^/]*$') AS file_name
         FROM labels l LEFT JOIN docs d ON d.doc_no = l.doc_id""",
)
def doc_path_enrich(spark, sf):
    own = F.when(F.col("quality") == 1, F.concat(F.lit("kept/"), F.col("doc_id"), F.lit(".txt")))
    citations = b.table(spark, sf, "labels").select("doc_id", own.alias("relative_path"))
    catalog = b.documents(spark, sf).select(F.col("doc_no").alias("doc_id"), F.col("source_relative_path").alias("relative_path"))
    return ig.enrich_paths(citations, catalog).select("doc_id", "relative_path", "file_name")


# --- short requests, by users who see much, little and nothing ---------------------------------


@register(
    "match_score_short",
    _with(b.SQL_CHUNKS, OPEN_SHORT, REQUIRED, MATCHES) + " SELECT trace_id, chunk_id, score FROM hits WHERE score > 0",
)
def match_score_short(spark, sf):
    asks, scopes = b.open_short_requests(spark, sf)
    return rt.keyword_matches(asks, b.index(spark, sf), scopes).select("trace_id", "chunk_id", "score")


@register(
    "required_optional_tokens_short",
    _with(b.SQL_SECURE, USER_SHORT, REQUIRED)
    + """ SELECT trace_id, array_to_string(list_sort(list_distinct(required)), ' ') AS required,
                 array_to_string(list_sort(list_distinct(list_filter(toks, lambda x: NOT list_contains(required, x)))), ' ') AS optional
          FROM req""",
)
def required_optional_tokens_short(spark, sf):
    asks, scopes = b.short_requests(spark, sf)
    asked = rt.required_tokens(asks, b.index(spark, sf), scopes)
    words = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), " ").alias(c)
    return asked.select("trace_id", words("required"), words("optional"))


@register(
    "bm25_short",
    _with(b.SQL_SECURE, USER_SHORT, BM25)
    + f" SELECT * FROM (SELECT trace_id, chunk_id, score, {_rank()} AS rank FROM bm WHERE score > 0) WHERE rank <= 20",
)
def bm25_short(spark, sf):
    asks, scopes = b.short_requests(spark, sf)
    return rt.bm25(asks, b.index(spark, sf), scopes, pool=20)


@register(
    "fulltext_hybrid_short",
    _with(b.SQL_SECURE, USER_SHORT, REQUIRED, MATCHES, BM25, FULLTEXT) + " SELECT trace_id, chunk_id, score, rank FROM full_text",
)
def fulltext_hybrid_short(spark, sf):
    asks, scopes = b.short_requests(spark, sf)
    return rt.fulltext_hybrid(asks, b.index(spark, sf), scopes)


@register(
    "rag_search_short",
    _with(b.SQL_SECURE, USER_SHORT, REQUIRED, MATCHES, SEARCH)
    + " SELECT trace_id, rank, chunk_id, doc_id, score, classification, snippet FROM results",
)
def rag_search_short(spark, sf):
    asks, scopes = b.short_requests(spark, sf)
    return rt.rag_search(asks, b.index(spark, sf), scopes)


@register(
    "hybrid_search_short",
    _with(b.SQL_CHUNKS, OPEN_SHORT, REQUIRED, MATCHES)
    + ", src AS (SELECT 'c' || chunk_id AS id, content AS txt FROM chunks UNION ALL SELECT 'q' || trace_id, q FROM asks), "
    + HASH_EMBED.strip()
    + f""", cs AS (SELECT h.trace_id, h.chunk_id, sum(c.c * q.c)::DOUBLE AS dp
                 FROM hits h JOIN bk c ON c.id = 'c' || h.chunk_id JOIN bk q ON q.id = 'q' || h.trace_id AND q.bucket = c.bucket
                 WHERE h.score > 0 GROUP BY 1, 2),
       hy AS (SELECT h.trace_id, h.chunk_id, h.doc_id, h.score AS keyword, round(coalesce(dp / (n1.n * n2.n), 0.0), 6) AS cosine
              FROM hits h LEFT JOIN cs USING (trace_id, chunk_id)
              LEFT JOIN nm n1 ON n1.id = 'c' || h.chunk_id LEFT JOIN nm n2 ON n2.id = 'q' || h.trace_id WHERE h.score > 0),
       hs AS (SELECT *, round(CASE WHEN keyword >= 0.99 THEN keyword ELSE 0.85::DOUBLE * keyword + (1.0::DOUBLE - 0.85::DOUBLE) * cosine END, 6) AS score FROM hy)
       SELECT trace_id, chunk_id, doc_id, keyword, cosine, score, rank FROM (SELECT *, {_rank()} AS rank FROM hs) WHERE rank <= 8""",
)
def hybrid_search_short(spark, sf):
    asks, scopes = b.open_short_requests(spark, sf)
    return rt.hybrid_search(asks, b.index(spark, sf), scopes)


@register(
    "keyword_score_of_matches",
    _with(b.SQL_CHUNKS, OPEN_SHORT, REQUIRED, MATCHES)
    + f""", k AS (SELECT trace_id, chunk_id, lower(content) AS low, list_distinct(regexp_extract_all(lower(content), '{T2}')) AS ts,
                       list_distinct(toks) AS ks FROM hits WHERE score > 0)
        SELECT trace_id, chunk_id, round(CASE WHEN len(ks) = 0 THEN 1.0::DOUBLE ELSE
               len(list_filter(ks, lambda k: contains(low, k) OR len(list_filter(ts, lambda t: contains(t, k) OR contains(k, t))) > 0))::DOUBLE / len(ks) END, 6) AS score
        FROM k""",
)
def keyword_score_of_matches(spark, sf):
    """Keyword hits of every match of a search, each chunk taken as the answer."""
    asks, scopes = b.open_short_requests(spark, sf)
    rows = rt.keyword_matches(asks, b.index(spark, sf), scopes, answers=True)
    return rows.select("trace_id", "chunk_id", F.col("answer").alias("score"))
