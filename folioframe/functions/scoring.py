"""Score expressions over (query, text) columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioframe import fixed_values as fx
from folioframe.functions import text as tx


def _share(hits: Column, total: Column) -> Column:
    return hits.cast("double") / total


def match_score(query: Column, text: Column, text_lemmas: Column | None = None) -> Column:
    """Graded lexical match.

    1.0 phrase as written, .93 phrase in other case, drawing-mark rules, .88 all
    tokens as written, .80-.86 all tokens, .80 all lemmas, up to .52 for a part of
    the tokens; a single token can also match by lemma (.35-.72).
    """
    lemmas = tx.lemmas(F.coalesce(text, F.lit(""))) if text_lemmas is None else text_lemmas
    raw = F.coalesce(text, F.lit(""))
    inputs = F.struct(query_parts(query).alias("parts"), raw.alias("raw"), F.lower(raw).alias("low"))
    return tx.let(inputs, lambda x: match_score_of(x["parts"], x["raw"], x["low"], lemmas))


def query_parts(query: Column) -> Column:
    """What :func:`match_score_of` needs of a query: worked out once for all texts."""
    q = tx.strip(F.coalesce(query, F.lit("")))
    number = F.regexp_extract(q, "(?iu)" + fx.FENCE_QUERY, 1)
    return F.struct(
        q.alias("q"), F.lower(q).alias("ql"), tx.raw_tokens(q).alias("spelled"), tx.tokens(q).alias("toks"),
        tx.lemmas(q).alias("lems"), number.alias("number"),
    )


def match_score_of(parts: Column, raw: Column, low: Column, doc_lemmas: Column) -> Column:
    """The match score of prepared inputs; without ``doc_lemmas`` (null) no base form is looked up."""
    q, ql, spelled, toks, lems, number = (parts[c] for c in ("q", "ql", "spelled", "toks", "lems", "number"))
    n = F.size(toks)
    hits = F.size(F.filter(toks, lambda t: low.contains(t)))
    exact = F.size(F.filter(spelled, lambda t: raw.contains(t)))
    found = F.size(lems) - F.size(F.filter(lems, lambda t: ~F.array_contains(doc_lemmas, t)))
    lemma_hits = F.when(doc_lemmas.isNotNull(), found).otherwise(0)

    after_mark = F.concat(F.lit(r"ограждени[ея]\s*ог-"), number, F.lit(r"/([^/\n]{1,80})"))
    remark = F.call_function("regexp_extract", low, after_mark, F.lit(1))
    mark_seen = F.regexp_like(low, F.concat(F.lit("ог-"), number, F.lit(r"(?:(?![\p{L}\p{N}_])|/)")))

    partial = F.least(F.lit(0.52), F.lit(0.28) + F.lit(0.24) * _share(hits, n))
    by_lemma = F.when(lemma_hits > 0, F.lit(0.35) + F.lit(0.37) * _share(lemma_hits, F.size(lems))).otherwise(0.0)
    all_found = tx.let(
        exact, lambda e: F.when(e == n, 0.88).otherwise(F.lit(0.80) + F.lit(0.06) * _share(e, n))
    )
    return (
        F.when((q == "") | (raw == ""), 0.0)
        .when(raw.contains(q), 1.0)
        .when(low.contains(ql), 0.93)
        .when(
            (number != "") & (remark != ""),
            F.when(~remark.contains(fx.NO_REMARKS) & (F.length(tx.strip(remark)) > 3), 1.0).otherwise(0.85),
        )
        .when((number != "") & mark_seen, 0.96)
        .when(n == 0, 0.0)
        .when(hits == n, all_found)
        .when((n >= 2) & (F.size(lems) > 0) & (lemma_hits == F.size(lems)), 0.80)
        .when(n >= 2, partial)
        .otherwise(F.least(F.lit(0.72), by_lemma))
    )


def hybrid_score(keyword: Column, cosine: Column, weight: float = 0.5, local_embeddings: bool = True) -> Column:
    """Weighted keyword and vector score; a full phrase match stays as it is."""
    w = max(weight, 0.85) if local_embeddings else weight
    return F.when(keyword >= 0.99, keyword).otherwise(F.lit(w) * keyword + F.lit(1.0 - w) * cosine)


def quality_score(base: Column, quality: Column, overlap: Column) -> Column:
    """Score that lowers noisy pieces of text."""
    return F.when((base <= 0) | (quality < 0.12), 0.0).otherwise(
        base * (F.lit(0.5) + F.lit(0.5) * quality) + F.lit(0.2) * overlap
    )


def rerank_score(base: Column, quality: Column, overlap: Column, repeated: Column) -> Column:
    """Score used to order results again; later pieces of one document lose .08."""
    return (
        base * (F.lit(0.45) + F.lit(0.55) * quality)
        + F.lit(0.35) * overlap
        - F.when(repeated, 0.08).otherwise(0.0)
    )


def path_score(query: Column, path: Column) -> Column:
    """File lookup score: exact name 10, name in other case 8, then token shares."""
    q = tx.strip(query)
    toks = tx.tokens(q)
    target, name = F.lower(path), tx.base_name(path)
    hits = F.size(F.filter(toks, lambda t: target.contains(t)))
    in_name = F.size(F.filter(toks, lambda t: F.lower(name).contains(t)))
    return (
        F.when((q != "") & name.contains(q), 10.0)
        .when((q != "") & F.lower(name).contains(F.lower(q)), 8.0)
        .otherwise(path_score_of(F.size(toks), hits, in_name))
    )


def path_score_of(n: Column, hits: Column, in_name: Column) -> Column:
    """The part of :func:`path_score` that depends on how many tokens the path and its name hold."""
    return (
        F.when((n == 0) | (hits == 0), 0.0)
        .when((n >= 2) & (hits < n), _share(hits, n) * 3.0 + in_name * 0.5)
        .otherwise(hits + in_name * 0.5 + F.when(hits == n, 0.25).otherwise(0.0))
    )


def content_rank_score(query: Column, path: Column, base: Column, prefer_letters: bool = False) -> Column:
    """File score for questions about content: letters up, remarks down, numbers up."""
    ql = F.lower(query)
    target = F.lower(F.concat_ws(" ", path, tx.base_name(path)))
    wants = F.lit(prefer_letters) | ql.contains("письм") | ql.contains("текст")
    letter, remarks = target.rlike(fx.LETTER_HINT), target.rlike(fx.REMARKS_HINT)
    numbers = F.filter(tx.tokens(query), lambda t: t.rlike("[0-9]"))
    return (
        base
        + F.when(wants & letter, 4.0).when(wants & remarks, -2.5).otherwise(0.0)
        + F.size(F.filter(numbers, lambda t: target.contains(t))) * 2.0
        + F.when(F.lit(not prefer_letters) & target.rlike(fx.DRAWING_HINT), 0.5).otherwise(0.0)
    )


def small_doc_tokens(query: Column) -> Column:
    """The words of a request that are longer than two letters."""
    q = F.lower(tx.strip(query))
    return F.filter(F.split(F.translate(q, ",", " "), r"(?U)\s+"), lambda t: F.length(t) > 2)


def small_doc_score(query: Column, path: Column, content: Column) -> Column:
    """Name 5, path 3, content 2, and one for each token longer than two letters."""
    q, name = F.lower(tx.strip(query)), F.lower(tx.base_name(path))
    rel = F.lower(path)
    toks = small_doc_tokens(query)

    def score(body: Column) -> Column:
        return (
            F.when(name.contains(q), 5).otherwise(0)
            + F.when(rel.contains(q), 3).otherwise(0)
            + F.when(body.contains(q), 2).otherwise(0)
            + F.size(F.filter(toks, lambda t: body.contains(t) | rel.contains(t)))
        )

    return tx.let(F.lower(content), score)


def snippet_around(query: Column, content: Column) -> Column:
    """120 characters from 40 before the first hit, or from the start."""
    at = F.instr(F.lower(content), F.lower(tx.strip(query)))
    start = F.when(at > 0, F.greatest(at - 40, F.lit(1))).otherwise(1)
    return tx.strip(F.translate(F.substring(content, start, F.lit(120)), "\n", " "))


def attempt_score(answer: Column, keywords: Column, reference: Column) -> Column:
    """.7 keywords + .3 reference words (keywords only without a reference)."""
    kw = tx.keyword_score(answer, keywords)
    ref = F.slice(tx.tokens(reference), 1, 12)
    return F.when(F.coalesce(tx.strip(reference), F.lit("")) == "", kw).otherwise(
        kw * 0.7 + tx.keyword_score(answer, ref) * 0.3
    )


def attempt_passed(answer: Column, keywords: Column, reference: Column, threshold: float = 0.55) -> Column:
    ref = F.slice(tx.tokens(reference), 1, 12)
    hits = F.size(F.array_union(tx.keyword_hits(answer, keywords), tx.keyword_hits(answer, ref)))
    need = F.greatest(F.lit(1), F.floor(F.size(keywords) / 2))
    return (attempt_score(answer, keywords, reference) >= threshold) & (
        (F.size(keywords) <= 0) | (hits >= need)
    )
