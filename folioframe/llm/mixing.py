"""Mixing weights with soft domain membership.

A classifier learned from a labelled table gives every document a posterior over
domains; projected-gradient least squares then fits one non-negative rate per document
so that the expected tokens of every domain meet their targets.

Everything is DataFrame functions.  The classifier is naive Bayes over hashed words and
a few binned shape features, learned from sums and applied without a join.  A gradient
step needs a few numbers per domain from all documents; rates are an expression of the
posteriors and of one number per domain, so documents are never rewritten between steps.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import stored

SLOTS = 1 << 14  # hashed words
SHAPES = 512  # slots of the shape features: shares of capitals and of marks, each by size
SHAPE_WEIGHT = 4  # occurrences that a shape feature counts as
FIT_ROWS = 20_000  # labelled rows the classifier is fitted on
STEPS = 30
TOLERANCE = 1e-3  # of the total of tokens


def word_slots(text: Column) -> Column:
    """Array of slots: one per word of letters, and the shape features after them."""
    clean = F.coalesce(text, F.lit(""))
    words = F.split(F.lower(clean), r"[\s\p{Punct}]+")
    hashed = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int"))
    n = F.length(clean) + 1
    capital = F.regexp_count(clean, F.lit("[A-Z]"))
    marks = F.regexp_count(clean, F.lit(r"[!-/:-@\[-`{-~]"))
    size = F.least(F.lit(15), F.floor(F.log2(n))).cast("int")
    share = lambda part: F.least(F.lit(15), F.floor(part / n * 64)).cast("int")
    shapes = F.array(F.lit(SLOTS) + size * 16 + share(capital), F.lit(SLOTS + 256) + size * 16 + share(marks))
    shapes = F.flatten(F.array_repeat(shapes, SHAPE_WEIGHT))
    return F.concat(hashed, shapes)


def token_count(text: Column) -> Column:
    """Words of a text, 1 at least, as its number of tokens."""
    return F.greatest(F.size(F.split(F.coalesce(text, F.lit("")), r"\s+")), F.lit(1)).cast("double")


def fit_classifier(
    docs: DataFrame,
    labels: DataFrame,
    domains: Sequence[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    rows: int = FIT_ROWS,
) -> tuple[list[float], list[list[float]]]:
    """(log prior per domain, log odds against the first domain per slot).

    ``labels``: id, domain.  The ``rows`` labelled documents with the smallest hash of
    the id are read; unlabelled ones, null domains and unknown names take no part.
    """
    known = labels.where(F.col("domain").isin(list(domains)) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min("domain").alias("_domain"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    # at most ``rows`` narrow rows
    seen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id")
    slots = seen.select("_domain", F.explode(word_slots(F.col("_text"))).alias("_slot"))
    counted = {(r["_domain"], r["_slot"]): r["n"] for r in slots.groupBy("_domain", "_slot").agg(F.count("*").alias("n")).collect()}
    sizes = {r["_domain"]: r["n"] for r in seen.groupBy("_domain").agg(F.count("*").alias("n")).collect()}
    width = SLOTS + SHAPES
    table = np.array([[counted.get((d, s), 0) for s in range(width)] for d in domains], dtype=float)
    base = (table.sum(axis=0) + 0.5) / (table.sum() + 0.5 * width)
    smooth = 20.0  # pseudo-count of a slot that is as frequent as all slots are on average
    share = (table + smooth * base * width) / (table.sum(axis=1, keepdims=True) + smooth * width)
    total = sum(sizes.values()) + len(domains)
    prior = [math.log((sizes.get(d, 0) + 1) / total) for d in domains]
    return prior, np.round(np.log(share) - np.log(share[0]), 6).tolist()


def posteriors(docs: DataFrame, model, domains: Sequence[str], text_col: str = "text") -> DataFrame:
    """Adds ``_p``: array of the posterior of each domain, and ``_tokens``."""
    prior, odds = model
    others = range(1, len(domains))
    # as text, which is parsed once while the plan is made
    weights = F.split(F.lit(",".join(repr(float(x)) for k in others for x in odds[k])), ",").cast("array<double>")
    width = len(odds[0])

    def add(sums: Column, slot: Column) -> Column:
        at = lambda k: F.get(weights, slot + (k - 1) * width)
        return F.struct(*[(sums[f"s{k}"] + at(k)).alias(f"s{k}") for k in others])

    if len(domains) > 1:
        zero = F.struct(*[F.lit(prior[k] - prior[0]).alias(f"s{k}") for k in others])
        sums = F.aggregate(word_slots(F.col(text_col)), zero, add)
        docs = docs.withColumns({"_sums": sums, "_tokens": token_count(F.col(text_col))})
        logits = F.array(F.lit(0.0), *[F.col("_sums")[f"s{k}"] for k in others])
    else:
        docs = docs.withColumn("_tokens", token_count(F.col(text_col)))
        logits = F.array(F.lit(0.0))
    docs = docs.withColumn("_logits", logits)
    of = lambda k: F.exp(F.col("_logits")[k] - F.array_max("_logits"))
    total = sum((of(k) for k in range(len(domains))), F.lit(0.0))
    return docs.withColumn("_p", F.array(*[of(k) / total for k in range(len(domains))])).drop("_sums", "_logits")


def rate(p: Column, pull: Sequence[float]) -> Column:
    """The rate of a document: 1 plus its posteriors times the gradient sum, projected to 0 or more."""
    return F.greatest(F.lit(0.0), sum((p[k] * float(x) for k, x in enumerate(pull)), F.lit(1.0)))


def fit_rates(soft: DataFrame, targets: Sequence[float], steps: int = STEPS, tolerance: float = TOLERANCE) -> np.ndarray:
    """The gradient sum that projected-gradient least squares reaches on ``soft`` (_p, _tokens).

    Minimises the squared gap between expected and wanted tokens per domain over rates
    of at least 0.  A gradient moves a document's rate by its posteriors times one
    number per domain, so the sum of all gradients so far is one number per domain too:
    it is kept unprojected, and the rates are its projection.  A step is one aggregate
    of all documents, scaled by the Gram matrix of those with a rate above 0.
    """
    kinds = range(len(targets))
    pairs = [(i, j) for i in kinds for j in kinds if i <= j]
    n, p = F.col("_tokens"), F.col("_p")
    goal, pull = np.array(targets, float), np.zeros(len(targets))
    for _ in range(steps):
        rows = soft.select(n.alias("n"), p.alias("p"), rate(p, pull).alias("r"))
        moving = F.when(F.col("r") > 0, F.col("n")).otherwise(0.0)
        now = rows.agg(
            *[F.sum(F.col("n") * F.col("p")[k] * F.col("r")).alias(f"t{k}") for k in kinds],
            *[F.sum(moving * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}") for i, j in pairs],
            *[F.sum(F.col("n") * F.col("p")[k]).alias(f"h{k}") for k in kinds],
        ).first()
        value = lambda name: now[name] or 0.0
        gap = goal - np.array([value(f"t{k}") for k in kinds])
        if np.abs(gap).max() <= tolerance * max(goal.sum(), 1.0):
            break
        gram = np.array([[value(f"g{min(i, j)}_{max(i, j)}") for j in kinds] for i in kinds])
        gram += np.diag([0.02 * value(f"h{k}") + 1e-9 for k in kinds])
        pull = pull + np.linalg.solve(gram, gap)
    return pull


def mix(
    docs: DataFrame,
    labels: DataFrame,
    weights: Mapping[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    total_tokens: float | None = None,
    whole: str | None = None,
) -> DataFrame:
    """Per row: id, tokens, posterior (array in the order of ``weights``), domain, rate.

    ``labels``: id, domain.  Targets are ``weights``, scaled to sum to 1, times
    ``total_tokens``; by default the largest total for which no domain must give more
    tokens than it is expected to have, so the scarcest domain sets how much stays.
    With ``whole``, that domain keeps what it has and sets the total; the others are
    thinned to their targets, and one that has less than its target stays as it is.

    A null text is an empty one.  Repeated rows and null ids are rows like any other.
    ``domain`` is the likeliest one, the first of equals.  An empty table gives an empty
    result.
    """
    if whole is not None and (total_tokens is not None or not weights[whole] > 0):
        raise ValueError("whole is a domain with a weight above 0, and sets the total itself")
    domains = list(weights)
    model = fit_classifier(docs, labels, domains, id_col, text_col)
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    soft = posteriors(base, model, domains, "_text").select("_id", "_tokens", "_p")
    soft = stored(soft, "posteriors")
    have = soft.agg(*[F.sum(F.col("_tokens") * F.col("_p")[k]).alias(f"t{k}") for k in range(len(domains))]).first()
    have = [have[f"t{k}"] or 0.0 for k in range(len(domains))]
    share = [weights[d] / sum(weights.values()) for d in domains]
    if whole is not None:
        at = domains.index(whole)
        targets = [min(h, w * have[at] / share[at]) for h, w in zip(have, share)]
    else:
        if total_tokens is None:
            total_tokens = min((h / w for h, w in zip(have, share) if w > 0), default=0.0)
        targets = [w * total_tokens for w in share]
    pull = fit_rates(soft, targets)
    best = F.array_position("_p", F.array_max("_p")) - 1
    return soft.select(
        F.col("_id").alias(id_col),
        F.col("_tokens").cast("long").alias("tokens"),
        F.col("_p").alias("posterior"),
        F.get(F.lit(domains), best.cast("int")).alias("domain"),
        rate(F.col("_p"), pull).alias("rate"),
    )


def keep_by_rate(docs: DataFrame, rates: DataFrame, id_col: str = "doc_id", seed: int = 17) -> DataFrame:
    """The rows of ``docs`` that stay when a document of rate r stays with probability min(1, r)."""
    draw = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 40)) / float(1 << 40))
    gone = rates.where(draw >= F.col("rate")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("_gone")), "left_anti")


def label_domains(labels: DataFrame) -> DataFrame:
    """Domains of the labels table: toxic, low (quality 0), clean; rows with a null label are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(
        (F.col("quality") == 1) & (F.col("toxic") == 0), "clean"
    )
    return labels.select("doc_id", domain.alias("domain"))
