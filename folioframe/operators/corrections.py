"""Mining of replacement rules from corrected text, and applying them."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe import fixed_values as fx
from folioframe.functions import text as tx

_SAME = "\u0001"  # stands for a word that both texts have


def _words(c: Column) -> Column:
    return F.split(tx.squeeze(c), " ")


def _differing_runs(a: Column, b: Column) -> Column:
    """Pairs of word runs that differ, of two arrays of one length compared place by place."""
    at = F.sequence(F.lit(0), F.size(a) - 1)

    def runs(own: Column, other: Column) -> Column:
        marked = F.transform(at, lambda i: F.when(own[i] == other[i], F.lit(_SAME)).otherwise(own[i]))
        return F.filter(F.split(F.array_join(marked, " "), f" ?{_SAME}[{_SAME} ]*"), lambda s: s != "")

    return F.arrays_zip(runs(a, b).alias("wrong"), runs(b, a).alias("replacement"))


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _longest_increasing(places: pd.Series) -> pd.Series:
    """Which numbers of each array make a longest increasing sequence, by piles as in patience."""

    def kept(row: list[int]) -> list[bool]:
        tops: list[int] = []
        pile = []
        for x in row:
            at = bisect_left(tops, x)
            tops[at : at + 1] = [x]
            pile.append(at)
        out, need, below = [False] * len(row), len(tops) - 1, float("inf")
        for k in range(len(row) - 1, -1, -1):
            if pile[k] == need and row[k] < below:
                out[k], need, below = True, need - 1, row[k]
        return out

    return places.map(kept)


def mine_pairs(corrections: DataFrame, raw: str = "raw_text", fixed: str = "corrected_text") -> DataFrame:
    """(wrong, replacement, n): word runs that differ, and how often in equal pairs of texts.

    Words that stand once in each of the two texts are anchors where they are in the same
    order: of all of them a longest increasing sequence, so a word that moves costs itself
    only.  Anchors cut both texts into segments.  Segments of one length are compared word by word, others
    are a rule as a whole.  A rule has a replacement of two characters at least and
    changes more than the case.
    """
    rows = corrections.select(tx.strip(F.col(raw)).alias("r"), tx.strip(F.col(fixed)).alias("f"))
    rows = rows.where((F.col("r") != "") & (F.col("f") != "") & (F.col("r") != F.col("f")))
    rows = rows.groupBy("r", "f").agg(F.count("*").alias("n")).withColumn("id", F.sha2(F.concat_ws("\u0000", "r", "f"), 256))
    rows = rows.select("id", "n", _words(F.col("r")).alias("a"), _words(F.col("f")).alias("b"))

    def once(side: str, place: str) -> DataFrame:
        words = rows.select("id", F.posexplode(side).alias(place, "w"))
        return words.groupBy("id", "w").agg(F.count("*").alias("c"), F.min(place).alias(place)).where("c = 1").drop("c")

    met = once("a", "i").join(once("b", "j"), ["id", "w"]).drop("w")
    met = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("met"))  # the words of one text
    kept = F.arrays_zip(F.col("met.i").alias("i"), F.col("met.j").alias("j"), _longest_increasing(F.col("met.j")).alias("k"))
    met = met.select("id", F.explode(F.filter(kept, lambda m: m["k"])).alias("m")).select("id", "m.i", "m.j")
    ends = rows.select("id", F.size("a").alias("i"), F.size("b").alias("j"))
    cuts = met.unionByName(ends)
    order = Window.partitionBy("id").orderBy("i")
    before = lambda c: F.coalesce(F.lag(c).over(order), F.lit(-1)) + 1
    cuts = cuts.withColumns({"i0": before("i"), "j0": before("j")}).where("i > i0 and j > j0")
    parts = cuts.join(rows, "id").select(
        "n", F.expr("slice(a, i0 + 1, i - i0)").alias("x"), F.expr("slice(b, j0 + 1, j - j0)").alias("y")
    )
    whole = F.array(F.struct(F.array_join("x", " ").alias("wrong"), F.array_join("y", " ").alias("replacement")))
    pairs = F.when(F.size("x") == F.size("y"), _differing_runs(F.col("x"), F.col("y"))).otherwise(whole)
    rules = parts.select("n", F.explode(pairs).alias("p")).select("n", "p.*")
    return rules.where((F.length("replacement") >= 2) & (F.lower("wrong") != F.lower("replacement"))).select("wrong", "replacement", "n")


def rule_counts(pairs: DataFrame, keep: int | None = None) -> DataFrame:
    """Occurrences per rule; ``keep`` limits the result to the most frequent ones."""
    counted = pairs.groupBy("wrong", "replacement").agg(F.sum("n").alias("count"))
    return counted if keep is None else counted.orderBy(F.desc("count"), "wrong", "replacement").limit(keep)


def learned_pattern(wrong: str) -> str:
    """Regex of a rule: a whole word, or words with any white space between."""
    words = [rf"\Q{w}\E" for w in wrong.split()]
    return rf"(?iuU)\b{words[0]}\b" if len(words) == 1 else r"(?iuU)" + r"\s+".join(words)


def apply_rules(texts: DataFrame, rules: list[tuple[str, str]], col: str = "text") -> DataFrame:
    """Apply learned rules, longest first, to each text, and fold its white space.

    Rules without words or without a replacement are left out; blank texts stay as they are.
    """
    out = F.col(col)
    for wrong, right in sorted(rules, key=lambda r: -len(r[0])):
        if wrong.split() and right:
            literal = right.replace("\\", r"\\").replace("$", r"\$")
            out = F.regexp_replace(out, learned_pattern(wrong), literal)
    blank = F.col(col).isNull() | (tx.strip(F.col(col)) == "")
    return texts.withColumn(col, F.when(blank, F.col(col)).otherwise(tx.squeeze(out)))


@F.pandas_udf(T.StringType())
def fold_unicode(batch: pd.Series) -> pd.Series:
    """Compatibility composition, for which Spark has no function."""
    return batch.str.normalize("NFKC")


# --- text read in the wrong code ------------------------------------------------------------


def _high_characters(code: str) -> tuple[str, str]:
    """The characters of a one-byte code above ASCII, and those with the same number in latin-1."""
    pairs = [(bytes([i]).decode(code, "replace"), chr(i)) for i in range(128, 256)]
    return tuple("".join(side) for side in zip(*[p for p in pairs if p[0] != "�"]))


def _read_again(text: Column, code: str) -> Column:
    """The bytes that ``code`` gives for a text, read as UTF-8; null where either is impossible."""
    own, same = _high_characters(code)
    fits = F.translate(F.regexp_replace(text, r"[\x00-\x7F]+", ""), own, "") == ""
    raw = F.encode(F.translate(F.when(fits, text), own, same), "ISO-8859-1").cast("string")
    return F.when(F.is_valid_utf8(raw), raw)


def repair_mojibake(text: Column) -> Column:
    """Undo UTF-8 text that was read as cp1251 or latin-1, when that looks more like text.

    A reading counts its Cyrillic letters, less two for each character that such damage
    leaves behind; a text with fewer than three of those is left alone.
    """
    marks = F.lit("[" + "".join(fx.MOJIBAKE_MARKS) + "]")
    rank = lambda t: F.regexp_count(t, F.lit("[А-яЁё]")) - 2 * F.regexp_count(t, marks)
    best = text
    for code in ("cp1251", "latin-1"):
        other = _read_again(text, code)
        best = F.when(rank(other) > rank(best), other).otherwise(best)
    return F.when(F.regexp_count(text, marks) >= 3, best).otherwise(text)


def latest_feedback(events: DataFrame, keep: int | None = None, answer_chars: int | None = None) -> DataFrame:
    """Feedback events that are not blank, newest first.

    ``keep`` and ``answer_chars`` are the limits of a store: rows, and characters of the
    previous answer.
    """
    body = tx.strip(F.coalesce("feedback", F.lit("")))
    answer = F.coalesce("previous_answer", F.lit(""))
    if answer_chars is not None:
        answer = F.substring(answer, 1, answer_chars)
    rows = events.where(body != "").withColumns({"feedback": body, "previous_answer": answer})
    rows = rows.orderBy(F.desc("at"), F.desc("event_id"))
    return rows if keep is None else rows.limit(keep)
