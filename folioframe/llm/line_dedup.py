"""Near-equal lines by a deletion-neighbourhood join.

Two lines within one edit give the same string once the edited character is left out
of the longer one, or of both at the same place.  So every line emits its variants
with one character deleted, as hashed keys, and equal keys are joined.

Emitting the variants of every line of a corpus would give a row per character.  A
line therefore first shows its two halves: an edit leaves one half as it is, so a line
whose halves nobody shares has no partner.  Only the others emit variants, and only
for the half that may hold the edit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import ascii_lower, stored

MIN_CHARS = 20  # shorter lines (brackets, list marks, page numbers) take no part
BLOCK = 256  # what stands before and after a block is hashed once for all its variants


def _trimmed(line: Column | str) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def normalised(line: Column) -> Column:
    return ascii_lower(_trimmed(line))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(_id, _n, _line, _h1, _h2): lines that take part, with a 128-bit identity."""
    body = F.split(F.coalesce("_text", F.lit("")), "\n")
    rows = docs.select("_id", F.posexplode(body).alias("_n", "_raw"))
    # lower-casing keeps the length; tested on the raw line, so that it is not worked out twice
    rows = rows.where(F.length(_trimmed("_raw")) >= min_chars).select("_id", "_n", normalised(F.col("_raw")).alias("_line"))
    return rows.withColumns({"_h1": F.xxhash64("_line"), "_h2": F.xxhash64(F.lit(1), "_line")})


def _half_keys(line: Column) -> Column:
    """Keys of the halves, as a line of its own length (0, 1) and as the shorter of two (2, 3).

    ``m`` is the length of the longer line; its first half has ``m // 2`` characters.
    """
    out = []
    for slot, m in ((0, F.length(line)), (2, F.length(line) + 1)):
        h = F.floor(m / 2).cast("int")
        out.append(F.xxhash64(F.lit(0), m, F.substring(line, F.lit(1), h)))
        out.append(F.xxhash64(F.lit(1), m, F.substring(line, F.length(line) - (m - h) + 1, m - h)))
    return F.array(*out)


def _with_partner_half(distinct: DataFrame) -> DataFrame:
    """(_at, _slots): distinct lines that share a half with another one."""
    halves = distinct.select("_at", F.posexplode("_keys").alias("_slot", "_key"))
    shared = halves.groupBy("_key").agg(F.count("*").alias("_c")).where("_c > 1").select("_key")
    found = halves.join(shared, "_key", "left_semi")
    return found.groupBy("_at").agg(F.collect_set("_slot").alias("_slots"))


def _texts_of(found: DataFrame, docs: DataFrame, min_chars: int) -> DataFrame:
    """(_at, _slots, _line): the lines at their first place, read once per document."""
    per_doc = found.groupBy(F.col("_at._id").alias("_d")).agg(F.collect_list(F.struct("_at", "_slots")).alias("_want"))
    rows = docs.join(per_doc, F.col("_id").eqNullSafe(F.col("_d")))
    rows = rows.select("_text", F.explode("_want").alias("_w"))
    line = F.split(F.coalesce("_text", F.lit("")), "\n")[F.col("_w._at._n")]
    rows = rows.select("_w._at", "_w._slots", normalised(line).alias("_line"))
    return rows.where(F.length("_line") >= min_chars).dropDuplicates(["_at"])


def _blocks(rows: DataFrame, m: Column) -> DataFrame:
    """One row per block of the longer line: _m, _s (start), _w (width)."""
    rows = rows.withColumn("_m", m).withColumn("_s", F.explode(F.sequence(F.lit(1), F.col("_m"), F.lit(BLOCK))))
    return rows.withColumn("_w", F.least(F.lit(BLOCK), F.col("_m") - F.col("_s") + 1))


def _variants(lines: DataFrame) -> DataFrame:
    """(_at, _v, _i): hashed strings with character ``_i`` left out, where the edit may be."""
    half = F.floor(F.col("_m") / 2)
    first, second = F.array_contains("_slots", 1), F.array_contains("_slots", 0)
    rows = _blocks(lines.where(first | second), F.length("_line"))
    rows = rows.where((first & (F.col("_s") <= half)) | (second & (F.col("_s") + F.col("_w") - 1 > half)))
    rows = rows.select(
        "_at", "_slots", "_m", "_s", "_w",
        F.xxhash64(F.substring("_line", F.lit(1), F.col("_s") - 1)).alias("_before"),
        F.xxhash64(F.substring("_line", F.col("_s") + F.col("_w"), F.col("_m"))).alias("_after"),
        F.substring("_line", F.col("_s"), F.col("_w")).alias("_block"),
    )
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_w"))))
    rows = rows.withColumn("_i", F.col("_s") + F.col("_k") - 1)
    rows = rows.where((first & (F.col("_i") <= half)) | (second & (F.col("_i") > half)))
    cut = F.concat(F.substring("_block", F.lit(1), F.col("_k") - 1), F.substring("_block", F.col("_k") + 1, F.col("_w")))
    return rows.select("_at", F.xxhash64("_m", "_s", "_before", "_after", cut).alias("_v"), "_i")


def _whole(lines: DataFrame) -> DataFrame:
    """(_at, _v): lines as what is left of a line that is longer by one character."""
    rows = _blocks(lines.where(F.arrays_overlap("_slots", F.array(F.lit(2), F.lit(3)))), F.length("_line") + 1)
    key = F.xxhash64(
        "_m", "_s",
        F.xxhash64(F.substring("_line", F.lit(1), F.col("_s") - 1)),
        F.xxhash64(F.substring("_line", F.col("_s") + F.col("_w") - 1, F.col("_m"))),
        F.substring("_line", F.col("_s"), F.col("_w") - 1),
    )
    return rows.select("_at", key.alias("_v"))


def _earlier_partners(lines: DataFrame) -> DataFrame:
    """(_at): lines with a verified partner within one edit that comes earlier."""
    variants = _variants(lines)
    # lines that share a variant at one place differ in one character, so the group is
    # bounded by the alphabet and its earliest line stands for all
    place = Window.partitionBy("_v", "_i")
    replaced = variants.withColumn("_e", F.min("_at").over(place)).where("_at != _e").select("_at", "_e")
    whole = _whole(lines).select(F.col("_at").alias("_o"), "_v")
    inserted = variants.join(whole, "_v").select(F.greatest("_at", "_o").alias("_at"), F.least("_at", "_o").alias("_e"))
    pairs = replaced.unionByName(inserted).distinct()
    mine = lines.select("_at", F.col("_line").alias("_a"))
    other = lines.select(F.col("_at").alias("_e"), F.col("_line").alias("_b"))
    near = pairs.join(mine, "_at").join(other, "_e").where(F.levenshtein("_a", "_b", 1).between(0, 1))
    return near.select("_at").distinct()


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text, then the other columns under names that cannot clash)."""
    others = [F.col(c).alias(f"_x{i}") for i, c in enumerate(docs.columns) if c not in (id_col, text_col)]
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *others)


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1, min_chars: int = MIN_CHARS
) -> DataFrame:
    """(id, removed): the numbers, from 0, of the lines that go, for documents that lose any.

    Lines are compared trimmed and in lower-case A-Z.  A line goes if an equal line
    comes earlier, in order of (id, line number), or if some line within one edit has
    its first place before the first place of this one, itself kept or not.  Lines
    under ``min_chars`` characters always stay.  ``max_edits`` is 0 or 1.

    A null text has no line to lose.  A null id comes before all others.  Repeated rows
    (one id, one text) are one document and lose the same lines.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    return _repeated(_prepared(docs, id_col, text_col), max_edits, min_chars).withColumnRenamed("_id", id_col)


def _repeated(base: DataFrame, max_edits: int, min_chars: int) -> DataFrame:
    lines = _lines(base, min_chars)
    distinct = lines.groupBy("_h1", "_h2").agg(
        F.min(F.struct("_id", "_n")).alias("_at"),
        (F.count("*") > 1).alias("_again"),
        F.any_value(_half_keys(F.col("_line"))).alias("_keys"),
    )
    distinct = stored(distinct, "lines")
    if max_edits:
        near = _earlier_partners(_texts_of(_with_partner_half(distinct), base, min_chars))
        near = near.withColumn("_near", F.lit(True))
        verdict = distinct.drop("_keys").join(near, "_at", "left").where("_again or _near")
    else:
        verdict = distinct.where("_again").select("_h1", "_h2", "_at", F.lit(None).cast("boolean").alias("_near"))
    places = lines.select("_id", "_n", "_h1", "_h2").join(verdict, ["_h1", "_h2"])
    gone = places.where(F.coalesce("_near", F.lit(False)) | (F.struct("_id", "_n") != F.col("_at")))
    return gone.groupBy("_id").agg(F.collect_set("_n").alias("removed"))


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1, min_chars: int = MIN_CHARS
) -> DataFrame:
    """``docs`` with the repeated lines taken out of the text; see :func:`repeated_lines`.

    All rows and columns stay (``lines_total`` and ``lines_removed`` are replaced or
    added).  A text that loses all its lines is empty, a null text stays null.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    docs = docs.drop("lines_total", "lines_removed")
    base = _prepared(docs, id_col, text_col)
    gone = _repeated(base, max_edits, min_chars).select(F.col("_id").alias("_d"), "removed")
    # the same exchange of (_id, _text) serves the texts of candidate lines and this join
    out = base.join(gone, F.col("_id").eqNullSafe(F.col("_d")), "left")
    kept = F.filter(F.split("_text", "\n"), lambda x, i: ~F.array_contains(F.col("removed"), i))
    names = {c: f"_x{i}" for i, c in enumerate(docs.columns)} | {id_col: "_id"}
    changed = F.when(F.col("removed").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n"))
    return out.select(
        *[(changed if c == text_col else F.col(names[c])).alias(c) for c in docs.columns],
        F.size(F.split(F.coalesce("_text", F.lit("")), "\n")).alias("lines_total"),
        F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).alias("lines_removed"),
    )
