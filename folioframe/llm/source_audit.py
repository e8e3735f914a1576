"""Divergence of the sources of each language, from count-level bitmaps.

Every (language, source) group gives each kept term a share of its tokens, a whole number
that depends on nothing but the term's count in the group.  So a group is stored as bit
sets: for every count the ids of the terms that occur that often.  For two groups, AND and
popcount of their bit sets give the number of terms in each joint cell (a, b) of counts;
cells with a zero follow by complement.  Cells times the difference of the two shares give
the distance of the groups; no term is visited per pair.

Terms are dealt in blocks of about ``BLOCK_TERMS``, among terms about as frequent, so that
a block has few counts.  A task holds one block for two tiles of at most about ``TILE``
sources, whatever the size of vocabulary, corpus or number of sources.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import stored

LEAST_DOCS = 30  # documents of a language that a kept term occurs in
SMOOTH = 5  # added to each count
THOUSANDS = 3  # shares are in units of 1000 ** -THOUSANDS
TOP_TERMS = 50
BLOCK_TERMS = 2048
TILE = 64  # sources of a tile
SALTS = 32  # parts that the blocks of a language are dealt in
FLUSH = 200_000  # counters that a task of the first pass holds
CELLS = 1 << 20  # joint cells that are held at once

#: Upper case to lower, what is in no term to a blank; bytes of characters beyond ASCII stay.
TERM_BYTES = bytes(
    b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) over a part of the documents, summed as far as memory allows."""
    totals: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in totals.items():
            held, terms = docs[lang, source], list(counts)
            columns = [
                pa.array([lang] * len(terms), pa.string()),
                pa.array([source] * len(terms), pa.string()),
                pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array(list(counts.values()), pa.int64()),
                pa.array([held[t] for t in terms], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        totals.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            terms = Counter(text.translate(TERM_BYTES).split())
            key = (lang, source)
            if key not in totals:
                totals[key], docs[key] = Counter(), Counter()
            size -= len(totals[key])
            totals[key].update(terms)
            docs[key].update(terms.keys())
            size += len(totals[key])
            if size >= FLUSH:
                yield from flush()
                size = 0
    yield from flush()


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)) of columns, exact: ``div`` cuts a quotient of whole decimals."""
    above = f"CAST({count} + {SMOOTH} AS DECIMAL(28,0)) * CAST({1000**THOUSANDS} AS DECIMAL(10,0))"
    return F.expr(f"1 + ({above}) div CAST({total} + {SMOOTH} * {terms} AS DECIMAL(20,0))")


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """The same for many counts of a group: long division by thousands, which does not overflow."""
    whole, rest, out = total + SMOOTH * terms, counts.astype(np.int64) + SMOOTH, np.zeros(len(counts), np.int64)
    for _ in range(THOUSANDS if terms else 0):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


class _Side:
    """The bit sets of one tile of groups in one block, as rows (group, share of the count, word, bits)."""

    def __init__(self, groups: pd.DataFrame, levels: pd.DataFrame):
        self.names = groups["source"].tolist()
        order = {s: k for k, s in enumerate(self.names)}
        totals, terms = groups["total"].to_numpy(), int(groups["terms"].iloc[0]) if len(groups) else 0
        self.none = np.array([shares(np.zeros(1, np.int64), int(n), terms)[0] for n in totals], np.int64)
        group = levels["source"].map(order).to_numpy(np.int64)
        word, share = levels["word"].to_numpy(np.int64), np.zeros(len(levels), np.int64)
        n = levels["n"].to_numpy(np.int64)
        for k, total in enumerate(totals):
            at = group == k
            share[at] = shares(n[at], int(total), terms)
        by = np.lexsort((group, word))
        self.group, self.word, self.share = group[by], word[by], share[by]
        self.bits = levels["bits"].to_numpy(np.int64)[by].view(np.uint64)
        self.held = np.bitwise_count(self.bits).astype(np.int64)

    def in_word(self, w: int) -> slice:
        return slice(*np.searchsorted(self.word, [w, w + 1]))


def distances(one: _Side, two: _Side, terms: int) -> np.ndarray:
    """Sums over the ``terms`` of a block of the difference of shares, for each group of ``one`` and of ``two``.

    A joint cell (a, b) holds the terms with count a here and b there: AND and popcount.
    What a group holds besides its cells is in the cell with a zero there, and the rest of
    the block in the cell (0, 0); so a cell adds its difference less those of the cells
    that its terms were counted in first.
    """
    base = np.abs(one.none[:, None] - two.none[None, :])
    out = terms * base
    for k in range(len(two.names)):
        apart = (np.abs(one.share - two.none[k]) - base[one.group, k]) * one.held
        np.add.at(out[:, k], one.group, apart)
    for k in range(len(one.names)):
        apart = (np.abs(two.share - one.none[k]) - base[k, two.group]) * two.held
        np.add.at(out[k], two.group, apart)
    for w in np.intersect1d(one.word, two.word):
        there = two.in_word(w)
        gt, pt, bt = two.group[there], two.share[there], two.bits[there]
        starts = np.flatnonzero(np.r_[True, gt[1:] != gt[:-1]])
        here = one.in_word(w)
        step = max(1, CELLS // len(gt))
        for at in range(here.start, here.stop, step):
            part = slice(at, min(at + step, here.stop))
            gh, ph = one.group[part], one.share[part]
            both = np.bitwise_count(one.bits[part][:, None] & bt[None, :]).astype(np.int64)
            more = np.abs(ph[:, None] - pt) - np.abs(ph[:, None] - two.none[gt]) - np.abs(one.none[gh][:, None] - pt) + base[np.ix_(gh, gt)]
            np.add.at(out, (gh[:, None], gt[starts][None, :]), np.add.reduceat(both * more, starts, axis=1))
    return out


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    """(lang, a, b, value): what one block adds to the distance of each pair of groups of two tiles."""
    is_group = pdf["word"].to_numpy() < 0
    groups, levels = pdf[is_group], pdf[~is_group]
    i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    side = lambda t: _Side(groups[groups["tile"] == t], levels[levels["tile"] == t])
    one = side(i)
    two = one if i == j else side(j)
    size = int(groups["n"].iloc[0]) if len(groups) else 0
    value = distances(one, two, size)
    x, y = np.triu_indices(len(one.names), 1) if i == j else (v.ravel() for v in np.indices(value.shape))
    names = np.array(one.names, object), np.array(two.names, object)
    return pd.DataFrame({"lang": pdf["lang"].iloc[0], "a": names[0][x], "b": names[1][y], "value": value[x, y]})


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank for each (language, source) group.

    Part ``pair`` lists every other source of the language, farthest first; part ``term``
    the ``TOP_TERMS`` terms that the group holds more of than its language does.  Ties go to the
    smaller item.  Nulls count as empty strings.  A language without kept terms has pairs
    at distance 0; one with a single source has no pair.  Repeated rows are documents of
    their own, other columns are ignored, and an empty table gives no row.
    """
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(own(lang_col).alias("lang"), own(source_col).alias("source"), own(text_col).cast("binary").alias("text"))
    found = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = stored(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")

    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs"))
    kept = kept.where(F.col("docs") >= LEAST_DOCS).withColumn("band", F.floor(F.log2("all")).cast("int"))
    kept = stored(kept, "kept")  # so that the few bands come by a broadcast and a hot one is not dealt to one task
    parts = stored(kept.groupBy("lang", "band").agg(F.ceil(F.count("*") / BLOCK_TERMS).alias("parts")), "bands")
    kept = kept.join(parts, ["lang", "band"]).withColumn("part", F.pmod(F.xxhash64("term"), "parts").cast("int"))
    place = Window.partitionBy("lang", "band", "part").orderBy("term")
    kept = kept.withColumn("id", F.row_number().over(place) - 1)
    kept = stored(kept.select("lang", "term", "all", "band", "part", "id"), "terms")
    held = stored(counts.drop("docs").join(kept, ["lang", "term"]), "held")

    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
    langs = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("lang_total")), "lang", "left")
    langs = langs.fillna(0, ["terms", "lang_total"])
    tile = F.pmod(F.xxhash64("source"), "tiles").cast("int").alias("tile")
    groups = groups.join(langs, "lang").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "terms", "lang_total", "tiles", tile)
    groups = stored(groups, "groups")
    pairs = _pairs(held, kept, groups)
    return _ranked(pairs).unionByName(_terms(held, groups))


def _pairs(held: DataFrame, kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for both orders of each pair of groups of a language."""
    salt = F.pmod(F.xxhash64("band", "part"), F.lit(SALTS))
    blocks = kept.groupBy("lang", "band", "part").agg(F.count("*").alias("n")).withColumn("salt", salt)
    # a language that keeps no term has one empty block, so that its pairs are there
    empty = groups.where("terms = 0").select("lang", F.lit(0).alias("band"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("n")).distinct()
    blocks = blocks.unionByName(empty.withColumn("salt", salt))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    present = groups.select("*", each).join(blocks, ["lang", "salt"]).select(
        "lang", "band", "part", "source", "tile", "tiles", "total", "terms", "n", F.lit(-1).alias("word"), F.lit(0).cast("long").alias("bits")
    )
    # the bit sets, by words of 64 terms: a row holds the terms of one word that a group counts alike
    bits = F.bit_or(F.expr("shiftleft(1L, int(id % 64))")).alias("bits")
    levels = held.groupBy("lang", "source", "band", "part", "n", F.floor(F.col("id") / 64).cast("int").alias("word")).agg(bits)
    levels = levels.join(groups.select("lang", "source", "tile", "tiles"), ["lang", "source"])
    zero = F.lit(0).cast("long")
    levels = levels.withColumns({"total": zero, "terms": zero})
    dealt = present.unionByName(levels).withColumn("other", F.explode(F.expr("sequence(0, int(tiles - 1))")))
    dealt = dealt.withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")}).drop("tiles", "other")
    partial = dealt.groupBy("lang", "band", "part", "i", "j").applyInPandas(_block, "lang string, a string, b string, value long")
    total = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    turn = lambda x, y: F.struct(F.col(x).alias("source"), F.col(y).alias("item"))
    return total.select("lang", "value", F.explode(F.array(turn("a", "b"), turn("b", "a"))).alias("e")).select("lang", "e.*", "value")


def _ranked(pairs: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(held: DataFrame, groups: DataFrame) -> DataFrame:
    """The terms that groups hold more of than their languages do; the cut reaches below the shuffle."""
    rows = held.join(groups, ["lang", "source"])
    over = _share("n", "total", "terms") - _share("`all`", "lang_total", "terms")
    rows = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), over.alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS)
