"""Language identification with string kernels.

The kernel of two texts is the number of byte n-grams of 1 to ``MAX_GRAM`` bytes that
both hold (blended spectrum, presence only), divided by the geometric mean of the
numbers that each holds.  Landmark texts give the Nyström map; kernel ridge regression
on it, one against the rest, gives a weight of every landmark for every language.

Scores are ``K(texts, landmarks) @ weights``.  The kernel matrix is itself a product of
presence matrices, so the right-hand factors are multiplied once, and a block of texts
is scored by one product of its presence matrix with a (n-gram, language) matrix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_GRAM = 4
SLOTS = 1 << 15  # hashed n-grams
FIT_PER_LANGUAGE = 400  # labelled rows read per language
LANDMARKS_PER_LANGUAGE = 64
RIDGE = 1e-3
BLOCK = 64  # texts of one matrix product
UNKNOWN = "und"

# lower-case A-Z; every other ASCII character that is no letter becomes a space
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def presence(text: str, out: np.ndarray) -> None:
    """Mark the n-grams of a text in a zeroed row of ``SLOTS`` bytes."""
    data = np.frombuffer((b" " + text.lower().encode("utf-8", "replace") + b" ").translate(_FOLD), np.uint8)
    h = data.astype(np.uint32)
    out[_slot(h)] = 1
    for n in range(1, MAX_GRAM):
        h = h[:-1] * np.uint32(0x01000193) + data[n:] + np.uint32(n)
        if not len(h):
            return
        out[_slot(h)] = 1


def _slot(h: np.ndarray) -> np.ndarray:
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(17)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # (SLOTS, languages)


def fit(packed: np.ndarray, languages: list[str], ridge: float = RIDGE) -> Model:
    """Kernel ridge regression on Nyström features from presence rows (bits) and their languages.

    Rows stay packed and matrices are taken a block at a time: this runs on the driver.
    """
    names = sorted(set(languages))
    if not names:
        return Model((), np.zeros((SLOTS, 0), np.float32))
    label = np.array([names.index(x) for x in languages])
    picked = np.concatenate([np.flatnonzero(label == c)[:LANDMARKS_PER_LANGUAGE] for c in range(len(names))])
    starts = range(0, len(packed), BLOCK)
    sums = [np.unpackbits(packed[i : i + BLOCK], axis=1).sum(axis=1, dtype=np.int64) for i in starts]
    norm = np.sqrt(np.maximum(np.concatenate(sums), 1))
    marks = np.empty((len(picked), SLOTS), np.float32)
    for row, i in zip(marks, picked):
        row[:] = np.unpackbits(packed[i]) / norm[i]
    kernel = np.concatenate([np.unpackbits(packed[i : i + BLOCK], axis=1).astype(np.float32) @ marks.T for i in starts])
    kernel = kernel.astype(np.float64) / norm[:, None]
    values, vectors = np.linalg.eigh(kernel[picked])
    good = values > 1e-6 * values.max()
    lift = vectors[:, good] / np.sqrt(values[good])
    phi = kernel @ lift
    goal = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    share = 1.0 / np.bincount(label)[label]  # languages weigh the same
    left = phi.T @ (phi * share[:, None]) + ridge * np.eye(phi.shape[1])
    alpha = lift @ np.linalg.solve(left, phi.T @ (goal * share[:, None]))
    weights = [(marks[:, i : i + SLOTS // 16].T.astype(np.float64) @ alpha).astype(np.float32) for i in range(0, SLOTS, SLOTS // 16)]
    return Model(tuple(names), np.concatenate(weights))


def _presence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, rows = [], []
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if has_letter(text):
                row = np.zeros(SLOTS, np.uint8)
                presence(text, row)
                langs.append(lang)
                rows.append(np.packbits(row).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.binary())], names=["lang", "bits"])


def train(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = FIT_PER_LANGUAGE
) -> Model:
    """Fit on at most ``per_language`` labelled rows of each language, picked by a hash of the id.

    Only these bounded rows, as presence bits of 4 kB, come to the driver.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    ids = rows.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"))
    ids = ids.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_language).select("_id").distinct()
    texts = rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    picked = texts.join(F.broadcast(ids), "_id").select("_text", "_lang")  # per_language ids of each language
    found = sorted((r["lang"], bytes(r["bits"])) for r in picked.mapInArrow(_presence_rows, "lang string, bits binary").collect())
    packed = np.frombuffer(b"".join(b for _, b in found), np.uint8).reshape(-1, SLOTS // 8)
    return fit(packed, [lang for lang, _ in found])


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per row: the columns ``keep``, lang_pred, score (0 to 1).

    A null text or one without a letter is ``und`` with score 0, as is every text if
    the model has no language.  Ties go to the first language in alphabetical order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        block = np.zeros((BLOCK, SLOTS), np.uint8)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            usable = [i for i, t in enumerate(texts) if m.languages and t is not None and has_letter(t)]
            for k in range(0, len(usable), BLOCK):
                part = usable[k : k + BLOCK]
                block[: len(part)] = 0
                for row, i in zip(block, part):
                    presence(texts[i], row)
                size = np.sqrt(block[: len(part)].sum(axis=1, dtype=np.int64))
                values = (block[: len(part)].astype(np.float32) @ m.weights) / size[:, None]
                best = values.argmax(axis=1)
                for i, b, v in zip(part, best, values):
                    lang[i] = m.languages[b]
                    score[i] = min(1.0, max(0.0, (float(v[b]) + 1) / 2))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(lang, pa.string()), pa.array(score)], names=[*batch.schema.names[1:], "lang_pred", "score"]
            )

    rows = docs.select(F.col(text_col).alias("_text"), *[c for c in keep if c not in ("lang_pred", "score")])
    schema = T.StructType(rows.schema.fields[1:]).add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score: learned from the labelled rows that are not held out."""
    known = docs.where(~F.coalesce(held_out(F.col(id_col)), F.lit(True)))
    model = train(known, id_col, text_col, lang_col)
    out = predict(docs, model, text_col, (id_col,))
    return out.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is found with a score of ``least`` or more."""
    known = docs.where(~F.coalesce(held_out(F.col(id_col)), F.lit(True)))
    out = predict(docs, train(known, id_col, text_col, lang_col), text_col, docs.columns)
    return out.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*docs.columns)
