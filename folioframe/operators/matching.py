"""Which chunks satisfy which forms, in the task that reads the chunks.

A form is what a request asks (``retrieval._forms``).  A token lies within one word, so the words of
a slice of chunks are looked up once, each word once a worker; what a chunk holds are then bits, and the
bits of the tokens of a form are combined for a whole slice at once.  Only a chunk that holds all
tokens of a form is compared with its phrase.  Forms are as many as the requests; they pass through the driver.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe import fixed_values as fx
from folioframe.functions import text as tx
from folioframe.operators.held import KNOWN
from folioframe.operators.postings import _Best, _bytes, _rounded

SPELLED = "а-яёА-ЯЁa-zA-Z0-9"  # characters of a token as written
SLICE = 1000  # chunks looked at at once
BLOCK = 2048  # forms looked at at once
LEAD = 2  # rows gathered before lists are cut, for each result wanted
DIMS = 64  # of a hash embedding


def special(forms: DataFrame) -> Column:
    """Forms whose tokens have other forms, marks or none at all; these are compared by columns."""
    odd = F.exists("tokens", lambda t: t.isin(list(fx.SCAN_ALIASES) + tx.alias_forms()))
    lists = [F.size(c) == 0 for c in ("tokens", "required", "_must", "_parts.spelled", "_parts.toks", "_parts.lems")]
    return tx.any_of([odd, F.col("_parts.number") != "", *lists])


@dataclass
class _Lists:
    """Numbers of words, a list a form, one after the other."""

    flat: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, lists: list[list[str]], number: dict[str, int]) -> _Lists:
        size = np.array([len(x) for x in lists], dtype=np.int64)
        return cls(np.array([number[t] for x in lists for t in x], dtype=np.int64), np.cumsum(size) - size, size)

    def block(self, at: slice) -> _Lists:
        start, size = self.start[at], self.size[at]
        low, high = (start[0], start[-1] + size[-1]) if len(start) else (0, 0)
        return _Lists(self.flat[low:high], start - low, size)


@dataclass
class Forms:
    """The forms that are compared here, with what their words are."""

    form: np.ndarray
    q: list[str]
    ql: list[str]
    simple: np.ndarray  # whether the request is one token as written
    spelled: list[list[str]]
    yo: bool  # whether any request holds a ё
    tokens: tuple[str, ...]
    lemmas: list[str]
    lists: dict[str, _Lists] = field(default_factory=dict)
    vectors: np.ndarray | None = None
    norms: np.ndarray | None = None

    @classmethod
    def read(cls, forms: DataFrame, vectors: bool = False) -> Forms:
        rows = forms.where(~special(forms)).select(
            "form", "required", F.col("_must").alias("must"), "_parts.q", "_parts.ql", "_parts.spelled", "_parts.toks", "_parts.lems"
        ).collect()
        words = lambda *cols: sorted({t for r in rows for c in cols for t in r[c]})
        number = lambda list_: {t: i for i, t in enumerate(list_)}
        tokens, lemmas = words("toks", "required"), words("lems", "must")
        token, base = number(tokens), number(lemmas)
        out = cls(
            np.array([r["form"] for r in rows], dtype=np.int64), [r["q"] for r in rows], [r["ql"] for r in rows],
            np.array([bool(re.fullmatch(f"[{SPELLED}]+", r["q"])) for r in rows], dtype=bool), [r["spelled"] for r in rows],
            any("ё" in r["ql"] for r in rows), tuple(tokens), lemmas,
        )
        of = lambda c, n: _Lists.of([r[c] for r in rows], n)
        out.lists = {
            "required": of("required", token), "toks": of("toks", token),
            "lems": of("lems", base), "must": of("must", base),
            "kinds": _Lists.of([list(dict.fromkeys(r["toks"])) for r in rows], token),
        }
        if vectors:
            out.vectors = np.zeros((len(rows), DIMS))
            for i, r in enumerate(rows):
                np.add.at(out.vectors[i], [_bucket(t) for t in r["toks"] if len(t) > 2], 1)
            out.norms = np.sqrt((out.vectors**2).sum(axis=1))
        return out

    def __len__(self) -> int:
        return len(self.form)

    def block(self, at: slice) -> Forms:
        part = lambda x: None if x is None else x[at]
        lists = {k: x.block(at) for k, x in self.lists.items()}
        return Forms(
            self.form[at], self.q[at], self.ql[at], self.simple[at], self.spelled[at], self.yo, self.tokens, self.lemmas, lists,
            part(self.vectors), part(self.norms),
        )


def _bucket(token: str) -> int:
    """As ``vectors.hash_bucket``."""
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % DIMS


class _Held:
    """Numbers of the tokens that a word contains, looked up once a word."""

    def __init__(self, tokens: tuple[str, ...]):
        self.number = {t: i for i, t in enumerate(tokens)}
        heads: dict[str, set[int]] = {}
        for t in tokens:
            heads.setdefault(t[:2], set()).add(len(t))
        self.heads = {h: tuple(sorted(x)) for h, x in heads.items()}  # the lengths of tokens that begin so
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, word: str) -> tuple[int, ...]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            number, heads = self.number, self.heads
            found = [number.get(word[i : i + k]) for i in range(len(word) - 1) for k in heads.get(word[i : i + 2], ())]
            got = self.known[word] = tuple({x for x in found if x is not None})
        return got


class _Equal:
    """Number of the lemma that a word is, ё folded."""

    def __init__(self, lemmas: list[str]):
        self.number = {t: (i,) for i, t in enumerate(lemmas)}

    def __call__(self, word: str) -> tuple[int, ...]:
        return self.number.get(word.replace("ё", "е"), ())


class _Within:
    """Numbers of the tokens that contain a word."""

    def __init__(self, tokens: list[str]):
        held: dict[str, set[int]] = {}
        for i, t in enumerate(tokens):
            for a in range(len(t)):
                for z in range(a + 2, len(t) + 1):
                    held.setdefault(t[a:z], set()).add(i)
        self.number = {w: tuple(x) for w, x in held.items()}

    def __call__(self, word: str) -> tuple[int, ...]:
        return self.number.get(word, ())


class _Buckets:
    """The bucket of a word of three letters or more."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, word: str) -> tuple[int, ...]:
        if len(word) < 3:
            return ()
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            got = self.known[word] = (_bucket(word),)
        return got


class _Words:
    """The distinct words of a slice and where they stand."""

    def __init__(self, lists: pa.Array):
        each = pc.dictionary_encode(lists.flatten())
        size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        self.rows = len(lists)
        self.words = each.dictionary.to_pylist()
        self.row = np.repeat(np.arange(self.rows), size)
        self.word = each.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def places(self, of) -> tuple[np.ndarray, np.ndarray]:
        """(row, number) of all that ``of`` gives for the words."""
        found = [of(w) for w in self.words]
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        start, flat = np.cumsum(size) - size, np.fromiter(chain.from_iterable(found), dtype=np.int64, count=size.sum())
        times = size[self.word]
        return np.repeat(self.row, times), flat[_spans(start[self.word], times)]

    def matrix(self, of, n: int) -> np.ndarray:
        out = np.zeros((self.rows, n), dtype=bool)
        out[self.places(of)] = True
        return out


def _spans(start: np.ndarray, times: np.ndarray) -> np.ndarray:
    return np.arange(times.sum()) + np.repeat(start - (np.cumsum(times) - times), times)


def _bits(matrix: np.ndarray) -> np.ndarray:
    """(columns, rows / 8): the rows that hold a word, as bits."""
    return np.ascontiguousarray(np.packbits(matrix, axis=0).T)


def _all(bits: np.ndarray, lists: _Lists) -> np.ndarray:
    return np.bitwise_and.reduceat(bits[lists.flat], lists.start, axis=0)


def _count(matrix: np.ndarray, row: np.ndarray, form: np.ndarray, lists: _Lists) -> np.ndarray:
    """How many words of its list each (row, form) holds."""
    times = lists.size[form]
    if not len(times):
        return times
    held = matrix[np.repeat(row, times), lists.flat[_spans(lists.start[form], times)]]
    return np.add.reduceat(held.astype(np.int64), np.cumsum(times) - times)


@lru_cache(maxsize=1)
def _held(tokens: tuple[str, ...]) -> _Held:
    """The words that this worker has met, in its earlier tasks too."""
    return _Held(tokens)


def _bits_of(forms: Forms, words: _Words, held: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The bits of tokens and lemmas.  Lemmas are null where no ё is folded: words in common are then found as written."""
    folds = forms.yo or any("ё" in w for w in words.words)
    return _bits(held), _bits(words.matrix(_Equal(forms.lemmas), len(forms.lemmas))) if folds else None


def _passes(f: Forms, low: np.ndarray, lemma: np.ndarray | None) -> np.ndarray:
    out = _all(low, f.lists["required"])
    return out if lemma is None else out | _all(lemma, f.lists["must"])


class Test:
    """The token test of all forms on slices of chunks: all required tokens, or else all their lemmas."""

    def __init__(self, forms: Forms):
        self.forms = forms

    def __call__(self, raw: pa.Array) -> np.ndarray:
        """(forms, chunks)."""
        words, f = _Words(raw), self.forms
        if not len(f):
            return np.zeros((0, len(raw)), dtype=bool)
        bits = _bits_of(f, words, words.matrix(_held(f.tokens), len(f.tokens)))
        return np.unpackbits(_passes(f, *bits), axis=1, count=len(raw)).astype(bool)


class _Slice:
    """A slice of chunks: what their words hold, for all forms."""

    def __init__(self, forms: Forms, raw: pa.Array, content: pa.Array, low: pa.Array):
        self.n = len(raw)
        self.words = _Words(raw)
        self.held = self.words.matrix(_held(forms.tokens), len(forms.tokens))
        self.low_bits, self.lemma_bits = _bits_of(forms, self.words, self.held)
        self.content, self.low = content.fill_null("").to_pylist(), low.to_pylist()

    def matches(self, f: Forms, whole: bool) -> tuple[np.ndarray, ...]:
        """(row, form, score, full) of pairs; ``whole``: only those that hold every token as written or in other case."""
        open_ = lambda bits: np.unpackbits(bits, axis=1, count=self.n).T.astype(bool)
        full = open_(_all(self.low_bits, f.lists["toks"]))
        passes = full if whole else open_(_passes(f, self.low_bits, self.lemma_bits))
        row, form = np.nonzero(passes)
        is_full, n = full[row, form], f.lists["toks"].size[form]
        score = np.zeros(len(row))
        # a text that holds the phrase holds its tokens
        q, content, simple = f.q, self.content, f.simple[form]
        at = np.flatnonzero(is_full)
        phrase = np.fromiter((q[j] in content[i] for i, j in zip(row[at].tolist(), form[at].tolist())), dtype=bool, count=len(at))
        score[at] = np.where(phrase, 1.0, np.where(simple[at], 0.93, 0.0))
        at = at[score[at] == 0]
        ql, low = f.ql, self.low
        score[at] = [0.93 if ql[j] in low[i] else 0.0 for i, j in zip(row[at].tolist(), form[at].tolist())]
        at = at[score[at] == 0]
        spelled = f.spelled
        e = np.array([sum([t in content[i] for t in spelled[j]]) for i, j in zip(row[at].tolist(), form[at].tolist())], dtype=np.int64)
        score[at] = np.where(e == n[at], 0.88, 0.80 + 0.06 * (e / n[at]))
        at = np.flatnonzero(~is_full)
        if len(at):
            lemmas = self.lemma_bits is not None and open_(_all(self.lemma_bits, f.lists["lems"]))[row[at], form[at]]
            hits = _count(self.held, row[at], form[at], f.lists["toks"])
            some = np.minimum(0.52, 0.28 + 0.24 * (hits / n[at]))
            score[at] = np.where(n[at] >= 2, np.where(lemmas, 0.80, some), np.where(lemmas, 0.72, 0.0))
        keep = score > 0
        return row[keep], form[keep], _rounded(score[keep]), is_full[keep]


def _blocks(forms: Forms) -> list[Forms]:
    return [forms.block(slice(i, i + BLOCK)) for i in range(0, len(forms), BLOCK)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def all_matches(forms: Forms, texts: DataFrame, answers: bool = False) -> DataFrame:
    """(form, score, ..): every chunk and form with a score above zero, with the columns of ``texts``.

    ``texts``: content, _raw (its tokens) and what is carried on.  A chunk leaves its task once, with
    the list of its forms.  ``answers`` adds ``answer``: the share of the distinct tokens of the
    request that the chunk contains or shares a word with (``text.keyword_score``).
    """
    carried = [c for c in texts.columns if c != "_raw"]
    entry = "struct<form:bigint,score:double" + (",answer:double>" if answers else ">")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within, blocks = _Within(forms.tokens) if answers else None, _blocks(forms)
        for batch in _slices(batches) if blocks else ():
            part = _Slice(forms, *(_column(batch, c) for c in ("_raw", "content", "_low")))
            known = part.held | part.words.matrix(within, len(forms.tokens)) if answers else None
            found = []
            for f in blocks:
                row, form, score, full = part.matches(f, False)
                more = []
                if answers:
                    share, at = np.ones(len(row)), np.flatnonzero(~full)
                    share[at] = _rounded(_count(known, row[at], form[at], f.lists["kinds"]) / f.lists["kinds"].size[form[at]])
                    more = [share]
                found.append((row, f.form[form], score, *more))
            row, *values = (np.concatenate(x) for x in zip(*found))
            if len(blocks) > 1:
                order = np.argsort(row, kind="stable")
                row, values = row[order], [x[order] for x in values]
            ends = np.searchsorted(row, np.arange(part.n + 1)).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(x) for x in values], names=["form", "score", "answer"][: len(values)])
            lists = pa.ListArray.from_arrays(pa.array(ends), items)
            yield pa.RecordBatch.from_arrays([*(_column(batch, c) for c in carried), lists], names=[*carried, "_found"])

    kept = [texts.schema[c] for c in carried]
    read = texts.withColumn("_low", F.lower(F.coalesce("content", F.lit(""))))
    schema = T.StructType([*kept, T.StructField("_found", T.ArrayType(T._parse_datatype_string(entry)))])
    found = read.mapInArrow(match, schema).where(F.size("_found") > 0)
    return found.select(*carried, F.inline("_found"))


def top_matches(forms: Forms, texts: DataFrame, n_classes: int, k: int, whole: bool = False, weight: float | None = None) -> DataFrame:
    """(form, class, chunk_id, score): the ``k`` best chunks of each form and class that a task has read.

    ``texts``: chunk_id, class (from 1), content, _raw.  With ``weight`` pairs are scored by words
    and vectors together (``scoring.hybrid_score``), and keyword and cosine are returned too.
    """
    extra = ", keyword double, cosine double" if weight is not None else ""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, buckets = _blocks(forms), _Buckets()
        lists = [_Best(len(f) * n_classes, k, LEAD) for f in blocks]
        for batch in _slices(batches) if blocks else ():
            part = _Slice(forms, *(_column(batch, c) for c in ("_raw", "content", "_low")))
            ids = _bytes(_column(batch, "chunk_id"))
            kind = _column(batch, "class").to_numpy(zero_copy_only=False).astype(np.int64) - 1
            if weight is not None:
                row, bucket = part.words.places(buckets)
                vectors = np.bincount(row * DIMS + bucket, minlength=part.n * DIMS).reshape(part.n, DIMS).astype(float)
                norms = np.sqrt((vectors**2).sum(axis=1))
            for f, list_ in zip(blocks, lists):
                row, form, score, _ = part.matches(f, whole)
                group, more = form * n_classes + kind[row], np.zeros((len(row), 0))
                if weight is not None:
                    length = norms[row] * f.norms[form]
                    dot = (vectors @ f.vectors.T)[row, form]
                    cosine = _rounded(np.divide(dot, length, out=np.zeros(len(row)), where=length > 0))
                    more = np.stack([score, cosine], 1)
                    score = np.where(score >= 0.99, score, _rounded(weight * score + (1.0 - weight) * cosine))
                keep = score >= list_.floor[group]
                list_.add(group[keep], score[keep], ids[row[keep]], more[keep])
        for f, list_ in zip(blocks, lists):
            done = list_.cut()
            if done:
                group, score, i, more = done
                form, kind = np.divmod(group, n_classes)
                data = [pa.array(f.form[form]), pa.array((kind + 1).astype(np.int32)), pa.array(i.tolist(), pa.binary()).cast(pa.string()), pa.array(score)]
                names = ["form", "class", "chunk_id", "score"]
                if weight is not None:
                    data += [pa.array(np.ascontiguousarray(more[:, 0])), pa.array(np.ascontiguousarray(more[:, 1]))]
                    names += ["keyword", "cosine"]
                yield pa.RecordBatch.from_arrays(data, names=names)

    read = texts.select("chunk_id", "class", "content", "_raw", F.lower(F.coalesce("content", F.lit(""))).alias("_low"))
    return read.mapInArrow(best, "form bigint, class int, chunk_id string, score double" + extra)
