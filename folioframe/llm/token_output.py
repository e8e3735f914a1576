"""Token ids as Arrow files of equal-length sequences.

Documents are encoded in the order of their ids, an end id after each, and the stream
of ids is cut into sequences of ``SEQUENCE`` ids.  A file is in the Arrow IPC file
format; its batches have two columns of fixed-size lists, ``ids`` and ``mask`` (false
where the last sequence of a file is padded).  Lists of one size have no offsets, so a
sequence or any range of ids is a slice of a mapped buffer and nothing is copied.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import new_path, stored

SEQUENCE = 2048
BATCH_SEQUENCES = 64
END_ID = 0
CACHE_WORDS = 400_000



class Encoder:
    """Byte-level BPE of the tokenizers library, with the words it has met kept as bytes.

    A space before a character that is no white space always starts a new piece for
    the pre-tokenizer, and so does a line break there, so a text is the concatenation of
    its words split before both.  Line breaks before other white space stay within their
    words.  A text with other white space around a space, or with the string of a special
    token, goes through the library as a whole.
    """

    _whole = re.compile(r" (?=\s|\Z)")
    _blank = re.compile(r"\n(?=\s|\Z)")

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        names = self.tokenizer.get_vocab()
        self.width = np.zeros(max(names.values()) + 1, np.int64)  # bytes of a token: a character of its name each
        for name, i in names.items():
            self.width[i] = len(name)

    def _ids(self, text: str) -> np.ndarray:
        # without the offsets of the tokens, which nothing here reads
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def encode(self, text: str) -> bytes:
        if self._whole.search(text) or any(s in text for s in self.special):
            return self._ids(text).tobytes()
        if "\n" in text and not self._blank.search(text):
            text = text.replace("\n", " \n")  # no other word begins with a line break
        first, *rest = text.split(" ")
        new = list(set(rest).difference(self.words))
        parts = [first, *(w if w[0] == "\n" else " " + w for w in new)]
        ids = self._ids("".join(parts))  # the new words at once, told apart by their bytes
        stops = np.cumsum([len(p.encode()) for p in parts])
        cut = (np.searchsorted(np.cumsum(self.width[ids]), stops, "right") * ids.itemsize).tolist()
        raw = ids.tobytes()
        found = {w: raw[a:b] for w, a, b in zip(new, cut, cut[1:])}
        if len(self.words) < CACHE_WORDS:
            self.words.update(found)
            return raw[: cut[0]] + b"".join(map(self.words.__getitem__, rest))
        known = self.words.get
        return raw[: cut[0]] + b"".join([known(w) or found[w] for w in rest])


@lru_cache(maxsize=1)
def encoder_of(vocabulary: str) -> Encoder:
    """The encoder of this worker, with the words that its earlier tasks have met."""
    return Encoder(vocabulary)


# --- files --------------------------------------------------------------------------------------


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


class SequenceWriter:
    def __init__(self, fs: pafs.FileSystem, path: str, kind, sequence: int = SEQUENCE, batch: int = BATCH_SEQUENCES):
        self.sequence, self.kind, self.take = sequence, kind, sequence * batch
        item = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(item, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.sink = fs.open_output_stream(path)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held, self.size = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.take:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.take * self.take
            for i in range(0, whole, self.take):
                self._write(flat[i : i + self.take], self.take)
            self.held, self.size = [flat[whole:]], len(flat) - whole

    def _write(self, ids: np.ndarray, filled: int) -> None:
        mask = np.arange(len(ids)) < filled
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.size:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.sequence) * self.sequence, self.kind)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        self.out.close()
        self.sink.close()


class SequenceFile:
    """Random access to the sequences of a file; arrays are views of its buffers."""

    def __init__(self, uri: str, sequence: int = SEQUENCE, batch: int = BATCH_SEQUENCES):
        fs, path = open_folder(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.sequence, self.batch, self.take = sequence, batch, sequence * batch
        self._at, self._held = -1, None

    def _batch(self, i: int) -> pa.RecordBatch:
        if i != self._at:
            self._at, self._held = i, self.reader.get_batch(i)
        return self._held

    def row(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence ``i``."""
        b, k = self._batch(i // self.batch), i % self.batch
        ids = b.column(0).values.to_numpy(zero_copy_only=True)[k * self.sequence : (k + 1) * self.sequence]
        return ids, b.column(1).values[k * self.sequence : (k + 1) * self.sequence]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids ``[start, stop)`` of the file, over sequences and batches."""
        parts = []
        while start < stop:
            i = start // self.take
            end = min(stop, (i + 1) * self.take)
            parts.append(self._batch(i).column(0).values.to_numpy(zero_copy_only=True)[start - i * self.take : end - i * self.take])
            start = end
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)

    def close(self) -> None:
        self.source.close()


# --- Spark ----------------------------------------------------------------------------------------


class TokenFiles(NamedTuple):
    """Where the documents are: part, file, place (in the file), doc_id, start (of all), n_tokens."""

    folder: str
    index: DataFrame


def write_token_files(
    docs: DataFrame, vocabulary: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE
) -> TokenFiles:
    """Encode ``docs`` into files under ``folder`` (shared; a new one by default).

    ``vocabulary`` is the JSON of the tokenizer.  Texts are dealt by ranges of the id
    and sorted, a task writes the file of its range.  File names are unique to the
    attempt, and the index names those of committed tasks only, so a task that is run
    again after a lost executor leaves no wrong rows.  A null text is an empty one, null
    ids come first, rows with one id follow each other in the order of their texts.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    shared = spark.sparkContext.broadcast(vocabulary)  # a file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, writer, place = encoder_of(shared.value), TaskContext.get().partitionId(), None, 0
        end = np.array([END_ID], encoder.kind)
        for batch in batches:
            places, sizes = [], []
            for text in batch.column(1).to_pylist():
                if writer is None:
                    fs, path = open_folder(folder)
                    fs.create_dir(path, recursive=True)
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.arrow"
                    writer = SequenceWriter(fs, f"{path}/{name}", encoder.kind, sequence)
                ids = np.frombuffer(encoder.encode(text or ""), encoder.kind)
                writer.add(ids)
                writer.add(end)
                places.append(place)
                sizes.append(len(ids) + 1)
                place += len(ids) + 1
            n = len(places)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([name] * n), pa.array(places, pa.int64()), batch.column(0), pa.array(sizes, pa.int64())],
                    names=["part", "file", "place", "doc_id", "n_tokens"],
                )
        if writer:
            writer.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    index = stored(rows.mapInArrow(run, "part int, file string, place long, doc_id long, n_tokens long"), "index")
    # a row per file: the files are as many as the tasks that wrote them
    sizes = index.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    index = index.join(sizes, "part").withColumn("start", F.col("before") + F.col("place")).drop("before")
    return TokenFiles(folder, index)


def read_back(files: TokenFiles, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), from the files."""
    folder = files.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            sums = []
            for file, place, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if file != name:
                    if reader:
                        reader.close()
                    name, reader = file, SequenceFile(f"{folder}/{file}", sequence)
                sums.append(zlib.crc32(reader.ids(place, place + n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(3), batch.column(4), batch.column(2), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    rows = files.index.select("file", "place", "n_tokens", "doc_id", "start")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
