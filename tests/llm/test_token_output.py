import zlib

import numpy as np
import pytest

from folioframe.llm import token_output as to

P = pytest.importorskip("public_tokenizers")
ODD = ["", None, " ", "a  b", " a", "a ", "\n a", "a \n b", "it's 's x", "a <|endoftext|> b", "12 34 5é ß  z", "  x", "é\n\n é", "word " * 3000 + "end"]


@pytest.fixture(scope="module")
def vocabulary():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def test_encoder_equals_library(vocabulary, monkeypatch):
    e = to.Encoder(vocabulary)
    for limit in (10, 0):
        monkeypatch.setattr(to, "CACHE_WORDS", limit)
        for text in ODD:
            want = e.tokenizer.encode(text or "", add_special_tokens=False).ids
            assert np.frombuffer(e.encode(text or ""), e.kind).tolist() == want


def test_round_trip(spark, vocabulary, tmp_path):
    rows = [(i * 3 if i != 5 else None, t, "x") for i, t in enumerate(ODD)] + [(6, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(3)
    files = to.write_token_files(docs, vocabulary, str(tmp_path / "out"), sequence=64)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in to.read_back(files, 64).collect())
    e, start, want = to.Encoder(vocabulary), 0, []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = e.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    one = next((tmp_path / "out").iterdir())
    f = to.SequenceFile(str(one), 64)
    ids, mask = f.row(0)
    assert len(ids) == len(mask) == 64 and not ids.flags.owndata
    empty = to.write_token_files(docs.limit(0), vocabulary)
    assert to.read_back(empty).count() == 0


def test_encoder_takes_ids_without_offsets(vocabulary):
    class Ids:
        def encode(self, *args, **more):
            raise AssertionError("offsets of tokens cost time and are not read")

        def __getattr__(self, name):
            return getattr(tokenizer, name)

    e = to.Encoder(vocabulary)
    tokenizer, e.tokenizer = e.tokenizer, Ids()
    for text in ("plain words", "a  b", "a <|endoftext|> b"):
        assert np.frombuffer(e.encode(text), e.kind).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_words_split_at_line_breaks():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = to.Encoder(f.read())
    texts = ["", "\n", "a", "a\nb c\nb", "\na b", "a b\n", "a\n\nb", "a\n\n\nb c", "a\r\nb c", "a\t\nb", "a\n\tb", "a\n b", "a \nb", "ß\né\n😀 x", "x.\n'tis\n's\n42\n--", "a\u2028\nb\n\u00a0c"]
    for text in texts + ["x ".join(texts)] + texts:
        ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), encoder.kind).tolist() == ids, text
    assert {"\nb", "\né"} <= encoder.words.keys()  # a word after a line break is kept as one of its own
