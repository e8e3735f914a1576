import random

import numpy as np

from folioframe.llm import suffix_dedup as sd


def plain(texts, width):
    """Spans by comparing all windows."""
    seen = {}
    for t in texts:
        for i in range(len(t) - width + 1):
            seen[t[i : i + width]] = seen.get(t[i : i + width], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        out.append(bytes(np.frombuffer(t, np.uint8)[~gone]))
    return out


def made(rng, n):
    """Texts with shared, edited and self-repeated passages."""
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.choice([40, 90, 130, 400]))) for _ in range(5)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passages)
            kind = rng.random()
            if kind < 0.3:
                at = rng.randrange(len(p))
                p = p[:at] + rng.choice("xyz") + p[at + rng.randint(0, 1) :]
            elif kind < 0.5:
                p = p[rng.randrange(len(p)) :]
            elif kind < 0.6:
                p = " ".join(word() for _ in range(100))
            parts.append(p)
        out.append("".join(parts))
    return out


def test_columns_equal_window_counts():
    rng = random.Random(4)
    for width in (4, 7):
        for _ in range(200):
            n = rng.randint(1, 12)
            group = np.sort(np.array([rng.randrange(3) for _ in range(n)]))
            texts, anchor = [], []
            for _ in range(n):
                left, right = rng.randint(0, 9), rng.randint(width, 14)
                texts.append(np.array([rng.randrange(2) for _ in range(left + right)], np.uint8))
                anchor.append(left)
            got = sd.repeated_starts(group, texts, np.array(anchor), width)
            count = {}
            for g, t, a in zip(group, texts, anchor):
                for i in range(len(t) - width + 1):
                    k = (g, i - a, t[i : i + width].tobytes())
                    count[k] = count.get(k, 0) + 1
            for g, t, a, f in zip(group, texts, anchor, got):
                assert f.tolist() == [count[g, i - a, t[i : i + width].tobytes()] > 1 for i in range(len(t) - width + 1)]


def test_whole_operator(spark, monkeypatch):
    rng = random.Random(9)
    texts = made(rng, 60) + [None, "", "short", "a" * 1500, "ab" * 900, "x" * 399, "y" * 400, "z" * 401]
    rows = [(i if i != 7 else None, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "s"), (3, texts[5], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, anchor string").repartition(4)
    want = sorted((-1 if r[0] is None else r[0], k) for r, k in zip(rows, plain([(r[1] or "").encode() for r in rows], 400)))
    for hot in (16_384, 1):
        monkeypatch.setattr(sd, "HOT_CONTEXTS", hot)
        got = [(-1 if r.doc_id is None else r.doc_id, bytes(r.kept), r.n_bytes, r.spans) for r in sd.remove_repeats(docs).collect()]
        assert sorted(g[:2] for g in got) == want
        assert all(len(k) == n - sum(s.end - s.start for s in spans) for _, k, n, spans in got)
    assert sd.remove_repeats(docs.limit(0)).count() == 0
