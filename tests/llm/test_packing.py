import numpy as np
import pandas as pd

from folioframe.llm import packing as pk


def plain(pdf, capacity):
    """Best fit over all bins, one by one."""
    pdf = pdf.sort_values(["id", "length", "source", "cluster"], kind="stable", na_position="first").reset_index(drop=True)
    rest = pdf["length"] % capacity
    bins, out = [], {}
    for i in sorted(pdf.index, key=lambda i: (-rest[i], i)):
        if rest[i] == 0 and pdf["length"][i]:
            continue
        fits = [
            (left, b)
            for b, (left, sources, clusters) in enumerate(bins)
            if 0 < left and left >= rest[i] and pdf["source"][i] not in sources and pdf["cluster"][i] not in clusters
        ]
        if fits:
            left, b = min(fits)
        else:
            b, left = len(bins), capacity
            bins.append(None)
        _, sources, clusters = bins[b] or (0, set(), set())
        add = lambda held, v: held | ({v} if v is not None else set())
        bins[b] = (left - rest[i], add(sources, pdf["source"][i]), add(clusters, pdf["cluster"][i]))
        out[int(pdf["id"][i]), int(pdf["length"][i] // capacity)] = (b, capacity - left)
    return out


def test_shard_is_best_fit():
    rng = np.random.default_rng(3)
    for n, capacity in ((300, 100), (200, 37), (1, 5), (0, 5)):
        pdf = pd.DataFrame(
            {
                "id": np.arange(n),
                "length": rng.integers(0, 250, n),
                "source": np.array([f"s{i}" for i in rng.integers(0, 9, n)], object),
                "cluster": np.array([None if i > 5 else str(i) for i in rng.integers(0, 40, n)], object),
            }
        )
        pdf.loc[pdf.index % 17 == 3, "source"] = None
        got = pk.pack_shard(pdf, capacity)
        want = plain(pdf, capacity)
        last = {(r.id, r.piece): (r.bin, r.offset) for r in got.itertuples() if (r.id, r.piece) in want}
        assert last == want
        assert got.groupby("id")["length"].sum().to_dict() == pdf.set_index("id")["length"].to_dict()
        assert got.groupby("bin")["length"].sum().max() <= capacity if n else got.empty


def test_pack_of_odd_rows(spark):
    rows = [(1, "abc", "s", None, 9), (1, "abc", "s", None, 9), (None, None, None, None, None), (3, "x" * 25, "s", "k", 1), (4, "", "t", "k", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, cluster string, bin long")
    got = pk.pack(docs, 10).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in got) == [(0, 0, 0), (1, 0, 3), (1, 0, 3), (3, 0, 10), (3, 1, 10), (3, 2, 5), (4, 0, 0)]
    a, b = [r for r in got if r.doc_id == 1]
    assert (a.shard, a.bin) != (b.shard, b.bin)
    assert pk.pack(docs.limit(0), 10).count() == 0
