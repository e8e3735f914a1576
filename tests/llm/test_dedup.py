"""Exact, line and near duplicates against plain versions."""

import hashlib
import random
from fractions import Fraction

import brute
import numpy as np

from folioframe.llm import common
from folioframe.llm import exact_dedup as ex
from folioframe.llm import line_dedup as ld
from folioframe.llm import ngram_join as nj
from folioframe.llm import shingles as sh


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, i) for i in range(301, 400)]
    got = {r.id: r.root for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = brute.roots({i for p in pairs for i in p}, pairs)
    linked = {i for a, b in pairs if a != b for i in (a, b)}
    assert got == {i: r for i, r in want.items() if i in linked}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


ODD = [(1, "Same Text", "a"), (2, "same text", "b"), (3, None, "c"), (4, "", None), (5, "ÄB", "c"), (6, "äb", "c"), (2, "same text", "b"),
       (None, "lone", None), (None, "same TEXT", "x"), (7, "y" * 200_000, "d"), (8, "Y" * 200_000, "d"), (9, "same tex", "e")]


def test_exact_dedup(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, kept string").repartition(3)
    got = sorted(((r.doc_id or 0, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in ex.exact_dedup(docs, with_digest=True).collect()), key=str)
    norm = lambda t: (t or "").translate(brute.FOLD)
    groups = {}
    for i, t, _ in ODD:
        groups.setdefault(norm(t), []).append(i)
    want, seen = [], set()
    for i, t, _ in ODD:
        g = groups[norm(t)]
        keep = max((x for x in g if x is not None), default=None)
        kept = i == keep and (i, norm(t)) not in seen
        seen.add((i, norm(t)))
        want.append((i or 0, keep, len(g), kept, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert ex.exact_dedup(docs.limit(0)).count() == 0


def plain_lines(rows, edits, least):
    norm = lambda s: s.strip(" \t\r").translate(brute.FOLD)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    first = {}
    for i, t in order:
        for n, line in enumerate((t or "").split("\n")):
            if len(norm(line)) >= least:
                first.setdefault(norm(line), (i is not None, i or 0, n))
    near = {a for a in first for b in first if edits and a != b and first[b] < first[a] and brute.within_one_edit(a, b)}
    out = []
    for i, t in rows:
        keep = [
            line for n, line in enumerate((t or "").split("\n"))
            if len(norm(line)) < least or (first[norm(line)] == (i is not None, i or 0, n) and norm(line) not in near)
        ]
        out.append((i, "\n".join(keep)))
    return out


def test_line_dedup(spark, monkeypatch):
    monkeypatch.setattr(ld, "BLOCK", 7)
    rng = random.Random(8)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(18, 40))) for _ in range(12)] + ["x" * 900]
    def edited(s):
        at, kind = rng.randrange(len(s)), rng.randrange(6)
        return [s[:at] + "q" + s[at:], s[:at] + s[at + 1 :], s[:at] + "q" + s[at + 1 :], s.upper(), " " + s + "\t", s][kind]
    rows = [(i, "\n".join(edited(rng.choice(base)) for _ in range(rng.randint(1, 6)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "short\nshort"), (None, base[0] + "\nend"), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, removed string").repartition(3)
    for edits in (1, 0):
        got = ld.line_dedup(docs, max_edits=edits, min_chars=18)
        assert got.columns == ["doc_id", "text", "removed", "lines_total", "lines_removed"]
        key = lambda r: (r[0] or -1, r[1])
        assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=key) == sorted(plain_lines(rows, edits, 18), key=key)
    assert ld.line_dedup(docs.limit(0)).count() == 0


def test_shingle_sets():
    texts = ["", " \n", "one", "One two", "a b c d a b c", "é x\x0by z é", "w " * 400_000]
    for width in (1, 3):
        for t, s in zip(texts, sh.shingle_sets([t.encode() for t in texts], width)):
            assert len(s) == len(brute.shingles(t, width))


def near_copies(rng, n, words=60):
    base = [f"w{i}" for i in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_region_join_is_exact():
    rng = random.Random(6)
    for bound in ((90, 100), (80, 100), (50, 100)):
        texts = near_copies(rng, 150) + near_copies(rng, 60, 25)
        sets = list(sh.shingle_sets([t.encode() for t in texts], 3))
        order = sorted(range(len(sets)), key=lambda i: i)
        root = nj.join_region([sets[i] for i in order], bound)
        want = brute.jaccard_components(list(enumerate(texts)), 3, bound[0])
        group = {}
        for i, r in enumerate(root):
            group.setdefault(int(r), []).append(i)
        assert {i: min(g) for g in group.values() for i in g} == {i: c for i, (_, c) in want.items()}


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(9)
    draw = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    for t in (Fraction(4, 5), Fraction(9, 10)):
        for n in [*range(1, 60), 150, 700, 3000]:
            for _ in range(20):
                # as many differences as a link allows, all in one set or split over both
                common = np.unique(draw(n))
                most = int(len(common) / t) - len(common)
                left = int(rng.integers(0, most + 1))
                a = np.unique(np.concatenate([common, draw(left)]))
                b = np.unique(np.concatenate([common, draw(most - left)]))
                if len(a) + len(b) > 2 * len(common):
                    assert np.intersect1d(nj.class_keys(a, t), nj.class_keys(b, t)).size


def test_jaccard_components(spark, monkeypatch):
    rng = random.Random(7)
    texts = near_copies(rng, 120) + ["other " * 50, None, "", "one two", "ONE two", "x y z", "x y z w"] + near_copies(rng, 5, 3000)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(*r, 1) for r in rows] + [(None, texts[0], 1), (3, texts[3], 1)], "doc_id long, text string, n long").repartition(5)
    for size in (1024, 16):
        monkeypatch.setattr(nj, "TASK_SETS", size)
        for width, percent in ((3, 90), (5, 80)):
            got = nj.jaccard_components(docs, width=width, percent=percent).collect()
            assert len(got) == len(rows) + 2
            want = brute.jaccard_components(rows, width, percent)
            assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
            assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert nj.jaccard_components(docs.limit(0)).count() == 0
    kept = {r.doc_id for r in nj.one_per_component(docs).collect()} - {None}
    want = brute.jaccard_components(rows, 5, 80)
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_lines_are_lower_cased_once(spark):
    """Testing the length of a lower-cased line works it out twice; only A-Z may change."""
    from folioframe.llm import common, line_dedup

    texts = ["ABC xyz", "ÀÉ ABC", "İSTANBUL", "\u212aELVIN", "ΣΑΣ ABC", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "_id long, _text string")
    got = dict(docs.select("_id", common.ascii_lower(docs["_text"])).collect())
    assert [got[i] for i in range(len(texts))] == [t and t.translate(str.maketrans(common.UPPER, common.LOWER)) for t in texts]
    plan = line_dedup._lines(docs, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1


def test_large_leaves_only_compare_sets_that_share_a_rare_shingle(monkeypatch):
    """Sets that have frequent shingles in common, which pivots cannot tell apart; a few are near copies."""
    rng = np.random.default_rng(3)
    common = rng.integers(0, 2**64, 40, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(common, 25, False), rng.integers(0, 2**64, 60, dtype=np.uint64)])) for _ in range(300)]
    sets += [np.unique(np.concatenate([s[rng.random(len(s)) > 0.04], rng.integers(0, 2**64, 2, dtype=np.uint64)])) for s in sets[:40]]
    compared, shared = [], nj._Region.shared
    monkeypatch.setattr(nj._Region, "shared", lambda self, i, others, *rest: compared.append(len(others)) or shared(self, i, others, *rest))
    for bound in ((80, 100), (90, 100)):
        compared.clear()
        root = nj.join_region(sets, bound)
        link = lambda a, b: 100 * len(np.intersect1d(a, b)) >= bound[0] * len(np.union1d(a, b))
        want = brute.roots(set(range(len(sets))), [(i, j) for i in range(300) for j in range(300, len(sets)) if link(sets[i], sets[j])])
        assert {i: int(r) for i, r in enumerate(root)} == want and len(set(want.values())) < len(sets)
        assert sum(compared) < 12 * len(sets)  # pivots included; before, nearly every pair
