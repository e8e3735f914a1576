import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from folioframe.llm import conversation_repair as cr
from folioframe.llm.queries import op12_conversation_structure_repair

BLANK = re.compile(r"[\x20\x09-\x0D]")
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}  # last role so far: roles that may follow


def cheapest(rows):
    """(cost, letters) by a plain search from the end: rows are (initial, fault)."""

    @lru_cache(None)
    def best(i, last, inserted):
        found = []
        if i == len(rows) and last in ("", "a"):
            found.append((0, ""))
        if inserted < 3:
            for r in "ua":
                if r in NEXT[last]:
                    c, t = best(i, r, inserted + 1)
                    found.append((c + 3, "I" + t))
        if i < len(rows):
            initial, fault = rows[i]
            c, t = best(i + 1, last, 0)
            found.append((c + 4, "D" + t))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                for r in "sua":
                    if r in NEXT[last] and (r == initial or r != "s"):
                        c, t = best(i + 1, r, 0)
                        found.append((c + more + (0 if r == initial else 3), ("K" if r == initial else "R") + t))
        return min(found, default=(10**9, ""))

    for i in range(len(rows), -1, -1):  # from the end, so that no call goes deep
        for inserted in (3, 2, 1, 0):
            for last in NEXT:
                best(i, last, inserted)
    return best(0, "", 0)


def plain(rows):
    """The contract's columns by conversation, for (conv, turn, role, text) after damage, times included."""
    by = defaultdict(list)
    for conv, turn, role, text, times in rows:
        by[conv] += [(turn, role, text)] * times
    out = {}
    for conv, held in by.items():
        key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
        held.sort(key=key)
        seen, faults = set(), []
        for _, role, text in held:
            solid = BLANK.sub("", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "ok" if solid[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append(fault)
        initials = [r[1][:1] for r in held]
        cost, audit = cheapest([(i, f) for i, f in zip(initials, faults)])
        turns = [t for t, _, _ in held if t is not None]
        lines, at = [], iter(held)
        last = ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(at)[1:]
            if edit == "D":
                continue
            if edit in "RI":
                role = "assistant" if last == "u" else "user"
            last = role[:1]
            lines.append(f"{role}:{text}")
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(df, conv="conv_id"):
    rows = df.collect()
    out = {r[conv]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def hurt(rows):
    """The damage of the contract."""
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        d = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        yield conv, turn, "user" if d == 4 else role, text, {0: 0, 3: 2}.get(d, 1)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    df = op12_conversation_structure_repair(spark, f"/root/testdata/{sf}")
    assert df.columns[:9] == ["conv_id", *COLUMNS]
    rows = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert got(df) == plain(hurt(map(tuple, rows)))


@pytest.mark.parametrize("segment", [3, 1024])
def test_odd_rows(spark, monkeypatch, segment):
    monkeypatch.setattr(cr, "SEGMENT", segment)
    rng = random.Random(7)
    texts = ["a.", "b", "", " \t", None, "c!", "d?", "no end " * 40, "é。", ".\x0b", "dot. "]
    roles = ["user", "assistant", "system", "tool", "", None, "u", "User"]
    rows = [
        (rng.choice([None, *range(40)]), rng.choice([None, *range(-3, 9)]), rng.choice(roles[:3] * 4 + roles), rng.choice(texts))
        for _ in range(700)
    ]
    rows += [(77, 2**63 - 1, "user", "far."), (77, -(2**63), "assistant", "off."), (78, None, None, None)]
    rows += [(99, i, "user" if i % 3 else "assistant", f"line {i}" + "." * (i % 5 != 0)) for i in range(500)]
    extra = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, tag string, place int")
    want = plain(hurt(rows))
    want[77] = (2**63 - 1, *want[77][1:])  # kept within a long
    assert got(cr.digests(cr.repair(cr.damaged(extra)))) == want
    assert cr.repair(extra.limit(0)).count() == 0


def test_rows_as_they_are(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 2, "assistant", "Well."), (2, 0, "system", "Be.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = cr.repair(df)
    kept = [tuple(r) for r in cr.turns(out).orderBy("conv_id", "place").collect()]
    assert kept == [
        (1, 1, "user", "Hi.", "K"),
        (1, 2, "assistant", "Yes.", "K"),
        (1, 3, "user", "", "I"),
        (1, 4, "assistant", "Well.", "K"),
    ]
    assert {r.conv_id: (r.cost, r.audit) for r in cr.audits(out).collect()} == {1: (3, "KKIK"), 2: (4, "D")}


def test_rules_change_nothing():
    rng = random.Random(3)
    rounds, new = [], 16
    for _ in range(4):
        pairs = {(rng.randrange(new), rng.randrange(new)) for _ in range(30)}
        rules = {}
        for p in sorted(pairs):
            rules[p] = new + len(rules)
        rounds.append(rules)
        new += len(rules)
    bare, ruled = cr.Grammar([]), cr.Grammar(rounds)
    for _ in range(200):
        symbols = "".join(chr(cr.FIRST + rng.randrange(16)) for _ in range(rng.randrange(0, 40)))
        one, two = cr.Walk(bare), cr.Walk(ruled)
        one.add(symbols)
        two.add(symbols[:11])
        two.add(symbols[11:])
        rows = [((cr.ROLES + "-")[(ord(c) - cr.FIRST) // 4], cr.FAULTS[(ord(c) - cr.FIRST) % 4]) for c in symbols]
        assert one.best() == two.best() == cheapest(rows)
