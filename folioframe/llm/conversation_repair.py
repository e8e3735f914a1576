"""Cheapest repair of the structure of conversations, by dynamic programs on a grammar.

A row of a conversation becomes a symbol: the class of its role and its first fault.  The
order of a repaired conversation is the language of an automaton with four states, so a
symbol is a 4 x 4 min-plus matrix: cheapest edits, and their letters, that lead from state
to state over that row.  Re-Pair turns the symbol sequences of the whole corpus into rules;
each rule gets one matrix, the product of its parts', whose letters are ropes that share
those of the parts.  A conversation is then a short product, and rules are shared by all.

Rows are dealt by ranges of (conversation, turn), so a conversation of any length is cut
into segments of bounded length, and matrices are what makes segments independent.  The
repaired rows of one conversation are written by one task in their order, as a stream.
"""

from __future__ import annotations

import hashlib
import os
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioframe.llm.common import stored

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
ROLES = "sua"  # initials with a place in the order; any other is a class of its own
FAULTS = ("ok", "blank", "duplicate", "truncated")
FIRST = ord("A")  # the letter of symbol 0
SEGMENT = 1024  # rows of a segment
ROUNDS = 8  # of pairing
PAIRS = 64  # pairs that a round looks at
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3

# states: nothing yet; after a system turn; after a user turn; after an assistant turn
STATES = range(4)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTED = (0, 3)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


# --- matrices -------------------------------------------------------------------------------------


class Rope:
    """Letters of edits as a pair of ropes; the text is put together when it is first needed."""

    __slots__ = ("left", "right", "_text")

    def __init__(self, left: Rope | None, right: Rope | None, text: str | None = None):
        self.left, self.right, self._text = left, right, text

    @property
    def text(self) -> str:
        if self._text is None:
            self._text = self.left.text + self.right.text
        return self._text


NOTHING = Rope(None, None, "")
Entry = tuple[int, Rope]
Matrix = list[list["Entry | None"]]


def better(x: Entry, y: Entry | None) -> bool:
    """Cheaper, or as cheap with letters that are less.

    Of two cheapest ways over the same rows none is a beginning of the other: equal letters
    use equal rows, and what is left could only be insertions, which cost.  So the order
    stays as it is when both go on alike, and min-plus products are right.
    """
    return y is None or x[0] < y[0] or (x[0] == y[0] and x[1].text < y[1].text)


def product(x: Matrix, y: Matrix) -> Matrix:
    out: Matrix = [[None] * 4 for _ in STATES]
    for i in STATES:
        for k in STATES:
            a = x[i][k]
            if a is None:
                continue
            for j in STATES:
                b = y[k][j]
                if b is not None:
                    new = (a[0] + b[0], Rope(a[1], b[1]))
                    if better(new, out[i][j]):
                        out[i][j] = new
    return out


def _inserted() -> Matrix:
    """Up to two insertions: more only go round in circles."""
    out: Matrix = [[(0, NOTHING) if i == j else None for j in STATES] for i in STATES]
    one: Matrix = [[None] * 4 for _ in STATES]
    for (i, initial), j in STEP.items():
        if initial != "s":
            one[i][j] = (INSERT, Rope(None, None, "I"))
    two = product(one, one)
    for more in (one, two):
        for i in STATES:
            for j in STATES:
                if more[i][j] is not None and better(more[i][j], out[i][j]):
                    out[i][j] = more[i][j]
    return out


def symbol_matrix(symbol: int) -> Matrix:
    """Insertions before a row, then what is done with it."""
    role, fault = divmod(symbol, len(FAULTS))
    row: Matrix = [[None] * 4 for _ in STATES]

    def way(i: int, j: int, cost: int, letter: str) -> None:
        new = (cost, Rope(None, None, letter))
        if better(new, row[i][j]):
            row[i][j] = new

    more = CUT_OFF if FAULTS[fault] == "truncated" else 0
    for i in STATES:
        way(i, i, DELETE, "D")
        if FAULTS[fault] in ("blank", "duplicate"):
            continue
        if role < len(ROLES) and (i, ROLES[role]) in STEP:
            way(i, STEP[i, ROLES[role]], more, "K")
        for initial in "ua":
            if (i, initial) in STEP:
                way(i, STEP[i, initial], REROLE + more, "R")
    return product(_inserted(), row)


class Grammar:
    """Rounds of rules, each round a map from a pair of symbols to a new one, and their matrices."""

    def __init__(self, rounds: Sequence[dict[tuple[int, int], int]]):
        self.rounds = rounds
        self.matrix = [symbol_matrix(s) for s in range((len(ROLES) + 1) * len(FAULTS))]
        for rules in rounds:
            for (a, b), new in rules.items():
                assert new == len(self.matrix)
                self.matrix.append(product(self.matrix[a], self.matrix[b]))
        self.closing = _inserted()

    def reduced(self, symbols: str) -> list[int]:
        return reduced([ord(c) - FIRST for c in symbols], self.rounds)


def reduced(row: list[int], rounds: Sequence[dict[tuple[int, int], int]]) -> list[int]:
    """The row after all rules; pairs are taken from the left."""
    for rules in rounds:
        out, k = [], 0
        while k < len(row):
            new = rules.get((row[k], row[k + 1])) if k + 1 < len(row) else None
            out.append(row[k] if new is None else new)
            k += 1 if new is None else 2
        row = out
    return row


class Walk:
    """Cheapest edits over the segments of one conversation so far, for each state they may end in."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.at: list[tuple[int, str] | None] = [(0, ""), None, None, None]
        self.settled: list[str] = []  # letters that all ways share

    def _step(self, matrix: Matrix) -> None:
        out: list[tuple[int, str] | None] = [None] * 4
        for i in STATES:
            for j in STATES:
                if self.at[i] is not None and matrix[i][j] is not None:
                    new = (self.at[i][0] + matrix[i][j][0], self.at[i][1] + matrix[i][j][1].text)
                    if out[j] is None or new < out[j]:
                        out[j] = new
        self.at = out

    def add(self, symbols: str) -> None:
        for s in self.grammar.reduced(symbols):
            self._step(self.grammar.matrix[s])
        shared = os.path.commonprefix([x[1] for x in self.at if x is not None])
        if len(shared) > 64:
            self.settled.append(shared)
            self.at = [None if x is None else (x[0], x[1][len(shared) :]) for x in self.at]

    def best(self) -> tuple[int, str]:
        self._step(self.grammar.closing)
        cost, tail = min(self.at[s] for s in ACCEPTED if self.at[s] is not None)
        return cost, "".join([*self.settled, tail])


# --- rows and symbols -----------------------------------------------------------------------------


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The same columns with the faults that a hash of (conversation, turn) gives each row, and ``copies``:
    how often the row now stands there (0 where it was dropped).

    A null role or text becomes one space, and so does a null in the hashed string.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown(conv_col), F.lit(":"), shown(turn_col)).cast("binary")) % 20
    role, text = shown(role_col), shown(text_col)
    text = F.when(fault == 1, "").when(fault == 2, F.translate(text, ENDS, "")).otherwise(text)
    return rows.select(
        F.col(conv_col),
        F.col(turn_col),
        F.when(fault == 4, "user").otherwise(role).alias(role_col),
        text.alias(text_col),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def _symbol(role: Column, fault: str | Column) -> Column:
    initial = F.substring(role, 1, 1)
    of_role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.lit(FAULTS.index(fault)) if isinstance(fault, str) else fault
    return F.char(F.lit(FIRST) + of_role * len(FAULTS) + fault)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Symbols of sorted rows, cut where a conversation ends and after ``SEGMENT`` rows."""
    task = TaskContext.get().partitionId()
    conv, last, seg, held, size = None, None, 0, [], 0
    out: list[tuple] = []
    kind = None

    def cut() -> None:
        nonlocal held, size, seg
        if held:
            out.append((conv, task, seg, "".join(held)))
            seg += 1
        held, size = [], 0

    def written() -> pa.RecordBatch:
        names = ["conv", "task", "seg", "symbols"]
        kinds = [kind, pa.int32(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    for batch in batches:
        kind = batch.schema.field(0).type
        for c, turn, key, one, again, times in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if last is None or c != conv:
                cut()
                conv, seg, last = c, 0, None
            # a row that is equal to the one before in all that rows are sorted by repeats it
            held.append((again if last == (turn, key) else one) + again * (times - 1))
            last = (turn, key)
            size += times
            if size >= SEGMENT:
                cut()
            if len(out) >= 4096:
                yield written()
                out.clear()
    cut()
    if out:
        yield written()


def _segment_rows(turns: DataFrame, schema: str) -> DataFrame:
    """conv, task, seg, symbols: in the order (conv, task, seg), the symbols of all rows in theirs."""
    place = F.struct(F.col("turn").isNotNull(), "turn")
    first = turns.where("not blank").groupBy("conv", "key").agg(F.min(place).alias("first")).withColumnsRenamed({"conv": "_conv", "key": "_key"})
    rows = turns.join(first, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key")), "left")
    fault = F.when(F.col("blank"), 1).when(place > F.col("first"), 2).when(F.col("cut"), 3).otherwise(0)
    again = F.when(F.col("blank"), _symbol(F.col("role"), "blank")).otherwise(_symbol(F.col("role"), "duplicate"))
    rows = rows.select("conv", "turn", "key", _symbol(F.col("role"), fault).alias("one"), again.alias("again"), "copies", "role")
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "key"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("role")
    return rows.mapInArrow(_segments, schema)


def infer(segments: DataFrame, rounds: int = ROUNDS) -> list[dict[tuple[int, int], int]]:
    """Re-Pair in rounds: the most frequent pairs of the corpus that do not meet become rules.

    Counts cover every segment; only the ``PAIRS`` most frequent pairs of a round reach the driver.
    """
    once = stored(segments.groupBy("symbols").count(), "symbols")
    found: list[dict[tuple[int, int], int]] = []
    new = (len(ROLES) + 1) * len(FAULTS)
    for _ in range(rounds):
        done = list(found)

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()  # at most the square of the number of symbols
            for batch in batches:
                for symbols, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    row = reduced([ord(c) - FIRST for c in symbols], done)
                    for pair in zip(row, row[1:]):
                        seen[pair] += n
            columns = list(zip(*((a, b, n) for (a, b), n in seen.items()))) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n"])

        counts = once.mapInArrow(pairs, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        top = counts.where("n > 1").orderBy(F.desc("n"), "a", "b").limit(PAIRS).collect()
        rules: dict[tuple[int, int], int] = {}
        left: set[int] = set()
        right: set[int] = set()
        for r in top:
            if r["a"] in right or r["b"] in left or (r["a"] == r["b"] and (r["a"] in left or r["b"] in right)):
                continue
            rules[r["a"], r["b"]] = new
            left.add(r["a"])
            right.add(r["b"])
            new += 1
        if not rules:
            break
        found.append(rules)
    return found


# --- the repair -----------------------------------------------------------------------------------

OUT = "place long, edit string, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Conversation:
    """One conversation of the stream: its segments come first, then its rows."""

    def __init__(self, conv: object, gaps: int, grammar: Grammar, known: dict):
        self.conv, self.gaps, self.grammar, self.known = conv, gaps, grammar, known
        self.walk, self.counts, self.illegal, self.role = None, Counter(), 0, ""
        self.only: str | None = None  # the symbols, while there is one segment
        self.cost, self.audit, self.next, self.place, self.state = 0, None, 0, 0, 0

    def segment(self, symbols: str) -> None:
        roles = [(ROLES + "-")[(ord(c) - FIRST) // len(FAULTS)] for c in symbols]
        self.counts.update(FAULTS[(ord(c) - FIRST) % len(FAULTS)] for c in symbols)
        self.illegal += sum(p not in LEGAL for p in zip([self.role, *roles] if self.role else roles, roles if self.role else roles[1:]))
        self.role = roles[-1]
        if self.walk is None and self.only is None:
            self.only = symbols
            return
        if self.walk is None:
            self.walk = Walk(self.grammar)
            self.walk.add(self.only)
        self.walk.add(symbols)

    def _solved(self) -> None:
        if self.audit is not None:
            return
        if self.walk is not None:
            self.cost, self.audit = self.walk.best()
        elif self.only is None:
            self.audit = ""
        else:
            if self.only not in self.known:
                if len(self.known) >= 1 << 16:
                    self.known.clear()
                walk = Walk(self.grammar)
                walk.add(self.only)
                self.known[self.only] = walk.best()
            self.cost, self.audit = self.known[self.only]

    def _turn(self, edit: str, role: str, text: str) -> tuple:
        self.state = STEP[self.state, role[:1]]
        self.place += 1
        return (self.conv, self.place, edit, role, text) + (None,) * 7

    def _expected(self) -> str:
        return "assistant" if self.state == 2 else "user"

    def _insertions(self) -> Iterator[tuple]:
        while self.next < len(self.audit) and self.audit[self.next] == "I":
            self.next += 1
            yield self._turn("I", self._expected(), "")

    def row(self, role: str, text: str) -> Iterator[tuple]:
        self._solved()
        yield from self._insertions()
        edit = self.audit[self.next]
        self.next += 1
        if edit == "K":
            yield self._turn("K", role, text)
        elif edit == "R":
            yield self._turn("R", self._expected(), text)

    def ended(self) -> Iterator[tuple]:
        self._solved()
        yield from self._insertions()
        counts = [self.counts[f] for f in FAULTS[1:]]
        yield (self.conv, None, None, None, None, self.gaps, *counts, self.illegal, self.cost, self.audit)


def _repaired(rounds: list[dict[tuple[int, int], int]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, known = Grammar(rounds), {}
        now: _Conversation | None = None
        out: list[tuple] = []
        size = 0

        def written() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for batch in batches:
            for conv, tag, gaps, symbols, role, text, times in zip(*(batch.column(i).to_pylist() for i in range(7))):
                new: list[tuple] = []
                if tag == 0:
                    if now is not None:
                        new += now.ended()
                    now = _Conversation(conv, gaps, grammar, known)
                elif tag == 1:
                    now.segment(symbols)
                else:
                    for _ in range(times):
                        new += now.row(role, text)
                out += new
                size += sum(len(r[4] or "") + 64 for r in new)
                if size > 1 << 22:
                    yield written()
                    out.clear()
                    size = 0
        if now is not None:
            out += now.ended()
        if out:
            yield written()

    return run


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired rows of each conversation in their order, then a row with its audit.

    Repaired rows have ``place`` (from 1), ``edit`` (K kept, R with another role, I
    inserted), role and text.  The last row of a conversation has null there and holds
    gaps, blank, duplicate, truncated, illegal, cost and audit.  All rows of a conversation
    stand in one partition, one after the other; see :func:`turns`, :func:`audits` and
    :func:`digests`.

    Rows are taken by turn, null first; rows of one turn by role and then by the SHA-256 of
    role and text.  A null role or text counts as one space; a null conversation is one of
    its own.  A column ``copies`` says how often a row stands there: conversations whose
    rows all have 0 are returned with zeros and an empty audit.  Other columns are ignored,
    and an empty table gives no row.  A conversation may be longer than memory, but for its
    audit, which is a letter or two a row.
    """
    text, role = F.coalesce(F.col(text_col), F.lit(" ")), F.coalesce(F.col(role_col), F.lit(" "))
    times = F.col("copies") if "copies" in rows.columns else F.lit(1)
    trimmed = F.rtrim(text, F.lit(BLANKS))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    full = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), key.alias("key"), times.cast("int").alias("copies"))
    narrow = rows.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        role.alias("role"),
        key.alias("key"),
        times.cast("int").alias("copies"),
        (trimmed == "").alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(list(ENDS))).alias("cut"),
    )
    narrow = stored(narrow, "turns")
    kind = narrow.schema["conv"].dataType.simpleString()
    live = narrow.where("copies > 0")
    segments = stored(_segment_rows(live, f"conv {kind}, task int, seg long, symbols string"), "segments")
    rounds = infer(segments)

    seen = F.when(F.col("copies") > 0, F.col("turn"))
    wide = lambda c: c.cast("decimal(20,0)")  # so that distant turns do not overflow
    gaps = F.coalesce(wide(F.max(seen)) - wide(F.min(seen)) + 1 - wide(F.count_distinct(seen)), F.lit(0))
    base = narrow.groupBy("conv").agg(F.least(gaps, F.lit(2**63 - 1)).cast("long").alias("gaps"))
    null = F.lit(None)
    stream = (
        base.select("conv", F.lit(0).alias("tag"), "gaps", null.cast("string").alias("symbols"), null.cast("string").alias("role"), null.cast("string").alias("text"), null.cast("int").alias("copies"), null.cast("int").alias("task"), null.cast("long").alias("seg"), null.cast("binary").alias("key"))
        .unionByName(segments.withColumn("tag", F.lit(1)), allowMissingColumns=True)
        .withColumn("turn", null.cast(narrow.schema["turn"].dataType))
        .unionByName(full.where("copies > 0").withColumn("tag", F.lit(2)), allowMissingColumns=True)
    )
    order = [F.asc_nulls_first("conv"), "tag", "task", "seg", F.asc_nulls_first("turn"), "role", "key"]
    stream = stream.repartition("conv").sortWithinPartitions(*order).select("conv", "tag", "gaps", "symbols", "role", "text", "copies")
    schema = f"conv {kind}, {OUT}"
    arrow = _arrow(StructType.fromDDL(schema))
    return stream.mapInArrow(_repaired(rounds, arrow), schema).withColumnRenamed("conv", conv_col)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def turns(repaired: DataFrame) -> DataFrame:
    """The repaired conversations: id, place, role, text, edit."""
    return repaired.where(F.col("place").isNotNull()).select(repaired.columns[0], "place", "role", "text", "edit")


def audits(repaired: DataFrame) -> DataFrame:
    """A row for each conversation: what was found and what was done."""
    return repaired.where(F.col("place").isNull()).drop("place", "edit", "role", "text")


def digests(repaired: DataFrame) -> DataFrame:
    """:func:`audits` and the SHA-256 of each repaired conversation, ``role:text`` joined by newlines.

    Reads the partitions of :func:`repair` as they come: a hash needs its text in one
    sequence, but never in memory at once.
    """
    kept = [f for f in repaired.schema if f.name not in ("place", "edit", "role", "text")]
    schema = StructType([*kept]).add("repaired_sha256", "string")
    arrow = _arrow(schema)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, n = hashlib.sha256(), 0
        for batch in batches:
            columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            ends, shown = [], []
            for k, (place, role, text) in enumerate(zip(*(columns[c].to_pylist() for c in ("place", "role", "text")))):
                if place is None:
                    ends.append(k)
                    shown.append(hashed.hexdigest())
                    hashed, n = hashlib.sha256(), 0
                else:
                    hashed.update((("\n" if n else "") + role + ":" + text).encode())
                    n += 1
            at = pa.array(ends, pa.int64())
            arrays = [columns[c].take(at) for c in names] + [pa.array(shown, pa.string())]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow)], schema=arrow)

    return repaired.mapInArrow(run, schema)
