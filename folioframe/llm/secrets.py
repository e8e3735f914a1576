"""Secret scan with inferred grammars.

Patterns with fixed prefixes or keywords find the base secrets.  From those, as labelled
credentials, a probabilistic automaton is inferred per kind: their prefix tree is folded
by merging states whose outgoing frequencies are statistically compatible (Hoeffding
bound).  Every other token of credential characters is then a candidate; it is a secret
if an automaton gives it a likelihood per character that is high enough, and higher
than the automaton of ordinary tokens does.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the base patterns and the order of their kinds
ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex")
# end of fixed values

FORMAT = "format"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
FIT_ROWS = 400  # credentials of each kind, and ordinary tokens, that automata are inferred from
LITERAL = 4  # first characters that an automaton sees as they are; later ones by class
ALPHA = 0.05  # of the compatibility test
FLOOR = 1e-4  # probability of a step that was never seen
SLACK = 0.5  # nats a character that a secret may lie below its kind's threshold
MARGIN = 0.7  # nats a character that a credential automaton must be ahead of the ordinary one

Span = tuple[int, int, str]  # start, end, kind


def base_spans(text: str) -> list[Span]:
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST["assign"]]
    for run in CANDIDATE.finditer(text):  # access keys and hex strings lie within such runs
        if run.end() - run.start() < 16:
            continue
        for kind, rx in (("access", ACCESS), ("hex", HEX)):
            spans = (m.span() for m in rx.finditer(text, run.start(), run.end()))
            found += [(a, b, kind) for a, b in spans if b - a >= LEAST[kind]]
    return sorted(found, key=_place)


def _place(span: Span) -> tuple[int, int, int]:
    order = (*KINDS, FORMAT)
    return span[0], order.index(span[2]), span[1]


def shown(spans: Sequence[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


# --- automata ------------------------------------------------------------------------------------

_CLASS = {c: k for k, chars in {"h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ", "0": "0123456789"}.items() for c in chars}
_END = ""


def symbols(token: str) -> list[str]:
    return ["=" + c for c in token[:LITERAL]] + [_CLASS.get(c, c) for c in token[LITERAL:]]


class Automaton:
    """Probabilistic automaton: state -> {symbol: (count, next state)}, ends counted under ``_END``."""

    def __init__(self, tokens: Sequence[str]):
        self.steps: list[dict[str, list]] = [{}]
        for token in tokens:
            at = 0
            for s in symbols(token):
                step = self.steps[at].setdefault(s, [0, -1])
                step[0] += 1
                if step[1] < 0:
                    step[1] = len(self.steps)
                    self.steps.append({})
                at = step[1]
            self.steps[at].setdefault(_END, [0, -1])[0] += 1
        self._fold()
        self._prepare()

    def _total(self, q: int) -> int:
        return sum(n for n, _ in self.steps[q].values())

    def _compatible(self, a: int, b: int) -> bool:
        """The frequencies of two states, and of all that follow them, differ by chance only."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self._total(a), self._total(b)
            if not na or not nb:
                continue
            bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            for s in self.steps[a].keys() | self.steps[b].keys():
                x, y = self.steps[a].get(s, (0, -1)), self.steps[b].get(s, (0, -1))
                if abs(x[0] / na - y[0] / nb) > bound:
                    return False
                if x[1] >= 0 and y[1] >= 0:
                    todo.append((x[1], y[1]))
        return True

    def _merge(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            for s, (n, to) in self.steps[b].items():
                mine = self.steps[a].setdefault(s, [0, -1])
                mine[0] += n
                if to >= 0:
                    if mine[1] < 0:
                        mine[1] = to
                    else:
                        todo.append((mine[1], to))

    def _fold(self) -> None:
        """Settle states from the root on; a neighbour of a settled state joins one or is settled."""
        settled = [0]
        done = {0}
        while True:
            front = [(q, s, to) for q in settled for s, (_, to) in sorted(self.steps[q].items()) if to >= 0 and to not in done]
            if not front:
                break
            q, s, to = max(front, key=lambda f: (self.steps[f[0]][f[1]][0], -f[0], f[1]))
            for r in settled:
                if self._compatible(r, to):
                    self.steps[q][s][1] = r
                    self._merge(r, to)
                    break
            else:
                settled.append(to)
                done.add(to)

    def _prepare(self) -> None:
        self.log = []
        for q in range(len(self.steps)):
            total = self._total(q)
            self.log.append({s: (math.log(n / total), to) for s, (n, to) in self.steps[q].items()} if total else {})

    def likelihood(self, token: str) -> float:
        """Mean log likelihood of a symbol; after an unseen step the walk stays where it is."""
        at, total, miss = 0, 0.0, math.log(FLOOR)
        steps = symbols(token)
        for s in steps:
            p = self.log[at].get(s)
            if p is None:
                # an unseen literal costs what the class of an unseen character costs
                total += miss if s[0] != "=" else miss / 2
            else:
                total += p[0]
                at = p[1]
        p = self.log[at].get(_END)
        return (total + (p[0] if p else miss)) / (len(steps) + 1)


class Grammars:
    """Automata of the kinds, their thresholds, and the automaton of ordinary tokens."""

    def __init__(self, credentials: dict[str, list[str]], ordinary: list[str]):
        self.plain = Automaton(ordinary)
        self.kinds = {k: Automaton(v) for k, v in sorted(credentials.items()) if v}
        # the lowest tenth of the labelled credentials of a kind may be odd ones
        self.least = {}
        for k, a in self.kinds.items():
            scores = sorted(a.likelihood(t) for t in credentials[k])
            self.least[k] = scores[len(scores) // 10]

    def is_secret(self, token: str) -> bool:
        scores = {k: a.likelihood(token) for k, a in self.kinds.items()}
        good = [v for k, v in scores.items() if v >= self.least[k] - SLACK]
        return bool(good) and max(good) >= self.plain.likelihood(token) + MARGIN


def scan(text: str, grammars: Grammars | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): candidates that overlap no base span are scored whole."""
    base = base_spans(text)
    if grammars is None or not grammars.kinds:
        return base, base
    more, taken, k = [], sorted((a, b) for a, b, _ in base), 0
    for m in CANDIDATE.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if any(a < m.end() and b > m.start() for a, b in taken[max(0, k - 3) : k + 3]):
            continue
        if grammars.is_secret(m.group()):
            more.append((m.start(), m.end(), FORMAT))
    return base, sorted(base + more, key=_place)


# --- Spark ----------------------------------------------------------------------------------------


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, token): values of base secrets, and one ordinary token in 512 by its hash."""
    for batch in batches:
        kinds, tokens = [], []
        for text in batch.column(0).to_pylist():
            spans = base_spans(text)
            for a, b, kind in spans:
                value = ASSIGN.match(text, a, b)[1] if kind == "assign" else text[a:b]
                kinds.append(kind)
                tokens.append(value)
            for m in CANDIDATE.finditer(text):
                if zlib.crc32(m.group().encode()) % 512 == 0 and not any(a < m.end() and b > m.start() for a, b, _ in spans):
                    kinds.append("")
                    tokens.append(m.group())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(tokens, pa.string())], names=["kind", "token"])


def infer(docs: DataFrame, text_col: str = "text", rows: int = FIT_ROWS) -> Grammars:
    """Automata from at most ``rows`` distinct tokens of each kind, those with the smallest hash.

    Tokens over 200 characters are left out of the fit (not of the scan).
    """
    texts = docs.where(F.col(text_col).isNotNull()).select(text_col)
    found = texts.mapInArrow(_samples, "kind string, token string").where(F.length("token") <= 200).distinct()
    order = Window.partitionBy("kind").orderBy(F.xxhash64("token"), "token")
    found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows)
    by: dict[str, list[str]] = {}
    for r in found.collect():  # four times ``rows`` short tokens
        by.setdefault(r["kind"], []).append(r["token"])
    return Grammars({k: sorted(v) for k, v in by.items() if k}, sorted(by.get("", [])))


def find_secrets(docs: DataFrame, grammars: Grammars | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base, spans: arrays of (start, end, kind), in code points, ends exclusive.

    A null text counts as empty.  Ids may be null or repeated; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammars)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "end", "kind")
        for batch in batches:
            base, spans = [], []
            for text in batch.column(1).to_pylist():
                b, s = scan(text or "", shared.value)
                base.append([dict(zip(names, x)) for x in b])
                spans.append([dict(zip(names, x)) for x in s])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, pa.list_(span)), pa.array(spans, pa.list_(span))], names=["_id", "base", "spans"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    array = "array<struct<start: bigint, end: bigint, kind: string>>"
    rows = docs.select(F.col(id_col).alias("_id"), text_col)
    return rows.mapInArrow(run, f"_id {kind}, base {array}, spans {array}").withColumnRenamed("_id", id_col)


def digest(spans: Sequence[Span]) -> str:
    return hashlib.sha256(shown(spans).encode()).hexdigest()
