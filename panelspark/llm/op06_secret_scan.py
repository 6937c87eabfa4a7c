"""Secret scan with one combined deterministic automaton.

All rule regexes (over ASCII) become one Thompson automaton, read *backwards*; subset construction and
minimisation give one transition array. A single pass over a text's bytes from its end marks every place where a
match of some rule starts, with the rules. At such a place the rule's own forward automaton gives the longest
end. Matches of a rule are leftmost and don't overlap, as with ``re.finditer``.

The pass is exact for any set of rules: the marks are all starts of all matches, taken from the left, each
after the end of the one before. A rule may bound the length of the match or of a group; like a match that
``finditer`` yields and the caller drops, a failing match still takes its place in the text.

Arrays are compiled once per task (some milliseconds) and hold a few thousand states at most. Texts are scanned one
by one and whole: memory is bounded by the longest text. Rows are independent, there is no shuffle.

Edge cases: null text is empty; an empty text has no spans; spans are in code points, also after
characters of several bytes; repeated rows are scanned alike; an empty table gives an empty result. A rule that
fits the empty text is an error.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str  # over ASCII; what `parse` knows
    any_case: bool = False
    least: int = 1  # characters of the match, or of `group`
    group: int = 0


#: The rules that the query's contract names, in its order.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    # runs of 24 or more: the same matches as all runs with the short ones dropped
    Rule("hex", r"[0-9a-f]{24,}", least=24),
)
#: Further kinds of tokens that carry their own mark.
MORE_RULES = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


class _Reader:
    """Recursive descent over a rule's regex; see ``parse``."""

    REPEAT = re.compile(r"[?*+]|\{([0-9]+)(,?)([0-9]*)\}")

    def __init__(self, regex: str, any_case: bool):
        self.s, self.i, self.any_case = regex, 0, any_case

    def wrong(self, what: str) -> ValueError:
        return ValueError(f"{what} at {self.i} of the rule {self.s!r}")

    def peek(self) -> str:
        return self.s[self.i:self.i + 1]

    def take(self) -> str:
        c = self.peek()
        if not c or not c.isascii():
            raise self.wrong("end" if not c else "not ASCII")
        self.i += 1
        return c

    def either(self) -> tuple:
        ways = [self.row()]
        while self.peek() == "|":
            self.i += 1
            ways.append(self.row())
        return ("any", ways)

    def row(self) -> tuple:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.one()))
        return ("all", parts)

    def one(self) -> tuple:
        c = self.take()
        if c == "(":
            if self.s.startswith("?:", self.i):
                self.i += 2
            inner = self.either()
            if self.take() != ")":
                raise self.wrong("open group")
            return inner
        if c == "[":
            return ("set", self.members())
        if c in ".^$?*+{":
            raise self.wrong(f"{c} not supported")
        return ("set", self.cased({self.escaped() if c == "\\" else ord(c)}))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            return int(self.take() + self.take(), 16)
        if c.isalnum():
            raise self.wrong(f"escape {c} not supported")
        return ord(c)

    def members(self) -> frozenset:
        negated = self.peek() == "^"
        self.i += negated
        found, first = set(), True
        while first or self.peek() != "]":
            low = self.take()
            low, first = self.escaped() if low == "\\" else ord(low), False
            high = low
            if self.peek() == "-" and self.s[self.i + 1:self.i + 2] not in ("", "]"):
                self.i += 1
                high = self.take()
                high = self.escaped() if high == "\\" else ord(high)
            found.update(range(low, high + 1))
        self.i += 1
        found = self.cased(found)
        return frozenset(range(128)) - found if negated else found

    def cased(self, found: set) -> frozenset:
        if self.any_case:
            found = found | {ord(c) for b in found if chr(b).isalpha() for c in (chr(b).lower(), chr(b).upper())}
        return frozenset(found)

    def repeated(self, part: tuple) -> tuple:
        m = self.REPEAT.match(self.s, self.i)
        if not m:
            return part
        self.i = m.end()
        if self.REPEAT.match(self.s, self.i):
            raise self.wrong("repeat of a repeat, lazy or possessive,")
        if m[1]:
            return ("repeat", part, int(m[1]), int(m[3]) if m[3] else None if m[2] else int(m[1]))
        return ("repeat", part, int(m[0] == "+"), 1 if m[0] == "?" else None)


def parse(regex: str, any_case: bool = False) -> tuple:
    """Tree of a rule's regex: ``("set", bytes)``, ``("all", parts)``, ``("any", ways)``, ``("repeat", part, low, high)``
    with ``high`` None without bound.

    Known are ASCII characters, ``\\xHH``, escaped marks, classes, groups, ``|`` and greedy repeats. All else is an
    error. A negated class is of ASCII characters only, so that no match begins or ends inside a character of several bytes."""
    reader = _Reader(regex, any_case)
    tree = reader.either()
    if reader.peek():
        raise reader.wrong("closed group")
    return tree


class _Nfa:
    """Thompson automaton: ``moves[s]`` is a list of (byte set, state), ``free[s]`` of states without input."""

    def __init__(self):
        self.moves, self.free = [], []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, tree: tuple, start: int, backwards: bool) -> int:
        """Append the parsed tree after ``start``; the end state."""
        kind, inner, at = tree[0], tree[1], start
        if kind == "set":
            at = self.state()
            self.moves[start].append((inner, at))
        elif kind == "all":
            for part in reversed(inner) if backwards else inner:
                at = self.add(part, at, backwards)
        elif kind == "any":
            at = self.state()
            for way in inner:
                self.free[self.add(way, start, backwards)].append(at)
        else:
            low, high = tree[2:]
            for _ in range(low):
                at = self.add(inner, at, backwards)
            end = self.state()
            self.free[at].append(end)
            if high is None:
                self.free[self.add(inner, end, backwards)].append(end)
            for _ in range((high or low) - low):
                at = self.add(inner, at, backwards)
                self.free[at].append(end)
            at = end
        return at

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass(frozen=True)
class Dfa:
    """``table[state * width + classes[byte]]`` is the next state times ``width``; ``accepts`` has the rules by state.
    States that accept stand last, from ``first``. State 0 is the start; ``dead`` is a state without way out, or -1."""

    classes: bytes
    width: int
    table: list
    accepts: list
    first: int
    dead: int


def _minimise(table: list[list[int]], accepts: list[int]) -> tuple[list[list[int]], list[int]]:
    """Merge states that agree on what they accept and on the blocks of their successors (partition refinement)."""
    block = [sorted(set(accepts)).index(a) for a in accepts]
    while True:
        keys = {}
        new = [keys.setdefault((block[s], *(block[t] for t in table[s])), len(keys)) for s in range(len(table))]
        if len(keys) == len(set(block)):
            break
        block = new
    one = {}
    for s, b in enumerate(new):
        one.setdefault(b, s)
    order = sorted(one, key=lambda b: (accepts[one[b]] != 0, b != new[0], b))  # the start first, accepting ones last
    name = {b: i for i, b in enumerate(order)}
    return [[name[new[t]] for t in table[one[b]]] for b in order], [accepts[one[b]] for b in order]


def compile_rules(rules: Sequence[Rule], backwards: bool = False, anywhere: bool = False) -> Dfa:
    """Subset construction over byte classes, then minimisation. ``anywhere``: a match may begin at any byte."""
    nfa = _Nfa()
    start, ends = nfa.state(), {}
    for k, rule in enumerate(rules):
        ends[nfa.add(parse(rule.regex, rule.any_case), start, backwards)] = 1 << k
    sets = {s for m in nfa.moves for s, _ in m}
    by = defaultdict(list)
    for b in range(256):
        by[tuple(b in s for s in sets)].append(b)
    picks = [group[0] for group in by.values()]
    classes = bytearray(256)
    for i, group in enumerate(by.values()):
        for b in group:
            classes[b] = i
    first = nfa.closure([start])
    states, table, todo = {first: 0}, [], [first]
    while todo:
        row, now = [], todo.pop(0)
        for b in picks:
            to = nfa.closure([t for s in now for bs, t in nfa.moves[s] if b in bs] + ([start] if anywhere else []))
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            row.append(states[to])
        table.append(row)
    accepts = [sum(ends.get(s, 0) for s in x) for x in states]
    if accepts[0]:
        raise ValueError("a rule fits the empty text")
    table, accepts = _minimise(table, accepts)
    width, flat = len(picks), [t * len(picks) for row in table for t in row]
    dead = next((i for i, row in enumerate(table) if not accepts[i] and all(t == i for t in row)), -1)
    n_plain = sum(a == 0 for a in accepts)
    return Dfa(bytes(classes), width, flat, accepts, n_plain * width, dead * width)


class Scanner:
    def __init__(self, rules: Sequence[Rule]):
        self.rules = tuple(rules)
        self.starts = compile_rules(self.rules, backwards=True, anywhere=True)
        self.each = [compile_rules([r]) for r in self.rules]
        self.checks = [re.compile(r.regex.encode(), re.IGNORECASE if r.any_case else 0) for r in self.rules]

    def _marks(self, data: bytes) -> list[tuple[int, int]]:
        """(place, state) wherever a match starts, from the right."""
        table, first, s, found = self.starts.table, self.starts.first, 0, []
        for i, c in enumerate(data.translate(self.starts.classes)[::-1]):
            s = table[s + c]
            if s >= first:
                found.append((i, s))
        n = len(data) - 1
        return [(n - i, s) for i, s in found]

    def _end(self, k: int, data: bytes, at: int) -> int:
        d, s, end = self.each[k], 0, at
        for i in range(at, len(data)):
            s = d.table[s + d.classes[data[i]]]
            if s == d.dead:
                break
            if s >= d.first:
                end = i + 1
        return end

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in code points, by start and then rule."""
        data = text.encode("utf-8", "surrogatepass")
        free, found = [0] * len(self.rules), []
        for at, s in reversed(self._marks(data)):
            bits = self.starts.accepts[s // self.starts.width]
            for k, rule in enumerate(self.rules):
                if bits >> k & 1 and at >= free[k]:
                    free[k] = end = self._end(k, data, at)
                    whole = self.checks[k].fullmatch(data, at, end)
                    if len(whole[rule.group]) >= rule.least:
                        found.append((at, k, end))
        if len(data) != len(text):  # bytes to code points
            place, done, points = {}, 0, 0
            for i in sorted({i for a, _, b in found for i in (a, b)}):
                points += len(data[done:i].decode("utf-8", "surrogatepass"))
                place[i], done = points, i
            found = [(place[a], k, place[b]) for a, k, b in found]
        return sorted(found)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                 rules: Sequence[Rule] = BASE_RULES + MORE_RULES) -> DataFrame:
    """One row per document: id, spans (array of kind, start, end; by start, then rule order)."""
    rules = tuple(rules)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in scanner.spans(t.as_py())]
                    for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=[id_col, "spans"])

    df = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    id_type = df.schema["_id"].dataType.simpleString()
    return df.mapInArrow(scan, f"`{id_col}` {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
           rules: Sequence[Rule] = BASE_RULES + MORE_RULES) -> DataFrame:
    """``docs`` with each span replaced by ``[kind]`` in the text column (overlapping spans by the first kind).

    Other columns, whatever their names, stay as they are; a null text stays null."""
    rules, at = tuple(rules), docs.columns.index(text_col)

    def clean(scanner: Scanner, text: str | None) -> str | None:
        if text is None:
            return None
        out, done = [], 0
        for a, k, b in scanner.spans(text):
            if a >= done:
                out += [text[done:a], f"[{rules[k].kind}]"]
            done = max(done, b)
        return "".join(out) + text[done:] if out else text

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            texts = pa.array([clean(scanner, t.as_py()) for t in batch.column(at)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    return docs.mapInArrow(scan, docs.schema)
