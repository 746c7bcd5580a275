"""Secret scan: fixed patterns, and candidates scored by automata inferred from labelled credentials.

Each labelled kind of credential is put into a prefix tree of character classes. States whose outgoing frequencies
agree within a Hoeffding bound are merged (ALERGIA, Carrasco and Oncina 1994), with their successors, into a
probabilistic automaton. Ordinary strings give a background automaton the same way. A candidate, any long run of
credential characters, is a secret if the best credential automaton explains it better than the background by
`margin` bits a character. The automata are small (a few hundred numbers) and go to the workers with the function.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import batch, map_batches

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more: runs are maximal, so shorter ones hide nothing
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long"

LOWER, UPPER, DIGIT = string.ascii_lowercase, string.ascii_uppercase, string.digits

#: Shapes of labelled credentials: a kind, then (characters, least length, greatest length) one after another.
FORMATS: tuple[tuple[str, tuple[tuple[str, int, int], ...]], ...] = (
    ("cloud key id", ((UPPER + DIGIT, 20, 20),)),
    ("hex digest", (("0123456789abcdef", 32, 64),)),
    ("base64 key", ((LOWER + UPPER + DIGIT + "+/", 40, 64),)),
    ("repository token", (("g", 1, 1), ("h", 1, 1), ("ops", 1, 1), ("_", 1, 1), (LOWER + UPPER + DIGIT, 36, 36))),
    ("payment key", (("s", 1, 1), ("k", 1, 1), ("_", 1, 1), ("live", 4, 4), ("_", 1, 1), (LOWER + UPPER + DIGIT, 24, 32))),
    ("chat token", (("x", 1, 1), ("o", 1, 1), ("x", 1, 1), ("bp", 1, 1), ("-", 1, 1), (DIGIT, 10, 12), ("-", 1, 1), (LOWER + UPPER + DIGIT, 24, 24))),
)
#: Shapes of ordinary strings, in the same form.
ORDINARY: tuple[tuple[str, tuple[tuple[str, int, int], ...]], ...] = (
    ("word", ((LOWER, 12, 40),)),
    ("Word", ((UPPER, 1, 1), (LOWER, 12, 40))),
    ("WORD", ((UPPER, 12, 40),)),
    ("number", ((DIGIT, 12, 24),)),
    ("compound-word", ((LOWER, 4, 16), ("-_/", 1, 1), (LOWER, 4, 16))),
    ("three-part-word", ((LOWER, 3, 10), ("-_/", 1, 1), (LOWER, 3, 10), ("-_/", 1, 1), (LOWER, 3, 10))),
    ("numbered_name", ((LOWER, 6, 20), ("-_/", 1, 1), (DIGIT, 1, 8))),
    ("name99", ((LOWER, 10, 24), (DIGIT, 1, 6))),
    ("date-like", ((DIGIT, 4, 4), ("-/", 1, 1), (DIGIT, 2, 2), ("-/", 1, 1), (DIGIT, 2, 8))),
    ("rule", (("=-_+/", 16, 40),)),
    ("CamelCase", ((UPPER, 1, 1), (LOWER, 3, 10), (UPPER, 1, 1), (LOWER, 3, 10), (UPPER, 1, 1), (LOWER, 3, 10))),
)

_class = {c: k for k, cs in (("d", DIGIT), ("h", "abcdef"), ("l", "ghijklmnopqrstuvwxyz"), ("H", "ABCDEF"), ("L", "GHIJKLMNOPQRSTUVWXYZ")) for c in cs} | {c: c for c in "+/_=-"}
_bits = {"d": math.log2(10), "h": math.log2(6), "l": math.log2(20), "H": math.log2(6), "L": math.log2(20)}
END = "$"


def examples(shapes: tuple, each: int, seed: int = 7) -> list[tuple[str, str]]:
    """(kind, string): `each` labelled strings of each shape."""
    r = random.Random(seed)
    return [(kind, "".join(r.choice(cs) for cs, lo, hi in parts for _ in range(r.randint(lo, hi)))) for kind, parts in shapes for _ in range(each)]


@dataclass
class Automaton:
    """Probabilistic automaton over character classes: a state's successors and log2 probabilities."""

    step: list[dict[str, tuple[int, float]]]
    floor: float

    def bits(self, x: str) -> float:
        """log2 probability of a string; a class that a state has never seen costs `floor` and leads to the start."""
        state, total = 0, 0.0
        for c in x:
            k = _class[c]
            state, p = self.step[state].get(k) or (0, self.floor)
            total += p - _bits.get(k, 0.0)
        return total + (self.step[state].get(END) or (0, self.floor))[1]


def infer(strings: list[str], alpha: float = 0.05) -> Automaton:
    """ALERGIA on the class strings of a sample."""
    count: list[dict[str, int]] = [{}]
    succ: list[dict[str, int]] = [{}]
    for x in strings:
        s = 0
        for c in x:
            k = _class[c]
            count[s][k] = count[s].get(k, 0) + 1
            if k not in succ[s]:
                succ[s][k] = len(succ)
                succ.append({})
                count.append({})
            s = succ[s][k]
        count[s][END] = count[s].get(END, 0) + 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def alike(a: int, b: int) -> bool:
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            n, m = sum(count[a].values()), sum(count[b].values())
            if n and m:
                limit = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
                if any(abs(count[a].get(k, 0) / n - count[b].get(k, 0) / m) > limit for k in count[a].keys() | count[b].keys()):
                    return False
            pairs += [(succ[a][k], succ[b][k]) for k in succ[a].keys() & succ[b].keys()]
        return True

    def fold(a: int, b: int) -> None:
        """Adds the tree below b to the state a."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            for k, n in count[b].items():
                count[a][k] = count[a].get(k, 0) + n
            for k, s in succ[b].items():
                if k in succ[a]:
                    pairs.append((succ[a][k], s))
                else:
                    succ[a][k] = s

    red, blue = [0], [(0, k) for k in sorted(succ[0])]
    while blue:
        parent, k = blue.pop(0)
        state = succ[parent][k]
        if state in red:
            continue
        for r in red:
            if alike(r, state):
                succ[parent][k] = r
                fold(r, state)
                break
        else:
            red.append(state)
        blue = [(r, k) for r in red for k in sorted(succ[r]) if succ[r][k] not in red]
    at = {s: i for i, s in enumerate(red)}
    step = []
    for s in red:
        n = sum(count[s].values())
        step.append({k: (at[succ[s][k]] if k != END else 0, math.log2(c / n)) for k, c in count[s].items()})
    return Automaton(step, -12.0)


@dataclass
class Grammar:
    formats: list[Automaton]
    ordinary: list[Automaton]
    margin: float = 0.35

    def is_secret(self, x: str) -> bool:
        known, usual = (max(a.bits(x) for a in s) for s in (self.formats, self.ordinary))
        return known - usual > self.margin * len(x)


def learn(credentials: list[tuple[str, str]] | None = None, ordinary: list[tuple[str, str]] | None = None, each: int = 60) -> Grammar:
    """One automaton for each kind of labelled strings; by default strings of the shapes above, `each` of a shape."""

    def by_kind(rows: list[tuple[str, str]]) -> list[Automaton]:
        kinds: dict[str, list[str]] = {}
        for kind, x in rows:
            kinds.setdefault(kind, []).append(x)
        return [infer(x) for x in kinds.values()]

    return Grammar(by_kind(credentials or examples(FORMATS, each)), by_kind(ordinary or examples(ORDINARY, each)))


Span = tuple  # (kind, start, end)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns in code points, by start and then by kind."""
    spans = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], s, e) for k, s, e in sorted(spans, key=lambda x: (x[1], x[0]))]


def spans_of(text: str, grammar: Grammar, known: dict[str, bool] | None = None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): the automata add candidates that overlap no base span."""
    base = base_spans(text)
    taken: list[list[int]] = []  # the base spans' union
    for _, s, e in base:
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    added, i = [], 0
    for m in CANDIDATE.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if i < len(taken) and taken[i][0] < m.end():
            continue
        if known is not None and len(known) < 1 << 18:
            secret = known.get(m[0])
            if secret is None:
                secret = known[m[0]] = grammar.is_secret(m[0])
        else:
            secret = grammar.is_secret(m[0])
        if secret:
            added.append(("format", m.start(), m.end()))
    return base, sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, grammar: Grammar | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by kind, a digest of the base spans and all spans of each row's whole text.

    Null and empty texts have no span (an empty string, and the digest of one); ids may be null or repeat, each row is
    scanned by itself; an empty table gives no rows; other columns are not read.
    """
    grammar = grammar or learn()
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                base, spans = spans_of(text or "", grammar, known)
                n = [sum(k == kind for k, _, _ in spans) for kind in KINDS]
                out.append((*n[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n[3]))
            yield batch(names, b.column(0), *(pa.array(list(c)) for c in zip(*out)))

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")), run, SCHEMA)


def redact(docs: DataFrame, grammar: Grammar | None = None, mark: str = "[secret]", text_col: str = "text") -> DataFrame:
    """docs with every span of its texts replaced by a mark (overlapping spans by one); all other columns as they are.

    Null and empty texts stay so. Ids aren't read and may be null or repeat, each row is cleaned by itself; an empty
    table gives no rows; columns of any name are passed on.
    """
    grammar = grammar or learn()

    def clean(text: str | None, known: dict[str, bool]) -> str | None:
        if not text:
            return text
        out, end, at = [], -1, 0
        for _, s, e in sorted(spans_of(text, grammar, known)[1], key=lambda x: (x[1], x[2])):
            if s >= end:
                out += [text[at:s], mark]
            end = at = max(end, e)
        return "".join(out) + text[at:] if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for b in batches:
            i = b.schema.get_field_index(text_col)
            yield b.set_column(i, b.schema.field(i), pa.array([clean(t, known) for t in b.column(i).to_pylist()], b.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)
