"""Removal of repeated substrings by prefix-free parsing and suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts earlier in the corpus. Trigger positions come from
a rolling hash: the position whose word of 8 bytes has the least hash among `length - anchor + 1` neighbours. Each
string of `length` bytes thus has exactly one trigger that depends on its own bytes alone, followed by at least
`anchor` bytes inside it. A phrase is the text of all strings between two changes of trigger; it ends where the last
such string ends, so neighbouring phrases overlap and no string is lost at their borders.

1. Parse: one Arrow pass over the texts gives rows (anchor hash, phrase hash, place). Phrases met before in the same
   task are settled there, so a phrase in a third of all documents leaves one row a task.
2. The parse's order: rows meet by anchor. An anchor met once is dropped: none of its strings can repeat. Of the
   places of one phrase the first stays, all others are removed whole. The distinct phrases of an anchor are the
   dictionary entries whose strings may still be shared in part.
3. The dictionary's order: these entries' bytes are fetched, and two suffix arrays are built for blocks of them, one of
   what follows the trigger and one, backwards, of what precedes it. A string that starts o bytes before its trigger is
   the o bytes before it and `length - o` bytes behind it; equal classes in both arrays are equal strings. The first
   place of each keeps its bytes.
4. Spans to remove are united for each document.

A dictionary group that exceeds one block is compared block by block, and the blocks' first places by a further
shuffle, so no task ever holds an unbounded group. Texts are shuffled once, by document, for steps 3 and 4 together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import as_bytes, batch, group_starts, map_batches, materialise, ordered_ids

LENGTH, ANCHOR = 100, 40
#: Phrases that a task compares by itself before it sends rows on; entries of one dictionary block.
PHRASES, BLOCK = 1 << 19, 4096
#: Bytes that are parsed at once; longer texts are parsed piece by piece.
PIECE = 1 << 22

_hash = xxhash.xxh64_intdigest


def triggers(a: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> np.ndarray:
    """For each string of `length` bytes of an array, by its start: the position of its trigger."""
    n, width = len(a), length - anchor + 1
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([a, np.zeros(7, np.uint8)]), 8)[: n - anchor + 1]
    v = np.ascontiguousarray(words).view("<u8").ravel()
    v = (v ^ (v >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    v = (v ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(v), dtype=np.uint64)  # the first of equal hashes wins
    size = 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    if width > size:
        v = np.minimum(v[: len(v) - (width - size)], v[width - size :])
    return (v & np.uint64(0xFFFFFFFF)).astype(np.int64)


def phrases(text: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first start, last start, trigger) of the phrases of a text; each start lies in one phrase."""
    n = len(text) - length + 1
    for at in range(0, max(0, n), PIECE):
        t = triggers(np.frombuffer(text, np.uint8)[at : at + PIECE + length - 1], length, anchor)
        low = np.concatenate(([0], np.flatnonzero(t[1:] != t[:-1]) + 1))
        high = np.concatenate((low[1:] - 1, [len(t) - 1]))
        yield low + at, high + at, t[low] + at


def signed(x: list[int] | np.ndarray) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def united(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of a set of spans; spans that touch are one run."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    at = np.flatnonzero(new)
    return list(zip(start[at].tolist(), end[np.concatenate((at[1:] - 1, [len(end) - 1]))].tolist()))


PARSE = "anchor long, phrase long, ord long, low long, span int, done boolean"


def parse(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """Rows of PARSE: a phrase's first place in a task, or, if done, a span of starts whose strings are all repeats."""
    names = [x.split()[0] for x in PARSE.split(", ")]

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        a, p, o, low, span = (np.concatenate(c) for c in zip(*rows))
        order = np.lexsort((low, o, p, a))
        first = np.zeros(len(a), bool)
        first[order] = np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (p[order][1:] != p[order][:-1])))
        yield batch(names, a[first], p[first], o[first], low[first], span[first].astype(np.int32), np.zeros(int(first.sum()), bool))
        again = np.flatnonzero(~first)
        if not len(again):
            return
        again = again[np.lexsort((low[again], o[again]))]  # neighbouring repeats of a document become one row
        o, low, high = o[again], low[again], (low + span)[again]
        new = np.concatenate(([True], (o[1:] != o[:-1]) | (low[1:] != high[:-1] + 1)))
        at = np.flatnonzero(new)
        until = high[np.concatenate((at[1:] - 1, [len(o) - 1]))]
        for i in range(0, len(at), 1 << 16):
            s = slice(i, i + (1 << 16))
            # done rows go anywhere: the place spreads them
            yield batch(names, o[at[s]] ^ (low[at[s]] << 40), low[at[s]], o[at[s]], low[at[s]], (until - low[at])[s].astype(np.int32), np.ones(len(at[s]), bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for o, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1))):
                for low, high, trigger in phrases(text or b"", length, anchor):
                    anchors = signed([_hash(text[t : t + anchor]) for t in trigger.tolist()])
                    whole = signed([_hash(text[x:y], 1) for x, y in zip(low.tolist(), (high + length).tolist())])
                    rows.append((anchors, whole, np.full(len(low), o, np.int64), low, high - low))
                    held += len(low)
                    if held >= PHRASES:
                        yield from settle(rows)
                        rows, held = [], 0
        yield from settle(rows)

    return map_batches(docs.select("ord", "text"), run, PARSE)


MEET = "ord long, low long, span int, anchor long, block int, alone boolean"


def meet(rows: DataFrame, most: int = BLOCK) -> DataFrame:
    """Rows of MEET. Without an anchor: starts whose strings are all repeats. With one: a dictionary entry to compare."""
    names = [x.split()[0] for x in MEET.split(", ")]

    def spans(o: np.ndarray, low: np.ndarray, span: np.ndarray) -> pa.RecordBatch:
        nulls = pa.nulls(len(o), pa.int64())
        return batch(names, o, low, span, nulls, pa.nulls(len(o), pa.int32()), pa.nulls(len(o), pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by (anchor, phrase, ord, low): of one anchor, at most a block of dictionary entries is held
        held: list[np.ndarray] = []
        last, last_phrase, blocks = None, None, 0

        def entries(closed: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, blocks
            if held and (len(held) > 1 or blocks):
                o, low, span = (np.array(x) for x in zip(*held))
                alone = closed and not blocks
                n = len(held)
                yield batch(names, o, low, span.astype(np.int32), np.full(n, last, np.int64), np.full(n, blocks, np.int32), np.full(n, alone))
            held, blocks = [], 0 if closed else blocks + 1

        for b in batches:
            a, p, o, low, span, done = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            if done.any():
                yield spans(o[done], low[done], span[done])
                a, p, o, low, span = (x[~done] for x in (a, p, o, low, span))
            if not len(a):
                continue
            same = np.concatenate(([last is not None and a[0] == last], a[1:] == a[:-1]))
            again = same & np.concatenate(([last_phrase is not None and p[0] == last_phrase], p[1:] == p[:-1]))
            if again.any():
                yield spans(o[again], low[again], span[again])
            first = np.flatnonzero(~again)
            # an entry alone with its anchor inside this batch needs no further look
            fa = a[first]
            dull = np.zeros(len(first), bool)
            if len(first) > 2:
                dull[1:-1] = (fa[1:-1] != fa[:-2]) & (fa[1:-1] != fa[2:])
            for i, key in zip(first[~dull].tolist(), fa[~dull].tolist()):
                if key != last:
                    yield from entries(True)
                    last = key
                elif len(held) >= most:
                    yield from entries(False)
                held.append((int(o[i]), int(low[i]), int(span[i])))
            if dull.any() and a[-1] != last:
                yield from entries(True)
            last, last_phrase = int(a[-1]), int(p[-1])
        yield from entries(True)

    return map_batches(rows.repartition("anchor").sortWithinPartitions("anchor", "phrase", "ord", "low"), run, MEET)


FETCHED = "anchor long, block int, alone boolean, ord long, low long, trigger int, bytes binary"


def fetch(texts: DataFrame, wanted: DataFrame, length: int, anchor: int) -> DataFrame:
    """The bytes of dictionary entries, from the texts; `trigger` counts from the entry's first byte."""
    names = [x.split()[0] for x in FETCHED.split(", ")]
    asked = wanted.groupBy("ord").agg(F.collect_list(F.struct("anchor", "block", "alone", "low", "span")).alias("asked"))  # at most one text's phrases

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for o, text, rows in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2)):
                if not rows.is_valid:
                    continue
                c = rows.values
                key, block, alone, low, span = (c.field(i) for i in range(5))
                at, n = low.to_numpy(), span.to_numpy()
                parts = [text[x : x + s + length] for x, s in zip(at.tolist(), n.tolist())]
                where = [int(triggers(np.frombuffer(x[:length], np.uint8), length, anchor)[0]) for x in parts]
                for i in range(0, len(parts), 1 << 15):
                    s = slice(i, i + (1 << 15))
                    yield batch(names, key[s], block[s], alone[s], np.full(len(parts[s]), o, np.int64), low[s], pa.array(where[s], pa.int32()), pa.array(parts[s], pa.binary()))

    return map_batches(texts.join(asked, "ord", "left").select("ord", "text", "asked"), run, FETCHED)


def classes(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the rows of a byte matrix inside their groups, and the common prefix with the row before."""
    pad = -rows.shape[1] % 8
    keys = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view(">u8").astype(np.uint64)
    order = np.lexsort((*keys.T[::-1], group))
    s, g = rows[order], group[order]
    differ = s[1:] != s[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return order, np.concatenate(([-1], np.where(g[1:] == g[:-1], lcp, -1)))


def shared(group: np.ndarray, trigger: np.ndarray, size: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of equal strings of dictionary entries, entries in corpus order.

    Returns (entry, start in the entry, number of the class) of every string whose class has more than one member.
    """
    n, before, after = len(texts), int(trigger.max()), int((size - trigger).max())
    joined = np.frombuffer(b"".join(texts), np.uint8)
    base = np.cumsum(size) - size
    col = np.arange(after)
    right = np.where(col < (size - trigger)[:, None], joined[np.minimum((base + trigger)[:, None] + col, len(joined) - 1)], 0)
    col = np.arange(max(1, before))
    left = np.where(col < trigger[:, None], joined[np.maximum((base + trigger)[:, None] - 1 - col, 0)], 0)
    (ro, rl), (lo, ll) = classes(right.astype(np.uint8), group), classes(left.astype(np.uint8), group)
    entry, start, number, total = [], [], [], 0
    rank_r, rank_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(before + 1):
        has = np.flatnonzero((trigger >= o) & (trigger - o + length <= size))
        if len(has) < 2:
            continue
        rank_r[ro] = np.cumsum(rl < length - o)
        rank_l[lo] = np.cumsum(ll < o)
        _, inverse, count = np.unique(rank_l[has] * (n + 1) + rank_r[has], return_inverse=True, return_counts=True)
        many = count[inverse] > 1
        entry.append(has[many])
        start.append(trigger[has[many]] - o)
        number.append(inverse[many] + total)
        total += len(count)
    return (np.concatenate(entry), np.concatenate(start), np.concatenate(number)) if entry else (np.zeros(0, np.int64),) * 3


COMPARED = "ord long, low long, span int, string binary"


def compare(entries: DataFrame, length: int) -> DataFrame:
    """Rows of COMPARED: runs of starts that repeat; or, of a group in several blocks, a block's first place of a string."""
    names = [x.split()[0] for x in COMPARED.split(", ")]

    def settle(cols: list[list]) -> Iterator[pa.RecordBatch]:
        key, block, alone, o, low, trigger, texts = cols
        o, low, alone = np.array(o, np.int64), np.array(low, np.int64), np.array(alone, bool)
        order = np.lexsort((low, o))
        texts = [texts[i] for i in order.tolist()]
        key, block, trigger = (np.array(x, np.int64)[order] for x in (key, block, trigger))
        o, low, alone = o[order], low[order], alone[order]
        group = np.unique(np.stack([key, block]), axis=1, return_inverse=True)[1].ravel()
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        entry, start, number = shared(group, trigger, size, texts, length)
        by = np.lexsort((start, entry, number))
        entry, start, number = entry[by], start[by], number[by]
        lead = np.zeros(len(entry), bool)
        lead[group_starts(number)] = True
        e, s = entry[~lead], start[~lead]
        by = np.lexsort((s, e))
        e, s = e[by], s[by]
        if len(e):
            new = np.concatenate(([True], (e[1:] != e[:-1]) | (s[1:] != s[:-1] + 1)))
            at = np.flatnonzero(new)
            until = s[np.concatenate((at[1:] - 1, [len(s) - 1]))]
            yield batch(names, o[e[at]], low[e[at]] + s[at], (until - s[at]).astype(np.int32), pa.nulls(len(at), pa.binary()))
        # a group in several blocks: strings that are new to this block meet the other blocks' strings by their hash
        repeated = set(zip(entry[~lead].tolist(), start[~lead].tolist()))
        for i in np.flatnonzero(~alone).tolist():
            x = texts[i]
            at = [p for p in range(len(x) - length + 1) if (i, p) not in repeated]
            yield batch(names, np.full(len(at), o[i]), low[i] + np.array(at, np.int64), np.zeros(len(at), np.int32), pa.array([xxhash.xxh3_128_digest(x[p : p + length]) for p in at], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in range(7)]
        for b in batches:
            for c, x in zip(cols, b.columns):
                c += x.to_pylist()
            if len(cols[0]) >= 4 * BLOCK:
                last = (cols[0][-1], cols[1][-1])  # the last group may go on; it has at most a block of rows
                n = next((i for i in range(len(cols[0]), 0, -1) if (cols[0][i - 1], cols[1][i - 1]) != last), 0)
                if n:
                    yield from settle([c[:n] for c in cols])
                    cols = [c[n:] for c in cols]
        if cols[0]:
            yield from settle(cols)

    return map_batches(entries.repartition("anchor", "block").sortWithinPartitions("anchor", "block"), run, COMPARED)


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows (ord, doc_id, text) dealt by document, rows (ord, low, span): starts low to low + span are repeats)."""
    rows, _ = ordered_ids(docs)
    texts = rows.repartition("ord")
    met = materialise(meet(parse(rows, length, anchor), block), "phrases")
    fetched = fetch(texts.select("ord", "text"), met.filter("anchor is not null").select("ord", "low", "span", "anchor", "block", "alone"), length, anchor)
    compared = materialise(compare(fetched, length), "strings")
    strings = compared.filter("string is not null").select("string", F.struct("ord", "low").alias("place"))
    least = strings.groupBy("string").agg(F.min("place").alias("first"))
    later = strings.join(least, "string").filter("place > first").select("place.ord", "place.low", F.lit(0).alias("span"))
    return texts, met.filter("anchor is null").select("ord", "low", "span").union(compared.filter("string is null").select("ord", "low", "span")).union(later)


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def deduplicate(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: bytes, removed bytes, maximal removed runs, and the digest of what is left.

    Documents are ordered by doc_id; a null id comes first, rows with the same id are ordered by text, and of identical
    rows one counts as the earlier. A null text is empty. Texts of fewer than `length` bytes lose nothing. An empty
    table gives no rows.
    """
    texts, spans = repeats(docs, length, anchor, block)
    starts = spans.groupBy("ord").agg(F.collect_list(F.struct("low", "span")).alias("spans"))  # at most one text's spans
    names = [x.split()[0] for x in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, s in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2)):
                text, runs = text or b"", []
                if s.is_valid:
                    low, span = (s.values.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                    runs = united(low, low + span + length)
                digest, at = hashlib.sha256(), 0
                for x, y in runs:
                    digest.update(text[at:x])
                    at = y
                digest.update(text[at:])
                out.append((doc_id, len(text), sum(y - x for x, y in runs), len(runs), digest.hexdigest()))
            yield batch(names, *(pa.array(list(c), pa.string() if k == "kept_sha256" else pa.int64()) for k, c in zip(names, zip(*out))))

    return map_batches(texts.join(starts, "ord", "left").select("doc_id", "text", "spans"), run, OUT)
