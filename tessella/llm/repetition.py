"""Quality rules on one document at a time, with a suffix array of its words.

Documents are put together into batches, and one suffix array is built for a batch by prefix doubling, in which words
of different documents never compare equal. Only suffixes that still share a rank are sorted again, so ordinary prose
takes two or three rounds. The ranks of each round give the longest common prefix of neighbours. An LCP interval of at
least `min_words` is a maximal repeat; the spans of all repeats are united for the covered fraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import as_bytes, batch, map_batches

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, repeat_words long, longest_repeat long"
WORDS = 1 << 17

_symbol = np.zeros(256, bool)
_symbol[list(b"#*$%&|<>")] = True
_letter = (np.arange(256) & 0xC0) != 0x80  # the first byte of a code point
_letter[[0x20, *range(0x09, 0x0E)]] = False


def longest_repeats(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word, the length in words of the longest run from there that occurs elsewhere in its document."""
    n = len(words)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    end = np.searchsorted(doc, doc, "right")
    key = doc * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    levels, step = [], 1
    shared = ~new
    shared[:-1] |= ~new[1:]
    active = order[shared]
    while len(active):
        levels.append(rank.copy())
        ahead = active + step
        second = np.where(ahead < end[active], rank[np.minimum(ahead, n - 1)], -1)
        by = np.argsort(rank[active] * (n + 1) + second + 1, kind="stable")
        active, second = active[by], second[by]
        old = rank[active]
        starts = np.concatenate(([True], old[1:] != old[:-1]))
        new = starts | np.concatenate(([True], second[1:] != second[:-1]))
        at = np.arange(len(active))
        begin = np.maximum.accumulate(np.where(starts, at, 0))
        rank[active] = old + np.maximum.accumulate(np.where(new, at, 0)) - begin
        alone = new & np.concatenate((new[1:], [True]))
        active = active[~alone]
        step *= 2
    if not levels:
        return best
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1], order[1:]
    near = levels[0][a] == levels[0][b]
    a, b = a[near], b[near]
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        inside = (x < end[a]) & (y < end[b])
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        # a rank that is equal because both runs end with the document can't occur: their lengths differ
        lcp += np.where(same, 1 << k, 0)
    np.maximum.at(best, a, lcp)
    np.maximum.at(best, b, lcp)
    return best


def covered(best: np.ndarray, least: int) -> np.ndarray:
    """Words inside a repeat of at least `least` words; for a fixed length, pass best clipped to it."""
    n = len(best)
    at = np.flatnonzero(best >= least)
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, at, 1)
    np.add.at(d, at + best[at], -1)
    return np.cumsum(d[:-1]) > 0


def measure(texts: list[bytes | None], min_words: int) -> list[tuple[int, ...]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words in repeats, longest repeat) of each text."""
    base, ids, sizes = [], [], []
    for t in texts:
        t = t or b""
        raw = np.frombuffer(t, np.uint8)
        lines = [x for x in t.split(b"\n") if x.strip()]
        words, seen = t.split(), {}
        base.append((len(words), int(_letter[raw].sum()), int(_symbol[raw].sum()), len(lines) - len(set(lines))))
        ids.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)))
        sizes.append(len(words))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    best = longest_repeats(np.concatenate(ids) if ids else np.zeros(0, np.int64), doc)
    sums = lambda mask: np.bincount(doc[mask], minlength=len(sizes))
    windows, repeats = sums(covered(np.minimum(best, 3), 3)), sums(covered(best, min_words))
    longest = np.zeros(len(sizes), np.int64)
    np.maximum.at(longest, doc, best)
    return [(*b, int(w), int(r), int(x)) for b, w, r, x in zip(base, windows, repeats, longest)]


def quality(docs: DataFrame, min_words: int = 8, max_covered: float = 0.4, max_longest: float = 0.2, long_words: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, the base rules' verdict and the repetition verdict for each row.

    `kept` is false if a base rule fails, if repeats of at least `min_words` words cover more than `max_covered` of
    the words, or if the longest repeat has more than `long_words` words and more than `max_longest` of all. Null and
    empty texts have all counts 0 and fail the base rules; ids may be null or repeat; an empty table gives no rows.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, i = b.column(0).to_pylist(), as_bytes(b.column(1)), 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or b"") <= 8 * WORDS):
                    size += len(texts[j] or b"")
                    j += 1
                rows = []
                for doc_id, (n, chars, symbols, lines, again, repeats, longest) in zip(ids[i:j], measure(texts[i:j], min_words)):
                    failed = n < 50 or 100 * again > 50 * n
                    kept = not failed and repeats <= max_covered * n and not (longest > long_words and longest > max_longest * n)
                    rows.append((doc_id, n, chars, symbols, lines, again, failed, kept, repeats, longest))
                yield batch(names, *(pa.array(list(c), pa.bool_() if k in ("base_failed", "kept") else pa.int64()) for k, c in zip(names, zip(*rows))))
                i = j

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")), run, SCHEMA)
