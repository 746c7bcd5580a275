"""Hierarchical multi-length packing of documents into training sequences.

Each task packs the documents it reads: no shuffle, and nothing of a document but its unpacked rest is held. Whole
windows of the longest context are cut off first. What is left is routed to the tier of the least context size that
holds it. Each tier is packed, the longest first: a sequence starts with a rest of its own tier, and its gap is filled
from shorter tiers, first by rests that fit, then by cutting one. Rests that fill no sequence end as sequences of a
power of two, which need no padding.

Step groups are balanced over all tasks: the pieces are written, a task's sequences of each length are counted, and from
the counts of the tasks before it each sequence gets its place among all of its length. So every group holds sequences of
one length with the same number of ids; only the last group of a length may hold fewer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import as_bytes, batch, map_batches, materialise
from tessella.llm.tokens import encoder

TIERS = (256, 512, 1024, 2048)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, size long, place long"
#: Rests that a task holds before it packs them; each has fewer ids than the longest context.
PENDING = 8192

Rest = tuple  # (doc_id, start, ids, doc_tokens)


class Packer:
    """Packs one task's documents; sequences are numbered from `first`."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, first: int = 0):
        self.tiers, self.next = sorted(tiers), first
        self.made: dict[int, int] = {}  # sequences by their number of ids
        self.rests: dict[int, list[Rest]] = {t: [] for t in self.tiers}
        self.held = 0
        self.out: list[tuple] = []

    def route(self, rest: Rest) -> None:
        n = len(rest[2]) // 4
        self.rests[next(t for t in self.tiers if n <= t)].append(rest)
        self.held += 1

    def emit(self, pieces: list[Rest], tier: int) -> None:
        size, offset = sum(len(p[2]) // 4 for p in pieces), 0
        place = self.made.get(size, 0)
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc_id, start, n, zlib.crc32(ids), total, self.next, offset, tier, size, place))
            offset += n
        self.made[size] = place + 1
        self.next += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, top = len(ids) // 4, self.tiers[-1]
        for at in range(0, total - total % top, top):
            self.emit([(doc_id, at, ids[4 * at : 4 * (at + top)], total)], top)
        if total % top:
            at = total - total % top
            self.route((doc_id, at, ids[4 * at :], total))
        if self.held >= PENDING:
            self.flush()

    def take(self, gap: int, below: int) -> Rest | None:
        """A rest of at most `gap` ids, of the longest tier that has one on top; else one cut to the gap."""
        tiers = [t for t in reversed(self.tiers) if t <= below and self.rests[t]]
        for t in tiers:
            if len(self.rests[t][-1][2]) // 4 <= gap:
                self.held -= 1
                return self.rests[t].pop()
        if not tiers:
            return None
        doc_id, start, ids, total = self.rests[tiers[0]].pop()
        self.held -= 1
        self.route((doc_id, start + gap, ids[4 * gap :], total))
        return doc_id, start, ids[: 4 * gap], total

    def flush(self) -> None:
        for t in reversed(self.tiers):
            self.rests[t].sort(key=lambda r: len(r[2]))
            while self.rests[t]:
                first = self.rests[t].pop()
                self.held -= 1
                pieces, gap = [first], t - len(first[2]) // 4
                shorter = max([s for s in self.tiers if s < t], default=t)
                while gap and ((more := self.take(gap, shorter)) or (more := self.take(gap, t))):
                    pieces.append(more)
                    gap -= len(more[2]) // 4
                if gap:
                    self.tail(pieces)
                else:
                    self.emit(pieces, t)

    def tail(self, pieces: list[Rest]) -> None:
        """Pieces that fill no sequence: cut into sequences of falling powers of two."""
        left = sum(len(p[2]) // 4 for p in pieces)
        pieces = pieces[::-1]
        while left:
            size = gap = 1 << (left.bit_length() - 1)
            seq = []
            while gap:
                doc_id, start, ids, total = pieces.pop()
                n = min(gap, len(ids) // 4)
                seq.append((doc_id, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    pieces.append((doc_id, start + n, ids[4 * n :], total))
                gap -= n
            self.emit(seq, next(t for t in self.tiers if size <= t))
            left -= size

    def rows(self) -> pa.RecordBatch:
        names = [x.split()[0] for x in PIECES.split(", ")]
        out, self.out = self.out, []
        return batch(names, *(pa.array(list(c), pa.int64()) for c in (zip(*out) if out else [()] * len(names))))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = 32_768, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document: where it begins in the document, its length and the sequence it lies in.

    `offset` is gapless from 0 in each sequence; a sequence has its tier's size in ids, or less where a task's last rests
    end (then a power of two). A null or empty text is a document of its end id alone; ids of rows may be null or
    repeat, each row is packed by itself; an empty table gives no rows. Very long texts are cut into whole windows.
    `step_group` numbers groups of sequences of one length, `step_tokens` ids each but for the last group of a length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        packer = Packer(tiers, first=TaskContext.get().partitionId() << 36)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), as_bytes(b.column(1))
            for doc_id, x in zip(ids, enc.encode(texts)):
                packer.add(doc_id, x + end)
            yield packer.rows()
        packer.flush()
        yield packer.rows()

    pieces = materialise(map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")), run, PIECES), "pieces")
    task = F.shiftright("sequence_id", 36)
    made = pieces.groupBy(task.alias("task"), "size").agg((F.max("place") + 1).alias("n"))
    # one row for each task and length
    before = made.select("task", "size", (F.sum("n").over(Window.partitionBy("size").orderBy("task")) - F.col("n")).alias("before"))
    sizes = pieces.select("size").distinct().select("size", (F.dense_rank().over(Window.orderBy("size")) - 1).cast("long").alias("class"))  # a few lengths
    placed = pieces.withColumn("task", task).join(before, ["task", "size"]).join(F.broadcast(sizes), "size")
    in_group = F.greatest(F.floor(F.lit(step_tokens) / F.col("size")).cast("long"), F.lit(1))  # sequences of a full group
    group = F.shiftleft("class", 40) + F.floor((F.col("before") + F.col("place")) / in_group).cast("long")
    return placed.withColumn("step_group", group).select([x.split()[0] for x in SCHEMA.split(", ")])
