"""Document likelihood over all segmentations into the pieces of an existing vocabulary.

Texts are dealt to blocks of bounded size by a hash of their id. Each block sends its distinct words once, compressed
and split by word bucket; a bucket adds up a word's counts over all blocks and sends counts and likelihoods back. So
what moves is a block's vocabulary rather than its tokens, and a word in every document costs one entry a block.

A word's likelihood is the sum over all ways to cut it into vocabulary pieces (the word begins with the piece mark, as
the tokenizer has it) of the product of the pieces' probabilities: a forward recursion in log space over the lattice
of matching pieces; a character that is no piece by itself goes through its bytes' pieces. Pieces' probabilities are
their smoothed shares in the training words, each cut as the tokenizer cuts it; or, for a unigram model's file, the file's own
scores (`file_scores`). The document's end is a piece, too.

There are far fewer word buckets than blocks, so that the messages from blocks to buckets stay long as the corpus grows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import as_bytes, batch, map_batches, materialise, text_bytes

#: Bytes of text in a block.
BLOCK_BYTES = 24 << 20
MARK = "▁"
END, TYPES, DOCS = -1, -2, -3  # rows of the summary besides the pieces'


def tokens(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


class Lattice:
    """log probabilities of words under a vocabulary with a log probability for each piece."""

    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: list[float]):
        self.known: dict[str, float | None] = {}
        for p, _ in pieces:
            for i in range(1, len(p)):
                self.known.setdefault(p[:i], None)  # only the beginning of a piece
        self.known.update(pieces)
        self.bytes = byte_pieces

    def word(self, word: str) -> float:
        s, get, exp, log = MARK + word, self.known.get, math.exp, math.log
        n = len(s)
        into: list[list[float]] = [[] for _ in range(n + 1)]
        a = 0.0
        for i in range(n):
            if i:
                terms = into[i]
                top = max(terms)
                a = top + log(sum([exp(t - top) for t in terms])) if len(terms) > 1 else top
                into[i] = ()
            j, whole = i + 1, False
            while j <= n and (p := get(s[i:j], 0)) != 0:
                if p is not None:
                    into[j].append(a + p)
                    whole |= j == i + 1
                j += 1
            if not whole:
                into[i + 1].append(a + sum(self.bytes[x] for x in s[i].encode("utf-8", "replace")))
        top = max(into[n])
        return top + log(sum(exp(t - top) for t in into[n]))


def pieces_of(path: str) -> tuple[list[tuple[int, str]], list[int], object]:
    """(id, text) of the ordinary pieces of a sentencepiece model, the ids of its 256 byte pieces, and the model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(sp.get_piece_size())
    ordinary = [(i, sp.id_to_piece(i)) for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    return ordinary, [sp.piece_to_id(f"<0x{x:02X}>") for x in range(256)], sp


@dataclass
class Model:
    counts: dict[int, int]  # training counts by piece id
    tokens: int  # training tokens, ends included
    types: int  # their distinct ones
    docs: int  # training documents
    size: int  # pieces of the vocabulary, the end included

    def log_p(self, piece: int) -> float:
        return math.log((self.counts.get(piece, 0) + 1) / (sum(self.counts.values()) + self.docs + self.size))

    def lattice(self, path: str, file_scores: bool = False) -> Lattice:
        ordinary, byte_ids, sp = pieces_of(path)
        if file_scores:
            return Lattice([(p, sp.get_score(i)) for i, p in ordinary], [sp.get_score(i) for i in byte_ids])
        total = math.log(sum(self.counts.values()) + self.docs + self.size)
        of = lambda i: math.log(self.counts.get(i, 0) + 1) - total
        return Lattice([(p, of(i)) for i, p in ordinary], [of(i) for i in byte_ids])

    def log_end(self) -> float:
        return math.log((self.docs + 1) / (sum(self.counts.values()) + self.docs + self.size))


def pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(3).compress(b"\n".join(words))


def unpack_words(x: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(x).split(b"\n")


def pack_numbers(x: object, kind: str) -> bytes:
    return zstandard.ZstdCompressor(3).compress(np.asarray(x, kind).tobytes())


def unpack_numbers(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def by_block(docs: DataFrame, held_out: Column, blocks: int, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.when(F.col(id_col).isNull(), text)), F.lit(blocks)).alias("block"))


def buckets_for(blocks: int) -> int:
    """Word buckets for so many blocks: distinct words grow as about the root of the text, and so do buckets."""
    return math.ceil(8 * math.sqrt(blocks))


def vocabularies(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, words, counts): each block's distinct words with their training counts, by word bucket."""

    def run(key: tuple, block: pa.Table) -> pa.Table:
        counts: Counter = Counter()
        docs = 0
        for b in block.select(["text", "held_out"]).to_batches():
            for text, out in zip(as_bytes(b.column(0)), b.column(1).to_pylist()):
                words = tokens(text)
                if out:
                    counts.update(dict.fromkeys(words, 0))
                else:
                    counts.update(words)
                    docs += 1
        parts: list[list[bytes]] = [[] for _ in range(buckets)]
        for w in counts:
            parts[xxhash.xxh32_intdigest(w) % buckets].append(w)
        full = [(i, sorted(p)) for i, p in enumerate(parts) if p]
        out = [(i, pack_words(p), pack_numbers([counts[w] for w in p], "<i8")) for i, p in full]
        out.append((DOCS, b"", pack_numbers([docs], "<i8")))
        return pa.table({"bucket": pa.array([o[0] for o in out], pa.int64()), "block": pa.array([key[0].as_py()] * len(out), pa.int64()), "words": pa.array([o[1] for o in out], pa.binary()), "counts": pa.array([o[2] for o in out], pa.binary())})

    return rows.groupBy("block").applyInArrow(run, "bucket long, block long, words binary, counts binary")


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[bytes, int], list[tuple[int, bytes]]]]:
    """For each bucket of batches sorted by bucket: the words' counts over all blocks, and the blocks' words."""
    last, counts, blocks = None, {}, []
    for b in batches:
        for bucket, block, words, n in zip(*(b.column(i).to_pylist() for i in range(4))):
            if bucket != last:
                if blocks:
                    yield counts, blocks
                last, counts, blocks = bucket, {}, []
            for w, c in zip(unpack_words(words), unpack_numbers(n, "<i8").tolist()):
                counts[w] = counts.get(w, 0) + c
            blocks.append((block, words))
    if blocks:
        yield counts, blocks


def train(vocab: DataFrame, path: str) -> Model:
    """Sums over all blocks: at most one row for each piece of the vocabulary reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, sp = pieces_of(path)
        pieces: Counter = Counter()
        for counts, _ in merged(batches):
            words = [(w, c) for w, c in counts.items() if c]
            pieces[END] += sum(c for _, c in words)
            pieces[TYPES] += len(words)
            for i in range(0, len(words), 4096):
                part = words[i : i + 4096]
                for ids, (_, c) in zip(sp.encode([w.decode("utf-8", "replace") for w, _ in part], num_threads=1), part):
                    for x in ids:
                        pieces[x] += c
        yield batch(["id", "n"], pa.array(list(pieces), pa.int64()), pa.array(list(pieces.values()), pa.int64()))

    words = vocab.filter(F.col("bucket") >= 0)
    dealt = words.repartition("bucket").sortWithinPartitions("bucket", "block")
    sums = {r["id"]: r["n"] for r in map_batches(dealt, run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}

    def docs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(["n"], pa.array([int(unpack_numbers(x, "<i8")[0]) for x in b.column(0).to_pylist()], pa.int64()))

    docs = map_batches(vocab.filter(F.col("bucket") == DOCS).select("counts"), docs_of, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    _, _, sp = pieces_of(path)
    n, types = sums.pop(END, 0), sums.pop(TYPES, 0)
    return Model(sums, n + docs, types + (docs > 0), docs, sp.get_piece_size() + 1)


def answers(vocab: DataFrame, model: Model, path: str, file_scores: bool = False) -> DataFrame:
    """(block, words, counts, logs): the blocks' words with their counts in all training texts and their likelihoods."""
    shared = vocab.sparkSession.sparkContext.broadcast(model)  # one number for each piece of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = shared.value.lattice(path, file_scores)
        for counts, blocks in merged(batches):
            logs = {w: lattice.word(w.decode("utf-8", "replace")) for w in counts}
            for block, packed in blocks:
                words = unpack_words(packed)
                yield batch(["block", "words", "counts", "logs"], [block], pa.array([packed], pa.binary()), pa.array([pack_numbers([counts[w] for w in words], "<i8")], pa.binary()), pa.array([pack_numbers([logs[w] for w in words], "<f8")], pa.binary()))

    dealt = vocab.filter(F.col("bucket") >= 0).repartition("bucket").sortWithinPartitions("bucket", "block")
    return map_batches(dealt, run, "block long, words binary, counts binary, logs binary")


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held_out: Column, path: str, block_bytes: int = BLOCK_BYTES, file_scores: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts, the smoothed word score and the lattice's log10 probability of each row's whole text.

    Rows that aren't held out train both. A null text is empty: its end is its only token. A null id counts as not held
    out; repeated rows train and are returned as often as given; without training rows all counts are 0; an empty table
    gives no rows. Words of any length are scored whole.
    """
    blocks = max(1, math.ceil(text_bytes(docs, text_col) / block_bytes))
    rows = by_block(docs, held_out, blocks, id_col, text_col)
    vocab = materialise(vocabularies(rows, buckets_for(blocks)), "vocabularies")
    model = train(vocab, path)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    known_end, total, end = model.docs, model.tokens, model.log_end()
    divisor = total + model.types + 1

    def run(block: pa.Table, replies: pa.Table) -> pa.Table:
        base, logs, known = {}, {}, {}
        for words, counts, log in zip(*(replies.column(c).to_pylist() for c in ("words", "counts", "logs"))):
            words, counts = unpack_words(words), unpack_numbers(counts, "<i8")
            base.update(zip(words, np.log10((counts + 1) / divisor).tolist()))
            known.update(zip(words, (counts > 0).tolist()))
            logs.update(zip(words, unpack_numbers(log, "<f8").tolist()))
        out = []
        for b in block.select(["doc_id", "held_out", "text"]).to_batches():
            for doc_id, held, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2))):
                words = tokens(text)
                low = math.fsum([base[w] for w in words] + [math.log10((known_end + 1) / divisor)])
                likelihood = math.fsum([logs[w] for w in words] + [end]) / math.log(10)
                out.append((doc_id, held, len(words) + 1, sum([known[w] for w in words]) + (known_end > 0), total, low, likelihood))
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [()] * 7, kinds)], names=names)

    return rows.groupBy("block").cogroup(answers(vocab, model, path, file_scores).groupBy("block")).applyInArrow(run, SCHEMA)
