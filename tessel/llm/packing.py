"""Vector best-fit packing of token sequences (operator 9).

Bins have capacities of tokens, documents and attention cost (the sum of squared lengths). Items that share a length
share all three demands, so the packing is planned on counts of lengths, which are at most as many as the sequence
length, whatever the corpus: for each length, from the longest, the bins of one residual vector are filled together,
as one item after the other would fill them.
Pieces then find their place from their rank among pieces of their length; ranks come from counts by file and length,
so no text and no group of pieces is gathered anywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import prepare, written
from .tokens import ByteBpe


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = "norm"

    def caps(self) -> np.ndarray:
        docs = self.documents if self.documents is not None else self.tokens
        cost = self.attention if self.attention is not None else self.tokens**2
        return np.array([self.tokens, docs, cost], np.int64)


def plan(counts: dict[int, int], limits: Limits) -> tuple[list[tuple], int]:
    """Best-fit decreasing over length classes.

    Returns runs ``(length, rank_lo, rank_hi, first_bin, offset)``: pieces of a length with ranks lo..hi-1 go to
    consecutive bins at an offset; and the number of bins. Of the bins that satisfy every constraint the rule takes the
    one with the least weighted residual norm after placement, or the greatest weighted dot product of demand and
    residual; ties go to the fuller bin. Raises ValueError for an item that no empty bin can hold.

    This is what one item after the other would get: by the norm, a bin that was best for an item is better still for
    the next of its length, as long as that fits, so bins of one residual are filled in turn; by the dot product it
    is worse, so each bin of a residual gets one.
    """
    caps = limits.caps()
    cap = caps.astype(float)
    w = np.array(limits.weights, float)
    open_: dict[tuple[int, int, int], list[list[int]]] = {}  # residual vector -> runs [first bin, bins]
    runs: list[tuple] = []
    bins = 0

    def keep(residual: np.ndarray, first: int, n: int) -> None:
        if n and residual[0] > 0 and residual[1] > 0:
            open_.setdefault(tuple(residual.tolist()), []).append([first, n])

    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length * length], np.int64)
        if np.any(need > caps):
            raise ValueError(f"a piece of {length} tokens exceeds an empty bin")
        left, rank = counts[length], 0
        while left:
            keys = np.array(list(open_), np.int64).reshape(-1, 3)
            fits = keys[(keys >= need).all(axis=1)]
            if len(fits):
                if limits.rule == "dot":
                    value = -((fits / cap) * (need / cap) * w).sum(axis=1)
                else:
                    value = (((fits - need) / cap) ** 2 * w).sum(axis=1)
                best = fits[np.lexsort((fits[:, 1], fits[:, 0], np.round(value, 12)))[0]]
                of = open_[tuple(best.tolist())]
                first, n = of.pop()
                if not of:
                    del open_[tuple(best.tolist())]
            else:
                best, first, n = caps, bins, 1 if limits.rule == "dot" else -(-left // int(min(caps // need)))
                bins += n
            per = 1 if limits.rule == "dot" else int(min(best // need))
            full = min(n, left // per)
            for groups, each in ((full, per), (int(n > full and left > full * per), left - full * per)):
                if not groups:
                    continue
                for k in range(each):
                    runs.append((length, rank, rank + groups, first, int(limits.tokens - best[0]) + k * length))
                    rank += groups
                keep(best - each * need, first, groups)
                left, first, n = left - groups * each, first + groups, n - groups
            keep(best, first, n)
    return runs, bins


def pieces_of(ids: bytes, size: int) -> list[tuple[int, int, int]]:
    """(start, length, crc) of the pieces of a document; the first is the shorter one."""
    n = len(ids) // 4
    head = n % size or min(n, size)
    cuts = [0, *range(head, n + 1, size)]
    return [(s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for s, e in zip(cuts, cuts[1:])]


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut each document's ids (and ``end_id`` after them) into pieces, numbered within file and length."""
    prepare(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe = ByteBpe(tokenizer)
        seen = np.zeros(size + 1, np.int64)
        part = TaskContext.get().partitionId()
        for b in batches:
            rows, of = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                for i, (s, n, crc) in enumerate(pieces_of(bpe.ids(t or "") + end, size)):
                    rows.append((i, s, n, crc, seen[n]))
                    of.append(k)
                    seen[n] += 1
            piece, start, length, crc, nth = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.record_batch(
                [b.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(of), part, np.int64)), pa.array(nth)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part long, nth long")


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document into few sequences.

    Returns a row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A null text is an empty
    one: only the end id. Documents longer than ``limits.tokens`` are cut, the first piece being the shorter. Repeated
    rows are packed each; an empty table gives no rows. Lengths are at most ``limits.tokens`` many, and only their
    counts reach the driver.
    """
    pieces = written(token_pieces(docs, tokenizer, limits.tokens, end_id, id_col, text_col), "pieces")
    by_file = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    by_file = written(by_file, "piece-counts")
    counts = {r["length"]: r["n"] for r in by_file.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(counts, limits)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(_by_length(runs))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_file.select(F.col("part").alias("p"), F.col("length").alias("l"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base.hint("merge"), (F.col("part") == F.col("p")) & (F.col("length") == F.col("l"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for b in batches:
            length = b.column(3).to_numpy(zero_copy_only=False)
            rank = b.column(5).to_numpy(zero_copy_only=False)
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length).tolist():
                at = length == n
                lo, first, offset = table[n]
                k = np.searchsorted(lo, rank[at], side="right") - 1
                seq[at] = first[k] + rank[at] - lo[k]
                off[at] = offset[k]
            yield pa.record_batch([*b.columns[:5], pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _by_length(runs: list[tuple]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out: dict[int, list] = {}
    for n, lo, _, first, offset in runs:
        out.setdefault(n, []).append((lo, first, offset))
    return {n: tuple(np.array(x, np.int64) for x in zip(*v)) for n, v in out.items()}
