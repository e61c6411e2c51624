"""SimHash near-duplicates by multi-index hashing (operator 8).

Fingerprints are cut into two 32-bit segments. Two fingerprints that differ in at most 3 bits differ in at most one
bit in one of the segments, so each segment value is entered in a table and the Hamming ball of radius 1 around it is
looked up. Of a pair one bit apart exactly one side has the 0 there, so a ball only flips zeros. Every match is
verified on all 64 bits. Inside a bucket a breadth-first search keeps a spanning forest: as many links as nodes, never
all pairs, and the same components.

Near copies by a similarity of sets, as the pipeline takes them, differ in more bits. ``set_prints`` makes wider
fingerprints of the sets, with as many segments as the recall asks for, and ``segment_links`` links those that share a
segment and differ in few bits of their first words; an exact comparison is left to the caller.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, log, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import prepare, written
from .text import is_space, mix64, signed

#: Table entries, or rows of balls, of one segment value above which the bucket is dealt out in blocks.
BLOCK = 20_000
_SEED = 42

#: Of the fingerprints of sets: bits of a segment, and first words that are compared and not part of a segment.
SEGMENT_BITS = 12
CHECK_WORDS = 3
#: Rows of a bucket up to which all its pairs are compared at once, and rows worked on together.
_SMALL = 1024
_ROWS = 1 << 16


def text_fingerprint(text: str | None, width: int = 3, seed: int = _SEED) -> int:
    """64-bit SimHash of the word shingles of a text; no words give 0."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    space = is_space()[raw]
    keep = ~space
    keep[1:] |= ~space[:-1]
    norm = np.where(space, np.uint8(32), raw)[keep]
    if len(norm) and norm[-1] == 32:
        norm = norm[:-1]
    if not len(norm):
        return 0
    ends = np.concatenate((np.flatnonzero(norm == 32), [len(norm)]))
    norm = norm.tobytes()
    digest = xxhash.xxh64_intdigest
    if len(ends) <= width:
        return digest(norm, seed)
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(ends) - width + 1
    votes = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        h = np.array([digest(norm[s:e], seed) for s, e in zip(starts[lo:hi].tolist(), ends[lo + width - 1 : hi + width - 1].tolist())], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, fp`` (fp a signed 64-bit long) for each row; null and blank texts have fingerprint 0."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((text_fingerprint(t, width) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp long")


def _near(key: str, bit: int) -> Column:
    """The segment values that differ from ``key`` in one place, where ``key`` has the bit."""
    return F.expr(f"transform(filter(sequence(0, 31), b -> (shiftright({key}, b) & 1) = {bit}), b -> {key} ^ shiftleft(1L, b))")


def _entries(fps: DataFrame, block: int) -> DataFrame:
    """``key, sub, kind, fp``: table rows (kind 0) and ball rows (kind 1) of each fingerprint by segment value.

    A bucket has ``tables`` blocks of table rows and ``balls`` blocks of ball rows; more than one of each only where a
    segment value is crowded, or one bit from a crowded one. Its parts (``sub``) are the pairs of table blocks, and
    those of a block with itself once for each block of ball rows; so each two table rows meet, and each ball row
    meets each table row once.
    """
    segments = F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32)))
    table = fps.select(F.explode(segments).alias("key"), "fp")
    ball = table.select(F.explode(_near("key", 0)).alias("key"), "fp")
    rows = table.select("key", F.lit(0).cast("byte").alias("kind"), "fp").union(ball.select("key", F.lit(1).cast("byte").alias("kind"), "fp"))
    crowds = written(table.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block), "simhash-crowds")
    if crowds.isEmpty():
        return rows.select("key", F.lit(0).cast("long").alias("sub"), "kind", "fp")
    here = crowds.select("key", "n", F.lit(0).cast("long").alias("m"))
    beside = crowds.select(F.explode(_near("key", 0)).alias("key"), F.lit(0).cast("long").alias("n"), F.col("n").alias("m"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.sum(c) / block)).cast("long")
    dealt = written(here.union(beside).groupBy("key").agg(blocks("n").alias("tables"), blocks("m").alias("balls")), "simhash-blocks")
    sub = """CASE WHEN tables IS NULL THEN array(0L)
      WHEN kind = 1 THEN transform(sequence(0L, tables - 1), i -> (i * tables + i) * balls + pmod(xxhash64(1, fp), balls))
      ELSE concat(transform(filter(sequence(0L, tables - 1), j -> j <> pmod(xxhash64(fp), tables)), j -> (least(j, pmod(xxhash64(fp), tables)) * tables + greatest(j, pmod(xxhash64(fp), tables))) * balls),
        transform(sequence(0L, balls - 1), b -> pmod(xxhash64(fp), tables) * (tables + 1) * balls + b)) END"""
    return rows.join(dealt, "key", "left").select("key", F.explode(F.expr(sub)).alias("sub"), "kind", "fp")


def bucket_links(table: np.ndarray, ball: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links of a bucket, grown from its table entries."""
    links = []
    nodes = np.unique(np.concatenate([table, ball]))
    open_ = np.ones(len(nodes), bool)
    for seed in np.searchsorted(nodes, np.unique(table)).tolist():
        if not open_[seed]:
            continue
        open_[seed] = False
        frontier = [seed]
        while frontier:
            at = frontier.pop()
            rest = np.flatnonzero(open_)
            if not len(rest):
                break
            near = rest[np.bitwise_count(nodes[rest] ^ nodes[at]) <= radius]
            if len(near):
                open_[near] = False
                links.append((np.full(len(near), nodes[at]), nodes[near]))
                frontier.extend(near.tolist())
    return links


def _match(radius: int, chunk: int = 100_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table, ball, pending = None, [], [], 0

        def flush():
            t = np.concatenate(table) if table else np.empty(0, np.uint64)
            q = np.concatenate(ball) if ball else np.empty(0, np.uint64)
            if not len(t) or len(t) + len(q) < 2:
                return None
            links = bucket_links(t, q, radius)
            if not links:
                return None
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*links))
            return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            sub = batch.column(1).to_numpy(zero_copy_only=False)
            kind = batch.column(2).to_numpy(zero_copy_only=False)
            fp = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(key):
                continue
            edge = np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1
            lo = np.concatenate(([0], edge))
            hi = np.concatenate((edge, [len(key)]))
            full = (hi - lo > 1) & (kind[lo] == 0)
            full[[0, -1]] = True  # a bucket may go on across batches
            for s, e in zip(lo[full].tolist(), hi[full].tolist()):
                at = (key[s], sub[s])
                if at != now:
                    out = flush()
                    if out is not None:
                        yield out
                    now, table, ball, pending = at, [], [], 0
                cut = s + int(np.searchsorted(kind[s:e], 1))
                table.append(fp[s:cut])
                ball.append(fp[cut:e])
                pending += e - cut
                if pending > chunk:
                    out = flush()
                    if out is not None:
                        yield out
                    ball, pending = [], 0
        out = flush()
        if out is not None:
            yield out

    return run


def fingerprint_links(fps: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``) at most ``radius`` <= 3 bits apart.

    The links connect exactly what all pairs would connect. A segment value held by more than ``block`` fingerprints,
    or next to such values, is dealt out in blocks, by a join.
    """
    if not 0 <= radius <= 3:
        raise ValueError("two segments with balls of radius 1 find at most 3 differing bits")
    prepare(fps.sparkSession)
    return _entries(fps.select("fp"), block).repartition("key", "sub").sortWithinPartitions("key", "sub", "kind").mapInArrow(_match(radius), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id``, the smallest doc_id reachable over links.

    Null, empty and blank texts share fingerprint 0 and link like any other. Repeated rows stay repeated. An empty
    table gives no rows; other columns are not read. A null doc_id has a row, and its group's smallest known id.
    """
    prints = written(fingerprints(docs, id_col, text_col, width), "simhash")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    comp = connected_components(fingerprint_links(nodes, radius))
    led = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    roots = led.groupBy("root").agg(F.min("first").alias("component_id"))
    named = led.join(roots, "root").select(F.col("fp").alias("node_fp"), "component_id")
    return prints.join(named, prints.fp == named.node_fp).select("doc_id", "fp", "component_id")


def fingerprint_hex(col: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))


def flip_share(threshold: float, most: int = 16) -> float:
    """The largest share of bits in which fingerprints of sets at the threshold differ, ties counted as half.

    For large sets it follows from the cosine; sets of up to ``most`` members are counted out.
    """
    worst = acos(2 * threshold / (1 + threshold)) / pi
    for a in range(1, most + 1):
        for b in range(a, most + 1):
            k = ceil(threshold * (a + b) / (1 + threshold) - 1e-9)
            if k > a:
                continue
            odds = 0.0
            for c in range(k + 1):
                for i in range(a - k + 1):
                    for j in range(b - k + 1):
                        x, y = np.sign(2 * (c + i) - a), np.sign(2 * (c + j) - b)
                        odds += comb(k, c) * comb(a - k, i) * comb(b - k, j) * (0 if a == b == k else abs(x - y) / 2 if x or y else 0.5)
            worst = max(worst, float(odds / 2 ** (a + b - k)))
    return worst


def tune_segments(threshold: float, recall: float, bits: int = SEGMENT_BITS, check_words: int = CHECK_WORDS) -> tuple[int, int]:
    """Segments, and the most bits of the first words that may differ, by which pairs at the threshold are missed with
    half of 1 - ``recall`` each."""
    p, miss, n = flip_share(threshold), (1 - recall) / 2, 64 * check_words
    segments = ceil(log(miss) / log(1 - (1 - p) ** bits))
    seen = 0.0
    for radius in range(n + 1):
        seen += comb(n, radius) * p**radius * (1 - p) ** (n - radius)
        if 1 - seen <= miss:
            break
    return segments, radius


def print_words(segments: int, bits: int = SEGMENT_BITS, check_words: int = CHECK_WORDS) -> int:
    return check_words + -(-segments * bits // 64)


def set_prints(members: np.ndarray, first: np.ndarray, words: int, chunk: int = 1 << 14) -> np.ndarray:
    """Fingerprints of ``words`` x 64 bits of sets of 64-bit hashes; set s's members begin at ``first[s]``.

    A bit is 1 if set in more than half of the members; where it is in just half, a hash of the set decides, so that
    small sets have no bit more often 0.
    """
    lanes = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    salts = mix64(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    hashes = lambda x: mix64(x[:, None] ^ salts).view(np.uint8)
    size = np.diff(np.append(first, len(members)))
    # a lane of 8 bits counts up to 255
    parts = -(-size // 255)
    owner = np.repeat(np.arange(len(first)), parts)
    start = first[owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
    end = np.append(start[1:], len(members))
    votes = np.zeros((len(first), 64 * words), np.int32)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + chunk, side="right")))
        sums = np.add.reduceat(lanes[hashes(members[start[lo] : end[hi - 1]])], start[lo:hi] - start[lo], axis=0)
        at = np.flatnonzero(np.diff(owner[lo:hi], prepend=-1))
        votes[owner[lo:hi][at]] += np.add.reduceat(sums.view(np.uint8).reshape(hi - lo, -1), at, axis=0, dtype=np.int32)
        lo = hi
    tie = np.unpackbits(hashes(mix64(np.bitwise_xor.reduceat(members, first) + np.uint64(1))), axis=1, bitorder="little")
    return np.packbits(2 * votes + tie > size[:, None], axis=1, bitorder="little").view(np.uint64)


def _segment_rows(segments: int, bits: int, check_words: int):
    """``key`` and the first words, for each segment of the fingerprints in column 0."""
    weights = (1 << np.arange(bits)).astype(np.int64)
    base = np.arange(segments, dtype=np.int64) << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            prints = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            raw = np.unpackbits(np.ascontiguousarray(prints[:, check_words:]).view(np.uint8), axis=1, bitorder="little")
            key = raw[:, : segments * bits].reshape(b.num_rows, segments, bits) @ weights + base
            cols = [pa.array(np.repeat(prints[:, k], segments)) for k in range(check_words)]
            yield pa.record_batch([pa.array(key.ravel()), *cols], names=["key", *(f"c{k}" for k in range(check_words))])

    return run


def label_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the least of its component, for links ``a``, ``b``."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        for end in (x, y, label[x], label[y]):
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _near_in_run(words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of one large bucket, as row numbers."""
    a, b = [], []
    open_ = np.ones(len(words), bool)
    for seed in range(len(words)):
        frontier = [seed] if open_[seed] else []
        open_[seed] = False
        while frontier:
            at = frontier.pop()
            rest = np.flatnonzero(open_)
            near = rest[np.bitwise_count(words[rest] ^ words[at]).sum(axis=1, dtype=np.int16) <= radius]
            open_[near] = False
            a.append(np.full(len(near), at))
            b.append(near)
            frontier.extend(near.tolist())
    return np.concatenate(a), np.concatenate(b)


def segment_matches(run: np.ndarray, words: np.ndarray, radius: int, small: int = _SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Links (of first words) that connect what all pairs within ``radius`` inside a bucket would connect; ``run`` is each
    row's bucket, rows of a bucket being together."""
    first = np.flatnonzero(np.diff(run, prepend=run[:1] - 1))
    size = np.diff(np.append(first, len(run)))
    left = np.repeat(np.where(size <= small, first + size, 0), size) - np.arange(len(run))  # rows up to the bucket's end
    node, a, b, held = words[:, 0], [], [], 0
    at = np.flatnonzero(left > 1)
    step = 1
    while len(at):
        far = np.bitwise_count(words[at, 0] ^ words[at + step, 0]).astype(np.int16)
        maybe = np.flatnonzero(far <= radius)
        x = at[maybe]
        far = far[maybe]
        for k in range(1, words.shape[1]):
            far += np.bitwise_count(words[x, k] ^ words[x + step, k])
        x = x[far <= radius]
        a.append(node[x])
        b.append(node[x + step])
        held += len(x)
        if held > 1 << 20:
            a, b = ([c] for c in label_forest(np.concatenate(a), np.concatenate(b)))
            held = len(a[0])
        step += 1
        at = at[left[at] > step]
    for f, n in zip(first[size > small].tolist(), size[size > small].tolist()):
        x, y = _near_in_run(words[f : f + n], radius)
        a.append(node[f + x])
        b.append(node[f + y])
    return label_forest(np.concatenate(a), np.concatenate(b)) if a else (node[:0], node[:0])


def _match_segments(radius: int, check_words: int, rows: int = _ROWS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, most = [], rows

        def flush(last: bool):
            """Links of the buckets that are whole; the last one goes on in the next batch."""
            nonlocal held, most
            x = np.concatenate(held)
            cut = len(x)
            edge = np.flatnonzero((x[1:, :2] != x[:-1, :2]).any(axis=1)) + 1
            if not last:
                cut = int(edge[-1]) if len(edge) else 0
            held, most = [x[cut:]], max(rows, 2 * (len(x) - cut))
            bucket = np.zeros(len(x), np.int64)
            bucket[edge] = 1
            a, b = segment_matches(np.cumsum(bucket)[:cut], x[:cut, 2:].view(np.uint64), radius)
            return pa.record_batch([pa.array(signed(a)), pa.array(signed(b))], names=["a", "b"]) if len(a) else None

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
            if sum(map(len, held)) >= most and (out := flush(False)) is not None:
                yield out
        if held and (out := flush(True)) is not None:
            yield out

    return run


def segment_links(prints: DataFrame, segments: int, radius: int, block: int = BLOCK, bits: int = SEGMENT_BITS, check_words: int = CHECK_WORDS) -> DataFrame:
    """Links ``a, b`` between first words of fingerprints (column ``print``, an array of longs) that share a segment and
    differ in at most ``radius`` bits of their ``check_words`` first words.

    The links connect what all pairs would connect. Buckets that look crowded in a sixteenth of the fingerprints are
    dealt out in pairs of blocks, in which each two members meet; the sample decides on the dealing only.
    """
    prepare(prints.sparkSession)
    checks = [f"c{k}" for k in range(check_words)]
    spread = lambda d: d.select("print").mapInArrow(_segment_rows(segments, bits, check_words), f"key long, {', '.join(c + ' long' for c in checks)}")
    some = spread(prints.where(F.pmod(F.xxhash64("print"), F.lit(16)) == 0))
    crowds = written(some.groupBy("key").agg((16 * F.count("*")).alias("n")).where(F.col("n") > block).select(F.col("key").alias("k"), F.ceil(2 * F.col("n") / block).cast("long").alias("blocks")), "simhash-crowds")
    rows = spread(prints)
    if crowds.isEmpty():
        dealt = rows.withColumn("sub", F.lit(0).cast("long"))
    else:
        mine = F.pmod(F.xxhash64(*checks), "blocks")
        others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: j != mine)
        pairs = F.transform(others, lambda j: F.least(j, mine) * F.col("blocks") + F.greatest(j, mine))
        sub = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)
        dealt = rows.join(crowds, F.col("key") == F.col("k"), "left").withColumn("sub", F.explode(sub))
    return dealt.select("key", "sub", *checks).repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(_match_segments(radius, check_words), "a long, b long")
