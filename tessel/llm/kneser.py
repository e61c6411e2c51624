"""Interpolated modified Kneser-Ney n-gram model over sorted hash arrays (operator 2).

Counting runs in Spark over all training texts: tasks count their own words, and pairs of a context and the word after
it, send sorted packed arrays to shards by hash, and shards merge them. The model is a folder of sorted hash arrays with
counts beside them, which scoring workers map into memory. A shard holds the words of a range of hashes; pairs lie in the
shard of their context, so that its statistics are whole there, but pairs of very frequent words are spread by the
pair's own hash and their statistics summed afterwards.

With ``order`` n a context is the n - 1 tokens before, filled up by a start mark at the beginning of a text. On every
level P(w | u) = max(c(uw) - D(c(uw)), 0) / c(u.) + gamma(u) P(w | u without its first token), with discounts D1, D2, D3+
from the level's counts of counts. The highest level has the counts themselves; on a lower one c(uw) is the number of
different tokens before uw, which the merge of the level above sends on. The lowest, P(w), is interpolated with
1 / (V + 1) for each word and one unknown. The first token of a text has P(w); a context that never was has the level
below.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import SharedFiles, discard, prepare, written
from .text import Words, mix64, word_runs

#: The token after a text's last word.
END = np.uint64(0x5851F42D4C957F2D)
#: What fills up contexts at the beginning of a text.
START = np.uint64(0x2127599BF4325C37)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
_CONTEXT = np.uint64(0x9FB21C651E98DF25)
#: Tokens that a counting task holds before it sends.
FLUSH = 4_000_000
#: Second words of pairs are kept to so many bits, the top ones of the hash.
SHORT = np.uint64(16)
#: Counts of a pair are a byte; greater ones are in a list.
CAP = 255
#: Shards, as a power of 2, up to which counting tasks send to shards at once; beyond, by way of groups of shards.
DIRECT_BITS = 10
#: Files that a scoring task has mapped at once; the first mapped goes when there are more.
MAPS = 8_192


def pack(*cols: np.ndarray) -> bytes:
    """Columns as one compressed blob; a first ascending uint64 column is kept as differences, bytes by significance."""
    out = []
    for c in cols:
        d = np.diff(c, prepend=c.dtype.type(0)) if c.dtype == np.uint64 and len(c) and np.all(c[1:] >= c[:-1]) else None
        body = d if d is not None else c
        flat = np.ascontiguousarray(body.view(np.uint8).reshape(len(c), c.dtype.itemsize).T).tobytes() if len(c) else b""
        out.append(json.dumps([c.dtype.str, len(c), d is not None]).encode().ljust(32) + flat)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        kind, n, summed = json.loads(raw[at : at + 32])
        size = np.dtype(kind).itemsize
        at += 32
        c = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T
        c = np.ascontiguousarray(c).view(kind).reshape(n)
        out.append(np.cumsum(c, dtype=np.uint64) if summed else c)
        at += n * size
    return out


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts in turn, each followed by the end, and the index after each text's end."""
    bounds = w.bounds()
    out = np.full(len(w.hash) + w.n_docs, END, np.uint64)
    out[np.arange(len(w.hash)) + w.doc] = w.hash
    return out, bounds[1:] + np.arange(1, w.n_docs + 1)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(first * _PAIR + (second >> SHORT))


def contexts(t: np.ndarray, ends: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the contexts of the tokens at ``at`` (none the first of its text), for the levels 2 to ``order``."""
    out = [t[at - 1]]
    if order > 2:
        begin = np.concatenate(([0], ends[:-1]))[np.searchsorted(ends, at, side="right")]
    for back in range(2, order):
        k = at - back
        out.append(mix64(out[-1] * _CONTEXT + np.where(k >= begin, t[np.maximum(k, 0)], START)))
    return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ascending keys, their summed counts, and where each occurs first."""
    if not len(keys):
        return keys, counts, np.empty(0, np.int64)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[first], np.add.reduceat(counts[order], first), order[first]


def _shard(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _runs(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """The shards that occur in an ascending array, each with the bounds of its run."""
    first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else np.empty(0, np.int64)
    yield from zip(shard[first].tolist(), first.tolist(), [*first[1:].tolist(), len(shard)])


def _cut(k: np.ndarray, n: np.ndarray, at: np.ndarray, bits: int) -> list[tuple[int, bytes]]:
    """Ascending keys and their counts by shard of the hashes ``at``."""
    return [(s, pack(k[a:b], n[a:b].astype(np.uint32))) for s, a, b in _runs(_shard(at, bits))]


def _word_blobs(parts: list[list[np.ndarray]], bits: int) -> list[tuple[int, bytes]]:
    k, n, _ = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64))
    return _cut(k, n, k, bits)


def _before_blobs(parts: list[list[np.ndarray]], bits: int) -> list[tuple[int, bytes]]:
    w, c, _ = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64))
    return _cut(w, c, w << SHORT, bits)


def _pair_blobs(hot: np.ndarray):
    def blobs(parts: list[list[np.ndarray]], bits: int) -> list[tuple[int, bytes]]:
        chain, v, n = _joined(parts)
        _, n, at = summed(mix64(chain[0] * _PAIR + v), n)
        return _blobs([c[at] for c in chain], v[at], n, bits, hot)

    return blobs


def _joined(parts: list[list[np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Contexts, second words and counts of packed pairs, one after another."""
    chain = [np.concatenate([np.repeat(p[c], p[-3].astype(np.int64)) for p in parts]) for c in range(len(parts[0]) - 3)]
    return chain, np.concatenate([p[-2] for p in parts]), np.concatenate([p[-1] for p in parts]).astype(np.int64)


def _dealt_on(blobs, bits: int):
    """Blobs of a group of shards, taken together and sent to the shards themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send():
            out = blobs(held, bits)
            return pa.record_batch([pa.array([s for s, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["shard", "blob"])

        for b in batches:
            for x in b.column(1).to_pylist():
                held.append(unpack(x))
                size += len(held[-1][-1])
                if size >= FLUSH:
                    yield send()
                    held, size = [], 0
        if size:
            yield send()

    return run


def _count_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send():
            k, n, _ = summed(np.concatenate(held), np.ones(size, np.int64))
            blobs = _cut(k, n, k, bits)
            return pa.record_batch([pa.array([s for s, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.binary())], names=["shard", "blob"])

        for b in batches:
            for _, _, w in word_runs(b.column(0)):
                t, _ = tokens(w)
                held.append(t)
                size += len(t)
                if size >= FLUSH:
                    yield send()
                    held, size = [], 0
        if size:
            yield send()

    return run


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[np.ndarray]]]]:
    """Unpacked blobs of each shard, from rows that come shard by shard."""
    now, held = None, []
    for b in batches:
        for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if s != now and held:
                yield now, held
                held = []
            now = s
            held.append(unpack(x))
    if held:
        yield now, held


def _merge_words(files: SharedFiles, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _by_shard(batches):
            k, n, _ = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64))
            files.write(f"word-{shard}", k.tobytes())
            files.write(f"count-{shard}", n.tobytes())
            most = np.argsort(-n, kind="stable")[:top]
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([len(k)], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([k[most].view(np.int64).tolist()], pa.list_(pa.int64())), pa.array([n[most].tolist()], pa.list_(pa.int64()))], names=["shard", "types", "tokens", "top", "top_n"])

    return run


def _blobs(chain: list[np.ndarray], v: np.ndarray, n: np.ndarray, bits: int, hot: np.ndarray) -> list[tuple[int, bytes]]:
    """Distinct pairs by shard of their context: contexts, those of the levels below for each, how many pairs each has,
    second words (shortened) and counts. ``chain`` has the pairs' contexts, the level's own first."""
    u = chain[0]
    shard = np.where(np.isin(u, hot), _shard(mix64(u * _PAIR + v), bits), _shard(u, bits))
    order = np.lexsort((u, shard))
    chain, v, n, shard = [c[order] for c in chain], v[order], n[order], shard[order]
    out = []
    for s, a, b in _runs(shard):
        u = chain[0][a:b]
        first = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
        runs = np.diff(np.concatenate((first, [b - a]))).astype(np.uint32)
        out.append((s, pack(*(c[a:b][first] for c in chain), runs, v[a:b], n[a:b].astype(np.uint32))))
    return out


def _count_pairs(bits: int, hot: np.ndarray, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send():
            *chain, v = (np.concatenate(x) for x in zip(*held))
            _, n, at = summed(pair_hash(chain[0], v), np.ones(size, np.int64))
            blobs = _blobs([c[at] for c in chain], v[at] >> SHORT, n, bits, hot)
            return pa.record_batch([pa.array([s for s, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.binary())], names=["shard", "blob"])

        for b in batches:
            for _, _, w in word_runs(b.column(0)):
                t, ends = tokens(w)
                inner = np.ones(len(t), bool)
                inner[np.concatenate(([0], ends[:-1]))] = False
                at = np.flatnonzero(inner)
                held.append((*contexts(t, ends, at, order)[::-1], t[at]))
                size += len(at)
                if size >= FLUSH:
                    yield send()
                    held, size = [], 0
        if size:
            yield send()

    return run


def _tally(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _merge_pairs(files: SharedFiles, bits: int, hot: np.ndarray, below: np.ndarray, level: int):
    """Pairs of a shard: their file, statistics of contexts, and what the level below counts: of its pairs, or on level 2
    of words, how many different ones stand before. ``hot`` are the contexts of the level that are spread, ``below`` those
    of the level below."""
    names = ["kind", "shard", "blob"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _by_shard(batches):
            chain, v, n = _joined(parts)
            g, n, at = summed(mix64(chain[0] * _PAIR + v), n)
            chain, v = [c[at] for c in chain], v[at]
            big = np.flatnonzero(n >= CAP)
            files.write(f"pair{level}-{shard}", g.tobytes())
            files.write(f"pairs{level}-{shard}", np.minimum(n, CAP).astype(np.uint8).tobytes())
            files.write(f"big{level}-{shard}", np.concatenate((g[big].view(np.int64), n[big])).tobytes())
            order = np.argsort(chain[0], kind="stable")
            us, ns = chain[0][order], n[order]
            first = np.flatnonzero(np.concatenate(([True], us[1:] != us[:-1])))
            stats = np.stack([np.add.reduceat(x.astype(np.int64), first) for x in (ns, ns == 1, ns == 2, ns >= 3)])
            ctx = us[first]
            spread = np.isin(ctx, hot)
            files.write(f"ctx{level}-{shard}", ctx[~spread].tobytes())
            files.write(f"stats{level}-{shard}", np.ascontiguousarray(stats[:, ~spread].T.astype(np.uint32)).tobytes())
            rows = [(0, shard, json.dumps(_tally(n) + [len(n)]).encode()), (1, shard, pack(ctx[spread], *(s.astype(np.int64) for s in stats[:, spread])))]
            if level > 2:
                _, c, at = summed(mix64(chain[1] * _PAIR + v), np.ones(len(v), np.int64))
                rows += [(2, s, x) for s, x in _blobs([x[at] for x in chain[1:]], v[at], c, bits, below)]
            else:
                w, c, _ = summed(v, np.ones(len(v), np.int64))
                rows += [(2, s, x) for s, x in _cut(w, c, w << SHORT, bits)]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int8(), pa.int32(), pa.binary()))], names=names)

    return run


def _merge_before(files: SharedFiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _by_shard(batches):
            w, c, _ = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64))
            words = files.map(f"word-{shard}").view(np.uint64) >> SHORT
            k = np.searchsorted(w, words)
            k[k == len(w)] = 0
            before = np.where(w[k] == words, c[k], 0)
            files.write(f"before-{shard}", before.astype(np.int64).tobytes())
            yield pa.record_batch([pa.array([json.dumps(_tally(before) + [int((before >= 3).sum())]).encode()], pa.binary())], names=["tally"])

    return run


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams seen once to four times, held between 0 and 1, 2, 3."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.0
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else y for k in (1, 2, 3)]
    return [min(max(d, 0.0), float(k)) for k, d in enumerate(raw, 1)]


@dataclass
class Model:
    """Where the arrays are, and the few numbers beside them."""

    files: SharedFiles
    order: int
    bits: int
    n_tokens: int
    n_types: int
    #: By level, from 2.
    pair_discounts: list[list[float]]
    word_discounts: list[float]
    #: Words with 1, 2 and 3 or more different words before them.
    words_before: list[int]
    pair_types: int
    #: Very frequent words as contexts of level 2: total count, and pair types seen once, twice, more often.
    hot: dict[int, list[int]]


def fit(texts: DataFrame, text_col: str = "text", order: int = 2, direct_bits: int = DIRECT_BITS) -> Model:
    """Count all rows of ``texts`` and write the model's arrays to the shared folder.

    ``order`` is the length of the n-grams, 2 or more. There are about two shards to an input split. Above
    2**``direct_bits`` of them, tasks send to groups of shards, about the square root of their number, whose blobs are
    taken together and sent on; so blobs do not shrink to a few entries as splits grow in number. Null texts are empty: an end token only. No rows give a model in
    which every token has probability 1 / (V + 1) = 1.
    """
    if order < 2:
        raise ValueError("order is 2 or more")
    spark = texts.sparkSession
    prepare(spark)
    src = texts.select(F.col(text_col).cast("string").alias("text"))
    bits = max(4, (2 * max(1, src.rdd.getNumPartitions()) - 1).bit_length())
    files = SharedFiles.create(spark, "kneser")
    sharded = "shard int, blob binary"
    # a task merges two neighbouring shards, whatever the session's number of shuffle partitions
    sort = lambda df: df.repartitionById(1 << (bits - 1), F.shiftright("shard", 1)).sortWithinPartitions("shard")
    coarse = bits if bits <= direct_bits else (bits + 1) // 2

    def to_shards(df: DataFrame, blobs) -> DataFrame:
        if coarse < bits:
            # a group's blobs are shared out by the task that sent them, over as many tasks as merge shards
            ways = 1 << max(0, bits - 1 - coarse)
            task = F.col("shard") * ways + F.pmod(F.spark_partition_id(), F.lit(ways))
            df = df.withColumn("task", task).repartitionById((1 << coarse) * ways, "task").select("shard", "blob").mapInArrow(_dealt_on(blobs, bits), sharded)
        return sort(df)

    words = to_shards(src.mapInArrow(_count_words(coarse), sharded), _word_blobs).mapInArrow(_merge_words(files, 64), "shard int, types long, tokens long, top array<long>, top_n array<long>").collect()
    n_tokens, n_types = sum(r["tokens"] for r in words), sum(r["types"] for r in words)
    limit = n_tokens / (4 << bits)
    hot = np.array(sorted(k for r in words for k, n in zip(r["top"], r["top_n"]) if n > limit), np.int64).view(np.uint64)
    counted, above, found, pair_types = src.mapInArrow(_count_pairs(coarse, hot if order == 2 else hot[:0], order), sharded), None, [], 0
    stats: dict[int, np.ndarray] = {}
    for level in range(order, 1, -1):
        spread = hot if level == 2 else hot[:0]
        pairs = to_shards(counted, _pair_blobs(spread))
        merged = written(pairs.mapInArrow(_merge_pairs(files, coarse, spread, hot if level == 3 else hot[:0], level), "kind byte, shard int, blob binary"), "kneser-pairs", "none")
        if above is not None:
            discard(above)
        above = merged
        tally = np.zeros(5, np.int64)
        for r in merged.where("kind < 2").toLocalIterator():
            if r["kind"] == 0:
                tally += np.array(json.loads(bytes(r["blob"])), np.int64)
            elif level == 2:
                ctx, *s = unpack(bytes(r["blob"]))
                for k, row in zip(ctx.tolist(), np.array(s).T if len(ctx) else []):
                    stats[k] = stats.get(k, 0) + row
        found.insert(0, discounts(tally[:4].tolist()))
        pair_types = int(tally[4])
        counted = merged.where("kind = 2").select("shard", "blob")
    before = to_shards(counted, _before_blobs).mapInArrow(_merge_before(files), "tally binary").collect()
    discard(above)
    words_tally = np.sum([json.loads(bytes(r["tally"])) for r in before], axis=0, dtype=np.int64) if before else np.zeros(5, np.int64)
    return Model(files, order, bits, n_tokens, n_types, found, discounts(words_tally[:4].tolist()), words_tally[[0, 1, 4]].tolist(), pair_types, {k: v.tolist() for k, v in stats.items()})


class Scorer:
    """The mapped arrays of a model, opened as they are needed."""

    def __init__(self, m: Model):
        self.m, self.open = m, {}
        #: mass left by discounting the lower order, spread over the vocabulary and one unknown
        left = sum(d * n for d, n in zip(m.word_discounts, m.words_before)) / m.pair_types if m.pair_types else 1.0
        self.rest = left / (m.n_types + 1)

    def arr(self, name: str, shard: int, kind) -> np.ndarray:
        key = (name, shard)
        if key not in self.open:
            if len(self.open) >= MAPS:
                self.open.pop(next(iter(self.open)))
            try:
                self.open[key] = self.m.files.map(f"{name}-{shard}").view(kind)
            except FileNotFoundError:
                self.open[key] = np.empty(0, kind)
        return self.open[key]

    def find(self, name: str, shard: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = self.arr(name, shard, np.uint64)
        if not len(a):
            return np.zeros(len(q), np.int64), np.zeros(len(q), bool)
        k = np.searchsorted(a, q)
        k[k == len(a)] = 0
        return k, a[k] == q

    def words(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count, and words before, of ascending distinct words."""
        c, before = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        for s, a, b in _runs(_shard(q, self.m.bits)):
            k, ok = self.find("word", s, q[a:b])
            if ok.any():
                c[a:b][ok] = self.arr("count", s, np.int64)[k[ok]]
                have = self.arr("before", s, np.int64)
                if len(have):
                    before[a:b][ok] = have[k[ok]]
        return c, before

    def contexts(self, q: np.ndarray, level: int) -> np.ndarray:
        """Statistics of ascending distinct contexts of a level; those that never were have a total of 0."""
        stats = np.zeros((len(q), 4), np.int64)
        for s, a, b in _runs(_shard(q, self.m.bits)):
            k, ok = self.find(f"ctx{level}", s, q[a:b])
            if ok.any():
                stats[a:b][ok] = self.arr(f"stats{level}", s, np.uint32).reshape(-1, 4)[k[ok]]
        if level == 2 and self.m.hot:
            hot = np.array(sorted(self.m.hot), np.uint64)
            k = np.searchsorted(q, hot)
            for i, h in zip(k.tolist(), hot.tolist()):
                if i < len(q) and q[i] == h:
                    stats[i] = self.m.hot[h]
        return stats

    def pairs(self, u: np.ndarray, v: np.ndarray, level: int) -> np.ndarray:
        """Counts of pairs of a context and a word."""
        out = np.zeros(len(u), np.int64)
        g = pair_hash(u, v)
        hot = np.array(sorted(self.m.hot) if level == 2 else [], np.uint64)
        shard = np.where(np.isin(u, hot), _shard(g, self.m.bits), _shard(u, self.m.bits))
        order = np.lexsort((g, shard))
        for s, a, b in _runs(shard[order]):
            at = order[a:b]
            k, ok = self.find(f"pair{level}", s, g[at])
            n = np.where(ok, self.arr(f"pairs{level}", s, np.uint8)[k] if ok.any() else 0, 0).astype(np.int64)
            big = np.flatnonzero(n == CAP)
            if len(big):
                table = self.arr(f"big{level}", s, np.int64).reshape(2, -1)
                n[big] = table[1][np.searchsorted(table[0].view(np.uint64), g[at][big])]
            out[at] = n
        return out

    def score(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens, base score and model score of each text."""
        m = self.m
        t, ends = tokens(w)
        q, of = np.unique(t, return_inverse=True)
        c, before = self.words(q)
        d = np.array([0.0, *m.word_discounts])
        p = (np.maximum(before - d[np.minimum(before, 3)], 0) / max(1, m.pair_types) + self.rest)[of]
        starts = np.concatenate(([0], ends[:-1]))
        inner = np.ones(len(t), bool)
        inner[starts[ends > starts]] = False
        inside = np.flatnonzero(inner)
        for level, u in enumerate(contexts(t, ends, inside, m.order) if len(inside) else [], 2):
            distinct, which = (q, of[inside - 1]) if level == 2 else np.unique(u, return_inverse=True)
            ctx = self.contexts(distinct, level)[which]
            known = ctx[:, 0] > 0
            at, u, ctx = inside[known], u[known], ctx[known]
            if len(at):
                n = self.pairs(u, t[at], level)
                d = np.array([0.0, *m.pair_discounts[level - 2]])
                total = ctx[:, 0]
                p[at] = np.maximum(n - d[np.minimum(n, 3)], 0) / total + (ctx[:, 1:] @ d[1:]) / total * p[at]
        base = np.log10((c + 1) / (m.n_tokens + m.n_types + 1))[of]
        return ends - starts, *(np.add.reduceat(x, starts) for x in ((c > 0)[of].astype(np.int64), base, np.log10(p)))


def score(docs: DataFrame, m: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity``.

    Scores are log10 probabilities of the words and one end token; null and blank texts have the end alone. Repeated
    rows score alike; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(m)
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(sent.value)
        for b in batches:
            for lo, hi, w in word_runs(b.column(1)):
                n, known, base, full = s.score(w)
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(known), pa.array(np.full(hi - lo, s.m.n_tokens)), pa.array(base), pa.array(full), pa.array(10.0 ** (-full / n))], names=names)

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")

