"""Substring deduplication: paragraph MinHash banding, and anchors of shared passages (operator 1).

Paragraphs are lines. Equal ones collapse to a class first. Classes get MinHash signatures over 5-word shingles; bands
are tuned so that a pair at the threshold is found with the asked probability; classes that share a band are compared
by exact Jaccard similarity of their shingles inside the bucket, where a spanning forest of the links is kept; and
connected components name what to remove.

A passage can also stand inside paragraphs that otherwise differ. Winnowing picks a least-hashed window of words in
every run of windows, so that any two places that share ``guarantee`` words share a picked window. Windows picked in two
places or more are joined to chains: picked windows that follow each other in a text, follow each other at the same
distance in the text of their group's first place, and have the same words between them there. The ends of a chain are
then extended, word by word, as far as both texts agree. Both the shingles of paragraphs and the words around the ends of
chains are taken in one further pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected_components
from .lines import line_groups, sealed
from .runtime import discard, prepare, written
from .text import Words, mix64, run_hash, sequence_sums, signed, word_runs

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
#: Paragraphs with fewer words are left alone; those of fewer than SHINGLE words are only ever compared for equality.
MIN_WORDS = 20
#: Any shared run of so many words is found; windows of WINDOW words are compared.
GUARANTEE = 50
WINDOW = 20
#: Distinct paragraphs in one bucket above which it is dealt out in pairs of blocks of half as many.
BLOCK = 5_000
#: Words of a bucket's paragraphs above which it is dealt out too: a worker holds the shingles of a whole group.
BLOCK_WORDS = 2_000_000


def tune_bands(threshold: float, recall: float, max_rows: int = 8, max_bands: int = 64) -> tuple[int, int]:
    """Bands and rows: the most rows (fewest chance collisions) whose fewest bands reach the recall within 40 hashes,
    or else the cheapest that reaches it at all."""
    options = []
    for rows in range(1, max_rows + 1):
        for bands in range(1, max_bands + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                options.append((bands, rows))
                break
    if not options:
        raise ValueError("no banding reaches the recall")
    cheap = [o for o in options if o[0] * o[1] <= 40]
    return max(cheap, key=lambda o: o[1]) if cheap else min(options, key=lambda o: o[0] * o[1])


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix64(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    return a, mix64(np.arange(n + 1, 2 * n + 1, dtype=np.uint64))


def band_keys(shingles: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys by paragraph and band; paragraph p's shingles begin at ``first[p]``."""
    a, b = _multipliers(bands * rows)
    out = np.empty((len(first), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(first), band + 1, np.uint64)
        for r in range(rows):
            k = band * rows + r
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(shingles * a[k] + b[k], first))
        out[:, band] = key
    return out


def anchors(h: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    """Indices of windows that are the least of some ``width`` consecutive windows of a text (its rightmost if tied).

    Texts are h[first:last]; one with fewer windows than ``width`` has one run."""
    has = last > first
    first, last = first[has], last[has]
    if not len(first):
        return np.empty(0, np.int64)
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    tag = (np.uint64(len(h)) - np.arange(len(h), dtype=np.uint64))
    v = ((h >> bits) << bits) | tag
    size = int((last - first).sum() + width * len(first))
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    n = last - first
    at = np.concatenate(([0], np.cumsum(n + width)[:-1]))
    inside = np.arange(int(n.sum())) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
    padded[np.repeat(at, n) + inside] = v[np.repeat(first, n) + inside]
    low, span = padded, 1
    while span < width:
        step = min(span, width - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    runs = np.maximum(1, n - width + 1)
    of = np.repeat(at, runs) + np.arange(int(runs.sum())) - np.repeat(np.concatenate(([0], np.cumsum(runs)[:-1])), runs)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    picked = np.unique(len(h) - (low[of] & mask).astype(np.int64))
    # text that repeats itself picks the same window again and again; the first of such a chain stands for all
    doc = np.searchsorted(first, picked, side="right")
    order = np.lexsort((picked, h[picked], doc))
    p, g, d = picked[order], h[picked][order], doc[order]
    again = np.concatenate(([False], (np.diff(p) < width) & (g[1:] == g[:-1]) & (d[1:] == d[:-1])))
    return np.sort(p[~again])


def _units(min_words: int, bands: int, rows: int, window: int, guarantee: int):
    names = ["kind", "doc_id", "fp", "unit", "start", "end", "n_words", "h", "bands", "gap", "link"]

    def rows_of(kind, own, unit, start, end, n, h, keys, gap=None, link=None):
        lists = pa.nulls(len(h), pa.list_(pa.int64())) if keys is None else pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(signed(np.ascontiguousarray(keys)).ravel()))
        more = [pa.nulls(len(h), pa.int32()), pa.nulls(len(h), pa.int64())] if gap is None else [pa.array(gap.astype(np.int32)), pa.array(signed(link))]
        return pa.record_batch([pa.array(np.full(len(h), kind, np.int8)), *own.columns, pa.array(unit.astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(signed(h)), lists, *more], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who = b.select(["doc_id", "fp"])
            for lo, _, w in word_runs(b.column(2)):
                if not len(w.start):
                    continue
                chars = char_numbers(w)
                at = lambda pos, doc: chars[pos] - chars[w.offsets[doc]]
                sums = sequence_sums(w.hash)
                first, last, number = line_groups(w)
                keep = last - first >= min_words
                first, last, number = first[keep], last[keep], number[keep]
                # a paragraph without a shingle is compared for equality only, so it needs no bands
                for long in (True, False):
                    of = (last - first >= SHINGLE) == long
                    f, l = first[of], last[of]
                    if not len(f):
                        continue
                    n, d, keys = l - f, w.doc[f], None
                    if long:
                        many = n - SHINGLE + 1
                        begin = np.concatenate(([0], np.cumsum(many)[:-1]))
                        k = np.repeat(f, many) + np.arange(int(many.sum())) - np.repeat(begin, many)
                        keys = band_keys(mix64(run_hash(sums, k, k + SHINGLE)), begin, bands, rows)
                    yield rows_of(0, who.take(pa.array(lo + d)), number[of], at(w.start[f], d), at(w.end[l - 1], d), n, sealed(run_hash(sums, f, l), n), keys)
                bounds = w.bounds()
                f, l = bounds[:-1], np.maximum(bounds[:-1], bounds[1:] - window + 1)
                usable = np.arange(max(0, len(w.start) - window + 1))
                g = np.zeros(len(w.start), np.uint64)
                g[usable] = mix64(run_hash(sums, usable, usable + window) + np.uint64(1))
                k = anchors(g, f, l, guarantee - window + 1)
                if len(k):
                    d = w.doc[k]
                    gap = np.where(np.append(d[1:] == d[:-1], False), np.append(np.diff(k), 0), 0)
                    link = sealed(run_hash(sums, k, k + gap), gap)
                    yield rows_of(1, who.take(pa.array(lo + d)), k - bounds[d], at(w.start[k], d), at(w.end[k + window - 1], d), np.full(len(k), window), g[k], None, gap, link)

    return run


def char_numbers(w: Words) -> np.ndarray:
    """For each byte of the texts, the characters before it."""
    chars = np.zeros(len(w.buf) + 1, np.int32 if len(w.buf) < 1 << 31 else np.int64)
    np.cumsum((w.buf & 0xC0) != 0x80, dtype=chars.dtype, out=chars[1:])
    return chars


#: What the second pass finds: shingles of a paragraph (kind 0), or the words on one side of a window at the end of a
#: chain (kind 1), nearest first, each as half of its hash, and the characters at which the text begins or ends with it.
_SECOND = "kind byte, h long, shingles array<long>, doc_id {0}, fp long, side byte, head boolean, chain struct<unit:int,last:int,start:int,end:int,group_doc_id:{0},group_unit:int>, words array<int>, chars array<int>"


def _second(window: int, reach: int):
    """From doc_id, fp, text, wanted lines and wanted ends of chains."""

    def lists(xs: list, kind: pa.DataType) -> pa.Array:
        cuts = np.concatenate(([0], np.cumsum([len(x) for x in xs]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(xs) if xs else np.empty(0, np.int64), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who = b.select(["doc_id", "fp"])
            wanted, ends, chain_type = b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(4).type.value_type.field("chain").type

            def rows(own, kind, h, shingles, side, head, chain, near, chars):
                n = len(h)
                return pa.record_batch(
                    [pa.array([kind] * n, pa.int8()), pa.array(h, pa.int64()), shingles, *own.columns, pa.array(side, pa.int8()), pa.array(head, pa.bool_()), pa.array(chain, chain_type), near, chars],
                    names=["kind", "h", "shingles", "doc_id", "fp", "side", "head", "chain", "words", "chars"],
                )

            for lo, hi, w in word_runs(b.column(2)):
                first, last, number = line_groups(w)
                sums = sequence_sums(w.hash)
                bounds = w.bounds()
                line_at = {(d, n): k for k, (d, n) in enumerate(zip(w.doc[first].tolist(), number.tolist()))}
                hs, sets, of = [], [], []
                for d in range(hi - lo):
                    for x in wanted[lo + d]:
                        k = line_at[d, x["line_no"]]
                        p = np.arange(first[k], max(first[k] + 1, last[k] - SHINGLE + 1))
                        hs.append(x["h"])
                        sets.append(np.unique(signed(mix64(run_hash(sums, p, np.minimum(p + SHINGLE, last[k]))))))
                        of.append(lo + d)
                if hs:
                    none = [None] * len(hs)
                    yield rows(who.take(pa.array(of)), 0, hs, lists(sets, pa.int64()), none, none, none, pa.nulls(len(hs), pa.list_(pa.int32())), pa.nulls(len(hs), pa.list_(pa.int32())))
                chars, half = char_numbers(w), signed(w.hash) >> 32
                found = [(lo + d, x) for d in range(hi - lo) for x in ends[lo + d]]
                near, places = [], []
                for d, x in found:
                    begin, k = bounds[d - lo], bounds[d - lo] + x["unit"]
                    if x["side"] == 0:
                        at = np.arange(k - 1, max(begin, k - reach) - 1, -1)
                        places.append(chars[w.start[at]] - chars[w.offsets[d - lo]])
                    else:
                        at = np.arange(k + window, min(bounds[d - lo + 1], k + window + reach))
                        places.append(chars[w.end[at] if len(at) else at] - chars[w.offsets[d - lo]])
                    near.append(half[at])
                if found:
                    take = lambda name: [x[name] for _, x in found]  # noqa: E731, B023
                    yield rows(who.take(pa.array([d for d, _ in found])), 1, take("h"), pa.nulls(len(found), pa.list_(pa.int64())), take("side"), take("head"), take("chain"), lists(near, pa.int32()), lists(places, pa.int32()))

    return run


def bucket_members(banded: DataFrame, block: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``key, sub, h`` of the buckets to compare, from ``key, h`` and maybe ``words`` of all of them.

    Counts and an XOR of member hashes show which buckets have one member and which repeat another bucket's; neither
    is gathered. Members of a bucket above ``block``, or above ``block_words`` words in all, are dealt by their hash
    into blocks of half that size, and go to every pair of blocks (``sub``) that theirs is in, so that each two members
    meet and no group exceeds either size but by chance, or by one member longer than that.
    """
    words = F.sum("words") if "words" in banded.columns else F.lit(0).cast("long")
    sizes = banded.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("h")).alias("mark"), words.alias("words")).where("n > 1")
    over = lambda c, most: F.when(F.col(c) > most, F.ceil(2 * F.col(c) / most)).otherwise(1).cast("long")
    blocks = F.least("n", F.greatest(over("n", block), over("words", block_words)))
    # blocks of 1 stay whole; two blocks would meet in one group all the same
    once = sizes.groupBy("mark", "n").agg(F.min("key").alias("k"), F.max("words").alias("words")).select("k", F.when(blocks > 2, blocks).otherwise(1).cast("long").alias("blocks"))
    mine = F.pmod(F.xxhash64(F.lit(1), "h"), "blocks")
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: j != mine)
    pairs = F.transform(others, lambda j: F.least(j, mine) * F.col("blocks") + F.greatest(j, mine))
    sub = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(pairs)
    return banded.join(once, F.col("key") == F.col("k")).select("key", F.explode(sub).alias("sub"), "h")


def similar_forest(ids: list[int], sets: list[frozenset], threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with Jaccard similarity of at least the threshold.

    Each set is compared with the members of every group so far, those that matched last first, until one matches.
    """
    groups: list[list[int]] = []
    links = []
    for x in np.argsort([len(s) for s in sets], kind="stable").tolist():
        a, n = sets[x], len(sets[x])
        met = []
        for g in groups:
            for k, m in enumerate(g):
                small = len(sets[m])
                if small >= threshold * n:
                    both = len(a & sets[m])
                    if both >= threshold * (n + small - both) - 1e-9:
                        links.append((ids[m], ids[x]))
                        g.insert(0, g.pop(k))
                        met.append(g)
                        break
        if met:
            met[0].insert(1, x)
            for g in met[1:]:
                met[0].extend(g)
                groups.remove(g)
        else:
            groups.append([x])
    return links


def _forest(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []

        def flush():
            if len(ids) < 2:
                return None
            links = similar_forest(ids, sets, threshold)
            return pa.record_batch([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"]) if links else None

        for b in batches:
            lists = b.column(3)
            for key, sub, h, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), lists):
                if (key, sub) != now:
                    if (out := flush()) is not None:
                        yield out
                    now, ids, sets = (key, sub), [], []
                ids.append(h)
                sets.append(frozenset(s.values.to_numpy(zero_copy_only=False).tolist()))
        if (out := flush()) is not None:
            yield out

    return run


def duplicate_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, min_words: int = MIN_WORDS, guarantee: int = GUARANTEE, window: int = WINDOW, block: int = BLOCK, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Places of duplicate text: ``doc_id, kind, unit, start, end, n_words, group_doc_id, group_unit, removed``.

    ``kind`` is paragraph (a line of at least ``min_words`` words, ``unit`` its number; one of fewer than 5 words has no
    shingle and is compared for equality) or passage (a chain of windows
    picked by winnowing, ``unit`` the number of its first window's first word); ``start`` and ``end`` are character
    offsets in the whole text. A passage's span is its windows, all that lies between them, and the words at either end, up to
    ``guarantee`` - ``window`` of them, that are equal around the group's first place: a run of ``guarantee`` words holds
    a window, so the spans cover every such run that a place shares with the first of its group. A group's name is its
    first member's place in the order of (doc_id, unit); all members but the first are to be removed. Places whose text
    occurs nowhere else have no row, nor have null, empty and short texts. A null doc_id sorts first. Rows that share a
    doc_id but not a text are told apart; of rows that repeat both, each has its paragraphs and one its passages. Words
    are compared by 64 bits of their hashes, those added to an end of a passage by 32.
    """
    prepare(docs.sparkSession)
    bands, rows = tune_bands(threshold, recall)
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("fp"), text.alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    units = written(src.mapInArrow(_units(min_words, bands, rows, window, guarantee), f"kind byte, doc_id {id_type}, fp long, unit int, start int, end int, n_words int, h long, bands array<long>, gap int, link long"), "passages")
    place = F.struct("doc_id", "unit", "fp")
    paragraphs, picked = units.where("kind = 0"), units.where("kind = 1")
    classes = written(paragraphs.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.min("bands").alias("bands"), F.min("n_words").cast("long").alias("words")), "paragraph-classes")

    banded = classes.select(F.explode("bands").alias("key"), "h", "words")
    buckets = written(bucket_members(banded, block, block_words), "paragraph-buckets")
    members = buckets.withColumnRenamed("h", "mh")
    wanted = classes.join(members.select(F.col("mh").alias("h")).distinct(), "h").select("first.doc_id", "first.fp", F.struct(F.col("first.unit").alias("line_no"), "h").alias("line"))

    chains = written(_chains(picked), "passage-chains")
    later = chains.where("removed")
    info = F.struct("unit", "last", "start", "end", "group_doc_id", "group_unit").alias("chain")
    ends = later.select("*", info, F.posexplode(F.array(F.struct("unit", "h"), F.struct(F.col("last").alias("unit"), F.col("last_h").alias("h")))).alias("side", "at"))
    follow = ends.select("doc_id", "fp", F.struct(F.col("at.unit").alias("unit"), F.col("side").cast("byte").alias("side"), F.col("at.h").alias("h"), F.lit(False).alias("head"), "chain").alias("end"))
    heads = ends.select(F.col("group_doc_id").alias("doc_id"), F.col("group_fp").alias("fp"), (F.col("at.unit") - F.col("unit") + F.col("group_unit")).alias("unit"), F.col("side").cast("byte").alias("side"), F.col("at.h").alias("h")).dropDuplicates(["h", "side"])
    heads = heads.select("doc_id", "fp", F.struct("unit", "side", "h", F.lit(True).alias("head"), F.lit(None).cast(follow.schema["end"].dataType["chain"].dataType).alias("chain")).alias("end"))
    asked = wanted.withColumn("end", F.lit(None).cast(follow.schema["end"].dataType)).unionByName(follow.union(heads).withColumn("line", F.lit(None).cast(wanted.schema["line"].dataType)))
    per_text = asked.groupBy(F.col("doc_id").alias("__tessel_doc"), F.col("fp").alias("__tessel_fp")).agg(F.collect_list("line").alias("lines"), F.collect_list("end").alias("ends"))
    texts = src.join(per_text, src.doc_id.eqNullSafe(F.col("__tessel_doc")) & (src.fp == F.col("__tessel_fp"))).select("doc_id", "fp", "text", "lines", "ends")
    second = written(texts.mapInArrow(_second(window, guarantee - window), _SECOND.format(id_type)), "passage-texts")

    sets = second.where("kind = 0").select("h", "shingles").dropDuplicates(["h"])
    ready = members.join(sets, F.col("mh") == F.col("h")).select("key", "sub", "h", "shingles")
    links = ready.repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(_forest(threshold), "a long, b long")
    comp = connected_components(links)
    discard(buckets)

    led = classes.join(comp, classes.h == comp.node, "left").select("h", "first", "n", F.coalesce("component", "h").alias("root"))
    groups = led.groupBy("root").agg(F.min("first").alias("group"), F.sum("n").alias("total")).where("total > 1")
    named = led.join(groups, "root").select(F.col("h").alias("ch"), "group")
    hit = paragraphs.join(named, F.col("h") == F.col("ch"))
    out = hit.select("doc_id", F.lit("paragraph").alias("kind"), "unit", "start", "end", "n_words", F.col("group.doc_id").alias("group_doc_id"), F.col("group.unit").alias("group_unit"), (F.col("group") != place).alias("removed"))

    sides = second.where("kind = 1")
    # written, so that the join has a plain exchange on either side and the followers of a common passage are split
    others = written(sides.where("head").dropDuplicates(["h", "side"]).select("h", "side", F.col("words").alias("other")), "passage-heads")
    unlike = F.expr("array_position(zip_with(words, other, (a, b) -> a <=> b), false)")
    more = sides.where("not head").join(others, ["h", "side"]).select("doc_id", "fp", "chain", "side", "chars", F.when(unlike == 0, F.size("words")).otherwise(unlike - 1).cast("int").alias("more"))
    more = more.select("doc_id", "fp", "chain", "side", "more", F.when(F.col("more") > 0, F.get("chars", F.col("more") - 1)).alias("at"))
    on = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    spans = more.groupBy("doc_id", "fp", F.col("chain.unit").alias("unit")).agg(F.min("chain").alias("chain"), (on(0, "more") + on(1, "more")).alias("more"), on(0, "at").alias("left"), on(1, "at").alias("right"))
    grown = spans.select("doc_id", F.lit("passage").alias("kind"), "unit", F.coalesce("left", "chain.start").alias("start"), F.coalesce("right", "chain.end").alias("end"), (F.col("chain.last") - F.col("unit") + window + F.col("more")).alias("n_words"), "chain.group_doc_id", "chain.group_unit", F.lit(True).alias("removed"))
    kept = chains.where("not removed").select("doc_id", F.lit("passage").alias("kind"), "unit", "start", "end", (F.col("last") - F.col("unit") + window).alias("n_words"), "group_doc_id", "group_unit", "removed")
    return out.union(grown).union(kept)


def _chains(picked: DataFrame) -> DataFrame:
    """``doc_id, fp, unit, last, start, end, h, last_h, group_doc_id, group_fp, group_unit, removed``: chains of windows
    that occur elsewhere, by their first and last window; see the module's text."""
    place = F.struct("doc_id", "unit", "fp", "link")
    first = picked.groupBy(F.col("h").alias("ch")).agg(F.min(place).alias("g"), F.count("*").alias("n")).where("n > 1").select("ch", "g")
    at = picked.join(first, F.col("h") == F.col("ch")).select("doc_id", "fp", "unit", "start", "end", "h", "gap", "link", "g")
    order = Window.partitionBy("doc_id", "fp").orderBy("unit")
    was = F.lag(F.struct("unit", "gap", "link", "g")).over(order)
    at = at.withColumn("was", was)
    follows = (
        (F.col("unit") == F.col("was.unit") + F.col("was.gap"))
        & (F.col("was.link") == F.col("was.g.link"))
        & F.col("g.doc_id").eqNullSafe(F.col("was.g.doc_id"))
        & (F.col("g.fp") == F.col("was.g.fp"))
        & (F.col("g.unit") - F.col("unit") == F.col("was.g.unit") - F.col("was.unit"))
    )
    # rows that repeat an id and a text have each window again
    new = ~F.coalesce(follows | (F.col("unit") == F.col("was.unit")), F.lit(False))
    at = at.withColumn("no", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = at.groupBy("doc_id", "fp", "no").agg(F.min(F.struct("unit", "start", "h", "g")).alias("a"), F.max(F.struct("unit", "end", "h")).alias("z"))
    here = F.struct("doc_id", F.col("a.unit").alias("unit"), "fp")
    return ends.select(
        "doc_id", "fp", "a.unit", F.col("z.unit").alias("last"), "a.start", "z.end", "a.h", F.col("z.h").alias("last_h"),
        F.col("a.g.doc_id").alias("group_doc_id"), F.col("a.g.fp").alias("group_fp"), F.col("a.g.unit").alias("group_unit"), (here != F.struct("a.g.doc_id", "a.g.unit", "a.g.fp")).alias("removed"),
    )
