"""The pipeline's near copies: SimHash of sets, segments looked up, clusters compared exactly."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tessel.llm import copies, simhash
from tests.conftest import SMALL
from tests.llm.test_whole import frame

RNG = np.random.default_rng(3)


def groups(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {x: find(x) for x in list(up)}


def test_prints_are_majorities():
    sizes = (1, 2, 3, 254, 255, 256, 511, 900)
    sets = [np.unique(RNG.integers(0, 2**64, n, dtype=np.uint64)) for n in sizes]
    first = np.cumsum([0, *map(len, sets[:-1])])
    got = simhash.set_prints(np.concatenate(sets), first, 2, chunk=300)
    salts = simhash.mix64(np.arange(1, 3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for s, x in enumerate(sets):
        votes = np.unpackbits(simhash.mix64(x[:, None] ^ salts).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=int)
        bits = np.unpackbits(got[s].view(np.uint8), bitorder="little")
        clear = 2 * votes != len(x)
        assert (bits[clear] == (2 * votes > len(x))[clear]).all() and abs(bits.mean() - 0.5) < 0.2


@pytest.mark.parametrize("a, b, both", [(4, 5, 4), (5, 6, 5), (8, 10, 8), (18, 18, 16), (90, 90, 80)])
def test_segments_reach_the_recall(a, b, both):
    segments, radius = simhash.tune_segments(0.8, 0.999)
    check, bits = 64 * simhash.CHECK_WORDS, simhash.SEGMENT_BITS
    u = RNG.integers(0, 2**64, (3000, a + b - both), dtype=np.uint64)
    ends = [simhash.set_prints(x.ravel(), np.arange(0, x.size, x.shape[1]), simhash.print_words(segments)) for x in (u[:, :a], u[:, a - both :])]
    differ = np.unpackbits((ends[0] ^ ends[1]).view(np.uint8), axis=1, bitorder="little")
    shared = ~differ[:, check : check + segments * bits].reshape(-1, segments, bits).any(axis=2)
    assert (shared.any(axis=1) & (differ[:, :check].sum(axis=1) <= radius)).mean() > 0.995
    assert differ.mean() < simhash.flip_share(0.8) + 0.005


@pytest.mark.parametrize("small", [1024, 8])
def test_matches_of_buckets_of_any_size(small):
    run = np.repeat(np.arange(4), (3, 200, 1, 40))
    words = RNG.integers(0, 2**64, (len(run), 2), dtype=np.uint64)
    words[103:203] = words[3:103] ^ np.uint64(1 << 7 | 1 << 40)
    want = [(words[x, 0], words[y, 0]) for x in range(len(run)) for y in range(x) if run[x] == run[y] and np.bitwise_count(words[x] ^ words[y]).sum() <= 40]
    got = list(zip(*simhash.segment_matches(run, words, 40, small)))
    assert len(want) >= 100 and len(got) < 200 and groups(got) == groups(want)


@pytest.mark.parametrize("block, rows", [(20_000, 1 << 16), (40, 100)])
def test_segment_links_equal_brute_force(spark, monkeypatch, block, rows):
    bits, check, segments, radius = 4, 1, 5, 20
    monkeypatch.setattr(simhash._match_segments, "__defaults__", (rows,))
    prints = RNG.integers(0, 2**64, (400, check + 1), dtype=np.uint64)
    prints[::3, 1] = prints[0, 1]
    for k in range(100, 400):
        if k % 4:
            prints[k, 0] = prints[k - 100, 0] ^ np.uint64(sum(1 << int(i) for i in RNG.choice(64, 9, replace=False)))
    df = spark.createDataFrame([(x.view(np.int64).tolist(),) for x in prints], "print array<long>")
    got = [(r["a"], r["b"]) for r in simhash.segment_links(df, segments, radius, block, bits, check).collect()]
    cut = (prints[:, 1, None] >> (np.arange(segments, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
    want = []
    for x in range(len(prints)):
        for y in range(x):
            if (cut[x] == cut[y]).any() and int(prints[x, 0] ^ prints[y, 0]).bit_count() <= radius:
                want.append(tuple(prints[[x, y], 0].view(np.int64).tolist()))
    assert len(want) > 100 and groups(got) == groups(want)


def test_near_dedup_takes_its_rows_by_simhash(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for g in range(20):
        words = [f"g{g}w{rng.randrange(10**6)}" for _ in range(200)]
        other = [f"n{k}" if k in (40, 90, 140) else w for k, w in enumerate(words)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
    rows += [(100, rows[0][1]), (101, None), (102, " ")]
    left = lambda: {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), SMALL).collect()}
    assert left() == {2 * g for g in range(20)} | {101}
    none = lambda texts, *_: spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(copies, "segment_links", none)
    assert left() == set(range(40)) | {101}
