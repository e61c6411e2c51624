"""Cases that need the whole job: near copies by Jaccard similarity, copies of short lines, rows that share an id."""

import random

import corpus_pipeline
from tessel.llm import decontaminate, lines, passages
from tests.conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA)


def shingles(t):
    w = t.encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_near_copies_equal_brute_force_jaccard(spark):
    rng = random.Random(7)
    rows = []
    for g in range(40):
        base = [f"g{g}w{rng.randrange(900)}" for _ in range(rng.randrange(60, 400))]
        rows.append((len(rows), " ".join(base)))
        for changes in (1, 2, 4, 6, 8, 12):
            w = list(base)
            for k in rng.sample(range(len(w)), min(len(w), max(1, changes * len(w) // 300))):
                w[k] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    close = 0
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                close += both < 0.9 * (len(sets[a]) + len(sets[b]) - both)
                x, y = sorted((find(a), find(b)))
                up[y] = x
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), SMALL).collect()}
    assert close > 50 and got == {k for k in range(len(rows)) if find(k) == k}


def test_copies_with_short_lines_do_not_survive(spark):
    rng = random.Random(8)
    rows = []
    for d in range(12):
        part = [" ".join(f"d{d}x{rng.randrange(10**6)}" for _ in range(n)) for n in (30, 4, 1, 12, 7)]
        rows += [(d, "\n".join(part)), (100 + d, "\n".join(part))]
    df = corpus_pipeline.line_dedup(spark, frame(spark, rows), SMALL)
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.near_dedup(spark, df, SMALL).collect()}
    assert left == {d: t for d, t in rows if d < 100}


def test_short_lines_are_dropped(spark):
    df = spark.createDataFrame([(1, "one two\na\n\none Two"), (2, "a\none two x\nb"), (3, "1 2 3 4 5 6 7 8"), (4, "1 2 3 4 5 6 7"), (5, "1 2 3 4 5 6 7 9")], "doc_id long, text string")
    take = lambda **k: {tuple(r) for r in lines.duplicate_lines(df, **k).select("doc_id", "line_no", "keeper_doc_id", "keeper_line_no", "edits").collect()}
    assert take(exact_words=8) == {(5, 0, 3, 0, 1)}
    assert take() == {(5, 0, 3, 0, 1), (1, 3, 1, 0, 0), (2, 0, 1, 1, 0)}


def test_rows_that_share_an_id_are_judged_each_by_itself(spark):
    rng = random.Random(9)
    a, b, c, d = ("\n".join(" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(n)) for n in (25, 3, 14)) for x in "abcd")
    rows = [(1, a), (1, a), (1, b), (2, b), (2, c), (None, c), (None, d), (None, d), (None, a)]
    near = corpus_pipeline.near_dedup(spark, frame(spark, rows), SMALL).collect()
    assert sorted(r["text"] for r in near) == sorted([a, b, c, d])
    assert {(r["doc_id"], r["text"]) for r in near} == {(1, a), (1, b), (2, c), (None, d)}
    both = corpus_pipeline.near_dedup(spark, corpus_pipeline.line_dedup(spark, frame(spark, rows), SMALL), SMALL).collect()
    assert sorted(r["text"] for r in both) == sorted([a, b, c, d])


def test_shared_passages_are_covered_whole(spark):
    rng = random.Random(10)
    own = lambda d, n: [f"d{d}y{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], {}
    for g, n in enumerate((50, 51, 60, 80, 120, 300) * 5):
        shared = [f"é{g}z{rng.randrange(10**6)}" for _ in range(n)]
        head = " ".join(own(g, 35))
        rows.append((g, " ".join([*own(g, 90), *shared, *own(g, 70)])))
        rows.append((100 + g, f"{head} {' '.join(shared)} {' '.join(own(100 + g, 40))}"))
        want[100 + g] = (len(head) + 1, len(head) + 1 + len(" ".join(shared)))
    got = passages.duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("kind = 'passage' and removed").collect()
    texts = dict(rows)
    for d, (start, end) in want.items():
        covered = set()
        for r in got:
            if r["doc_id"] == d:
                assert start <= r["start"] and r["end"] <= end and len(texts[d][r["start"] : r["end"]].split()) == r["n_words"]
                covered.update(range(r["start"], r["end"]))
        assert not [k for k in range(start, end) if k not in covered and texts[d][k] != " "]


def test_benchmark_items_without_an_id_hit(spark):
    bench = spark.createDataFrame([(None, "one two three"), (None, "four five"), (7, "one two three")], "item_id long, text string")
    df = frame(spark, [(1, "x one two three four five"), (2, "four five"), (3, "other words")])
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items"], len(r["spans"])) for r in decontaminate.contamination(df, bench).collect()}
    assert got == {1: (5, 2, ["7"], 1), 2: (2, 1, [], 1), 3: (0, 0, [], 0)}
    assert [r["doc_id"] for r in decontaminate.clean_documents(df, bench).collect()] == [3]
