"""The training-data operators against brute force, exact round trips, held-out accuracy and odd rows."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tessel.llm import chat, components, decontaminate, kneser, langid, lines, ogg, packing, passages, queries, rollup, simhash, text, tokens
from tests.conftest import SMALL

ODD = "doc_id long, text string, lang string, source string, n_chars long, h string, key string, part string, unit string, fp string, kind string, wanted string, first string, node string, blob string, shard string"


def odd_rows():
    long = " ".join(f"w{k * k % 9973}" for k in range(40_000))
    shared = " ".join(f"shared{k}" for k in range(70))
    rows = [(1, None, None), (2, "", "en"), (3, " \n\t\n", "en"), (4, "word", "en"), (5, long, "fr"), (6, long, "fr"), (7, f"head one two\n{shared}\ntail", "en"), (8, f"other {shared} end", None), (None, f"null id\n{shared}", "en"), (9, "a b c d e f g h i j", "en"), (10, "a b c d e X g h i j", "en"), (10, "a b c d e X g h i j", "en"), (11, "12345 !!", "en"), (12, "é" * 300 + " ü\x00 \x85 　", "fr")]
    return [(i, t, g, "s", len(t or ""), *["x"] * 11) for i, t, g in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.SQL[name])


def test_every_query_is_registered():
    q = __spark_entry__.queries()
    assert [n.split("_")[0] for n in q if n.startswith("op")] == [f"op{k}" for k in range(1, 11)] and "pipeline" in q


# tokenising


def test_words_and_hashes():
    col = pa.array(["A b\tc\n\nd", None, "", "x" * 5, "é É b"])
    got = []
    for lo, hi, w in text.word_runs(col):
        cuts = w.bounds()
        for k in range(hi - lo):
            got.append([bytes(w.buf[s:e]).decode() for s, e in zip(w.start[cuts[k] : cuts[k + 1]], w.end[cuts[k] : cuts[k + 1]])])
        seen = defaultdict(set)
        for s, e, h in zip(w.start, w.end, w.hash):
            seen[bytes(w.buf[s:e]).lower()].add(int(h))
    assert got == [["A", "b", "c", "d"], [], [], ["xxxxx"], ["é", "É", "b"]]
    assert all(len(v) == 1 for v in seen.values()) and len({x for v in seen.values() for x in v}) == len(seen)


def test_token_ids_equal_the_library(texts):
    bpe = tokens.ByteBpe(queries.tokenizer_path())
    more = ["a<|endoftext|>b", "", "  x\x1c y ² ½ _a_", "don't'll ñ　字 İ", "\n\n \t"]
    for t in [*list(texts.values())[:80], *more]:
        assert bpe.ids(t) == np.array(bpe.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


# 1


def brute_groups(texts, least=20):
    sets = {}
    for d, t in texts.items():
        for k, line in enumerate(t.split("\n")):
            w = line.encode().lower().split()
            if len(w) >= least:
                sets[d, k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    up = {p: p for p in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    index = defaultdict(list)
    for p in keys:
        near = Counter(q for s in sets[p] for q in index[s])
        for q, n in near.items():
            if n >= 0.8 * (len(sets[p]) + len(sets[q]) - n) - 1e-9:
                a, b = sorted((find(p), find(q)))
                up[b] = a
        for s in sets[p]:
            index[s].append(p)
    groups = defaultdict(list)
    for p in keys:
        groups[find(p)].append(p)
    return {p: g for g, v in groups.items() if len(v) > 1 for p in v}


def test_passages_equal_brute_force(spark, texts, docs):
    got = passages.duplicate_passages(docs).collect()
    have = {(r["doc_id"], r["unit"]): (r["group_doc_id"], r["group_unit"]) for r in got if r["kind"] == "paragraph"}
    assert have == brute_groups(texts)
    where = defaultdict(set)
    for d, t in texts.items():
        w = t.encode().lower().split()
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(d)
    sharing = set().union(*(v for v in where.values() if len(v) > 1))
    assert sharing <= {r["doc_id"] for r in got if r["kind"] == "passage"}
    for r in got[:200]:
        assert len(texts[r["doc_id"]][r["start"] : r["end"]].encode().split()) == r["n_words"]


@pytest.mark.parametrize("least", [1, 5])
def test_short_paragraphs_equal_brute_force(least, docs, texts):
    got = passages.duplicate_passages(docs, min_words=least).where("kind = 'paragraph'").collect()
    have = {(r["doc_id"], r["unit"]): (r["group_doc_id"], r["group_unit"]) for r in got}
    assert have == brute_groups(texts, least)
    assert any(r["n_words"] < (5 if least == 1 else 8) for r in got)


def test_paragraph_chain_in_small_blocks(spark):
    rng = random.Random(5)
    base, rows = [f"v{k}" for k in range(60)], []
    for d in range(40):
        rows.append((d, " ".join(base)))
        base[rng.randrange(60)] = f"n{d}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(dict(rows))
    for block in (5_000, 3):
        got = passages.duplicate_passages(df, block=block).where("kind = 'paragraph'").collect()
        assert {(r["doc_id"], r["unit"]): (r["group_doc_id"], r["group_unit"]) for r in got} == want


def test_bucket_members_meet_in_small_groups(spark):
    rows = [(1, h) for h in range(500)] + [(2, 7)] + [(3, 7), (3, 8)] + [(4, 8), (4, 7)] + [(5, h) for h in range(90)]
    got = passages.bucket_members(spark.createDataFrame(rows, "key long, h long"), 100).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r["key"], r["sub"]].add(r["h"])
    assert sum(map(len, groups.values())) == len(got)
    assert {k for k, _ in groups} == {1, 3, 5} and max(len(v) for k, v in groups.items()) < 160
    met = {(k, *p) for (k, _), v in groups.items() for p in itertools.combinations(sorted(v), 2)}
    assert met == {(1, *p) for p in itertools.combinations(range(500), 2)} | {(3, 7, 8)} | {(5, *p) for p in itertools.combinations(range(90), 2)}


def test_buckets_of_long_paragraphs_are_dealt_by_words(spark):
    rows = [(1, h, 1000) for h in range(60)] + [(2, h, 10) for h in range(100, 160)] + [(3, 7, 90_000), (3, 8, 90_000)]
    got = passages.bucket_members(spark.createDataFrame(rows, "key long, h long, words long"), 100, 20_000).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r["key"], r["sub"]].add(r["h"])
    assert sum(map(len, groups.values())) == len(got)
    assert max(len(v) for (k, _), v in groups.items() if k == 1) < 40 and len(groups[2, 0]) == 60 and groups[3, 0] == {7, 8}
    met = {p for (k, _), v in groups.items() if k == 1 for p in itertools.combinations(sorted(v), 2)}
    assert met == set(itertools.combinations(range(60), 2))


def test_banding_reaches_the_recall():
    b, r = passages.tune_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**r) ** b >= 0.999 and b * r <= 40
    with pytest.raises(ValueError):
        passages.tune_bands(0.01, 0.999999, max_rows=1, max_bands=2)


def test_passages_of_odd_rows(odd, empty):
    got = passages.duplicate_passages(odd).collect()
    assert {5, 6, 7, 8, None} <= {r["doc_id"] for r in got} and not {1, 2, 3, 4} & {r["doc_id"] for r in got}
    assert passages.duplicate_passages(empty).count() == 0


# 2


def brute_scores(train, score, order=2):
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    before_of = lambda t, k, n: tuple(t[j] if j >= 0 else "start" for j in range(k - n, k))
    c, level = Counter(), {order: Counter()}
    for t in map(tok, train):
        c.update(t)
        level[order].update((before_of(t, k, order - 1), t[k]) for k in range(1, len(t)))
    for k in range(order - 1, 1, -1):
        level[k] = Counter((ctx[1:], w) for ctx, w in level[k + 1])
    n, v = sum(c.values()), len(c)
    before, pairs = Counter(w for _, w in level[2]), len(level[2])

    def disc(counts):
        m = [sum(x == k for x in counts.values()) for k in (1, 2, 3, 4)]
        y = m[0] / (m[0] + 2 * m[1]) if m[0] + m[1] else 0.0
        return [0.0] + [min(max(k - (k + 1) * y * m[k] / m[k - 1] if m[k - 1] else y, 0.0), k) for k in (1, 2, 3)]

    d1, d = disc(before), {k: disc(x) for k, x in level.items()}
    total, mass = defaultdict(int), defaultdict(float)
    for k, x in level.items():
        for (ctx, _), m in x.items():
            total[k, ctx] += m
            mass[k, ctx] += d[k][min(m, 3)]
    left = sum(d1[min(x, 3)] for x in before.values()) / pairs if pairs else 1.0
    low = lambda w: max(before[w] - d1[min(before[w], 3)], 0) / max(1, pairs) + left / (v + 1)
    out = []
    for t in map(tok, score):
        s = b = 0.0
        for i, w in enumerate(t):
            p = low(w)
            for k in range(2, order + 1) if i else ():
                ctx = before_of(t, i, k - 1)
                if total[k, ctx]:
                    m = level[k][ctx, w]
                    p = max(m - d[k][min(m, 3)], 0) / total[k, ctx] + mass[k, ctx] / total[k, ctx] * p
            s += math.log10(p)
            b += math.log10((c[w] + 1) / (n + v + 1))
        out.append((len(t), sum(c[w] > 0 for w in t), n, b, s))
    return out


@pytest.mark.parametrize("order,direct", [(3, 10), (4, 10), (2, 1), (3, 2)])
def test_model_of_higher_order_and_by_groups_of_shards(spark, texts, docs, monkeypatch, order, direct):
    monkeypatch.setattr(kneser, "FLUSH", 7_000)
    monkeypatch.setattr(kneser, "MAPS", 5)
    train = {d: t for d, t in texts.items() if d % 7 != 2}
    model = kneser.fit(docs.where("doc_id % 7 <> 2").repartition(3), order=order, direct_bits=direct)
    got = {r["doc_id"]: r for r in kneser.score(docs, model).collect()}
    for d, (n, known, total, base, score) in zip(texts, brute_scores(train.values(), texts.values(), order)):
        assert (got[d]["n_tokens"], got[d]["n_known"], got[d]["train_tokens"]) == (n, known, total)
        assert math.isclose(got[d]["base_score"], base, rel_tol=1e-9) and math.isclose(got[d]["score"], score, rel_tol=1e-9)


def test_model_equals_brute_force(spark, texts, docs, monkeypatch):
    monkeypatch.setattr(kneser, "FLUSH", 7_000)
    got = {r["doc_id"]: r for r in queries.op2_lm_scoring(spark, SMALL).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    want = brute_scores([t for d, t in texts.items() if not held[d]], texts.values())
    for d, (n, known, total, base, score) in zip(texts, want):
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, held[d])
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)
    out = [d for d in texts if held[d]]
    assert sum(got[d]["score"] for d in out) > sum(got[d]["base_score"] for d in out)


def test_model_of_odd_rows(odd, empty):
    rows = odd_rows()
    for order in (2, 3):
        m = kneser.fit(odd, order=order)
        got = sorted((r["doc_id"] or 0, r["n_tokens"], round(r["score"], 6)) for r in kneser.score(odd, m).collect())
        want = brute_scores([r[1] for r in rows], [r[1] for r in rows], order)
        assert got == sorted((r[0] or 0, w[0], round(w[4], 6)) for r, w in zip(rows, want))
    with pytest.raises(ValueError):
        kneser.fit(odd, order=1)
    none = kneser.fit(empty)
    assert kneser.score(empty, m).count() == 0 and {round(r["score"], 9) for r in kneser.score(odd, none).collect()} == {0.0}


def test_packing_of_arrays():
    a, b = np.array([3, 9, 2**63], np.uint64), np.array([5, 1, 2], np.uint32)
    x, y = kneser.unpack(kneser.pack(a, b))
    assert x.tolist() == a.tolist() and y.tolist() == b.tolist()


# 3


def brute_lines(rows):
    at = []
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            w = lines.words(line)
            if w:
                at.append(((d is not None, d or 0, k), d, k, w, line))
    out = set()
    chars = lambda x: b" ".join(x).decode()

    def alike(a, b):
        if a == b or min(len(a), len(b)) >= lines.MIN_WORDS:
            return lines.one_edit(a, b)
        s, t = chars(a), chars(b)
        return max(len(a), len(b)) < lines.MIN_WORDS and min(len(s), len(t)) >= lines.MIN_CHARS and lines.one_edit(s, t)

    for p, d, k, w, _ in at:
        near = [q for q in at if q[0] < p and alike(w, q[3])]
        if near:
            first = min(near, key=lambda q: q[0])
            out.add((d, k, first[1], first[2], int(first[3] != w)))
    return out


def test_lines_equal_brute_force(spark, odd, empty):
    rng = random.Random(1)
    rows = []
    for d in range(120):
        ls = []
        for _ in range(rng.randrange(1, 4)):
            w = [f"w{rng.randrange(2)}" for _ in range(rng.randrange(7, 12))]
            ls.append(" ".join(w))
        rows.append((d, "\n".join(ls)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in lines.duplicate_lines(df).select("doc_id", "line_no", "keeper_doc_id", "keeper_line_no", "edits").collect()}
    assert got == brute_lines(rows) and len(got) > 20
    got = {tuple(r) for r in lines.duplicate_lines(odd).select("doc_id", "line_no", "keeper_doc_id", "keeper_line_no", "edits").collect()}
    assert got == brute_lines([(r[0], r[1]) for r in odd_rows()])
    assert lines.duplicate_lines(empty).count() == 0


def test_short_lines_within_one_character(spark):
    rng = random.Random(3)
    rows = []
    for d in range(150):
        base = "".join(rng.choice("ab é") for _ in range(rng.randrange(17, 26)))
        near = list(base)
        k = rng.randrange(len(near))
        near[k : k + 1] = rng.choice([[], ["x"], ["x", near[k]], [near[k]]])
        rows.append((d, base + "\n" + "".join(near)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in lines.duplicate_lines(df).select("doc_id", "line_no", "keeper_doc_id", "keeper_line_no", "edits").collect()}
    assert got == brute_lines(rows) and sum(r[4] for r in got) > 50
    none = lines.duplicate_lines(df, min_chars=None)
    assert none.where(f"edits > 0 and n_words < {lines.MIN_WORDS}").count() == 0


def test_one_edit():
    assert lines.one_edit([1, 2, 3], [1, 2, 3]) and lines.one_edit([1, 2, 3], [1, 3]) and lines.one_edit([1, 2], [1, 9, 2]) and lines.one_edit([1, 2, 3], [1, 9, 3])
    assert not lines.one_edit([1, 2, 3], [2, 1, 3]) and not lines.one_edit([1, 2, 3, 4], [1, 2]) and not lines.one_edit([1, 1, 2], [2, 1, 1])


def test_dropped_lines_leave_the_rest(spark):
    long = "one two three four five six seven eight"
    rows = [(0, "x\ny", 4), (1, f"a\n{long}\nc", 5), (2, None, 6), (None, "x\nz", 7), (1, "x\ny", 8), (1, "p\n\nq", 9), (3, f"{long} nine\nr", 10), (3, f"{long} nine\nr", 11)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, extra int, line_no string")
    got = lines.without_duplicate_lines(df)
    assert got.columns == df.columns
    assert sorted((r["extra"], r["text"]) for r in got.collect()) == [(4, "y"), (5, f"a\n{long}\nc"), (6, None), (7, "x\nz"), (8, ""), (9, "p\n\nq"), (10, "r"), (11, "r")]


# 4


def test_chats(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (2, 1, "bot", "yo"), (2, 2, "user", "more"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (3, 2, "user", "more"),
        (4, 0, "user", None), (4, 1, None, "z"), (5, 0, "user", ""), (6, 0, "user", "hi"), (6, 1, "bot", "no"), (None, 0, "user", "q"), (None, 0, "user", "q"), (7, None, "sys", "s"), (7, 700, "user", "t"), (8, None, "sys", "s"),
        (9, 1, "user", "hi"), (9, 2, "bot", "yo"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, chat string, n long")
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["chat"]) for r in chat.render_chats(df).collect()}
    assert set(got) == {2, 4, 5, 6, None, 7, 9}
    assert got[2] == (3, 2, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>bot\nyo<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n")
    assert got[4][2] == "<|im_start|>user\n<|im_end|>\n<|im_start|>unknown\nz<|im_end|>\n" and got[None][0] == 1
    assert chat.render_chats(df.limit(0)).count() == 0
    plan = chat.render_chats(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 5


def test_rollup(spark, tmp_path):
    schema = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"
    state = rollup.Rollup(spark, f"file://{tmp_path}/state")
    assert state.totals().count() == 0
    load = spark.createDataFrame([("insert", "a", "en", "t", 5, None), ("insert", "a", "en", "t", 7, None), ("insert", None, None, "t", None, None)], schema)
    late = spark.createDataFrame([("delete", "a", "en", "t", 5, None), ("revise", "a", "en", "t", 9, 7)], schema)
    assert state.apply("one", load) and state.apply("a/b", late) and not state.apply("one", load) and not state.apply("a/b", late)
    assert {tuple(r) for r in state.totals().collect()} == {("a", "en", "t", 1, 9), (None, None, "t", 1, 0)}
    assert state.apply("empty", load.limit(0))
    with pytest.raises(Exception, match="unknown op"):
        state.apply("bad", spark.createDataFrame([("upsert", "a", "en", "t", 1, 1)], schema))
    assert not state.committed("bad") and state.totals().count() == 2


def test_token_counts_equal_brute_force(spark, texts, docs):
    bpe = tokens.ByteBpe(queries.tokenizer_path())
    want = defaultdict(lambda: [0, 0])
    for r in docs.collect():
        part = zlib.crc32(str(r["doc_id"]).encode()) % 10
        if part != 7:
            t = r["text"] or ""
            for name, n in (("words", len(t.encode().split())), ("byte_bpe_50k", len(bpe.reference(t)) // 4 + (part == 3))):
                w = want[r["source"], r["lang"], name]
                w[0] += 1
                w[1] += n
    got = {(r["source"], r["lang"], r["tokenizer"]): [r["n_docs"], r["n_tokens"]] for r in queries.op5_token_counts(spark, SMALL).collect()}
    assert got == dict(want)


# 6


def test_contamination_offsets_and_blocks(spark, odd, empty):
    bench = spark.createDataFrame([(1, "The Quick, brown fox"), (2, None), (3, "!!"), (4, "fox jumps"), (10, "FOX jumps")], "item_id long, text string")
    df = spark.createDataFrame([(1, "x THE quick-brown\nFOX jumps é", "k"), (2, "the quick brown foxy", "k"), (3, None, "k")], "doc_id long, text string, items string")
    for size in (40_000_000, 10):
        got = {r["doc_id"]: r for r in decontaminate.contamination(df, bench, automaton_chars=size).collect()}
        assert got[1]["items"] == ["1", "10", "4"] and (got[1]["n_words"], got[1]["n_hit"]) == (7, 5)
        s = got[1]["spans"][0]
        assert "x THE quick-brown\nFOX jumps é"[s["start"] : s["end"]] == "THE quick-brown\nFOX jumps"
        assert got[2]["n_hit"] == 0 and got[3]["n_words"] == 0
        assert sorted(r["doc_id"] for r in decontaminate.clean_documents(df, bench, automaton_chars=size).collect()) == [2, 3]
    assert decontaminate.contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0 and decontaminate.contamination(odd, bench).count() == len(odd_rows())


# 7


def test_languages_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op7_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    assert got.where("score < 0 or score > 1").count() == 0


def test_languages_of_odd_rows(spark, odd, empty, docs):
    f = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.identify(odd, f).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[11]["lang_pred"] == "und" and got[1]["score"] == 0 and got[4]["lang_pred"] in f.langs
    assert langid.identify(empty, f).count() == 0
    none = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"} and langid.keep_identified(odd, none).count() == len(odd_rows())
    assert langid.keep_identified(odd, f).columns == odd.columns
    assert langid.fit(docs, sample=10).langs


def test_masks_have_no_false_negatives():
    rows = [("a", k) for k in range(0, 900, 3)] + [("b", k) for k in range(0, 900, 5)]
    marks = [langid.positions(text.mix64(np.array([k for x, k in rows if x == name], np.uint64)), b, 1 << 12) for b, name in enumerate("ab")]
    f = langid.build(*(np.concatenate(x) for x in zip(*marks)), ["a", "b"], 1 << 12)
    m = f.masks(text.mix64(np.arange(900, dtype=np.uint64)))
    assert (m[::3] & 1).all() and (m[::5] & 2).all() and ((m & 1).mean() - 1 / 3) < 0.05
    many = langid.build(*(np.concatenate(x) for x in zip(*(langid.positions(text.mix64(np.array([k, k + 1], np.uint64)), k, 1 << 12) for k in range(130)))), [str(k) for k in range(130)], 1 << 12)
    m = many.masks(text.mix64(np.arange(131, dtype=np.uint64)))
    assert all(many.has(m, k)[k] and many.has(m, k)[k + 1] for k in range(130)) and sum(int(many.has(m, k).sum()) for k in range(130)) < 300


# 8


def brute_fingerprint(t):
    import xxhash

    w = (t or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    up = {i: i for i in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark, texts):
    got = {r["doc_id"]: r for r in queries.op8_simhash_near_dedup(spark, SMALL).collect()}
    fps = {d: brute_fingerprint(t) for d, t in texts.items()}
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{f:016x}" for d, f in fps.items()}
    assert {d: r["component_id"] for d, r in got.items()} == brute_components(fps)


@pytest.mark.parametrize("block", [20_000, 4])
def test_links_of_planted_fingerprints(spark, block):
    rng = random.Random(3)
    fps = set()
    for _ in range(30):
        f = rng.getrandbits(64)
        for _ in range(12):
            fps.add(f)
            for _ in range(rng.randrange(1, 4)):
                f ^= 1 << rng.randrange(64)
    for k in range(40):  # a crowd that shares a segment
        fps.add(0xABCD << 48 | rng.getrandbits(32))
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = simhash.fingerprint_links(df, block=block)
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in links.collect())
    got = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    want = brute_components({k: f for k, f in enumerate(fps)})
    sign = lambda f: f - (1 << 64) if f >> 63 else f
    same = lambda a, b: got.get(sign(a), sign(a)) == got.get(sign(b), sign(b))
    for k, f in enumerate(fps):
        for j in range(k):
            assert same(f, fps[j]) == (want[k] == want[j])


def test_long_chains_have_one_component(spark):
    n = 300
    e = spark.createDataFrame([(k * 7919 % n, (k + 1) * 7919 % n) for k in range(n - 1)] + [(5, 5), (None, 3)], "a long, b long")
    assert {(r["component"]) for r in components.connected_components(e).collect()} == {0}


def test_simhash_of_odd_rows(odd, empty):
    got = [(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.simhash_groups(odd).collect()]
    assert len(got) == len(odd_rows()) and {c for d, f, c in got if d in (1, 2, 3)} == {1} and {c for d, _, c in got if d in (5, 6)} == {5}
    assert simhash.simhash_groups(empty).count() == 0
    named = simhash.simhash_groups(odd.select(F.concat(F.lit("doc-"), F.lpad("doc_id", 3, "0")).alias("doc_id"), "text"))
    assert {r["component_id"] for r in named.where("doc_id in ('doc-001', 'doc-002', 'doc-003')").collect()} == {"doc-001"}


# 9


def check_packing(rows, want, limits):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= limits.tokens and len(places) <= limits.caps()[1] and sum(n * n for _, n in places) <= limits.caps()[2]
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert {d: sorted(v) for d, v in got.items()} == want
    return len(bins)


def test_packing_equals_the_contract(spark, texts):
    bpe = tokens.ByteBpe(queries.tokenizer_path())
    want, total = {}, 0
    for d, t in texts.items():
        ids = bpe.reference(t) + (2).to_bytes(4, "little")
        n = len(ids) // 4
        total += n
        cuts = [0, *range(n % 1024 or min(n, 1024), n + 1, 1024)] if n > 1024 else [0, n]
        want[d] = [(k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    bins = check_packing(queries.op9_best_fit_packing(spark, SMALL).collect(), want, packing.Limits())
    assert bins <= math.ceil(total / 1024) * 1.03


@pytest.mark.parametrize("limits", [packing.Limits(128, 3), packing.Limits(128, None, 9000, rule="dot"), packing.Limits(64, 5, 2500, (1.0, 0.5, 2.0))])
def test_packing_keeps_every_capacity(spark, texts, docs, limits):
    if limits.attention and limits.tokens**2 > limits.attention:
        with pytest.raises(ValueError):
            packing.plan({limits.tokens: 1}, limits)
        small = docs.select("doc_id", F.substring("text", 1, 60).alias("text"))
    else:
        small = docs
    rows = packing.pack_documents(small, queries.tokenizer_path(), limits).collect()
    check_packing(rows, {d: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == d) for d in {r["doc_id"] for r in rows}}, limits)


def test_packing_of_odd_rows(odd, empty):
    rows = packing.pack_documents(odd, queries.tokenizer_path()).collect()
    assert sum(r["piece"] == 0 for r in rows) == len(odd_rows()) and {(r["length"], r["offset"] >= 0) for r in rows if r["doc_id"] == 1} == {(1, True)}
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert packing.pack_documents(empty, queries.tokenizer_path()).count() == 0


# 10


def test_media_round_trip(spark, texts):
    for r in queries.op10_media_columns(spark, SMALL).collect():
        raw = texts[r["doc_id"]].encode()
        pad = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        m = ogg.encode(pad, len(raw))
        assert (r["media_bytes"], r["media_sha256"]) == (len(m), hashlib.sha256(m).hexdigest())


def slow_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c >> 31 else c << 1) & 0xFFFFFFFF
    return c


def test_ogg_pages():
    rng = random.Random(2)
    for n in (0, 1, 27, 300):
        data = rng.randbytes(n)
        assert ogg.page_crc(data) == slow_crc(data)
    packets = [(b"head", 0), (rng.randbytes(70_000), 8), (b"", 9), (rng.randbytes(255), 16), (rng.randbytes(510), 24)]
    pages = ogg.stream_pages(9, packets, per_page=2)
    d = ogg.decode(b"junk" + b"".join(pages))
    assert [p for p, _ in d.streams[9].packets] == [p for p, _ in packets] and d.bad == d.gaps == 0 and d.streams[9].ended
    assert d.streams[9].packets[-1][1] == 24 / ogg.RATE
    hurt = bytearray(b"".join(pages))
    hurt[len(pages[0]) + 500] ^= 1
    d = ogg.decode(bytes(hurt))
    assert d.bad == 1 and d.gaps == 1 and [p for p, _ in d.streams[9].packets][0] == b"head" and all(len(p) < 70_000 for p, _ in d.streams[9].packets)
    cut = ogg.decode(b"".join(pages)[:-5])
    assert cut.bad == 1


def test_media_of_odd_rows(spark, odd, empty):
    got = {r["doc_id"]: r for r in ogg.store_and_read(odd).collect()}
    assert got[1]["n_bytes"] == got[2]["n_bytes"] == 0 and got[1]["payload_bytes"] == 64 and got[1]["media_sha256"] == got[2]["media_sha256"]
    assert ogg.store_and_read(empty).count() == 0
    bad = spark.createDataFrame([(1, None), (2, b"OggS"), (3, b"")], "doc_id long, media binary")
    assert {r["payload_bytes"] for r in ogg.media_features(bad).collect()} == {0}
    p = ogg.packets(ogg.media_column(odd)).where("doc_id = 5").groupBy("serial").count().collect()
    assert {r["serial"] for r in p} == {ogg.AUDIO, ogg.NOTES}


# pipeline


def brute_jaccard(texts):
    """Components of the links of documents whose 5-word shingles are alike to 0.8, over all pairs that share one."""
    sets, holders = {}, defaultdict(list)
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        for s in sets[d]:
            holders[s].append(d)
    up = {d: d for d in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in {(a, b) for ds in holders.values() for a in ds for b in ds if a < b}:
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {d: find(d) for d in texts}


def brute_pipeline_ids(rows, bench, identified):
    """Stages 3, 8 and 6 over the documents that the first stage kept: ids and texts left."""
    kept = [(d, t) for d, t in rows if d in identified]
    drop = defaultdict(set)
    at, where = [], defaultdict(list)
    for d, t in kept:
        for k, line in enumerate((t or "").split("\n")):
            w = tuple(lines.words(line))
            if w:
                at.append((d, k, w))
                where[w].append((d, k))
            if len(w) >= lines.MIN_WORDS:
                for i in range(len(w)):
                    where[w[:i] + (None,) + w[i + 1 :]].append((d, k))
                    where["cut", w[:i] + w[i + 1 :]].append((d, k))
    for d, k, w in at:
        near = [*where[w], *(where["cut", w] if len(w) >= lines.MIN_WORDS else [])]
        for i in range(len(w) if len(w) >= lines.MIN_WORDS else 0):
            near += where[w[:i] + (None,) + w[i + 1 :]]
            near += where[w[:i] + w[i + 1 :]] if len(w) > lines.MIN_WORDS else []
        if min(near) < (d, k):
            drop[d].add(k)
    kept = [(d, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[d])) for d, t in kept]
    kept = [(d, t) for d, t in kept if t is None or t.strip(" \t\n\r\x0b\x0c")]
    comp = brute_jaccard({d: t for d, t in kept})
    kept = [(d, t) for d, t in kept if comp[d] == d]
    pats = {tuple(w) for _, b in bench for w in (x.split() for x in decontaminate.windows(b, 13))}
    sizes = {len(p) for p in pats}
    out = {}
    for d, t in kept:
        w = decontaminate.normal_words(t)
        hit, whole = set(), False
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in pats:
                    hit.update(range(k, k + n))
                    whole |= n == 13
        if not (whole or hit and 20 * len(hit) >= len(w)):
            out[d] = t
    return out


def test_pipeline_equals_brute_force(spark, docs):
    first = corpus_pipeline.STAGES[0][1](spark, docs, SMALL)
    assert first.columns == docs.columns
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = brute_pipeline_ids([(r["doc_id"], r["text"]) for r in docs.collect()], bench, {r["doc_id"] for r in first.collect()})
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in got} == set(want)
    bpe = tokens.ByteBpe(queries.tokenizer_path())
    size = defaultdict(int)
    for r in got:
        size[r["doc_id"]] += r["length"]
    assert dict(size) == {d: len(bpe.reference(t or "")) // 4 + 1 for d, t in want.items()}


def test_stages_of_odd_rows(spark, odd, empty):
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    for df in (odd, empty):
        d = df.select(cols)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, SMALL)
            assert d.columns == cols
        corpus_pipeline.STAGES[-1][1](spark, d, SMALL).count()
