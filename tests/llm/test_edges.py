"""Cases at the edges of the operators: broken-off batches, lost headers, crowded keys, many languages, long texts."""

import random
import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tessel.llm import chat, decontaminate, langid, lines, ogg, packing, rollup, runtime, simhash, text

CHANGES = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"


def batch(spark, n):
    return spark.createDataFrame([("insert", "a", "en", "t", n, None)], CHANGES)


def test_a_batch_that_breaks_off_can_come_again(spark, tmp_path, monkeypatch):
    state = rollup.Rollup(spark, f"file://{tmp_path}/state")
    assert state.apply("one", batch(spark, 5))

    def dies(*_):
        raise OSError("lost")

    monkeypatch.setattr(rollup.Rollup, "_put", dies)
    with pytest.raises(OSError):
        state.apply("two", batch(spark, 7))
    monkeypatch.undo()
    # what a writer leaves that dies while it writes the marker
    (tmp_path / "state" / "pending").mkdir(exist_ok=True)
    (tmp_path / "state" / "pending" / "half").write_bytes(b"")
    assert not state.committed("two") and state.totals().first()["n_tokens"] == 5
    assert state.apply("two", batch(spark, 7)) and state.totals().first()["n_tokens"] == 12


def test_of_two_writers_of_a_batch_one_counts(spark, tmp_path, monkeypatch):
    a, b = (rollup.Rollup(spark, f"file://{tmp_path}/state") for _ in range(2))
    put = rollup.Rollup._put

    def late(self, path, content):
        monkeypatch.undo()
        assert b.apply("one", batch(spark, 5))  # the other writer is quicker
        return put(self, path, content)

    monkeypatch.setattr(rollup.Rollup, "_put", late)
    assert not a.apply("one", batch(spark, 5))
    assert [tuple(r) for r in a.totals().collect()] == [("a", "en", "t", 1, 5)]


def test_totals_are_compacted(spark, tmp_path):
    state = rollup.Rollup(spark, f"file://{tmp_path}/state", compact_every=3)
    for k in range(8):
        assert state.apply(f"b{k}", batch(spark, k)) and not state.apply("b0", batch(spark, 99))
    base, later = state._live()
    assert base["number"] == 2 and len(base["batches"]) == 6 and set(later) == {"b6", "b7"}
    assert [tuple(r) for r in state.totals().collect()] == [("a", "en", "t", 8, 28)]


def test_token_counts_of_odd_rows(spark):
    from tessel.llm.queries import tokenizer_path

    cols = "doc_id long, text string, source string, lang string, words string, bpe string"
    df = spark.createDataFrame([(1, None, None, None, "x", "y"), (2, "", "s", "en", "x", "y"), (None, "a b", "s", "en", "x", "y"), (3, "word " * 50_000, "s", "en", "x", "y"), (3, "a b", "s", "en", "x", "y")], cols)
    got = [(r["doc_id"], r["words"]) for r in rollup.count_tokens(df, tokenizer_path()).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (2, 0), (None, 2), (3, 50_000), (3, 2)], key=str)
    assert rollup.count_tokens(df.limit(0), tokenizer_path()).count() == 0


def test_a_passage_in_a_long_document_is_found(spark):
    rng = random.Random(4)
    fill = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    item = fill(40)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "yes")], "item_id long, text string")
    rows = [(1, " ".join([*fill(2500), *item[9:22], *fill(2500)])), (2, " ".join([*fill(2500), *item[9:21], *fill(2500)])), (3, "yes of course " + " ".join(fill(60))), (4, "Yes"), (5, None), (5, "x"), (None, " ".join(item))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (40_000_000, 10):
        left = [(r["doc_id"], r["text"]) for r in decontaminate.clean_documents(df, bench, automaton_chars=size).collect()]
        assert sorted(left, key=str) == sorted([r for k, r in enumerate(rows) if k in (1, 2, 4, 5)], key=str)
    got = {r["doc_id"]: r["n_hit"] for r in decontaminate.contamination(df, bench).collect()}
    assert (got[1], got[2], got[3], got[4]) == (13, 0, 1, 1)


def test_one_automaton_is_built_once(monkeypatch):
    built = []
    monkeypatch.setattr(decontaminate, "build", lambda items, width, f=decontaminate.build: (built.append(1), f(items, width))[1])

    class Files:
        uri = "here"

        def map(self, name):
            import pickle

            return np.frombuffer(pickle.dumps([(int(name), f"item {name} has words")]), np.uint8)

    batches = [pa.record_batch([pa.array([k]), pa.array([f"item {k % 2} has words"])], names=["doc_id", "text"]) for k in range(6)]
    for n, times in ((1, 1), (2, 2)):
        built.clear()
        decontaminate._built.clear()
        found = [items for _, _, _, _, i, _ in decontaminate._matched(iter(batches), 1, Files(), n, 13) for items in i]
        assert len(built) == times and found == [{0} if k % 2 == 0 else {1} if n == 2 else set() for k in range(6)]


def brute_masks(texts, langs, grams_of):
    """Which language each text is of by exact sets of n-grams: the most hits; None where the lead is less than two."""
    out = []
    for t in texts:
        h = langid.grams(*text.text_buffer(langid._lower(pa.array([t]))))[0]
        hits = [sum(int(x) in grams_of[g] for x in h) for g in langs]
        first, second = sorted(hits)[:-3:-1]
        out.append(langs[hits.index(first)] if first > second + 1 else None)
    return out


def test_languages_equal_exact_sets(spark):
    rng = random.Random(6)
    letters = {f"l{k}": [chr(97 + (k * 5 + j) % 26) for j in range(9)] for k in range(70)}  # more than one word of bits
    word = lambda g: "".join(rng.choice(letters[g]) for _ in range(6))
    rows = [(n * 100 + k, " ".join(word(g) for _ in range(60)), g) for k, g in enumerate(letters) for n in range(4 - k // 35)]
    rows += [(7, rows[0][1], "l0")] * 30 + [(10**6, "tie tie tie", "l1"), (10**6, None, "l2"), (5, "nobody", None)]
    f = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), min_docs=1)
    assert set(f.langs) == set(letters) and f.langs[0] == "l0"
    grams_of = {g: set() for g in letters}
    for _, t, g in rows:
        if t and g:
            grams_of[g].update(langid.grams(*text.text_buffer(langid._lower(pa.array([t]))))[0].tolist())
    probes = [" ".join(word(g) for _ in range(40)) for g in letters] + [" ".join(t.split()[:20]) for _, t, _ in rows[:80]]
    want = brute_masks(probes, f.langs, grams_of)
    got = langid.predict(pa.array(probes), f)[0].tolist()
    assert [a for a, b in zip(got, want) if b] == [b for b in want if b] and sum(b is not None for b in want) > 100


def test_small_and_repeated_samples_teach(spark):
    rows = [(1, "the same words again and again", "en")] * 50 + [(2, "un seul texte pour apprendre", "fr"), (3, "ein einziger Text genug", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    f = langid.fit(df, sample=10)
    assert langid.predict(pa.array(["same words again", "seul texte", "einziger text", "12", None]), f)[0].tolist() == ["en", "fr", "de", "und", "und"]
    kept, gone = langid.keep_identified(df, f), langid.keep_identified(df, f, rejected=True)
    assert kept.count() + gone.count() == len(rows)


def test_packets_are_dated_by_their_own_headers():
    samples = bytes(range(256)) * 40
    media = ogg.encode(samples, 10_000, rate=16_000)
    d = ogg.decode(media)
    audio = d.of(ogg.SAMPLES)
    assert audio.rate == 16_000 and ogg.duration(d) == len(samples) / 16_000
    assert [t for _, t in audio.data] == [min(k + ogg.PACKET, len(samples)) / 16_000 for k in range(0, len(samples), ogg.PACKET)]
    assert all(t is not None for s in d.streams.values() for _, t in s.packets)
    assert ogg.read_back(media)[:2] == (samples, 10_000)
    # other serial numbers, the comment first
    a = ogg.stream_pages(77, [(ogg.SAMPLES + struct.pack("<IBQ", 8000, 1, 5), 0), (b"\1\2\3", 3), (b"\4\5", 5)])
    b = ogg.stream_pages(5, [(ogg.COMMENT + struct.pack("<Q", 4), 0)])
    assert ogg.read_back(b"".join([b[0], *a]))[:2] == (b"\1\2\3\4\5", 4)


def test_a_lost_header_loses_no_payload():
    samples = random.Random(3).randbytes(27_008)
    media = bytearray(ogg.encode(samples, 27_000))
    media[40] ^= 1
    payload, n, d = ogg.read_back(bytes(media))
    assert payload == samples and n == 27_000 and d.bad == 1
    assert ogg.read_back(b"")[:2] == (b"", 0) and ogg.read_back(None)[:2] == (b"", 0)


def test_a_crowd_beside_a_sparse_segment_is_dealt(spark):
    rng = random.Random(5)
    low = 0b1010
    crowd = {rng.getrandbits(32) << 32 | low for _ in range(400)}
    alone = {f ^ 0b0101 ^ 0b0100 for f in sorted(crowd)[:3]}  # one bit from the crowd's value, and linked to it
    fps = sorted(crowd | alone)
    sign = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(sign(f),) for f in fps], "fp long")
    rows = simhash._entries(df, 20)
    sizes = rows.groupBy("key", "sub").count().agg({"count": "max"}).first()[0]
    assert sizes < 150
    got = {tuple(sorted(r)) for r in simhash.fingerprint_links(df, block=20).collect()}
    want = {tuple(sorted((sign(a), sign(b)))) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3}
    assert got <= want and {x for p in want for x in p} == {x for p in got for x in p}


def test_long_texts_take_bounded_memory():
    t = "some words of a long text\n" * 800_000  # 21 MB in one row
    buf, offsets = text.text_buffer(pa.array([t]))
    tracemalloc.start()
    w = text.words_of(buf, offsets)
    lines.line_groups(w)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(w.start) == 4_800_000 and peak < 14 * len(buf) and len(set(w.hash[:6].tolist())) == 6 and (w.hash[:6] == w.hash[-6:]).all()
    short = text.words_of(*text.text_buffer(pa.array(["x " * 300 + "y" * 3_000_000 + " x"])))
    assert short.hash[0] == short.hash[-1] and len(short.start) == 302


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://there:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session())


def brute_pack(lengths, limits):
    """Best fit item by item, from the longest: the contents of each bin."""
    cap = limits.caps().astype(float)
    w = np.array(limits.weights)
    bins = []
    for n in sorted(lengths, reverse=True):
        need = np.array([n, 1, n * n])
        choice = None
        for k, (left, _) in enumerate(bins):
            if (left >= need).all():
                value = -((left / cap) * (need / cap) * w).sum() if limits.rule == "dot" else (((left - need) / cap) ** 2 * w).sum()
                key = (round(float(value), 12), int(left[0]), int(left[1]))
                if choice is None or key < choice[0]:
                    choice = (key, k)
        if choice is None:
            bins.append([limits.caps(), []])
            choice = (None, len(bins) - 1)
        bins[choice[1]][0] = bins[choice[1]][0] - need
        bins[choice[1]][1].append(n)
    return sorted(tuple(b) for _, b in bins)


@pytest.mark.parametrize("limits", [packing.Limits(64), packing.Limits(64, documents=3), packing.Limits(64, attention=700), packing.Limits(64, 4, 900), packing.Limits(64, 4, 900, rule="dot"), packing.Limits(64, rule="dot"), packing.Limits(64, 5, 1200, (2.0, 0.5, 1.0))])
def test_packing_equals_best_fit_item_by_item(limits):
    rng = random.Random(11)
    most = min(64, int(limits.caps()[2] ** 0.5))
    for n in (1, 7, 60, 400):
        lengths = [rng.choice([1, 2, 3, rng.randrange(1, most + 1), most]) for _ in range(n)]
        counts = {x: lengths.count(x) for x in lengths}
        runs, bins = packing.plan(counts, limits)
        content, seen = {}, {}
        for length, lo, hi, first, offset in runs:
            assert lo == seen.get(length, 0)
            seen[length] = hi
            for k in range(hi - lo):
                content.setdefault(first + k, []).append((offset, length))
        for places in content.values():
            at = 0
            for o, length in sorted(places):
                assert o == at
                at += length
        assert seen == counts and len(content) == bins
        assert sorted(tuple(x for _, x in sorted(p)) for p in content.values()) == brute_pack(lengths, limits)
    if limits.documents or limits.attention:
        free = packing.plan(counts, packing.Limits(64, rule=limits.rule))[1]
        assert bins > free  # the other capacities bind


def test_chats_without_ids_or_numbers(spark):
    long = "x" * 2_000_000
    rows = [(None, "0", "user", "a"), (None, "1", "bot", "b"), (None, "1", "bot", "b"), (7, "first", "user", "q"), (7, "2", "bot", "r"), (8, "0", "user", long), (8, "1", "bot", "z"), (9, "0", "user", "a"), (9, None, "sys", "s")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn string, role string, text string, c int, conv string")
    got = sorted(((r["conv_id"], r["n_turns"], r["n_copies"], r["chat"]) for r in chat.render_chats(df).collect()), key=str)
    one = lambda role, t: f"{chat.OPEN}{role}\n{t}{chat.CLOSE}\n"
    assert got == sorted([(None, 1, 1, one("user", "a")), (None, 1, 1, one("bot", "b")), (7, 2, 1, one("user", "q") + one("bot", "r")), (8, 2, 1, one("user", long) + one("bot", "z")), (9, 2, 1, one("sys", "s") + one("user", "a"))], key=str)
