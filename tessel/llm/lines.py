"""Line deduplication by a deletion-neighbourhood join (operator 3).

Two lines are duplicates if their words (ASCII letters folded) differ by at most one edit: a word replaced, added or
left out. Every line is entered under the hash of each variant with one word left out, and under its own. Lines that
share a variant and the place of the word left out differ by a replacement; a variant that equals a whole line is that
line with a word added. So a minimum by (variant, place) finds the earliest partner of all lines of a bucket without
pairs, and buckets pre-aggregate before the shuffle. For lines of few words the unit is the character, in the same way;
for longer ones it is the word, as variants then grow with the words of the text, not with its characters times itself.

Before variants are made, lines that share neither half with another line are set aside: one edit leaves one half of
the shorter line whole, so this loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, prepare, written
from .text import Words, mix64, run_hash, sequence_sums, signed, word_power, word_runs

#: Lines of fewer words are compared by characters, and if they have fewer characters than MIN_CHARS for equality only.
MIN_WORDS = 8
MIN_CHARS = 16
_LENGTH = np.uint64(0xA24BAED4963EE407)


def line_groups(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word index of each line that has words, and its number in its text."""
    if not len(w.start):
        e = np.empty(0, np.int64)
        return e, e, e
    breaks = np.flatnonzero(w.buf == 10)
    number = np.searchsorted(breaks, w.start) - np.searchsorted(breaks, w.offsets[:-1])[w.doc]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(w.doc) != 0) | (np.diff(number) != 0))))
    last = np.concatenate((first[1:], [len(w.start)]))
    return first, last, number[first]


def sealed(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hash of a run of n words."""
    return mix64(h + n.astype(np.uint64) * _LENGTH)


def normal(line: bytes) -> str:
    """A line's words, ASCII letters folded, with single spaces between them."""
    return b" ".join(line.lower().split()).decode("utf-8", "replace")


def _char_hash(t: str) -> int:
    return xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 0x5A17)


def _line_rows(min_words: int, exact_words: int, min_chars: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, w in word_runs(b.column(1)):
                first, last, number = line_groups(w)
                keep = last - first >= min(min_words, exact_words)
                first, last, number = first[keep], last[keep], number[keep]
                n = last - first
                sums = sequence_sums(w.hash)
                half, less = n // 2, (n - 1) // 2
                parts = [sealed(run_hash(sums, first, first + m), m) for m in (half, less)]
                parts += [mix64(sealed(run_hash(sums, last - m, last), m)) for m in (half, less)]
                compared = n >= min_words
                if min_chars is not None:
                    for k in np.flatnonzero(~compared).tolist():
                        t = normal(w.buf[w.start[first[k]] : w.end[last[k] - 1]].tobytes())
                        if len(t) >= min_chars:
                            compared[k] = True
                            m = len(t) // 2, (len(t) - 1) // 2
                            for x, y in zip(parts, ("<" + t[: m[0]], "<" + t[: m[1]], ">" + t[len(t) - m[0] :], ">" + t[len(t) - m[1] :])):
                                x[k] = _char_hash(y)
                ids = b.column(0).take(pa.array(lo + w.doc[first]))
                cols = [pa.array(signed(sealed(run_hash(sums, first, last), n))), *(pa.array(signed(x), mask=~compared) for x in parts)]
                yield pa.record_batch([ids, pa.array(number.astype(np.int32)), pa.array(n.astype(np.int32)), *cols], names=["doc_id", "line_no", "n_words", "h", "p0", "p1", "s0", "s1"])

    return run


def _variants(min_words: int):
    """From doc_id, text and the wanted (line number, class) pairs: variants of each wanted line, and its text."""
    names = ["key", "place", "h", "doc_id", "line_no", "line"]

    def by_words(w: Words, f: np.ndarray, l: np.ndarray, sums: np.ndarray) -> tuple:
        """Of each line, its own key, and the line, place and key of each variant."""
        n = l - f
        line = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(line)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
        word = f[line] + place
        head = run_hash(sums, f[line], word)
        tail = run_hash(sums, word + 1, l[line])
        return signed(sealed(run_hash(sums, f, l), n)), line, place, signed(sealed(head + tail * word_power(place), n[line] - 1))

    def by_chars(texts: list[str]) -> tuple:
        own = np.array([_char_hash(t) for t in texts], np.uint64)
        n = np.array([len(t) for t in texts], np.int64)
        line = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(line)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
        return signed(own), line, place, signed(np.array([_char_hash(t[:k] + t[k + 1 :]) for t in texts for k in range(len(t))], np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, wanted = b.column(0), b.column(2).to_pylist()
            for lo, hi, w in word_runs(b.column(1)):
                first, last, number = line_groups(w)
                doc = w.doc[first]
                sums = sequence_sums(w.hash)
                own = signed(sealed(run_hash(sums, first, last), last - first))
                at = {(d, n): k for k, (d, n) in enumerate(zip(doc.tolist(), number.tolist()))}
                picked = {k for d in range(hi - lo) for x in wanted[lo + d] if (k := at.get((d, x["line_no"]))) is not None and own[k] == x["h"]}
                for long in (True, False):
                    p = np.array(sorted(k for k in picked if (last[k] - first[k] >= min_words) == long), np.int64)
                    if not len(p):
                        continue
                    raw = [w.buf[w.start[s] : w.end[e - 1]].tobytes() for s, e in zip(first[p], last[p])]
                    key, line, place, variant = by_words(w, first[p], last[p], sums) if long else by_chars([normal(x) for x in raw])
                    whole, d = own[p], lo + doc[p]
                    text = [x.decode("utf-8", "replace") for x in raw]
                    yield pa.record_batch([pa.array(key), pa.array(np.full(len(p), -1, np.int32)), pa.array(whole), ids.take(pa.array(d)), pa.array(number[p].astype(np.int32)), pa.array(text)], names=names)
                    yield pa.record_batch([pa.array(variant), pa.array(place.astype(np.int32)), pa.array(whole[line]), ids.take(pa.array(d[line])), pa.array(number[p][line].astype(np.int32)), pa.nulls(len(line), pa.string())], names=names)

    return run


def words(line: str) -> list[bytes]:
    return line.encode("utf-8", "surrogatepass").lower().split()


def one_edit(a: Sequence, b: Sequence) -> bool:
    """Whether two sequences differ by at most one replacement, insertion or deletion."""
    if abs(len(a) - len(b)) > 1:
        return False
    head = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    tail = next((k for k, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    return head + tail >= max(len(a), len(b)) - 1


def near_lines(a: str, b: str, min_words: int, min_chars: int | None) -> bool:
    """Whether two lines are within one edit: of a word if both have ``min_words``, of a character if both have fewer
    words and ``min_chars`` characters at least."""
    x, y = words(a), words(b)
    if x == y or min(len(x), len(y)) >= min_words:
        return one_edit(x, y)
    s, t = normal(a.encode("utf-8", "surrogatepass")), normal(b.encode("utf-8", "surrogatepass"))
    return min_chars is not None and max(len(x), len(y)) < min_words and min(len(s), len(t)) >= min_chars and one_edit(s, t)


def _verified(min_words: int, min_chars: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [near_lines(x, y, min_words, min_chars) for x, y in zip(b.column("line").to_pylist(), b.column("other").to_pylist())]
            yield b.filter(pa.array(ok, pa.bool_())).select(["h", "doc_id", "line_no"])

    return run


def wanted_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, text, wanted`` of the documents that hold wanted lines ``doc_id, line_no, h``."""
    per_doc = wanted.groupBy(F.col("doc_id").alias("__tessel_doc")).agg(F.collect_list(F.struct("line_no", "h")).alias("wanted"))
    return docs.join(per_doc, docs.doc_id.eqNullSafe(F.col("__tessel_doc"))).select("doc_id", "text", "wanted")


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, exact_words: int = 1, min_chars: int | None = MIN_CHARS) -> DataFrame:
    """The lines to drop: ``doc_id, line_no, n_words, keeper_doc_id, keeper_line_no, edits``.

    A line of at least ``min_words`` words is dropped if an earlier line of the corpus, in the order of (doc_id, line
    number), is within one word edit; a shorter one of at least ``min_chars`` characters (None: not at all), if an earlier
    one of these is within one character edit; one of at least ``exact_words`` words, if an earlier line has the same
    words. Characters are counted with single spaces between words. A line of ``min_words`` words and one of fewer are
    compared for equality only. The
    keeper is the earliest such line and ``edits`` is 0 or 1. The keeper of a line may have a keeper itself: links are
    not carried on, so in a chain of lines each one edit from the next all but the first go. Lines are split at
    newlines and numbered from 0. Null, empty and wordless texts give nothing; a null doc_id sorts first; rows that
    share a doc_id share the places of their lines, and of two lines at one place neither is earlier:
    ``without_duplicate_lines`` tells such rows apart.
    """
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    lines = written(src.mapInArrow(_line_rows(min_words, exact_words, min_chars), f"doc_id {id_type}, line_no int, n_words int, h long, p0 long, p1 long, s0 long, s1 long"), "lines")
    place = F.struct("doc_id", "line_no")
    classes = written(lines.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.min("n_words").alias("n_words"), *(F.min(c).alias(c) for c in ("p0", "p1", "s0", "s1"))), "line-classes")

    halves = classes.where("p0 is not null").select("h", F.explode(F.array_distinct(F.array("p0", "p1", "s0", "s1"))).alias("half"))
    shared = halves.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("half")
    near = halves.join(shared, "half").select("h").distinct()
    wanted = classes.join(near, "h").select("h", "first.doc_id", "first.line_no")
    rows = written(wanted_lines(src, wanted).mapInArrow(_variants(min_words), f"key long, place int, h long, doc_id {id_type}, line_no int, line string"), "line-variants")

    spot = F.struct("doc_id", "line_no", "h")
    cut_ = rows.where("place >= 0").select("key", "place", "h", spot.alias("spot"))
    whole = rows.where("place < 0").select("key", "h", spot.alias("spot"))
    lead = cut_.groupBy("key", "place").agg(F.min("spot").alias("lead"), F.max("h").alias("hi"), F.min("h").alias("lo")).where("hi <> lo").select("key", "place", "lead")
    replaced = cut_.join(lead, ["key", "place"]).select("h", "spot", F.col("lead").alias("other"))
    added = cut_.join(whole.select("key", F.col("h").alias("short"), F.col("spot").alias("short_spot")), "key")
    shorter = added.select("h", "spot", F.col("short_spot").alias("other"))
    longer = added.groupBy("short", "short_spot").agg(F.min("spot").alias("other")).select(F.col("short").alias("h"), F.col("short_spot").alias("spot"), "other")
    links = replaced.union(shorter).union(longer).where("h <> other.h and struct(other.doc_id, other.line_no) < struct(spot.doc_id, spot.line_no)").select("h", "other").distinct()
    texts = rows.where("place < 0").select(F.col("h").alias("th"), "line")
    both = links.join(texts, links.h == texts.th).select("h", "other", "line")
    both = both.join(texts.select("th", F.col("line").alias("other_line")), both.other.h == F.col("th")).select("h", "other.doc_id", "other.line_no", "line", F.col("other_line").alias("other"))
    true = both.mapInArrow(_verified(min_words, min_chars), f"h long, doc_id {id_type}, line_no int")
    best = true.groupBy("h").agg(F.min(place).alias("partner")).select(F.col("h").alias("bh"), "partner")

    doubled = classes.select(F.col("h").alias("ch"), "first", "last").join(best, F.col("ch") == F.col("bh"), "left").where("first <> last or partner is not null")
    # written, so that the last join has a plain exchange on either side and hot classes are split
    doubled = written(doubled.select("ch", "first", "partner"), "line-doubles")
    discard(classes, rows)
    hit = lines.join(doubled, lines.h == F.col("ch"))
    keeper = F.least("first", F.coalesce("partner", "first"))
    out = hit.withColumn("keeper", keeper).where("keeper < struct(doc_id, line_no)")
    edits = F.when(F.col("keeper") == F.col("first"), 0).otherwise(1)
    return out.select("doc_id", "line_no", "n_words", F.col("keeper.doc_id").alias("keeper_doc_id"), F.col("keeper.line_no").alias("keeper_line_no"), edits.alias("edits"))


def without_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, exact_words: int = 1, min_chars: int | None = None) -> DataFrame:
    """``docs`` with the lines that ``duplicate_lines`` drops taken out of its texts; other columns stay.

    Rows are told apart by id and text, in the order of the id and then a hash of the text: an id may be null or come
    again with another text. Rows that repeat both keep what is nowhere else. Short lines go only if they repeat, unless
    ``min_chars`` is given: one character is much of "part 1".
    """
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("fp"))
    keyed = docs.withColumn("__tessel_row", row)
    dropped = duplicate_lines(keyed, "__tessel_row", text_col, min_words, exact_words, min_chars)
    per_row = dropped.groupBy(F.col("doc_id").alias("__tessel_doc")).agg(F.collect_set("line_no").alias("__tessel_drop"))
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains("__tessel_drop", i)), "\n")
    text = F.when(F.col("__tessel_drop").isNull(), F.col(text_col)).otherwise(kept)
    return keyed.join(per_row, keyed["__tessel_row"] == F.col("__tessel_doc"), "left").withColumn(text_col, text).select(docs.columns)
