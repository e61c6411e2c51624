"""Language identification with language-bitmask n-gram filters (operator 7).

One bit-sliced Bloom filter serves all languages: each position holds a mask with a bit per language, and the AND of an
n-gram's positions is the mask of all languages that (seem to) contain it. A text's languages are scored by popcounts of
its n-grams' masks, corrected for each language's false-positive rate, which follows from the share of its bits set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare
from .text import mix64, spans, text_buffer

#: The classifier is fitted on at most so many labelled documents of a language, and on over half of that if there are.
SAMPLE_PER_LANG = 3_000
#: An n-gram enters a language's slice if it is in so many sampled documents; in fewer where a language has few: in one
#: of MIN_SHARE of them, and in one at least.
MIN_DOCS = 3
MIN_SHARE = 10
GRAM = 5
SLOTS = 1 << 21
HASHES = 3
#: Documents of whose n-grams no language knows so large a share are in none of them.
LEAST_KNOWN = 0.2


@dataclass
class MaskFilter:
    """``slots`` has a mask at each position: a row of words, with as many bits in all as there are languages."""

    langs: list[str]
    slots: np.ndarray
    fpr: np.ndarray

    def masks(self, h: np.ndarray) -> np.ndarray:
        slots = self.slots.ravel() if self.slots.shape[1] == 1 else self.slots
        out = slots[_slot(h, 0, len(slots))]
        for k in range(1, HASHES):
            out &= slots[_slot(h, k, len(slots))]
        return out

    def has(self, masks: np.ndarray, lang: int) -> np.ndarray:
        """The bit of a language in each of the masks."""
        bits = masks.dtype.itemsize * 8
        word = masks[:, lang // bits] if masks.ndim == 2 else masks
        return (word >> masks.dtype.type(lang % bits)) & masks.dtype.type(1)


def _slot(h: np.ndarray, k: int, size: int) -> np.ndarray:
    return ((h >> np.uint64(21 * k)) & np.uint64(size - 1)).astype(np.int64)


def grams(buf: np.ndarray, offsets: np.ndarray, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the byte n-grams inside texts. ``buf`` is lower case; all but letters counts as a space."""
    m = len(buf) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    letters = np.where((buf >= 0x80) | ((buf >= 97) & (buf <= 122)), buf, np.uint8(32))
    h = np.zeros(m, np.uint64)
    blank = np.zeros(m, bool)
    for k in range(n):
        part = letters[k : k + m]
        h <<= np.uint64(8)
        h |= part
        if k:
            blank |= (part == 32) & (letters[k - 1 : k - 1 + m] == 32)
    inside = np.ones(m, bool)
    for e in offsets[1:-1]:
        inside[max(0, e - n + 1) : e] = False
    at = np.flatnonzero(inside & ~blank)
    return mix64(h[at]), at


def _lower(col: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(col.cast(pa.large_string()), ""))


def build(at: np.ndarray, word: np.ndarray, mask: np.ndarray, langs: list[str], size: int = SLOTS) -> MaskFilter:
    """From positions, the word of the mask there, and its bits; see ``positions``."""
    kind = np.uint8 if len(langs) <= 8 else np.uint64
    bits = np.dtype(kind).itemsize * 8
    slots = np.zeros((size, max(1, -(-len(langs) // bits))), kind)
    np.bitwise_or.at(slots, (at, word), mask.astype(np.int64).view(np.uint64).astype(kind))
    f = MaskFilter(langs, slots, np.zeros(len(langs)))
    filled = np.array([np.count_nonzero(f.has(slots, b)) / size for b in range(len(langs))])
    return MaskFilter(langs, slots, filled**HASHES)


def positions(h: np.ndarray, lang: int, size: int = SLOTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where n-grams of a language set bits: positions, words of the mask and their bits as signed longs."""
    at = np.unique(np.concatenate([_slot(h, k, size) for k in range(HASHES)]))
    bit = np.array([1 << lang % 64], np.uint64).view(np.int64)
    return at, np.full(len(at), lang // 64), np.repeat(bit, len(at))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE_PER_LANG, min_docs: int = MIN_DOCS) -> MaskFilter:
    """Fit on labelled rows: at most ``sample`` different documents of each language, whole texts.

    Document counts of n-grams, and the bits that they set, are made in Spark; the driver gets the set positions, of
    which the filter has SLOTS whatever the texts. Rows with a null language or text teach nothing; rows that repeat id
    and text teach once. Any number of languages is taken. No labelled row gives a filter without languages.
    """
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    # documents whose hash begins with z zero bits are a 2**-z share; counts by z say which z to take
    keyed = src.select("text", "lang", F.xxhash64("id", "text").alias("h"))
    keyed = keyed.withColumn("zeros", F.when(F.col("h") == 0, 64).otherwise(64 - F.length(F.bin("h"))))
    by: dict[str, dict[int, int]] = {}
    for r in keyed.groupBy("lang", "zeros").count().collect():
        by.setdefault(r["lang"], {})[r["zeros"]] = r["count"]
    langs = sorted(by, key=lambda x: (-sum(by[x].values()), x))
    if not langs:
        return MaskFilter([], np.zeros((SLOTS, 1), np.uint8), np.zeros(0))
    # where even the rarest zeros have too many rows these are repeats of one or two, and fall together
    least = {lang: next((z for z in sorted(n) if sum(c for k, c in n.items() if k >= z) <= sample), max(n)) for lang, n in by.items()}
    wanted = spark.createDataFrame([(lang, k, least[lang]) for k, lang in enumerate(langs)], "lang string, no int, least int")
    picked = keyed.join(F.broadcast(wanted), "lang").where("zeros >= least").dropDuplicates(["lang", "h"]).select("no", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = text_buffer(_lower(b.column(1)))
            no = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(b.num_rows):
                h, _ = grams(buf[offsets[i] : offsets[i + 1]], np.zeros(0, np.int64))
                h = np.unique(h)
                yield pa.record_batch([pa.array(np.full(len(h) + 1, no[i], np.int32)), pa.array([None, *h.view(np.int64)], pa.int64())], names=["no", "gram"])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            no, h = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            for lang in np.unique(no).tolist():
                at, word, mask = positions(h[no == lang], lang)
                yield pa.record_batch([pa.array(at), pa.array(word), pa.array(mask)], names=["at", "word", "mask"])

    # a row without n-gram counts the language's documents
    counts = picked.mapInArrow(run, "no int, gram long").groupBy("no", "gram").agg(F.count("*").alias("n")).persist()
    size = counts.where("gram is null").select("no", F.greatest(F.lit(1), F.least(F.lit(min_docs), F.floor(F.col("n") / MIN_SHARE))).alias("need"))
    enter = counts.where("gram is not null").join(F.broadcast(size), "no").where("n >= need").select("no", "gram")
    rows = enter.mapInArrow(bits, "at long, word long, mask long").groupBy("at", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    counts.unpersist()
    return build(rows["at"].to_numpy(np.int64), rows["word"].to_numpy(np.int64), rows["mask"].to_numpy(np.int64), langs)


def score_texts(col: pa.Array, f: MaskFilter) -> tuple[np.ndarray, np.ndarray]:
    """Corrected hits of each language by text, and the number of n-grams."""
    n, k = len(col), len(f.langs)
    hits, total = np.zeros((n, k)), np.zeros(n)
    buf, offsets = text_buffer(_lower(col))
    for lo, hi in spans(offsets, 1 << 19):
        own = offsets[lo : hi + 1] - offsets[lo]
        h, at = grams(buf[offsets[lo] : offsets[hi]], own)
        if not len(h):
            continue
        cuts = np.searchsorted(at, own)
        masks = f.masks(h)
        count = np.diff(cuts)
        total[lo:hi] = count
        for b in range(k):
            seen = np.concatenate(([0], np.cumsum(f.has(masks, b), dtype=np.int64)))
            hits[lo:hi, b] = (np.diff(seen[cuts]) - count * f.fpr[b]) / max(1e-9, 1 - f.fpr[b])
    return np.maximum(hits, 0), total


def predict(col: pa.Array, f: MaskFilter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and known share of each text; see ``identify``. The share of a text without n-grams is NaN."""
    letter = pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    names = np.array([*f.langs, "und"], object)
    if not f.langs or not len(col):
        return np.full(len(col), "und", object), np.zeros(len(col)), np.full(len(col), np.nan)
    hits, total = score_texts(col, f)
    best = hits.argmax(axis=1)
    top, all_ = hits[np.arange(len(best)), best], hits.sum(axis=1)
    score = np.where(letter & (all_ > 0), top / np.maximum(all_, 1e-12), 0.0)
    known = np.where(total > 0, np.minimum(1.0, top / np.maximum(total, 1)), np.nan)
    return names[np.where(letter, best, len(f.langs))], score, known


def identify(docs: DataFrame, f: MaskFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, lang_pred, score, known``.

    ``lang_pred`` is a learned language, or ``und`` for a null text or one without a letter (score 0), and for all if
    nothing was learned. ``score`` is the best language's share of all corrected hits; ``known`` is the share of the
    text's n-grams that the best language contains. Ties go to the language that taught more documents. Whole texts are read;
    texts too short for an n-gram get the most frequent language with score 0.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, known = predict(b.column(1), sent.value)
            yield pa.record_batch([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(np.nan_to_num(known))], names=["doc_id", "lang_pred", "score", "known"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, known double")


def keep_identified(docs: DataFrame, f: MaskFilter, text_col: str = "text", least_known: float = LEAST_KNOWN, rejected: bool = False) -> DataFrame:
    """``docs``, all columns, without rows whose language is ``und`` or of whose n-grams the best language knows a
    smaller share than ``least_known``; a text too short for an n-gram stays. With ``rejected`` the rows that go, so
    that a caller can see or keep them. Nothing is shuffled. A filter that learned nothing keeps every row."""
    if not f.langs:
        return docs.limit(0) if rejected else docs
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(f)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, _, known = predict(b.column(at), sent.value)
            yield b.filter(pa.array(((lang != "und") & ~(known < least_known)) != rejected))

    return docs.mapInArrow(run, docs.schema)


def held_out(modulus: int, id_col: str = "doc_id"):
    """crc32 of the id as text leaves 2; a null id is in no held-out fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == 2, F.lit(False))
