"""Near copies of whole documents: SimHash of sets of 5-word shingles, then their exact Jaccard similarity.

Documents with the same words collapse to a class. A pair at the threshold shares a segment of the fingerprints, and is
near in them, with probability of at least the recall; such links make clusters. Inside a cluster classes are compared
exactly, and components of the links that hold are groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .lines import sealed
from .passages import BLOCK, BLOCK_WORDS, RECALL, SHINGLE, THRESHOLD, _forest, bucket_members
from .runtime import prepare, written
from .simhash import print_words, segment_links, set_prints, tune_segments
from .text import Words, mix64, run_hash, sequence_sums, signed, word_runs


def _shingles(w: Words, sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of words first..last-1 (a shorter text is one shingle), and where each text's begin."""
    many = np.maximum(1, last - first - SHINGLE + 1)
    begin = np.concatenate(([0], np.cumsum(many)[:-1]))
    k = np.repeat(first, many) + np.arange(int(many.sum())) - np.repeat(begin, many)
    return mix64(run_hash(sums, k, np.minimum(k + SHINGLE, np.repeat(last, many)))), begin


def _units(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in word_runs(b.column(2)):
                bounds = w.bounds()
                first, last = bounds[:-1], bounds[1:]
                n = last - first
                sums = sequence_sums(w.hash)
                prints = np.empty((0, words), np.uint64)
                has = np.flatnonzero(n)
                if len(has):
                    s, begin = _shingles(w, sums, first[has], last[has])
                    text = np.repeat(np.arange(len(has)), np.diff(np.append(begin, len(s))))
                    order = np.lexsort((s, text))
                    s, text = s[order], text[order]
                    once = np.concatenate(([True], (s[1:] != s[:-1]) | (text[1:] != text[:-1])))
                    prints = set_prints(s[once], np.searchsorted(text[once], np.arange(len(has))), words)
                cuts = np.concatenate(([0], np.cumsum(np.where(n > 0, words, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(signed(np.ascontiguousarray(prints)).ravel()))
                own = b.slice(lo, hi - lo)
                yield pa.record_batch([own.column(0), own.column(1), pa.array(n.astype(np.int64)), pa.array(signed(sealed(run_hash(sums, first, last), n))), lists], names=["doc_id", "fp", "words", "h", "print"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct shingle hashes of each text."""
    for b in batches:
        for lo, hi, w in word_runs(b.column(0)):
            bounds = w.bounds()
            sums = sequence_sums(w.hash)
            first, last = bounds[:-1], bounds[1:]
            h = sealed(run_hash(sums, first, last), last - first)
            sets = [np.unique(signed(_shingles(w, sums, first[d : d + 1], last[d : d + 1])[0])) for d in range(hi - lo)]
            cuts = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            yield pa.record_batch([pa.array(signed(h)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(sets)))], names=["h", "shingles"])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs``, all columns, with exactly one row of each group of near copies: the one with the smallest known id.

    Two documents are near copies if the Jaccard similarity of their sets of 5-word shingles (ASCII letters folded) is
    ``threshold`` or more; groups are what links connect. Texts without words are copies of each other. Rows are told
    apart by id and text, so that rows which share an id but not a text, and rows without an id, are judged each by
    itself; of rows that repeat both, one stays.
    """
    prepare(docs.sparkSession)
    segments, radius = tune_segments(threshold, recall)
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("fp"), text.alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    units = written(src.mapInArrow(_units(print_words(segments)), f"doc_id {id_type}, fp long, words long, h long, print array<long>"), "copies")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp")
    classes = written(units.groupBy("h").agg(F.min(place).alias("first"), F.first("print").alias("print"), F.first("words").alias("words")), "copy-classes")

    texts = classes.where("words > 0")
    near = connected_components(segment_links(texts, segments, radius)).select(F.col("node"), F.col("component").alias("cluster"))
    mark = F.element_at("print", 1)  # classes that share it are one node
    clusters = texts.select("h", "words", mark.alias("mark")).join(near, F.col("mark") == F.col("node"), "left").select(F.coalesce("cluster", "mark").alias("key"), "h", "words")
    members = written(bucket_members(clusters, block, block_words), "copy-buckets").withColumnRenamed("h", "mh")
    wanted = classes.join(members.select(F.col("mh").alias("h")).distinct(), "h").select(F.col("first.doc_id").alias("wd"), F.col("first.fp").alias("wf"))
    sets = src.join(wanted, src.doc_id.eqNullSafe(F.col("wd")) & (src.fp == F.col("wf"))).select("text").mapInArrow(_sets, "h long, shingles array<long>").dropDuplicates(["h"])
    ready = members.join(sets, F.col("mh") == F.col("h")).select("key", "sub", "h", "shingles")
    links = ready.repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(_forest(threshold), "a long, b long")
    comp = connected_components(links)

    led = classes.join(comp, classes.h == comp.node, "left").select("h", "first", F.coalesce("component", "h").alias("root"))
    groups = led.groupBy("root").agg(F.min("first").alias("group"))
    named = written(led.join(groups, "root").select(F.col("h").alias("ch"), "group"), "copy-groups")
    rows_of = units.select("doc_id", "fp", "h").join(named, F.col("h") == F.col("ch"))
    gone = rows_of.where(~place.eqNullSafe(F.col("group"))).select(F.col("doc_id").alias("__tessel_doc"), F.col("fp").alias("__tessel_fp")).distinct()
    again = units.groupBy("doc_id", "fp").count().where("count > 1").select(F.col("doc_id").alias("__tessel_doc"), F.col("fp").alias("__tessel_fp"))
    marks = written(gone.withColumn("__tessel_gone", F.lit(True)).union(again.join(gone, again["__tessel_doc"].eqNullSafe(gone["__tessel_doc"]) & (again["__tessel_fp"] == gone["__tessel_fp"]), "left_anti").withColumn("__tessel_gone", F.lit(False))), "copy-marks")
    own = docs.withColumn("__tessel_own", F.xxhash64(text))
    same = own[id_col].eqNullSafe(marks["__tessel_doc"]) & (own["__tessel_own"] == marks["__tessel_fp"])
    once = own.join(marks, same, "left_anti")
    repeated = own.join(marks.where("not __tessel_gone"), same, "left_semi").dropDuplicates([id_col, "__tessel_own"])
    return once.unionByName(repeated).select(docs.columns)
