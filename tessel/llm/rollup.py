"""Delta-maintained token-count rollups (operator 5).

Totals are additive, so a batch of changes becomes a few signed sums by source, language and tokenizer version. A
batch's sums are written to a folder of their own and count from the moment its marker is there. A marker names that
folder; it is written whole under another name and then renamed, so a batch that broke off at any point counts not at
all and can come again. A marker names one folder, so a batch that comes twice, or from two writers at once, counts
once. Every so many batches the sums of all are written as one base, and totals read the base and what came after it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import prepare
from .tokens import ByteBpe

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of ``op, source, lang, tokenizer, n_tokens, old_tokens``.

    insert adds a document and its tokens; delete takes them off (``n_tokens`` is the count that was added); revise
    adds the difference to ``old_tokens``. Null counts are 0; null keys are groups of their own; any other op is an
    error, so that no change is lost in silence.
    """
    n, old, op = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0)), F.col("op")
    bad = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(op, F.lit("null"))))
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(bad.cast("int"))
    tokens = F.when(op == "insert", n).when(op == "delete", -n).otherwise(n - old)
    return changes.groupBy(*KEYS).agg(F.sum(docs).alias("n_docs"), F.sum(tokens).alias("n_tokens"))


class Rollup:
    """Totals kept under a folder that driver and executors share. After ``compact_every`` batches beyond the last base
    a new base is written."""

    def __init__(self, spark: SparkSession, path: str, compact_every: int = 64):
        self.spark, self.path, self.compact_every = spark, path.rstrip("/"), compact_every
        self._jvm = spark.sparkContext._jvm
        self._jpath = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _marker(self, batch: str) -> str:
        return f"{self.path}/commits/{quote(str(batch), safe='')}"

    def _put(self, path: str, content: str) -> bool:
        """Write a file as a whole: under another name, then renamed. False if the name was taken."""
        tmp = self._jpath(f"{self.path}/pending/{uuid.uuid4().hex}")
        out = self._fs.create(tmp, False)
        out.write(bytearray(content.encode()))
        out.close()
        to = self._jpath(path)
        self._fs.mkdirs(to.getParent())
        if not self._fs.exists(to) and self._fs.rename(tmp, to):
            return True
        self._fs.delete(tmp, False)
        if not self._fs.exists(to):
            raise OSError(f"{path} could not be written")
        return False

    def _read(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _files(self, folder: str) -> dict:
        at = self._jpath(f"{self.path}/{folder}")
        return {s.getPath().getName(): s.getPath() for s in self._fs.listStatus(at)} if self._fs.exists(at) else {}

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._jpath(self._marker(batch)))

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Count a batch once; False if it was counted before."""
        if self.committed(batch):
            return False
        name = uuid.uuid4().hex
        deltas(changes).write.parquet(f"{self.path}/data/{name}")
        if not self._put(self._marker(batch), name):
            self._fs.delete(self._jpath(f"{self.path}/data/{name}"), True)
            return False
        if len(self._live()[1]) >= self.compact_every:
            self.compact()
        return True

    def _live(self) -> tuple[dict | None, dict[str, str]]:
        """The last base, and the folders of the batches that it does not cover."""
        bases = self._files("bases")
        base = json.loads(self._read(bases[max(bases)])) if bases else None
        known = set(base["batches"]) if base else set()
        return base, {b: self._read(p) for b, p in self._files("commits").items() if b not in known}

    def _sums(self, base: dict | None, later: dict[str, str]) -> DataFrame:
        live = [f"{self.path}/data/{n}" for n in sorted([*later.values(), *([base["data"]] if base else [])])]
        df = self.spark.read.schema(SCHEMA).parquet(*live) if live else self.spark.createDataFrame([], SCHEMA)
        return df.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def compact(self) -> None:
        """Write the sums of all batches so far as a base. It counts from the moment that its file is there; of two
        written at once one stands, and either covers just the batches that it names."""
        base, later = self._live()
        name = uuid.uuid4().hex
        self._sums(base, later).write.parquet(f"{self.path}/data/{name}")
        number = (base["number"] if base else 0) + 1
        content = {"number": number, "data": name, "batches": sorted([*(base["batches"] if base else []), *later])}
        if not self._put(f"{self.path}/bases/{number:012d}", json.dumps(content)):
            self._fs.delete(self._jpath(f"{self.path}/data/{name}"), True)

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens``; keys whose sums are all 0 are gone."""
        return self._sums(*self._live()).where("n_docs <> 0 or n_tokens <> 0")


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """``doc_id, source, lang, words, bpe``: words split at white space, and ids of the byte-level BPE file. Null is 0."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(tokenizer)
        for b in batches:
            texts = [t or "" for t in b.column(3).to_pylist()]
            words = [len(t.encode("utf-8", "surrogatepass").split()) for t in texts]
            yield pa.record_batch([*b.columns[:3], pa.array(words, pa.int64()), pa.array([len(bpe.ids(t)) // 4 for t in texts], pa.int64())], names=["doc_id", "source", "lang", "words", "bpe"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, source string, lang string, words long, bpe long")


def as_changes(counts: DataFrame, op: str, tokenizers: dict[str, str], revised: dict[str, int] | None = None) -> DataFrame:
    """Changes of one kind for documents' counts; ``revised`` adds to a tokenizer's count."""
    out = None
    for name, col in tokenizers.items():
        more = (revised or {}).get(name, 0)
        one = counts.select(F.lit(op).alias("op"), "source", "lang", F.lit(name).alias("tokenizer"), (F.col(col) + more).alias("n_tokens"), F.col(col).alias("old_tokens"))
        out = one if out is None else out.union(one)
    return out
