"""Benchmark decontamination with one Aho-Corasick automaton (operator 6).

Test items are normalised to words and cut into windows; every window is a pattern of one automaton over the
characters of the normalised text, in which single spaces enclose each word. A text is normalised once and scanned once;
matches are mapped back to its words and from there to offsets in the original.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import SharedFiles, prepare

#: Characters of patterns in one automaton; more test text makes more automata, used one after the other, each for
#: HELD_BYTES of text at a time.
AUTOMATON_CHARS = 40_000_000
HELD_BYTES = 64 << 20
_TABLE = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    """Words of digits, letters folded from A-Z, and everything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows(text: str | None, width: int) -> list[bytes]:
    w = normal_words(text)
    if not w:
        return []
    return [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]


def build(items: list[tuple], width: int) -> "ahocorasick.Automaton":
    """Patterns carry their number of words and the items that contain them."""
    found: dict[bytes, set] = {}
    for item, text in items:
        for w in windows(text, width):
            found.setdefault(w, set()).add(item)
    a = ahocorasick.Automaton()
    for w, who in found.items():
        a.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(who)))
    if found:
        a.make_automaton()
    return a


def scan(words: list[bytes], a: "ahocorasick.Automaton", hit: np.ndarray, items: set, width: int) -> bool:
    """Mark the words inside any occurrence and collect the items; whether a window of ``width`` words occurs."""
    if not words or not len(a):
        return False
    starts, whole = None, False
    for end, (n, who) in a.iter(f" {b' '.join(words).decode('latin-1')} "):
        if starts is None:
            starts = np.cumsum([1, *(len(w) + 1 for w in words)])  # a window ends on the space before starts[k]
        last = int(np.searchsorted(starts, end + 1)) - 1
        hit[last - n + 1 : last + 1] = True
        items.update(who)
        whole |= n == width
    return whole


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Character bounds in the original text of each normalised word."""
    raw = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8)
    inside = np.frombuffer(_TABLE, np.uint8)[b] != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    chars = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))
    return [(int(chars[s]), int(chars[e])) for s, e in edge.reshape(-1, 2)]


def spans_of(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as character offsets in the original."""
    where = word_offsets(text)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).reshape(-1, 2)
    return [{"start": where[s][0], "end": where[e - 1][1]} for s, e in edge.tolist()]


def _stored(benchmark: DataFrame, item_col: str, text_col: str, width: int, limit: int) -> tuple[SharedFiles, int]:
    """Test items in files of the shared folder, each of as much text as one automaton takes; the number of files.

    Items pass through the driver one after the other; only a file's worth is held."""
    files = SharedFiles.create(benchmark.sparkSession, "benchmark")
    block, size, n = [], 0, 0
    for r in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        if r["t"] is None:
            continue
        block.append((r["i"], r["t"]))
        size += len(r["t"]) * width
        if size >= limit:
            files.write(str(n), pickle.dumps(block))
            block, size, n = [], 0, n + 1
    if block:
        files.write(str(n), pickle.dumps(block))
    return files, n + bool(block)


#: The automaton that this worker process built last, and what it was built from.
_built: dict[tuple, "ahocorasick.Automaton"] = {}


def _automaton(files: SharedFiles, k: int, width: int) -> "ahocorasick.Automaton":
    key = (files.uri, k, width)
    if key not in _built:
        _built.clear()
        _built[key] = build(pickle.loads(files.map(str(k)).tobytes()), width)
    return _built[key]


def _matched(batches: Iterator[pa.RecordBatch], at: int, files: SharedFiles, n: int, width: int) -> Iterator[tuple]:
    """Batches with the texts in column ``at``, and the words, hit words, items and whether a whole window occurs of
    each. One automaton is built once for a worker; of several, each is built once for HELD_BYTES of text."""

    def flush(held: list) -> Iterator[tuple]:
        found = []
        for b in held:
            texts = b.column(at).to_pylist()
            words = [normal_words(t) for t in texts]
            found.append((b, texts, words, [np.zeros(len(w), bool) for w in words], [set() for _ in words], np.zeros(len(words), bool)))
        for k in range(n):
            a = _automaton(files, k, width)
            for _, _, words, hits, items, whole in found:
                for i, w in enumerate(words):
                    whole[i] |= scan(w, a, hits[i], items[i], width)
        yield from found

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(at).nbytes
        if n < 2 or size >= HELD_BYTES:
            yield from flush(held)
            held, size = [], 0
    yield from flush(held)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 13, min_share: int = 20, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """``docs``, all columns, without contaminated rows.

    A row goes if its text holds ``width`` consecutive words of a test item, however long the text, or if items shorter
    than that make up at least one in ``min_share`` of its words: a short answer inside a long text says nothing.
    Each row is judged by itself; null and wordless texts stay.
    """
    prepare(docs.sparkSession)
    files, n = _stored(benchmark, item_col, item_text_col, width, automaton_chars)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, words, hits, _, whole in _matched(batches, at, files, n, width):
            yield b.filter(pa.array([not (full or 0 < h.sum() and h.sum() * min_share >= len(w)) for w, h, full in zip(words, hits, whole)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 13, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items, spans``.

    ``items`` are the ids of test items of which a window occurs, sorted as strings; items without an id
    hit like any other, are left out of ``items`` and count in ``n_items`` as one; ``spans`` are the character
    bounds of hit passages in the original text. Null or wordless texts and items match nothing; repeated rows are
    rows of their own; items with the same window are all named. An empty benchmark hits nothing. Test items lie in
    files of the shared folder, as much in each as an automaton of bounded size takes; a worker holds one automaton.
    """
    prepare(docs.sparkSession)
    files, n = _stored(benchmark, item_col, item_text_col, width, automaton_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts, words, hits, items, _ in _matched(batches, 1, files, n, width):
            yield pa.record_batch(
                [
                    b.column(0),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([int(h.sum()) for h in hits], pa.int64()),
                    pa.array([len(i) for i in items], pa.int64()),
                    pa.array([sorted(str(x) for x in i if x is not None) for i in items], pa.list_(pa.string())),
                    pa.array([spans_of(t, h) if i else [] for t, h, i in zip(texts, hits, items)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items", "spans"],
            )

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:int,end:int>>")


def contaminated(min_share: int = 20):
    """A document is contaminated if at least one in ``min_share`` of its words is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * min_share >= F.col("n_words"))


def items_sha256():
    return F.sha2(F.array_join("items", ",").cast("binary"), 256)


