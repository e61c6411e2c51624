"""What the splitting of texts into words takes beside the texts."""

import random
import tracemalloc

import numpy as np

from tessel.llm import text


def test_words_of_a_full_run_take_little_memory(monkeypatch):
    rng = random.Random(1)
    doc = " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 12))) for _ in range(text.CHUNK_BYTES // 8)).encode()
    buf, offsets = np.frombuffer(doc, np.uint8), np.array([0, len(doc) // 2, len(doc)])
    monkeypatch.setattr(text, "_tables", {})
    tracemalloc.start()
    w = text.words_of(buf, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(doc)
    monkeypatch.setattr(text, "HASH_BYTES", 50)
    monkeypatch.setattr(text, "_tables", {})
    few = doc[: doc.index(b" ", 1 << 14)]
    runs = text.words_of(np.frombuffer(few, np.uint8), np.array([0, len(few)])).hash
    assert len(runs) > 1000 and (runs == w.hash[: len(runs)]).all()
