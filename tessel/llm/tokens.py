"""Fast exact token ids of a byte-level BPE file: words are cut by its pattern and encoded once each."""

from __future__ import annotations

import json
import re

import numpy as np

#: Distinct words whose ids a worker keeps; beyond it, it starts afresh.
CACHE_WORDS = 1_000_000


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Known(dict):
    """Ids of words; a word not seen before is encoded on the way."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        self[word] = out = b"".join([i.to_bytes(4, "little") for i in self.encode(word)])
        return out


#: The file's pattern for the standard library's faster engine, and the texts on which the two may differ.
_FAST = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
_SLOW_TEXT = "[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]|[^\x00-\u024f]"


class ByteBpe:
    """Ids as ``tokenizers`` gives them with ``add_special_tokens=False``, as little-endian uint32 bytes.

    The pre-tokeniser's pattern splits a text into words and BPE never merges across words, so the ids of a text are
    those of its words in turn. Words are encoded from the file's own vocabulary, whose ids are in merge order, by
    the faster of the two libraries; tests hold the ids against ``tokenizers``. Texts that contain an added token's
    string go through ``tokenizers`` whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte = _byte_of_char()
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in self.added}
        enc = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known = _Known(enc.encode_ordinary)
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.fast, self.slow_text = re.compile(_FAST).findall, re.compile(_SLOW_TEXT).search

    def reference(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return self.reference(text)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        words = self.find(text) if self.slow_text(text) else self.fast(text)
        return b"".join(map(self.known.__getitem__, words))
