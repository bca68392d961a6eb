"""Encoding whole texts with a tokenizers file, with a cache of words.

When the file says that no token crosses white space (the pre-tokenizer cuts there), a text's
ids are the ids of its words in order, so each distinct word is encoded once per worker. Words
of plain letters go straight to the model; all others through the library's full encoder.
Any other kind of file uses the full encoder for whole texts.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Words that the cache keeps, which bounds a worker's memory. The first so many stay: frequent words come
#: early. Once it is full, so many misses per kept word empty it, for texts that have become others.
CACHED_WORDS = 500_000
MISSES_PER_WORD = 20

# The normaliser and splitter of the word-level file, under which words are independent.
_WORD_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|#%&$*]*)").fullmatch
#: str.split() cuts at these although they are not white space to the library.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level files: itself where printable, else 256 and up."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = (chr(256 + i) for i in range(256))
    return {b: chr(b) if b in printable else next(spare) for b in range(256)}


class _Words(dict):
    """word -> its ids as little-endian 32-bit bytes."""

    def __init__(self, tokenizer):
        super().__init__()
        letters = _byte_letters()
        self.missed = 0
        self.marks: dict[str, bytes] = {}
        self.tokenizer = tokenizer
        self.piece = tokenizer.model.tokenize
        self.id_bytes = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]
        plain = [*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
        self.letters = str.maketrans({i: "".join(letters[b] for b in chr(i).lower().encode()) for i in plain})

    def piece_ids(self, letters: str) -> bytes:
        ids = self.id_bytes
        return b"".join([ids[t.id] for t in self.piece(letters)])

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            out = self.piece_ids(word.lower())
        elif (plain := _PLAIN(word)) is None:
            out = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            stem, marks = plain.groups()
            if marks:
                if len(self.marks) >= CACHED_WORDS:
                    self.marks.clear()
                if marks not in self.marks:
                    self.marks[marks] = self.piece_ids(marks)
                out = self[stem] + self.marks[marks]
            else:
                out = self.piece_ids(stem.translate(self.letters))
        if len(self) < CACHED_WORDS:
            self[word] = out
        else:
            self.missed += 1
            if self.missed > MISSES_PER_WORD * CACHED_WORDS:
                self.missed = 0
                self.clear()
        return out


class TextEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.words = _Words(self.tokenizer) if _by_words(spec) else None

    def ids(self, text: str) -> bytes:
        """The text's ids, each as four little-endian bytes."""
        if self.words is None or any(c in text for c in _ODD):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, text.split()))


def _by_words(spec: dict) -> bool:
    normalizer = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = spec["model"]
    return (
        normalizer == _WORD_NORMALIZER
        and [s.get("type") for s in splits] == ["Split", "ByteLevel"]
        and splits[0]["pattern"] == {"Regex": _WORD_SPLIT}
        and splits[0]["invert"]
        and not splits[1]["add_prefix_space"]
        and model["type"] == "BPE"
        and not model.get("dropout")
        and not model.get("continuing_subword_prefix")
        and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
    )


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The worker's encoder for a file; its cache lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]
