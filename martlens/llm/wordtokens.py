"""Token ids as the ``tokenizers`` library gives them, chunk by chunk.

Both kinds of vocabulary here end a word at white space, so the ids of a text are
those of its chunks between spaces.  Chunks are encoded once per batch and the
frequent ones remembered.  A text of ASCII and Latin letters is lower-cased as a
whole, and its chunks go through the batched merge rounds of
:mod:`martlens.llm.bpe`.  Of any other text each chunk is looked at: one with marks
that may compose, another script or a special string goes through the library itself.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Sequence

import numpy as np
import regex
import tokenizers

from martlens.llm.bpe import Merges, Store, byte_letters

# The word pattern of the lower-casing vocabulary, and the characters
# whose lower case and normal form are one character each.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_PLAIN = regex.compile(r"[!-~À-ÖØ-öø-ÿ]*")
_SPACES = regex.compile(" +")
_PLAIN_BYTES = bytes(b for b in range(256) if b in b"\n " or _PLAIN.fullmatch(chr(b)))
# A chunk of a text that is not lower-cased as a whole begins with this.
_RAW = "\n"


def version(path: str) -> str:
    """Digest of the tokenizer file and the library's version."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + tokenizers.__version__.encode()).hexdigest()


def library(path: str) -> tokenizers.Tokenizer:
    model = tokenizers.Tokenizer.from_file(path)
    model.no_padding()
    model.no_truncation()
    return model


class WordIds:
    """Ids of whole texts under a vocabulary that lower-cases and drops white space."""

    def __init__(self, path: str, bound: int):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"not a lower-casing word vocabulary: {path}")
        self.library = library(path)
        suffix = spec["model"]["end_of_word_suffix"] or ""
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        letters = byte_letters().values()
        self.merges = Merges(vocab, pairs, suffix)
        self.whole = all(c in vocab and c + suffix in vocab for c in letters)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.store = Store(self._make, bound)

    def _plain(self, text: str) -> bool:
        """Whether lower case and merges are all that its chunks need."""
        if not self.whole or any(t in text for t in self.special):
            return False
        if text.isascii():
            raw = text.encode()
        else:
            try:
                raw = text.encode("latin-1")
            except UnicodeEncodeError:
                return False
        return not raw.translate(None, _PLAIN_BYTES)

    def content(self, text: str) -> bytes:
        """What the ids depend on: the text as the tokenizer's normaliser leaves it.

        Special strings are found before that, so a text with one, in any case, stays raw.
        """
        low = text.lower()
        if any(t.lower() in low for t in self.special):
            return b"raw\0" + text.encode()
        if self._plain(text):
            plain = low.replace("\n", " ")
            return (_SPACES.sub(" ", plain) if "  " in plain else plain).encode()
        return self.library.normalizer.normalize_str(text).encode()

    def _make(self, chunks: Sequence[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each chunk."""
        out: list[bytes] = [b""] * len(chunks)
        several: dict[int, list[str]] = {}  # chunks of other than one word of letters
        other = []
        for i in [i for i, letters in enumerate(map(str.isalpha, chunks)) if not letters]:
            chunk = chunks[i]
            if chunk[:1] != _RAW:
                several[i] = _WORDS.findall(chunk)
                continue
            chunk = chunk[1:]
            known = chunk.isprintable() if chunk.isascii() else _PLAIN.fullmatch(chunk)
            if known and self.whole and not any(t in chunk for t in self.special):
                several[i] = _WORDS.findall(chunk.lower())
            else:
                other.append(i)
        single = [i for i, letters in enumerate(map(str.isalpha, chunks)) if letters]
        words = [chunks[i] for i in single]
        place = dict(zip(words, single, strict=True))  # a word's chunk, if it is one
        more = list(set().union(*several.values()).difference(place))
        words += more
        ids, ends = self.merges.encode([w.encode() for w in words])
        flat, ends = ids.astype("<u4").tobytes(), (ends * 4).tolist()
        begin = 0
        for i, end in zip(single, ends, strict=False):
            out[i] = flat[begin:end]
            begin = end
        known = {}
        for word, end in zip(more, ends[len(single) :], strict=True):
            known[word] = flat[begin:end]
            begin = end
        for i, parts in several.items():
            out[i] = b"".join([known[w] if w in known else out[place[w]] for w in parts])
        found = self.library.encode_batch([chunks[i][1:] for i in other], add_special_tokens=False)
        for i, one in zip(other, found, strict=True):
            out[i] = np.array(one.ids, "<u4").tobytes()
        return out

    def run(self, texts: Sequence[str]) -> list[bytes]:
        plans = []
        for text in texts:
            if self._plain(text):
                plans.append(text.lower().replace("\n", " ").split(" "))
            else:
                chunks = text.replace("\n", " ").split(" ")
                plans.append([_RAW + c for c in chunks])
        known = self.store.of(plans).__getitem__
        return [b"".join(map(known, plan)) for plan in plans]


@functools.lru_cache(maxsize=2)
def word_ids(path: str, bound: int = 500_000) -> WordIds:
    return WordIds(path, bound)
