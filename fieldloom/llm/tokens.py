"""Token ids of whole texts with the tokenizers library, made fast by encoding each distinct piece once.

A byte-level BPE splits a text into pieces before merging and never merges across them, so a text's ids are
the ids of its pieces in order. Between a character that is no white space and a following space there is
always such a border, and a single line feed between two others is a piece of its own; texts are cut there, each distinct
piece is encoded once by the library and kept in a bounded cache of the worker process. Texts in which the cut could fall inside a run of white space are encoded whole.
The place of the vocabulary file is a parameter.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

#: New pieces after which a worker forgets those that it hasn't met since as many before; so it keeps twice as many at most.
CACHE_PIECES = 500_000
#: A plain word and the marks after it: the pre-tokenizer makes one piece of each.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")

_encoders: dict[tuple[str, int], Encoder] = {}


def default_tokenizer() -> str:
    """The public byte-level BPE of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    import os

    key = (path, os.getpid())
    if key not in _encoders:
        _encoders[key] = Encoder(path)
    return _encoders[key]


def forget() -> None:
    """Frees this process's encoders and their pieces; workers that go on to another kind of task needn't hold them."""
    _encoders.clear()


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(256 + rest.index(b)) if b not in shown else chr(b) for b in range(256)}


class Encoder:
    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        self.by_pieces = isinstance(self.whole.pre_tokenizer, ByteLevel) and self.whole.normalizer is None and not self.whole.pre_tokenizer.add_prefix_space
        self.dtype = np.uint16 if self.whole.get_vocab_size() <= 1 << 16 else np.uint32
        self.code = "H" if self.dtype == np.uint16 else "I"
        self.cache = _Pieces(self)

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _whole(self, text: str) -> bytes:
        return self.pack(self.whole.encode(text, add_special_tokens=False).ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without special tokens, as arrays of the smallest unsigned type."""
        out = []
        for text in texts:
            if len(self.cache) > CACHE_PIECES:
                self.cache.age()
            ids = None
            if self.by_pieces and "\0" not in text:
                try:
                    ids = b"".join(map(self.cache.__getitem__, ("\0" + text).split(" ")))
                except _Unsure:
                    pass
            out.append(np.frombuffer(self._whole(text) if ids is None else ids, dtype=self.dtype))
        return out


class _Unsure(Exception):
    """A piece that the cut at spaces may have torn out of a run of white space."""


class _Pieces(dict):
    """The ids of pieces. A key is what follows a space; the first piece of a text has \\0 before it instead."""

    def __init__(self, owner: Encoder) -> None:
        self.whole, self.pack, self.tokenize = owner._whole, owner.pack, owner.whole.model.tokenize
        self.table = _byte_letters()
        self.space, self.feed = self.table[0x20], self.whole("\n")
        self.older: dict[str, bytes] = {}

    def age(self) -> None:
        self.older = dict(self)
        self.clear()

    def __missing__(self, key: str) -> bytes:
        if key in self.older:
            return self.setdefault(key, self.older[key])
        first = key[:1] == "\0"
        word = key[1:] if first else key
        if m := _PLAIN.match(word):
            plain, marks = m.groups()
            ids = self.get("\0" + plain if first else plain) if marks else None
            if ids is None:
                letters = plain if plain.isascii() else plain.encode().decode("latin-1").translate(self.table)
                ids = self.pack([t.id for t in self.tokenize(letters if first else self.space + letters)])
            if marks:
                ids += self._marks(marks)
        elif first and not word:
            ids = b""
        elif not word or word[0].isspace() and not first or word[-1].isspace():
            raise _Unsure
        elif (cut := word.find("\n")) > 0 and not word[cut - 1].isspace() and not word[cut + 1].isspace():
            ids = self["\0" + word[:cut] if first else word[:cut]] + self.feed + self["\0" + word[cut + 1 :]]
        else:
            ids = self.whole(word if first else " " + word)
        self[key] = ids
        return ids

    def _marks(self, marks: str) -> bytes:
        key = "\0" + marks
        return self[key] if key in self else self.setdefault(key, self.whole(marks))
