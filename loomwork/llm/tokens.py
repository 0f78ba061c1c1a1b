"""Byte-level BPE through the tokenizers library, with the ids of pre-tokens kept in a bounded cache.

A byte-level BPE never merges over a pre-token's border, so a text's ids are its pre-tokens' ids in a row. Texts with
characters on which regular expression engines may disagree go to the library whole, and so do texts that hold the string of an
added token: the library makes one id of it, unless `added` is False, which takes such strings for ordinary text.
"""

from __future__ import annotations

import os
from array import array
from operator import attrgetter

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed value: how this vocabulary's pre-tokenizer splits text.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts made of these only are split here: ASCII, Latin letters and the punctuation of European languages.
UNSURE = r"[^\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧‰-⁞]"
#: Pieces and pre-tokens that a worker keeps. A full cache stays as it is, as the words that came first are the frequent
#: ones, and starts anew after PATIENCE times as many misses.
CACHE, PATIENCE = 250_000, 16
LONGEST_KEPT = 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_id = attrgetter("id")
_MARKS = frozenset(".,;:!?")


def byte_characters() -> dict[int, str]:
    """The character for each byte in a byte-level vocabulary: printable Latin-1 as it is, the others from 256 on in their order."""
    odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return {b: chr(256 + k) for k, b in enumerate(odd)}


class Kept(dict):
    """Values of `make`, remembered."""

    def __init__(self, make):
        super().__init__()
        self.make, self.misses = make, 0

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) < CACHE:
            if len(key) <= LONGEST_KEPT:
                self[key] = value
        else:
            self.misses += 1
            if self.misses > PATIENCE * CACHE:
                self.clear()
                self.misses = 0
        return value


class Encoder:
    """Ids as bytes: unsigned 32-bit little-endian."""

    def __init__(self, path: str, added: bool = True):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not added
        self.added = {t.content: k for k, t in self.tok.get_added_tokens_decoder().items()} if added else {}
        #: Characters after a pre-token that can have a say in where it ends.
        self.context = max([2, *(len(x) + 1 for x in self.added)])
        self.mark = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = regex.compile(PRETOKEN).findall
        self.unsure = regex.compile(UNSURE).search
        self.merge, self.char = self.tok.model.tokenize, byte_characters()
        self.blank = self.char[32]
        self.pre = Kept(self._merged)
        self.after_blank = Kept(self._after_blank)

    def _merged(self, pretoken: str) -> bytes:
        if pretoken in self.added:
            return array("I", [self.added[pretoken]]).tobytes()
        return array("I", map(_id, self.merge(pretoken.encode().decode("latin-1").translate(self.char)))).tobytes()

    def _after_blank(self, word: str) -> bytes:
        """The ids of a blank and what follows it."""
        if word.isalpha():
            if word.isascii():  # as they are in the vocabulary
                return array("I", map(_id, self.merge(self.blank + word))).tobytes()
            return self._merged(" " + word)
        if word[-1:] in _MARKS and word[:-1].isalpha():
            return self.after_blank[word[:-1]] + self.pre[word[-1]]
        return b"".join(map(self.pre.__getitem__, self.words(" " + word)))

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.unsure(text) or (self.mark and self.mark.search(text)):
            return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        if "  " in text:
            return b"".join(self.each(self.words(text)))
        # every blank stands alone and so starts a pre-token: what lies between two blanks has ids of its own
        head, *words = text.split(" ")
        return b"".join(self.each(self.words(head))) + b"".join(map(self.after_blank.__getitem__, words))

    def split(self, text: str) -> list[str]:
        """Pre-tokens, added tokens among them; no other reaches over one."""
        if not self.mark or not self.mark.search(text):
            return self.words(text)
        parts = self.mark.split(text)
        return [w for k, x in enumerate(parts) for w in ([x] if k % 2 else self.words(x))]

    def each(self, words: list[str]) -> list[bytes]:
        """The ids of each pre-token."""
        return list(map(self.pre.__getitem__, words))


_kept: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, added: bool = True) -> Encoder:
    """One for each worker process and vocabulary."""
    if (path, added) not in _kept:
        _kept[path, added] = Encoder(path, added)
    return _kept[path, added]
