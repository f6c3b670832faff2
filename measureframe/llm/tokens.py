"""Token ids of whole texts by public tokenizers, with a bounded memory of words."""

from __future__ import annotations

import string
import struct
from functools import lru_cache

#: Entries that a worker's memory of encoded words may hold; it is then begun anew.
MEMORY = 600_000
_SEEN = (1 << 22) - 1


def byte_alphabet() -> dict[int, str]:
    """The characters that byte-level BPE writes bytes with: printable ones stay, others follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


class _Words(dict):
    """Ids of ``prefix + word`` for words without white space at either end.

    A word met once is not kept, so words that never return do not push out the others.
    """

    def __init__(self, owner: ByteBpe, prefix: str) -> None:
        self.owner, self.prefix, self.seen = owner, prefix, bytearray(_SEEN + 1)

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise ValueError  # white space runs together with what is beside the word
        value = self._ids(word)
        at = hash(word) & _SEEN
        if self.seen[at] and len(word) <= 64:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = value
        self.seen[at] = 1
        return value

    def _ids(self, word: str) -> bytes:
        own = self.owner
        if "\n" in word:
            first, *rest = word.split("\n")
            if all(rest):
                return self[first] + b"".join(own.newline + own.bare[r] for r in rest)
        letters = word.rstrip(string.punctuation)
        if not letters or letters == word and word.isalpha():
            return own.one(self.prefix + word)
        if letters.isalpha():
            return self[letters] + own.bare[word[len(letters):]]
        return own.whole(self.prefix + word)


class ByteBpe:
    """Ids (little-endian, unsigned 32 bit) by a byte-level BPE tokenizer file, special tokens not added.

    The tokenizer first cuts a text into pieces: letters, digits or other signs, each with one space
    before it, and runs of white space.  So a text falls apart at every single space
    between two words, and a word into its letters and the signs behind them; such parts are encoded
    once and remembered.  A text with other white space beside a space, or with the
    text of a special token, is encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.special = self.tokenizer.model, [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.alphabet = byte_alphabet()
        self.spaced, self.bare = _Words(self, " "), _Words(self, "")
        self.newline = self.whole("\n")

    def one(self, piece: str) -> bytes:
        """Ids of a text that is a single piece."""
        ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if not any(s in text for s in self.special):
            first, *rest = text.split(" ")
            try:
                return self.bare[first] + b"".join(map(self.spaced.__getitem__, rest))
            except ValueError:
                pass
        return self.whole(text)


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
