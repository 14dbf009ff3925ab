"""Token ids of whole texts by a public tokenizer file.

The tokenizer joins white space and never looks across it, so the ids of a text are those of its parts
between spaces, tabs and line ends, one after the other. Each part goes to the library once per worker and
is then looked up; a bounded number of short parts is kept. A part of letters with punctuation behind is
what the tokenizer's own splitting makes two pieces of, so it goes to the library's BPE model directly;
everything else goes through the whole tokenizer.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np

PART = re.compile(r"[^ \t\n\r]+")
#: White space that str.split() cuts at besides the four characters of PART.
OTHER_SPACE = [chr(c) for c in (11, 12, 28, 29, 30, 31, 133, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
KEPT_PARTS = 1_000_000
KEPT_LENGTH = 48


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, other = {b: chr(b) for b in plain}, iter(range(256, 512))
    return [letters[b] if b in letters else chr(next(other)) for b in range(256)]


class Encoder:
    def __init__(self, path: str, kept: int = KEPT_PARTS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.kept, self.known, self.letters = kept, {}, _byte_letters()

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype.itemsize == 2 else 'I'}", *ids)

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join([self.letters[b] for b in piece.encode()])
        return self._packed([t.id for t in self.tokenizer.model.tokenize(piece)])

    def _lower(self, core: str) -> str:
        if core.isascii() or (max(core) < "\u0180" and unicodedata.is_normalized("NFC", core)):
            return core.lower()
        return self.tokenizer.normalizer.normalize_str(core)

    def _learn(self, parts: set[str]) -> None:
        whole = []
        for part in parts:
            core = part.rstrip(TAIL)
            if core.isalpha() and (low := self._lower(core)).isalpha():
                tail = part[len(core):]
                self.known[part] = self._piece(low) + (self._piece(tail) if tail else b"")
            else:
                whole.append(part)
        found = self.tokenizer.encode_batch_fast(whole, add_special_tokens=False) if whole else []
        for part, e in zip(whole, found):
            self.known[part] = self._packed(e.ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as packed little-endian integers of ``dtype``; nothing for a null or empty text."""
        out = []
        for text in texts:
            text = text or ""
            parts = PART.findall(text) if any(c in text for c in OTHER_SPACE) else text.split()
            found = list(map(self.known.get, parts))
            if None in found:
                new = {p for p, ids in zip(parts, found) if ids is None}
                if len(self.known) + len(new) > self.kept:
                    self.known, new = {}, set(parts)
                self._learn(new)
                found = list(map(self.known.__getitem__, parts))
                for p in new:
                    if len(p) > KEPT_LENGTH:
                        del self.known[p]
            out.append(b"".join(found))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
