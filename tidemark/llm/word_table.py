"""Token ids of whole texts through a table of distinct chunks.

The word tokenizer never joins across white space, so a text's ids are those of
its chunks between spaces and line feeds, joined. Each distinct chunk is encoded
once per worker and kept as packed little-endian ids; a text is then one join of
byte strings. Chunks of ASCII and Latin-1 letters, digits and ASCII marks take a
short path through the library's BPE model; all others the library's full one.
"""

from __future__ import annotations

import re

import numpy as np

from tidemark.llm.common import worker_table

#: Distinct chunks of a generation; longer ones than ``CHUNK_CHARS`` are encoded anew each time. A full table becomes the old generation, from which chunks still in use return.
TABLE_LIMIT = 400_000
CHUNK_CHARS = 64

#: The pre-tokenizer's alternatives for lower-cased ASCII and Latin-1 text.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, n = [], 0
    for b in range(256):
        out.append(chr(b) if b in kept else chr(256 + n))
        n += b not in kept
    return out


class WordTable(dict):
    def __init__(self, path: str, limit: int = TABLE_LIMIT):
        super().__init__()
        from tokenizers import Tokenizer

        self.tok, self.limit = Tokenizer.from_file(path), limit
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.ids = [i.to_bytes(self.width, "little") for i in range(self.tok.get_vocab_size())]
        self.letters, self.parts, self.model = _byte_letters(), {}, self.tok.model
        self.old: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}
        self[""] = b""

    @staticmethod
    def load(path: str) -> WordTable:
        return worker_table(f"words {path}", lambda: WordTable(path))

    def trim(self) -> None:
        """Between tasks only the present generation is kept."""
        self.old, self.old_parts = {}, {}

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            got = self.old_parts.get(part)
            if got is not None:
                self.parts[part] = got
        if got is None:
            spelled = part if part.isascii() else "".join(self.letters[b] for b in part.encode())
            ids = self.ids
            got = b"".join([ids[t.id] for t in self.model.tokenize(spelled)])
            if len(part) <= CHUNK_CHARS:
                self.parts[part] = got
        return got

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
            self[""] = b""
        if len(self.parts) >= self.limit:
            self.old_parts, self.parts = self.parts, {}
        ids = self.old.get(chunk)
        if ids is not None:
            self[chunk] = ids
            return ids
        ids = self._encoded(chunk)
        if len(chunk) <= CHUNK_CHARS:
            self[chunk] = ids
        return ids

    def _encoded(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return self._part(chunk.lower())
        if chunk[-1] in ".," and chunk[:-1].isascii() and chunk[:-1].isalpha():
            return self._part(chunk[:-1].lower()) + self._part(chunk[-1])
        if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
            return b"".join([self._part(p) for p in _PIECES.findall(chunk.lower())])
        return b"".join([self.ids[i] for i in self.tok.encode(chunk, add_special_tokens=False).ids])

    def packed(self, text: str) -> bytes:
        """The packed ids of ``text``."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))
