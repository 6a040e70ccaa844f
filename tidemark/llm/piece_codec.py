"""Operator 9: SentencePiece encoding and decoding through a distinct-chunk table.

No piece of such a model crosses from text to a following white-space marker,
and none joins a line feed to anything (both are checked when the model is
loaded). So a text splits before each run of markers and before each line feed;
each distinct marked word is segmented once per worker and ids are joined back
by position. A model that fails the check is applied to whole texts.

Edge cases: a null or empty text has no ids and decodes to the empty string; a
null ``doc_id`` stays null; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.common import per_batch, texts, worker_table

MARK = "▁"
#: Distinct chunks that a worker remembers; longer ones than ``CHUNK_CHARS`` are encoded anew each time.
TABLE_LIMIT, CHUNK_CHARS = 400_000, 64


class PieceTable(dict):
    def __init__(self, path: str, limit: int = TABLE_LIMIT):
        super().__init__()
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.limit = limit
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.width = 2 if len(pieces) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.lead = self.sp.piece_to_id(MARK)
        inner = any(MARK in p.lstrip(MARK) for p in pieces)
        feeds = any("\n" in p and p != "\n" for p in pieces)
        spaced = self.sp.encode("a  b\n c ") == self.sp.encode("a") + self.sp.encode(" b") + self.sp.encode("\n")[1:] + self.sp.encode("c") + [self.lead]
        self.split = not inner and not feeds and spaced and self.lead != self.sp.unk_id()

    @staticmethod
    def load(path: str) -> PieceTable:
        return worker_table(f"pieces {path}", lambda: PieceTable(path))

    def trim(self) -> None:
        """All chunks are kept between tasks, up to the limit."""

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        """A chunk is a word after one marker; with leading spaces, after that many more; after a line feed, after none."""
        if len(self) >= self.limit:
            self.clear()
        if chunk[:1] == "\n":
            ids = self.sp.encode(chunk)[1:]
        elif chunk.startswith(" ") and "\n" in chunk:
            spaces = len(chunk) - len(chunk.lstrip(" "))
            ids = (self.sp.encode(" " * (spaces - 1)) if spaces > 1 else [self.lead]) + self.sp.encode(chunk[spaces:])[1:]
        elif chunk == "":
            ids = [self.lead]
        else:
            ids = self.sp.encode(chunk)
        packed = self._pack(ids)
        if len(chunk) <= CHUNK_CHARS:
            self[chunk] = packed
        return packed

    def packed(self, text: str) -> bytes:
        if text == "":
            return b""
        if not self.split:
            return self._pack(self.sp.encode(text))
        if MARK in text:
            text = text.replace(MARK, " ")
        words = text.replace("\n", " \n").split(" ")
        if "" not in words:
            return b"".join(map(self.__getitem__, words))
        out, gap = [], 0
        for w in words[:-1]:
            if w == "":
                gap += 1
            else:
                out.append(self[" " * gap + w])
                gap = 0
        last = words[-1]
        out.append(self[" " * gap + last])
        return b"".join(out)


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded) of every whole text."""

    def run(b: dict) -> dict:
        t = PieceTable.load(model)
        ids = [np.frombuffer(t.packed(x), t.dtype).tolist() for x in b["text"]]
        return {"doc_id": b["doc_id"], "ids": ids, "decoded": [t.sp.decode(x) if x else "" for x in ids]}

    return per_batch(texts(docs), run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), made where the text is encoded so that ids never travel."""

    def run(b: dict) -> dict:
        t = PieceTable.load(model)
        n, a, d = [], [], []
        for x in b["text"]:
            ids = np.frombuffer(t.packed(x), t.dtype).tolist()
            n.append(len(ids))
            a.append(hashlib.sha256(str(ids)[1:-1].replace(" ", "").encode()).hexdigest())
            d.append(hashlib.sha256((t.sp.decode(ids) if ids else "").encode()).hexdigest())
        return {"doc_id": b["doc_id"], "n_tokens": n, "ids_sha256": a, "decoded_sha256": d}

    return per_batch(texts(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
