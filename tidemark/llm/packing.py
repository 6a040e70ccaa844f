"""Operator 5: best-fit packing of documents into fixed-length token sequences by exact complements.

Only lengths matter for a packing, and there are at most ``capacity`` distinct
ones, so the plan is made from the corpus's length counts alone (complete, and
of bounded size whatever the corpus). Longest first, an index of the lengths
still available gives a single, a pair or a triple that exactly fills the gap;
the combination is consumed as often as its counts allow. Residual lengths go
best-fit into the fullest sequence that still holds them. The plan is a set of
patterns with multiplicities; a piece finds its place by its rank among the
pieces of its length, numbered in parallel with hot lengths split over buckets.

Edge cases: a null text is empty and packs as its end id alone; a null
``doc_id`` stays null; repeated rows are packed each; an empty table gives no
rows; a document longer than the capacity is cut into pieces of exactly the
capacity and a last one that may be shorter; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import per_batch, save, texts
from tidemark.llm.word_table import WordTable

CAPACITY = 4096
END_ID = 1


class _Sums:
    """Singles, pairs and triples of available lengths by their sum.

    ``held`` are pieces that are set aside while a combination is sought. A pair
    that only they block is skipped for now; the place in a sum's list of pairs
    moves on only past pairs that the real counts no longer allow.
    """

    def __init__(self, count: np.ndarray):
        self.count, self.pairs = count, {}

    def left(self, n: int, held: dict[int, int]) -> int:
        return int(self.count[n]) - held.get(n, 0)

    def single(self, gap: int, held: dict[int, int]) -> tuple[int, ...] | None:
        return (gap,) if self.left(gap, held) > 0 else None

    def _fits(self, a: int, gap: int, held: dict[int, int]) -> bool:
        if 2 * a == gap:
            return self.left(a, held) >= 2
        return self.left(a, held) >= 1 and self.left(gap - a, held) >= 1

    def pair(self, gap: int, held: dict[int, int]) -> tuple[int, ...] | None:
        if gap not in self.pairs:
            a = np.arange(gap - 1, (gap - 1) // 2, -1)
            self.pairs[gap] = [a[(self.count[a] > 0) & (self.count[gap - a] > 0)].tolist(), 0]
        at = self.pairs[gap]
        while at[1] < len(at[0]) and not self._fits(at[0][at[1]], gap, {}):
            at[1] += 1
        for i in range(at[1], len(at[0])):
            a = at[0][i]
            if self._fits(a, gap, held):
                return a, gap - a
        return None

    def triple(self, gap: int, held: dict[int, int]) -> tuple[int, ...] | None:
        for a in np.flatnonzero(self.count[: max(gap - 1, 0)])[::-1].tolist():
            if 3 * a < gap:
                return None
            if self.left(a, held) > 0:
                rest = self.pair(gap - a, {**held, a: held.get(a, 0) + 1})
                if rest:
                    return (a, *rest)
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Patterns as (how many sequences, {length: pieces in each})."""
    c = np.zeros(capacity + 1, dtype=np.int64)
    for n, k in counts.items():
        c[n] += k
    out: list[tuple[int, dict[int, int]]] = []

    def consume(combo: tuple[int, ...]) -> int:
        need: dict[int, int] = {}
        for n in combo:
            need[n] = need.get(n, 0) + 1
        m = min(int(c[n]) // q for n, q in need.items())
        if m:
            for n, q in need.items():
                c[n] -= m * q
            out.append((m, need))
        return m

    if c[capacity]:
        consume((capacity,))
    sums = _Sums(c)
    for n in range(capacity - 1, 0, -1):
        for find in (sums.single, sums.pair, sums.triple):
            while c[n] > 0:
                combo = find(capacity - n, {n: 1})  # the piece whose gap is filled is not its own partner
                if combo is None or not consume((n, *combo)):
                    break
    return out + _best_fit(c, capacity)


def _best_fit(c: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Residual lengths, longest first, each into the open sequences with the least room that holds it."""
    rooms: dict[int, list[list]] = {}  # room -> groups [sequences, pattern]
    for n in np.flatnonzero(c)[::-1]:
        n, left = int(n), int(c[n])
        while left:
            room = min((r for r in rooms if r >= n), default=None)
            if room is None:
                each = min(capacity // n, left)
                m = left // each
                rooms.setdefault(capacity - n * each, []).append([m, {n: each}])
                left -= m * each
                continue
            group = rooms[room][-1]
            each = min(room // n, left)
            m = min(group[0], left // each)
            rooms.setdefault(room - n * each, []).append([m, {**group[1], n: each}])
            group[0] -= m
            left -= m * each
            if not group[0]:
                rooms[room].remove(group)
                if not rooms[room]:
                    del rooms[room]
    return [(m, p) for groups in rooms.values() for m, p in groups]


def slots(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces of the length per sequence, offset of the first)."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for m, pattern in patterns:
        offset = 0
        for n, q in sorted(pattern.items(), reverse=True):
            lo = taken.get(n, 0)
            out.append((n, lo, lo + m * q, sequence, q, offset))
            taken[n] = lo + m * q
            offset += n * q
        sequence += m
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and the end id, cut at the capacity."""

    def run(b: dict) -> dict:
        t = WordTable.load(tokenizer)
        out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        for d, x in zip(b["doc_id"], b["text"], strict=True):
            ids = np.append(np.frombuffer(t.packed(x), t.dtype).astype("<u4"), np.uint32(end_id))
            for i in range(0, len(ids), capacity):
                p = ids[i : i + capacity]
                for k, v in zip(out, (d, i // capacity, i, len(p), zlib.crc32(p.astype("<u4").tobytes())), strict=True):
                    out[k].append(v)
        return out

    return per_batch(texts(docs), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, buckets: int | None = None) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    cut = save(pieces(docs, tokenizer, capacity, end_id), "pieces")
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)))
    per = cut.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    lengths = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most capacity rows
    rows = slots(plan(lengths, capacity))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # at most capacity x buckets rows
    rank = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("_r", rank).join(base, ["length", "_b"]).withColumn("_r", F.col("_r") + F.col("_base"))
    table = spark.createDataFrame(rows, "length long, _lo long, _hi long, _seq long, _q long, _off long")
    placed = ranked.join(F.broadcast(table), "length").where("_r >= _lo and _r < _hi")  # slots are bounded by the capacity, not the corpus
    k = F.col("_r") - F.col("_lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_seq") + F.expr("(_r - _lo) div _q")).alias("sequence_id"),
        (F.col("_off") + F.pmod(k, F.col("_q")) * F.col("length")).alias("offset"),
    )
