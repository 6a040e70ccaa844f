"""Operator 7: near-duplicate groups by improved consistent weighted sampling.

A document is its five-word shingles (words lower-cased, outer punctuation
dropped; a shorter text is one shingle) with weight count x idf. The document
frequency of every shingle is counted exactly: chunks of documents send their
distinct shingles, sorted and packed by range of hash, in one shuffle, and each
range keeps those of two or more documents.

Frequencies count a group's own copies, so what they share weighs little and an
edit weighs much, the more so the larger group and corpus are. Similarity is
therefore that of the weights or, from ``COPIES`` on, that of the counts alone.

Candidates come from ``BANDS`` x ``ROWS`` consistent weighted samples and from
``COUNT_BANDS`` x ``ROWS`` of the counts alone. For the samples the idf is read
from a table of bounded size that every task holds: exact for shingles in at
least ``HEAVY`` of all documents, and for the others the mean frequency of an
occurrence in their ``SLOTS``-th of the hash range. An error of it moves the
chance that a pair meets, never a verdict: every pair is verified by Jaccard
similarity of the whole texts with the exact frequencies, which are joined to
the texts that have a candidate.

Equal texts are one node. In each bucket the ``LEADERS`` nodes of least hash are
compared with all members, so pairs grow linearly with a bucket, and buckets of
up to LEADERS + 1 nodes are compared in full. The texts of larger buckets that
still hold several groups are joined by prefix filtering, which is exact: each
offers its rarest shingles, up to a fifth of its weight or, if that is more, a
sixth of its count; those that share one meet its leaders, then all of other
groups that can still be similar. Buckets are dealt over ``SALTS``, so a hot one
is no single task's. Links join groups by min-label propagation over tables in
the shared folder.

Edge cases: null and empty texts are equal texts; a null ``doc_id`` comes before
all others and gives a null ``class_id``; rows of one id and text are one
document; an empty table gives no rows; other columns pass through ``dedup``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_task, frugal, save
from tidemark.llm.word_hash import byte_table, word_hashes
from tidemark.session import broadcast_if_small

WORDS, SIMILAR = 5, 0.8
#: Similarity by counts alone that makes a link whatever the weights.
COPIES = 5 / 6
BANDS, COUNT_BANDS, ROWS, LEADERS = 14, 6, 3, 4
HEAVY, SLOTS = 0.005, 1 << 20
CHUNK_DOCS, CHUNK_CHARS = 20_000, 1 << 22
BATCH_CHARS = 1 << 18
#: Ranges of hashes are of about so many characters of text; several of them, picked by hash, make a task, so that tasks are of like size.
PART_CHARS, TASK_PARTS, MAX_TASKS = 1 << 21, 4, 8192
DRAWS, SALTS = 1 << 15, 8
FREQ = np.dtype([("s", "<u8"), ("c", "<u8")])
MAX_ROUNDS = 60
#: Different texts of a task whose band keys are remembered.
SIGNED = 20_000
#: Marks that do not count at a word's ends.
_OUTER = byte_table(".,;:!?\"'()[]{}#*$%&|<>-")
_NULL = -(2**63)
_M = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingle_batch(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes (sorted within a text) of all texts, their counts, and where each text's begin (one entry more than texts)."""
    data = [x.lower().encode() for x in texts]
    h, at, _ = word_hashes(b" ".join(data), strip=_OUTER)
    edges = np.cumsum([0, *(len(x) + 1 for x in data)])
    end = np.searchsorted(at, edges[1:])
    size = np.diff(end, prepend=0)
    held = np.concatenate([h, np.zeros(WORDS, np.uint64)])
    s = np.zeros(len(h), dtype=np.uint64)
    for j in range(WORDS):
        s += _mix(held[j : j + len(h)] * _M[j])  # adds _mix(0) = 0 beyond the end
    first = end - size
    for i in np.flatnonzero((size < WORDS) & (size > 0)):  # a short text is one shingle of its own words
        own, v = h[first[i] : end[i]], np.zeros(1, np.uint64)
        for j in range(len(own)):
            v += _mix(own[j : j + 1] * _M[j])
        s[first[i]] = v[0]
    n = np.where(size > 0, np.maximum(1, size - WORDS + 1), 0)
    on = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    s = _mix(s[on])
    ends = np.cumsum(n)
    for a, z in zip((ends - n).tolist(), ends.tolist(), strict=True):
        s[a:z].sort()
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    new[(ends - n)[n > 0]] = True
    at = np.flatnonzero(new)
    return s[at], np.diff(at, append=len(s)), np.searchsorted(at, np.concatenate([[0], ends]))


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (sorted) and their counts."""
    return shingle_batch([text or ""])[:2]


def in_batches(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) in groups of at most ``BATCH_CHARS`` characters; a longer text is a group of its own."""
    own, at, size = [], 0, 0
    for i, x in enumerate(texts):
        if own and size + len(x) > BATCH_CHARS:
            yield at, own
            own, at, size = [], i, 0
        own.append(x)
        size += len(x)
    if own:
        yield at, own


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


class Weights:
    """idf of shingles: those in ``keys`` by their counts, a text's others by the ``FREQ`` records that come with it, all else is in one document.

    ``slots`` are mean frequencies by range of hash, which ``estimated`` uses instead of records.
    """

    def __init__(self, docs: int, keys: np.ndarray, counts: np.ndarray, slots: np.ndarray | None = None):
        order = np.argsort(keys)
        self.docs, self.keys = docs, keys[order]
        self.idf = np.log1p(docs / np.maximum(counts[order], 1))
        self.slots = None if slots is None else np.log1p(docs / slots)

    def heavy(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which shingles are frequent, and the places of those in ``keys``."""
        if not len(self.keys):
            return np.zeros(len(s), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        hit = self.keys[at] == s
        return hit, at[hit]

    def of(self, s: np.ndarray, n: np.ndarray, freq: bytes | None = None) -> np.ndarray:
        w = np.full(len(s), np.log1p(self.docs))
        if freq:
            r = np.frombuffer(freq, FREQ)
            w[np.searchsorted(s, r["s"])] = np.log1p(self.docs / r["c"])
        hit, at = self.heavy(s)
        w[hit] = self.idf[at]
        return w * n

    def estimated(self, s: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = self.slots[_slot(s)]
        hit, at = self.heavy(s)
        w[hit] = self.idf[at]
        return w * n


def jaccard(s: np.ndarray, x: np.ndarray, t: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard similarity of two texts given as sorted shingles and their weights; two empty texts are alike."""
    if not len(s) or not len(t):
        return float(len(s) == len(t))
    if len(s) > len(t):
        s, x, t, y = t, y, s, x
    at = np.minimum(np.searchsorted(t, s), len(t) - 1)
    on = t[at] == s
    both = np.minimum(x[on], y[at[on]]).sum()
    return float(both / (x.sum() + y.sum() - both))


def likeness(s: np.ndarray, x: np.ndarray, n: np.ndarray, t: np.ndarray, y: np.ndarray, m: np.ndarray) -> float:
    """``jaccard`` by the weights ``x`` and ``y``; where that makes no link, by the counts ``n`` and ``m`` if that is ``COPIES`` or more."""
    weighted = jaccard(s, x, t, y)
    counted = jaccard(s, n, t, m) if weighted < SIMILAR else 0.0
    return counted if counted >= COPIES else weighted


def similarity(a: tuple, b: tuple, weights: Weights) -> float:
    """``likeness`` of two ``shingles`` results, each with its ``freq`` if known."""
    return likeness(a[0], weights.of(*a), a[1], b[0], weights.of(*b), b[1])


def _stored(n: np.ndarray) -> bytes:
    """Counts as bytes, none if all are 1."""
    return b"" if (n == 1).all() else n.astype("<u4").tobytes()


def _counts(b: bytes | pa.Buffer, size: int) -> np.ndarray:
    return np.frombuffer(b, "<u4").astype(np.int64) if len(b) else np.ones(size, np.int64)


@lru_cache(maxsize=(BANDS + COUNT_BANDS) * ROWS)
def _draws(j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sample ``j``'s gamma, log gamma and uniform variables; a shingle takes those of its place among ``DRAWS``."""
    g = np.random.Generator(np.random.PCG64([11, j]))
    return g.gamma(2, 1, DRAWS).astype(np.float32), np.log(g.gamma(2, 1, DRAWS)).astype(np.float32), g.random(DRAWS, dtype=np.float32)


def samples(s: np.ndarray, w: np.ndarray, k: int = BANDS * ROWS, bounds: np.ndarray | None = None, start: int = 0) -> np.ndarray:
    """``k`` consistent weighted samples, from number ``start`` on, of each non-empty text: the hash of the chosen (shingle, quantum). Texts lie between ``bounds``."""
    first = (np.array([0]) if bounds is None else bounds[:-1]).astype(np.int64)
    size = np.diff(np.append(first, len(s)))
    lw = np.log(w).astype(np.float32)
    at = (_mix(s * _M[1]) & np.uint64(DRAWS - 1)).astype(np.int64)
    out = np.empty((k, len(first)), dtype=np.uint64)
    for j in range(k):
        r, lc, beta = (x.take(at) for x in _draws(start + j))
        t = np.floor(lw / r + beta)
        a = lc - r * (t - beta + np.float32(1))
        low = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, first), size))
        best = low[np.searchsorted(low, first)]
        out[j] = _mix(s[best] * _M[3] + t[best].astype(np.int64).astype(np.uint64))
    return out if bounds is not None else out[:, 0]


def band_keys(texts: list[str], weights: Weights) -> list[list[int]]:
    """Band keys of each text; none for an empty one."""
    s, n, bounds = shingle_batch(texts)
    full = np.flatnonzero(np.diff(bounds))
    out: list[list[int]] = [[] for _ in texts]
    if len(full):
        edges = np.append(bounds[full], len(s))
        x = np.concatenate([samples(s, weights.estimated(s, n), bounds=edges), samples(s, n, COUNT_BANDS * ROWS, edges, BANDS * ROWS)])
        keys = np.empty((BANDS + COUNT_BANDS, len(full)), dtype=np.uint64)
        for b in range(BANDS + COUNT_BANDS):
            key = np.full(len(full), b, dtype=np.uint64)
            for r in range(ROWS):
                key = _mix((key ^ x[b * ROWS + r]) * _M[4])
            keys[b] = key
        for i, row in zip(full.tolist(), keys.T.view(np.int64).tolist(), strict=True):
            out[i] = row
    return out


def _nodes(docs: DataFrame) -> DataFrame:
    """(k, node, text): node is the hash of the whole text."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("k"), F.unhex(F.md5(t)).alias("node"), t.alias("text"))


def pack(s: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte place by byte place: the high places are mostly zero, which the shuffle's compression removes."""
    return np.diff(s, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _by_part(s: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of sorted hashes; part ``p`` of a power of two holds the p-th range of hashes."""
    tops = np.arange(1, parts, dtype=np.uint64) << np.uint64(65 - parts.bit_length()) if parts > 1 else np.zeros(0, np.uint64)
    cuts = [0, *np.searchsorted(s, tops).tolist(), len(s)]
    return [(p, a, z) for p, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < z]


def _tasks(parts: int) -> int:
    return max(1, min(parts // TASK_PARTS, MAX_TASKS))


def _summed(s: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of ``s``, sorted, and the sums of ``c``."""
    order = np.argsort(s, kind="stable")
    s, c = s[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[at], np.add.reduceat(c, at) if len(at) else c


def shingle_counts(docs: DataFrame, chunk_chars: int = CHUNK_CHARS) -> tuple[DataFrame, Weights, int]:
    """Saved (p, s, c): per range of hashes the shingles of two or more documents and their counts; the weights for candidates; the number of ranges."""
    t = frugal(docs).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total, chars = t.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    parts = min(SLOTS, 1 << max(0, (chars or 0) // PART_CHARS).bit_length())
    width, least = SLOTS // parts, HEAVY * total

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter = Counter()
        size = 0

        def dealt() -> pa.RecordBatch:
            once, more = [x for x, n in own.items() if n == 1], [x for x, n in own.items() if n > 1]
            s = np.concatenate([np.zeros(0, np.uint64), *(shingle_batch(x)[0] for _, x in in_batches(once))])
            s.sort()
            at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
            s, c = s[at], np.diff(at, append=len(s))
            for _, x in in_batches(more):  # an equal text is cut into shingles once
                u, _, bounds = shingle_batch(x)
                s, c = _summed(np.concatenate([s, u]), np.concatenate([c, np.repeat([own[y] for y in x], np.diff(bounds))]))
            rows = [(p, pack(s[a:z]), c[a:z].astype("<u4").tobytes()) for p, a, z in _by_part(s, parts)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], names=["p", "s", "c"])

        for b in batches:
            for x in b.column(0).to_pylist():
                if x not in own:
                    size += len(x)
                own[x] += 1
                if size >= chunk_chars or len(own) >= CHUNK_DOCS:
                    yield dealt()
                    own.clear()
                    size = 0
        if own:
            yield dealt()

    def count(key: tuple, t: pa.Table) -> pa.Table:
        p = key[0].as_py()
        s, c = _summed(np.concatenate([unpack(x) for x in t.column("s").to_pylist()]), np.concatenate([np.frombuffer(x, "<u4") for x in t.column("c").to_pylist()]).astype(np.int64))
        many = c >= max(2, least)
        slot = (_slot(s) - p * width)[~many]
        light = c[~many].astype(np.float64)
        n = np.bincount(slot, light, width)
        mean = np.where(n > 0, np.bincount(slot, light * light, width) / np.maximum(n, 1), 1).astype("<f4")
        on = (c > 1) & ~many
        cols = [s[on].tobytes(), c[on].astype("<u8").tobytes(), s[many].tobytes(), c[many].astype("<u8").tobytes(), mean.tobytes()]
        return pa.table({"p": pa.array([p], pa.int64()), **{k: pa.array([v], pa.binary()) for k, v in zip(("s", "c", "hs", "hc", "mean"), cols, strict=True)}})

    dealt = t.mapInArrow(arrow_task(deal), "p long, s binary, c binary").repartition(_tasks(parts), "p")
    counts = save(dealt.groupBy("p").applyInArrow(count, "p long, s binary, c binary, hs binary, hc binary, mean binary"), "shingle-counts")
    slots, keys, found = np.ones(SLOTS, np.float32), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for r in counts.select("p", "hs", "hc", "mean").toLocalIterator():  # SLOTS means, and at most average length / HEAVY frequent shingles
        slots[r["p"] * width : (r["p"] + 1) * width] = np.frombuffer(r["mean"], "<f4")
        keys.append(np.frombuffer(r["hs"], np.uint64))
        found.append(np.frombuffer(r["hc"], "<u8").astype(np.int64))
    return counts.select("p", "s", "c"), Weights(total, np.concatenate(keys), np.concatenate(found), slots), parts


def signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """(k, node, keys array<long>) of every document, saved; a task signs equal texts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}
        for b in batches:
            nodes, texts = b.column("node").to_pylist(), b.column("text").to_pylist()
            if len(known) > SIGNED:
                known.clear()
            new = {n: x for n, x in zip(nodes, texts, strict=True) if n not in known}
            names = list(new)
            for at, group in in_batches(list(new.values())):
                known.update(zip(names[at : at + len(group)], band_keys(group, weights), strict=True))
            keys = pa.array([known[n] for n in nodes], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("node"), keys], names=["k", "node", "keys"])

    return save(_nodes(docs).mapInArrow(arrow_task(run), "k long, node binary, keys array<long>"), "signatures")


def buckets(sigs: DataFrame) -> DataFrame:
    """(bucket, node, salt) of all different texts, saved."""
    one = sigs.groupBy("node").agg(F.first("keys").alias("keys"))
    rows = one.select("node", F.explode("keys").alias("bucket"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt"))
    return save(rows, "buckets")


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def candidate_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): distinct pairs of a bucket member and one of its bucket's leaders."""
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64("node"), "node"))
    lead = rows.select("bucket", F.col("node").alias("b"), rank.alias("r")).where(F.col("r") <= LEADERS)
    lead = save(lead.join(_sizes(rows).where("n > 1").select("bucket"), "bucket", "left_semi").select("bucket", "b"), "leaders")
    met = rows.join(_salted(lead), ["bucket", "salt"]).where("node <> b")
    return met.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()


def profiles(docs: DataFrame, sigs: DataFrame, pairs: DataFrame, counts: DataFrame, parts: int, weights: Weights) -> DataFrame:
    """(node, s, w, n): shingles, exact weights and counts of every text that is in some pair, saved.

    One row of each text is taken. Groups of texts ask each range of hashes once and get the counts of two and more back by group.
    """
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    first = sigs.groupBy("node").agg(F.min("k").alias("k"))
    wanted = save(first.join(wanted, "node", "left_semi").select("k", "node"), "pair-nodes")
    held = _nodes(docs).join(broadcast_if_small(wanted), ["k", "node"], "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    held = save(held, "pair-texts")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column("node").to_pylist()
            for at, group in in_batches(b.column("text").to_pylist()):
                s, _, bounds = shingle_batch(group)
                owner = np.repeat(np.arange(len(group)), np.diff(bounds))
                order = np.argsort(s, kind="stable")
                s, owner = s[order], owner[order].astype("<u4")
                rows = [(p, names[at], s[a:z].tobytes(), owner[a:z].tobytes()) for p, a, z in _by_part(s, parts)]
                rows.append((-1, names[at], b"".join(names[at : at + len(group)]), b""))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))], names=["p", "chunk", "s", "own"])

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in known.column("s").to_pylist())])
        c = np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(x, "<u8") for x in known.column("c").to_pylist())])
        out: list[list] = [[], [], []]
        for chunk, s, own in zip(*(asked.column(x).to_pylist() for x in ("chunk", "s", "own")), strict=True):
            s, own = np.frombuffer(s, np.uint64), np.frombuffer(own, "<u4")
            at = np.minimum(np.searchsorted(keys, s), max(0, len(keys) - 1))
            hit = keys[at] == s if len(keys) else np.zeros(len(s), bool)
            if hit.any():
                r = np.empty(int(hit.sum()), FREQ)
                r["s"], r["c"] = s[hit], c[at[hit]]
                for x, v in zip(out, (chunk, r.tobytes(), own[hit].tobytes()), strict=True):
                    x.append(v)
        return pa.table({k: pa.array(v, pa.binary()) for k, v in zip(("chunk", "s", "own"), out, strict=True)})

    def gather(t: pa.Table) -> pa.Table:
        names, recs, own = b"", [np.zeros(0, FREQ)], [np.zeros(0, "<u4")]
        for p, s, o in zip(*(t.column(x).to_pylist() for x in ("p", "s", "own")), strict=True):
            if p == -1:
                names = s
            else:
                recs.append(np.frombuffer(s, FREQ))
                own.append(np.frombuffer(o, "<u4"))
        r, o = np.concatenate(recs), np.concatenate(own)
        order = np.lexsort((r["s"], o))
        r, cuts = r[order], np.searchsorted(o[order], np.arange(len(names) // 16 + 1))
        return pa.table({"node": pa.array([names[i : i + 16] for i in range(0, len(names), 16)], pa.binary()), "freq": pa.array([r[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, freq = b.column("text").to_pylist(), b.column("freq").to_pylist()
            keys, sums, counted = [], [], []
            for at, group in in_batches(texts):
                s, n, bounds = shingle_batch(group)
                for i, (a, z) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    keys.append(s[a:z].tobytes())
                    sums.append(weights.of(s[a:z], n[a:z], freq[at + i]).tobytes())
                    counted.append(_stored(n[a:z]))
            yield pa.RecordBatch.from_arrays([b.column("node"), *(pa.array(x, pa.binary()) for x in (keys, sums, counted))], names=["node", "s", "w", "n"])

    asked = save(held.mapInArrow(arrow_task(ask), "p long, chunk binary, s binary, own binary"), "shingles-asked")
    tasks = _tasks(parts)
    got = asked.where("p >= 0").repartition(tasks, "p").groupBy("p").cogroup(counts.repartition(tasks, "p").groupBy("p")).applyInArrow(answer, "chunk binary, s binary, own binary")
    back = got.select(F.lit(0).cast("long").alias("p"), "chunk", "s", "own").unionByName(asked.where("p = -1"))
    freq = back.groupBy("chunk").applyInArrow(gather, "node binary, freq binary")
    return save(held.join(freq, "node").mapInArrow(arrow_task(weigh), "node binary, s binary, w binary, n binary"), "profiles")


def prefix(s: np.ndarray, w: np.ndarray, rank: np.ndarray, similar: float = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """The leading shingles, by ``rank`` and hash, without which less than ``similar`` of the weight is left, and the weight from each on.

    Two texts of at least that similarity share one: their common weight is at
    least ``similar`` of either, so it does not fit into what either leaves out.
    From the first they share on, both have at least that common weight.
    """
    if not len(s):
        return s, w
    order = np.lexsort((s, rank))
    left = np.cumsum(w[order][::-1])[::-1]
    on = left >= similar * left[0] * (1 - 1e-9)
    return s[order[on]], left[on]


def rest_prefixes(texts: DataFrame, rows: DataFrame, labels: DataFrame, weights: Weights) -> DataFrame | None:
    """(s, rest, w, more, n, node): prefixes of the texts in buckets too large for their leaders that hold several groups, saved; None if there are none.

    The texts of such buckets share a prefix shingle if they are similar, by
    weights (``rest`` of ``w``) or by counts (``more`` of ``n``); of a text's two
    prefixes one begins with the other, and beyond the shorter its measure is 0.
    Shingles are ranked by the weights' table, so a prefix holds a text's rarest
    shingles; the ranking affects cost only.
    """
    large = _salted(_sizes(rows).where(F.col("n") > LEADERS + 1).select("bucket"))
    own = rows.join(large, ["bucket", "salt"]).join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    own = save(own, "large-buckets")
    several = own.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    several = _salted(several.select("bucket"))
    own = own.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    nodes = save(own.join(several, ["bucket", "salt"], "left_semi").select("node").distinct(), "rest-nodes")
    if nodes.limit(1).count() == 0:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, at, numbers = [], [], []
            for i, (x, y, z) in enumerate(zip(*(b.column(c).to_pylist() for c in ("s", "w", "n")), strict=True)):
                s, w = np.frombuffer(x, np.uint64), np.frombuffer(y)
                n, rank = _counts(z, len(s)), -weights.estimated(s, 1)
                (p, rest), (q, more) = prefix(s, w, rank), prefix(s, n, rank, COPIES)
                size = max(len(p), len(q))
                keys.append(p if len(p) == size else q)
                at.append(np.full(size, i))
                numbers.append(np.stack([np.pad(rest, (0, size - len(p))), np.full(size, w.sum()), np.pad(more, (0, size - len(q))), np.full(size, n.sum())]).astype(float))
            named = b.column("node").take(pa.array(np.concatenate(at), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *map(pa.array, np.concatenate(numbers, axis=1)), named], names=["s", "rest", "w", "more", "n", "node"])

    held = texts.join(broadcast_if_small(nodes), "node", "left_semi").select("node", "s", "w", "n")
    return save(held.mapInArrow(arrow_task(run), "s long, rest double, w double, more double, n double, node binary"), "prefixes")


def prefix_pairs(found: DataFrame, labels: DataFrame, few: bool) -> DataFrame:
    """(a, b): pairs of different groups that share a prefix shingle and can be similar; with ``few`` only those with the shingle's ``LEADERS`` texts."""
    own = found.join(labels, "node", "left").select("s", "rest", "w", "more", "n", "node", F.coalesce("label", "node").alias("label"))
    own = own.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    mixed = own.groupBy("s").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("s")
    own = save(own.join(_salted(mixed), ["s", "salt"], "left_semi"), "mixed-prefixes")
    low = own.select("s", F.col("node").alias("b"), F.col("label").alias("other"), F.col("w").alias("v"), F.col("rest").alias("left"), F.col("n").alias("m"), F.col("more").alias("over"))
    if few:
        rank = F.row_number().over(Window.partitionBy("s").orderBy(F.desc(F.greatest(F.col("left") / F.col("v"), F.col("over") / F.col("m"))), "b"))
        low = low.withColumn("r", rank).where(F.col("r") <= LEADERS).drop("r")
    reach = lambda t: t / (1 + t) * (1 - 1e-9)
    able = f"label <> other and (least(rest, left) >= {reach(SIMILAR)!r}D * (w + v) or least(more, over) >= {reach(COPIES)!r}D * (n + m))"
    met = own.join(_salted(low), ["s", "salt"]).where(able if few else f"node > b and {able}")
    return met.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()


def verified_links(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, sim) of the pairs whose whole texts are similar enough, saved; only profiles in some pair are shuffled."""
    j = pairs.join(texts.withColumnsRenamed({"node": "b", "s": "sb", "w": "wb", "n": "nb"}), "b").join(texts.withColumnsRenamed({"node": "a", "s": "sa", "w": "wa", "n": "na"}), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sims = [], [], []
            for i, (x, y) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                sa, wa, sb, wb = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("sa", np.uint64), ("wa", float), ("sb", np.uint64), ("wb", float)))
                na, nb = (_counts(batch.column(c)[i].as_buffer(), len(x)) for c, x in (("na", sa), ("nb", sb)))
                s = likeness(sa, wa, na, sb, wb, nb)
                if s >= SIMILAR:
                    a.append(x)
                    b.append(y)
                    sims.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(sims, pa.float64())], names=["a", "b", "sim"])

    return save(j.select("a", "b", "sa", "wa", "na", "sb", "wb", "nb").mapInArrow(arrow_task(run), "a binary, b binary, sim double"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, label): least node reachable, by min-label propagation with pointer jumping; every round is a saved table."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = save(both, "edges")
    labels = save(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("new"))
        # jump: take the label of the label
        jump = step.join(labels.select(F.col("node").alias("new"), F.col("label").alias("far")), "new", "left").select("node", "old", F.least("new", F.coalesce("far", "new")).alias("label"))
        jump = save(jump, "labels")
        labels = jump.select("node", "label")
        if jump.where("old <> label").limit(1).count() == 0:
            return labels
    raise RuntimeError("groups did not settle")


def _classes(docs: DataFrame) -> DataFrame:
    """(k, node, class, n_texts, n_links, least_sim, keep) of every row; of a group's texts under its smallest id, the one of least hash stays."""
    counts, w, parts = shingle_counts(docs)
    sigs = signatures(docs, w)
    rows = buckets(sigs)
    pairs = save(candidate_pairs(rows), "pairs")
    texts = profiles(docs, sigs, pairs, counts, parts, w)
    links = verified_links(texts, pairs)
    labels = components(links)
    rest = rest_prefixes(texts, rows, labels, w)
    if rest is not None:
        for few in (True, False):  # what leaders join need not meet again
            more = save(prefix_pairs(rest, labels, few), "pairs")
            if more.limit(1).count():
                links = links.union(verified_links(texts, more))
                labels = components(links)
    linked = links.select("a", "b", "sim").distinct()
    ends = linked.select(F.explode(F.array("a", "b")).alias("node"), "sim").groupBy("node").agg(F.count(F.lit(1)).alias("n_links"), F.min("sim").alias("least_sim"))
    ids = sigs.select("k", "node")
    own = ids.groupBy("node").agg(F.min("k").alias("first"))
    named = own.join(labels, "node", "left").join(ends, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "first", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "least_sim")
    group = named.groupBy("label").agg(F.min(F.struct("first", "node")).alias("head"), F.count(F.lit(1)).alias("n_texts"))
    by_node = save(named.join(group, "label").select("node", F.col("head.first").alias("class"), (F.col("node") == F.col("head.node")).alias("head"), "n_texts", "n_links", "least_sim"), "classes")
    j = ids.join(by_node, "node")
    return j.select("k", "node", "class", "n_texts", "n_links", "least_sim", ((F.col("k") == F.col("class")) & F.col("head")).alias("keep"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_texts, n_links, least_sim, keep).

    ``class_id`` is the smallest id of the group, whose document stays; ``n_texts`` counts the group's different texts;
    ``n_links`` counts the verified links of the document's text to other texts, and ``least_sim`` is the weakest of them
    (by weights, or by counts where only these make the link).
    """
    back = lambda c: F.when(F.col(c) != _NULL, F.col(c))
    return _classes(docs).select(back("k").alias("doc_id"), back("class").alias("class_id"), "n_texts", "n_links", "least_sim", "keep")


def dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group, with all their columns; a document is an id and its text."""
    keep = save(_classes(docs).where("keep").groupBy(F.col("k").alias("_x_k"), F.col("node").alias("_x_node")).agg(F.count(F.lit(1)).alias("_x_n")), "kept-documents")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.withColumns({"_x_k": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)), "_x_node": F.unhex(F.md5(text))})
    kept = d.join(keep, ["_x_k", "_x_node"], "left_semi")
    if keep.where("_x_n > 1").limit(1).count():
        kept = kept.dropDuplicates(["_x_k", "_x_node"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
