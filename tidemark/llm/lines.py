"""Operator 6: line dedup by a log-template tree of fixed depth.

A line's leaf is its token count and its leading tokens: the first third of them
and at least ``DEPTH``. Two more trees take the middle and the last tokens
instead, and serve lines whose field is among the first. Tokens with a digit or
``@`` are variable: in the trees they stand for each other. Fields are learned in
every leaf that holds different lines: the distinct lines' tokens are counted by
position (aggregated map-side, so a hot leaf is never gathered), and the most
frequent one of each position makes the leaf's pattern. A line belongs to the
template if it equals the pattern in ``LEAST_CONSTANT`` positions and in
``SIMILAR`` of those that are not variable in both; where it differs is a field.
All other lines, such as rows of numbers or prose that only begins alike, are
templates of their own, equal to lines of the same tokens only.

A template with lines in two or more documents recurs: its lines stay in the
first document (smallest ``doc_id``) and are dropped from all others. Blank
lines have no template. One rule holds for lines of every length and script.

Tokens are compared by 8 bits of their hash within a leaf, so two different
tokens pass as equal once in 255. Only first and last documents are aggregated
per line and per template, so a line in a third of all documents costs one row
per task; the recurring ones are joined back as a broadcast when their bytes are
counted as few, else by a join that AQE splits where it is skewed. Texts are
shuffled once at most.

Edge cases: a null text stays null, an empty one empty; a null ``doc_id`` is a
document before all others; rows of one ``doc_id`` are one document; a text that
loses all lines is empty; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import arrow_task, frugal, save
from tidemark.llm.word_hash import byte_table, word_hashes
from tidemark.session import broadcast_if_small

DEPTH, SIMILAR, LEAST_CONSTANT = 3, 0.75, 3
TREES = 3  # by leading, middle and last tokens
SALTS = 8
#: Lines tokenised at once are of texts of about this many characters.
BATCH_CHARS = 1 << 18
_VARIABLE = byte_table("0123456789@")
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)


def hashed_lines(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the non-blank ones among the \\n-split lines: their numbers, hashes, leaves (a column per tree), 8-bit tokens (0 for variable ones), and where each line's tokens begin.

    A line with too few constant tokens for a template has its own hash for a leaf.
    """
    h, at, variable = word_hashes(data, mark=_VARIABLE)
    feeds = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    n = np.diff(np.concatenate([[0], np.searchsorted(at, feeds), [len(h)]]))
    on = np.flatnonzero(n)
    n = n[on]
    end = np.cumsum(n)
    first = end - n
    h = _mix(h)
    place = (np.arange(len(h)) - np.repeat(first, n)).astype(np.uint64) * _M
    total = np.concatenate([[np.uint64(0)], np.cumsum(_mix(h + place), dtype=np.uint64)])
    line = _mix((total[end] - total[first]) ^ _mix(n.astype(np.uint64)))
    total = np.concatenate([[np.uint64(0)], np.cumsum(_mix(np.where(variable, np.uint64(1), h) + place), dtype=np.uint64)])
    width = np.minimum(n, np.maximum(DEPTH, -(-n // 3)))
    solid = n - np.diff(np.concatenate([[0], np.cumsum(variable)[end - 1]])) if len(on) else n
    leaves = np.empty((len(on), TREES), np.uint64)
    for tree in range(TREES):
        a = first + tree * (n - width) // (TREES - 1)
        leaf = _mix((total[a + width] - total[a]) ^ _mix(n.astype(np.uint64) * np.uint64(TREES) + np.uint64(tree)))
        leaves[:, tree] = np.where(solid >= LEAST_CONSTANT, leaf, line)
    tokens = np.where(variable, 0, 1 + (h >> np.uint64(56)) % np.uint64(255)).astype(np.uint8)
    return on, line, leaves, tokens, np.append(first, len(h))


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))


def keyed_lines(docs: DataFrame) -> DataFrame:
    """(d, t, pos, line, leaves, tokens) of every non-blank line, saved; t is the hash of the whole text."""
    own = frugal(docs).where("text is not null").select(_doc().alias("d"), F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, at = b.column("text").to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH_CHARS):
                    size += len(texts[end])
                    end += 1
                data = [x.encode() for x in texts[at:end]]
                n = np.array([x.count(b"\n") + 1 for x in data], np.int64)
                on, line, leaves, tokens, cuts = hashed_lines(b"\n".join(data))
                owner = pa.array(np.repeat(np.arange(at, end), n)[on])
                pos = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))[on]
                held = pa.Array.from_buffers(pa.binary(), len(on), [None, pa.py_buffer(cuts.astype("<i4")), pa.py_buffer(tokens)])
                trees = pa.ListArray.from_arrays(pa.array(np.arange(len(on) + 1, dtype=np.int32) * TREES), pa.array(leaves.ravel().view(np.int64)))
                cols = [b.column("d").take(owner), b.column("t").take(owner), pa.array(pos.astype(np.int32)), pa.array(line.view(np.int64)), trees, held]
                yield pa.RecordBatch.from_arrays(cols, names=["d", "t", "pos", "line", "leaves", "tokens"])
                at = end

    return save(own.mapInArrow(arrow_task(run), "d long, t long, pos int, line long, leaves array<long>, tokens binary"), "line-keys")


def templates(keyed: DataFrame, lines: DataFrame) -> DataFrame:
    """(line, key): the lines that belong to learned templates, saved; ``key`` is a template's leaf."""
    pairs = lines.select("line", F.explode("leaves").alias("leaf"))
    several = pairs.groupBy("leaf").agg(F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo <> hi").select("leaf")
    own = save(pairs.join(broadcast_if_small(save(several, "line-leaves")), "leaf", "left_semi"), "leaf-lines")
    wanted = broadcast_if_small(save(own.select("line").distinct(), "template-lines"))
    held = save(keyed.select("line", "tokens").join(wanted, "line", "left_semi").groupBy("line").agg(F.first("tokens").alias("tokens")), "line-tokens")
    own = own.join(held, "line").select("leaf", "line", "tokens")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = [np.frombuffer(x, np.uint8) for x in b.column("tokens")[i : i + 1000].to_pylist()]
                n = np.array([len(x) for x in part], np.int64)
                place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                leaf = b.column("leaf").take(pa.array(i + np.repeat(np.arange(len(part)), n)))
                # place and token in one number, so that counting compares two longs
                yield pa.RecordBatch.from_arrays([leaf, pa.array(place * 256 + np.concatenate(part))], names=["leaf", "at"])

    counted = own.select("leaf", "tokens").mapInArrow(arrow_task(tokens), "leaf long, at long").groupBy("leaf", "at").agg(F.count(F.lit(1)).alias("n"))
    top = counted.groupBy("leaf", F.expr("at div 256").alias("place")).agg(F.max(F.expr("n * 256 + at % 256")).alias("most"))
    pattern = top.groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "most"))), lambda x: x["most"] % 256).alias("pattern"))  # as long as a line
    dealt = own.withColumn("salt", F.pmod("line", F.lit(SALTS)).cast("int"))
    j = dealt.join(pattern.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["leaf", "salt"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            on = []
            for i in range(b.num_rows):
                x, y = np.frombuffer(b.column("tokens")[i].as_buffer(), np.uint8), b.column("pattern")[i].values.to_numpy()
                same, wild = int(((x == y) & (x != 0)).sum()), int(((x == 0) & (y == 0)).sum())
                on.append(same >= LEAST_CONSTANT and same >= SIMILAR * (len(x) - wild))
            yield b.select(["line", "leaf"]).rename_columns(["line", "key"]).filter(pa.array(on, pa.bool_()))

    return save(j.select("line", "leaf", "tokens", "pattern").mapInArrow(arrow_task(match), "line long, key long"), "line-templates")


def recurring(docs: DataFrame) -> DataFrame:
    """(_x_d, _x_t, _x_pos): places of lines to drop, by document and text hash."""
    keyed = keyed_lines(docs)
    lines = save(keyed.groupBy("line").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.first("leaves").alias("leaves")), "lines")
    named = save(templates(keyed, lines).join(lines.drop("leaves"), "line"), "named-lines")
    by_key = named.groupBy("key").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first < last")
    salted = by_key.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    shared = named.select("line", "key", F.pmod("line", F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["key", "salt"]).select("line", "first")
    again = shared.union(lines.where("first < last").select("line", "first")).groupBy("line").agg(F.min("first").alias("first"))
    again = save(again, "lines-again")
    return keyed.select("d", "t", "pos", "line").join(broadcast_if_small(again), "line").where("d > first").select(F.col("d").alias("_x_d"), F.col("t").alias("_x_t"), F.col("pos").alias("_x_pos"))


def dedup(docs: DataFrame, counts: bool = False) -> DataFrame:
    """The documents without recurring lines, same columns (``n_chars`` follows the text); with ``counts`` also ``n_lines`` and ``n_dropped``."""
    drops = save(recurring(docs).groupBy("_x_d", "_x_t").agg(F.collect_set("_x_pos").alias("_x_drop")), "line-drops")  # one document's own lines
    d = docs.withColumn("_x_d", _doc()).withColumn("_x_t", F.xxhash64("text"))
    j = d.join(broadcast_if_small(drops), ["_x_d", "_x_t"], "left").select(*[F.col(f"`{c}`") for c in docs.columns], "_x_drop")
    fields = [*docs.schema.fields, *([StructField("n_lines", LongType()), StructField("n_dropped", LongType())] if counts else [])]
    text, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, n, gone = [], [], []
            for x, drop in zip(b.column(text).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                lines = x.split("\n") if x is not None else []
                if drop:
                    s = set(drop)
                    x = "\n".join([line for i, line in enumerate(lines) if i not in s])
                out.append(x)
                n.append(len(lines))
                gone.append(len(drop or ()))
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            cols[text] = pa.array(out, b.schema.field(text).type)
            if chars is not None:
                cols[chars] = pa.array([None if x is None else len(x) for x in out], b.schema.field(chars).type)
            more = [pa.array(n, pa.int64()), pa.array(gone, pa.int64())] if counts else []
            yield pa.RecordBatch.from_arrays(cols + more, names=[f.name for f in fields])

    return j.mapInArrow(arrow_task(run), StructType(fields))
