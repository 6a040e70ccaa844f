"""Operator 8: language identification by averaged hashed subword embeddings.

Character n-grams of each marked word are hashed to embedding rows; a document
is their mean, classified by a linear softmax. Both are trained by stochastic
gradient descent in numpy on a bounded labelled sample (``PER_LANG`` documents of
each of the ``MAX_LANGS`` most frequent languages, the smallest hashes of
``doc_id`` and text, picked per salt first, so that a hot language is no single
task's). Executors reduce the sample's whole texts to counts of their
``SAMPLE_GRAMS`` most frequent embedding rows; only those reach the driver, at most
``MAX_LANGS`` x ``PER_LANG`` x ``SAMPLE_GRAMS`` numbers. A part of the sample held
back from training fits a temperature and the score below which a prediction is
``rejected``, so that ``REJECT_RATE`` of right predictions fall below it.

For prediction the embeddings are multiplied into the output layer once, so a
word is one row of class scores; each distinct word is scored once per worker.

Edge cases: ``und`` with score 0 and rejected for a null text or one without a
letter (Unicode category L); a null ``doc_id`` stays null (and is not held out); rows of
one id and several texts or languages are rows of their own; an untrainable
sample (no labelled text) predicts ``und`` for all; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_task, frugal, per_batch, save

BUCKETS, DIM, ORDERS = 1 << 16, 16, (1, 2, 3, 4)
PER_LANG, EPOCHS, RATE, SEED = 600, 6, 20.0, 11
REJECT_RATE = 0.01
MAX_LANGS, SAMPLE_GRAMS, SALTS = 400, 4096, 16
#: Characters of all words that a worker remembers.
TABLE_CHARS = 1 << 23
TABLE_LIMIT = 400_000
SLICE = 256
_LETTER = regex.compile(r"\p{L}")


def words_of(text: str) -> list[str]:
    return text.lower().split()


def ngram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(embedding row, word number) of every n-gram of the marked words."""
    cp = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    rows, own = [], []
    for n in ORDERS:
        if len(cp) < n:
            break
        h = np.full(len(cp) - n + 1, 0x9E3779B9 + n, dtype=np.uint64)
        for j in range(n):
            h = (h ^ cp[j : len(cp) - n + 1 + j]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        inside = owner[: len(h)] == owner[n - 1 :]
        rows.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
        own.append(owner[: len(h)][inside])
    return np.concatenate(rows), np.concatenate(own)


class LanguageModel:
    """``scores`` are class scores per embedding row; ``temperature`` and ``least`` are calibrated."""

    def __init__(self, langs: list[str], scores: np.ndarray, temperature: float, least: float):
        self.langs, self.scores, self.temperature, self.least = langs, scores.astype(np.float32), temperature, least
        self._reset()

    def _reset(self) -> None:
        self._at: dict[str, int] = {}
        self._chars = 0
        self._rows = np.zeros((0, len(self.langs) + 1), dtype=np.float32)

    def __getstate__(self):
        return (self.langs, self.scores, self.temperature, self.least)

    def __setstate__(self, s):
        self.__init__(*s)

    def _learn(self, new: list[str]) -> None:
        rows, own = ngram_rows(new)
        add = np.zeros((len(new), len(self.langs) + 1), dtype=np.float32)
        for c in range(len(self.langs)):
            add[:, c] = np.bincount(own, weights=self.scores[rows, c], minlength=len(new))
        add[:, -1] = np.bincount(own, minlength=len(new))
        self._at.update({w: len(self._rows) + i for i, w in enumerate(new)})
        self._rows = np.concatenate([self._rows, add])
        self._chars += sum(map(len, new))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        if len(texts) > SLICE:  # words of few texts are held at once
            parts = [self.predict(texts[i : i + SLICE]) for i in range(0, len(texts), SLICE)]
            return tuple([x for p in parts for x in p[j]] for j in range(3))
        split = [words_of(t) if self.langs and t and _LETTER.search(t) else [] for t in texts]
        if len(self._at) > TABLE_LIMIT or self._chars > TABLE_CHARS:
            self._reset()
        new = list({w for ws in split for w in ws} - self._at.keys())
        if new:
            self._learn(new)
        lang, score, rejected = [], [], []
        for ws in split:
            if not ws:
                lang.append("und")
                score.append(0.0)
                rejected.append(True)
                continue
            s = self._rows[np.fromiter(map(self._at.__getitem__, ws), dtype=np.int64, count=len(ws))].sum(axis=0, dtype=np.float64)
            z = s[:-1] / s[-1] / self.temperature
            p = np.exp(z - z.max())
            p /= p.sum()
            i = int(p.argmax())
            lang.append(self.langs[i])
            score.append(float(p[i]))
            rejected.append(bool(p[i] < self.least))
        return lang, score, rejected


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of a whole text and their counts, the ``SAMPLE_GRAMS`` most frequent ones; slices of words bound the memory."""
    ws, total = words_of(text), np.zeros(BUCKETS, np.int64)
    for i in range(0, len(ws), 1 << 16):
        total += np.bincount(ngram_rows(ws[i : i + (1 << 16)])[0], minlength=BUCKETS)
    rows = np.flatnonzero(total)
    if len(rows) > SAMPLE_GRAMS:
        rows = np.sort(rows[np.argsort(-total[rows], kind="stable")[:SAMPLE_GRAMS]])
    return rows, total[rows]


def fit(samples: list[tuple[str, np.ndarray, np.ndarray]]) -> LanguageModel:
    """Train on (lang, embedding rows, counts)."""
    langs = sorted({lang for lang, _, _ in samples})
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0)), 1.0, 0.0)
    rng = np.random.default_rng(SEED)
    data = [(rows, n / n.sum(), langs.index(lang)) for lang, rows, n in samples if len(rows)]
    order = rng.permutation(len(data))
    held, used = order[: len(data) // 5], order[len(data) // 5 :]
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    out = np.zeros((DIM, len(langs)))
    steps, done = max(1, EPOCHS * len(used)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            rows, w, y = data[i]
            v = w @ emb[rows]
            z = v @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            rate = RATE * (1 - done / steps) / DIM
            back = out @ p
            out -= rate * np.outer(v, p)
            emb[rows] -= rate * np.outer(w, back)
            done += 1
    scores = emb @ out
    z = np.array([w @ scores[rows] for rows, w, _ in (data[i] for i in held)]).reshape(-1, len(langs))
    y = np.array([data[i][2] for i in held], dtype=np.int64)
    best, least = 1.0, 0.0
    if len(y):
        def soft(t: float) -> np.ndarray:
            e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
            return e / e.sum(axis=1, keepdims=True)

        best = min((2.0**k for k in np.arange(-4, 4.01, 0.25)), key=lambda t: -np.log(soft(t)[np.arange(len(y)), y] + 1e-12).mean())
        p = soft(best)
        right = p.argmax(axis=1) == y
        least = float(np.quantile(p.max(axis=1)[right], REJECT_RATE)) if right.any() else 0.0
    return LanguageModel(langs, scores, float(best), least)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_lang: int = PER_LANG) -> LanguageModel:
    """Model from at most ``per_lang`` documents of each language that are not held out."""
    fit_rows = frugal(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    keys = fit_rows.select("lang", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"))
    keys = keys.withColumn("salt", F.pmod(F.col("t"), F.lit(SALTS)))

    def least(df: DataFrame, *by: str) -> DataFrame:
        return df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h", "t"))).where(F.col("r") <= per_lang).drop("r")

    frequent = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).select("lang")
    pick = save(least(least(keys, "lang", "salt"), "lang").join(F.broadcast(frequent), "lang", "left_semi").select("lang", "h", "t").distinct(), "language-sample")
    named = fit_rows.select("text", "lang", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"))
    rows = named.join(F.broadcast(pick), ["lang", "h", "t"], "left_semi").select("lang", "h", "t", "text")  # MAX_LANGS x per_lang rows at most

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [gram_counts(x) for x in b.column("text").to_pylist()]
            cols = [pa.array([g[i].astype("<i4").tobytes() for g in got], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("lang", "h", "t")), *cols], names=["lang", "h", "t", "rows", "n"])

    found = rows.mapInArrow(arrow_task(counts), "lang string, h long, t long, rows binary, n binary").dropDuplicates(["lang", "h", "t"])
    got = sorted(found.collect(), key=lambda r: (r["h"], r["t"], r["lang"]))
    return fit([(r["lang"], np.frombuffer(r["rows"], "<i4").astype(np.int64), np.frombuffer(r["n"], "<i4").astype(np.float64)) for r in got])


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every whole text."""
    m = model or train(docs)

    def run(b: dict) -> dict:
        lang, score, rejected = m.predict(b["text"])
        return {"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": lang, "score": score, "rejected": rejected}

    t = frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return per_batch(t, run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
