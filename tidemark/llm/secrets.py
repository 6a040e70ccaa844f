"""Operator 1: secret scans by character Markov models.

Two first-order Markov models over characters, one trained on random strings and
one on ordinary identifiers, words and numbers, are compared by log-likelihood
ratio. Fixed patterns (assignments, access keys, long hex) are always reported;
the models add spans that no pattern names.

Candidates are all runs of ``[A-Za-z0-9+/_=-]`` of ``MIN_LENGTH`` characters or
more, without what pattern spans cover. In a run the stretch with the greatest
sum of (log ratio - ``TOLL``) is found, so that words beside a key, as in a path,
neither dilute nor hide it; then those left and right of it. A stretch is
reported if it leads by ``LEAD`` nats in all, has ``MIN_LENGTH`` characters and a
letter (numbers alone are no keys): a short one must be the more random. Ends move
outwards to a separator at most ``SNAP`` characters away.

Edge cases: a null text is empty and has no spans; a null ``doc_id`` stays
null; repeated rows repeat; other columns are ignored. Positions count code
points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_task, frugal, per_batch, texts

#: Kinds in their order at equal starts.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_LENGTH = 10
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
CUES = ("passw", "secret", "token", "api")
#: Nats by which the random model must lead in a stretch, what each character pays, and how far an end moves to a separator.
LEAD, TOLL, SNAP = 9.0, 0.25, 8
#: Characters of runs that are scored at once.
BATCH = 1 << 18
#: Labelled rows for training: words of this many documents, and this many generated strings.
SAMPLE_DOCS, SAMPLE_STRINGS = 400, 4000
#: Labelled ordinary words for identifiers, beside those of the corpus.
COMMON = """get set list name value index count user file path from into item items data time date size type node key
map load save read write open close start stop begin end first last next prev left right parent child table column row
field record query result error message buffer stream string number integer float double boolean object class method
function module package import export config option setting default request response client server session handler
event listener manager service factory builder parser reader writer update delete insert create remove append total
current previous average maximum minimum length width height color image button window screen page view model control
test example sample document license version release build number public private internal external local remote global
""".split()
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_AT = {c: i for i, c in enumerate(_ALPHABET)}


class Markov:
    """First-order character model with add-one smoothing; a start state opens each string."""

    def __init__(self, samples: list[str]):
        n = len(_ALPHABET)
        counts = np.ones((n + 1, n))
        for s in samples:
            was = n
            for c in s:
                i = _AT.get(c)
                if i is not None:
                    counts[was, i] += 1
                    was = i
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True))


_LETTER = re.compile("[A-Za-z]")
_CODE = np.full(256, 0, np.int64)
_CODE[list(_ALPHABET.encode())] = np.arange(len(_ALPHABET))
_SEPARATOR = frozenset("+/_=-")


class SecretModel:
    """The two models; ``ratio`` is the mean log-likelihood ratio per character."""

    def __init__(self, random_strings: list[str], identifiers: list[str]):
        self.table = Markov(random_strings).log - Markov(identifiers).log

    def ratio(self, s: str) -> float:
        return float(self.ratios([s])[0].mean())

    def ratios(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood ratios of all characters of all runs, and where each run begins."""
        i = _CODE[np.frombuffer("".join(runs).encode(), np.uint8)]
        first = np.cumsum([0, *map(len, runs)])[:-1]
        was = np.concatenate([[0], i[:-1]])
        was[first] = len(_ALPHABET)
        return self.table[was, i], first

    def stretches(self, runs: list[str]) -> list[list[tuple[int, int]]]:
        """(start, end) of the random stretches of each run."""
        out: list[list[tuple[int, int]]] = [[] for _ in runs]
        if not runs:
            return out
        r, first = self.ratios(runs)
        r = r - TOLL
        most = np.add.reduceat(np.maximum(r, 0), first)  # no stretch sums to more
        for i in np.flatnonzero(most >= LEAD).tolist():
            todo = [(0, len(runs[i]))]
            while todo:
                a, z = todo.pop()
                if z - a < MIN_LENGTH:
                    continue
                s = np.concatenate([[0.0], np.cumsum(r[first[i] + a : first[i] + z])])
                low = np.minimum.accumulate(s)
                end = int((s - low).argmax())
                if s[end] - low[end] < LEAD:
                    continue
                begin = int(np.flatnonzero(s[: end + 1] == low[end])[-1])
                x, y = _snapped(runs[i], a + begin, a + end, a, z)
                if y - x >= MIN_LENGTH and _LETTER.search(runs[i], x, y):
                    out[i].append((x, y))
                todo += [(a, x), (y, z)]
        return out


def _snapped(run: str, x: int, y: int, a: int, z: int) -> tuple[int, int]:
    """The stretch with its ends moved out to a separator or the run's end, where one is near."""
    for step in range(SNAP + 1):
        if x - step <= a or run[x - step - 1] in _SEPARATOR:
            x = max(a, x - step)
            break
    for step in range(SNAP + 1):
        if y + step >= z or run[y + step] in _SEPARATOR:
            y = min(z, y + step)
            break
    return x, y


def generated(n: int = SAMPLE_STRINGS, seed: int = 7) -> list[str]:
    """Labelled random strings: hex of both cases, alphanumeric and base64-like, 12 to 48 characters."""
    rng = random.Random(seed)
    sets = ("0123456789abcdef", "0123456789ABCDEF", _ALPHABET[:62], _ALPHABET[:64], _ALPHABET[26:62], _ALPHABET[:26] + _ALPHABET[52:62])
    return ["".join(rng.choices(sets[i % len(sets)], k=rng.randint(12, 48))) for i in range(n)]


def identifiers(words: list[str], n: int = SAMPLE_STRINGS, seed: int = 8) -> list[str]:
    """Labelled ordinary identifiers: words alone and joined as snake, kebab, camel and path names, some numbered, and plain numbers and dates."""
    rng = random.Random(seed)
    own = [w for w in words if w.isascii() and w.isalpha()]
    pool = sorted({*COMMON, *own})
    out = [*COMMON, *own[: 4 * n]]
    for i in range(n):
        w = rng.choices(COMMON if i % 2 else pool, k=rng.randint(2, 4))
        joined = (  # by number, so that each form is as frequent
            "_".join(w), "-".join(w), "".join(x.capitalize() for x in w), "/".join(w), "_".join(w).upper(),
        )[i // 2 % 5]
        out.append(joined + ("", "", str(rng.randint(0, 99)), f"-{rng.randint(1990, 2030)}")[i // 3 % 4])
        if i % 4 == 0:
            out.append((str(rng.randint(0, 10 ** rng.randint(1, 18))), f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}")[i // 4 % 2])
    return out


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> SecretModel:
    """Models from generated random strings and the words of a bounded sample (the ``sample_docs`` smallest hashes of ``doc_id``)."""
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    picked = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    letters = F.array_distinct(F.split(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+"))  # pieces of keys with digits are no words
    words = picked.select(F.explode(letters).alias("w")).where("w rlike '^[A-Za-z]{2,40}$'").groupBy("w").count()
    top = words.orderBy(F.desc("count"), "w").limit(4 * SAMPLE_STRINGS)
    return SecretModel(generated(), identifiers([r["w"] for r in top.collect()]))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    lower = text.lower()
    if any(c in lower for c in CUES):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def candidate_runs(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, str]]:
    """(start, run) of the runs outside every pattern span."""
    if not base:
        return [(m.start(), m.group()) for m in RUN.finditer(text)]
    out = []
    covered = sorted((a, z) for a, z, _ in base)
    for m in RUN.finditer(text):
        at = m.start()
        for a, z in covered:
            if z <= at or a >= m.end():
                continue
            if a - at >= MIN_LENGTH:
                out.append((at, text[at:a]))
            at = max(at, z)
        if m.end() - at >= MIN_LENGTH:
            out.append((at, text[at : m.end()]))
    return out


def all_spans(texts: list[str], model: SecretModel) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """(pattern spans, model spans) of each text."""
    base = [base_spans(x) for x in texts]
    more: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    owner: list[int] = []
    at: list[int] = []
    runs: list[str] = []
    size = 0

    def scored() -> None:
        for i, a, found in zip(owner, at, model.stretches(runs), strict=True):
            more[i] += [(a + x, a + y, "random") for x, y in found]
        owner.clear(), at.clear(), runs.clear()

    for i, x in enumerate(texts):
        for a, run in candidate_runs(x, base[i]):
            owner.append(i)
            at.append(a)
            runs.append(run)
            size += len(run)
        if size >= BATCH:
            scored()
            size = 0
    scored()
    return list(zip(base, more, strict=True))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for a, z, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def scan(docs: DataFrame, model: SecretModel | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans)."""
    m = model or train(docs)

    def run(b: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans")}
        for d, (base, more) in zip(b["doc_id"], all_spans(b["text"], m), strict=True):
            kinds = [k for _, _, k in base + more]
            row = (d, *(kinds.count(k) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more))
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return out

    return per_batch(texts(docs), run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redact(docs: DataFrame, model: SecretModel | None = None, mark: str = "<SECRET>") -> DataFrame:
    """The documents with every span (overlapping ones joined) replaced by ``mark``; all other columns pass, a null text stays null."""
    m = model or train(docs)
    text = docs.columns.index("text")

    def clean(x: str, spans: list[tuple[int, int, str]]) -> str:
        if not spans:
            return x
        out, at = [], 0
        for a, z, _ in sorted(spans):
            if a >= at:
                out += [x[at:a], mark]
            at = max(at, z)
        return "".join([*out, x[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(text).to_pylist()
            found = all_spans([x or "" for x in own], m)
            new = pa.array([None if x is None else clean(x, base + more) for x, (base, more) in zip(own, found, strict=True)], b.schema.field(text).type)
            yield b.set_column(text, b.schema.field(text), new)

    return frugal(docs).mapInArrow(arrow_task(run), docs.schema)
