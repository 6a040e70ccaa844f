"""Operators 1, 3, 5, 8, 9 and 10 against brute force, with every awkward case."""

import hashlib
import os
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from fixtures import AWKWARD, docs  # noqa: E402

from tidemark.llm import fingerprint, langid, packing, piece_codec, secrets, token_files  # noqa: E402
from tidemark.llm.queries import LLM_QUERIES, tokenizer  # noqa: E402

WORD, PIECE = tokenizer("word_bpe_49k.json"), tokenizer("piece_bpe_32k.model")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def plain(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


def ids_of(tok, text):
    return [*tok.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# 9


def check_pieces(rows, got):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = Counter()
    for i, t in rows:
        ids = sp.encode(t or "")
        want[(i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids) if ids else ""))] += 1
    assert Counter(tuple(r) for r in got) == want


def test_pieces(spark, sf, plain):
    check_pieces(plain, LLM_QUERIES["op9_piece_codec"](spark, sf).collect())


def test_pieces_awkward(spark):
    d = docs(spark, AWKWARD)
    check_pieces(AWKWARD, piece_codec.digests(d, PIECE).collect())
    assert piece_codec.digests(d.limit(0), PIECE).count() == 0
    both = {r["doc_id"]: r for r in piece_codec.encode_decode(d, PIECE).collect()}
    assert both[6]["decoded"] == "same" and both[2]["ids"] == []


# 10


def check_files(rows, got, tok):
    at, want = 0, Counter()
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = ids_of(tok, t)
        want[(i, at, len(ids), crc(ids))] += 1
        at += len(ids)
    assert Counter(tuple(r) for r in got) == want


def test_files(spark, sf, plain, tok):
    check_files(plain, LLM_QUERIES["op10_token_files"](spark, sf).collect(), tok)


def test_files_awkward(spark, tok, tmp_path):
    d = docs(spark, AWKWARD).repartition(3)
    check_files(AWKWARD, token_files.token_files(d, WORD, f"file://{tmp_path}/a").collect(), tok)
    assert token_files.token_files(d.limit(0), WORD, f"file://{tmp_path}/b").count() == 0
    flat = np.concatenate([np.fromfile(p, "<u2") for p in sorted((tmp_path / "a").glob("*.ids"))])
    assert len(flat) == sum(len(ids_of(tok, t)) for _, t in AWKWARD)
    assert not list((tmp_path / "a").glob(".*ids"))


def test_files_by_ranges(spark, tok, tmp_path, monkeypatch):
    """Stores that cannot be mapped are read by ranges, with the same result; rows without an id are spread."""
    import pyarrow.fs as pafs

    rows = [*AWKWARD, *[(None, f"text {i} of no id") for i in range(300)]]
    d = docs(spark, rows).repartition(3)
    folder = f"file://{tmp_path}/c"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        m = token_files.write_files(d, folder, WORD)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    check_files(rows, token_files.read_digests(spark, folder, m, 7).collect(), tok)
    assert m.count() > 2 and max(r["n_docs"] for r in m.collect()) < 200
    local = token_files._Flat(folder, f"{m.first()['stem']}.ids", "<u2")
    monkeypatch.setattr(pafs, "LocalFileSystem", type("Other", (), {}))
    remote = token_files._Flat(folder, f"{m.first()['stem']}.ids", "<u2")
    assert remote.map is None and remote.size == local.size and (remote.range(3, local.size) == local.range(3, local.size)).all()


# 5


def check_packing(rows, got, tok):
    want, places = Counter(), defaultdict(list)
    for i, t in rows:
        ids = ids_of(tok, t)
        for k in range(0, len(ids), 4096):
            p = ids[k : k + 4096]
            want[(i, k // 4096, k, len(p), crc(p))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in places.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096
    return len(places), -(-sum(r["length"] for r in got) // 4096)


def test_packing(spark, sf, plain, tok):
    used, least = check_packing(plain, LLM_QUERIES["op5_packing"](spark, sf).collect(), tok)
    assert used <= least + 2


def test_packing_awkward(spark, tok):
    d = docs(spark, AWKWARD).repartition(3)
    check_packing(AWKWARD, packing.pack(d, WORD).collect(), tok)
    assert packing.pack(d.limit(0), WORD).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    n = Counter(rng.integers(1, 65 if seed % 2 else 40, 3000).tolist())
    if seed == 3:
        n = Counter({33: 100, 31: 50, 1: 3})
    p = packing.plan(dict(n), 64)
    used = Counter()
    for m, pattern in p:
        assert sum(k * q for k, q in pattern.items()) <= 64 and m > 0
        for k, q in pattern.items():
            used[k] += m * q
    assert used == n
    if seed != 3:
        assert sum(m for m, _ in p) <= -(-sum(k * v for k, v in n.items()) // 64) * 1.02 + 40 * (seed % 2)
    assert packing.plan({}, 64) == []


def test_triple_is_found():
    assert packing.plan({50: 2, 4: 2, 5: 4}, 64) == [(2, {50: 1, 5: 2, 4: 1})]


def test_held_pieces_block_no_pair_for_good():
    """A pair that only a set-aside piece blocks is found again once that piece is free."""
    c = np.zeros(65, np.int64)
    c[[10, 20]] = 1
    sums = packing._Sums(c)
    assert sums.pair(30, {10: 1}) is None and sums.pair(30, {}) == (20, 10)
    c[10] = 0
    assert sums.pair(30, {}) is None
    rng = np.random.default_rng(9)
    for _ in range(200):  # every pair that the counts allow is found, whatever was asked before
        c = rng.integers(0, 3, 40)
        sums = packing._Sums(c)
        for _ in range(30):
            gap, held = int(rng.integers(2, 40)), {int(rng.integers(1, 39)): 1}
            free = c.copy()
            for n in held:
                free[n] -= 1
            want = any((free[a] >= 2) if 2 * a == gap else (free[a] > 0 and free[gap - a] > 0) for a in range(1, gap))
            assert (sums.pair(gap, held) is not None) == want
            c[rng.integers(0, 40)] *= 0


# 1


def brute_base(t):
    t = t or ""
    out = [(m.start(), m.end(), "assign") for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return out


def check_secrets(rows, got):
    want = Counter()
    for i, t in rows:
        b = brute_base(t)
        c = Counter(k for _, _, k in b)
        want[(i, c["assign"], c["access"], c["hex"], sha(secrets.listed(b)))] += 1
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want


def test_secrets(spark, sf, plain):
    got = LLM_QUERIES["op1_secret_scan"](spark, sf).collect()
    check_secrets(plain, got)
    assert sum(r["n_random"] > 0 for r in got) <= 10  # prose is left alone


def test_secrets_awkward(spark):
    d = docs(spark, [*AWKWARD, (11, "token: token=secret:abcdefgh api-key passwd='x' ſecret=abcdefg Api_Key==zzzzzz")])
    m = secrets.train(d)
    got = secrets.scan(d, m).collect()
    check_secrets([*AWKWARD, (11, "token: token=secret:abcdefgh api-key passwd='x' ſecret=abcdefg Api_Key==zzzzzz")], got)
    eight = next(r for r in got if r["doc_id"] == 8)
    assert eight["n_random"] == 1 and "random:" in eight["spans"]
    red = {r["doc_id"]: r for r in secrets.redact(d, m).collect()}
    assert red[8]["text"] == "<SECRET>\" <SECRET> <SECRET> key <SECRET>" and red[2]["text"] is None and red[8]["bucket"] == "x"
    assert secrets.scan(d.limit(0)).count() == 0
    ordinary = "getUserNameFromList2 src/main/java/com/example/service/UserServiceImpl 4532015112830366 2023-10-11T12-30-59 internationalization HTTP_REQUEST_TIMEOUT_SECONDS"
    assert not any(m.stretches(ordinary.split()))


def test_secrets_recall(spark, sf, plain):
    """Random strings of other seeds than the training's, alone, in paths and beside pattern spans; prose of the whole table stays alone."""
    import random
    import uuid

    m = secrets.train(spark.read.parquet(f"{sf}/documents.parquet"))
    a, rng = secrets._ALPHABET, random.Random(1234)
    for name, letters in {"hex": a[52:62] + "abcdef", "HEX": a[52:62] + "ABCDEF", "alnum": a[:62], "base64": a[:64], "upper": a[26:62], "lower": a[:26] + a[52:62], "letters": a[:52]}.items():
        for n, least in ((12, 0.8), (16, 0.9), (20, 0.9), (40, 0.9)):
            keys = ["".join(rng.choices(letters, k=n)) for _ in range(400)]
            keys = [k for k in keys if secrets._LETTER.search(k)]
            found = sum(any(x <= 2 and y >= n - 2 for x, y in f) for f in m.stretches(keys))
            assert found >= least * len(keys), (name, n, found / len(keys))
    keys = ["".join(rng.choices(a[:62], k=24)) for _ in range(200)]
    paths = [f"usr/local/share/{k}/config_file" for k in keys]
    assert sum(any(x <= 16 + 2 and y >= 40 - 2 for x, y in f) for f in m.stretches(paths)) >= 0.95 * len(keys)
    ids = [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(200)]
    assert sum(bool(f) for f in m.stretches(ids)) >= 0.9 * len(ids)
    beside = f"{'0123456789abcdef' * 2}/{keys[0]}"
    (base, more), = secrets.all_spans([beside], m)
    assert [k for *_, k in base] == ["hex"] and [beside[x:y] for x, y, _ in more] == [f"/{keys[0]}"] or [beside[x:y] for x, y, _ in more] == [keys[0]]
    assert sum(len(more) for _, more in secrets.all_spans([t or "" for _, t in plain], m)) <= 2


# 3


def check_prints(rows, got):
    import xxhash

    signed = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) ^ 1 << 63) - (1 << 63)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0], signed(r[1])), reverse=True)
    want = Counter()
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        want[(i, len(t), sha(t[: len(t) - h] + nxt[:h]))] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want


def test_prints(spark, sf, plain):
    got = LLM_QUERIES["op3_fingerprints"](spark, sf).collect()
    check_prints(plain, got)
    by = defaultdict(set)
    text = dict(plain)
    for r in got:
        by[text[r["doc_id"]]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)
    long = [r for r in got if r["n_chars"] > 1000]
    assert np.mean([abs(r["near_edited"] - 0.5) < 0.25 for r in long]) > 0.88  # a text whose first half repeats itself is farther


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_prints_awkward(spark, n):
    d = docs(spark, AWKWARD)
    from tidemark.session import table  # noqa: F401

    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        check_prints(AWKWARD, fingerprint.edited_fingerprints(d).collect())
        check_prints([(5, "alone text")], fingerprint.edited_fingerprints(docs(spark, [(5, "alone text")])).collect())
        assert fingerprint.edited_fingerprints(d.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def brute_likeness(x, y):
    """2 x shared clauses weight over both: the likeness that the sketch estimates, from exact multisets."""
    a, b = (Counter(c for c in fingerprint._clauses(t) if c) for t in (x, y))
    top, low = 2 * sum(n * b[c] for c, n in a.items()), sum(n * n for n in a.values()) + sum(n * n for n in b.values())
    return top / low if low else float(x == y)


def test_likeness_estimates_shared_clauses(spark, sf, plain):
    """The sketch's likeness of edited texts and of neighbours against exact clause multisets."""
    got = LLM_QUERIES["op3_fingerprints"](spark, sf).collect()
    order = sorted(plain, key=lambda r: r[0], reverse=True)
    near = {r["doc_id"]: (r["near_edited"], r["near_next"]) for r in got}
    off = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        off += [abs(near[i][0] - brute_likeness(t, t[: len(t) - h] + nxt[:h])), abs(near[i][1] - brute_likeness(t, nxt))]
    assert np.mean(off) < 0.04 and np.quantile(off, 0.99) < 0.2


def test_likeness_of_many_repeats():
    """Sums beyond 16 bits do not wrap."""
    a, b = fingerprint.vectors(["one clause\n" * 40_000, "one clause\n" * 25_536])
    got = fingerprint.likeness(a[None], b[None])[0]
    assert abs(got - 2 * 40_000 * 25_536 / (40_000**2 + 25_536**2)) < 0.01
    assert (fingerprint.remove(a, fingerprint.vectors(["one clause\n" * 14_463 + "one clause"])[0])[-1]) == 25_536


def test_prints_of_one_id(spark):
    """A third of the rows without an id is dealt over many tasks, each text still meeting its next one."""
    rows = [(None, f"text {i} of nobody") for i in range(200)] + [(7, f"text {i} of seven") for i in range(100)] + [(i, f"text {i}") for i in range(10, 310)] + [(None, "equal")] * 30
    d = docs(spark, rows).repartition(5)
    laid = fingerprint.with_next(d, 24)
    per = Counter(r["bucket"] for r in laid.select("bucket").collect())
    assert max(per.values()) < 120
    check_prints(rows, fingerprint.edited_fingerprints(d).collect())


def test_homomorphism():
    a, b, ab = fingerprint.vectors(["one\ntwo", "three", "three\none\ntwo"])
    assert (fingerprint.add(a, b) == ab).all() and (fingerprint.remove(ab, b) == a).all()
    assert (fingerprint.decode(fingerprint.encode(ab[None])[0]) == ab).all()


# 8


def test_language(spark, sf):
    got = LLM_QUERIES["op8_language_id"](spark, sf)
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = got.collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97


def test_language_of_odd_letters(spark):
    """Digits, marks and number signs are no letters; one combining or modifier letter is."""
    m = langid.fit([("en", *langid.gram_counts("the cat")), ("de", *langid.gram_counts("die katze"))])
    assert m.predict(["² ½ 10 _ …", "", None, "٣ Ⅳ", "ʰ", "x²"])[0][:4] == ["und"] * 4
    assert "und" not in m.predict(["ʰ", "x²", "日"])[0]


def test_language_by_brute_force(spark, sf, plain):
    """Predictions equal a plain mean of each n-gram's class scores over the whole text."""
    m = langid.train(spark.read.parquet(f"{sf}/documents.parquet"))
    texts = [t for _, t in plain[:60]]
    lang, score, _ = m.predict(texts)
    for t, a, p in zip(texts, lang, score, strict=True):
        ws = langid.words_of(t or "")
        if not ws:
            assert a == "und"
            continue
        z = m.scores[langid.ngram_rows(ws)[0]].astype(np.float64).mean(axis=0) / m.temperature
        e = np.exp(z - z.max())
        assert a == m.langs[int(z.argmax())] and abs(p - (e / e.sum()).max()) < 1e-4


def test_language_repeated_ids(spark):
    """One id with several texts and languages trains with each of them once."""
    rows = [(1, "the cat and the dog went home " * 3, "en"), (1, "der hund und die katze gehen heim " * 3, "de"), (1, "der hund und die katze gehen heim " * 3, "de")] * 20
    rows += [(i, "the dog saw the cat", "en") for i in range(50, 90)] + [(i, "der hund sah die katze", "de") for i in range(90, 130)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(d).collect()
    assert len(got) == len(rows) and all(r["lang_pred"] in ("en", "de") for r in got)
    one = langid.identify(d.select("doc_id", "text").withColumn("lang", __import__("pyspark.sql.functions", fromlist=["x"]).lit("en"))).collect()
    assert {r["lang_pred"] for r in one} == {"en"}


def test_language_awkward(spark):
    rows = [(100 + i, "the cat and the dog went home" if i % 2 else "der hund und die katze gehen heim") for i in range(40)]
    d = docs(spark, [*rows, *AWKWARD]).withColumn("lang", __import__("pyspark.sql.functions", fromlist=["x"]).expr("case when text like '%der %' then 'de' when text like '%the %' then 'en' end"))
    out = langid.identify(d).collect()
    assert len(out) == len(rows) + len(AWKWARD)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in out if r["doc_id"] == 10)
    assert all(0 <= r["score"] <= 1 for r in out)
    none = langid.identify(d.withColumn("lang", __import__("pyspark.sql.functions", fromlist=["x"]).lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert langid.identify(d.limit(0)).count() == 0


# what workers keep


def test_workers_keep_one_table(spark):
    import pyarrow as pa

    from tidemark.llm import common

    class Table:
        def trim(self):
            pass

    common._TABLES.clear()
    a = common.worker_table("a", Table)
    assert common.worker_table("a", Table) is a
    common.worker_table("b", Table)
    assert list(common._TABLES) == ["b"]
    common._TABLES.clear()

    def load(batches):
        from tidemark.llm.word_table import WordTable

        for b in batches:
            WordTable.load(WORD).packed("some words")
            yield pa.RecordBatch.from_arrays([pa.array([len(common._held())] * b.num_rows, pa.int64())], names=["n"])

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common._held())] * b.num_rows, pa.int64())], names=["n"])

    d = spark.range(8).repartition(4)
    assert {r["n"] for r in d.mapInArrow(common.arrow_task(load, tables=True), "n long").collect()} == {1}
    assert {r["n"] for r in d.mapInArrow(common.arrow_task(count), "n long").collect()} == {0}


def test_tables_are_given_back_before_other_work(monkeypatch):
    from tidemark.llm import common

    class Table:
        def trim(self):
            pass

    seen = []

    def work(batches):
        seen.append("work")
        yield from batches

    monkeypatch.setattr(common, "release", lambda: seen.append(len(common._TABLES)))
    common._TABLES.clear()
    common.worker_table("a", Table)
    assert list(common.arrow_task(work)(iter([1, 2]))) == [1, 2]
    assert seen == [0, "work", 0]  # the memory of the dropped table goes before the work begins, not only when it ends
    seen.clear()
    list(common.arrow_task(work)(iter([1])))
    assert seen == ["work", 0]


def test_whole_texts_are_read_in_small_batches(spark):
    from tidemark.llm import common, lines, quality

    for stage in (quality.filter_documents, lines.dedup):
        s = spark.newSession()
        s.conf.set("spark.sql.parquet.columnarReaderBatchSize", "4096")
        docs = s.createDataFrame([(1, "a few words\nand more", "en", "web")], "doc_id long, text string, lang string, source string")
        stage(docs)
        assert {int(s.conf.get(k)) for k in common.BATCHES} == {common.ARROW_ROWS}
