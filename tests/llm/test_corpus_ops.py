"""Operators 6 and 7 and the pipeline against brute force, with every awkward case."""

import os
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from fixtures import AWKWARD, docs  # noqa: E402

from tidemark.llm import lines, neardup, packing, quality, secrets  # noqa: E402
from tidemark.llm.queries import LLM_QUERIES  # noqa: E402
from tidemark.llm.word_hash import word_hashes  # noqa: E402

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def plain(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def say(x, n):
    return " ".join(f"{x}{j}" for j in range(n))


# 6


def tokens_of(line):
    return tuple(x for x in re.split(r"[\x20\x09-\x0D]+", line) if x)


def learned(rows):
    """{line tokens: keys} by both trees, with plain loops over whole tokens."""
    all_lines = {tokens_of(x) for _, t in rows for x in (t or "").split("\n")} - {()}
    mask = lambda x: "<*>" if re.search("[0-9@]", x) else x
    out = {t: {("own", t)} for t in all_lines}
    for tree in range(3):
        leaves = defaultdict(list)
        for t in all_lines:
            m = tuple(map(mask, t))
            n = len(t)
            w = min(n, max(lines.DEPTH, -(-n // 3)))
            a = (0, (n - w) // 2, n - w)[tree]
            if sum(x != "<*>" for x in m) >= lines.LEAST_CONSTANT:
                leaves[tree, n, m[a : a + w]].append((t, m))
        for leaf, own in leaves.items():
            if len(own) < 2:
                continue
            counts = [Counter(c) for c in zip(*(m for _, m in own), strict=True)]
            top = [c.most_common() for c in counts]
            tied = any(len(c) > 1 and c[0][1] == c[1][1] for c in top)
            pattern = [c[0][0] for c in top]
            for t, m in own:
                if tied:  # ties are broken by hash: take the pattern from the operator's own tokens
                    pattern = tied_pattern([x for x, _ in own])
                    same = sum(x == y != 0 for x, y in zip(codes(t), pattern, strict=True))
                    wild = sum(x == y == 0 for x, y in zip(codes(t), pattern, strict=True))
                else:
                    same = sum(x == y != "<*>" for x, y in zip(m, pattern, strict=True))
                    wild = sum(x == y == "<*>" for x, y in zip(m, pattern, strict=True))
                if same >= lines.LEAST_CONSTANT and same >= lines.SIMILAR * (len(t) - wild):
                    out[t].add(leaf)
    return out


def codes(t):
    return tuple(lines.hashed_lines(" ".join(t).encode())[3].tolist())


def tied_pattern(own):
    return [max(Counter(c).items(), key=lambda x: (x[1], x[0]))[0] for c in zip(*map(codes, own), strict=True)]


def brute_lines(rows):
    where, keys = defaultdict(set), learned(rows)
    key = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        for x in (t or "").split("\n"):
            for k in keys.get(tokens_of(x), ()):
                where[k].add(key(i))
    out = Counter()
    for i, t in rows:
        if t is None:
            out[(i, None, 0, 0)] += 1
            continue
        own = t.split("\n")
        left = [x for x in own if all(min(where[k]) == key(i) for k in keys.get(tokens_of(x), ()))]
        out[(i, "\n".join(left), len(own), len(own) - len(left))] += 1
    return out


def test_lines(spark, sf, plain):
    got = LLM_QUERIES["op6_line_dedup"](spark, sf)
    assert Counter(tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()) == brute_lines(plain)


def test_lines_awkward(spark):
    say = "This report was written by {} on day {} for the good of all people here"
    rows = [*AWKWARD, (20, say.format("Ann", 4) + "\nown line of twenty\n\n"), (21, "short one\n" + say.format("Bob", 17)), (22, "own line of twenty"), (23, "a b\n\n"), (None, "own line of twenty")]
    d = docs(spark, rows)
    got = lines.dedup(d, counts=True)
    assert Counter(tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()) == brute_lines(rows)
    assert {r["doc_id"]: r["text"] for r in got.collect()}[21] == "short one"
    assert lines.dedup(d).columns == d.columns and lines.dedup(d.limit(0)).count() == 0
    assert all(r["n_chars"] == len(r["text"]) for r in lines.dedup(d).collect() if r["text"] is not None)


def test_lines_short_and_unspaced(spark):
    """Lines of few tokens and of scripts without spaces recur too, but only where they are equal."""
    wide = "本网站的所有内容均受版权保护，未经书面许可不得转载、复制或以其他方式使用。" * 2
    same = f"All rights reserved.\n{wide}\nhttps://example.org/a/long/path?id=77"
    rows = [(1, f"{same}\nPage 1\n\n7"), (2, f"{same}\nPage 2\n\n8"), (3, f"All  rights\treserved.\nall rights reserved\n{wide}。")]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in lines.dedup(docs(spark, rows), counts=True).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("Page 2\n\n8", 3), 3: (f"all rights reserved\n{wide}。", 1)}


def test_lines_of_numbers(spark):
    """Rows of numbers are no template: they are dropped only where they are equal."""
    rows = [(1, "2019 45 12 33\nsum 7 of 9 rows"), (2, "17 18 19 20\nsum 8 of 3 rows"), (3, "2019  45 12 33")]
    assert {r["doc_id"]: r["text"] for r in lines.dedup(docs(spark, rows)).collect()} == {1: rows[0][1], 2: "17 18 19 20", 3: ""}


def test_lines_one_word_edits(spark):
    """A one-word edit at any place, first and last included, is a field; prose that only begins or ends alike is not."""
    name = lambda *n: "".join(chr(97 + x) for x in n)
    rows = [(1, " ".join(name(20, 20, j) for j in range(9)))]
    for p in range(9):
        w = [name(p, j) for j in range(9)]
        rows += [(10 + p, " ".join(w)), (30 + p, " ".join([*w[:p], "edit", *w[p + 1 :]]))]
    rows += [(60 + i, " ".join(["the", "cat", *(name(21, i, j) for j in range(7))])) for i in range(20)]
    rows += [(90 + i, " ".join([*(name(22, i, j) for j in range(7)), "of", "it"])) for i in range(20)]
    got = {r["doc_id"]: r["n_dropped"] for r in lines.dedup(docs(spark, rows), counts=True).collect()}
    assert all(got[30 + p] == 1 and got[10 + p] == 0 for p in range(9)) and got[1] == 0
    assert not any(got[i] for i in [*range(60, 80), *range(90, 110)])


def test_lines_recall(plain, sf, spark):
    """Lines of 4 to 80 tokens that differ from one of an earlier document in one word: nearly all go."""
    first = {}
    for i, t in sorted(plain):
        for x in (t or "").split("\n"):
            first.setdefault(tokens_of(x), i)
    by = defaultdict(set)
    for t in first:
        if 4 <= len(t) <= 80:
            for p in range(len(t)):
                by[t[:p], t[p + 1 :]].add(t)
    late = {t for ts in by.values() for t in ts if first[t] > min(first[x] for x in ts)}
    left = {tokens_of(x) for r in LLM_QUERIES["op6_line_dedup"](spark, sf).collect() for x in (r["text"] or "").split("\n")}
    assert late and len(late - left) >= 0.95 * len(late)


def test_lines_broadcast_or_not(spark, monkeypatch):
    rows = [(i, f"User {chr(97 + i % 26) * 3} logged in from host h{i} at noon\nshared line of five words\nown {say(f'o{i}x', 6)}") for i in range(50)]
    want = sorted(tuple(r) for r in lines.dedup(docs(spark, rows)).collect())
    monkeypatch.setattr(lines, "broadcast_if_small", lambda df: df)
    assert sorted(tuple(r) for r in lines.dedup(docs(spark, rows)).collect()) == want
    assert sum("shared" in r[1] for r in want) == 1 and sum("logged" in r[1] for r in want) == 1


# 7


def links_of(rows):
    distinct = sorted({t or "" for _, t in rows})
    total = len(rows)
    df = Counter()
    sh = {t: neardup.shingles(t) for t in distinct}
    for _, t in rows:
        df.update(sh[t or ""][0].tolist())
    w = neardup.Weights(total, np.array(list(df), dtype=np.uint64), np.array(list(df.values()), dtype=np.int64))
    inv = defaultdict(list)
    for t in distinct:
        for s in sh[t][0].tolist():
            inv[s].append(t)
    pairs = {(a, b) for ts in inv.values() for i, a in enumerate(ts) for b in ts[i + 1 :]}
    return {p for p in pairs if neardup.similarity(sh[p[0]], sh[p[1]], w) >= neardup.SIMILAR}, distinct


def groups(rows):
    links, distinct = links_of(rows)
    root = {t: t for t in distinct}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in links:
        root[top(a)] = top(b)
    key = lambda i: -(2**63) if i is None else i
    first = {}
    for i, t in rows:
        g = top(t or "")
        first[g] = min(first.get(g, key(i)), key(i))
    return Counter((i, None if first[top(t or "")] == -(2**63) else first[top(t or "")]) for i, t in rows)


def test_near(spark, sf, plain):
    """All copies and all similar pairs of different texts are grouped, and nothing else."""
    got = LLM_QUERIES["op7_near_dedup"](spark, sf).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == groups(plain)
    assert sum(r["keep"] for r in got) == len({r["class_id"] for r in got})


@pytest.mark.parametrize("parts", [1, 5, 60])
def test_document_frequencies(spark, monkeypatch, parts):
    """Every shingle's documents are counted exactly, however they are dealt over partitions and ranges of hash."""
    monkeypatch.setattr(neardup, "PART_CHARS", 9_000)
    rows = [(i, say(f"w{i}x", 6) + (" one two three four five" if i < 30 else "") + (" red green blue black white" if i % 60 == 0 else "")) for i in range(1500)] + [(5000 + i, say("equal", 9)) for i in range(40)] + [(6000, None)]
    counts, w, n = neardup.shingle_counts(docs(spark, rows).repartition(parts), chunk_chars=3000)
    assert n > 4
    df = Counter(x for _, t in rows for x in neardup.shingles(t)[0].tolist())
    heavy = {x: c for x, c in df.items() if c >= neardup.HEAVY * len(rows)}
    assert heavy and sorted(w.keys.tolist()) == sorted(heavy)
    assert np.allclose(w.idf, [np.log1p(len(rows) / heavy[x]) for x in w.keys.tolist()])
    got = {}
    for r in counts.collect():
        got.update(zip(np.frombuffer(r["s"], np.uint64).tolist(), np.frombuffer(r["c"], "<u8").tolist(), strict=True))
    assert got == {x: c for x, c in df.items() if c > 1 and x not in heavy}
    assert not len(neardup.shingle_counts(docs(spark, rows).limit(0))[1].keys)


def test_shingle_batch():
    """Texts cut into shingles together give what each gives alone, by a plain loop."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcd"), int(n))) for n in rng.integers(0, 12, 200)] + ["", "one", "a b c d", "a b c d e", " x\ty\n z "]

    def plain(t):
        outer = ".,;:!?\"'()[]{}#*$%&|<>-"
        h = [int(word_hashes((w.strip(outer) or w).encode())[0][0]) for w in t.lower().split()]
        out = Counter()
        for i in range(max(1, len(h) - 4) if h else 0):
            v = np.zeros(1, np.uint64)
            for j, x in enumerate(h[i : i + 5]):
                v += neardup._mix(np.array([x], np.uint64) * neardup._M[j])
            out[int(neardup._mix(v)[0])] += 1
        return sorted(out.items())

    s, n, bounds = neardup.shingle_batch(texts)
    for i, t in enumerate(texts):
        assert list(zip(s[bounds[i] : bounds[i + 1]].tolist(), n[bounds[i] : bounds[i + 1]].tolist(), strict=True)) == plain(t)
    assert (neardup.unpack(neardup.pack(np.sort(s))) == np.sort(s)).all() and not len(neardup.unpack(neardup.pack(s[:0])))


def test_near_large_group(spark):
    """A chain and a large family of near copies hold together; different documents stay apart."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    stem = [word() for _ in range(300)]
    rows = []
    for i in range(120):
        w = list(stem)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(300)] = word()
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(word() for _ in range(200))) for i in range(60)] + [(2000 + i, rows[3][1]) for i in range(40)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(spark, rows)).collect()}
    want = {i: c for (i, c), _ in groups(rows).items()}
    assert got == want
    assert all(got[1000 + i] == 1000 + i for i in range(60)) and all(got[2000 + i] == got[3] for i in range(40))


def test_near_crowded_buckets(spark):
    """Texts that share most of a passage crowd the buckets without being alike; the few that are alike are all found."""
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    stem = [word() for _ in range(150)]
    rows = [(i, " ".join(stem + [word() for _ in range(60)])) for i in range(150)]
    rows += [(1000 + i, rows[i][1].rsplit(" ", 3)[0] + " end of text") for i in range(0, 150, 5)]
    want = {i: c for (i, c), _ in groups(rows).items()}
    assert all(want[1000 + i] == i for i in range(0, 150, 5)) and len(set(want.values())) == 150
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(spark, rows)).collect()} == want


def test_prefixes_lose_no_similar_pair():
    """Texts that are similar enough share a prefix shingle under any ranking."""
    rng = np.random.default_rng(2)
    pool = np.unique(rng.integers(1, 2**63, 60).astype(np.uint64))
    rank = rng.integers(0, 5, len(pool))
    w = rng.uniform(0.1, 5, len(pool))
    close = 0
    for _ in range(3000):
        a = rng.random(len(pool)) < 0.8
        b = a ^ (rng.random(len(pool)) < 0.1)
        if w[a & b].sum() >= neardup.SIMILAR * w[a | b].sum():
            close += 1
            (p, x), (q, y) = neardup.prefix(pool[a], w[a], rank[a]), neardup.prefix(pool[b], w[b], rank[b])
            _, i, j = np.intersect1d(p, q, return_indices=True)
            need = neardup.SIMILAR / (1 + neardup.SIMILAR) * (w[a].sum() + w[b].sum()) * (1 - 1e-9)
            assert (np.minimum(x[i], y[j]) >= need).any()
    assert close > 100
    assert neardup.prefix(pool[:0], w[:0], rank[:0])[0].size == 0


def test_near_awkward(spark):
    rows = [*AWKWARD, (40, "One, two three FOUR five six"), (41, "one two three four five six."), (42, "a b"), (43, "b a")]
    d = docs(spark, rows)
    got = neardup.classes(d).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == groups(rows)
    kept = neardup.dedup(d)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.where("doc_id in (6, 40, 41)").collect()) == [6, 40]
    assert neardup.classes(d.limit(0)).count() == 0


def test_near_keeps_by_id_and_text(spark):
    """Different texts with no id or with one repeated id all stay; of similar ones under one id a single text stays."""
    say = lambda x: " ".join(f"{x}{j}" for j in range(40))
    rows = [(None, say("a")), (None, say("b")), (None, say("c")), (None, say("c") + " more"), (1, say("d")), (2, say("d")), (2, say("e")), (2, say("e")), (2, say("f"))]
    d = docs(spark, rows)
    got = Counter((r["doc_id"], r["text"].removesuffix(" more")) for r in neardup.dedup(d).collect())
    assert got == Counter([(None, say("a")), (None, say("b")), (None, say("c")), (1, say("d")), (2, say("e")), (2, say("f"))])


def test_near_counts_every_shingle(spark, monkeypatch):
    """Shingles that are not frequent have their own document frequency: a passage of 9 documents in 2011 weighs less than words of one."""
    monkeypatch.setattr(neardup, "PART_CHARS", 20_000)
    rows = [(i, f"{say('shared', 100)} {say(f'own{i}x', 10)}") for i in range(9)] + [(i, say("alone", 60)) for i in (9, 10)] + [(100 + i, say(f"w{i}x", 9)) for i in range(2000)]
    d = docs(spark, rows).repartition(7)
    counts, w, parts = neardup.shingle_counts(d)
    assert parts > 1 and not len(w.keys)
    df = Counter(x for _, t in rows for x in neardup.shingles(t)[0].tolist())
    sigs = neardup.signatures(d, w)
    nodes = [r["node"] for r in sigs.where("k < 12").orderBy("k").collect()]
    pairs = spark.createDataFrame([(nodes[0], n) for n in nodes[1:]], "a binary, b binary")
    exact = {bytes(r["node"]): r for r in neardup.profiles(d, sigs, pairs, counts, parts, w).collect()}
    assert set(exact) == {bytes(n) for n in nodes}
    for (_, t), node in zip(rows[:11], nodes, strict=True):
        s, n = neardup.shingles(t)
        r = exact[bytes(node)]
        assert (np.frombuffer(r["s"], np.uint64) == s).all()
        assert np.allclose(np.frombuffer(r["w"]), np.array([np.log1p(len(rows) / df[x]) for x in s.tolist()]) * n)
    got = {r["doc_id"]: r for r in neardup.classes(d).collect()}
    assert all(got[i]["class_id"] == i and got[i]["n_links"] == 0 for i in range(9)) and got[10]["class_id"] == 9


def test_near_links(spark):
    """Verified links are counted by text, equal texts sharing them."""
    t = say("w", 60)
    rows = [(1, t), (2, t + " end"), (3, t), (4, t + " stop"), (5, say("other", 50))]
    got = {r["doc_id"]: (r["n_texts"], r["n_links"], r["least_sim"] and 0.8 <= r["least_sim"] < 1) for r in neardup.classes(docs(spark, rows)).collect()}
    assert got == {1: (3, 2, True), 2: (3, 2, True), 3: (3, 2, True), 4: (3, 2, True), 5: (1, 0, None)}


def test_near_copies_of_large_groups(spark):
    """A large group's near copies hold together though their common shingles are frequent and so weigh little; each has three words in 200 replaced."""
    import random

    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    stem = [word() for _ in range(200)]
    rows = [(i, " ".join(stem)) for i in range(100)] + [(5000 + i, " ".join(word() for _ in range(30))) for i in range(600)]
    for i in range(100):
        w = list(stem)
        for j in rng.sample(range(200), 3):
            w[j] = word()
        rows.append((1000 + i, " ".join(w)))
    df = Counter(x for _, t in rows for x in neardup.shingles(t)[0].tolist())
    w = neardup.Weights(len(rows), np.array(list(df), dtype=np.uint64), np.array(list(df.values()), dtype=np.int64))
    s = [neardup.shingles(t) for i, t in rows if i == 0 or 1000 <= i < 1100]
    assert np.median([neardup.jaccard(s[0][0], w.of(*s[0]), x[0], w.of(*x)) for x in s[1:]]) < 0.8
    got = {r["doc_id"]: (r["class_id"], r["least_sim"]) for r in neardup.classes(docs(spark, rows)).collect()}
    assert all(got[1000 + i][0] == 0 and got[1000 + i][1] >= 0.8 for i in range(100)) and all(got[5000 + i][0] == 5000 + i for i in range(600))


def test_prefixes_by_counts_lose_no_copy():
    """Texts that are copies by counts share a shingle of the prefix by counts, at which both have enough left."""
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(1, 2**63, 60).astype(np.uint64))
    rank, close = rng.integers(0, 5, len(pool)), 0
    for _ in range(3000):
        n = rng.integers(1, 3, len(pool))
        a = rng.random(len(pool)) < 0.8
        b = a ^ (rng.random(len(pool)) < 0.08)
        if neardup.jaccard(pool[a], n[a], pool[b], n[b]) >= neardup.COPIES:
            close += 1
            (p, x), (q, y) = (neardup.prefix(pool[i], n[i], rank[i], neardup.COPIES) for i in (a, b))
            _, i, j = np.intersect1d(p, q, return_indices=True)
            assert (np.minimum(x[i], y[j]) >= neardup.COPIES / (1 + neardup.COPIES) * (n[a].sum() + n[b].sum()) * (1 - 1e-9)).any()
    assert close > 100


def test_samples_are_consistent():
    """Agreement of samples estimates weighted Jaccard similarity."""
    rng = np.random.default_rng(1)
    s = np.unique(rng.integers(1, 2**63, 400).astype(np.uint64))
    w = rng.uniform(0.5, 5, len(s))
    v = w * rng.uniform(0.6, 1.0, len(s))
    want = np.minimum(w, v).sum() / np.maximum(w, v).sum()
    agree = (neardup.samples(s, w, 3000) == neardup.samples(s, v, 3000)).mean()
    assert abs(agree - want) < 0.04


# pipeline


def test_pipeline(spark, sf, plain):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    kept = quality.filter_documents(rows)
    ids = {r["doc_id"] for r in quality.judge(rows).where("kept").collect()}
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == ids
    text = [(r["doc_id"], r["text"]) for r in kept.collect()]
    text = [(i, t) for (i, t, _, _), n in brute_lines(text).items() for _ in range(n)]
    one = {c for (_, c) in groups(text)}
    text = [(i, t) for i, t in text if i in one]
    d = docs(spark, text)
    m = secrets.train(d)
    red = [(r["doc_id"], r["text"]) for r in secrets.redact(d, m).collect()]
    assert not any(secrets.base_spans(t) for _, t in red)
    want = Counter(tuple(r) for r in packing.pieces(docs(spark, red), corpus_pipeline.tokenizer("word_bpe_49k.json")).collect())
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "secret_scan", "best_fit_packing"]


def test_pipeline_awkward(spark, tmp_path):
    """Nulls in any column, repeated ids and rows, copies, secrets, an empty table and extra columns with clashing names."""
    say = lambda i, n=60: " ".join(f"w{(i * 7919 + j * 104729) % 99991}" for j in range(n))
    key = "Zx81kQ0pLm47TyWq93VbNe5R"
    rows = [*AWKWARD, (50, say(1)), (51, say(1)), (None, say(2)), (None, say(3)), (7, say(4)), (7, say(5)), (7, say(5)), (52, say(6) + "\nAll rights of this page are reserved\n" + key), (53, say(8) + "\nAll rights of this page are reserved")]
    d = docs(spark, rows).withColumn("lang", __import__("pyspark.sql.functions", fromlist=["x"]).expr("if(doc_id = 50, null, lang)"))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    frame = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        assert frame.columns == d.columns, name
        seen.append(frame.count())
    left = Counter((r["doc_id"], r["text"]) for r in frame.collect())
    assert left[50, say(1)] == 1 and not any(i == 51 and t for i, t in left)  # all lines of the copy recur
    assert sum(n for (_, t), n in left.items() if not t) <= 1
    assert left[None, say(2)] == left[None, say(3)] == left[7, say(4)] == left[7, say(5)] == 1
    assert left[52, say(6) + "\nAll rights of this page are reserved\n<SECRET>"] == 1 and left[53, say(8)] == 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in left} and all(r["length"] <= 4096 for r in got)
    d.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_stages_keep_columns(spark):
    d = docs(spark, [(i, f"word{i} " * 3 + "the quick brown fox jumps over a lazy dog while ten wise owls look on from trees") for i in range(30)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, "")
        assert out.columns == d.columns, name
        assert stage(spark, d.limit(0), "").count() == 0, name
