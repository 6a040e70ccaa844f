"""Operators 2 and 4 against brute force, with every awkward case."""

import hashlib
import os
import re
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from fixtures import AWKWARD, docs  # noqa: E402

from tidemark.llm import pii, quality  # noqa: E402
from tidemark.llm.queries import LLM_QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def plain(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    c, hit = Counter(win), set()
    for i, x in enumerate(win):
        if c[x] > 1:
            hit.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def check_quality(rows, got):
    want = Counter()
    for i, t in rows:
        c = counts(t)
        want[(i, *c, c[0] < 20 or 100 * c[4] > 30 * c[0])] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r["base_failed"] and r["kept"] for r in got)


def test_quality(spark, sf, plain):
    got = LLM_QUERIES["op2_quality_rules"](spark, sf).collect()
    check_quality(plain, got)
    passed = [r for r in got if not r["base_failed"]]
    assert sum(r["kept"] for r in passed) > 0.85 * len(passed)


def test_quality_awkward(spark):
    rows = [*AWKWARD, (20, "a b c d e f g h i a b c d e f g h a b c d e f g h x y z w v"), (21, "x\n x\nx\n\r\n\r\n#*$"), (22, "1 2 3 4 5 6 7 8")]
    d = docs(spark, rows)
    check_quality(rows, quality.judge(d).collect())
    assert quality.judge(d.limit(0)).count() == 0
    kept = quality.filter_documents(d)
    assert kept.columns == d.columns and kept.count() == sum(r["kept"] for r in quality.judge(d).collect())


def test_quality_bounds_adapt(spark):
    """The same ratio is odd in a clean source and usual in a noisy one."""
    words = [f"w{i}" for i in range(30)]
    noisy = " ".join(f"{w} #" for w in words)
    rows = [(i, " ".join([f"a{i}", *words]), "en", "clean") for i in range(60)] + [(100 + i, f"b{i} " + noisy, "en", "noisy") for i in range(60)] + [(200, "c " + noisy, "en", "clean"), (201, "d " + noisy, None, None)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(60)) and all(got[100 + i] for i in range(60)) and not got[200]


def brute_bounds(rows):
    """Bounds of {(lang, source): ...} from exact quantiles, by plain loops."""
    import numpy as np

    def ratios(t):
        n, chars, symbols, dup, rep = counts(t)
        lines = len([x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
        return {"symbols": symbols / max(n, 1), "dup_lines": dup / (lines + 10), "repeats": rep / (n + 100), "chars": chars / max(n, 1)}

    def quantile(a, u):
        return a[max(0, int(np.ceil(round(u * len(a), 6))) - 1)]

    def bound(values, k, side):
        a = sorted(values if side == "hi" else [-x for x in values])
        inner, at = quantile(a, quality.INNER), [quantile(a, min(1.0, quality.FROM + quality.STEP * i)) for i in range(81)]
        got = at[-1]
        for x, y in zip(at[:-1], at[1:], strict=True):
            if y - x > max(x - inner, quality.LEAST_JUMP[k]):
                got = x + quality.INTO * (y - x)
                break
        return got if side == "hi" else -got

    def all_bounds(rs):
        return {(k, s): bound([r[k] for r in rs], k, s) for k, s in quality.SIDES}

    def drawn(own, n, outer):
        return {k: (n * v + quality.PRIOR * outer[k]) / (n + quality.PRIOR) for k, v in own.items()}

    made = [(lang, source, ratios(t), counts(t)) for t, lang, source in rows]
    passed = [(x, y, r) for x, y, r, c in made if not (c[0] < 20 or 100 * c[4] > 30 * c[0])]
    whole = all_bounds([r for _, _, r in passed])
    out = {}
    for lang in {x for x, _, _ in passed}:
        own = [r for x, _, r in passed if x == lang]
        by_lang = drawn(all_bounds(own), len(own), whole)
        for source in {y for x, y, _ in passed if x == lang}:
            g = [r for x, y, r in passed if (x, y) == (lang, source)]
            out[lang, source] = drawn(all_bounds(g), len(g), by_lang)
    return out, made


def test_quality_bounds_by_exact_quantiles(spark, sf):
    """Verdicts agree with exact quantiles, bounds differ between sources, and labels are followed."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in d.select("doc_id", "text", "lang", "source").collect()]
    bounds, made = brute_bounds([r[1:] for r in rows])
    want = {}
    for (i, *_), (lang, source, r, c) in zip(rows, made, strict=True):
        b = bounds.get((lang, source), {})
        odd = any(r[k] > v if s == "hi" else r[k] < v for (k, s), v in b.items())
        want[i] = not (c[0] < 20 or 100 * c[4] > 30 * c[0]) and not odd
    got = {r["doc_id"]: r["kept"] for r in quality.judge(d).collect()}
    assert sum(got[i] != want[i] for i in got) <= 0.005 * len(got)
    for k in quality.SIDES:
        assert len({round(b[k], 3) for b in bounds.values()}) > 10, k
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    passed = [(label[i], got[i]) for (i, *_), (_, _, _, c) in zip(rows, made, strict=True) if i in label and not (c[0] < 20 or 100 * c[4] > 30 * c[0])]
    assert sum(k for q, k in passed if q == 1) >= 0.99 * sum(q == 1 for q, _ in passed)
    assert sum(k for q, k in passed if q == 0) <= 0.15 * sum(q == 0 for q, _ in passed)


def test_quality_salted_join(spark, monkeypatch):
    """Where the bounds are too many to broadcast, a salted join gives the same verdicts."""
    rows = [(i, " ".join(f"w{j}" for j in range(30)) + (" #" * 25 if i % 9 == 0 else "")) for i in range(90)]
    d = docs(spark, rows)
    want = sorted(tuple(r) for r in quality.judge(d).collect())
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    assert sorted(tuple(r) for r in quality.judge(d).collect()) == want
    assert {i: k for i, *_, k in want} == {i: i % 9 != 0 for i in range(90)}


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for k, p, lo, hi in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if lo <= len(d) <= hi and (k == 3 or luhn(d)):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def check_pii(rows, got):
    want = Counter()
    for i, t in rows:
        b = base(t)
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in b)
        want[(i, *(sum(k == j for _, k, _ in b) for j in range(4)), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want


def test_pii(spark, sf, plain):
    got = LLM_QUERIES["op4_personal_data"](spark, sf).collect()
    check_pii(plain, got)
    assert sum(r["n_email"] for r in got) > 0


MORE = [
    (30, "a@b.c@d.e.f x@y.com_z@w.org .@. é a.b+c@d-e.co. @x.y a@b"),
    (31, "1.2.3.4.5.6.7.8 256.1.1.1 0000255.01.1.1 1.2.3 99999999999999999999.1.1.1 é😀 10.0.0.1"),
    (32, "4111 1111 1111 1111, 4111-1111-1111-1112 +1 (415) 555-2671 5 4111111111111111 +49 30 1234 +123456789012345678"),
    (33, "1 " * 20_000 + "9" * 20_000),
    (34, "call me: 415-555-2671 or john [at] example [dot] com, ssn 123-45-6789; 4111 1111 1111 111"),
    (35, "a" * 50_000 + "@" + "b." * 20_000 + "c"),
]


def test_pii_awkward(spark):
    rows = [*AWKWARD, *MORE]
    d = docs(spark, rows)
    got = pii.find(d).collect()
    check_pii(rows, got)
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert "phone_local:9:21" in spans[34] and "email_spelled" in spans[34]
    assert pii.find(d.limit(0)).count() == 0


def test_em_separates():
    p, rates = pii.estimate({(5, 0b11111): 80, (5, 0b11101): 40, (5, 0b00000): 100, (5, 0b10000): 60})
    assert p[5, 0b11111] > 0.9 and p[5, 0] < 0.1
    assert rates[5][0][0] > 0.8 > 0.3 > rates[5][0][1]


def planted(seed, n):
    """(rows, truth {doc_id: {(kind, start, end)}}): prose with personal data and look-alikes that are none."""
    import random

    rng = random.Random(seed)
    low = lambda k: [rng.choice("river stone market gentle walking under bright seven garden window paper cloud often simple letter morning".split()) for _ in range(k)]
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    own_first = "Zebulon Quentin Thorbjorn Ysolde Branwen Caspian Ottoline Leocadia".split()
    last = "Hartwell Okonkwo Lindqvist Abernathy Castellano Whitcombe Novak Jorgensen Petrov Moreau Delacroix Fairbanks".split()
    street = ["Maple Street", "Old Mill Road", "Harbor Avenue", "North Elm Lane", "Cedar Drive"]

    def person():
        first = rng.choice(own_first if rng.random() < 0.3 else pii.FIRST_NAMES)
        return f"{first} {rng.choice(last)}"

    def good():
        k = rng.choice(["name", "name", "address", "phone_local", "id_number", "card_like", "email_spelled"])
        if k == "name":
            return k, rng.choice(["please ask for our employee ", "the letter was signed ", "dear ", "the author is called ", "a patient named "]), person(), rng.choice([" who lives here", ", phone on file", " said so", " again"])
        if k == "address":
            return k, rng.choice(["the home address is ", "she lives at ", "please deliver to "]), f"{rng.randint(1, 999)} {rng.choice(street)}", rng.choice([", Springfield", ", Boston", " near here"])
        if k == "phone_local":
            return k, rng.choice(["call me on ", "my phone is ", "fax: "]), f"{rng.randint(2, 9)}{digits(2)}-{rng.randint(2, 9)}{digits(2)}-{digits(4)}", rng.choice([" after six", ". thanks", " or write"])
        if k == "id_number":
            return k, rng.choice(["social security ", "ssn ", "identity no "]), f"{rng.randint(1, 5)}{rng.randint(10, 65)}-{rng.randint(10, 99)}-{rng.randint(1000, 9998)}", rng.choice([" issued", ", born there", " on file"])
        if k == "card_like":
            return k, rng.choice(["my visa card ", "credit card "]), f"4{digits(3)} {digits(4)} {digits(4)} {digits(3)}1 {digits(3)}", rng.choice([" exp soon", ", valid", " then"])
        return k, rng.choice(["mail me at ", "contact "]), f"{rng.choice(last).lower()} [at] {rng.choice('post mail corp'.split())} [dot] {rng.choice(['com', 'org'])}", rng.choice([" for more", ". or call"])

    def bad():
        return rng.choice([
            f"we saw Grand {rng.choice(['River', 'Lake', 'Church', 'Museum'])} today",
            f"the {rng.choice(['Central', 'Royal', 'National'])} {rng.choice(['Bank', 'Museum', 'University', 'Station'])} opened",
            f"part #{digits(3)}-{digits(2)}-0000 was sold",
            f"item/{digits(3)}-{digits(2)}-{digits(4)} in stock",
            f"version 0{digits(2)}.1{digits(2)}.{digits(4)} of it",
            f"measured {digits(4)} {digits(3)} {digits(3)} times",
        ])

    rows, truth = [], {}
    for i in range(n):
        out, at, spans = [], 0, set()
        for _ in range(rng.randint(1, 4)):
            text = " ".join(low(rng.randint(5, 15))).capitalize() + ". "
            out.append(text)
            at += len(text)
            if rng.random() < 0.5:
                text = "Then " + bad() + ". "
                out.append(text)
                at += len(text)
            else:
                k, before, span, after = good()
                text = "Then " + before
                spans.add((k, at + len(text), at + len(text) + len(span)))
                out.append(text + span + after + ". ")
                at += len(out[-1])
        rows.append((i, "".join(out)))
        truth[i] = spans
    return rows, truth


def test_pii_planted(spark):
    """Personal data of no fixed pattern, planted among look-alikes: precision and recall of what the method adds, over all and by kind."""
    rows, truth = planted(4, 800)
    hit, said, real = Counter(), Counter(), Counter()
    for r in pii.find(docs(spark, rows).repartition(4)).collect():
        got = {(k, int(a), int(z)) for k, a, z in (x.split(":") for x in r["spans"].split(",") if x) if k in pii.MORE}
        for k, a, z in got:
            said[k] += 1
            hit[k] += (k, a, z) in truth[r["doc_id"]]
        for k, _, _ in truth[r["doc_id"]]:
            real[k] += 1
    print({k: (round(hit[k] / max(1, said[k]), 3), round(hit[k] / real[k], 3)) for k in pii.MORE})
    assert sum(hit.values()) >= 0.9 * sum(said.values()) and sum(hit.values()) >= 0.9 * sum(real.values())
    for k in pii.MORE:
        assert hit[k] >= 0.8 * said[k] and hit[k] >= 0.8 * real[k], (k, hit[k], said[k], real[k])


def test_pii_leaves_prose_alone(spark, sf, plain):
    got = LLM_QUERIES["op4_personal_data"](spark, sf).collect()
    assert sum(r["n_more"] for r in got) <= 0.01 * len(got)


def test_pii_many_matches(spark):
    """Matches beyond one block keep their places, and thousands of them take no long."""
    text = "x@y.zz 1.2.3.4 " * 3000
    r = pii.find(docs(spark, [(1, text)])).collect()[0]
    assert (r["n_email"], r["n_ip"]) == (3000, 3000)
    check_pii([(1, text)], [r])


def test_pii_repeats_of_every_name(spark):
    """A name said twice is marked so wherever it stands among a text's names, and one said once is not."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda i: f"Zor{letters[i // 26]}{letters[i % 26]} Quil{letters[i % 26]}{letters[i // 26]}"
    order = [*range(400), *range(350, 400), *range(0, 10)]
    text = "; ".join(f"then {name(i)}" for i in order) + "; card 1234 5678 9012 3456 and 12 1234 5678 9012 3456"
    bit = 1 << len(pii.LABELERS) + pii.FEATURES.index("repeated")
    got = {}
    for x in pii.candidates(docs(spark, [(1, text)])).collect()[0]["more"]:
        got.setdefault(text[x["s"] : x["e"]], []).append(bool(x["v"] & bit))
    assert got.pop("1234 5678 9012 3456") == [True, True]
    assert got == {name(i): [order.count(i) > 1] * order.count(i) for i in range(400)}
