"""Operator 4: personal data by weak supervision, in DataFrame functions only.

Fixed patterns (email, ip, card, phone) are always reported. Candidates that no
pattern covers (spelled-out emails, local phone numbers, identity numbers, card
numbers of another length, names of persons, street addresses) come with the
votes of six labelers: a strict form (regex), a gazetteer, a cue word before, a
validity check, clean borders and other personal data nearby. Over the counts of
vote patterns of all documents expectation-maximisation estimates each
labeler's reliability and every pattern's posterior, with a hidden class and
reliabilities of its own for each kind. A logistic span classifier is trained on
those posteriors; it sees the votes and four features that no labeler has (a cue
after the span, the start of a line, length, repetition in the document) and
decides each candidate. The driver handles pattern counts only, at most
``len(KINDS) - 4`` x 2^10 rows whatever the corpus.

Positions come from ``split`` and ``regexp_extract_all`` with one pattern: the
lengths of pieces and matches add up to the starts, in code points. They are
added up by blocks of ``BLOCK`` matches, so that many matches of one text cost
about their number. Patterns are written so that Java's matcher neither recurses
nor backtracks quadratically.

Edge cases: a null or empty text has no spans; a null ``doc_id`` stays null;
repeated rows repeat; an empty table gives no rows; other columns are ignored.
Candidates that overlap a fixed pattern's span are left to it; an accepted name
inside an accepted address is left to that.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import save, texts

#: Kinds in their order at equal starts.
KINDS = ("email", "ip", "card", "phone", "email_spelled", "phone_local", "id_number", "card_like", "address", "name")
BASE, MORE = KINDS[:4], KINDS[4:]
LABELERS = ("form", "gazetteer", "cue", "valid", "border", "near")
FEATURES = ("cue_after", "line_start", "long", "repeated")
#: Fixed gazetteers.
TOP_DOMAINS = "com org net edu gov de fr es uk eu io info us ch at be nl it pt mx ar".split()
FIRST_NAMES = """James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph
Jessica Thomas Sarah Charles Karen Christopher Lisa Daniel Nancy Matthew Betty Anthony Sandra Mark Margaret Paul Emily
Steven Anna Andrew Emma George Laura Kevin Helen Brian Julia Edward Alice Peter Rachel Henry Grace Jack Hannah Adam Jane
Hans Klaus Jürgen Wolfgang Stefan Andreas Katrin Ursula Monika Petra Sabine Heike Dieter Uwe Lukas Jonas Lena Greta Karl
Jean Pierre Marie Jacques François Louis Claire Camille Chloé Luc Antoine Nicolas Julien Sophie Hélène Céline Amélie René
José Juan Carlos María Luis Carmen Ana Miguel Pedro Javier Sofía Lucía Elena Pablo Diego Isabel Pilar Rosa Jorge Manuel
Mohammed Ali Fatima Ahmed Omar Wei Li Chen Yuki Hiroshi Priya Raj Anil Olga Ivan Natasha Dmitri Igor Anya Giulia Marco""".split()
CITIES = """London Paris Berlin Madrid Rome Vienna Zurich Geneva Brussels Amsterdam Lisbon Dublin Boston Chicago Denver Dallas
Houston Seattle Miami Atlanta Phoenix Austin Portland Toronto Montreal Vancouver Sydney Melbourne Munich München Hamburg Köln
Cologne Frankfurt Stuttgart Dresden Leipzig Bremen Hannover Nürnberg Lyon Marseille Toulouse Nice Nantes Bordeaux Lille
Strasbourg Barcelona Valencia Sevilla Seville Bilbao Zaragoza Málaga Granada Mexico Bogotá Lima Santiago Oxford Cambridge
Manchester Liverpool Leeds Bristol Edinburgh Glasgow Springfield Franklin Georgetown Salem Madison Arlington Clinton""".split()
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Frau|Señor|Señora|Don|Doña|Monsieur|Madame|Mme"
#: Words that end no person's name.
NO_NAMES = """Street Road Avenue Lane University College School Company Corporation Inc Ltd Group Bank Church Park River Lake Bay
Mountain County City State States Kingdom Republic Union Museum Hospital Station Airport Times Post News Press Award Prize League
Club Team House Center Centre Council Court Act War Day Week Month Year Monday Tuesday Wednesday Thursday Friday Saturday Sunday
January February March April May June July August September October November December North South East West""".split()
CUES = {
    "email_spelled": "mail|contact|write|kontakt|correo|courriel|adresse|reach",
    "phone_local": "phone|tel|call|fax|mobile|cell|fon|anruf|appel|llam|contact|dial|ring|reach",
    "id_number": "ssn|social|security|identity|identification|passport|ausweis|dni|personal no|personal number",
    "card_like": "card|visa|master|amex|credit|karte|carte|tarjeta|payment|debit",
    "address": "address|live|resid|home|ship|deliver|mail|wohn|adresse|domicil|direcci|located at|moved to|send",
    "name": "name|called|mr|mrs|ms|dr|prof|signed|contact|sincerely|regards|nombre|nom|herr|frau|dear|patient|customer|employee|author|attn|yours|with",
}
#: Words that follow such spans, which no labeler looks at.
AFTER = {
    "email_spelled": "for|or|if|thanks",
    "phone_local": "ext|between|hours|after|before|or",
    "id_number": "dob|born|date of birth|issued|exp",
    "card_like": "exp|cvv|cvc|valid|code",
    "address": "apt|suite|floor|zip|[0-9]{5}|tel|phone",
    "name": "who|said|wrote|born|lives|works|[(]|phone|tel|mail|aged|signed",
}
LONG = {"email_spelled": 40, "phone_local": 13, "id_number": 11, "card_like": 19, "address": 40, "name": 24}
ACCEPT = 0.5
EM_ROUNDS, FIT_ROUNDS = 60, 400
CUE_REACH, AFTER_REACH, NEAR, BLOCK = 40, 24, 120, 128

_PATTERN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+",
    "card": r"[0-9](?:[\\x20-]?[0-9])++",
    "phone": r"\\+[0-9][\\x20().0-9-]+[0-9]",
    "email_spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}\\x20?[\\[(]\\x20?(?:at|AT)\\x20?[\\])]\\x20?[A-Za-z0-9-]{2,64}(?:\\.[A-Za-z0-9-]{2,24}|\\x20?[\\[(]\\x20?(?:dot|DOT)\\x20?[\\])]\\x20?[A-Za-z0-9-]{2,24}){1,3}",
    "phone_local": r"(?<![0-9A-Za-z+.-])(?:\\([0-9]{3}\\)\\x20?|[0-9]{3}[-.\\x20])[0-9]{3}[-.\\x20][0-9]{4}(?![0-9A-Za-z-])",
    "id_number": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card_like": r"(?<![0-9A-Za-z.-])[0-9]{4}(?:[\\x20-][0-9]{3,6}){2,4}(?![0-9A-Za-z-])",
    "address": r"(?<![\\p{L}0-9])(?:[0-9]{1,5}\\x20(?:\\p{Lu}[\\p{L}.]{0,19}\\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Way|Place|Terrace)(?!\\p{L})|\\p{Lu}\\p{Ll}{1,19}(?:straße|strasse|weg|platz|gasse|allee)\\x20[0-9]{1,4}(?![\\p{L}0-9])|[0-9]{1,4},?\\x20(?:rue|avenue|boulevard|place|quai)\\x20(?:d[eu]\\x20)?(?:l[ae]\\x20)?\\p{Lu}\\p{L}{1,19}|(?:Calle|Avenida|Plaza|Paseo)\\x20(?:de\\x20)?(?:la\\x20)?\\p{Lu}\\p{L}{1,19},?\\x20[0-9]{1,4}(?![\\p{L}0-9]))",
    "name": r"(?<![\\p{L}0-9])\\p{Lu}\\p{Ll}{1,15}(?:-\\p{Lu}\\p{Ll}{1,15})?(?:\\x20\\p{Lu}\\.)?(?:\\x20\\p{Lu}[\'’]?\\p{Lu}?\\p{Ll}{1,15}){1,2}(?![\\p{L}0-9])",
}
#: SQL that a text searched for the kind fulfils.
_GUARD = {
    "email": "contains(text, '@')",
    "ip": "contains(text, '.') and rlike(text, '[0-9]')",
    "card": "rlike(text, '[0-9]')",
    "phone": "contains(text, '+') and rlike(text, '[0-9]')",
    "email_spelled": r"rlike(text, '[\\[(]\\x20?(?:at|AT)')",
    "phone_local": "rlike(text, '[0-9]')",
    "id_number": "contains(text, '-') and rlike(text, '[0-9]')",
    "card_like": "rlike(text, '[0-9]')",
    "address": "rlike(text, '[0-9]')",
    "name": "true",
}
_SPAN = "array<struct<s:int,k:int,e:int,m:string>>"
_VOTED = "array<struct<s:int,k:int,e:int,v:int>>"
_MARKED = "array<struct<m:string,s:int,k:int,e:int,again:boolean>>"
_NO_SPANS = f"cast(array() as {_SPAN})"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    at = f"cast(substring({d}, length({d}) - i, 1) as int)"
    return f"aggregate(transform(sequence(0, length({d}) - 1), i -> if(i % 2 = 0, {at}, {at} * 2 - if({at} > 4, 9, 0))), 0, (a, x) -> a + x) % 10 = 0"


_VALID = {
    "email": "true",
    "ip": "forall(split(x.m, '\\\\.'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', right(ltrim('0', p), 3)) as int) <= 255)",
    "card": f"length({_digits('x.m')}) between 14 and 19 and {_luhn(_digits('x.m'))}",
    "phone": f"length({_digits('x.m')}) between 10 and 15",
}


def _found(kind: str) -> str:
    """SQL of the kind's matches as (start, kind, end, text)."""
    k, p = KINDS.index(kind), _PATTERN[kind]
    pairs = f"zip_with(split(text, '{p}', -1), regexp_extract_all(text, '{p}', 0), (a, b) -> struct(length(a) as n, b as m))"
    # each block's matches by their place in the block, then each block by its place in the text
    block = f"""aggregate(slice(p, c * {BLOCK} + 1, {BLOCK}), named_struct('at', 0, 'out', {_NO_SPANS}),
        (acc, x) -> named_struct('at', acc.at + x.n + coalesce(length(x.m), 0),
          'out', if(x.m is null, acc.out, concat(acc.out, array(named_struct('s', acc.at + x.n, 'k', {k}, 'e', acc.at + x.n + length(x.m), 'm', x.m))))))"""
    blocks = f"transform(sequence(0, (size(p) - 1) div {BLOCK}), c -> {block})"
    walk = f"""aggregate({blocks}, named_struct('at', 0, 'out', cast(array() as array<struct<at:int,own:{_SPAN}>>)),
        (acc, x) -> named_struct('at', acc.at + x.at, 'out', concat(acc.out, array(named_struct('at', acc.at, 'own', x.out)))),
        acc -> flatten(transform(acc.out, o -> transform(o.own, x -> named_struct('s', o.at + x.s, 'k', x.k, 'e', o.at + x.e, 'm', x.m)))))"""
    return f"if({_GUARD[kind]}, transform(array({pairs}), p -> {walk})[0], {_NO_SPANS})"


def _words(words: list[str]) -> str:
    return "|".join(words)


def _votes(kind: str) -> str:
    """SQL of a candidate's votes and features as bits; ``x`` is the marked candidate, ``near`` every span and candidate of the text but names."""
    d = _digits("x.m")
    before = f"lower(substring(text, greatest(x.s - {CUE_REACH - 1}, 1), least(x.s, {CUE_REACH})))"
    after = f"lower(substring(text, x.e + 1, {AFTER_REACH}))"
    last = "element_at(split(x.m, ' '), -1)"
    form = {
        "email_spelled": "rlike(x.m, '(?i)dot')",
        "phone_local": "rlike(x.m, '[(-]')",
        "id_number": "not rlike(substring(text, greatest(x.s - 1, 1), least(x.s, 2)), '[#/:]')",
        "card_like": f"length({d}) between 13 and 19",
        "address": "length(x.m) >= 10",
        "name": "x.s > 1 and not rlike(substring(text, greatest(x.s - 1, 1), least(x.s, 2)), '[.!?\\n]')",
    }[kind]
    gazetteer = {
        "email_spelled": f"rlike(lower(x.m), '({_words(TOP_DOMAINS)})$')",
        "phone_local": "rlike(x.m, '^[(]?[2-9]')",
        "id_number": "not rlike(x.m, '^(000|666|9)')",
        "card_like": "rlike(x.m, '^(4|5[1-5]|2[2-7]|3[47]|6)')",
        "address": f"rlike(substring(text, x.e + 1, 60), '(?<!\\\\p{{L}})({_words(CITIES)})(?!\\\\p{{L}})')",
        "name": f"rlike(x.m, '^({_words(FIRST_NAMES)})[\\\\x20-]') or rlike(substring(text, greatest(x.s - 8, 1), least(x.s, 9)), '(?<!\\\\p{{L}})({TITLES})\\\\.?\\\\x20$')",
    }[kind]
    valid = {
        "email_spelled": "not rlike(x.m, '[.%+-]$')",
        "phone_local": f"not rlike({d}, '^...[01]')",
        "id_number": f"not rlike({d}, '^...00|0000$')",
        "card_like": _luhn(d),
        "address": "not rlike(x.m, '^0')",
        "name": f"not rlike({last}, '^({_words(NO_NAMES)})$') and not rlike(x.m, '^(The|This|That|In|On|At|It|He|She|We|And|But|For|New|Der|Die|Das|Le|La|Les|El|Los|Un|Une)\\\\x20')",
    }[kind]
    border = "rlike(concat(substring(text, x.s, if(x.s = 0, 0, 1)), ' '), '^[\\\\x20\\n,;:(]') and rlike(concat(substring(text, x.e + 1, 1), ' '), '^[\\\\x20\\n.,;:)!?]')"
    near = f"exists(near, o -> o.s <> x.s and o.k <> x.k and o.s < x.e + {NEAR} and x.s < o.e + {NEAR})"
    bits = (form, gazetteer, f"rlike({before}, '(?<!\\\\p{{L}})({CUES[kind]})')", valid, border, near)
    extra = (
        f"rlike({after}, '^[^\\\\p{{L}}0-9(]{{0,3}}({AFTER[kind]})')",
        "x.s = 0 or substring(text, x.s, 1) = '\\n'",
        f"length(x.m) > {LONG[kind]}",
        "x.again",
    )
    return " + ".join(f"if({b}, {1 << i}, 0)" for i, b in enumerate((*bits, *extra)))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, more): pattern spans, and candidates outside them with their votes and features."""
    d = texts(docs)
    found = [F.expr(f"filter({_found(k)}, x -> {_VALID[k]})").alias(f"_{k}") for k in BASE] + [F.expr(_found(k)).alias(f"_{k}") for k in MORE]
    d = d.select("doc_id", "text", *found)
    d = d.select("doc_id", "text", F.expr(f"sort_array(concat({', '.join('_' + k for k in BASE)}))").alias("base"), *[f"_{k}" for k in MORE])
    apart = [F.expr(f"filter(_{k}, x -> not exists(base, b -> b.s < x.e and x.s < b.e))").alias(f"_{k}") for k in MORE]
    d = d.select("doc_id", "text", "base", *apart)
    # a name may be told apart by other spans near it, but prose is full of name-like pairs: they are nobody's neighbours
    d = d.withColumn("near", F.expr(f"concat(base, {', '.join('_' + k for k in MORE if k != 'name')})"))
    # equal spans stand side by side once sorted by their text; no two of one text begin at one place
    same = "coalesce(get(p, i - 1).m = x.m, false) or coalesce(get(p, i + 1).m = x.m, false)"
    mark = f"transform(p, (x, i) -> named_struct('m', x.m, 's', x.s, 'k', x.k, 'e', x.e, 'again', {same}))"
    sort = "sort_array(transform(concat(near, _name), x -> named_struct('m', x.m, 's', x.s, 'k', x.k, 'e', x.e)))"
    marked = F.expr(f"transform(array({sort}), p -> {mark})[0]").cast(_MARKED)
    d = d.select("doc_id", "text", "base", "near", F.when(F.expr(" + ".join(f"size(_{k})" for k in MORE) + " > 0"), marked).otherwise(F.expr(f"cast(array() as {_MARKED})")).alias("marked"))
    voted = [F.expr(f"transform(filter(marked, x -> x.k = {KINDS.index(k)}), x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'v', {_votes(k)}))") for k in MORE]
    return d.select("doc_id", F.expr("transform(base, b -> named_struct('s', b.s, 'k', b.k, 'e', b.e))").alias("base"), F.concat(*voted).cast(_VOTED).alias("more"))


def estimate(patterns: dict[tuple[int, int], int]) -> tuple[dict[tuple[int, int], float], dict[int, list[tuple[float, float]]]]:
    """Posterior of each (kind, votes), and each labeler's estimated rates (of firing on true and on false spans), by expectation-maximisation."""
    n = len(LABELERS)
    out: dict[tuple[int, int], float] = {}
    rates: dict[int, list[tuple[float, float]]] = {}
    for kind in {k for k, _ in patterns}:
        own: dict[int, int] = {}
        for (k, v), c in patterns.items():
            if k == kind:
                own[v & ((1 << n) - 1)] = own.get(v & ((1 << n) - 1), 0) + c
        prior, hit, noise = 0.5, [0.8] * n, [0.3] * n
        post: dict[int, float] = {}
        for _ in range(EM_ROUNDS):
            for v in own:
                a, b = math.log(prior), math.log(1 - prior)
                for i in range(n):
                    on = v >> i & 1
                    a += math.log(hit[i] if on else 1 - hit[i])
                    b += math.log(noise[i] if on else 1 - noise[i])
                post[v] = 1 / (1 + math.exp(max(-50.0, min(50.0, b - a))))
            total = sum(own.values())
            yes = sum(c * post[v] for v, c in own.items())
            prior = (yes + 1) / (total + 2)
            # a beta prior keeps labelers better than chance on either side
            hit = [(4 + sum(c * post[v] for v, c in own.items() if v >> i & 1)) / (5 + yes) for i in range(n)]
            noise = [(1 + sum(c * (1 - post[v]) for v, c in own.items() if v >> i & 1)) / (4 + total - yes) for i in range(n)]
        out.update({(kind, v): p for v, p in post.items()})
        rates[kind] = list(zip(hit, noise, strict=True))
    return out, rates


def train(patterns: dict[tuple[int, int], int]) -> dict[int, tuple[float, list[float]]]:
    """{kind: (bias, weights)} of the span classifier over votes and features, fitted to the posteriors by Newton's steps."""
    post, _ = estimate(patterns)
    n, out = len(LABELERS) + len(FEATURES), {}
    for kind in {k for k, _ in patterns}:
        rows = [(v, c, post[kind, v & ((1 << len(LABELERS)) - 1)]) for (k, v), c in sorted(patterns.items()) if k == kind]
        x = np.array([[1.0, *(v >> i & 1 for i in range(n))] for v, _, _ in rows])
        c, y = np.array([c for _, c, _ in rows], float), np.array([p for _, _, p in rows])
        w, ridge = np.zeros(n + 1), np.full(n + 1, 0.1)
        for _ in range(FIT_ROUNDS):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (c * (p - y)) + ridge * w
            h = (x.T * (c * p * (1 - p) + 1e-9)) @ x + np.diag(ridge)
            step = np.linalg.solve(h, g)
            w = w - step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
            if np.abs(step).max() < 1e-8:
                break
        out[kind] = (float(w[0]), w[1:].tolist())
    return out


def _accepted(model: dict[int, tuple[float, list[float]]]) -> str:
    """SQL of the classifier's decision on x."""
    cut = math.log(ACCEPT / (1 - ACCEPT))
    terms = [f"(x.k = {k} and {b!r}D + {' + '.join(f'((x.v >> {i}) & 1) * {w!r}D' for i, w in enumerate(ws))} >= {cut!r}D)" for k, (b, ws) in sorted(model.items())]
    return " or ".join(terms) or "false"


def patterns_of(found: DataFrame) -> dict[tuple[int, int], int]:
    """Counts of (kind, votes and features) over all candidates; bounded by the bits, not by the corpus."""
    return {(r["k"], r["v"]): r["count"] for r in found.select(F.explode("more").alias("x")).groupBy("x.k", "x.v").count().collect()}


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_more, base_sha256, spans)."""
    found = save(candidates(docs), "pii-candidates")
    model = train(patterns_of(found))
    address = KINDS.index("address")
    taken = f"transform(filter(more, x -> {_accepted(model)}), x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))"
    d = found.withColumn("_taken", F.expr(taken))
    d = d.withColumn("added", F.expr(f"filter(_taken, x -> x.k = {address} or not exists(_taken, o -> o.k = {address} and o.s <= x.s and x.e <= o.e))"))
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    listed = lambda c: f"array_join(transform(sort_array({c}), x -> concat_ws(':', {names}[x.k], x.s, x.e)), ',')"
    n = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return d.select("doc_id", *n, F.expr("cast(size(added) as bigint)").alias("n_more"), F.sha2(F.expr(listed("base")), 256).alias("base_sha256"), F.expr(listed("concat(base, added)")).alias("spans"))
