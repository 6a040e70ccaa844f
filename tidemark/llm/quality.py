"""Operator 2: quality rules with adaptive thresholds, in DataFrame functions only.

Counts are made per document; four ratios (symbols per word, repeated lines per
line, repeated words per word, characters per word) of the documents that pass
the base rule feed mergeable KLL quantile sketches per (lang, source); merged,
they give those of each language and of the corpus. A bound comes from the
sketch's quantiles alone, read outwards in steps of ``STEP`` from ``FROM``: the
first jump that is wider than everything inside it (from the opposite tail's
``INNER`` quantile, and ``LEAST_JUMP`` where that is narrower) parts the bulk
from outliers, and the bound lies at ``INTO`` of it. A sketch without such a
jump is bounded by its own extreme, so it rejects nothing. Characters per word
have a lower bound as well, found the same way. The bounds of a group of n
documents count n / (n + ``PRIOR``), those of its language the rest, and those of
a language are likewise drawn to the corpus's, so no group size switches rules.

Ratios of lines and repeats have ``PAD`` added below, so that one repeated line
of five is no outlier. Verdicts come from joining the bounds (one row per group)
to the documents; they are broadcast when counted as few, and otherwise joined
over salted keys.

Edge cases: a null or empty text has no words, so it fails the base rule; null
``lang`` or ``source`` form a group of their own; a group that only the base rule
rejects has no bounds and needs none; a null ``doc_id`` stays null; repeated rows
repeat; an empty table gives no rows; extra columns pass through
``filter_documents`` and are ignored by ``judge``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import frugal, save
from tidemark.session import BROADCAST_ROWS

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: ratio -> least jump that parts outliers, where the bulk has no width; only characters per word are bounded below too.
LEAST_JUMP = {"symbols": 0.1, "dup_lines": 0.1, "repeats": 0.15, "chars": 0.5}
#: Added to the lines and words that these ratios divide by.
PAD = {"dup_lines": 10, "repeats": 100}
FROM, STEP, INNER, INTO = 0.6, 0.005, 0.02, 0.25
PRIOR, SKETCH_K, SALTS = 50, 800, 32
SLACK = 1e-6  # a value equal to its bound is inside
SIDES = [(k, "hi") for k in LEAST_JUMP] + [("chars", "lo")]
_SPACE = r"[\\x20\\x09-\\x0D]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts (prefix ``_q_``); names are prefixed so that no column of the input clashes."""
    t = "coalesce(cast(text as string), '')"
    d = docs.withColumns(
        {
            "_q_w": F.expr(f"filter(split({t}, '{_SPACE}+'), w -> w <> '')"),
            "_q_l": F.expr(f"filter(split({t}, '\\n', -1), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"),
            "_q_word_chars": F.expr(f"length(regexp_replace({t}, '{_SPACE}+', ''))"),
            "_q_n_symbols": F.expr(f"length({t}) - length(translate({t}, '#*$%&|<>', ''))"),
        }
    )
    d = d.withColumn("_q_h", F.expr(f"if(size(_q_w) >= {WINDOW}, transform(sequence(0, size(_q_w) - {WINDOW}), i -> xxhash64(slice(_q_w, i + 1, {WINDOW}))), cast(array() as array<bigint>))"))
    d = d.withColumns({"_q_lines": F.expr("size(_q_l)"), "_q_n_dup_lines": F.expr("size(_q_l) - size(array_distinct(_q_l))"), "_q_n_words": F.expr("size(_q_w)")})
    # windows by hash and place, only where some hash recurs
    d = d.withColumn("_q_s", F.expr("if(size(array_distinct(_q_h)) = size(_q_h), cast(array() as array<struct<h:bigint,i:int>>), sort_array(transform(_q_h, (x, i) -> struct(x as h, i as i))))"))
    d = d.withColumn("_q_p", F.expr("sort_array(transform(filter(_q_s, (e, j) -> (j > 0 and _q_s[greatest(j - 1, 0)].h = e.h) or (j < size(_q_s) - 1 and _q_s[least(j + 1, size(_q_s) - 1)].h = e.h)), e -> e.i))"))
    covered = f"aggregate(transform(_q_p, (p, j) -> if(j = size(_q_p) - 1, {WINDOW}, least({WINDOW}, _q_p[least(j + 1, size(_q_p) - 1)] - p))), 0L, (a, x) -> a + x)"
    # generated, so that the optimiser never copies these expressions into a later filter and counts a text again for each use
    names = [f"_q_{c}" for c in (*COUNTS, "lines")]
    d = d.withColumn("_q_n_repeat_words", F.expr(covered))
    own = [F.col(f"`{c}`") for c in docs.columns]
    return d.select(*own, F.explode(F.array(F.struct(*names))).alias("_q")).select(*own, *[F.col(f"_q.{c}").alias(c) for c in names])


def _ratios() -> dict[str, Column]:
    n = F.greatest(F.col("_q_n_words"), F.lit(1)).cast("double")
    return {
        "symbols": F.col("_q_n_symbols") / n,
        "dup_lines": F.col("_q_n_dup_lines") / (F.col("_q_lines") + PAD["dup_lines"]),
        "repeats": F.col("_q_n_repeat_words") / (F.col("_q_n_words") + PAD["repeats"]),
        "chars": F.col("_q_word_chars") / n,
    }


def _base_failed() -> Column:
    return (F.col("_q_n_words") < MIN_WORDS) | (100 * F.col("_q_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_q_n_words"))


def _group() -> list[Column]:
    """Group keys that are never null: the marker keeps a null apart from an empty string."""
    return [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")).alias(f"_q_{c}") for c in ("lang", "source")]


def _bound(sketch: str, side: str, least: float) -> tuple[Column, Column]:
    """Quantiles of a sketch, and from them its bound: inside the first jump outwards that is wider than all within it, else the extreme."""
    steps = round((1 - FROM) / STEP) + 1
    up = [INNER, *[min(1.0, FROM + STEP * i) for i in range(steps)]]
    # quantiles from the inner tail outwards, mirrored for the lower side
    q = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(round(u if side == "hi" else 1 - u, 6)) for u in up]))
    if side == "lo":
        q = F.transform(q, lambda x: -x)
    held = f"_q_at_{sketch}_{side}"
    first = f"array(get(filter(sequence(1, {steps - 1}), i -> q[i + 1] - q[i] > greatest(q[i] - q[0], {least}D)), 0))"  # in an array of one, so that it is found once
    out = F.expr(f"transform(array({held}), q -> transform({first}, i -> if(i is null, q[{steps}], q[i] + {INTO}D * (q[i + 1] - q[i])))[0])[0]")
    return q.alias(held), (-out if side == "lo" else out).alias(f"{side}_{sketch}")


def _bounds(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, n and the bounds of each sketch row."""
    made = [_bound(k, side, LEAST_JUMP[k]) for k, side in SIDES]
    return sketches.select(*keys, "n", *[q for q, _ in made]).select(*keys, "n", *[b for _, b in made])


def thresholds(counted: DataFrame) -> DataFrame:
    """(_q_lang, _q_source, _q_hi_x for each ratio, _q_lo_chars): one row per group of documents that pass the base rule."""
    src = counted.where(~_base_failed()).select(*_group(), *[c.cast("double").alias(k) for k, c in _ratios().items()])
    sketched = [F.kll_sketch_agg_double(k, SKETCH_K).alias(k) for k in LEAST_JUMP]
    g = save(src.groupBy("_q_lang", "_q_source").agg(F.count(F.lit(1)).alias("n"), *sketched), "quality-sketches")
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(k, SKETCH_K).alias(k) for k in LEAST_JUMP]]
    names = [f"{side}_{k}" for k, side in SIDES]

    def drawn(inner: DataFrame, outer: dict[str, Column]) -> DataFrame:
        """Bounds of ``inner``, each drawn to those of ``outer`` by ``PRIOR`` documents."""
        return inner.select(*[c for c in inner.columns if c.startswith("_q_")], "n", *[((F.col("n") * F.col(x) + PRIOR * outer[x]) / (F.col("n") + PRIOR)).alias(x) for x in names])

    whole = _bounds(g.agg(*merged).where("n > 0"), [])
    one = whole.select(F.struct(*names)).scalar()
    by_lang = drawn(_bounds(g.groupBy("_q_lang").agg(*merged), ["_q_lang"]), {x: one[x] for x in names})
    own = _bounds(g, ["_q_lang", "_q_source"]).join(by_lang.select("_q_lang", *[F.col(x).alias(f"o_{x}") for x in names]), "_q_lang")
    out = drawn(own, {x: F.col(f"o_{x}") for x in names})
    return out.select("_q_lang", "_q_source", *[(F.col(x) + (SLACK if x.startswith("hi") else -SLACK)).alias(f"_q_{x}") for x in names])


def _judged(counted: DataFrame, bounds: DataFrame) -> DataFrame:
    """``counted`` with ``_q_base_failed`` and ``_q_kept``."""
    keyed = counted.withColumns(dict(zip(("_q_lang", "_q_source"), _group(), strict=True)))
    if bounds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        j = keyed.join(F.broadcast(bounds), ["_q_lang", "_q_source"], "left")
    else:  # a hot group is dealt over the salts
        salted = bounds.withColumn("_q_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        j = keyed.withColumn("_q_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["_q_lang", "_q_source", "_q_salt"], "left")
    r, odd = _ratios(), F.lit(False)
    for k, side in SIDES:
        b = F.col(f"_q_{side}_{k}")
        odd = odd | (r[k] > b if side == "hi" else r[k] < b)
    return j.withColumn("_q_base_failed", _base_failed()).withColumn("_q_kept", ~F.col("_q_base_failed") & ~F.coalesce(odd, F.lit(False)))


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, the five counts, base_failed, kept); texts are read and counted once."""
    own = frugal(docs).select("doc_id", "text", "lang", "source")
    counted = save(_counted(own).drop("text"), "quality-counts")
    j = _judged(counted, save(thresholds(counted), "quality-bounds"))
    return j.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f"_q_{c}").cast("long").alias(c) for c in COUNTS], F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The kept documents with all their columns; texts are counted once and saved beside their counts, never shuffled."""
    counted = save(_counted(frugal(docs)), "quality-counts")
    return _judged(counted, save(thresholds(counted), "quality-bounds")).where("_q_kept").select(*[F.col(f"`{c}`") for c in docs.columns])
