"""Quality rules: base rules, then a hashed n-gram likelihood ratio.

Texts are tokenised into runs of letters, digits and other signs; their hashed
uni- and bigrams are counted over the trusted documents and over the whole
corpus. A document's score is the mean over its n-grams of
log p(trusted) - log p(corpus); it is rejected below a fixed threshold or one
fitted on the labelled sample. Everything is DataFrame expressions: the
two multinomials are one table of ``buckets`` numbers, a literal of the plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, held, save, smallest_hashes, text_or_empty, words_of

#: Runs of letters, of digits, of other signs.
TOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
SYMBOLS = r"[#*$%&|<>]"


# ------------------------------------------------------------- base rules
def with_base(df: DataFrame, text_col: str, *, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed`` for the non-null text column ``text_col``. Array expressions
    on the document's own row, one sort of its repeated windows: no shuffle."""
    w, h, s, p = fresh(df, "words", "windows", "sorted", "places")
    text = F.col(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    d = df.withColumn(w, held(words_of(text)))
    words = F.col(w)
    d = d.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        h: held(F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(
            F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>")))}).drop(w)
    d = _dup_lines(d, lines)
    # only a text that has a window twice is sorted
    d = d.withColumn(s, held(F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(
        F.transform(F.col(h), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))).drop(h)
    twice = F.filter(F.col(s), lambda x, j: F.coalesce(F.get(F.col(s), j - 1)["h"] == x["h"], F.lit(False))
                     | F.coalesce(F.get(F.col(s), j + 1)["h"] == x["h"], F.lit(False)))
    d = d.withColumn(p, held(F.sort_array(F.transform(twice, lambda x: x["i"])))).drop(s)
    reach = F.transform(F.col(p), lambda x, j: F.least(F.lit(3), F.coalesce(F.get(F.col(p), j + 1) - x, F.lit(3))))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop(p)
    return d.withColumn("base_failed", (F.col("n_words") < min_words)
                        | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))


def _dup_lines(d: DataFrame, lines: Column) -> DataFrame:
    n, = fresh(d, "lines")
    return (d.withColumn(n, held(lines))
            .withColumn("n_dup_lines", (F.size(n) - F.size(F.array_distinct(n))).cast("long")).drop(n))


# ------------------------------------------------------ likelihood ratio
def grams(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """Adds ``name``: the hashes of the text's token uni- and bigrams."""
    t, = fresh(df, "tokens")
    d = df.withColumn(t, held(F.regexp_extract_all(F.col(text_col), F.lit(TOKEN), F.lit(0))))
    tokens = F.col(t)
    one = F.transform(tokens, lambda x: F.xxhash64(x))
    two = F.when(F.size(tokens) >= 2, F.transform(F.sequence(F.lit(0), F.size(tokens) - 2), lambda i: F.xxhash64(
        F.get(tokens, i), F.get(tokens, i + 1)))).otherwise(F.array().cast("array<bigint>"))
    return d.withColumn(name, held(F.concat(one, two))).drop(t)


def counts(df: DataFrame, text_col: str, buckets: int) -> list[int]:
    """n-grams of all texts in each bucket, summed in the tasks first."""
    g, = fresh(df, "grams")
    rows = (grams(df.select(text_col), text_col, g).select(F.explode(g).alias("g"))
            .groupBy(F.pmod("g", F.lit(buckets)).cast("int").alias("bucket")).count().collect())  # buckets rows at most
    out = [0] * buckets
    for r in rows:
        out[r["bucket"]] = r["count"]
    return out


def log_ratio(trusted: list[int], corpus: list[int], smoothing: float = 1.0) -> list[float]:
    """log p(trusted) - log p(corpus) of each bucket, both smoothed by the
    corpus' own distribution so that rare buckets stay near 0."""
    n, m, k = sum(trusted), sum(corpus), len(corpus)
    out = []
    for a, b in zip(trusted, corpus, strict=True):
        prior = (b + smoothing) / (m + smoothing * k)
        weight = smoothing * k
        p = (a + weight * prior) / (n + weight)
        out.append(round(math.log(p / prior), 6))
    return out


def with_score(df: DataFrame, text_col: str, ratio: list[float], name: str) -> DataFrame:
    """Adds ``name``: the mean log ratio of the text's n-grams (0 without any)."""
    g, = fresh(df, "grams")
    table = F.split(F.lit(",".join(map(repr, ratio))), ",").cast("array<double>")  # folded to one literal
    total = F.aggregate(F.col(g), F.lit(0.0), lambda a, x: a + F.get(table, F.pmod(x, F.lit(len(ratio))).cast("int")))
    return (grams(df, text_col, g)
            .withColumn(name, F.when(F.size(g) > 0, F.round(total / F.size(g), 9)).otherwise(0.0)).drop(g))


def labelled_sample(docs: DataFrame, labels: DataFrame, *, per_class: int, id_col: str = "doc_id",
                    text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``text, label`` of at most ``per_class`` labelled documents a class,
    those whose ids have the smallest hashes. The ids are few by that bound, so
    they are broadcast and the texts are not moved."""
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    one = lab.groupBy("id").agg(F.min("label").alias("label"))  # a document labelled twice counts by its lower label
    picked = None
    for c in (0, 1):
        part = smallest_hashes(one.where(F.col("label") == c), per_class)
        picked = part if picked is None else picked.unionByName(part)
    return (docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
            .join(F.broadcast(picked), "id").groupBy("id", "label").agg(F.min("text").alias("text")).select("text", "label"))


def fit_threshold(good: list[float], bad: list[float], floor: float = -1.0, weight: float = 4.0) -> float:
    """The cut with the least cost: the share of rejected trusted documents,
    ``weight`` times, and the share of others kept (of equal cuts the lowest).
    It is lowered by a third of the gap below it, or of the trusted scores'
    spread; a few wrong labels move neither the cut nor the gap far. Without
    others, the lowest hundredth of the trusted scores is the cut; ``floor``
    without trusted ones."""
    if not good:
        return floor
    good = sorted(good)
    middle = good[len(good) // 2]
    if not bad:
        low = good[len(good) // 100]
        return low - 0.5 * (middle - low)
    # walk up the scores: what lies below a cut is rejected
    cost = best = 1.0
    low, under = min(good[0], *bad), None
    last = None
    every = sorted([(x, 0) for x in bad] + [(x, 1) for x in good])
    for x, trusted in every:
        if x != last and cost < best - 1e-12:
            best, low, under = cost, x, last
        cost += weight / len(good) if trusted else -1 / len(bad)
        last = x
    margin = (low - under) / 3 if under is not None else 0.0
    return low - max(margin, 0.1 * max(0.0, middle - low))


def rate(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
         buckets: int = 8192, per_class: int = 5_000, threshold: float | None = None,
         min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """``docs`` with the base columns of :func:`with_base`, ``llr`` and ``kept``.

    The corpus' counts cover all documents; the trusted ones are those labelled
    1 in a sample of at most ``per_class`` documents a class, which also sets the
    threshold unless it is given. Kept: not failed by the base rules, and
    ``llr`` at or above the threshold.

    Defined cases: a null or empty text has no words, fails the base rules and
    scores 0; without labels the ratio is 0 for all and only the base rules
    count; rows that repeat are rated alike; an empty table gives no rows;
    columns of ``docs`` named like the results are replaced."""
    results = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    d = docs.drop(*results)
    t, = fresh(d, "text")
    sample = save(labelled_sample(docs, labels, per_class=per_class, id_col=id_col, text_col=text_col, label_col=label_col),
                  "quality-sample")
    corpus = counts(docs.select(text_or_empty(text_col).alias("text")), "text", buckets)
    ratio = log_ratio(counts(sample.where("label = 1"), "text", buckets), corpus)
    if threshold is None:
        scored = with_base(with_score(sample, "text", ratio, "llr"), "text", min_words=min_words, max_repeat_percent=max_repeat_percent)
        rows = scored.where("not base_failed").select("label", "llr").collect()  # 2 * per_class at most
        threshold = fit_threshold([r["llr"] for r in rows if r["label"] == 1], [r["llr"] for r in rows if r["label"] == 0])
    d = with_base(d.withColumn(t, text_or_empty(text_col)), t, min_words=min_words, max_repeat_percent=max_repeat_percent)
    return (with_score(d, t, ratio, "llr").drop(t)
            .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(threshold))))
