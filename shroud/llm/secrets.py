"""Secrets: fixed base patterns, then character Markov models.

A run of token characters is scored by the mean, over its character pairs, of
the log-likelihood ratio between a Markov model of random strings and one of
ordinary words and identifiers, both counted from labelled samples. Everything
is DataFrame expressions; match positions come from the lengths of the matches
and of the texts between them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, held, save, smallest_hashes, text_or_empty

#: Base kinds (fixed values): pattern of the whole match; a shorter match fails.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Runs that the models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
KINDS = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("random", CANDIDATE))
#: Signs that join words: parts between them are judged too, if they are as long as a run.
JOINTS, LEAST = "[+/_=-]", 16
BLOCK = 128


def _positions(df: DataFrame, text: str, out: dict[str, str]) -> DataFrame:
    """Adds for each kind ``out[kind]``: array of struct(m, s, e) of its matches
    (text, start and end in code points), leftmost and non-overlapping.

    The start of match i is the sum of the lengths of the i + 1 texts before it
    and the i matches before it; sums run over blocks, so a text of very many
    matches does not take their square. A text without a match has its arrays
    empty after one pass of the pattern."""
    c = F.col(text)
    names = {k: fresh(df, f"m_{k}", f"u_{k}", f"b_{k}", f"p_{k}") for k, _ in KINDS}
    empty = F.array().cast("array<int>")
    d = df.withColumns({names[k][0]: held(F.when(c.rlike(r), F.regexp_extract_all(c, F.lit(r), F.lit(0)))
                                          .otherwise(F.array().cast("array<string>"))) for k, r in KINDS})
    gaps = {k: held(F.when(F.size(names[k][0]) > 0, F.transform(F.split(c, r, -1), F.length)).otherwise(empty)) for k, r in KINDS}
    d = d.withColumns({names[k][1]: g for k, g in gaps.items()})

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def steps(m: str, u: str) -> Column:
        """Each match's start minus the one before: the text between plus the match before."""
        return F.transform(F.slice(F.col(u), F.lit(1), F.size(m)), lambda g, i: g + F.when(i > 0, F.length(F.get(F.col(m), i - 1))).otherwise(0))

    def blocks(u: str) -> Column:
        last = F.floor((F.size(u) - 1) / F.lit(BLOCK)).cast("int")
        return F.when(F.size(u) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: total(
            F.slice(F.col(u), b * BLOCK + 1, F.lit(BLOCK))))).otherwise(empty)

    def before(b: str) -> Column:
        return F.transform(F.col(b), lambda x, i: total(F.slice(F.col(b), F.lit(1), i)))

    d = d.withColumns({u: held(steps(m, u)) for m, u, _, _ in names.values()})
    d = d.withColumns({b: held(blocks(u)) for _, u, b, _ in names.values()})
    d = d.withColumns({p: held(before(b)) for _, _, b, p in names.values()})

    def spans(k):
        m, u, _, p = (F.col(x) for x in names[k])

        def one(x, i):
            b = F.floor(i / F.lit(BLOCK)).cast("int")
            start = F.get(p, b) + total(F.slice(u, b * BLOCK + 1, i - b * BLOCK + 1))
            return F.struct(x.alias("m"), start.alias("s"))

        placed = F.transform(m, one)
        return F.transform(placed, lambda x: F.struct(x["m"].alias("m"), x["s"].alias("s"), (x["s"] + F.length(x["m"])).alias("e")))

    d = d.withColumns({out[k]: held(spans(k)) for k, _ in KINDS})
    return d.drop(*[n for v in names.values() for n in v])


def _value(match: Column) -> Column:
    """Group 2 of the contract's assign pattern: what is assigned."""
    return F.regexp_extract(match, "^" + ASSIGN, 1)


def with_matches(df: DataFrame, text: str, out: dict[str, str], min_value: int = 6) -> DataFrame:
    """The arrays of :func:`_positions`; assignments of short values dropped."""
    d = _positions(df, text, out)
    return d.withColumn(out["assign"], held(F.filter(F.col(out["assign"]), lambda x: F.length(_value(x["m"])) >= min_value)))


# ------------------------------------------------------------------ models
def _pair_counts(strings: DataFrame) -> list[list[int]]:
    """Counts of ASCII character pairs in the rows of ``s`` (128 * 128 at most
    come back)."""
    codes = held(F.transform(F.split("s", ""), lambda c: F.ascii(c)))
    pairs = (strings.select(codes.alias("c")).where(F.size("c") >= 2)
             .select(held(F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.get(F.col("c"), i) * 128 + F.get(F.col("c"), i + 1))).alias("p"))
             .select(F.explode("p").alias("p")).where("p < 16384").groupBy("p").count())
    out = [[0] * 128 for _ in range(128)]
    for r in pairs.collect():
        out[r["p"] // 128][r["p"] % 128] = r["count"]
    return out


def fit(secrets: DataFrame, ordinary: DataFrame, *, uniform: float = 0.3, weight: float = 20.0) -> list[float]:
    """Log-likelihood ratio of each character pair (first * 128 + second), from
    labelled strings (column ``s``).

    Each row of a model is its counts with ``weight`` counts of a prior: the
    characters' frequencies in the sample, of which the share ``uniform`` is
    spread over letters, digits and ``+/_=-``. Pairs with one of those signs
    count as 0."""
    alphabet = [c for c in range(128) if chr(c).isalnum() or chr(c) in "+/_=-"]

    def rows(counts, mixed):
        second = [sum(r[c] for r in counts) for c in range(128)]
        total = sum(second)
        prior = [(1 - mixed) * (second[c] / total if total else 1 / len(alphabet)) + mixed / len(alphabet) if c in alphabet
                 else 1e-6 for c in range(128)]
        return [[(counts[a][b] + weight * prior[b]) / (sum(counts[a]) + weight) for b in range(128)] for a in range(128)]

    random, plain = rows(_pair_counts(secrets), max(uniform, 0.5)), rows(_pair_counts(ordinary), 0.02)
    joints = {ord(c) for c in "+/_=-"}  # they join words of either sort and tell nothing
    return [0.0 if joints & {a, b} else round(math.log(random[a][b] / plain[a][b]), 6) for a in range(128) for b in range(128)]


def mean_ratio(match: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of the string's character pairs."""
    codes = F.array(F.transform(F.split(match, ""), lambda c: F.least(F.ascii(c), F.lit(127))))  # bound once, then indexed
    return F.get(F.transform(codes, lambda c: F.aggregate(
        F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0),
        lambda a, i: a + F.get(table, F.get(c, i - 1) * 128 + F.get(c, i))) / (F.size(c) - 1)), F.lit(0))


def _judged(run: Column, table: Column, threshold: float) -> Column:
    """What the models find in a run struct(m, s, e): the run, or else those of
    its parts between joining signs that are long enough."""
    def high(x: Column) -> Column:  # without a letter it is a number
        return x.rlike("[A-Za-z]") & (mean_ratio(x, table) >= F.lit(threshold))

    parts = F.split(run["m"], JOINTS, -1)
    # a part begins behind the parts before it and a sign for each
    placed = F.aggregate(parts, F.struct(run["s"].alias("s"), F.array().cast("array<struct<m:string,s:int,e:int>>").alias("out")), lambda a, p: F.struct(
        (a["s"] + F.length(p) + 1).alias("s"),
        F.when(F.length(p) >= LEAST, F.array_append(a["out"], F.struct(p.alias("m"), a["s"].alias("s"), (a["s"] + F.length(p)).alias("e")))).otherwise(a["out"]).alias("out")))["out"]
    return F.when(high(run["m"]), F.array(run)).when(run["m"].rlike(JOINTS) & run["m"].rlike(f"[A-Za-z0-9]{{{LEAST},}}"), F.filter(placed, lambda x: high(x["m"]))).otherwise(
        F.array().cast("array<struct<m:string,s:int,e:int>>"))


def training_sample(docs: DataFrame, labels: DataFrame, *, limit: int, id_col: str, text_col: str) -> DataFrame:
    """Texts of at most ``limit`` labelled documents (smallest hashes of the
    ids; the ids are broadcast, few by that bound)."""
    ids = smallest_hashes(labels.select(F.col(id_col).alias("id")).where("id is not null").distinct(), limit)
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text")).select("text")


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 20_000) -> list[float]:
    """The models of :func:`fit` from labelled documents: what the base kinds
    match in them are secrets, their other words of three or more characters
    are ordinary."""
    sample = save(training_sample(docs, labels, limit=limit, id_col=id_col, text_col=text_col), "secret-sample")
    out = {k: f"__{k}" for k, _ in KINDS}
    marked = save(with_matches(sample, "text", out).select(
        F.concat(F.transform(out["assign"], lambda x: _value(x["m"])), F.transform(out["access"], lambda x: x["m"]),
                 F.transform(out["hex"], lambda x: x["m"])).alias("secrets"),
        F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ").alias("rest")), "secret-marked")
    words = held(F.regexp_extract_all("rest", F.lit(r"[A-Za-z0-9_]{3,}"), F.lit(0)))
    ordinary = marked.select(words.alias("w")).select(F.explode("w").alias("s")).where(~F.col("s").rlike("^[0-9]+$"))
    return fit(marked.select(held(F.col("secrets")).alias("x")).select(F.explode("x").alias("s")), ordinary)


def find_secrets(docs: DataFrame, ratio: list[float], *, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``secrets``: array of struct(kind, start, end, match) in
    order of start, then kind (assign, access, hex, random); code points, end
    exclusive.

    The base kinds are matched in the whole text and always stay. A run of 16 or
    more token characters with a letter is added as ``random`` if its mean ratio is at least
    ``threshold`` and no base span overlaps it; where the whole run scores less,
    its parts of 16 or more characters between joining signs are judged alone
    (a key inside a path).

    Defined cases: a null or empty text has no spans; very long texts are
    matched whole; equal rows get equal spans; an empty table gives no rows; a
    column of ``docs`` named ``secrets`` is replaced."""
    d = docs.drop("secrets")
    t, *names = fresh(d, "text", *[f"x_{k}" for k, _ in KINDS])
    out = dict(zip([k for k, _ in KINDS], names, strict=True))
    d = with_matches(d.withColumn(t, text_or_empty(text_col)), t, out)
    table = F.split(F.lit(",".join(map(repr, ratio))), ",").cast("array<double>")  # folded to one literal
    found = F.flatten(F.transform(F.col(out["random"]), lambda x: _judged(x, table, threshold)))
    d = d.withColumn(out["random"], held(found))
    base, = fresh(d, "base")
    d = d.withColumn(base, held(F.concat(*[F.col(out[k]) for k in ("assign", "access", "hex")])))
    d = d.withColumn(out["random"], held(F.filter(F.col(out["random"]), lambda x: ~F.exists(
        F.col(base), lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"])))))

    def ranked(rank: int, kind: str) -> Column:
        return F.transform(out[kind], lambda x: F.struct(x["s"].alias("start"), F.lit(rank).alias("rank"), x["e"].alias("end"),
                                                         F.lit(kind).alias("kind"), x["m"].alias("match")))

    every = F.concat(*[ranked(r, k) for r, (k, _) in enumerate(KINDS)])
    return d.withColumn("secrets", held(F.transform(F.sort_array(every), lambda x: F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"))))).drop(t, base, *names)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
