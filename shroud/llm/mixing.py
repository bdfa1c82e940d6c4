"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (every combination of the margins' values) are raked
to one target share per source, language and topic; documents are then sampled
with probabilities calibrated to the cells' weights and a token budget.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, save, text_or_empty


@dataclass(frozen=True)
class Margin:
    """Target shares of one column's values: in proportion to their tokens to
    the power ``exponent`` (1 keeps the mix, 0 makes all values equal), with
    ``shares`` for values whose share is given (the others divide the rest)."""

    column: str
    exponent: float = 1.0
    shares: tuple[tuple[str, float], ...] = ()

    def targets(self, totals: dict) -> dict:
        given = {v: s for v, s in self.shares if v in totals and totals[v] > 0}
        if (held := sum(given.values())) > 1:
            raise ValueError(f"shares of {self.column} exceed 1")
        rest = {v: t ** self.exponent for v, t in totals.items() if v not in given and t > 0}
        whole = sum(rest.values())
        scale = (1 - held) / whole if rest else 0.0
        if not rest and given:  # the given shares alone: made to add up to 1
            given = {v: s / held for v, s in given.items()}
        return given | {v: w * scale for v, w in rest.items()}


def rake(cells: list[tuple[tuple, float]], margins: list[Margin], rounds: int) -> list[float]:
    """Share of each cell after ``rounds`` rounds over the margins. ``cells``
    holds (values, tokens); cells without tokens get 0."""
    total = sum(t for _, t in cells)
    weight = [t / total if total else 0.0 for _, t in cells]
    targets = []
    for k, m in enumerate(margins):
        totals: dict = {}
        for values, t in cells:
            totals[values[k]] = totals.get(values[k], 0) + t
        targets.append(m.targets(totals))
    for _ in range(rounds):
        for k in range(len(margins)):
            held: dict = {}
            for (values, _), w in zip(cells, weight, strict=True):
                held[values[k]] = held.get(values[k], 0.0) + w
            weight = [w * targets[k][values[k]] / held[values[k]] if held[values[k]] else 0.0
                      for (values, _), w in zip(cells, weight, strict=True)]
    return weight


def calibrate(tokens: list[float], weight: list[float], keep: float) -> list[float]:
    """Probability of each cell: min(1, factor * weight / tokens), with the
    factor that keeps the share ``keep`` of all tokens on average. Cells
    without tokens are kept whole (they add none)."""
    ratio = [w / t if t else 0.0 for t, w in zip(tokens, weight, strict=True)]
    order = sorted((i for i, t in enumerate(tokens) if t and ratio[i] > 0), key=lambda i: -ratio[i])
    budget, rest = keep * sum(tokens), sum(weight[i] for i in order)
    factor = 0.0
    for i in order:  # cells in falling ratio are full until the factor leaves the next one below 1
        factor = budget / rest if rest > 0 else 0.0
        if factor * ratio[i] <= 1:
            break
        budget -= tokens[i]
        rest -= weight[i]
        if budget <= 0:
            break
    else:
        factor = float("inf")
    return [1.0 if not t else min(1.0, factor * r) if r > 0 else 0.0 for t, r in zip(tokens, ratio, strict=True)]


def _rake_by_joins(cells: DataFrame, margins: list[Margin], rounds: int, keep: float) -> DataFrame:
    """The same for cell tables of any size: every step is an aggregation by one
    margin and a join back, saved once a round."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    c = cells.withColumn("weight", F.col("tokens") / F.lit(float(total or 1)))
    targets = []
    for m in margins:
        t = cells.groupBy(F.col(m.column).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0")
        given = dict(m.shares)
        share = F.lit(None).cast("double")
        for v, s in given.items():
            share = F.when(F.col("value").eqNullSafe(F.lit(v)), F.lit(float(s))).otherwise(share)
        t = t.withColumn("given", share).withColumn("w", F.when(F.col("given").isNull(), F.pow(F.col("t").cast("double"), F.lit(m.exponent))))
        whole, held = t.agg(F.sum("w"), F.coalesce(F.sum("given"), F.lit(0.0))).first()
        if held > 1:
            raise ValueError(f"shares of {m.column} exceed 1")
        goal = F.coalesce(F.col("given") / F.lit(held if not whole and held else 1.0), F.col("w") * F.lit((1 - held) / whole if whole else 0.0))
        targets.append(save(t.select("value", goal.alias("goal")), "rake-targets"))
    for _ in range(rounds):
        for m, t in zip(margins, targets, strict=True):
            held = c.groupBy(F.col(m.column).alias("value")).agg(F.sum("weight").alias("held"))
            factor = held.join(t, held["value"].eqNullSafe(t["value"])).select(
                held["value"].alias("value"), F.when(F.col("held") > 0, F.col("goal") / F.col("held")).otherwise(0.0).alias("factor"))
            c = (c.join(factor, c[m.column].eqNullSafe(factor["value"]), "left")
                 .withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(0.0))).drop("value", "factor"))
        c = save(c, "rake-round")
    c = c.withColumn("ratio", F.when((F.col("tokens") > 0) & (F.col("weight") > 0), F.col("weight") / F.col("tokens")))
    # the factor, by bisection over one aggregate a step
    want, low, high = keep * total, 0.0, None
    top = c.agg(F.min("ratio")).first()[0]
    if top:
        high = 1.0 / top
        for _ in range(60):
            mid = (low + high) / 2
            got = c.agg(F.sum(F.least(F.lit(1.0), F.col("ratio") * F.lit(mid)) * F.col("tokens"))).first()[0] or 0.0
            low, high = (mid, high) if got < want else (low, mid)
    return c.withColumn("probability", F.when(F.col("tokens") == 0, 1.0).otherwise(
        F.coalesce(F.least(F.lit(1.0), F.col("ratio") * F.lit(high or 0.0)), F.lit(0.0)))).drop("ratio")


def uniform(seed: str, *cols: str) -> Column:
    """A number in [0, 1) from the values alone: the same row, the same draw."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def topic_of(text: Column, topics: list[tuple[str, str]], default: str = "general") -> Column:
    """The first topic whose pattern the text holds, else ``default``."""
    out = F.lit(default)
    for name, pattern in reversed(topics):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def mix(docs: DataFrame, margins: list[Margin], *, keep: float, tokens: Column | None = None, id_col: str = "doc_id",
        text_col: str = "text", rounds: int = 20, seed: str = "mix", max_driver_cells: int = 100_000) -> DataFrame:
    """``docs`` with ``n_tokens, cell_weight`` (share of the mix its cell is
    raked to), ``probability`` and ``kept`` (a draw from the id and the seed).

    ``tokens`` gives a document's tokens (default: its words). ``keep`` is the
    share of all tokens to keep on average; a cell that would need more than all
    its documents is kept whole and the others share the rest. Cells are
    aggregated before the shuffle; up to ``max_driver_cells`` of them are raked
    on the driver and broadcast back (the count is checked first), more by joins.

    Defined cases: null sources, languages or topics are a value like any other;
    null or empty texts have no tokens, and a cell without tokens is kept whole;
    rows that repeat an id share its draw; an empty table gives no rows; columns
    of ``docs`` named like the results are replaced."""
    spark = docs.sparkSession
    names = [m.column for m in margins]
    d = docs.drop("n_tokens", "cell_weight", "probability", "kept")
    d = d.withColumn("n_tokens", (word_count(text_or_empty(text_col)) if tokens is None else F.coalesce(tokens, F.lit(0))).cast("long"))
    cells = save(d.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    keys = fresh(d, *[f"k{i}" for i in range(len(names))])
    small = cells.count() <= max_driver_cells
    if small:
        rows = sorted(((tuple(r[n] for n in names), float(r["tokens"])) for r in cells.collect()),
                      key=lambda x: tuple((v is not None, str(v)) for v in x[0]))
        weight = rake(rows, margins, rounds)
        prob = calibrate([t for _, t in rows], weight, keep)
        types = dict(cells.dtypes)
        table = spark.createDataFrame([(*v, w, p) for (v, _), w, p in zip(rows, weight, prob, strict=True)],
                                      ", ".join(f"{k} {types[n]}" for k, n in zip(keys, names, strict=True)) + ", cell_weight double, probability double")
        table = F.broadcast(table)
    else:
        table = _rake_by_joins(cells, margins, rounds, keep).select(
            *[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], F.col("weight").alias("cell_weight"), "probability")
    on = None
    for n, k in zip(names, keys, strict=True):
        one = d[n].eqNullSafe(table[k])
        on = one if on is None else on & one
    return (d.join(table, on, "left").drop(*keys)
            .withColumn("kept", uniform(seed, id_col) < F.coalesce("probability", F.lit(1.0))))
