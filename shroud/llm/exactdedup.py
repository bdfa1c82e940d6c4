"""Exact duplicates by content-defined chunk recipes.

A text is cut at content-defined borders; each chunk gets an identifier, its
digest. Distinct (digest, chunk) pairs are compared as bytes, so an identifier
that stands for two contents is found and replaced by the content itself. Texts
are then equal when their ordered lists of identifiers are: the comparison
moves 32 bytes a chunk, and of the texts only one copy of each distinct chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, held, save, text_or_empty

#: A chunk ends at the first sentence or line end after 512 characters, the text's end, or after 4,096 characters.
CHUNK = r"(?s)(?:.{512,4095}?(?:(?<=[\n.!?])|\z)|.{1,4096})"


def sha256_bytes(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def chunks_of(text: Column, pattern: str = CHUNK) -> Column:
    """array<string> whose concatenation is ``text``."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def unverified(chunks: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Digests (``digest``) that stand for more than one content among the rows
    of ``chunk``. Copies of a chunk meet before the shuffle, in each task."""
    return (chunks.select("chunk", digest(F.col("chunk")).alias("digest")).distinct()
            .groupBy("digest").count().where("count > 1").select("digest"))


def with_recipes(docs: DataFrame, text: Column, name: str, *, pattern: str = CHUNK,
                 digest: Callable[[Column], Column] = sha256_bytes, max_listed: int = 10_000) -> DataFrame:
    """``docs`` with ``name``: the ordered list of its chunks' verified
    identifiers (array<binary>). Verifies all chunks of the table first."""
    cut = chunks_of(text, pattern)
    broken = [r[0] for r in unverified(docs.select(held(cut).alias("cut")).select(F.explode("cut").alias("chunk")), digest).limit(max_listed + 1).collect()]
    if not broken:
        return docs.withColumn(name, held(F.transform(cut, digest)))
    if len(broken) > max_listed:  # a digest this weak identifies nothing: the contents stand for themselves
        return docs.withColumn(name, held(F.transform(cut, lambda c: c.cast("binary"))))
    bad = F.array(*[F.lit(bytes(b)) for b in broken])
    pairs = F.transform(cut, lambda c: F.struct(digest(c).alias("d"), c.alias("c")))
    return docs.withColumn(name, held(F.transform(pairs, lambda p: F.when(
        F.array_contains(bad, p["d"]), F.concat(p["d"], p["c"].cast("binary"))).otherwise(p["d"]))))


def dedup_exact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "max",
                pattern: str = CHUNK, digest: Callable[[Column], Column] = sha256_bytes) -> DataFrame:
    """``docs`` with ``keep_id`` (the id that stays of equal texts: the
    largest, or the smallest with ``keep='min'``), ``group_size`` (rows),
    ``kept`` and ``text_sha256``.

    Groups come from an aggregation over recipes that combines before its
    shuffle; they go back by an equi-join on the recipe, whose large side Spark
    may split, so a group that holds a third of all rows is no task's alone.
    Columns that a caller does not use afterwards are not moved.

    Defined cases: a null text counts as empty, and all empty texts are equal; a
    null id is smaller than any other (``keep_id`` is null only where all are);
    rows that repeat both id and text are all kept or all dropped
    (:func:`drop_copies` leaves one); an empty table gives no rows; columns of
    ``docs`` named like the results are replaced."""
    text = text_or_empty(text_col)
    d = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    recipe, other, chosen, size = fresh(d, "recipe", "other", "chosen", "size")
    d = with_recipes(d, text, recipe, pattern=pattern, digest=digest).withColumn("text_sha256", F.sha2(text, 256))
    best = {"max": F.max, "min": F.min}[keep](F.col(id_col))
    groups = (d.groupBy(F.col(recipe).alias(other)).agg(best.alias(chosen), F.count(F.lit(1)).alias(size))
              .where(F.col(size) > 1))
    # written first: as it is, the aggregate's partitioning would serve the join too and keep a large group in one task
    groups = save(groups, "exact-groups")
    j = d.join(groups, d[recipe] == groups[other], "left")
    alone = F.col(size).isNull()
    return (j.withColumns({"keep_id": F.when(alone, F.col(id_col)).otherwise(F.col(chosen)),
                           "group_size": F.coalesce(size, F.lit(1)).cast("long"),
                           "kept": alone | F.col(id_col).eqNullSafe(F.col(chosen))}).drop(recipe, other, chosen, size))


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that :func:`dedup_exact` keeps, and of rows that
    repeat both id and text one (any of them), with the columns of ``docs``.

    Only ids, digests and recipes are grouped and joined; the documents
    themselves are read again and looked up by (id, digest)."""
    key, gone, n = fresh(docs, "key", "gone", "n")
    d = dedup_exact(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, keep=keep)
    # of equal texts, (id, digest) names a row, or rows that repeat
    named = d.where("group_size > 1").groupBy(F.struct(F.col(id_col).alias("i"), F.col("text_sha256").alias("t")).alias(gone)).agg(
        F.max("kept").alias("kept"), F.count(F.lit(1)).alias(n))
    named = save(named.where((~F.col("kept")) | (F.col(n) > 1)), "exact-gone")
    keyed = docs.withColumn(key, F.struct(F.col(id_col).alias("i"), F.sha2(text_or_empty(text_col), 256).alias("t")))
    left = keyed.join(named.select(gone), keyed[key].eqNullSafe(F.col(gone)), "left_anti")
    repeats = named.where("kept").select(gone)
    one = keyed.join(repeats, keyed[key].eqNullSafe(F.col(gone)), "left_semi").dropDuplicates([key])
    return left.unionByName(one).select(*[docs[c] for c in docs.columns])
