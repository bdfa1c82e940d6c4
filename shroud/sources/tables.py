"""Readers for the driver tables and for text corpora.

Parquet reads rely on Catalyst for column pruning and filter pushdown: callers
select only what they need and the scan's ReadSchema follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# A directory of text files -> (path, content), one row per file.
DDL_GLOB = "*.{sql,ddl}"
CODE_GLOB = "*.{py,sql,js,ts,scala,java}"


def text_corpus(spark: SparkSession, path: str, glob: str = CODE_GLOB,
                recursive: bool = True) -> DataFrame:
    """Whole-file text source: (path, content). Files are packed into input
    splits by ``spark.sql.files.maxPartitionBytes``; each file is one row."""
    # .text()'s own keyword defaults would override reader options: pass them here
    df = spark.read.text(path, wholetext=True, pathGlobFilter=glob,
                         recursiveFileLookup=recursive)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


# JSON records {filePath, content}
CODE_RECORD_SCHEMA = T.StructType([T.StructField("filePath", T.StringType()),
                                   T.StructField("content", T.StringType())])


def json_records(spark: SparkSession, path: str, schema: T.StructType = CODE_RECORD_SCHEMA) -> DataFrame:
    """JSON-lines records with an explicit schema (no inference pass)."""
    return spark.read.schema(schema).json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON-lines sink, one file per partition."""
    df.write.mode(mode).json(path)


def to_json_column(df: DataFrame, name: str = "json") -> DataFrame:
    """S5 as a column: each row rendered as compact JSON."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias(name))


def schema_catalog(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> DataFrame:
    """(table_name, ordinal, name, data_type, nullable) from table schemas.

    Built from metadata only (a few rows per table), never from table data."""
    rows = []
    for t in names or TABLES:
        for i, f in enumerate(table(spark, sf_dir, t).schema.fields, start=1):
            rows.append((t, i, f.name, f.dataType.simpleString(), f.nullable))
    return spark.createDataFrame(rows, "table_name string, ordinal int, name string, "
                                       "data_type string, nullable boolean")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over ``spark.shroud.inputTasks`` tasks, if that is set.

    A Parquet file of one row group is one task; CPU-heavy text work on a few
    such files wants more. The setting is the user's choice for such inputs and
    is off by default: the plan never depends on sizes or on the cluster."""
    n = df.sparkSession.conf.get("spark.shroud.inputTasks", None)
    return df.repartition(int(n)) if n else df


def deal(df: DataFrame) -> DataFrame:
    """:func:`spread` for small rows with much work each: without the setting,
    over as many tasks as a shuffle has, or as the cluster has cores."""
    spark = df.sparkSession
    n = spark.conf.get("spark.shroud.inputTasks", None)
    return df.repartition(int(n) if n else max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
