"""ZIP archives of CSV files, and the Parquet table that is made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import schemas, zip_source

#: Where a row stands in its source; see builder.ORDINAL.
ORDINAL = "__ordinal"


def rows_of(told: DataFrame, dataset: str) -> DataFrame:
    """The rows among all that the source tells, under declared types (a value that doesn't fit is null), with _member and their place in the source.

    A book ticker without a symbol has the one that its archive's name begins with.
    """
    known = schemas.known_schema(dataset)
    names = [c for c in told.columns if c not in dict(zip_source.PLACE)]
    rows = told.where("_kind = 'row'")
    made = rows.select(*[F.col("`" + n.replace("`", "``") + "`") for n in names], F.concat_ws("!", "_path", "_member").alias("_member"), F.struct("_path", F.col("_member").alias("member"), "_line").alias(ORDINAL))
    if dataset == "bookTicker" and "symbol" not in names:
        made = made.withColumn("symbol", schemas.symbol_of_file(F.col(f"{ORDINAL}._path")))
    return schemas.conform(made, known) if known else made


def read_archives(spark: SparkSession, paths: Sequence[str], dataset: str, first_member_only: bool = False) -> DataFrame:
    """Rows of all archives under the declared schema, or under the names of all headers as texts; with _member and __ordinal.

    Each member is decoded by its own header, in one pass. Archives without any CSV raise.
    """
    if not any(member for _, member, _ in zip_source.members(paths, first_member_only)):
        raise ValueError(f"no CSV in {list(paths)}")
    return rows_of(zip_source.read(spark, paths, dataset, first_member_only), dataset)


def bad_archives(spark: SparkSession, paths: Sequence[str], dataset: str = "") -> DataFrame:
    """(path, error) of the archives and members that can't be read, or not to their ends."""
    return zip_source.read(spark, paths, dataset).where("_kind = 'error'").select(F.col("_path").alias("path"), F.col("_note").alias("error"))


def manifest_of(told: DataFrame) -> DataFrame:
    """(path, member, rows, bytes, digest, note, error) from what the source tells: one row a member, and one for each archive that can't be read."""
    ends = told.where("_kind IN ('member', 'error')")
    return ends.select(
        F.col("_path").alias("path"), F.col("_member").alias("member"), F.col("_rows").alias("rows"), F.col("_bytes").alias("bytes"), F.col("_digest").alias("digest"),
        F.when(F.col("_kind") == "member", F.col("_note")).alias("note"), F.when(F.col("_kind") == "error", F.col("_note")).alias("error"),
    )


def member_manifest(rows: DataFrame, id_column: str | None = None) -> DataFrame:
    """(member, rows, distinct ids) of what was read."""
    more = [F.count_distinct(id_column).alias("ids")] if id_column else []
    return rows.groupBy(F.col("_member").alias("member")).agg(F.count(F.lit(1)).alias("rows"), *more)


def file_hashes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, size, sha256) of whole files."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


# The table that archives are kept in

PARTITIONS = ("market", "dataset_type", "symbol", "interval", "cadence", "date")


def write_cache(df: DataFrame, root: str, **partition: str) -> None:
    """Adds rows to the cache; a date is written again whole."""
    made = df.withColumns({k: F.lit(partition[k]) for k in PARTITIONS if k in partition})
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(root)


def scan_cache(spark: SparkSession, root: str, columns: Sequence[str] | None = None, dates: tuple[str, str] | None = None, **partition: str) -> DataFrame:
    """Lazy scan; the filters fall on partition columns, so other dates aren't listed or read."""
    df = spark.read.option("mergeSchema", "true").parquet(root)
    for k, v in partition.items():
        df = df.where(F.col(k) == v)
    if dates:
        df = df.where(F.col("date").cast("string").between(*dates))
    return df.select(*[c for c in columns if c in df.columns]) if columns else df.drop(*PARTITIONS)
