"""Writers: Parquet, CSV, JSON lines, reports, versioned artefacts."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as ``folder/<name>.parquet``; an empty table keeps its schema."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, the only form CSV can hold."""
    nested = (ArrayType, MapType, StructType)
    return df.select(*[
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema
    ])


def write_csv(df: DataFrame, path: str) -> None:
    flat_for_csv(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def parquet_folder_to_csv(spark: SparkSession, tables: list[str], folder: str, out: str) -> dict[str, str]:
    """Convert ``folder/<table>.parquet`` to ``out/<table>.csv``; a bad table does not stop the rest.

    Returns the outcome per table: ``ok`` or the error text.
    """
    outcome = {}
    for name in tables:
        try:
            write_csv(spark.read.parquet(f"{folder}/{name}.parquet"), f"{out}/{name}.csv")
            outcome[name] = "ok"
        except Exception as e:  # noqa: BLE001 - every failure is reported, none is fatal
            outcome[name] = str(e).splitlines()[0]
    return outcome


def tag_table_summary(tags: DataFrame) -> DataFrame:
    """Long summary ``(measure, source, n)``: rows, distinct works, distinct tags, rows per source."""
    totals = tags.agg(
        F.count("*").alias("rows"), F.count_distinct("work_id").alias("works"), F.count_distinct("tag").alias("tags")
    )
    none = F.lit(None).cast("string")
    out = totals.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), none.alias("source"), F.col(m).alias("n")) for m in ("rows", "works", "tags")
    ])).alias("r")).select("r.*")
    if "source" in tags.columns:
        per = tags.groupBy("source").agg(F.count("*").alias("n"))
        out = out.unionByName(per.select(F.lit("source").alias("measure"), "source", "n"))
    return out


def csv_to_parquet(df: DataFrame, path: str) -> DataFrame:
    """Write tags to Parquet and summarise what was read back."""
    df.write.mode("overwrite").parquet(path)
    return tag_table_summary(df.sparkSession.read.schema(df.schema).parquet(path))


def export_tags(tags: DataFrame, path: str, format: str = "csv") -> DataFrame:
    """Export as ``csv`` or ``jsonl`` and return the coverage summary."""
    if format == "csv":
        write_csv(tags, path)
    elif format == "jsonl":
        tags.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unsupported format: {format}")
    return export_summary(tags)


def export_summary(tags: DataFrame) -> DataFrame:
    return tags.agg(
        F.count("*").alias("associations"),
        F.count_distinct("work_id").alias("works"),
        F.round(F.count("*") / F.nullif(F.count_distinct("work_id"), F.lit(0)), 1).alias("avg_tags_per_work"),
    )


def flat_corrections(corrections: DataFrame) -> DataFrame:
    return corrections.select(
        "work_id", "title", "composer_id", "work_type",
        F.array_join("removed", ", ").alias("removed_tags"),
        F.array_join("added", ", ").alias("added_tags"),
        "reason", "reviewer", "timestamp",
    )


def export_corrections(corrections: DataFrame, path: str) -> None:
    write_csv(flat_corrections(corrections), path)


def append_corrections(corrections: DataFrame, path: str) -> None:
    corrections.write.mode("append").json(path)


def write_report(metrics: DataFrame, path: str, input_dir: str, output_dir: str, artists: list[str] | None = None) -> None:
    """One-row nested metrics as a JSON report with time and folders."""
    now = datetime.now(timezone.utc).isoformat()
    cols = [F.lit(now).alias("timestamp"), F.lit(input_dir).alias("input_dir"), F.lit(output_dir).alias("output_dir"),
            (F.array(*map(F.lit, artists)) if artists else F.lit(None).cast("array<string>")).alias("artists"),
            F.struct("*").alias("metrics")]
    text = metrics.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))
    text.coalesce(1).write.mode("overwrite").text(path)


# --- versioned artefacts -----------------------------------------------------------------------

def content_stamp(df: DataFrame, *cols: str) -> DataFrame:
    """Row count and an order-free content hash of the given columns."""
    h = F.xxhash64(*(cols or df.columns))
    return df.agg(
        F.count("*").alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("hash_xor"),
        F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"),
    )


def load_or_build(
    spark: SparkSession, folder: str, version: str, source: DataFrame, build, force_rebuild: bool = False, write=None
) -> tuple[DataFrame, bool]:
    """Reuse the artefact in ``folder`` when version, row count and content hash agree, else build it.

    Returns the frame and whether it was reused; ``write(frame, path)`` sets the layout.  A data folder is never overwritten: each build has
    its own, and the metadata table names the current one.
    """
    stamp = content_stamp(source).first()
    if not force_rebuild:
        try:
            metas = spark.read.parquet(f"{folder}/metadata")
            meta = metas.orderBy(F.desc("created_at")).first()
        except AnalysisException:
            meta = None
        if meta and (meta["version"], meta["rows"], meta["hash_xor"], meta["hash_sum"]) == (
                version, stamp["rows"], stamp["hash_xor"], stamp["hash_sum"]):
            return spark.read.parquet(meta["data"]), True
    data = f"{folder}/data-{uuid.uuid4().hex}"
    (write or (lambda df, path: df.write.parquet(path)))(build(source), data)
    row = (version, stamp["rows"], stamp["hash_xor"], stamp["hash_sum"], data, datetime.now(timezone.utc))
    spark.createDataFrame(
        [row], "version string, rows bigint, hash_xor bigint, hash_sum string, data string, created_at timestamp"
    ).coalesce(1).write.mode("append").parquet(f"{folder}/metadata")
    return spark.read.parquet(data), False


def repair_table(spark: SparkSession, path: str, repaired: DataFrame) -> str:
    """Replace the table at ``path`` by ``repaired`` (which may read from it); returns the backup path.

    The repaired rows are written to a side folder first, so no path is overwritten while it is read.
    """
    tag = uuid.uuid4().hex[:12]
    backup, staged = f"{path}_backup_{tag}", f"{path}_staged_{tag}"
    spark.read.parquet(path).write.parquet(backup)
    repaired.write.parquet(staged)
    spark.read.schema(repaired.schema).parquet(staged).write.mode("overwrite").parquet(path)
    return backup
