"""Readers of the catalogue tables: Parquet, CSV, text lines and JSON lines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ostinato.sources.schemas import COMPOSERS, CORRECTIONS, TAGS, WORKS


def require_columns(df: DataFrame, required: list[str], what: str) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def with_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of ``schema`` in order; absent ones become typed nulls, further ones are kept behind."""
    declared = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ]
    extra = [F.col(c) for c in df.columns if c not in schema.fieldNames()]
    return df.select(*declared, *extra)


def _scan(spark: SparkSession, path: str, schema: StructType, required: list[str], what: str) -> DataFrame:
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"{what} not found: {path}") from e
        raise
    return with_schema(require_columns(df, required, what), schema)


def scan_works(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, WORKS, ["work_id", "title"], "works table")


def scan_composers(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, COMPOSERS, ["composer_id", "name"], "composers table")


def scan_tags(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, TAGS, ["work_id", "tag"], "tags table")


def scan_csv(spark: SparkSession, path: str, schema: StructType, missing_ok: bool = False, multi_line: bool = False) -> DataFrame:
    """CSV with a header, read by column name; an absent optional file is an empty typed frame.

    Array columns are JSON text in the file.  Files are split among tasks unless ``multi_line`` says that values hold line breaks;
    then a file is one task.
    """
    try:
        raw = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        if not missing_ok:
            raise FileNotFoundError(f"no CSV at {path}") from e
        return spark.createDataFrame([], schema)
    cols = []
    for f in schema:
        if f.name not in raw.columns:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif f.dataType.typeName() == "array":
            cols.append(F.from_json(f.name, f.dataType).alias(f.name))
        else:
            cols.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
    return raw.select(*cols)


def scan_names(spark: SparkSession, path: str) -> DataFrame:
    """Text lines, trimmed, without blank ones."""
    return spark.read.text(path).select(F.trim("value").alias("name")).filter("name <> ''")


def scan_corrections(spark: SparkSession, path: str) -> DataFrame:
    """Correction log in JSON lines; blank lines are skipped by the reader, absent arrays are empty."""
    df = spark.read.schema(CORRECTIONS).json(path)
    empty = F.array().cast("array<string>")
    return df.withColumns({c: F.coalesce(c, empty) for c in ("auto_tags", "corrected_tags", "removed", "added")})
