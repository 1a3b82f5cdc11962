"""End-to-end conforming job: documents to tables, quality report, Parquet and CSV."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ostinato.operators import conform, quality
from ostinato.session import cut
from ostinato.sources import documents, sinks


@dataclass
class EtlResult:
    tables: dict[str, DataFrame]
    metrics: DataFrame
    errors: list[str]

    @property
    def status(self) -> int:
        """1 when the quality check found errors."""
        return 1 if self.errors else 0


def conform_documents(docs: DataFrame) -> dict[str, DataFrame]:
    """The three tables of a documents frame; exploded works are stored once, three tables read them."""
    raw = cut(documents.works_of(docs), "raw-works")
    works = cut(conform.conform_works(raw), "works")
    return {
        "composers": conform.conform_composers(documents.artists_of(docs), works),
        "works": works,
        "work_tags": conform.conform_tags(raw),
    }


def run_etl(spark: SparkSession, input_dir: str, output_dir: str, names: list[str] | None = None, csv: bool = True, **scan) -> EtlResult:
    docs = documents.scan_documents(spark, input_dir, names, **scan)
    tables = conform_documents(docs)
    sinks.write_tables(tables, output_dir)
    stored = {n: spark.read.schema(df.schema).parquet(f"{output_dir}/{n}.parquet") for n, df in tables.items()}
    metrics = cut(quality.profile_all(stored["composers"], stored["works"]), "metrics")
    sinks.write_report(metrics, f"{output_dir}/quality_report.json", input_dir, output_dir, names)
    if csv:
        sinks.parquet_folder_to_csv(spark, list(tables), output_dir, output_dir)
    return EtlResult(stored, metrics, metrics.first()["errors"])
