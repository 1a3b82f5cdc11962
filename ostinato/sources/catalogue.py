"""Derived tables kept for lookups: sorted by key, with Bloom filters, and rebuilt when the files they come from change."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.sources.sinks import load_or_build

#: Bytes of a row group: what a lookup by key reads at most of a file.
ROW_GROUP = 8 << 20
KEYS_A_GROUP = 100_000
#: Rows that ``spread`` gives to a task, about.
ROWS_A_TASK = 50_000
MAX_TASKS = 20_000


def files_of(*tables: DataFrame) -> DataFrame:
    """Path, size and time of the files that the tables are read from; no data is read."""
    parts = [t.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time") for t in tables]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows in ranges of the key, some ``ROWS_A_TASK`` a task, for work that is dear per row: the files they are read from may be few and hold many rows each.

    Rows of one key may span tasks, so a key with very many rows (or none) does not make one task of them.
    """
    tasks = min(MAX_TASKS, df.count() // ROWS_A_TASK + 1)
    return df.repartitionByRange(tasks, key, F.xxhash64(*df.columns))


def write_sorted(df: DataFrame, path: str, key: str) -> None:
    """Sorted partitions in small row groups with a Bloom filter on the key: a lookup skips all groups but one.

    The partitions are ranges of the key already if ``spread`` made them; a range shuffle here would run the frame twice, first for its sample.
    """
    (df.sortWithinPartitions(key).write.option("parquet.block.size", ROW_GROUP)
     .option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", KEYS_A_GROUP).parquet(path))


def kept(spark: SparkSession, folder: str, version: str, sources: list[DataFrame], build: Callable[[], DataFrame], key: str, force_rebuild: bool = False, ranged: bool = False) -> DataFrame:
    """The table in ``folder`` if it was built by the same version from the same files, else ``build()`` stored there.

    ``ranged`` says that the frame built comes in ranges of the key (``spread``).
    """
    def write(df: DataFrame, path: str) -> None:
        write_sorted(df if ranged else df.repartitionByRange(key), path, key)

    return load_or_build(spark, folder, version, files_of(*sources), lambda _: build(), force_rebuild, write)[0]
