"""Keyed state of streams, and keyed upsert and delete streams to a current-state table."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.operators.interactions import latest_per_key
from ostinato.session import delete_folder, finished_folders


#: Rows that a state entry or an emitted frame holds at most.
FRAME = 10_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Streams started from now on keep their state in the store that knows lists, maps and timers; those restarted keep the one of their checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def keyed_rows(stream: DataFrame, client: str, ts: str, event_id: str, *more: Column) -> DataFrame:
    """Columns k (client) and id as text, the time, us, and more; rows without a time belong to no window and go.

    Whole numbers beside nulls reach Python as floats, as keys and inside arrays too: so both pass as text.
    """
    rows = stream.where(F.col(ts).isNotNull())
    return rows.select(F.col(client).cast("string").alias("k"), F.col(ts), F.col(event_id).cast("string").alias("id"), F.unix_micros(ts).alias("us"), *more)


def order_key(type_name: str):
    """Order of ids given as text, nulls first as in a sort."""
    number = int if type_name in ("tinyint", "smallint", "int", "bigint") else float if type_name in ("float", "double") or type_name.startswith("decimal") else str
    return lambda x: (x is not None, number(x) if x is not None else 0)


class KeyedTable:
    """Current rows per key, kept as versions of a base, a manifest that names the current one, and a bounded number of deltas.

    A micro-batch writes only its own latest rows, into a folder named by the batch id, so a repeated batch overwrites itself.  Every ``fold_every``
    deltas the stream folds them into the next base and then writes its manifest row, which is the switch: a crash before it leaves the old
    version current, and the repeated batch folds again over the unfinished base.  The base before last and the deltas folded into it go after
    the switch, so readers of the last version are not disturbed.  Tombstones stay in the base, so an older row that comes late stays deleted.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], tombstone: str | None = None, fold_every: int = 20):
        self.spark, self.path, self.keys, self.order, self.tombstone, self.fold_every = spark, path, keys, order, tombstone, fold_every

    def manifest(self) -> tuple[int, int, int]:
        """The current version, the last batch folded into it, and that of the version before; (0, -1, -1) without a base."""
        try:
            row = self.spark.read.schema("version int, folded bigint, before bigint").parquet(f"{self.path}/manifest").select("version", "folded", "before").orderBy(F.desc("version")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            row = None
        return tuple(row) if row else (0, -1, -1)

    def pending(self, folded: int) -> list[int]:
        """Complete deltas after the folded ones."""
        found = [int(n.removeprefix("batch=")) for n in finished_folders(self.spark, f"{self.path}/deltas")]
        return sorted(i for i in found if i > folded)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        version, folded, _ = self.manifest()
        if batch_id <= folded:
            return  # a batch repeated after its fold
        latest_per_key(batch, self.keys, self.order).write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch_id}")
        if len(self.pending(folded)) >= self.fold_every:
            self.fold()

    def fold(self) -> None:
        """Write base and pending deltas as the next base, switch to it, and delete what no version needs."""
        version, folded, before = self.manifest()
        waiting = self.pending(folded)
        if not waiting:
            return
        latest_per_key(self._all(), self.keys, self.order).write.mode("overwrite").parquet(f"{self.path}/base/v={version + 1}")
        row = self.spark.createDataFrame([(version + 1, waiting[-1], folded)], "version int, folded bigint, before bigint")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version + 1}")
        for i in finished_folders(self.spark, f"{self.path}/deltas"):
            if int(i.removeprefix("batch=")) <= folded:
                delete_folder(self.spark, f"{self.path}/deltas/{i}")
        if version > 1:
            delete_folder(self.spark, f"{self.path}/base/v={version - 1}")

    def _all(self) -> DataFrame:
        version, folded, _ = self.manifest()
        parts = [f"{self.path}/base/v={version}"] * (version > 0) + [f"{self.path}/deltas/batch={i}" for i in self.pending(folded)]
        if not parts:
            raise FileNotFoundError(self.path)
        return reduce(lambda a, b: a.unionByName(b), [self.spark.read.parquet(p) for p in parts])

    def current(self) -> DataFrame:
        gone: Column | None = F.expr(self.tombstone) if self.tombstone else None
        return latest_per_key(self._all(), self.keys, self.order, gone)

    def compact(self, new_path: str) -> "KeyedTable":
        """Write the latest rows (tombstones too) as the first base of a new folder."""
        latest_per_key(self._all(), self.keys, self.order).write.parquet(f"{new_path}/base/v=1")
        self.spark.createDataFrame([(1, -1, -1)], "version int, folded bigint, before bigint").coalesce(1).write.parquet(f"{new_path}/manifest/v=1")
        return KeyedTable(self.spark, new_path, self.keys, self.order, self.tombstone, self.fold_every)

    def follow(self, changes: DataFrame, checkpoint: str, **trigger):
        """Start the stream that merges changes into this table."""
        return (
            changes.writeStream.foreachBatch(lambda df, i: self.merge(df, i))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()
        )
