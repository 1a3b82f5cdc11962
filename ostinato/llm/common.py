"""Helpers that the training-data operators share."""

from __future__ import annotations

import functools
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.session import fresh_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def worker_cached(name: str, token: str, make):
    """``make()`` kept for the life of the Python worker, one value a name; functions themselves are sent anew with each task."""
    cache = sys.__dict__.setdefault("_ostinato_worker_cache", {})
    if cache.get(name, ("",))[0] != token:
        cache.pop(name, None)  # before the new one is made, so that only one is held
        cache[name] = (token, make())
    return cache[name][1]


def keeps_columns(operator):
    """For operators whose own columns start with an underscore: such columns of the input pass through them inside one struct."""
    @functools.wraps(operator)
    def call(df: DataFrame, *args, **kw) -> DataFrame:
        named = {x for x in [*args, *kw.values()] if isinstance(x, str)}
        inner = [c for c in df.columns if c.startswith("_") and c not in named]
        if not inner:
            return operator(df, *args, **kw)
        name = "others"
        while any(c.lower() == name for c in df.columns):
            name += "_"
        packed = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in inner], F.struct(*[F.col(f"`{c}`") for c in inner]).alias(name))
        out = operator(packed, *args, **kw)
        return out.select(*[F.col(f"`{c}`") for c in out.columns if c != name], *[F.col(name)[c].alias(c) for c in inner])

    return call


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def with_fields(df: DataFrame, struct: str, fields: list[str]) -> DataFrame:
    """Put the fields of a struct column beside the other columns; they replace columns of the same names."""
    names = {n.lower() for n in fields}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != struct and c.lower() not in names], *[F.col(struct)[n].alias(n) for n in fields])


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A copy in the shared folder and its path, for callers that delete it when they are done."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate copy from the shared folder."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
