"""Small tables with awkward rows for the training-data operators."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Über " + "Lorem ipsum dolor sit amet, consectetur 12 adipiscing! " * 4000


def docs_frame(spark, texts, extra: dict | None = None):
    """Documents with ids from 0; ``texts`` may hold None. ``extra`` adds constant columns with given names."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 2 else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for name, value in (extra or {}).items():
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(value))
    return df


def with_odd_rows(df, spark):
    """The frame, its first row again, and a row of nulls."""
    from pyspark.sql import functions as F

    nulls = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    return df.unionByName(df.orderBy("doc_id").limit(1)).unionByName(nulls)
