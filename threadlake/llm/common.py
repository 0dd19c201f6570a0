"""Helpers that the operators of this subpackage share.

Large intermediate results are written as Parquet below the folder that the
cluster names in ``spark.checkpoint.dir`` (all executors see it), so a lost
executor never costs more than the running stage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; the path may be of any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode, where none need be configured."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def plain_names(df: DataFrame, kept: int | None = None) -> DataFrame:
    """``df`` with its first ``kept`` columns (or all) named by place, as Arrow maps know no names with dots."""
    n = len(df.columns) if kept is None else kept
    return df.toDF(*(f"c{k}" for k in range(n)), *df.columns[n:])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds the rows (so the memory) of one Arrow batch handed to a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def runs(batches, keys: list[str]):
    """Tables of the rows with equal ``keys``, from Arrow batches that are sorted by them.

    Only the run at hand is held. For ``mapInArrow`` after ``sortWithinPartitions``;
    much cheaper than a grouped map where groups are many and small.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    held, last = [], None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        table = pa.Table.from_batches([batch])
        new = np.zeros(n, bool)
        for key in keys:
            col = table.column(key).combine_chunks()
            new[1:] |= pc.fill_null(pc.not_equal(col[1:], col[:-1]), True).to_numpy(zero_copy_only=False)
        first = tuple(table.column(k)[0].as_py() for k in keys)
        new[0] = first != last
        at = np.flatnonzero(new).tolist()
        if held and at and at[0] == 0:
            yield pa.concat_tables(held)
            held = []
        for a, b in zip([0, *[x for x in at if x]], [*[x for x in at if x], n], strict=True):
            if a and held:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
        last = tuple(table.column(k)[n - 1].as_py() for k in keys)
    if held:
        yield pa.concat_tables(held)
