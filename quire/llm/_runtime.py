"""Session helpers shared by the operators: table access, checkpoints, batch plumbing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import settled


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the cluster's folder (``spark.checkpoint.dir``)."""
    return settled(df)


def spread(docs: DataFrame) -> DataFrame:
    """``docs``, dealt out where they come in fewer partitions than there are cores (a small file is one partition)."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores, F.xxhash64(*docs.columns))


def id_crc(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, lengthened where a column is already called so."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch whose columns are cast to ``schema``."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows of equal ``key`` from batches that are sorted by it, one table at a time."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(k).to_pylist() for k in key), strict=True))
        start = 0
        for i in range(len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            if held and held_key != keys[start]:
                yield pa.Table.from_batches(held)
                held = []
            held_key = keys[start]
            held.append(batch.slice(start, i - start))
            start = i
    if held:
        yield pa.Table.from_batches(held)


#: A key that holds more than this share of the rows is joined by broadcast: at most 1 / share such keys exist.
#: So few rows as ``HOT_ROWS`` may meet in one task.
HOT_SHARE, HOT_ROWS = 1e-4, 10_000


def join_unique(rows: DataFrame, table: DataFrame, on: list[str], times: DataFrame | None = None) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row for each key, no null keys): an inner join that bears hot keys.

    ``times`` has the keys and ``n``, how many rows each has (counted here by default). Keys with a
    large share of the rows, whose number is bounded by that share, are broadcast; the others meet
    their row by shuffle, at most that share of the rows in one task.
    """
    columns = [*rows.columns, *(c for c in table.columns if c not in on)]
    if times is None:
        total, counted = rows.count(), rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    else:
        total, counted = times.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], times
    hot = counted.where(F.col("n") > max(total * HOT_SHARE, HOT_ROWS)).select(*on)
    if total <= HOT_ROWS or hot.isEmpty():
        return rows.join(table, on).select(*columns)
    hot = durable(hot)
    few = F.broadcast(durable(table.join(F.broadcast(hot), on, "left_semi")))
    return rows.join(few, on).select(*columns).unionByName(rows.join(F.broadcast(hot), on, "left_anti").join(table, on).select(*columns))
