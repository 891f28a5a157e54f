"""Mixing sources to target weights by pivotal dependent rounding.

A source's target, divided by its size, is the fractional number of copies of each of its
documents. The whole part is certain; fractions are rounded in pairs: mass (in words) moves at
random from one document of a pair to the other until one of them is whole, in such a way that
every expectation and the sum of words stay as they are. What is left fractional, at most one
document of a group, meets others at the next level of a reduction tree of fixed fan-in, so a task
holds about ``FAN`` documents of a source and the last level has one residual per source.

Rows that repeat source, id and text are one item with a number of rows: the item's copies are
rounded together and dealt evenly to its rows, so no group grows with repeated or null ids.

Targets fill up like water: all sources get weight times a level, cut at their limit; the level is
raised until the shares are dealt out. Up to ``DRIVER_SOURCES`` sources this happens in the driver
and their table is broadcast; beyond, sources are numbered by a range sort, the level is found by
aggregation (one pass for each set of sources that reaches its limit) and documents meet their
source by a join that bears hot sources. Both ways give the same targets.

Defined results: size is the number of words (null text: 0); the null source is a source, last in
order; a document of size 0 takes 0 words; a null id is an id like any other; no rows give no rows.
Reruns agree, for random numbers follow from ids and texts. Extra columns, whatever their names, are
ignored by :func:`mix` and kept by :func:`mixed_rows`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._runtime import durable, join_unique, read_table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
FAN = 256
#: So many sources at most are held by the driver and broadcast.
DRIVER_SOURCES = 50_000
STATE = "source_no long, bucket long, key long, doc_id long, t long, size long, times long, base long, p double, copies long"
SOURCES = "source_no long, none boolean, named string, source_size long, n long, target double, copies_each double"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> dict:
    """source -> target: ``share`` of all sizes by weight, none above ``most`` times its size."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free = {}, list(order)
    left = share * sum(sizes.values())
    while free:
        each = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * each > most * sizes[s]]
        if not full:
            return out | {s: weight[s] * each for s in free}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def driver_sources(totals: DataFrame, share: float, most: float, weights: tuple) -> DataFrame:
    """The table of sources of a mix that names few of them."""
    held = {None if r["none"] else r["named"]: (r["source_size"], r["n"]) for r in totals.toLocalIterator()}
    target = targets({s: v[0] for s, v in held.items()}, share, most, weights)
    order = sorted(held, key=lambda s: (s is None, s or ""))
    rows = [(i, s is None, s or "", *held[s], float(target[s]), target[s] / held[s][0] if held[s][0] else 0.0) for i, s in enumerate(order)]
    return totals.sparkSession.createDataFrame(rows, SOURCES)


def spread_sources(totals: DataFrame, share: float, most: float, weights: tuple) -> DataFrame:
    """The same table without a row in the driver: sources are numbered by a range sort, the level is found by aggregation."""
    spark = totals.sparkSession
    ranged = durable(totals.repartitionByRange("none", "named").sortWithinPartitions("none", "named").withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id() % (1 << 33)))
    before, counts = 0, []
    for r in sorted(ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):  # one row for each partition
        counts.append((r["part"], before))
        before += r["n"]
    starts = F.broadcast(spark.createDataFrame(counts, "part int, before long"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_no") % len(weights)).cast("int") + 1)
    numbered = ranged.join(starts, "part").withColumn("source_no", F.col("before") + F.col("nth")).withColumn("weight", weight)
    numbered = durable(numbered.select("source_no", "none", "named", "source_size", "n", "weight", (most * F.col("source_size")).alias("limit")))
    left, level = share * (numbered.agg(F.sum("source_size")).first()[0] or 0), 0.0
    while True:
        full = F.col("weight") * F.lit(level) > F.col("limit")
        taken, free = numbered.agg(F.coalesce(F.sum(F.when(full, F.col("limit"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        raised = (left - taken) / free if free else level
        if raised <= level * (1 + 1e-12):
            break
        level = raised
    target = F.least(F.col("weight") * F.lit(level), F.col("limit"))
    each = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return durable(numbered.select("source_no", "none", "named", "source_size", "n", target.alias("target"), each.alias("copies_each")))


def pair_up(pdf: pd.DataFrame, seed: int, level: int) -> pd.DataFrame:
    """Round the items of one group against each other; at most one stays fractional."""
    pdf = pdf.sort_values(["key", "doc_id", "t"])
    source, bucket = int(pdf["source_no"].iloc[0]), int(pdf["bucket"].iloc[0])
    name = f"{seed}:{level}:{source}:{bucket}".encode()
    draws = np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.blake2b(name, digest_size=16).digest(), "little"))).random(len(pdf))
    size, p = pdf["size"].to_numpy().astype(float), pdf["p"].to_numpy().copy()
    held = -1
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        if size[i] == 0:
            p[i] = 0.0
            continue
        if held < 0:
            held = i
            continue
        to_i, to_held = min(size[i] * (1 - p[i]), size[held] * p[held]), min(size[i] * p[i], size[held] * (1 - p[held]))
        gains, mass = (i, to_i) if draws[i] * (to_i + to_held) < to_held else (held, to_held)
        loses = held if gains == i else i
        up, down = size[gains] * (1 - p[gains]), size[loses] * p[loses]
        p[gains] = 1.0 if up <= down else p[gains] + mass / size[gains]
        p[loses] = 0.0 if down <= up else p[loses] - mass / size[loses]
        p[gains], p[loses] = (1.0 if p[gains] > 1 - 1e-12 else p[gains]), (0.0 if p[loses] < 1e-12 else p[loses])
        held = next((x for x in (i, held) if 0.0 < p[x] < 1.0), -1)
    whole = (p == 0.0) | (p == 1.0)
    return pdf.assign(p=p, copies=np.where(whole, pdf["base"] + (p == 1.0), -1).astype(np.int64), bucket=bucket // FAN)


def rounding(seed: int, level: int):
    return lambda pdf: pair_up(pdf, seed, level)


def item_plan(docs: DataFrame, id_col: str, source_col: str, text_col: str, share: float, most: float, weights: tuple, seed: int, residual: str) -> DataFrame:
    """One row per item (rows of equal source, id and text): doc_id, t, source, size, times, source_size, target, copies (of all its rows), extra (words)."""
    source = F.col(source_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t"), source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("named"), word_count(F.col(text_col)).alias("size"))
    items = durable(rows.groupBy("doc_id", "t", "none", "named", "size").agg(F.count(F.lit(1)).alias("times")))
    totals = durable(items.groupBy("none", "named").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.count(F.lit(1)).alias("n")))
    n_sources, most_items = totals.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    few = n_sources <= DRIVER_SOURCES
    sources = (driver_sources if few else spread_sources)(totals, share, most, weights)
    key = ["none", "named"]
    meet = lambda left, on, times=None: left.join(F.broadcast(sources), on) if few else join_unique(left, sources, on, times)
    joined = meet(items, key, totals.select(*key, "n"))
    expected = F.col("copies_each") * F.col("times")
    # A product a rounding error below a whole number is that number.
    base = F.floor(expected + 1e-9)
    order = F.xxhash64("doc_id", "t", F.lit(seed))
    level = joined.select(
        "source_no", F.pmod(F.xxhash64(order), F.ceil(F.col("n") / FAN)).alias("bucket"), order.alias("key"), "doc_id", "t", "size", "times",
        base.alias("base"), F.greatest(expected - base, F.lit(0.0)).alias("p"), F.lit(-1).cast("long").alias("copies"),
    )
    done, deepest, depth = None, most_items, 0
    while True:
        rounded = durable(level.groupBy("source_no", "bucket").applyInPandas(rounding(seed, depth), STATE))
        settled = rounded.where("copies >= 0")
        done = settled if done is None else done.unionByName(settled)
        level = rounded.where("copies < 0")
        deepest, depth = -(-deepest // FAN), depth + 1
        if deepest <= 1:
            break
    if residual == "words":
        last = level.withColumn("copies", F.col("base")).withColumn("extra", F.round(F.col("p") * F.col("size")).cast("long"))
    else:
        luck = F.pmod(F.xxhash64("source_no", "key", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
        last = level.withColumn("copies", F.col("base") + (luck < F.col("p")).cast("long")).withColumn("extra", F.lit(0).cast("long"))
    out = done.withColumn("extra", F.lit(0).cast("long")).unionByName(last)
    named = meet(out, ["source_no"])
    return named.select("doc_id", "t", F.when(~F.col("none"), F.col("named")).alias("source"), "size", "times", "source_size", "target", "copies", "extra")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, seed: int = 0, residual: str = "words") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    The last fractional document of a source has nothing left to be paired with: by ``residual`` it
    is taken for its fraction of words ("words": the source meets its target to half a word) or
    rounded at random ("whole").
    """
    plan = item_plan(docs, id_col, source_col, text_col, share, most, weights, seed, residual)
    nth = F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))
    rows = plan.withColumn("nth", nth).withColumn("own", own_copies(F.col("nth")))
    taken = F.col("own") * F.col("size") + F.when(F.col("nth") == F.col("copies") % F.col("times"), F.col("extra")).otherwise(0)
    return rows.select("doc_id", "source", "size", "source_size", "target", F.col("own").cast("int").alias("copies"), taken.alias("taken"))


def own_copies(nth: Column) -> Column:
    """Copies of the ``nth`` row of an item."""
    return F.floor(F.col("copies") / F.col("times")) + (nth < F.col("copies") % F.col("times")).cast("long")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, whole; all columns stay as they are."""
    settings = {"share": 1.5, "most": 2.0, "weights": WEIGHTS, "seed": 0} | options
    plan = durable(item_plan(docs, id_col, source_col, text_col, residual="whole", **settings).where("copies > 0"))
    plan = plan.select(F.struct("doc_id", "t", "source").alias("item"), "times", "copies")
    columns = docs.columns
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    whole = whole.select("row", F.struct(F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(f"row.`{text_col}`").alias("t"), F.col(f"row.`{source_col}`").cast("string").alias("source")).alias("item"))
    same = F.col("d.item").eqNullSafe(F.col("p.item"))
    even = (F.col("times") == 1) | (F.col("copies") % F.col("times") == 0)
    alike = whole.alias("d").join(plan.where(even).alias("p"), same).select("row", (F.col("copies") / F.col("times")).cast("int").alias("own"))
    # Rows of one item of which some are taken once more: only these are ranked.
    ranked = whole.alias("d").join(plan.where(~even).alias("p"), same).select("row", "d.item", "times", "copies")
    ranked = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy(F.xxhash64("row"))) - 1)
    ranked = ranked.select("row", own_copies(F.col("nth")).cast("int").alias("own"))
    both = alike.unionByName(ranked) if not plan.where(~even).isEmpty() else alike
    return both.where("own > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("own"))).alias("copy")).select(*(F.col(f"row.`{c}`").alias(c) for c in columns))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix(read_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
