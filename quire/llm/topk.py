"""Exact top-k inner products by distributed histogram selection.

Vectors are packed into blocks (numpy bytes). Every task takes one block of queries and one block
of candidates, scores all pairs in one matrix product and keeps counts only:

1. each pass counts, per query, how many scores fall into the bins of the interval that holds its
   k-th value; the counts are summed and the interval shrinks to one bin, until its width is 1;
2. the last pass returns scores above the k-th value and, of those equal to it, the smallest ids.

A block reports only its highest bins until it has k scores itself: lower ones cannot hold the
k-th value. Scores are integers (components are floored), exact in float64 below 2**53.

Defined results: vectors that are null, empty or hold null or non-finite components take no part,
nor do rows without id; vectors of different lengths never meet; candidates with the query's own id
are not its candidates; a repeated id takes part once per row, and ties of score go to the smaller
id; a query with fewer candidates gets all. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ensure_folder
from ._runtime import durable, partitions, read_table

BINS = 256


def integral(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """row, id, v: components floored to integers, unusable vectors left out."""
    v = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    usable = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    ok = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & usable)
    return ok.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def packed(rows: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks of about ``block_bytes`` of vectors of one length: block, dim, ids, vs (bytes, row by row)."""
    n, longest_v = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    # The number of blocks follows the number of rows; hashing by content too deals equal ids out.
    blocks = max(1, -(-n * 8 * (longest_v or 1) // block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, block, vs = b.column("id").to_numpy(), b.column("block").to_numpy(), b.column("v")
            at = vs.offsets.to_numpy()
            sizes, flat = np.diff(at), vs.values.to_numpy()
            order = np.lexsort((ids, sizes, block))
            edges = np.flatnonzero((np.diff(block[order]) != 0) | (np.diff(sizes[order]) != 0)) + 1
            for part in np.split(order, edges):
                dim = int(sizes[part[0]])
                m = np.stack([flat[at[i] : at[i] + dim] for i in part])
                yield pa.RecordBatch.from_pydict({"block": [int(block[part[0]])], "dim": pa.array([dim], pa.int32()), "ids": [ids[part].astype("<i8").tobytes()], "vs": [m.astype("<f8").tobytes()]})

    # Beyond 4096 blocks tasks take several, one after the other, as many tasks as the session shuffles to.
    tasks = min(blocks, max(4096, partitions(rows.sparkSession)))
    return dealt.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(pack, "block long, dim int, ids binary, vs binary")


def scored(q_ids: bytes, q_vs: bytes, c_ids: bytes, c_vs: bytes, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids, and scores; a query's own id scores NaN."""
    qi, ci = np.frombuffer(q_ids, "<i8"), np.frombuffer(c_ids, "<i8")
    s = np.frombuffer(q_vs, "<f8").reshape(-1, dim) @ np.frombuffer(c_vs, "<f8").reshape(-1, dim).T
    order = np.argsort(ci, kind="stable")
    s, ci = s[:, order], ci[order]
    s[qi[:, None] == ci[None, :]] = np.nan
    return qi, ci, s


def top_k(queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0, query_bytes: int = 1 << 19, block_bytes: int = 1 << 21, at_once: int = 16) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of each query.

    ``at_once`` blocks of ``query_bytes`` are broadcast at a time (a fixed bound), so candidates
    are never shuffled; the loop runs over such sets of query blocks. Each set's rows are written to
    the shared folder, so that the plan does not grow with the number of sets.
    """
    spark = queries.sparkSession
    ensure_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/quire-topk-{uuid.uuid4().hex}"
    q_blocks = durable(packed(integral(queries, id_col, vec_col, scale), query_bytes).withColumn("q", F.monotonically_increasing_id()))
    c_blocks = durable(packed(integral(candidates, id_col, vec_col, scale), block_bytes))
    top = c_blocks.mapInArrow(longest, "reach double").agg(F.max("reach")).first()[0] or 0.0
    numbers = sorted(r[0] for r in q_blocks.select("q").toLocalIterator())  # one number for each block
    for first in range(0, max(1, len(numbers)), at_once):
        some = q_blocks.where(F.col("q").isin(numbers[first : first + at_once]))
        top_k_of(some, c_blocks, k, top).write.parquet(f"{path}/first={first}")
    return spark.read.schema("query_id long, rank int, vec_id long, score long, first long").parquet(path).drop("first")


def top_k_of(q_blocks: DataFrame, c_blocks: DataFrame, k: int, top: float) -> DataFrame:
    rows = q_blocks.mapInArrow(query_rows, "query_row long, query_id long, q long, at int, reach double")
    # All scores of all queries lie in [low, low + width * BINS); widths are powers of BINS, so bins nest.
    bound = int(np.ceil((rows.agg(F.max("reach")).first()[0] or 0.0) * top)) + 1
    width = 1
    while width * BINS < 2 * bound + 1:
        width *= BINS
    state = rows.select("query_row", "query_id", "q", "at", F.lit(0).cast("long").alias("above"), F.lit(-bound).cast("long").alias("low"))
    while width:
        counted = jobs(c_blocks, q_blocks, state).mapInArrow(lambda it, w=width: counts_in(it, k, w), "query_row long, bin long, n long")
        summed = counted.groupBy("query_row", "bin").agg(F.sum("n").alias("n"))
        higher = Window.partitionBy("query_row").orderBy(F.desc("bin"))
        running = summed.withColumn("before", F.sum("n").over(higher) - F.col("n"))
        joined = state.join(running, "query_row", "left").where(F.col("bin").isNull() | (F.col("above") + F.col("before") < k))
        # The lowest bin with fewer than k scores above it holds the k-th (or the last) score.
        chosen = joined.groupBy("query_row", "query_id", "q", "at").agg(F.min_by(F.struct("bin", "before", "above", "low"), F.coalesce("bin", F.lit(0))).alias("s"))
        state = durable(chosen.select(
            "query_row", "query_id", "q", "at",
            (F.col("s.above") + F.coalesce("s.before", F.lit(0))).alias("above"),
            (F.col("s.low") + F.coalesce("s.bin", F.lit(0)) * width).alias("low"),
        ))
        width //= BINS
    hits = jobs(c_blocks, q_blocks, state).mapInArrow(lambda it: hits_in(it, k), "query_row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for q, dim, ids, vs in zip(*(b.column(c).to_pylist() for c in ("q", "dim", "ids", "vs")), strict=True):
            ids, norms = np.frombuffer(ids, "<i8"), np.sqrt((np.frombuffer(vs, "<f8").reshape(-1, dim) ** 2).sum(1))
            at = np.arange(len(ids), dtype=np.int32)
            yield pa.RecordBatch.from_pydict({"query_row": pa.array(q * 65536 + at.astype(np.int64)), "query_id": pa.array(ids), "q": pa.array(np.full(len(ids), q, np.int64)), "at": pa.array(at), "reach": pa.array(norms)})


def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        norms = [float(np.sqrt((np.frombuffer(vs, "<f8").reshape(-1, d) ** 2).sum(1)).max()) for d, vs in zip(b.column("dim").to_pylist(), b.column("vs").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"reach": pa.array(norms, pa.float64())})


def jobs(c_blocks: DataFrame, q_blocks: DataFrame, state: DataFrame) -> DataFrame:
    """Each block of candidates with each broadcast block of queries and their intervals, in the block's order."""
    per_block = state.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("at", "query_row", "above", "low"))).alias("s"))
    q_side = q_blocks.join(per_block, "q").select("dim", F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"), F.col("s.query_row").alias("row"), F.col("s.above").alias("above"), F.col("s.low").alias("low"))
    return c_blocks.select("dim", F.col("ids").alias("c_ids"), F.col("vs").alias("c_vs")).join(F.broadcast(q_side), "dim")


def jobs_of(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for x in b.to_pylist():
            yield x, scored(x["q_ids"], x["q_vs"], x["c_ids"], x["c_vs"], x["dim"])


def counts_in(batches: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[pa.RecordBatch]:
    for x, (_, _, s) in jobs_of(batches):
        rows, low = (np.array(x[c], np.int64) for c in ("row", "low"))
        out = ([], [], [])
        for i in range(len(rows)):
            own = s[i][~np.isnan(s[i])]
            bins = np.floor((own - low[i]) / width).astype(np.int64)
            n = np.bincount(bins[(bins >= 0) & (bins < BINS)], minlength=BINS)
            through = np.cumsum(n[::-1])[::-1]
            keep = np.flatnonzero((n > 0) & (through - n < k))
            out[0].append(np.full(len(keep), rows[i]))
            out[1].append(keep)
            out[2].append(n[keep])
        if out[0]:
            yield pa.RecordBatch.from_pydict({c: pa.array(np.concatenate(v).astype(np.int64)) for c, v in zip(("query_row", "bin", "n"), out, strict=True)})


def hits_in(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for x, (qi, ci, s) in jobs_of(batches):
        rows, low, above = (np.array(x[c], np.int64) for c in ("row", "low", "above"))
        out = ([], [], [], [])
        for i in range(len(qi)):
            own = s[i]
            # Candidates are in order of id, so the first of the equal ones have the smallest ids.
            take = np.concatenate([np.flatnonzero(own > low[i]), np.flatnonzero(own == low[i])[: max(0, k - above[i])]])
            out[0].append(np.full(len(take), rows[i]))
            out[1].append(np.full(len(take), qi[i]))
            out[2].append(ci[take])
            out[3].append(own[take])
        if out[0]:
            yield pa.RecordBatch.from_pydict({c: pa.array(np.concatenate(v).astype(np.int64)) for c, v in zip(("query_row", "query_id", "vec_id", "score"), out, strict=True)})


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors.where(F.col("vec_id") % 20 == 0), vectors, 20)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20
"""
