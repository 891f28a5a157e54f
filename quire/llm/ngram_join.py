"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with equal sets of word 5-grams form a class; classes are the nodes. Their MinHash values
make ``BANDS`` bands of ``ROWS``; classes that share a band's key meet in that bucket. A bucket is
split into blocks of at most about ``BLOCK`` classes, and a task takes two blocks, so that neither
a large bucket nor all pairs of one end up in a task. Per pair, MinHash values are compared
``STEP_HASHES`` at a time; the pair is dropped when the posterior probability that its similarity
reaches the threshold falls below ``tolerance``. A pair belongs to the first band it shares. What is
left is verified exactly on the full sets of 5-grams.

No list of pairs is kept: a first pass over the tasks names the classes that have a pair left, their
texts are fetched, and a second pass prunes the same pairs again and verifies them. Links leave a
task as one row per class (their number and its smallest linked class); groups are then merged by
contracting the links until none is left.

The chance that a pair of similarity 0.8 shares no band is (1 - 0.8**4)**24, about 3e-6.

Defined results: a word is a run of ``[^\\x20\\x09-\\x0D]``; a text of 1 to 4 words has one gram,
all its words; null, empty and white texts share the empty set and are copies of each other; repeated
rows are copies; a null id keeps its row, and a class's id is the smallest id of its group (null if
all are null); no rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._runtime import durable, join_unique, partitions, read_table, sorted_groups, spread, unused
from ._words import chained, slices, word_hashes

GRAM, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
HASHES = 96
STEP_HASHES = 16
BLOCK = 512
TOLERANCE = 1e-6
SEED = 20240229


CHUNK_BYTES = 1 << 20


def grams(column: pa.Array, n: int = GRAM) -> Iterator[np.ndarray]:
    """Of each text, the sorted distinct 64-bit hashes of its word n-grams."""
    for _, some in slices(column, CHUNK_BYTES):
        h, sizes = word_hashes(some)
        whole, ends = chained(h, n), np.cumsum(sizes)
        for size, end in zip(sizes.tolist(), ends.tolist(), strict=True):
            own = whole[end - size : end - n + 1] if size >= n else chained(h[end - size : end], size) if size else h[:0]
            own = np.sort(own)
            yield own[np.r_[True, own[1:] != own[:-1]]] if len(own) else own


def minhashes(g: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = (g ^ (g >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 512):
        np.minimum(out, (low[start : start + 512, None] * a + b).min(axis=0), out=out)
    return out


def coefficients() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(SEED))
    return r.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, least matches) of each step: fewer matches, and P(J >= threshold) < tolerance.

    Flat prior on J; stored values are one byte, so unequal sets match by chance once in 256.
    """
    j = (np.arange(20_000) + 0.5) / 20_000
    match = np.log(j + (1 - j) / 256)
    miss = np.log1p(-(j + (1 - j) / 256))
    out = []
    for n in range(STEP_HASHES, HASHES + 1, STEP_HASHES):
        for m in range(n + 1):
            log = m * match + (n - m) * miss
            w = np.exp(log - log.max())
            if w[j >= threshold].sum() / w.sum() >= tolerance:
                break
        out.append((n, m))
    return out


FEATURES = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("node", pa.binary()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])


def featured(docs: DataFrame, gram: int) -> DataFrame:
    """doc_id, t (hash of the text), node (128-bit digest of the set of grams), sig (one byte of each MinHash), bands (64-bit keys)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for g in grams(batch.column("text"), gram):
                out[0].append(xxhash.xxh3_128_digest(g.tobytes()))
                m = minhashes(g, a, b) if len(g) else None
                out[1].append(None if m is None else m.astype(np.uint8).tobytes())
                out[2].append(None if m is None else np.array([xxhash.xxh3_64_intdigest(m[i * ROWS : (i + 1) * ROWS].tobytes(), seed=i) for i in range(BANDS)], np.uint64).astype(np.int64))
            columns = [batch.column("doc_id"), batch.column("t"), *(pa.array(c, f.type) for c, f in zip(out, list(FEATURES)[2:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=FEATURES)

    return docs.mapInArrow(sign, "doc_id long, t long, node binary, sig binary, bands array<long>")


def pruned(t: pa.Table, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (as two arrays of row numbers) of a task that survive pruning and whose first shared band is the task's."""
    n = t.num_rows
    band, bi, bj = (t.column(c)[0].as_py() for c in ("band", "bi", "bj"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(n, HASHES)
    bands = np.array(t.column("bands").to_pylist(), np.int64).reshape(n, BANDS)
    block = t.column("block").to_numpy()
    if bi == bj:
        x, y = np.triu_indices(n, 1)
    else:
        one, two = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
        x, y = np.repeat(one, len(two)), np.tile(two, len(one))
    for earlier in range(band):
        apart = bands[x, earlier] != bands[y, earlier]
        x, y = x[apart], y[apart]
    matches, start = np.zeros(len(x), np.int32), 0
    for upto, least in steps:
        if not len(x):
            break
        matches += (sig[x, start:upto] == sig[y, start:upto]).sum(axis=1)
        start = upto
        keep = matches >= least
        x, y, matches = x[keep], y[keep], matches[keep]
    return x, y


ALIVE = pa.schema([("band", pa.int32()), ("key", pa.int64()), ("bi", pa.int32()), ("bj", pa.int32()), ("block", pa.int32()), ("node", pa.binary())])


def alive(groups: Iterator[pa.Table], steps: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """The rows of each task that have a pair left."""
    held: list[pa.Table] = []
    for t in groups:
        x, y = pruned(t, steps)
        if len(x):
            held.append(t.select(ALIVE.names).take(np.unique(np.r_[x, y])).cast(ALIVE))
            if sum(h.num_rows for h in held) > 5_000:
                yield from pa.concat_tables(held).combine_chunks().to_batches()
                held.clear()
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches()


TASK = ["band", "key", "bi", "bj"]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


LINKED = pa.schema([("node", pa.binary()), ("root", pa.binary()), ("links", pa.int64())])


def verified(groups: Iterator[pa.Table], steps: list[tuple[int, int]], threshold: float, gram: int) -> Iterator[pa.RecordBatch]:
    """Per task and class with links: node, root (the task's smallest connected class), links (rows they stand for)."""
    for t in groups:
        nodes, rows = t.column("node").to_pylist(), t.column("copies").to_pylist()
        sets = list(grams(t.column("text").combine_chunks() if t.column("text").num_chunks != 1 else t.column("text").chunk(0), gram))
        links, root = [0] * len(nodes), list(range(len(nodes)))

        def find(n: int, root: list = root) -> int:
            while root[n] != n:
                root[n] = root[root[n]]
                n = root[n]
            return n

        for n, m in zip(*(x.tolist() for x in pruned(t, steps)), strict=True):
            a, b = sets[n], sets[m]
            if min(len(a), len(b)) < threshold * max(len(a), len(b)):
                continue
            both = overlap(a, b)
            if both >= threshold * (len(a) + len(b) - both):
                links[n] += rows[m]
                links[m] += rows[n]
                one, two = sorted((find(n), find(m)))  # rows are in order of node
                root[two] = one
        linked = [n for n, x in enumerate(links) if x]
        if linked:
            yield pa.RecordBatch.from_arrays([pa.array([nodes[n] for n in linked], pa.binary()), pa.array([nodes[find(n)] for n in linked], pa.binary()), pa.array([links[n] for n in linked], pa.int64())], schema=LINKED)


def groups_of(edges: DataFrame) -> DataFrame:
    """node, group of the connected components of ``edges`` (node, root).

    Each round points every node at its smallest neighbour, follows one more pointer, and contracts
    the edges; the number of rounds is logarithmic in a component's size.
    """
    left = durable(edges.where(F.col("node") != F.col("root")).select("node", "root").distinct())
    rounds = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("to")).select("node", F.least("node", "to").alias("to"))
        least = durable(least)
        onward = least.select(F.col("node").alias("to"), F.col("to").alias("further"))
        least = durable(join_unique(least, onward, ["to"]).select("node", F.col("further").alias("to")))
        rounds.append(least)
        moved = join_unique(left, least, ["node"]).select("root", F.col("to").alias("a"))
        moved = join_unique(moved, least.select(F.col("node").alias("root"), F.col("to").alias("b")), ["root"])
        left = durable(moved.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct())
    if not rounds:
        return edges.select("node", F.col("root").alias("group")).where(F.lit(False))
    out = rounds[-1].select("node", F.col("to").alias("group"))
    for earlier in reversed(rounds[:-1]):
        # A root that no later round moved stays the group; every root has a row, so the join is inner.
        roots = earlier.select("to").distinct().join(out.select(F.col("node").alias("to"), "group"), "to", "left")
        out = durable(join_unique(earlier, roots.select("to", F.coalesce("group", "to").alias("group")), ["to"]).select("node", "group"))
    return durable(out)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, gram: int = GRAM, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its group), copy_id (smallest id with
    the same grams), n_links (other documents of similarity ``threshold`` or more, copies included),
    t (xxhash64 of the text), group (the group's name, a digest)."""
    parts = partitions(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    source = spread(source.withColumn("t", F.xxhash64("text")))
    rows = durable(featured(source, gram))
    # Rows of equal sets fold into one class; one of them lends its text.
    classes = durable(rows.groupBy("node").agg(F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "t")).alias("of"), F.first("sig").alias("sig"), F.first("bands").alias("bands")))
    member = classes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = durable(member.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")))
    met = join_unique(member, buckets.drop("n"), ["band", "key"], buckets)
    met = met.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("band", "key", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "node")
    dealt = lambda df: df.repartition(parts, *TASK).sortWithinPartitions(*TASK, "node")
    signs, steps = classes.select("node", "sig", "bands"), least_matches(threshold, tolerance)
    left = durable(dealt(met.join(signs, "node")).mapInArrow(lambda it: alive(sorted_groups(it, TASK), steps), "band int, key long, bi int, bj int, block int, node binary"))
    wanted = left.select("node").distinct().join(classes, "node").select("node", "of.doc_id", "of.t")
    same = F.col("s.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("s.t") == F.col("w.t"))
    texts = source.alias("s").join(wanted.alias("w"), same).select("node", "text").dropDuplicates(["node"])
    work = dealt(left.join(classes.select("node", "sig", "bands", "copies"), "node").join(texts, "node"))
    linked = durable(work.mapInArrow(lambda it: verified(sorted_groups(it, TASK), steps, threshold, gram), "node binary, root binary, links long"))
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    merged = classes.select("node", "copy_id", "copies").join(groups_of(linked), "node", "left").join(links, "node", "left")
    merged = durable(merged.select("node", "copy_id", "copies", F.coalesce("group", "node").alias("group"), F.coalesce("links", F.lit(0)).alias("links")))
    ids = merged.groupBy("group").agg(F.min("copy_id").alias("class_id"))
    known = durable(join_unique(merged, ids, ["group"]).select("node", "group", "copy_id", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n")))
    return join_unique(rows.select("doc_id", "t", "node"), known.drop("n"), ["node"], known.select("node", "n")).select("doc_id", "class_id", "copy_id", "n_links", "t", "group")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the smallest id (null last), then the smallest
    hash of the text. A group is told by its texts, never by its ids; all columns stay as they are."""
    number, stays, text = unused(docs.columns, "number", "stays", "t")
    found = near_duplicates(docs, id_col, text_col, **options)
    rows = found.groupBy("group", "doc_id", "t").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "n"))
    kept = durable(rows.groupBy("group").agg(first.alias("s")).select(F.col("s.doc_id").alias(stays), F.col("s.t").alias(text), F.col("s.n").alias(number)))
    match = F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col(f"k.{stays}")) & (F.xxhash64(f"d.`{text_col}`") == F.col(f"k.{text}"))
    out = docs.alias("d").join(kept.alias("k"), match, "left_semi")
    if not kept.where(F.col(number) > 1).isEmpty():  # rows that repeat both id and text
        out = out.withColumn(text, F.xxhash64(text_col)).dropDuplicates([id_col, text]).drop(text)
    return out


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("t", "group")
