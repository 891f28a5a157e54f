"""Toxicity by non-negative positive-unlabelled learning (numpy).

The classifier is logistic over the presence of features: words (runs of letters, lower case) and
their beginnings of ``PREFIXES`` letters, so that inflected forms share evidence. It learns from
confirmed toxic texts (positives) and texts without regard to their label (unlabelled), both samples
taken by hash and bounded by parameters of :func:`train`, with the corrected risk

    R = prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)]);

when the second part turns negative, the step goes up that part instead. Its vocabulary
is made of the features whose share among positives exceeds that among unlabelled texts most surely;
they are counted where the texts are, and only rows of one bit per feature of the vocabulary reach the
driver, so what it holds is bounded in bytes, however long the texts are.

Defined results: null and empty texts score by the bias alone; whole texts are read; repeated rows
score alike; a null id counts as the empty text when folds are drawn; without positives that stand out
every score is 0; no rows give no rows. Extra columns are ignored; labels, lang, source and ids are no input.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._runtime import durable, id_crc, read_table

#: Defaults of :func:`train`: texts in expectation that it fits on, and features (the corpus is always scored whole).
MAX_POSITIVE, MAX_UNLABELLED, VOCABULARY = 4_000, 12_000, 512
PREFIXES = (4, 5, 6)
CACHE_WORDS = 400_000
LETTERS = re.compile(r"[^\W\d_]+")


def word_set(text: str | None) -> set[str]:
    return set(LETTERS.findall((text or "").lower()))


def features(word: str) -> list[int]:
    """Hashes of a word and its beginnings."""
    return [xxhash.xxh32_intdigest(word), *(xxhash.xxh32_intdigest(word[:n], seed=n) for n in PREFIXES if len(word) > n)]


class Model:
    """Weights of features, by hash, and a bias; words are looked up once."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.own: dict[str, tuple[int, ...]] = {}

    def known(self, word: str) -> tuple[int, ...]:
        """The features of a word that have a weight."""
        found = self.own.get(word)
        if found is None:
            if len(self.own) > CACHE_WORDS:
                self.own.clear()
            found = self.own[word] = tuple(f for f in features(word) if f in self.weights)
        return found

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        present = {f for w in word_set(text) for f in self.known(w)}
        z = self.bias + sum(sorted(self.weights[f] for f in present))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def sample(rows: DataFrame, most: int, total: int, seed: int, *by: str) -> DataFrame:
    """``most`` of ``total`` rows in expectation (all, if fewer), by a hash of columns: the same rows at every run."""
    share = min(1.0, most / max(1, total))
    return rows.where(F.pmod(F.xxhash64(*by, F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)))


def feature_counts(texts: DataFrame, name: str) -> DataFrame:
    """feature, and in how many texts it is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"feature": pa.array(list(n), pa.int64()), "n": pa.array(list(n.values()), pa.int64())})
            n.clear()
            return made

        for b in batches:
            for t in b.column("text"):
                n.update({f for w in word_set(t.as_py()) for f in features(w)})
                if len(n) > CACHE_WORDS:
                    yield out()
        if n:
            yield out()

    return texts.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias(name))


def vocabulary_of(positive: DataFrame, unlabelled: DataFrame, n_p: int, n_u: int, most: int) -> np.ndarray:
    """The features most surely commoner among positives, sorted."""
    both = feature_counts(positive, "p").where(F.col("p") >= min(5, n_p)).join(feature_counts(unlabelled, "u"), "feature", "left").na.fill(0, ["u"])
    p, u = F.col("p") / n_p, (F.col("u") + 0.5) / (n_u + 1)
    pooled = (F.col("p") + F.col("u")) / (n_p + n_u)
    z = (p - u) / F.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / max(1, n_u)) + 1e-12)
    best = both.withColumn("z", z).where("z > 3").orderBy(F.desc("z"), "feature").limit(most)
    return np.sort(np.array([r["feature"] for r in best.select("feature").collect()], np.int64))


def matrix(texts: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """One row of zeros and ones for each text, in an order that does not depend on the partitions."""
    at = {int(f): i for i, f in enumerate(vocabulary)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column("text"):
                bits = np.zeros(len(at), bool)
                bits[[at[f] for w in word_set(t.as_py()) for f in features(w) if f in at]] = True
                out.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_pydict({"bits": pa.array(out, pa.binary())})

    found = sorted(bytes(r[0]) for r in texts.select("text").mapInArrow(rows, "bits binary").toLocalIterator())
    packed = np.frombuffer(b"".join(found), np.uint8).reshape(len(found), -1)
    return np.unpackbits(packed, axis=1, count=len(vocabulary)).astype(np.float32)


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss (Adam on the whole sample).

    Small batches would make the second part negative by chance alone and undo what was learnt.
    """
    xp, xu = (np.hstack([x, np.ones((len(x), 1), np.float32)]) for x in (xp, xu))
    w, decay = np.zeros(xp.shape[1]), 0.2 / len(xp)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    for t in range(1, steps + 1):
        zp, zu = (x @ w.astype(np.float32) for x in (xp, xu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        of_negative = sigmoid(zu) @ xu / len(xu) - prior * (sigmoid(zp) @ xp) / len(xp)
        g = -of_negative if negative < 0 else prior * ((sigmoid(zp) - 1) @ xp) / len(xp) + of_negative
        g = g + decay * np.r_[w[:-1], 0.0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, vocabulary: int = VOCABULARY) -> Model:
    """Fit on the rows whose id is not held out (``crc32(id) mod folds`` is 0).

    ``prior`` is the share of toxic texts; by default that among the labelled training rows.
    ``max_positive`` and ``max_unlabelled`` bound the texts it fits on, in expectation.
    """
    usable = docs.where(id_crc("doc_id", folds) != 0).select("doc_id", "text").where(F.col("text").isNotNull())
    toxic = labels.where(id_crc("doc_id", folds) != 0).where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_toxic, n_labelled = toxic.agg(F.count_if(F.col("toxic") == 1), F.count(F.lit(1))).first()
    if not n_toxic:
        return Model({}, 0.0)
    prior = prior if prior is not None else min(max(n_toxic / n_labelled, 1e-4), 0.9)
    # Ids are sampled before their texts are fetched, so what is broadcast is bounded by the sample. Equal texts count once.
    chosen = sample(toxic.where("toxic = 1").select("doc_id"), max_positive, n_toxic, 1, "doc_id")
    positive = durable(usable.join(F.broadcast(chosen), "doc_id", "left_semi").select("text").distinct())
    unlabelled = durable(sample(usable, max_unlabelled, usable.count(), 2, "doc_id", "text").select("text").distinct())
    n_p, n_u = positive.count(), unlabelled.count()
    words = vocabulary_of(positive, unlabelled, n_p, n_u, vocabulary) if n_p and n_u else ()
    if not len(words):
        return Model({}, 0.0)
    w, bias = fit_nnpu(matrix(positive, words), matrix(unlabelled, words), prior)
    return Model(dict(zip(words.tolist(), w.tolist(), strict=True)), bias)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row. What is broadcast is at most as many numbers as the vocabulary has features."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([own.score(t.as_py()) for t in b.column("text")], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``limit`` or more; all columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in batches:
            yield b.filter(pa.array([own.score(t.as_py()) < limit for t in b.column("text")], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    scored = scores(docs, model)
    return scored.select("doc_id", (id_crc("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
