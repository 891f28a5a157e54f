"""Language-model scoring with a log-frequency Bloom filter.

Training counts every n-gram of orders 1 to ``ORDER`` of the training texts (in lower case, each
text closed by one end token). Every n-gram, from one occurrence on, is quantised to
``q = 1 + floor(log2(count))`` and the filter gets the keys (n-gram, 1) to (n-gram, q); likewise,
for each context, the sum and the number of n-grams after it. A query probes levels upward until one
is missing; the last found gives the count. With C(h) and T(h) the sum and number of those after h,

    P(w | h) = (c(h w) + (c(h) - C(h) + T(h)) * P(w | shorter h)) / (c(h) + T(h)),

which sums to one up to quantisation: a share for new words goes to the lower order. P(w) is the
base's.

N-grams are dealt by context into segments, whose number follows the bytes read, so that a task's
share of the counts and of the filter stays the same at every size. Filters of at most
``FILTER_BYTES`` are broadcast and probed where the texts are. A larger filter stays in its segments:
a block of texts sends each segment its distinct n-grams and gets levels back, by shuffle; contexts
are read off the n-grams. A segment answers many blocks at once, as blocks and segments both grow in
number with the corpus and work for each pair of them would grow with its square. Both ways give
the same scores; nothing is left out of either.

The exact base score needs each token's exact count. Words of at least ``HEAVY`` of the tokens
(at most 1 / HEAVY of them, 16 bytes each) are broadcast; a block's distinct others travel, as 64-bit
hashes packed by segment, to the segment's counts, which come back.

Defined results: words are told apart by 64-bit hashes; a null text is empty and has one token, the
end; words that only look like the end token are ordinary words; a null id counts as the empty text
when folds are drawn; repeated rows score alike; an empty training set gives N = 0 and all words
unknown; no rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._runtime import durable, id_crc, read_table, spread
from ._words import MIX_1, STEP, mixed, slices, word_hashes

ORDER = 2
HEAVY = 2.0**-21
BITS_PER_KEY, PROBES = 10, 5
#: A segment per so many bytes of text, in powers of two, 2^SEGMENT_BITS at least; CONTEXT_BITS of a key are its context.
SEGMENT_BITS, MOST_BITS, SEGMENT_BYTES, CONTEXT_BITS = 6, 24, 1 << 25, 40
#: A filter of up to so many bytes is broadcast.
FILTER_BYTES = 144_000_000
ADD = 0.1
END = np.uint64(0x5EED0FE2D0000001)  # the end token's hash
#: Bytes of text that are hashed, that are counted and that are scored at once.
CHUNK_BYTES, FLUSH_BYTES, BLOCK_BYTES = 1 << 20, 1 << 24, 1 << 23
#: Keys that are probed, that a segment answers and that it sums at once (more, if one row has more).
PROBED, ANSWERED, MERGED = 1 << 16, 1 << 18, 1 << 22
#: Kinds of keys in the filter besides the orders: what follows a context, summed and by number of words.
FOLLOWED, FOLLOWERS = 64, 128
KINDS = [1, *(k + n for n in range(2, ORDER + 1) for k in (0, FOLLOWED, FOLLOWERS))]


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts, one after the other (words, A-Z in lower case, and the end), each token's place in its text, and the texts' sizes."""
    words, n = word_hashes(column, lower=True)
    sizes = n + 1
    ends = np.cumsum(sizes)
    h = np.empty(len(words) + len(n), np.uint64)
    word = np.ones(len(h), bool)
    word[ends - 1] = False
    h[word], h[ends - 1] = words, END
    return h, np.arange(len(h)) - np.repeat(ends - sizes, sizes), sizes


def context_of(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` tokens up to each position."""
    out = h[at - (n - 1)]
    for i in range(n - 2, -1, -1):
        out = mixed(out + STEP) ^ h[at - i]
    return mixed(out + np.uint64(n + 1))


def split_context(context: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A context's segment, and its bits in keys."""
    return (context >> np.uint64(64 - bits)).astype(np.int64), (context << np.uint64(bits)) >> np.uint64(64 - CONTEXT_BITS)


def keys_of(h: np.ndarray, place: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments and keys of the n-grams that end at each position and lie inside one text; the positions."""
    if n == 1:
        key = mixed(h + STEP)
        return (key >> np.uint64(64 - bits)).astype(np.int64), key, np.arange(len(h))
    at = np.flatnonzero(place >= n - 1)
    segment, rest = split_context(context_of(h, at - 1, n - 1), bits)
    return segment, (rest << np.uint64(64 - CONTEXT_BITS)) | (mixed(h[at]) >> np.uint64(CONTEXT_BITS)), at


def segment_bits(n_bytes: int) -> int:
    """Bits of a segment's number for so many bytes of text."""
    return min(max(SEGMENT_BITS, (max(n_bytes - 1, 0) // SEGMENT_BYTES).bit_length()), MOST_BITS)


SQUEEZE, UNSQUEEZE = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(values: np.ndarray) -> bytes:
    """Numbers, bytes of like weight together, so that those that sorted ones share compress away."""
    return SQUEEZE.compress(np.ascontiguousarray(values).view("u1").reshape(-1, values.itemsize).T.tobytes())


def unpacked(data: bytes | None, kind: str = "<u8") -> np.ndarray:
    if data is None:
        return np.empty(0, kind)
    return np.ascontiguousarray(np.frombuffer(UNSQUEEZE.decompress(data), "u1").reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def key_blobs(parts: list[tuple[np.ndarray, np.ndarray]], order: int, bits: int) -> Iterator[tuple]:
    """Counted keys by segment: (order, segment, keys, counts, number)."""
    segment, key = (np.concatenate(x) for x in zip(*parts, strict=True))
    # Stable sorts of 16-bit numbers are radix sorts; then each segment's keys are sorted alone.
    by = np.argsort(segment.astype(np.uint16) if bits <= 16 else segment, kind="stable")
    segment, key = segment[by], key[by]
    edges = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1], True])
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        part, n = np.unique(key[i:j], return_counts=True)
        yield order, int(segment[i]), packed(part), packed(n.astype("<u4")), len(part)


BLOB = pa.schema([("ord", pa.int32()), ("segment", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("n", pa.int64())])
BLOB_SQL = "ord int, segment int, keys binary, counts binary, n long"


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def counted(docs: DataFrame, order: int, bits: int) -> DataFrame:
    """Blobs of the n-gram keys of orders 1 to ``order`` and their counts, as tasks gather them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {n: [] for n in range(1, order + 1)}
        held = 0

        def flush() -> pa.RecordBatch:
            rows = [r for n, p in parts.items() if p for r in key_blobs(p, n, bits)]
            for p in parts.values():
                p.clear()
            return batch_of(rows, BLOB)

        for b in batches:
            for _, some in slices(b.column("text"), CHUNK_BYTES):
                h, place, _ = tokens(some)
                for n, p in parts.items():
                    segment, key, _ = keys_of(h, place, n, bits)
                    if len(key):
                        p.append((segment.astype(np.uint32), key))
                held += 8 * len(h)
                if held >= FLUSH_BYTES:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(count, BLOB_SQL)


def level_of(n: np.ndarray) -> np.ndarray:
    """1 + floor(log2(n)), exactly."""
    return np.frexp(n.astype(np.float64))[1].astype("u1")


#: Middle (by ratio) of the counts of each level.
MIDDLE = np.r_[0.0, np.sqrt(2.0 ** np.arange(64) * (2.0 ** np.arange(1, 65) - 1))]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.argsort(key)
    key, n = key[by], n[by]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[starts], np.add.reduceat(n, starts)


def added(pdf, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of one order and their counts, summed over blobs, in order of key."""
    own = pdf[pdf["ord"] == order]
    parts, held, kept = [], 0, 0
    for keys, counts, n in zip(own["keys"], own["counts"], own["n"], strict=True):
        parts.append((unpacked(keys), unpacked(counts, "<u4").astype(np.int64)))
        held += n
        if held >= max(2 * kept, MERGED):
            parts = [merged(parts)]
            held = kept = len(parts[0][0])
    return merged(parts) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))


def leveled(pdf, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Kinds, keys and levels of one segment: its n-grams and what follows each of its contexts."""
    for o in range(1, order + 1):
        key, n = added(pdf, o)
        yield o, key, level_of(n)
        if o > 1 and len(key):
            context = key >> np.uint64(64 - CONTEXT_BITS)
            starts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
            yield FOLLOWED + o, context[starts], level_of(np.add.reduceat(n, starts))
            yield FOLLOWERS + o, context[starts], level_of(np.diff(np.r_[starts, len(key)]))


def bits_of(kinds: list[tuple[int, np.ndarray, np.ndarray]], per_key: int = BITS_PER_KEY) -> np.ndarray:
    """The bytes of one segment of the filter."""
    n = sum(int(level.sum(dtype=np.int64)) for _, _, level in kinds)
    size = max(1, -(-n * per_key // 64)) * 64
    flags = np.zeros(size, bool)
    for kind, key, level in kinds:
        for q in range(1, int(level.max(initial=0)) + 1):
            one, two = probe_hashes(kind, key[level >= q], q)
            for i in range(PROBES):
                flags[places(one, two, i, size)] = True
    return np.packbits(flags, bitorder="little")


def probe_hashes(kind: int, key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    one = mixed(key ^ np.uint64((kind * 1024 + level) * int(STEP) % (1 << 64)))
    return one, mixed(one ^ MIX_1) | np.uint64(1)


def places(one: np.ndarray, two: np.ndarray, i: int, size) -> np.ndarray:
    """The ``i``-th probe of each key among ``size`` (below 2^32) bits."""
    return (((one + np.uint64(i) * two) >> np.uint64(32)) * (np.uint64(size) if np.isscalar(size) else size)) >> np.uint64(32)


SEGMENT_SQL = "segment int, bits binary, keys binary, counts binary, n long, tokens long"


def segments_of(blobs: DataFrame, order: int = ORDER) -> DataFrame:
    """Per segment: its slice of the filter; the keys of its words, sorted, and their exact counts."""
    import pandas as pd

    per_key = BITS_PER_KEY

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        key, n = added(pdf, 1)
        bits = bits_of(list(leveled(pdf, order)), per_key)
        row = (int(pdf["segment"].iloc[0]), bits.tobytes(), packed(key), packed(n.astype("<i8")), len(key), int(n.sum()))
        return pd.DataFrame([row], columns=["segment", "bits", "keys", "counts", "n", "tokens"])

    return blobs.groupBy("segment").applyInPandas(make, SEGMENT_SQL)


class LogBloom:
    """A Bloom filter of (kind, key, level); each segment has its own slice of bytes."""

    def __init__(self, slices: dict[int, np.ndarray], bits: int):
        self.bits = np.concatenate([slices[s] for s in sorted(slices)]) if slices else np.zeros(1, np.uint8)
        self.sizes, self.starts = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)
        at = 0
        for s in sorted(slices):
            self.starts[s], self.sizes[s] = at, 8 * len(slices[s])
            at += len(slices[s])

    def has(self, kind: int, segment: np.ndarray | None, key: np.ndarray, level: int) -> np.ndarray:
        """Positions of the keys that are there; without ``segment`` all are in segment 0."""
        one, two = probe_hashes(kind, key, level)
        size, start = (self.sizes[0], self.starts[0]) if segment is None else (self.sizes[segment], self.starts[segment])
        live = None
        for i in range(PROBES):
            at = places(one, two, i, size)
            hit = (self.bits[start + (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            if live is None:
                hit &= size > 0
            new = np.flatnonzero(hit)
            live = new if live is None else live[new]
            one, two = one[new], two[new]
            if segment is not None:
                size, start = size[new], start[new]
        return live

    def levels(self, kind: int, segment: np.ndarray | None, key: np.ndarray) -> np.ndarray:
        """Levels are probed upward until one is missing; the last found, or 0."""
        level = np.zeros(len(key), "u1")
        for first in range(0, len(key), PROBED):
            live, q = np.arange(first, min(first + PROBED, len(key))), 1
            while len(live) and q < len(MIDDLE):
                live = live[self.has(kind, None if segment is None else segment[live], key[live], q)]
                level[live] = q
                q += 1
        return level

    def count(self, kind: int, segment: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Estimates: the middle (by ratio) of the level, or 0."""
        return MIDDLE[self.levels(kind, segment, key)]


def runs(segment: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(segment, first, end) of each run of equal numbers."""
    edges = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1], True]) if len(segment) else np.zeros(1, np.int64)
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(segment[i]), i, j


class Asked:
    """Stands in for a filter's counts and writes down the n-grams that are asked, by segment and order.

    Words and contexts are not written down: the words are asked for their exact counts anyway, and
    the n-grams' keys hold their contexts.
    """

    def __init__(self):
        self.keys: dict[int, dict[int, np.ndarray]] = {}

    def __call__(self, kind: int, segment: np.ndarray, key: np.ndarray) -> np.ndarray:
        if 1 < kind < FOLLOWED:
            for s, i, j in runs(segment):
                self.keys.setdefault(s, {})[kind] = key[i:j]
        return np.zeros(len(key))


class Given:
    """Gives a segment's answers (see :func:`answers_to`) when the same is asked again in the same order."""

    def __init__(self, answers: dict[int, np.ndarray]):
        self.answers, self.at = answers, dict.fromkeys(answers, 0)

    def __call__(self, kind: int, segment: np.ndarray, key: np.ndarray) -> np.ndarray:
        level = np.zeros(len(key), "u1")
        for s, i, j in runs(segment):
            level[i:j] = self.answers[s][self.at[s] : self.at[s] + j - i]
            self.at[s] += j - i
        return MIDDLE[level]


class Model:
    """What scoring needs: exact counts of heavy words (by key), corpus totals, and the filter, if it is broadcast."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, n_tokens: int, vocabulary: int, bits: int, bloom: LogBloom | None):
        self.keys, self.counts, self.tokens, self.vocabulary, self.bits, self.bloom = keys, counts, n_tokens, vocabulary, bits, bloom

    @property
    def denominator(self) -> float:
        return max(self.tokens + ADD * (self.vocabulary + 1), ADD)

    def exact(self, key: np.ndarray) -> np.ndarray:
        """Exact counts of words by key; -1 if not heavy."""
        return looked_up(self.keys, self.counts, key, -1)


def looked_up(keys: np.ndarray, values: np.ndarray, key: np.ndarray, none: int) -> np.ndarray:
    """Values of ``key`` in a table sorted by ``keys``."""
    if not len(keys):
        return np.full(len(key), none, np.int64)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[at] == key, values[at], none)


def light_words(key: np.ndarray, exact: np.ndarray) -> np.ndarray:
    """Positions of the words without an exact count, in order of key, which is also that of segments."""
    rare = np.flatnonzero(exact < 0)
    return rare[np.argsort(key[rare])]


def distinct_keys(segment: np.ndarray, key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The position of one of each distinct (segment, key), in that order, and which of them each is."""
    by = np.argsort(key)
    by = by[np.argsort(segment[by].astype(np.uint16 if bits <= 16 else np.uint32), kind="stable")]
    k, s = key[by], segment[by]
    new = np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])] if len(by) else np.zeros(0, bool)
    which = np.empty(len(by), np.int64)
    which[by] = np.cumsum(new) - 1
    return by[new], which


def logs(distinct: np.ndarray, back: np.ndarray, place: np.ndarray, exact: np.ndarray, denominator: float, bits: int, count) -> np.ndarray:
    """log10 P of each token. ``distinct``: hashes of the distinct words, ``back``: which of them a
    token is, ``exact``: their counts, see :meth:`Model.exact`; ``count(kind, segments, keys)``
    gives the filter's estimates for distinct keys in order of segment and key, and what is asked does
    not depend on what it gives."""
    h = distinct[back]
    guess, (segment, key, _) = exact.astype(np.float64), keys_of(distinct, np.zeros(len(distinct), np.int64), 1, bits)
    rare = light_words(key, exact)
    guess[rare] = count(1, segment[rare], key[rare])
    p = (guess[back] + ADD) / denominator
    # Each distinct n-gram is looked up once; ``which`` and ``times`` are those of the lower order and their counts.
    which, times = back, guess
    for n in range(2, ORDER + 1):
        segment, key, at = keys_of(h, place, n, bits)
        first, inverse = distinct_keys(segment, key, bits)
        segment, key, first = segment[first], key[first], at[first]
        context = key >> np.uint64(64 - CONTEXT_BITS)
        new = np.r_[True, (context[1:] != context[:-1]) | (segment[1:] != segment[:-1])] if len(key) else np.zeros(0, bool)
        own = np.cumsum(new) - 1
        followed = count(FOLLOWED + n, segment[new], context[new])[own]
        followers = count(FOLLOWERS + n, segment[new], context[new])[own]
        before = np.maximum(times[which[first - 1]], 1.0)
        # A context without followers was found by chance.
        followed = np.where(followers > 0, np.minimum(followed, before), 0.0)
        seen = count(n, segment, key)
        # Words that share an n-gram's key keep their own P of the lower order.
        p[at] = (np.minimum(seen, followed)[inverse] + (before - followed + followers)[inverse] * p[at]) / (before + followers)[inverse]
        which, times = np.zeros(len(h), np.int64), seen
        which[at] = inverse
    return np.log10(p)


def per_text(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over texts; every text has a token."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(values) else np.zeros(0)


def settled_alone(df: DataFrame) -> DataFrame:
    """:func:`durable`; the shuffle files that led there are removed, as nothing reads them again."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        return durable(df.select("*"))
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def train(docs: DataFrame, folds: int = 10) -> tuple[Model, DataFrame]:
    """The model of the texts whose id is not held out, and its segments (exact counts and slices of the filter)."""
    training = docs.where(id_crc("doc_id", folds) != 0)
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = segment_bits(n_bytes)
    segments = settled_alone(segments_of(counted(training, ORDER, bits)))
    total, vocabulary, size = segments.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("tokens"), F.col("n"), F.length("bits")))).first()
    parts = [(np.frombuffer(bytes(r["k"]), "<u8"), np.frombuffer(bytes(r["c"]), "<i8")) for r in segments.select("keys", "counts").mapInArrow(heavy_in(total * HEAVY), "k binary, c binary").collect()]
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
    by = np.argsort(keys)
    bloom = None
    if size <= FILTER_BYTES:
        bloom = LogBloom({r["segment"]: np.frombuffer(bytes(r["bits"]), np.uint8) for r in segments.select("segment", "bits").toLocalIterator()}, bits)
    return Model(keys[by], counts[by], total, vocabulary, bits, bloom), segments


def heavy_in(least: float):
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for keys, counts in zip(b.column("keys"), b.column("counts"), strict=True):
                key, n = unpacked(keys.as_py()), unpacked(counts.as_py(), "<i8")
                rows.append((key[n >= least].tobytes(), n[n >= least].tobytes()))
            if rows:
                yield batch_of(rows, pa.schema([("k", pa.binary()), ("c", pa.binary())]))

    return pick


#: A block's own row has segment -1 and its ids, sizes and sums. If the filter is broadcast, ``tokens`` are its light tokens (as
#: numbers of its light words); else all tokens, as numbers of its words, which ``keys`` holds. Rows of other segments hold the
#: block's light words there and, for a filter that is not broadcast, its n-grams, ``n_asked`` of each order from 2 on.
BLOCK = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("segment", pa.int32()), ("keys", pa.binary()), ("asked", pa.binary()), ("n_asked", pa.list_(pa.int64())), ("tokens", pa.binary()),
    ("doc_id", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("n_light", pa.list_(pa.int64())), ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("score", pa.list_(pa.float64())),
])
BLOCK_SQL = "part int, block int, segment int, keys binary, asked binary, n_asked array<long>, tokens binary, doc_id array<long>, n_tokens array<long>, n_light array<long>, known array<long>, base array<double>, score array<double>"


def light_tokens(back: np.ndarray, sizes: np.ndarray, exact: np.ndarray, light: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that are light words, as numbers of those, and how many each text has."""
    number = np.zeros(len(exact), np.int64)
    number[light] = np.arange(len(light))
    rare = exact[back] < 0
    return number[back[rare]], per_text(rare.astype(np.int64), sizes)


def block_rows(ids: list, column: pa.Array, part: int, block: int, model: Model) -> list[tuple]:
    h, place, sizes = tokens(column)
    distinct, back = np.unique(h, return_inverse=True)
    key = mixed(distinct + STEP)
    counts = model.exact(key)
    asked = Asked()
    score = per_text(logs(distinct, back, place, counts, model.denominator, model.bits, model.bloom.count if model.bloom else asked), sizes)
    heavy = counts >= 0
    base = per_text(np.where(heavy, np.log10((np.maximum(counts, 0) + ADD) / model.denominator), 0.0)[back], sizes)
    known = per_text(heavy.astype(np.int64)[back], sizes)
    light = light_words(key, counts)
    rare = key[light]
    rows = {s: [part, block, s, packed(rare[i:j]), *[None] * 9] for s, i, j in runs((rare >> np.uint64(64 - model.bits)).astype(np.int64))}
    for s, keys in asked.keys.items():
        row = rows.setdefault(s, [part, block, s, *[None] * 10])
        keys = [keys.get(n, np.empty(0, np.uint64)) for n in range(2, ORDER + 1)]
        row[4], row[5] = packed(np.concatenate(keys)), np.array([len(k) for k in keys])
    if model.bloom:
        some, n_light = light_tokens(back, sizes, counts, light)
        own = (part, block, -1, None, None, None, packed(some.astype("<u4")), ids, sizes, n_light, known, base, score)
    else:
        # What is needed to score the block when the answers are there.
        own = (part, block, -1, packed(distinct), None, None, packed(back.astype("<u4")), ids, sizes, None, known, base, None)
    return [own, *rows.values()]


def scored_blocks(docs: DataFrame, model: Model) -> DataFrame:
    """Per block of texts: its own row, and by segment what it needs from there."""
    # A broadcast filter needs memory that blocks then leave to it.
    shared, most = docs.sparkSession.sparkContext.broadcast(model), BLOCK_BYTES // 2 if model.bloom else BLOCK_BYTES

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        for b in batches:
            for first, some in slices(b.column("text"), most):
                yield batch_of(block_rows(b.column("doc_id").slice(first, len(some)).to_pylist(), some, part, block, shared.value), BLOCK)
                block += 1

    return docs.mapInArrow(score, BLOCK_SQL)


ANSWER_SQL = "part int, block int, segment int, counts binary, levels binary"


def cut(values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """``values`` in pieces of ``sizes``."""
    ends = np.cumsum(sizes).tolist()
    return [values[j - n : j] for n, j in zip(sizes, ends, strict=True)]


def answers_to(rows: list[tuple[np.ndarray, list[np.ndarray]]], keys: np.ndarray, counts: np.ndarray, bloom: LogBloom | None) -> list[tuple[bytes, bytes | None]]:
    """One segment's answers to rows of blocks (light words; n-grams of each order from 2 on), all rows
    looked up together: the words' exact counts, and levels: of the words, then, order by order, of
    what follows the n-grams' contexts and of the n-grams."""
    sizes = [len(words) for words, _ in rows]
    words = np.concatenate([words for words, _ in rows])
    exact = cut(looked_up(keys, counts, words, 0).astype("<i8"), sizes)
    if bloom is None:
        return [(packed(x), None) for x in exact]
    levels = [cut(bloom.levels(1, None, words), sizes)]
    for i in range(len(rows[0][1])):
        sizes = [len(asked[i]) for _, asked in rows]
        key = np.concatenate([asked[i] for _, asked in rows])
        ends = np.cumsum(sizes)
        context = key >> np.uint64(64 - CONTEXT_BITS)
        new = np.zeros(len(key) + 1, bool)
        new[1:-1] = context[1:] != context[:-1]
        new[ends - sizes] = True
        new = new[:-1]
        upto = np.r_[0, np.cumsum(new)]
        each = (upto[ends] - upto[ends - sizes]).tolist()
        context = context[new]
        levels += [cut(bloom.levels(FOLLOWED + i + 2, None, context), each), cut(bloom.levels(FOLLOWERS + i + 2, None, context), each), cut(bloom.levels(i + 2, None, key), sizes)]
    return [(packed(x), packed(np.concatenate(own))) for x, own in zip(exact, zip(*levels, strict=True), strict=True)]


def answered(blocks: DataFrame, segments: DataFrame, model: Model) -> DataFrame:
    """Per block and segment: the exact counts of its light words there, and the levels of what it asks for."""
    import pandas as pd

    with_filter, orders = model.bloom is None, ORDER - 1
    held = blocks.where("segment >= 0").select("part", "block", "segment", "keys", "asked", "n_asked")
    table = segments.select("segment", F.col("keys").alias("known_keys"), "counts", *(["bits"] if with_filter else []))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known, counts = (unpacked(right[c].iloc[0] if len(right) else None, kind) for c, kind in (("known_keys", "<u8"), ("counts", "<i8")))
        bloom = LogBloom({0: np.frombuffer(right["bits"].iloc[0], np.uint8)} if len(right) else {}, 1) if with_filter else None
        out, rows, n_held = [], [], 0
        for keys, asked, sizes in zip(left["keys"], left["asked"], left["n_asked"], strict=True):
            rows.append((unpacked(keys), cut(unpacked(asked), [0] * orders if asked is None else sizes.tolist())))
            n_held += len(rows[-1][0]) + sum(map(len, rows[-1][1]))
            if n_held >= ANSWERED:
                out += answers_to(rows, known, counts, bloom)
                rows, n_held = [], 0
        if rows:
            out += answers_to(rows, known, counts, bloom)
        return pd.DataFrame({"part": left["part"], "block": left["block"], "segment": left["segment"], "counts": [x for x, _ in out], "levels": [x for _, x in out]})

    return held.groupBy("segment").cogroup(table.groupBy("segment")).applyInPandas(meet, ANSWER_SQL)


DOCUMENT_SQL = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def finished(blocks: DataFrame, answers: DataFrame, model: Model) -> DataFrame:
    """Rows of documents, from each block's own row and the answers to it."""
    import pandas as pd

    late, denominator, bits = model.bloom is None, model.denominator, model.bits
    shared = blocks.sparkSession.sparkContext.broadcast((model.keys, model.counts) if late else None)
    own = blocks.where("segment = -1").select("part", "block", "keys", "tokens", "doc_id", "n_tokens", "n_light", F.col("known").alias("sure"), F.col("base").alias("part_base"), "score")

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block = left.iloc[0]
        base, known, sizes = np.array(block["part_base"], np.float64), np.array(block["sure"], np.int64), np.asarray(block["n_tokens"], np.int64)
        right = right.sort_values("segment")
        found = np.concatenate([np.empty(0, np.int64), *(unpacked(x, "<i8") for x in right["counts"])])
        score, some, n_light = block["score"], unpacked(block["tokens"], "<u4").astype(np.int64), block["n_light"]
        if late:
            heavy, distinct, back = Model(*shared.value, 0, 0, bits, None), unpacked(block["keys"]), some
            key = mixed(distinct + STEP)
            exact = heavy.exact(key)
            place = np.arange(len(back)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            given = Given({s: unpacked(x, "u1") for s, x in zip(right["segment"], right["levels"], strict=True)})
            score = per_text(logs(distinct, back, place, exact, denominator, bits, given), sizes)
            some, n_light = light_tokens(back, sizes, exact, light_words(key, exact))
        doc = np.repeat(np.arange(len(sizes)), n_light)
        base += np.bincount(doc, np.log10((found + ADD) / denominator)[some], len(sizes))
        known += np.bincount(doc[found[some] > 0], minlength=len(sizes))
        ids = pd.array([None if x is None or x != x else int(x) for x in block["doc_id"]], dtype="Int64")
        return pd.DataFrame({"doc_id": ids, "n_tokens": sizes, "n_known": known, "base_score": base, "score": np.asarray(score, np.float64)})

    return own.groupBy("part", "block").cogroup(answers.groupBy("part", "block")).applyInPandas(finish, DOCUMENT_SQL)


def score_documents(docs: DataFrame, folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    model, segments = train(docs, folds)
    blocks = durable(scored_blocks(docs, model))
    rows = finished(blocks, settled_alone(answered(blocks, segments, model)), model)
    return rows.select("doc_id", (id_crc("doc_id", folds) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))
