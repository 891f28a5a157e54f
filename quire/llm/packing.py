"""Best-fit packing of tokenised documents into sequences, with a bounded number of open bins.

Documents become ids plus an end id; only those longer than a sequence are cut. Pieces are dealt
by hash into groups of about ``GROUP_SEQUENCES`` sequences, whose number follows the tokens; each
group is packed online: a piece goes to the open bin with the least room that holds it, found in a
bitset keyed by free space; when more than ``OPEN_BINS`` are open, the fullest closes.

Defined results: a null text is empty and gives one piece, the end id; repeated rows are packed
each; a null id is kept; very long texts give many pieces; no rows give no rows. Extra columns are
ignored. ``sequence_id`` numbers sequences inside a group, the group in the high bits.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._runtime import durable, read_table

LENGTH = 2048
OPEN_BINS = 1024
GROUP_SEQUENCES = 2048
#: Entries after which a worker's caches start anew; they bound memory, not what is encoded.
CACHE_WORDS = 400_000
LATIN, SIGNS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f", r"!-&(-/:-@\[-`{-~"
PLAIN, RUNS = re.compile(f"[{LATIN}{SIGNS}]+"), re.compile(f"[{LATIN}]+|[{SIGNS}]+")
#: How byte-level vocabularies write bytes: printable ones as they are, the others from code point 256 on.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = [chr(b) if b in PRINTABLE else chr(256 + sum(x not in PRINTABLE for x in range(b))) for b in range(256)]
NOT_SPACE = frozenset("\x1c\x1d\x1e\x1f")
# The tokenizer settings for which words may be encoded alone and letter runs in lower case.
WORDS_APART = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class WordIds(dict):
    """Word -> its token ids (unsigned 32-bit, little-endian).

    The tokenizer's pattern never crosses white space, so words are encoded alone. Words of Latin
    letters and ASCII punctuation without apostrophes are cut where the pattern cuts them, so that
    a letter run is encoded once whatever its case and the punctuation around it. That holds for
    tokenizers with the settings ``WORDS_APART``; with any others whole texts are encoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.apart = all(settings[k] == v for k, v in WORDS_APART.items()) and settings["model"]["type"] == "BPE" and not settings["model"].get("dropout")
        self.tokenize = self.tokenizer.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces: dict[str, bytes] = {}

    def encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= CACHE_WORDS:
                self.pieces.clear()
            written = "".join([BYTES[b] for b in piece.encode()])
            ids = self.pieces[piece] = array("I", [t.id for t in self.tokenize(written)]).tobytes()
        return ids

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        if PLAIN.fullmatch(word):
            ids = b"".join([self.piece(x.lower()) for x in RUNS.findall(word)])
        else:
            ids = self.encoded(word)
        self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        # split() cuts at some characters where the tokenizer doesn't; its special tokens are found in whole texts.
        if not self.apart or not NOT_SPACE.isdisjoint(text) or any(x in text for x in self.special):
            return self.encoded(text)
        return b"".join(map(self.__getitem__, text.split()))


@functools.cache
def word_ids(path: str) -> WordIds:
    """A worker's encoder, kept from task to task."""
    return WordIds(path)


def pieces_of(docs: DataFrame, tokenizer_path: str, end_id: int, length: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_ids(tokenizer_path).of, array("I", [end_id]).tobytes()
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = encode(text.as_py() or "") + end
                for piece, start in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[start : start + 4 * length]
                    for column, value in zip(out, (doc, piece, start // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """Open bins by free space; bit f of ``bits`` is set while a bin with f free is open."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.bits, self.open, self.by_free, self.next = 0, 0, [[] for _ in range(length + 1)], 0

    def put(self, size: int) -> tuple[int, int]:
        """Place a piece: (bin, offset)."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.length, self.next
            self.next += 1
        if left := free - size:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        return number, self.length - free

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number


def pack_group(pdf: pd.DataFrame, length: int, open_bins: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["order", "doc_id", "piece", "ids_crc32"], kind="stable")
    bins = OpenBins(length, open_bins)
    placed = np.array([bins.put(n) for n in pdf["length"].tolist()], dtype=np.int64).reshape(-1, 2)
    return pdf.assign(sequence_id=(pdf["group"].to_numpy() << 32) + placed[:, 0], offset=placed[:, 1])[[c.split()[0] for c in PACKED.split(", ")]]


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = 0, open_bins: int = OPEN_BINS, group_sequences: int = GROUP_SEQUENCES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = durable(pieces_of(docs, tokenizer_path, end_id, length))
    tokens = pieces.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, round(tokens / (length * group_sequences)))
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = pieces.withColumn("order", order).withColumn("group", F.pmod(F.xxhash64("order"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(lambda pdf: pack_group(pdf, length, open_bins), PACKED)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
