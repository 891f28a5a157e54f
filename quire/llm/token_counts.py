"""Token counts of a unigram vocabulary by count-only Viterbi.

A pre-token is ``\\u2581`` and a word. Aho-Corasick gives all vocabulary pieces that end at each
place; dynamic programming carries, per place, the best sum of scores and the number of pieces on
that path, no back pointers. Tie rule of the tokenizers: a later candidate must be strictly better,
and candidates come in order of their start, so the longest last piece wins. A character that is no
piece itself may also be an unknown one, ten below the lowest score; unknown characters cost their
UTF-8 bytes where the vocabulary falls back to bytes, else a run of them is one token.

A word always gives the same count, so workers keep counts of words in a bounded cache.

No unigram vocabulary is at hand and tokenizers are not trained here. ``zipf`` makes one of a merge
vocabulary: its pieces in order of merging are in order of frequency, nearly, so by Zipf's law the piece
of rank r has a probability proportional to 1 / r. Texts are taken as they are; a model's own
normaliser is not applied.

Defined results: words are runs of ``[^\\x20\\x09-\\x0D]``; a null, empty or white text has 0 tokens
and score 0; repeated rows count alike; a null id keeps its row; no rows give no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._runtime import read_table

MARK = "▁"
UNKNOWN_BELOW = 10.0
CACHE_WORDS = 300_000


def pieces_of(model_path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece model and their scores (sentinel scores are left out)."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    plain = (i for i in range(m.get_piece_size()) if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i)))
    return [(m.id_to_piece(i), m.get_score(i)) for i in plain if m.get_score(i) > -1e8]


def zipf(pieces: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """Pieces of a merge vocabulary (scores fall with the rank) with log probabilities after their ranks."""
    ranked = sorted(pieces, key=lambda x: -x[1])
    total = math.log(sum(1 / r for r in range(1, len(ranked) + 1)))
    return [(piece, -math.log(r) - total) for r, (piece, _) in enumerate(ranked, 1)]


class Viterbi(dict):
    """word -> (tokens, unknown characters, score)."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_BELOW
        self.byte_fallback = byte_fallback

    def __missing__(self, word: str) -> tuple[int, int, float]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = self.count(MARK + word)
        return found

    def count(self, text: str) -> tuple[int, int, float]:
        ends: list[list[tuple[int, float]]] = [[] for _ in range(len(text) + 1)]
        for last, match in self.automaton.iter(text):
            ends[last + 1].append(match)
        score, tokens, unknown, in_run = [0.0], [0], [0], [False]
        for end in range(1, len(text) + 1):
            best, start, single = None, 0, False
            for size, piece in sorted(ends[end], reverse=True):  # the earliest start first
                single = single or size == 1
                candidate = score[end - size] + piece
                if best is None or candidate > best:
                    best, start = candidate, end - size
            lost = False
            if not single:
                candidate = score[end - 1] + self.unknown
                if best is None or candidate > best:
                    best, start, lost = candidate, end - 1, True
            score.append(best)
            if not lost:
                cost = 1
            elif self.byte_fallback:
                cost = len(text[end - 1].encode("utf-8", "surrogatepass"))
            else:
                cost = 0 if in_run[start] else 1
            tokens.append(tokens[start] + cost)
            unknown.append(unknown[start] + lost)
            in_run.append(lost)
        return tokens[-1], unknown[-1], score[-1]


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], byte_fallback: bool = True) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown, score of every row. The vocabulary, of fixed size, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        viterbi = Viterbi(shared.value, byte_fallback)
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for text in b.column("text"):
                words = [w.decode("utf-8", "surrogatepass") for w in (text.as_py() or "").encode("utf-8", "surrogatepass").split()]
                counts = [viterbi[w] for w in words]
                n, unknown, score = map(sum, zip(*counts, strict=True)) if counts else (0, 0, 0.0)
                for column, value in zip(out, (len(words), n, unknown, float(score)), strict=True):
                    column.append(value)
            columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", "n_words", "n_tokens", "n_unknown", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(count, "doc_id long, n_words long, n_tokens long, n_unknown long, score double")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents"), zipf(pieces_of(public_tokenizers.path("piece_bpe_32k.model"))))
