"""Language-model scoring by a subword lattice.

A document is a sequence of words and one end. A word is spelt by the pieces of a fixed vocabulary; the probability of
a spelling is the product of its pieces' weights, and a word's is the sum over all ways to cut it into pieces, found by
a forward recursion in log space. A piece doesn't cross the start of a word, so the recursion runs once for each
distinct word.

The vocabulary's own scores weight the pieces (``piece_weights``). What is learned from the training rows are the
tokens' counts: a token that they hold is one more arc of its lattice, from its start to its end, weighted by its
count less DISCOUNT; the mass so freed, DISCOUNT for each distinct token, goes to the spellings. With c a token's count,
N all and V the distinct training tokens, its probability is

    max(c - DISCOUNT, 0) / N + DISCOUNT * V / N * (sum over its spellings)

and without training rows the sum over its spellings. Words of any kind have a probability, and all sum to 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import stored
from kinloom.llm.token_files import slices

#: Added to a piece's rank in its weight; what a token's count is lessened by.
RANK_OFFSET, DISCOUNT = 10, 0.5
#: Words that a task counts before it hands them on; share of all tokens from which a word is sent to all tasks.
HELD, FREQUENT = 400_000, 2e-5
#: The token that ends each document. It is no word, as words hold no white space.
END = b" "
WORD_START = "▁"
LN10 = float(np.log(10))
#: Multiplier of the polynomial hash of a piece's letters, modulo 2 ** 64; bytes of words that are scored together; letters
#: from which a word is scored by itself.
BASE, TOGETHER, LONG = np.uint64(0x9E3779B97F4A7C15), 400_000, 64


def piece_weights(scores: np.ndarray) -> np.ndarray:
    """Probabilities of pieces from a vocabulary's scores, which only order them: 1 / (rank + RANK_OFFSET), normalised.

    The best score has rank 0; of equal scores the first piece comes first.
    """
    rank = np.empty(len(scores))
    rank[np.argsort(-scores, kind="stable")] = np.arange(len(scores))
    weights = 1 / (rank + RANK_OFFSET)
    return weights / weights.sum()


@dataclass
class Pieces:
    """The usable pieces of a vocabulary: sorted hashes of their texts with their numbers, and one for each byte."""

    hashes: np.ndarray
    numbers: np.ndarray
    byte_numbers: np.ndarray
    log_p: np.ndarray
    log_end: float
    longest: int

    @classmethod
    def of(cls, path: str) -> Pieces:
        """Normal pieces (a word start only at their beginning), byte pieces and the end, weighted by their scores.

        Byte pieces, which stand for what no other piece spells, come after all others; the end comes first.
        """
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts, byte_numbers, scores = {}, np.zeros(256, np.int64), []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_numbers[int(piece[3:5], 16)] = len(scores)
                scores.append(-np.inf)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or WORD_START in piece[1:]):
                texts[piece] = len(scores)
                scores.append(model.get_score(i))
        log_p = np.log(piece_weights(np.array([*scores, np.inf])))
        hashes = np.array([text_hash(t) for t in texts], np.uint64)
        order = np.argsort(hashes)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces have the same hash")
        numbers = np.array(list(texts.values()))[order]
        return cls(hashes[order], numbers, byte_numbers, log_p[:-1], float(log_p[-1]), max(map(len, texts)))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], -1)

    def lattice(self, words: list[str]) -> np.ndarray:
        """Natural log of the summed probability of all spellings of each word.

        Words of equal length go through the recursion together, a long word by itself.
        """
        out = np.zeros(len(words))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            text = WORD_START + WORD_START.join(words[i] for i in own)
            letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(own), n + 1).T.astype(np.uint64)
            if n < LONG:
                out[own] = self._equal(np.ascontiguousarray(letters))
            else:
                out[own] = [self._long(x) for x in letters.T]
        return out

    def _spelt(self, letters: np.ndarray) -> np.ndarray:
        """Log probability of each letter as the pieces of its bytes."""
        distinct, which = np.unique(letters, return_inverse=True)
        of = [self.log_p[self.byte_numbers[list(chr(int(c)).encode("utf-8", "surrogatepass"))]].sum() for c in distinct]
        return np.array(of)[which.reshape(letters.shape)]

    def _equal(self, letters: np.ndarray) -> np.ndarray:
        """letters: a row for each place, a column for each word."""
        n, width = letters.shape
        spelt = self._spelt(letters)
        alpha = np.full((n + 1, width), -np.inf)
        alpha[0] = 0
        for i in range(n):
            alpha[i + 1] = np.logaddexp(alpha[i + 1], alpha[i] + spelt[i])
            h = np.zeros(width, np.uint64)
            for j in range(i, min(n, i + self.longest)):
                h = h * BASE + letters[j] + np.uint64(1)
                piece = self.find(h)
                if len(at := np.flatnonzero(piece >= 0)):
                    alpha[j + 1, at] = np.logaddexp(alpha[j + 1, at], alpha[i, at] + self.log_p[piece[at]])
        return alpha[n]

    def _long(self, letters: np.ndarray) -> float:
        """One word: the pieces that end at each place are found for all places at once, length by length."""
        n, most = len(letters), min(self.longest, len(letters))
        arcs = np.full((n + 1, most), -np.inf)  # by end and length - 1
        h = np.zeros(n, np.uint64)
        for k in range(most):
            h = h[: n - k] * BASE + letters[k:] + np.uint64(1)
            piece = self.find(h)
            arcs[k + 1 :, k] = np.where(piece >= 0, self.log_p[piece], -np.inf)
        arcs[1:, 0] = np.logaddexp(arcs[1:, 0], self._spelt(letters))
        alpha = np.full(n + most, -np.inf)  # places before the start are impossible
        alpha[most - 1] = 0
        for j in range(1, n + 1):
            x = alpha[j - 1 : j - 1 + most][::-1] + arcs[j]
            top = x.max()
            alpha[j + most - 1] = top + np.log(np.exp(x - top).sum())
        return float(alpha[-1])


def text_hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(BASE) + ord(c) + 1) % 2**64
    return h


def tokens_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8."""
    return text.encode().lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c, seen): occurrences in the training rows of docs (text, training), and in all rows.

    Each task sums a bounded number of words before it hands them on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, rest = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            words = list(train.keys() | rest.keys())
            c = pa.array([train[w] for w in words], pa.int64())
            seen = pa.array([train[w] + rest[w] for w in words], pa.int64())
            train.clear()
            rest.clear()
            return pa.record_batch([pa.array(words, pa.binary()), c, seen], names=["word", "c", "seen"])

        for batch in batches:
            for piece, texts in slices(batch, "text"):
                for text, own in zip(texts, piece.column("training").to_pylist(), strict=True):
                    count = train if own else rest
                    count.update(tokens_of(text))
                    count[END] += 1
                if len(train) + len(rest) >= HELD:
                    yield flush()
        yield flush()

    each = docs.select("text", "training").mapInArrow(run, "word binary, c long, seen long")
    return each.groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of words cut and joined to tables of about TOGETHER bytes (one word at least)."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("word")).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = done = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + TOGETHER - size, "right")))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - done
            start, done = stop, int(ends[stop - 1])
            if size >= TOGETHER or start < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def score_words(counts: DataFrame, pieces: Pieces, n: int, v: int) -> DataFrame:
    """(word, c, seen, log_z): the natural log probability of each distinct token, from N and V of the training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in together(batches):
            words, c = batch["word"].to_pylist(), batch["c"].to_numpy()
            z = pieces.lattice([w.decode() for w in words])
            z[[w == END for w in words]] = pieces.log_end
            if n:
                with np.errstate(divide="ignore"):
                    z = np.logaddexp(np.log(np.maximum(c - DISCOUNT, 0) / n), np.log(DISCOUNT * v / n) + z)
            yield from batch.append_column("log_z", pa.array(z)).combine_chunks().to_batches()

    return counts.select("word", "c", "seen").mapInArrow(run, "word binary, c long, seen long, log_z double")


def score_texts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Score docs (doc_id, text, training) by a model of the rows whose training is true.

    Returns doc_id, training, n_tokens (words and one end), n_known (those with c > 0), train_tokens,
    base_score (sum over tokens of log10((c + 1) / (N + V + 1)), where c is the token's count, N all and V the
    distinct tokens of the training rows) and score (log10 of the text's probability under the lattice).

    A null or empty text is its end alone. Null and repeated ids keep their rows; without training rows N and V
    are 0 and the spellings alone count; an empty table gives no rows. Texts and words of any length are scored whole,
    a word in time and memory in proportion to its length. Further columns of docs are not read.

    Words with at least FREQUENT of all tokens, 1 / FREQUENT at most, are sent to all tasks with their scores;
    the occurrences of the others are counted by document and joined by the word, where none is hot.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("key"),
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("training", F.lit(False)).alias("training"),
    )
    counts = stored(count_words(rows), "word-counts")
    total = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
        F.count_if(F.col("c") > 0).alias("v"),
        F.coalesce(F.sum("seen"), F.lit(0)).alias("seen"),
    ).first()
    table = stored(score_words(counts, Pieces.of(vocabulary), total.n, total.v), "word-scores").withColumn(
        "base", F.log10((F.col("c") + 1) / F.lit(float(total.n + total.v + 1)))
    )
    frequent = F.col("seen") >= FREQUENT * max(1, total.seen)
    known = {bytes(r.word): (r.c > 0, r.base, r.log_z / LN10) for r in table.where(frequent).toLocalIterator()}
    sent = spark.sparkContext.broadcast(known)  # 1 / FREQUENT words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, names = sent.value, ["key", "doc_id", "training", "word", "n", "n_known", "base", "score"]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for batch in batches:
            for piece, texts in slices(batch, "text"):
                out = []
                for key, doc_id, training, text in zip(*(piece.column(c).to_pylist() for c in ("key", "doc_id", "training")), texts, strict=True):
                    count = Counter(tokens_of(text))
                    count[END] += 1
                    n_known, base, score = 0, 0.0, 0.0
                    for w, n in count.items():
                        if w in common:
                            a, b, s = common[w]
                            n_known, base, score = n_known + n * a, base + n * b, score + n * s
                        else:
                            out.append((key, None, None, w, n, 0, 0.0, 0.0))
                    # The row of the document itself: no word begins with white space, so it meets none in the join.
                    alone = END + key.to_bytes(8, "little")
                    out.append((key, doc_id, training, alone, sum(count.values()), n_known, base, score))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    fields = "key long, doc_id long, training boolean, word binary, n long, n_known long, base double, score double"
    each = rows.mapInArrow(run, fields)
    others = table.where(~frequent).select("word", "c", F.col("base").alias("word_base"), "log_z")
    own = F.col("training").isNotNull()
    return (
        each.join(others, "word", "left")
        .groupBy("key")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("training").alias("training"),
            F.max(F.when(own, F.col("n"))).alias("n_tokens"),
            F.sum(F.when(own, F.col("n_known")).otherwise(F.when(F.col("c") > 0, F.col("n")).otherwise(0))).alias("n_known"),
            F.lit(total.n).cast("long").alias("train_tokens"),
            F.sum(F.when(own, F.col("base")).otherwise(F.col("n") * F.col("word_base"))).alias("base_score"),
            F.sum(F.when(own, F.col("score")).otherwise(F.col("n") * F.col("log_z") / LN10)).alias("score"),
        )
        .drop("key")
    )
