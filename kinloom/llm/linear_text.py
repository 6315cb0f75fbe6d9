"""Hashed indicator features of texts, fitting in one task, and scoring with a linear model, shared by the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.token_files import slices

#: Makes the distinct features of one text, as 32-bit hashes that are equal in every process.
Features = Callable[[str], set[int]]
#: Tokens whose features a worker remembers.
REMEMBERED = 200_000
SAMPLED = "label int, features binary"


@dataclass
class LinearModel:
    """score = 1 / (1 + exp(-scale * (bias + the weights of a text's features)))."""

    weights: dict[int, float]
    bias: float
    scale: float = 1.0

    def score(self, features: set[int]) -> float:
        own = self.weights
        margin = self.bias + sum(own[f] for f in sorted(features & own.keys()))
        return float(1 / (1 + np.exp(-np.clip(self.scale * margin, -500, 500))))


class Memo(dict):
    """Remembers make(key) for a bounded number of keys."""

    def __init__(self, make: Callable) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key):  # noqa: ANN001, ANN204
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = made = self.make(key)
        return made


class Matrix:
    """Rows of hashed features against the columns of a vocabulary: row bounds and column numbers."""

    def __init__(self, rows: list[np.ndarray], vocabulary: np.ndarray) -> None:
        """vocabulary: sorted hashes; features outside it are left out, row by row, so that little is held at once."""
        own = []
        for r in rows:
            at = np.minimum(np.searchsorted(vocabulary, r), max(0, len(vocabulary) - 1))
            own.append(at[vocabulary[at] == r].astype(np.int32) if len(vocabulary) else np.zeros(0, np.int32))
        self.bounds = np.concatenate([[0], np.cumsum([len(c) for c in own], dtype=np.int64)]).astype(np.int64)
        self.column = np.concatenate([*own, np.zeros(0, np.int32)])
        self.owner = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(self.bounds))
        self.shape = len(rows), len(vocabulary)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.column], self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, g[self.owner], self.shape[1])


def counted(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of the rows and in how many rows each is."""
    flat = np.concatenate([*rows, np.zeros(0, np.uint32)])
    flat.sort()
    starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])[: len(flat)])
    return flat[starts], np.diff(np.append(starts, len(flat)))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, features: Features) -> DataFrame:
    """SAMPLED rows, in one partition, of at most ``most`` rows: those of labels (doc_id, label) with the smallest hashes.

    The sample is chosen among the labels alone; their documents are found by a join and turned into features
    where they lie. What meets in one task are the features of at most ``most`` rows, whatever the table's size.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in slices(batch, "text"):
                made = [np.array(sorted(features(t)), "<u4").tobytes() for t in texts]
                yield pa.record_batch(
                    [piece.column("doc_id"), piece.column("label"), pa.array(made, pa.binary())],
                    names=["doc_id", "label", "features"],
                )

    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows of two numbers
        .select("doc_id", "label", "text")
        .mapInArrow(run, "doc_id long, label int, features binary")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "features")
        .limit(most)
        .select("label", "features")
    )


def fit_in_a_task(sample: DataFrame, fit: Callable[[list[np.ndarray], np.ndarray], LinearModel]) -> LinearModel:
    """Fit on a bounded sample (SAMPLED) in one task of an executor; only the weights come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            labels += batch.column("label").to_pylist()
            rows += [np.frombuffer(x, "<u4") for x in batch.column("features").to_pylist()]
        model = fit(rows, np.array(labels, np.int64))
        names = np.fromiter(model.weights.keys(), np.int64, len(model.weights))
        weights = np.fromiter(model.weights.values(), np.float64, len(model.weights))
        blobs = [names.tobytes(), weights.tobytes(), np.array([model.bias, model.scale]).tobytes()]
        yield pa.record_batch([pa.array([x], pa.binary()) for x in blobs], names=["names", "weights", "rest"])

    row = sample.coalesce(1).mapInArrow(run, "names binary, weights binary, rest binary").first()
    if row is None:  # the optimizer knew that there is no row
        return fit([], np.zeros(0, np.int64))
    names, weights, rest = np.frombuffer(row.names, np.int64), np.frombuffer(row.weights), np.frombuffer(row.rest)
    return LinearModel(dict(zip(names.tolist(), weights.tolist(), strict=True)), *rest.tolist())


def score_texts(docs: DataFrame, model: LinearModel, features: Features, keep_text: bool = False) -> DataFrame:
    """Add score to docs, which has a column text; a null text counts as empty. No shuffle.

    The model goes to the workers as one broadcast: weights of features of a bounded sample. A column score that
    docs has already is replaced; any other column is passed on.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for piece, texts in slices(batch, "text"):
                scores = pa.array([model.score(features(t or "")) for t in texts], pa.float64())
                kept = [n for n in piece.schema.names if keep_text or n != "text"]
                columns = [piece.column(piece.schema.get_field_index(n)) for n in kept]
                yield pa.record_batch([*columns, scores], names=[*kept, "score"])

    rows = docs.drop("score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if keep_text or f.name != "text")
    return rows.mapInArrow(run, f"{fields}, score double")
