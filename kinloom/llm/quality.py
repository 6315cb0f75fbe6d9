"""Quality by a support vector machine over naive Bayes features.

Indicators of n-grams (of token shapes, of repetition, and of how much of the text they make up) are scaled by
the log ratio of their counts in the two classes; a linear hinge-loss model is then fitted by dual coordinate
descent, and mixed with its mean weight.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import pairwise

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.linear_text import LinearModel, Matrix, Memo, counted, fit_in_a_task, labelled_sample, score_texts

#: Labelled rows that a model is fitted on, at most; of these, how many must hold a feature for it to have a weight.
SAMPLE, LEAST_ROWS = 16_000, 3
#: Shares of a text's n-grams from which one more indicator is set.
SHARES = (0.02, 0.05, 0.1, 0.2, 0.4, 0.7)

_letters = (re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"([^\w\s])\1{3,}"))


def token_shape(token: str) -> str:
    """Runs of letters as a, A or Aa, of digits as 0; other characters as they are, at most four alike."""

    def letters(m: re.Match) -> str:
        run = m[0]
        return "A" if run.isupper() else "Aa" if run[0].isupper() else "a"

    return _letters[2].sub(r"\1\1\1\1", _letters[1].sub("0", _letters[0].sub(letters, token)))


_shapes = Memo(token_shape)
_hashes = Memo(xxhash.xxh32_intdigest)


def features(text: str) -> set[int]:
    """1-, 2- and 3-grams of token shapes; a token that repeats the one before is marked as such."""
    tokens = text.split()
    n = len(tokens)
    same = [False, *[a == b for a, b in pairwise(tokens)]]
    shapes = ["=" if s else _shapes[t] for s, t in zip(same, tokens, strict=True)] if tokens else []
    out = {_hashes[f"size {n.bit_length()}"]}
    two = list(zip(shapes, shapes[1:], strict=False))
    for grams in (shapes, two, list(zip(two, shapes[2:], strict=False))):
        for gram, count in Counter(grams).items():
            name = str(gram)
            out.add(_hashes[name])
            for level in SHARES:
                if count < level * len(grams):
                    break
                out.add(_hashes[f"{name} {level}"])
    distinct = len(set(tokens)) / n if n else 1.0
    out.update(_hashes[f"distinct {x}"] for x in range(1, 20) if distinct * 20 >= x)
    return out


def fit_nbsvm(
    rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, mixed: float = 0.25, smoothing: float = 1.0,
    rounds: int = 30,
) -> LinearModel:
    """Fit on rows of features and labels 0 or 1. With one class only, every score leans to it."""
    y = np.where(np.asarray(labels) == 1, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        return LinearModel({}, float(y[0]) if len(y) else 0.0, 2.0)
    names, count = counted(rows)
    x = Matrix(rows, names[count >= LEAST_ROWS])
    positive, negative = x.back((y > 0).astype(float)) + smoothing, x.back((y < 0).astype(float)) + smoothing
    ratio = np.log(positive / positive.sum()) - np.log(negative / negative.sum())
    w, alpha, bias = np.zeros(x.shape[1]), np.zeros(len(y)), 0.0
    columns = [x.column[a:b] for a, b in pairwise(x.bounds)]
    values = [ratio[c] for c in columns]
    norms = np.array([v @ v for v in values]) + 1.0
    weight = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))  # both classes weigh alike
    scale = 1 / np.mean(norms)
    order = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            c, v = columns[i], values[i]
            gradient = y[i] * (w[c] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost * weight[i] * scale)
            if (d := (new - alpha[i]) * y[i]) != 0:
                w[c] += d * v
                bias += d
                alpha[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-9:
            break
    final = ((1 - mixed) * np.abs(w).mean() + mixed * w) * ratio
    margins = x.dot(final)
    bias = _cut(margins, y)
    spread = np.median(np.abs(margins + bias)) or 1.0
    return LinearModel({int(k): float(v) for k, v in zip(names[count >= LEAST_ROWS], final, strict=True) if v}, float(bias), 2.0 / spread)


def _cut(margins: np.ndarray, y: np.ndarray) -> float:
    """The bias after mixing: midway in the widest gap among those with the fewest errors on the sample."""
    order = np.argsort(margins, kind="stable")
    m, t = margins[order], y[order]
    errors = np.concatenate([[0], np.cumsum(t > 0)]) + (t < 0).sum() - np.concatenate([[0], np.cumsum(t < 0)])
    gaps = np.concatenate([[1e-9], np.diff(m), [1e-9]])
    best = max(range(len(errors)), key=lambda i: (-errors[i], gaps[i]))
    below, above = m[max(best - 1, 0)], m[min(best, len(m) - 1)]
    return -(below + above) / 2


def train(docs: DataFrame, labels: DataFrame) -> LinearModel:
    """Fit from docs (doc_id, text) and labels (doc_id, quality), on at most SAMPLE labelled rows, in one task of an executor.

    A null id or label is left out; a document with two labels counts as the smaller; repeated rows of docs count
    each, within the bound; without labels or texts, or with one class only, every score leans to one side. A very
    long text is one row of indicators. Further columns of either table are not read.
    """
    return fit_in_a_task(labelled_sample(docs, labels.select("doc_id", F.col("quality").alias("label")), SAMPLE, features), fit_nbsvm)


def score(docs: DataFrame, model: LinearModel, keep_text: bool = False) -> DataFrame:
    """Replace text (unless it is kept) by score (0 to 1, higher: good likelier) in docs; a null or empty text is scored as empty.

    Every row keeps its place: repeated rows have equal scores, null ids are kept, an empty table gives no rows. A
    text of any length is scored whole. A column named score is replaced, all others are passed on.
    """
    return score_texts(docs, model, features, keep_text)
