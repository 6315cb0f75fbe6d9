"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear in indicators of words and word beginnings. It is trained with numpy from confirmed
toxic texts (P) and unlabelled texts (U) by minimising the class-prior-corrected risk

    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))

where R_X(y) is the mean logistic loss on X taken as y. Where the part in max() falls below zero, the step goes
against its gradient, so the model cannot gain by calling every unlabelled text clean.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.linear_text import LinearModel, Matrix, Memo, counted, fit_in_a_task, labelled_sample, score_texts

#: Confirmed toxic and unlabelled rows that a model is fitted on, at most.
POSITIVES, UNLABELLED = 4_000, 12_000
#: What a feature needs to have a weight: confirmed rows that hold it; its lift (log of its share among the confirmed
#: rows over that among the unlabelled) times the root of their number; and its lift, as a share of -log(prior).
LEAST_ROWS, LEAST_STRENGTH, LEAST_LIFT = 3, 3.0, 0.4


def token_features(token: str) -> tuple[int, ...]:
    """Of one lower-cased token between white space: its word and the word's first 4, 5 and 6 letters."""
    word = token.strip("".join(c for c in token if not c.isalpha())) or token
    starts = [f"{word[:n]}*" for n in (4, 5, 6) if len(word) >= n]
    return tuple(xxhash.xxh32_intdigest(x) for x in (word, *starts))


_memo = Memo(token_features)


def features(text: str) -> set[int]:
    return {f for token in set(text.lower().split()) for f in _memo[token]}


def fit_nnpu(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 400, rate: float = 0.05,
    decay: float = 1e-4, beta: float = 0.0, gamma: float = 1.0,
) -> LinearModel:
    """Fit by Adam on whole-sample gradients. Without positives (or a prior of 0) every score is near 0.

    Only features that speak for the confirmed class by LEAST_ROWS, LEAST_STRENGTH and LEAST_LIFT get weights: a
    text is clean unless something in it is known to be toxic.
    """
    if not positive or not unlabelled or prior <= 0:
        return LinearModel({}, -10.0)
    names, in_p = counted(positive)
    u_names, u_count = counted(unlabelled)
    found = np.minimum(np.searchsorted(u_names, names), len(u_names) - 1) if len(u_names) else np.zeros(len(names), int)
    in_u = np.where(u_names[found] == names, u_count[found], 0) if len(u_names) else np.zeros(len(names))
    lift = np.log((in_p + 0.5) / len(positive)) - np.log((in_u + 0.5) / len(unlabelled))
    vocabulary = names[(in_p >= LEAST_ROWS) & (lift * np.sqrt(in_p) > LEAST_STRENGTH) & (lift > LEAST_LIFT * -np.log(prior))]
    p, u = Matrix(positive, vocabulary), Matrix(unlabelled, vocabulary)
    n_p, n_u = len(positive), len(unlabelled)
    w, b = np.zeros(len(vocabulary)), np.log(prior / (1 - prior)) if prior < 1 else 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))

    for t in range(1, rounds + 1):
        z_p, z_u = p.dot(w) + b, u.dot(w) + b
        risk_negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        g_p, g_u = prior * (sigmoid(z_p) - 1) / n_p, sigmoid(z_u) / n_u
        g_minus = -prior * sigmoid(z_p) / n_p
        if risk_negative >= -beta:
            rows_p, rows_u = g_p + g_minus, g_u
        else:
            rows_p, rows_u = -gamma * g_minus, -gamma * g_u
        g = np.append(p.back(rows_p) + u.back(rows_u) + decay * w, rows_p.sum() + rows_u.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return LinearModel({int(k): float(x) for k, x in zip(vocabulary, w, strict=True) if x}, float(b))


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, prior: float) -> LinearModel:
    """Fit from sampled rows: label 1 marks the confirmed ones, 0 the unlabelled."""
    return fit_nnpu([x for x, y in zip(rows, labels, strict=True) if y == 1], [x for x, y in zip(rows, labels, strict=True) if y == 0], prior)


def train(docs: DataFrame, labels: DataFrame) -> LinearModel:
    """Fit from docs (doc_id, text) and labels (doc_id, toxic), in one task of an executor.

    Confirmed toxic: rows with toxic = 1, at most POSITIVES. Unlabelled: the texts of all labelled rows, whatever
    their label, at most UNLABELLED. Of the other labels only their share is used, as the class prior, counted
    over all rows. A null id or label is left out; a document with two labels counts as the smaller; repeated
    rows of docs count each, within the bounds; without labels or texts every score is near 0. A very long text
    is one row of indicators. Further columns of either table are not read.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    toxic = known.where("toxic = 1").select("doc_id", F.lit(1).alias("label"))
    everything = known.select("doc_id", F.lit(0).alias("label"))
    sample = labelled_sample(docs, toxic, POSITIVES, features).unionByName(labelled_sample(docs, everything, UNLABELLED, features))
    return fit_in_a_task(sample, partial(fit_rows, prior=min(prior, 0.99)))


def score(docs: DataFrame, model: LinearModel, keep_text: bool = False) -> DataFrame:
    """Replace text (unless it is kept) by score (0 to 1, higher: toxic likelier) in docs; a null or empty text is scored as empty.

    Every row keeps its place: repeated rows have equal scores, null ids are kept, an empty table gives no rows. A
    text of any length is scored whole. A column named score is replaced, all others are passed on.
    """
    return score_texts(docs, model, features, keep_text)
