"""The best references by runs of four letters against all references, however common the runs are."""

from __future__ import annotations

import random

import pytest

from kinloom.operators import blocking
from kinloom.plans import catalogue
from tests.test_whole import HEAD, cosines


def grams(t: str) -> list[str]:
    return [t[i : i + 4] for i in range(len(t) - 3)]


@pytest.mark.parametrize("rows", [2_000, 7])
def test_common_runs_make_candidates_too(spark, tmp_path, monkeypatch, rows):
    r = random.Random(4)
    texts = {i: f"{i:03d} {HEAD} {' '.join(r.choice(['xenon', 'yttrium', 'zinc 😀']) for _ in range(5))}" for i in range(60)}
    texts |= {100 + i: f"{texts[i]} late{i}" for i in range(1, 60, 7)} | {71: "abc", 72: ""}
    docs = [(i, t, "en" if i % 3 else None, "x") for i, t in texts.items()] + [(73, None, "en", "x"), (None, "no id", "en", "x")]
    # An id with two rows has the runs of both.
    docs.append((4, "a second row of the same number", "en", "x"))
    texts[4] += "a second row of the same number"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(blocking.GramCell, "ROWS", rows)
    got = {(x.tid, x.qid): x.score for x in catalogue.queries()["block_char_ngram_whole"](spark, str(tmp_path)).collect()}
    copied = {i - 100 for i in texts if i >= 100}
    targets = [i for i in texts if i >= 100 or i % 5 == 0 and i not in copied and i < 70]
    known = {i: grams(t) if i != 4 else grams(t[: -len("a second row of the same number")]) + grams("a second row of the same number") for i, t in texts.items() if i < 70 or i >= 100}
    all_scores = cosines({i: g for i, g in known.items() if i not in targets}, {i: known[i] for i in targets}, lambda g: g, 2)
    want = {}
    for t in targets:
        for s, q in sorted((-s, q) for (u, q), (s, _) in all_scores.items() if u == t)[:3]:
            want[t, q] = -s
    assert got == pytest.approx(want, abs=1.5e-6) and len(got) == 3 * len(targets) > 50
