"""The best references of cells against all candidates, and how many rows leave a cell."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from kinloom.operators import blocking, compete
from kinloom.plans import catalogue, fixtures


def frames(spark, fields, seed=1):
    r = random.Random(seed)
    sides = {}
    for name, n, first in (("q", 70, 0), ("t", 110, 1000)):
        sides[name] = [(first + i, r.choice("xy"), [[f"{f}{int(r.paretovariate(0.6))}" for _ in range(r.randint(0, 9))] for f in range(fields)]) for i in range(n)]
    sides["t"].append((5000, "only here", [["00"]] * fields))
    sides = {k: [(i, co, [sorted(set(x)) for x in h]) for i, co, h in v] for k, v in sides.items()}
    out = []
    for k in ("q", "t"):
        df = spark.createDataFrame(sides[k], "id long, co string, words array<array<string>>").repartition(3)
        out.append(df.select("id", "co", F.array(*[blocking.hashed(F.col("words")[f], f) for f in range(fields)]).alias("h")))
    return sides, *out


def plain(sides, fields, least, k):
    """field_idf() and the k best of all candidates."""
    out = {}
    for co in "xy":
        q, t = ([(i, h) for i, c, h in sides[s] if c == co] for s in "qt")
        n, df, df1 = len(q) + len(t), {}, {}
        for rows, counts in ((q + t, df), (q, df1)):
            for _, h in rows:
                for f, words in enumerate(h):
                    for w in words:
                        counts[f, w] = counts.get((f, w), 0) + 1
        idf = {x: math.log((n + 1) / (c + 1)) + 1 for x, c in df.items()}
        most = max(least, min(2000, len(q) * 3 // 100))

        def weights(h):
            v = [{w: idf[f, w] for w in words} for f, words in enumerate(h)]
            return [{w: x / math.sqrt(sum(y * y for y in p.values())) for w, x in p.items()} for p in v]

        for i, h in t:
            a, best = weights(h), []
            for j, g in q:
                if any(df1.get((f, w), 0) <= most and w in g[f] for f in range(fields) for w in h[f]):
                    b = weights(g)
                    cos = [round(sum(x * b[f].get(w, 0) for w, x in a[f].items()), 6) for f in range(fields)]
                    best.append((-round(sum(cos), 6), j, cos))
            for s, j, cos in sorted(best)[:k]:
                out[i, j] = [*cos, -s]
    return out


@pytest.mark.parametrize("most, least_parts", [(40_000, 1), (9, 1), (40_000, 3)])
def test_best_in_cells_are_those_of_all_candidates(spark, most, least_parts):
    sides, q, t = frames(spark, 2)
    got = blocking.best_in_cells(t, q, blocking.field_idf(q, t, 4), 3, most, least_parts)
    got = {(r.tid, r.qid): [*r.cosines, r.score] for r in got.collect()}
    want = plain(sides, 2, 4, 3)
    assert got.keys() == want.keys() and len(want) > 100
    for key, x in want.items():
        assert got[key] == pytest.approx(x, abs=1.5e-6)


def test_repeated_ids_are_one_row(spark):
    rows = spark.createDataFrame([(1, "x", [[1, 2], [9]]), (1, "x", [[2, 3], []]), (1, "y", [[4], [4]])], "id long, co string, h array<array<bigint>>")
    got = {(r.id, r.co): [sorted(x) for x in r.h] for r in blocking.rows_by_id(rows).collect()}
    assert got == {(1, "x"): [[1, 2, 3], [9]], (1, "y"): [[4], [4]]}


def test_only_the_best_of_a_cell_move(spark, tmp_path, monkeypatch):
    rows = spark.range(400).selectExpr("id AS c_custkey", "1 AS c_nationkey")
    rows.write.parquet(f"{tmp_path}/customer.parquet")
    seen = []
    plain_top = compete.top_k
    monkeypatch.setattr(compete, "top_k", lambda df, *a: seen.append(df.count()) or plain_top(df, *a))
    catalogue.queries()["block_skeleton"](spark, str(tmp_path)).count()
    assert len(seen) == 1 and seen[0] <= 800 * 5


def test_only_the_best_of_whole_texts_move(spark, tmp_path, monkeypatch):
    rows = [(i, f"{i:060d} " + " ".join(f"w{(i * j) % 60}" for j in range(1, 40)), "en", "x") for i in range(400)]
    rows += [(400 + i, f"{t} late", co, source) for i, t, co, source in rows[:100]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    plain_top = compete.top_k
    monkeypatch.setattr(compete, "top_k", lambda df, *a: seen.append(df.count()) or plain_top(df, *a))
    monkeypatch.setattr(blocking, "share_cap", lambda n, least=1: n)
    got = catalogue.queries()["block_token_tfidf_whole"](spark, str(tmp_path)).collect()
    targets = len({r.tid for r in got})
    assert len(seen) == 1 and 0 < seen[0] <= targets * 5 * 3 and len(got) == targets * 5


def test_given_pairs_are_scored_without_a_row_for_each_token(spark, tmp_path):
    rows = [(i, f"{i % 40:060d} " + " ".join(f"w{(i * j) % 30}" for j in range(1, 9)), "en", "x") for i in range(90)] + [(500, None, "en", "x"), (501, "", "en", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalogue.queries()["block_rescore_whole"](spark, str(tmp_path))
    pairs = fixtures.part(spark, str(tmp_path), "pairs").select("tid", "qid").collect()
    assert sorted(map(tuple, df.select("tid", "qid").collect())) == sorted(map(tuple, pairs)) and pairs
    assert "token" not in df._jdf.queryExecution().executedPlan().toString()
