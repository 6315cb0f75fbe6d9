"""The queries against SQL, and the pipeline against a plain version of its decisions."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from kinloom.llm import common, decontamination, jaccard_join, quality, queries, toxicity
from tests.test_queries import SF, TABLES, plain


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want


def test_all_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11))


def test_pipeline_keeps_what_the_stages_keep(spark):
    docs = common.table(spark, SF, "documents", doc_id="long", text="string").toPandas()
    rows = [(int(a), b) for a, b in zip(docs.doc_id, docs.text, strict=True)]
    for module, label, good in ((toxicity, "toxic", lambda s: s < 0.5), (quality, "quality", lambda s: s >= 0.5)):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        model = module.train(df, common.table(spark, SF, "labels", doc_id="long", **{label: "int"}))
        rows = [(i, t) for i, t in rows if good(model.score(module.features(t)))]
    sets = [{*jaccard_join.shingles(t, 5).tolist()} for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                root[max(find(i), find(j), key=lambda k: rows[k][0])] = min(find(i), find(j), key=lambda k: rows[k][0])
    rows = [r for i, r in enumerate(rows) if find(i) == i]
    items = [decontamination.words_of(r.text) for r in common.table(spark, SF, "benchmark", text="string").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9)) if w}
    lengths = {len(w) for w in windows}

    def leaks(t):
        w = decontamination.words_of(t)
        return any(tuple(w[i : i + n]) in windows for n in lengths for i in range(len(w) - n + 1))

    want = sorted(i for i, t in rows if not leaks(t))
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()) == want
