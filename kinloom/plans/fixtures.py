"""Linkage tables derived from the driver's tables, as SQL that Spark and DuckDB read alike.

references(qid, co, text, deg), targets(tid, co, text, own, sr) and candidate pairs(qid, tid, co, sr, own, deg,
p, raw, y). Documents with the same first 60 characters are one entity; its smallest id is the reference. Scores
are integer arithmetic on ids, so both engines have the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PARTS = {
    "docs_": "SELECT doc_id, lang AS co, text, source, substr(text, 1, 60) AS gk FROM {documents} WHERE doc_id IS NOT NULL",
    "groups_": "SELECT gk, min(doc_id) AS q, count(*) AS n FROM docs_ GROUP BY gk",
    "members_": """
        SELECT d.doc_id, d.co, d.text, g.q, g.n, CASE WHEN g.n = 1 AND g.q % 5 = 0 THEN 1 ELSE 0 END AS decoy
        FROM docs_ d JOIN groups_ g ON d.gk = g.gk""",
    "refs": "SELECT doc_id AS qid, co, text, n - 1 AS deg FROM members_ WHERE doc_id = q AND decoy = 0",
    "targets": """
        SELECT doc_id AS tid, co, text, CASE WHEN decoy = 1 THEN -1 ELSE q END AS own,
               CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 3 END AS sr
        FROM members_ WHERE doc_id <> q OR decoy = 1""",
    "numbered_": """
        SELECT qid, co, deg, row_number() OVER (PARTITION BY co ORDER BY qid) - 1 AS i, count(*) OVER (PARTITION BY co) AS n
        FROM refs""",
    "offered_": """
        SELECT t.tid, r.qid FROM targets t
        CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k
        JOIN numbered_ r ON r.co = t.co AND r.i = (t.tid * 7 + k.j * 13) % r.n
        UNION SELECT tid, own FROM targets WHERE own >= 0""",
    "pairs": """
        SELECT o.qid, o.tid, t.co, t.sr, t.own, r.deg,
               CAST((o.qid * 7919 + o.tid * 104729 + CASE WHEN t.own = o.qid THEN 613 ELSE 0 END) % 997 AS DOUBLE) / 1000 AS p,
               CAST((o.qid * 31 + o.tid * 17) % 10 AS DOUBLE) / 10 AS raw,
               CASE WHEN t.own = o.qid THEN 1 ELSE 0 END AS y
        FROM offered_ o JOIN targets t ON t.tid = o.tid JOIN refs r ON r.qid = o.qid""",
}

#: The same offers for Spark, which takes a place that depends on both sides for a filter behind a join on the country
#: alone, of all its targets and references. Here places are counted before the join, which then has both as keys.
OFFERS = {
    "sizes_": "SELECT co, count(*) AS n FROM refs GROUP BY co",
    "places_": """
        SELECT t.tid, t.co, (t.tid * 7 + k.j * 13) % s.n AS i FROM targets t JOIN sizes_ s ON s.co = t.co
        CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k""",
    "numbered_": "SELECT qid, co, CAST(row_number() OVER (PARTITION BY co ORDER BY qid) - 1 AS BIGINT) AS i FROM refs",
    "offered_": """
        SELECT p.tid, r.qid FROM places_ p JOIN numbered_ r ON r.co = p.co AND r.i = p.i
        UNION SELECT tid, own FROM targets WHERE own >= 0""",
}
PLAN = {k: v for k, v in PARTS.items() if k not in ("numbered_", "offered_", "pairs")} | OFFERS | {"pairs": PARTS["pairs"]}


def with_parts(documents: str = "documents", parts: dict[str, str] = PARTS) -> str:
    """The definitions as the start of a statement: ``WITH a AS (...), ...``."""
    return "WITH " + ",\n".join(f"{k} AS ({v.format(documents=documents)})" for k, v in parts.items())


#: Starts each oracle that uses these tables; more definitions may follow after a comma.
FX = with_parts()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver's table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """refs, targets or pairs. The four offers of each target are a fixed list, not a join of two tables."""
    return spark.sql(f"{with_parts('{documents}', PLAN)} SELECT * FROM {name}", documents=read(spark, sf_dir, "documents"))
