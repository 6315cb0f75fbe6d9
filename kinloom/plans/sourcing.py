"""Queries: readers, writers and id lists, over files written to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kinloom.operators import relational
from kinloom.plans.fixtures import FX, part, read
from kinloom.sources import files

REGISTRY: dict = {}


def query(sql: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def folder(s) -> str:
    return f"{s.conf.get('spark.checkpoint.dir').rstrip('/')}/files-{uuid.uuid4().hex}"


RECORDS = "SELECT concat('S1-', lpad(CAST(c_custkey AS VARCHAR), 9, '0')) AS eid, c_name AS nm, '' AS ad, lower(c_mktsegment) AS co FROM customer"


@query(f"SELECT row_number() OVER (ORDER BY eid) - 1 + 100 AS rid, eid, nm, ad, co FROM ({RECORDS})")
def source_records(s, d):
    """Written as tab-separated text, read back with the strict reader and numbered from 100."""
    c = read(s, d, "customer")
    rows = c.select(
        F.concat(F.lit("S1-"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("entity_id"),
        F.col("c_name").alias("business_name"), F.lit("").alias("business_address"), F.col("c_mktsegment").alias("country"),
    )
    path = folder(s)
    rows.write.csv(path, sep="\t", header=True, quote="", emptyValue="")
    return files.read_records(s, path, 1, 100).select("rid", "eid", "nm", "ad", "co")


LISTS = f"""{FX}, l AS (SELECT own AS qid, string_agg(t, ',' ORDER BY t) AS ids FROM (SELECT DISTINCT own, CAST(tid AS VARCHAR) AS t FROM targets) GROUP BY 1)"""


@query(f"{LISTS} SELECT CAST(own AS VARCHAR) AS source1_entity_id, CAST(tid AS VARCHAR) AS target FROM targets WHERE own >= 0")
def sink_truth_lists(s, d):
    """Id lists written, read back and exploded."""
    links = part(s, d, "targets").select(F.col("own").cast("string").alias("k"), F.col("tid").cast("string").alias("tid"))
    refs = part(s, d, "refs").select(F.col("qid").cast("string").alias("k"))
    lists = relational.id_lists(refs, links, "k", "tid").select(F.col("k").alias("source1_entity_id"), F.col("ids").alias("matched_entity_ids"))
    path = folder(s)
    files.write_id_lists(lists, path, "source1_entity_id", "matched_entity_ids")
    return files.read_truth(s, path)


@query(f"{FX} SELECT qid, tid, p FROM pairs WHERE tid % 3 = 0 UNION ALL SELECT qid, tid, raw FROM pairs WHERE tid % 3 <> 0")
def source_overlapping_parts(s, d):
    """Two parts that overlap: the first one's targets keep its scores."""
    pairs, base = part(s, d, "pairs"), folder(s)
    pairs.where("tid % 3 = 0").select("qid", "tid", "p").write.parquet(f"{base}/a")
    pairs.select("qid", "tid", F.col("raw").alias("p")).write.parquet(f"{base}/b")
    return files.read_parts(s, [f"{base}/a", f"{base}/b"]).select("qid", "tid", "p")


@query(f"{FX} SELECT qid, tid, p FROM pairs WHERE co <> 'fr' UNION ALL SELECT qid, tid, raw FROM pairs WHERE co = 'fr'")
def sink_country_routed(s, d):
    pairs = part(s, d, "pairs").select("qid", "tid", "co", "p", "raw")
    return files.country_routed(pairs.drop("raw"), pairs.drop("p").withColumnRenamed("raw", "p"), "fr").select("qid", "tid", "p")


@query(f"{FX} SELECT count(*) AS rows, count(DISTINCT tid) AS targets FROM pairs")
def sink_manifest(s, d):
    return files.write_part(part(s, d, "pairs").select("qid", "tid"), folder(s)).select("rows", "targets")


@query("SELECT c_custkey AS rid, concat('name: ', c_name, chr(10), 'address: ', c_mktsegment, chr(10), 'country: ', c_nationkey) AS text FROM customer")
def serialised_text(s, d):
    rows = read(s, d, "customer").select(F.col("c_custkey").alias("rid"), F.col("c_name").alias("nm"), F.col("c_mktsegment").alias("ad"), F.col("c_nationkey").cast("string").alias("co"))
    return files.serialised(rows)


@query()
def sample_two_percent(s, d):
    return files.sampled(read(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 2)
