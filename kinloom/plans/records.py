"""Records with names and addresses, made from all rows of customer, as SQL that Spark and DuckDB read alike.

rec_refs(qid, co, name, address), rec_targets(tid, co, own, sr, name, address) and rec_pairs(qid, tid, co, own, sr, a, b,
aa, ba, p, y). Each customer is a reference and has two targets, changed in one of eight ways; a target whose house was
changed is a decoy without owner. Candidates are generated: targets meet the references of their country that share the
second word of the name, or the first word and the house.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinloom.plans.fixtures import read

FIRST = "amber,birch,cedar,delta,ember,fjord,grove,harbor,indigo,juniper,kestrel,lumen,meadow,northern,orchid,pioneer,quarry,raven,summit,timber,umber,valley,willow"
SECOND = "foods,tools,press,works,travel,motors,textile,garden,dental,studio,media"
FORM = "inc,ltd,gmbh,llc,company"
ROAD = "street,road,avenue,lane"
TOWN = "aven,brook,clare,dunmore,eston"


def pick(words: str, number: str) -> str:
    return f"split_part('{words}', ',', CAST(({number}) % {len(words.split(','))} AS INTEGER) + 1)"


PARTS = {
    "ent_": f"""
        SELECT c_custkey AS k, concat('n', c_nationkey) AS co, {pick(FIRST, 'c_custkey * 7')} AS w1,
               concat({pick(SECOND, 'c_custkey * 5')}, c_custkey % 307) AS w2, {pick(FORM, 'c_custkey * 3')} AS form,
               c_custkey % 89 + 1 AS house, concat({pick(FIRST, 'c_custkey * 11 + 3')}, ' ', {pick(ROAD, 'c_custkey * 3')}) AS road,
               {pick(TOWN, 'c_custkey * 2')} AS town
        FROM {{customer}} WHERE c_custkey IS NOT NULL""",
    "both_": """
        SELECT *, 0 AS j, CAST((k * 3) % 8 AS INTEGER) AS e FROM ent_
        UNION ALL SELECT *, 1 AS j, CAST((k * 3 + 5) % 8 AS INTEGER) AS e FROM ent_""",
    "rec_refs": "SELECT k AS qid, co, concat(w1, ' ', w2, ' ', form) AS name, concat(house, ' ', road, ', ', town) AS address FROM ent_",
    "rec_targets": f"""
        SELECT k * 2 + j AS tid, co, CASE WHEN e = 3 THEN -1 ELSE k END AS own, j + 2 AS sr,
               CASE e WHEN 1 THEN concat(w1, ' ', w2) WHEN 2 THEN concat({pick(FIRST, 'k * 7 + 9')}, ' ', w2, ' ', form)
                      WHEN 4 THEN concat(replace(w1, 'e', 'a'), ' ', w2, ' ', form) WHEN 6 THEN concat(w2, ' ', w1, ' & ', form)
                      ELSE concat(w1, ' ', w2, ' ', form) END AS name,
               CASE e WHEN 3 THEN concat(house + 2, ' ', road, ', ', town) WHEN 5 THEN concat(house, '-', house + 4, ' ', road, ', ', town)
                      WHEN 7 THEN '' ELSE concat(house, ' ', road, ', ', town) END AS address
        FROM both_""",
    "rec_keys_": """
        SELECT qid, tid FROM (SELECT qid, co, split_part(name, ' ', 2) AS w FROM rec_refs) r
        JOIN (SELECT tid, co, split_part(name, ' ', 2) AS w FROM rec_targets) t ON r.co = t.co AND r.w = t.w
        UNION SELECT qid, tid FROM (SELECT qid, co, split_part(name, ' ', 1) AS w, split_part(address, ' ', 1) AS h FROM rec_refs) r
        JOIN (SELECT tid, co, split_part(name, ' ', 1) AS w, split_part(address, ' ', 1) AS h FROM rec_targets) t
        ON r.co = t.co AND r.w = t.w AND r.h = t.h""",
    "rec_pairs": """
        SELECT r.qid, t.tid, t.co, t.own, t.sr, r.name AS a, t.name AS b, r.address AS aa, t.address AS ba,
               CAST((CASE WHEN r.name = t.name THEN 50 ELSE 30 END) + (CASE WHEN r.address = t.address THEN 40 ELSE 0 END)
                    + (r.qid * 31 + t.tid * 17) % 10 AS DOUBLE) / 100 AS p,
               CASE WHEN t.own = r.qid THEN 1 ELSE 0 END AS y
        FROM rec_keys_ k JOIN rec_refs r ON r.qid = k.qid JOIN rec_targets t ON t.tid = k.tid""",
}


def with_records(customer: str = "customer") -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v.format(customer=customer) if '{customer}' in v else v})" for k, v in PARTS.items())


#: Starts each oracle that uses these tables; more definitions may follow after a comma.
RX = with_records()


def record(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """rec_refs, rec_targets or rec_pairs."""
    return spark.sql(f"{with_records('{customer}')} SELECT * FROM {name}", customer=read(spark, sf_dir, "customer"))
