"""Queries: relational core and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinloom.operators import compete, relational
from kinloom.plans.fixtures import FX, part, read

REGISTRY: dict = {}


def query(sql: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


@query(f"{FX} SELECT p.qid, p.tid, t.sr FROM pairs p JOIN targets t ON p.tid = t.tid")
def join_inner(s, d):
    return part(s, d, "pairs").select("qid", "tid").join(part(s, d, "targets").select("tid", "sr"), "tid").select("qid", "tid", "sr")


@query(f"{FX} SELECT r.qid, r.co, t.tid FROM refs r LEFT JOIN targets t ON t.own = r.qid")
def join_left(s, d):
    own = part(s, d, "targets").select(F.col("own").alias("qid"), "tid")
    return part(s, d, "refs").select("qid", "co").join(own, "qid", "left")


@query(f"""{FX}, a AS (SELECT qid, tid, p FROM pairs WHERE p >= 0.5), b AS (SELECT qid, tid, raw FROM pairs WHERE raw >= 0.5)
SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.tid, b.tid) AS tid, coalesce(p, 0.0001) AS p, coalesce(raw, 0.0001) AS raw
FROM a FULL JOIN b ON a.qid = b.qid AND a.tid = b.tid""")
def join_full_blend(s, d):
    pairs = part(s, d, "pairs")
    left, right = pairs.where("p >= 0.5").select("qid", "tid", "p"), pairs.where("raw >= 0.5").select("qid", "tid", "raw")
    return relational.blend_full(left, right, ["qid", "tid"], ["p", "raw"], 1e-4)


@query(f"{FX} SELECT tid, co FROM targets WHERE own IN (SELECT qid FROM refs WHERE deg >= 2)")
def join_semi(s, d):
    busy = part(s, d, "refs").where("deg >= 2").select(F.col("qid").alias("own"))
    return part(s, d, "targets").join(busy, "own", "left_semi").select("tid", "co")


@query(f"{FX} SELECT qid, co FROM refs WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE pairs.qid = refs.qid)")
def join_anti(s, d):
    return part(s, d, "refs").join(part(s, d, "pairs"), "qid", "left_anti").select("qid", "co")


@query("""WITH e AS (SELECT c_nationkey AS a, c_custkey % 25 AS b, count(*) AS n FROM customer GROUP BY ALL)
SELECT e.a, e.b, e.n, r.n AS back_n FROM e LEFT JOIN e r ON r.a = e.b AND r.b = e.a""")
def self_join_swap(s, d):
    e = read(s, d, "customer").groupBy(F.col("c_nationkey").alias("a"), (F.col("c_custkey") % 25).alias("b")).agg(F.count("*").alias("n"))
    return relational.swapped(e, "a", "b", "n")


@query(f"{FX} SELECT x.own, x.tid, y.tid AS sibling FROM targets x JOIN targets y ON x.own = y.own AND x.tid <> y.tid WHERE x.own >= 0")
def self_join_siblings(s, d):
    return relational.siblings(part(s, d, "targets").where("own >= 0"), "own", "tid")


@query(f"""{FX} SELECT qid AS id, co, deg, NULL::INTEGER AS sr FROM refs
UNION ALL SELECT tid, co, NULL, sr FROM targets""")
def union_missing_columns(s, d):
    refs = part(s, d, "refs").select(F.col("qid").alias("id"), "co", "deg")
    return relational.union_all(refs, part(s, d, "targets").select(F.col("tid").alias("id"), "co", "sr"))


@query(f"{FX} SELECT co, sr FROM targets UNION SELECT co, CAST(deg % 3 AS INTEGER) FROM refs")
def union_distinct(s, d):
    return part(s, d, "targets").select("co", "sr").union(part(s, d, "refs").select("co", (F.col("deg") % 3).cast("int"))).distinct()


@query(f"{FX} SELECT qid, tid FROM pairs WHERE p >= 0.4 INTERSECT SELECT qid, tid FROM pairs WHERE raw >= 0.4")
def intersect_pairs(s, d):
    pairs = part(s, d, "pairs")
    return pairs.where("p >= 0.4").select("qid", "tid").intersect(pairs.where("raw >= 0.4").select("qid", "tid"))


@query(f"{FX} SELECT qid, tid FROM pairs WHERE p >= 0.4 EXCEPT SELECT qid, tid FROM pairs WHERE raw >= 0.4")
def except_pairs(s, d):
    pairs = part(s, d, "pairs")
    return pairs.where("p >= 0.4").select("qid", "tid").subtract(pairs.where("raw >= 0.4").select("qid", "tid"))


@query(f"""{FX}, kept AS (SELECT qid, tid FROM pairs WHERE p >= 0.6 EXCEPT SELECT qid, tid FROM pairs WHERE raw < 0.2)
SELECT * FROM kept UNION SELECT qid, tid FROM pairs WHERE y = 1""")
def set_arms(s, d):
    pairs, keys = part(s, d, "pairs"), ["qid", "tid"]
    chosen = [pairs.where(c).select(*keys) for c in ("p >= 0.6", "raw < 0.2", "y = 1")]
    return relational.set_arms(*chosen, keys)


@query(f"""{FX} SELECT co, CASE WHEN p >= 0.5 AND raw >= 0.5 THEN 'both' WHEN p >= 0.5 THEN 'only_a' ELSE 'only_b' END AS side, count(*) AS n
FROM pairs WHERE p >= 0.5 OR raw >= 0.5 GROUP BY ALL""")
def difference_audit(s, d):
    pairs = part(s, d, "pairs")
    return relational.difference_audit(pairs.where("p >= 0.5"), pairs.where("raw >= 0.5"), ["qid", "tid"], "co")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
def topk_global(s, d):
    rows = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rows.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(20)


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER
(PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 3""")
def topk_per_group(s, d):
    rows = read(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return compete.top_k(rows, "l_suppkey", 3, F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"))


@query(f"""{FX}, l AS (SELECT own AS qid, string_agg(s, ',' ORDER BY s) AS ids FROM
(SELECT DISTINCT own, CAST(tid AS VARCHAR) AS s FROM targets) GROUP BY own)
SELECT r.qid, coalesce(ids, '') AS ids FROM refs r LEFT JOIN l USING (qid)""")
def list_agg_ids(s, d):
    links = part(s, d, "targets").select(F.col("own").alias("qid"), F.col("tid").cast("string").alias("tid"))
    return relational.id_lists(part(s, d, "refs"), links, "qid", "tid")


@query(f"{FX} SELECT own AS qid, CAST(tid AS VARCHAR) AS tid FROM targets WHERE own >= 0")
def truth_explode(s, d):
    return relational.exploded_ids(list_agg_ids(s, d), "qid", "ids", "tid")


@query(f"""{FX} SELECT co, count(DISTINCT qid) AS refs, count(DISTINCT tid) FILTER (WHERE p >= 0.5) AS strong,
count(DISTINCT tid) FILTER (WHERE y = 1) AS owned FROM pairs GROUP BY co""")
def distinct_filtered_count(s, d):
    return part(s, d, "pairs").groupBy("co").agg(
        F.countDistinct("qid").alias("refs"),
        F.countDistinct(F.when(F.col("p") >= 0.5, F.col("tid"))).alias("strong"),
        F.countDistinct(F.when(F.col("y") == 1, F.col("tid"))).alias("owned"),
    )


@query("""SELECT l_returnflag, l_linestatus, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS discounted,
sum(l_quantity) FILTER (WHERE l_tax = 0) AS untaxed, min(l_quantity) AS least, max(l_quantity) AS most, avg(l_quantity) AS mean,
bool_or(l_quantity > 49) AS any_large, bool_and(l_quantity > 0) AS all_positive FROM lineitem GROUP BY ALL""")
def conditional_agg(s, d):
    return read(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.when(F.col("l_discount") > 0.05, 1).otherwise(0)).alias("discounted"),
        F.sum(F.when(F.col("l_tax") == 0, F.col("l_quantity"))).alias("untaxed"),
        F.min("l_quantity").alias("least"),
        F.max("l_quantity").alias("most"),
        F.avg("l_quantity").alias("mean"),
        F.bool_or(F.col("l_quantity") > 49).alias("any_large"),
        F.bool_and(F.col("l_quantity") > 0).alias("all_positive"),
    )


@query("""WITH n AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.95) AS p95, quantile_disc(n, 0.99) AS p99, max(n) AS max, avg(n) AS mean FROM n""")
def nearest_rank_percentiles(s, d):
    orders = read(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    sizes = read(s, d, "customer").select("c_custkey").join(orders, "c_custkey", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return relational.nearest_rank(sizes, "n", [0.5, 0.95, 0.99])


@query("SELECT l_shipmode_ AS flag, quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.5) AS q50 FROM (SELECT l_returnflag AS l_shipmode_, l_extendedprice FROM lineitem) GROUP BY 1")
def interpolated_quantile(s, d):
    q = F.percentile("l_extendedprice", F.array(F.lit(0.25), F.lit(0.5)))
    return read(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(q.alias("q")).select("flag", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"))


@query(r"""SELECT lang AS co, count(*) AS n, count(*) FILTER (WHERE trim(text) = '') AS blank,
count(*) FILTER (WHERE regexp_matches(text, '[^\x00-\x7F]')) AS non_ascii, count(*) FILTER (WHERE regexp_matches(text, '[0-9]')) AS digits,
count(*) FILTER (WHERE regexp_matches(text, 'https?://')) AS urls, quantile_disc(length(text), 0.5) AS p50 FROM documents GROUP BY 1""")
def census_by_country(s, d):
    text = F.col("text")
    return read(s, d, "documents").groupBy(F.col("lang").alias("co")).agg(
        F.count("*").alias("n"),
        F.count_if(F.trim(text) == "").alias("blank"),
        F.count_if(text.rlike(r"[^\x00-\x7F]")).alias("non_ascii"),
        F.count_if(text.rlike("[0-9]")).alias("digits"),
        F.count_if(text.rlike("https?://")).alias("urls"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY length(text))").cast("long").alias("p50"),
    )


@query(f"""{FX}, k AS (SELECT r.qid, count(t.tid) FILTER (WHERE t.sr = 2) AS s2, count(t.tid) FILTER (WHERE t.sr = 3) AS s3
FROM refs r LEFT JOIN targets t ON t.own = r.qid GROUP BY 1) SELECT s2, s3, s2 + s3 AS degree, count(*) AS n FROM k GROUP BY ALL""")
def truth_degree_histogram(s, d):
    t = part(s, d, "targets").withColumnRenamed("own", "qid").groupBy("qid").agg(*[F.count_if(F.col("sr") == k).alias(f"s{k}") for k in (2, 3)])
    k = part(s, d, "refs").select("qid").join(t, "qid", "left").na.fill(0)
    return k.groupBy("s2", "s3", (F.col("s2") + F.col("s3")).alias("degree")).agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT p_name, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1)
SELECT n AS group_size, count(*) AS names, sum(n) AS parts, sum(CASE WHEN brands > 1 THEN 1 ELSE 0 END) AS mixed FROM n WHERE n > 1 GROUP BY 1""")
def ambiguity_groups(s, d):
    n = read(s, d, "part").groupBy("p_name").agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("brands")).where("n > 1")
    return n.groupBy(F.col("n").alias("group_size")).agg(F.count("*").alias("names"), F.sum("n").alias("parts"), F.sum((F.col("brands") > 1).cast("long")).alias("mixed"))


@query(f"""{FX} SELECT co, sr, y, count(*) AS n, avg(p) AS mean_p FROM pairs GROUP BY GROUPING SETS ((), (co), (co, sr), (co, sr, y))""")
def hierarchy_grouping_sets(s, d):
    sets = [[], [F.col("co")], [F.col("co"), F.col("sr")], [F.col("co"), F.col("sr"), F.col("y")]]
    return part(s, d, "pairs").groupingSets(sets, "co", "sr", "y").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"))


@query("SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name) AS name_n FROM part")
def document_frequency(s, d):
    return relational.with_frequency(read(s, d, "part").select("p_partkey", "p_name"), ["p_name"], "name_n")


@query("SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 12")
def most_common_names(s, d):
    return read(s, d, "part").groupBy("p_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_name").limit(12)


@query(f"""{FX}, r AS (SELECT tid, p, row_number() OVER (PARTITION BY tid ORDER BY p DESC) AS r FROM pairs)
SELECT tid, max(p) FILTER (WHERE r = 1) AS best, max(p) FILTER (WHERE r = 2) AS second FROM r GROUP BY 1""")
def top_two_list(s, d):
    return relational.top_two(part(s, d, "pairs").select("tid", "p"), "tid", "p")


@query("""SELECT l_orderkey, l_linenumber, greatest(l_discount, l_tax) AS most, least(l_discount, l_tax) AS least,
(l_discount + l_tax) / 2 AS mean, abs(l_discount - l_tax) / 2 AS deviation FROM lineitem""")
def horizontal_stats(s, d):
    a, b = F.col("l_discount"), F.col("l_tax")
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.greatest(a, b).alias("most"), F.least(a, b).alias("least"), ((a + b) / 2).alias("mean"), (F.abs(a - b) / 2).alias("deviation"))


@query(f"{FX} SELECT CASE WHEN tid % 2 = 0 THEN 'validation' ELSE 'test' END AS split, co, avg(p) AS p, avg(raw) AS raw, count(*) AS n FROM pairs GROUP BY ALL")
def drift_table(s, d):
    split = F.when(F.col("tid") % 2 == 0, "validation").otherwise("test")
    return part(s, d, "pairs").groupBy(split.alias("split"), "co").agg(F.avg("p").alias("p"), F.avg("raw").alias("raw"), F.count("*").alias("n"))


@query(f"{FX} SELECT count(*) - count(DISTINCT (qid, tid)) AS repeated, count(*) FILTER (WHERE p < 0 OR p > 1 OR isnan(p)) AS out_of_range, count(*) FILTER (WHERE qid IS NULL) AS no_key FROM pairs")
def guard_checks(s, d):
    return part(s, d, "pairs").agg(
        (F.count("*") - F.countDistinct("qid", "tid")).alias("repeated"),
        F.count_if((F.col("p") < 0) | (F.col("p") > 1) | F.isnan("p")).alias("out_of_range"),
        F.count_if(F.col("qid").isNull()).alias("no_key"),
    )


@query("SELECT o_orderkey, CAST(((o_orderkey * 2654435761) >> 13) % 100 AS INTEGER) AS part FROM orders")
def knuth_partition(s, d):
    return read(s, d, "orders").select("o_orderkey", relational.bucket(F.col("o_orderkey"), 100).alias("part"))


@query(f"""{FX}, k AS (SELECT qid, co, least(deg, 7) AS g, ((qid * 2654435761) >> 13) % 1048576 AS h FROM refs),
r AS (SELECT qid, row_number() OVER (PARTITION BY co, g ORDER BY h, qid) AS r, floor(count(*) OVER (PARTITION BY co, g) / 10) AS n FROM k)
SELECT qid, CASE WHEN r <= n THEN 0 WHEN r <= 2 * n THEN 1 ELSE 2 END AS fold FROM r""")
def stratified_folds(s, d):
    refs = part(s, d, "refs").withColumn("g", F.least("deg", F.lit(7)))
    return relational.stratified_folds(refs, ["co", "g"], "qid").select("qid", "fold")


@query("""SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT s_nationkey FROM supplier) THEN CAST(c_nationkey AS VARCHAR) ELSE '*' END AS scope FROM customer""")
def country_scope_fallback(s, d):
    left = read(s, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("co"))
    right = read(s, d, "supplier").select(F.col("s_nationkey").cast("string").alias("co"))
    return relational.scoped(left, right, "co", "c_custkey")


@query(f"{FX} SELECT tid, qid, p FROM pairs WHERE co = 'de' AND p >= 0.25")
def scan_pushdown(s, d):
    return part(s, d, "pairs").where((F.col("co") == "de") & (F.col("p") >= 0.25)).select("tid", "qid", "p")


# windows


@query(f"""{FX} SELECT tid, qid, count(*) OVER w AS n, max(p) OVER w AS best, max(p) OVER w - p AS gap,
row_number() OVER (PARTITION BY tid ORDER BY p DESC, qid) AS place, rank() OVER (PARTITION BY tid ORDER BY p DESC) AS shared_place
FROM pairs WINDOW w AS (PARTITION BY tid)""")
def win_context(s, d):
    return compete.context(part(s, d, "pairs").select("tid", "qid", "p"), "tid", "p", "qid").drop("p")


@query(f"""{FX}, r AS (SELECT qid, tid, p, row_number() OVER (PARTITION BY tid ORDER BY p DESC, qid) AS r FROM pairs),
m AS (SELECT *, max(CASE WHEN r = 1 THEN p END) OVER (PARTITION BY tid) AS a, max(CASE WHEN r = 2 THEN p END) OVER (PARTITION BY tid) AS b FROM r)
SELECT qid, tid, p - CASE WHEN r = 1 THEN coalesce(b, -14.0) ELSE a END AS margin FROM m""")
def win_margin_to_other(s, d):
    return compete.margin_to_other(part(s, d, "pairs").select("qid", "tid", "p"), "tid", "p", "qid", -14.0).drop("p")


@query(f"""{FX} SELECT qid, tid, p - lead(p) OVER w AS to_next, lag(p) OVER w - p AS to_previous FROM pairs
WINDOW w AS (PARTITION BY tid ORDER BY p DESC, qid)""")
def win_lead_lag(s, d):
    w = Window.partitionBy("tid").orderBy(F.desc("p"), "qid")
    return part(s, d, "pairs").select("qid", "tid", (F.col("p") - F.lead("p").over(w)).alias("to_next"), (F.lag("p").over(w) - F.col("p")).alias("to_previous"))


@query(f"{FX} SELECT qid, tid, sum(CASE WHEN p >= b - 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY tid) AS ties FROM (SELECT *, max(p) OVER (PARTITION BY tid) AS b FROM pairs)")
def win_near_ties(s, d):
    return compete.near_ties(part(s, d, "pairs"), "tid", "p", 0.1).select("qid", "tid", "ties")


@query(f"{FX} SELECT qid, tid, sum(y) OVER (PARTITION BY qid) - y AS others FROM pairs")
def win_leave_one_out(s, d):
    return compete.leave_one_out(part(s, d, "pairs"), "qid", "y").select("qid", "tid", "others")


@query(f"""{FX}, o AS (SELECT qid, tid, greatest(p, 0.000001) / (1 - greatest(p, 0.000001)) AS o FROM pairs),
s AS (SELECT *, 1 + sum(o) OVER (PARTITION BY tid) AS t FROM o),
e AS (SELECT qid, tid, o / t AS prior, 1 / t AS outside FROM s)
SELECT qid, tid, round(prior, 9) AS prior, round(outside, 9) AS outside,
round(sum(-prior * ln(prior)) OVER (PARTITION BY tid) - outside * ln(outside), 9) AS entropy FROM e""")
def win_odds_entropy(s, d):
    out = compete.entropy(compete.ownership(part(s, d, "pairs").select("qid", "tid", "p"), "tid", "p"), "tid")
    return out.select("qid", "tid", *[F.round(c, 9).alias(c) for c in ("prior", "outside", "entropy")])


@query(f"""{FX}, r AS (SELECT qid, tid, sum(1 + deg) OVER (PARTITION BY co ORDER BY p DESC, qid, tid ROWS UNBOUNDED PRECEDING) AS spent FROM pairs)
SELECT qid, tid, spent FROM r WHERE spent <= 100""")
def win_budget(s, d):
    rows = part(s, d, "pairs").withColumn("cost", F.col("deg") + 1)
    return compete.within_budget(rows, "cost", 100, F.desc("p"), F.asc("qid"), F.asc("tid"), by=["co"]).select("qid", "tid", "spent")


@query(f"{FX} SELECT qid, tid, sum(p) OVER (PARTITION BY qid, sr) AS source_sum, count(*) OVER (PARTITION BY qid, sr) AS source_n FROM pairs")
def win_two_keys(s, d):
    w = Window.partitionBy("qid", "sr")
    return part(s, d, "pairs").select("qid", "tid", F.sum("p").over(w).alias("source_sum"), F.count("*").over(w).alias("source_n"))


@query("SELECT p_partkey, (SELECT count(DISTINCT p_brand) FROM part i WHERE i.p_name = o.p_name) AS brands, count(*) OVER (PARTITION BY p_name) = 1 AS single FROM part o")
def win_distinct_over(s, d):
    w = Window.partitionBy("p_name")
    return read(s, d, "part").select("p_partkey", F.size(F.collect_set("p_brand").over(w)).cast("long").alias("brands"), (F.count("*").over(w) == 1).alias("single"))


@query(f"""{FX}, r AS (SELECT qid, tid, p, row_number() OVER (PARTITION BY tid ORDER BY p DESC, qid) AS r FROM pairs)
SELECT qid, tid FROM r WHERE r = 1 OR (r <= 3 AND p >= 0.3)""")
def gate_adaptive(s, d):
    return compete.adaptive(part(s, d, "pairs"), "tid", "p", "qid", 0.3, 3).select("qid", "tid")


@query(f"""{FX}, r AS (SELECT qid, tid, p, max(p) OVER (PARTITION BY tid) AS b, row_number() OVER (PARTITION BY tid ORDER BY p DESC, qid) AS r FROM pairs)
SELECT qid, tid FROM r WHERE r <= 3 AND p >= 0.6 * b""")
def candidate_filter(s, d):
    return compete.candidate_filter(part(s, d, "pairs"), "tid", "p", "qid", 3, 0.6).select("qid", "tid")


@query("SELECT event_id, user_id, session FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events))")
def win_sessions(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.col("ts") <= F.lag("ts").over(w) + F.expr("INTERVAL 1 HOUR"), 0).otherwise(1)
    rows = read(s, d, "events").select("event_id", "user_id", "ts", fresh.alias("fresh"))
    return rows.select("event_id", "user_id", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("session"))
