"""Queries: features, graph, calibration, decisions, metrics, policies, learned scores and incremental runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinloom.operators import compete, decide, graph, relational
from kinloom.plans.fixtures import FX, part, read
from kinloom.plans.records import RX, record
from kinloom.sources.files import stored

REGISTRY: dict = {}


def query(sql: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


WON = f"""{FX}, won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY p DESC, raw DESC, qid) AS r FROM pairs) WHERE r = 1)"""
FH = "CASE WHEN deg = 0 THEN CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END WHEN tp > 0 THEN 1.25 * tp / (n + 0.25 * deg) ELSE 0.0 END"


def won(s, d):
    return compete.winners(part(s, d, "pairs"))


@query(f"""{WON}, acc AS (SELECT qid, tid FROM won WHERE p >= 0.3), l AS (SELECT qid, string_agg(t, ',' ORDER BY t) AS ids FROM (SELECT DISTINCT qid, CAST(tid AS VARCHAR) AS t FROM acc) GROUP BY 1)
SELECT r.qid, r.co, coalesce(ids, '') AS matched FROM refs r LEFT JOIN l USING (qid)""")
def flagship_top1_match(s, d):
    """Candidates, one owner for each target, a cut, and one list of ids for each reference."""
    acc = won(s, d).where("p >= 0.3").select("qid", F.col("tid").cast("string").alias("tid"))
    refs = part(s, d, "refs")
    lists = relational.id_lists(refs, acc, "qid", "tid", "matched")
    return refs.select("qid", "co").join(lists, "qid")


@query(f"{FX} SELECT qid, tid, p FROM pairs WHERE p >= 0.8")
def decide_threshold(s, d):
    return part(s, d, "pairs").where("p >= 0.8").select("qid", "tid", "p")


@query(f"{WON} SELECT qid, tid, p FROM won")
def decide_top1(s, d):
    return won(s, d).select("qid", "tid", "p")


CUTS = {"de": 0.55, "en": 0.5, "es": 0.6, "fr": 0.45}


@query(f"{WON} SELECT qid, tid, co FROM won WHERE p >= CASE co {' '.join(f'WHEN {k!r} THEN {v}' for k, v in CUTS.items())} END")
def decide_country_cuts(s, d):
    return decide.country_cuts(won(s, d), CUTS).select("qid", "tid", "co")


@query(f"{WON}, o AS (SELECT *, count(*) OVER (PARTITION BY qid) AS c FROM won) SELECT qid, tid, p FROM o WHERE c = 1 AND p > 0.5")
def decide_expected_f_single(s, d):
    one = won(s, d).withColumn("c", F.count("*").over(Window.partitionBy("qid"))).where("c = 1")
    return decide.expected_f(one.drop("c")).select("qid", "tid", "p")


@query()
def decide_expected_f(s, d):
    return decide.expected_f(part(s, d, "pairs")).select("qid", "tid", "p")


@query(f"{FX} SELECT qid, tid, round(1 / (1 + exp(-(0.25 * ln(q / (1 - q)) + 0.75 * ln(r / (1 - r))))), 9) AS blend, round(2 * p / (2 * p + 1 - p), 9) AS doubled FROM (SELECT *, greatest(p, 0.000001) AS q, greatest(raw, 0.000001) AS r FROM pairs)")
def blend_logit(s, d):
    a, b = F.col("p"), F.col("raw")
    return part(s, d, "pairs").select("qid", "tid", F.round(decide.logit_blend(a, b, 0.25), 9).alias("blend"), F.round(decide.times_odds(a, 2), 9).alias("doubled"))


@query(f"""{FX}, x AS (SELECT qid, tid, CASE WHEN tid % 3 = 0 THEN NULL ELSE p END AS a, CASE WHEN qid % 2 = 0 THEN NULL ELSE raw END AS b FROM pairs)
SELECT qid, tid, round((2 * coalesce(a, 0) + coalesce(b, 0)) / nullif(2 * (a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0), 9) AS mean FROM x""")
def blend_available(s, d):
    x = part(s, d, "pairs").select("qid", "tid", F.when(F.col("tid") % 3 != 0, F.col("p")).alias("a"), F.when(F.col("qid") % 2 != 0, F.col("raw")).alias("b"))
    return x.select("qid", "tid", F.round(decide.available_mean({"a": 2.0, "b": 1.0}), 9).alias("mean"))


@query(f"{FX} SELECT qid, tid, CASE WHEN p BETWEEN 0.2 AND 0.8 THEN raw ELSE p END AS score FROM pairs")
def score_selective(s, d):
    return part(s, d, "pairs").select("qid", "tid", decide.selective(F.col("raw"), F.col("p"), 0.2, 0.8).alias("score"))


MACRO = f"""{WON}, acc AS (SELECT qid, sum(y) AS tp, count(*) AS n FROM won WHERE p >= 0.4 GROUP BY 1),
k AS (SELECT r.qid, r.co, r.deg, coalesce(tp, 0) AS tp, coalesce(n, 0) AS n FROM refs r LEFT JOIN acc USING (qid))"""


@query(f"{MACRO} SELECT round(avg({FH}), 9) AS f, round(sum(tp) / sum(n), 9) AS precision, round(sum(tp) / sum(deg), 9) AS recall, count(*) AS refs FROM k")
def macro_f05(s, d):
    return decide.macro(part(s, d, "refs"), won(s, d).where("p >= 0.4"))


CURVE = f"""{WON}, c AS (SELECT w.qid, w.p, w.y, r.deg, sum(w.y) OVER o AS tp, count(*) OVER o AS n FROM won w JOIN refs r USING (qid) WINDOW o AS (PARTITION BY w.qid ORDER BY w.p DESC, w.tid ROWS UNBOUNDED PRECEDING)),
ds AS (SELECT p, y, {FH} - (SELECT {FH.replace('tp', 'b.tp').replace('n =', 'b.n =').replace('(n +', '(b.n +').replace('deg', 'b.deg')} FROM (SELECT c.tp - c.y AS tp, c.n - 1 AS n, c.deg AS deg) b) AS d FROM c),
g AS (SELECT p, sum(d) AS d, sum(y) AS y, count(*) AS k FROM ds GROUP BY p),
cur AS (SELECT p, round(((SELECT count(*) FROM refs WHERE deg = 0) + sum(d) OVER q) / (SELECT count(*) FROM refs), 9) AS f, sum(y) OVER q AS tp, sum(k) OVER q AS n FROM g WINDOW q AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))"""


@query(f"{CURVE} SELECT p, f, tp, n FROM cur")
def threshold_curve(s, d):
    return decide.threshold_curve(part(s, d, "refs"), won(s, d))


@query(f"{CURVE} SELECT f, round(tp / n, 9) AS precision, p AS cut, tp, n FROM cur ORDER BY f DESC, precision DESC, cut DESC LIMIT 1")
def threshold_best(s, d):
    return decide.best_cut(decide.threshold_curve(part(s, d, "refs"), won(s, d)))


@query(f"{CURVE} SELECT f, round(tp / n, 9) AS precision, p AS cut, tp, n FROM cur WHERE round(tp / n, 9) >= 0.2 ORDER BY f DESC, precision DESC, cut DESC LIMIT 1")
def threshold_constrained(s, d):
    return decide.best_cut(decide.threshold_curve(part(s, d, "refs"), won(s, d)), 0.2)


@query(f"""{WON}, c AS (SELECT tid, bool_or(y = 1) AS offered, max(CASE WHEN y = 1 THEN p END) AS own_p FROM pairs GROUP BY 1)
SELECT CASE WHEN t.own < 0 AND w.p >= 0.4 THEN 'decoy accepted' WHEN t.own < 0 THEN 'decoy rejected' WHEN NOT coalesce(offered, false) THEN 'not a candidate' WHEN w.y = 1 AND w.p >= 0.4 THEN 'found'
WHEN w.y = 1 THEN 'rejected' ELSE 'another first' END AS outcome, count(*) AS n FROM targets t LEFT JOIN c USING (tid) LEFT JOIN won w USING (tid) GROUP BY 1""")
def error_attribution(s, d):
    pairs = part(s, d, "pairs")
    offered = pairs.groupBy("tid").agg(F.bool_or(F.col("y") == 1).alias("offered"))
    rows = part(s, d, "targets").select("tid", "own").join(offered, "tid", "left").join(won(s, d).select("tid", "p", "y"), "tid", "left")
    outcome = (
        F.when((F.col("own") < 0) & (F.col("p") >= 0.4), "decoy accepted")
        .when(F.col("own") < 0, "decoy rejected")
        .when(~F.coalesce("offered", F.lit(False)), "not a candidate")
        .when((F.col("y") == 1) & (F.col("p") >= 0.4), "found")
        .when(F.col("y") == 1, "rejected")
        .otherwise("another first")
    )
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(f"""{WON}, acc AS (SELECT tid FROM won WHERE p >= 0.6) SELECT tid, qid, p FROM (SELECT tid, qid, p, row_number() OVER (PARTITION BY tid ORDER BY p DESC, qid) AS r FROM pairs
WHERE raw >= 0.3 AND p >= 0.3 AND tid NOT IN (SELECT tid FROM acc)) WHERE r = 1""")
def policy_additions(s, d):
    acc = won(s, d).where("p >= 0.6").select("tid")
    return decide.additions(acc, part(s, d, "pairs").where("raw >= 0.3"), 0.3).select("tid", "qid", "p")


@query(f"""{WON}, acc AS (SELECT tid, qid, p FROM won WHERE p >= 0.3), o AS (SELECT tid, qid, raw AS p, row_number() OVER (PARTITION BY tid ORDER BY raw DESC, qid) AS r FROM pairs)
SELECT a.tid, CASE WHEN o.p >= 0.8 AND o.p - a.p >= 0.1 THEN o.qid ELSE a.qid END AS qid, coalesce(o.p >= 0.8 AND o.p - a.p >= 0.1 AND o.qid <> a.qid, false) AS moved FROM acc a LEFT JOIN o ON o.tid = a.tid AND o.r = 1""")
def policy_switch(s, d):
    offers = part(s, d, "pairs").select("tid", "qid", F.col("raw").alias("p"))
    return decide.switched(won(s, d).where("p >= 0.3").select("tid", "qid", "p"), offers, 0.8, 0.1)


def fh(tp: str, n: str) -> str:
    return FH.replace("tp", f"({tp})").replace("n =", f"({n}) =").replace("(n +", f"(({n}) +")


@query(f"""{WON}, acc AS (SELECT w.qid, w.tid, w.y, w.p, sum(w.y) OVER (PARTITION BY w.qid) AS tp, count(*) OVER (PARTITION BY w.qid) AS n, r.deg FROM won w JOIN refs r USING (qid) WHERE w.p >= 0.2)
SELECT qid, tid, round({fh('tp - y', 'n - 1')} - ({fh('tp', 'n')}), 9) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY p, tid) AS r FROM acc) WHERE r = 1""")
def policy_set_utility(s, d):
    w = Window.partitionBy("qid")
    acc = won(s, d).where("p >= 0.2").drop("deg").join(part(s, d, "refs").select("qid", "deg"), "qid")
    acc = acc.withColumn("tp", F.sum("y").over(w)).withColumn("n", F.count("*").over(w))
    weakest = compete.top_k(acc, "qid", 1, F.asc("p"), F.asc("tid"))
    return weakest.select("qid", "tid", F.round(decide.remove_gain(*map(F.col, ("tp", "n", "deg", "y"))), 9).alias("gain"))


@query(f"""{WON} SELECT co, sum(y) AS hits, count(*) AS n, round((sum(y) / count(*) + 3.8416 / (2 * count(*)) - 1.96 * sqrt((sum(y) / count(*) * (1 - sum(y) / count(*)) + 3.8416 / (4 * count(*))) / count(*))) / (1 + 3.8416 / count(*)), 9) AS wilson FROM won GROUP BY co""")
def policy_wilson(s, d):
    rows = won(s, d).groupBy("co").agg(F.sum("y").alias("hits"), F.count("*").alias("n"))
    return rows.select("co", "hits", "n", F.round(decide.wilson(F.col("hits"), F.col("n")), 9).alias("wilson"))


@query(f"""{FX}, m AS (SELECT tid, (arg_max(qid, (p, -qid)) = arg_max(qid, (raw, -qid))) AS same, arg_max(qid, (p, -qid)) AS qid, max(p) AS a, max(raw) AS b FROM pairs GROUP BY 1)
SELECT tid, qid, least(a, b) AS score FROM m WHERE same""")
def policy_unanimous(s, d):
    best = [F.max_by("qid", F.struct(c, -F.col("qid"))).alias(f"q_{c}") for c in ("p", "raw")]
    m = part(s, d, "pairs").groupBy("tid").agg(*best, F.max("p").alias("a"), F.max("raw").alias("b"))
    return m.where("q_p = q_raw").select("tid", F.col("q_p").alias("qid"), F.least("a", "b").alias("score"))


@query(f"""{FX}, r AS (SELECT tid, p, y, row_number() OVER (PARTITION BY tid ORDER BY p DESC, qid) AS r FROM pairs)
SELECT k, floor, count(*) AS kept, sum(y) AS hits FROM r, (VALUES (1), (2), (4)) a(k), (VALUES (0.0), (0.25), (0.5)) b(floor) WHERE r = 1 OR (r <= k AND p >= floor) GROUP BY ALL""")
def gate_budget_grid(s, d):
    grid = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f).cast("decimal(2,1)" if f != 0.25 else "decimal(3,2)").cast("decimal(3,2)").alias("floor")) for k in (1, 2, 4) for f in (0.0, 0.25, 0.5)])
    r = compete.ranked(part(s, d, "pairs"), "tid", F.desc("p"), F.asc("qid")).withColumn("g", F.explode(grid))
    kept = r.where((F.col("rank") == 1) | ((F.col("rank") <= F.col("g.k")) & (F.col("p") >= F.col("g.floor"))))
    return kept.groupBy("g.k", "g.floor").agg(F.count("*").alias("kept"), F.sum("y").alias("hits"))


@query(f"""{WON}, lists AS (SELECT qid, tid FROM won WHERE p >= 0.3), cand AS (SELECT qid, tid FROM pairs WHERE p >= 0.35)
SELECT 'match outside candidates' AS problem, count(*) AS n FROM (SELECT * FROM lists EXCEPT SELECT * FROM cand) UNION ALL
SELECT 'target with several owners', count(*) FROM (SELECT tid FROM lists GROUP BY 1 HAVING count(*) > 1) UNION ALL
SELECT 'unknown reference', count(*) FROM lists WHERE qid NOT IN (SELECT qid FROM refs) UNION ALL
SELECT 'unknown target', count(*) FROM lists WHERE tid NOT IN (SELECT tid FROM targets)""")
def validate_output(s, d):
    pairs, lists = part(s, d, "pairs"), won(s, d).where("p >= 0.3").select("qid", "tid")
    found = {
        "match outside candidates": lists.join(pairs.where("p >= 0.35"), ["qid", "tid"], "left_anti"),
        "target with several owners": relational.duplicates(lists, ["tid"]),
        "unknown reference": lists.join(part(s, d, "refs"), "qid", "left_anti"),
        "unknown target": lists.join(part(s, d, "targets"), "tid", "left_anti"),
    }
    return graph.union([rows.agg(F.count("*").alias("n")).select(F.lit(k).alias("problem"), "n") for k, rows in found.items()])


# features


@query(f"""{WON}, o AS (SELECT tid, qid, p FROM won WHERE p >= 0.3) SELECT p.qid, p.tid, count(o.tid) AS siblings, coalesce(sum((t.sr = p.sr)::INT), 0) AS same_source, max(o.p) AS best
FROM pairs p LEFT JOIN o ON o.qid = p.qid AND o.tid <> p.tid LEFT JOIN targets t ON t.tid = o.tid GROUP BY ALL""")
def feat_siblings(s, d):
    o = won(s, d).where("p >= 0.3").select("qid", F.col("tid").alias("other"), F.col("p").alias("op"), F.col("sr").alias("osr"))
    p = part(s, d, "pairs").select("qid", "tid", "sr")
    rows = p.join(o, (p["qid"] == o["qid"]) & (p["tid"] != o["other"]), "left").drop(o["qid"])
    same = F.coalesce(F.sum((F.col("sr") == F.col("osr")).cast("int")), F.lit(0)).alias("same_source")
    return rows.groupBy("qid", "tid").agg(F.count("other").alias("siblings"), same, F.max("op").alias("best"))


@query("""WITH e AS (SELECT p_brand AS co, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part), c AS (SELECT a, b, count(*) AS f, count(DISTINCT co) AS fan FROM e GROUP BY ALL)
SELECT c.a, c.b, c.f, c.fan, coalesce(r.f, 0) AS back, round((c.f + 1) / (c.f + coalesce(r.f, 0) + 2), 6) AS forward_share FROM c LEFT JOIN c r ON r.a = c.b AND r.b = c.a""")
def feat_swap_stats(s, d):
    w = F.split("p_name", " ")
    e = read(s, d, "part").select(F.col("p_brand").alias("co"), F.get(w, F.lit(0)).alias("a"), F.coalesce(F.get(w, F.lit(1)), F.lit("")).alias("b"))
    c = e.groupBy("a", "b").agg(F.count("*").alias("f"), F.countDistinct("co").alias("fan"))
    back = F.coalesce("back_f", F.lit(0)).alias("back")
    return relational.swapped(c, "a", "b", "f").select("a", "b", "f", "fan", back, F.round((F.col("f") + 1) / (F.col("f") + F.coalesce("back_f", F.lit(0)) + 2), 6).alias("forward_share"))


@query(f"""{FX}, r AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY p DESC, qid) AS r FROM pairs), m AS (SELECT tid, max(CASE WHEN r = 1 THEN p END) AS p1, max(CASE WHEN r = 2 THEN p END) AS p2, max(CASE WHEN r = 1 THEN raw END) AS w1, max(CASE WHEN r = 2 THEN raw END) AS w2 FROM r GROUP BY 1)
SELECT r.qid, r.tid, r.p - CASE WHEN r = 1 THEN coalesce(p2, 0) ELSE p1 END AS p_contrast, r.raw - CASE WHEN r = 1 THEN coalesce(w2, 0) ELSE w1 END AS raw_contrast FROM r JOIN m USING (tid)""")
def feat_triads(s, d):
    r = compete.ranked(part(s, d, "pairs"), "tid", F.desc("p"), F.asc("qid"))
    w = Window.partitionBy("tid")
    def rival(c):
        first, second = (F.max(F.when(F.col("rank") == k, F.col(c))).over(w) for k in (1, 2))
        return F.col(c) - F.when(F.col("rank") == 1, F.coalesce(second, F.lit(0.0))).otherwise(first)
    return r.select("qid", "tid", rival("p").alias("p_contrast"), rival("raw").alias("raw_contrast"))


@query(f"""{FX} SELECT qid, tid, (p >= 0.5)::INT + (raw >= 0.5)::INT AS votes, abs(p - raw) AS spread, count(*) OVER (PARTITION BY qid) AS claims,
count(*) FILTER (WHERE p >= 0.5) OVER (PARTITION BY qid, sr) AS strong_claims FROM pairs""")
def feat_votes(s, d):
    strong = (F.col("p") >= 0.5).cast("int")
    return part(s, d, "pairs").select(
        "qid", "tid", (strong + (F.col("raw") >= 0.5).cast("int")).alias("votes"), F.abs(F.col("p") - F.col("raw")).alias("spread"),
        F.count("*").over(Window.partitionBy("qid")).alias("claims"), F.sum(strong).over(Window.partitionBy("qid", "sr")).alias("strong_claims"),
    )


# calibration

EDGES = [0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9]
BIN = " + ".join(f"(p >= {e})::INT" for e in EDGES)


@query(f"{FX} SELECT co, {BIN} AS bin, count(*) AS n, sum(y) AS hits FROM pairs GROUP BY ALL")
def calib_histogram(s, d):
    return part(s, d, "pairs").groupBy("co", decide.bins(F.col("p"), EDGES).alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("hits"))


def curve(s, d) -> tuple[list[float], list[float]]:
    """Rising posterior at the bins' centres; eight numbers come to the driver."""
    rows = calib_histogram(s, d).groupBy("bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).orderBy("bin").collect()
    ends = [0.0, *EDGES, 1.0]
    xs = [(ends[r.bin] + ends[r.bin + 1]) / 2 for r in rows]
    return xs, decide.isotonic([r.hits / r.n for r in rows], [float(r.n) for r in rows])


@query()
def calib_isotonic(s, d):
    xs, ys = curve(s, d)
    return s.createDataFrame(list(zip(xs, ys, strict=True)), "x double, y double")


@query()
def calib_apply(s, d):
    return part(s, d, "pairs").select("qid", "tid", F.round(decide.interpolated(F.col("p"), *curve(s, d)), 9).alias("p"))


@query(f"""{FX}, h AS (SELECT co, {BIN} AS bin, sum(y) / count(*) AS rate FROM pairs GROUP BY ALL) SELECT co, bin, max(rate) OVER (PARTITION BY co ORDER BY bin ROWS UNBOUNDED PRECEDING) AS rising FROM h""")
def calib_running_max(s, d):
    w = Window.partitionBy("co").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    h = calib_histogram(s, d).withColumn("rate", F.col("hits") / F.col("n"))
    return h.select("co", "bin", F.max("rate").over(w).alias("rising"))


# graph

EDGE = f"""{RX}, b AS (SELECT tid AS id, sr, concat(co, ' ', split_part(name, ' ', 2)) AS k, list_distinct(list_filter(string_split(lower(concat(name, ' ', address)), ' '), lambda w: w <> '')) AS w FROM rec_targets),
s AS (SELECT k FROM b GROUP BY 1 HAVING count(*) BETWEEN 2 AND 16), e AS (SELECT x.id AS src, y.id AS dst, round(len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))), 6) AS weight FROM b x JOIN b y USING (k) JOIN s USING (k) WHERE x.sr <> y.sr),
t AS (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM e) WHERE r <= 4),
m AS (SELECT t.* FROM t JOIN t u ON u.src = t.dst AND u.dst = t.src)"""


def linked(rows):
    """Edges between rows (id, source, k, body) of a block, weighted by the words that two bodies share."""
    tokens = F.array_distinct(F.filter(F.split(F.lower("body"), " "), lambda w: w != ""))
    return graph.mutual_neighbours(graph.block_edges(rows.withColumn("tokens", tokens).drop("body"), "k", 16), 4)


def edges(s, d):
    """Targets of a country whose names share the second word, by all words of names and addresses."""
    t = record(s, d, "rec_targets")
    k = F.concat("co", F.lit(" "), F.split_part("name", F.lit(" "), F.lit(2)))
    return linked(t.select(F.col("tid").alias("id"), F.col("sr").alias("source"), k.alias("k"), F.concat_ws(" ", "name", "address").alias("body")))


def text_edges(s, d):
    """Targets of a country whose texts begin alike, by all words of the texts."""
    t = part(s, d, "targets")
    k = F.concat("co", F.lit(" "), F.substring("text", 1, 14))
    return linked(t.select(F.col("tid").alias("id"), F.col("sr").alias("source"), k.alias("k"), F.col("text").alias("body")))


@query(f"{EDGE} SELECT src, dst, weight FROM m")
def graph_mutual_topk(s, d):
    return edges(s, d)


@query(f"""{FX}, r AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY p DESC, qid) AS r FROM pairs), m AS (SELECT tid, max(CASE WHEN r = 1 THEN qid END) AS qid, max(p) AS p, max(CASE WHEN r = 2 THEN p END) AS p2 FROM r GROUP BY 1)
SELECT tid, qid FROM m WHERE p >= 0.7 AND p - coalesce(p2, 0) >= 0.2""")
def graph_seeds(s, d):
    return graph.seeds(part(s, d, "pairs").select("tid", "qid", "p"), 0.7, 0.2)


@query()
def graph_messages(s, d):
    out = graph.propagate(part(s, d, "pairs"), text_edges(s, d))
    return out.select("tid", "qid", *[F.round(c, 6).alias(c) for c in ("prior", "posterior", "outside")])


@query(f"""{EDGE.replace('WITH ', 'WITH RECURSIVE ', 1)}, reach(id, r) AS (SELECT src, src FROM m UNION SELECT reach.id, m.dst FROM reach JOIN m ON m.src = reach.r) SELECT id, min(r) AS component FROM reach GROUP BY 1""")
def graph_components(s, d):
    return graph.components(edges(s, d))


@query()
def graph_mutual_topk_whole(s, d):
    return text_edges(s, d)


@query()
def graph_components_whole(s, d):
    return graph.components(text_edges(s, d))


# learned scores and incremental runs


def labelled(s, d):
    from pyspark.ml.feature import VectorAssembler

    w = Window.partitionBy("tid")
    rows = part(s, d, "pairs").withColumn("rivals", F.count("*").over(w).cast("double")).withColumn("gap", F.max("p").over(w) - F.col("p"))
    return VectorAssembler(inputCols=["p", "raw", "rivals", "gap"], outputCol="x").transform(rows).withColumn("label", F.col("y").cast("double"))


@query()
def gate_boosted(s, d):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    rows = labelled(s, d)
    model = GBTClassifier(featuresCol="x", maxIter=5, maxDepth=3, seed=1).fit(rows.where("qid % 5 <> 0"))
    return model.transform(rows).select("qid", "tid", F.round(vector_to_array("probability")[1], 6).alias("gate"))


@query()
def oof_crossfit(s, d):
    """Each pair scored by a model that has seen no pair of its reference."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    # The folds read the pairs six times, so they are written down once.
    rows = stored(labelled(s, d).select("qid", "tid", "x", "label", F.pmod(F.xxhash64("qid"), F.lit(3)).alias("fold")))
    out = []
    for k in range(3):
        model = LogisticRegression(featuresCol="x", regParam=0.01).fit(rows.where(F.col("fold") != k))
        out.append(model.transform(rows.where(F.col("fold") == k)).select("qid", "tid", F.round(vector_to_array("probability")[1], 6).alias("oof")))
    return graph.union(out)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, max(value) AS most FROM events GROUP BY 1")
def incremental_events(s, d):
    from kinloom.streaming.incremental import run_available

    return run_available(s, f"{d}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.max("value").alias("most"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, length(props) AS n FROM events")
def json_props(s, d):
    return read(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").cast("long").alias("n"))


@query(f"""{FX} SELECT qid, CAST(('0x' || substr(sha256(concat(co, ':', qid % 50)), 1, 15))::BIGINT % 10 AS INTEGER) AS part FROM refs""")
def name_group_split(s, d):
    digest = F.sha2(F.concat("co", F.lit(":"), (F.col("qid") % 50).cast("string")).cast("binary"), 256)
    return part(s, d, "refs").select("qid", (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % 10).cast("int").alias("part"))


@query(f"""{FX}, u AS (SELECT tid, co, abs(max(p) - 0.5) AS u FROM pairs GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY co ORDER BY u, tid) AS r FROM u)
SELECT tid, co FROM (SELECT *, row_number() OVER (ORDER BY r, co) AS i FROM r WHERE r <= 10) WHERE i <= 30""")
def select_round_robin(s, d):
    u = part(s, d, "pairs").groupBy("tid", "co").agg(F.abs(F.max("p") - 0.5).alias("u"))
    r = compete.ranked(u, "co", F.asc("u"), F.asc("tid")).where("rank <= 10")
    return r.orderBy("rank", "co").limit(30).select("tid", "co")


@query(f"""{MACRO} SELECT co, round(avg({FH}), 9) AS f, round(avg(CASE WHEN deg > tp THEN {fh('deg', 'n + deg - tp')} ELSE {FH} END) - avg({FH}), 9) AS repair_missing, round(avg(CASE WHEN n > tp THEN {fh('tp', 'tp')} ELSE {FH} END) - avg({FH}), 9) AS repair_false FROM k GROUP BY co""")
def loss_decomposition(s, d):
    own = won(s, d).where("p >= 0.4").groupBy("qid").agg(F.sum("y").alias("tp"), F.count("*").alias("n"))
    k = part(s, d, "refs").join(own, "qid", "left").na.fill(0, ["tp", "n"])
    tp, n, deg = map(F.col, ("tp", "n", "deg"))
    f = decide.f_half(tp, n, deg)
    return k.groupBy("co").agg(
        F.round(F.avg(f), 9).alias("f"),
        F.round(F.avg(decide.f_half(deg, n + deg - tp, deg)) - F.avg(f), 9).alias("repair_missing"),
        F.round(F.avg(decide.f_half(tp, tp, deg)) - F.avg(f), 9).alias("repair_false"),
    )
