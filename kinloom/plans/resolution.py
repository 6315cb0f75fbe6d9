"""Queries over records with names and addresses: views, evidence, repair, validation and transfer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinloom.functions import records, text
from kinloom.operators import adapt, blocking, evidence, repair
from kinloom.plans.fixtures import read
from kinloom.plans.records import RX, record
from kinloom.plans.textual import SKELETON, sql_basic, sql_words

REGISTRY: dict = {}


def query(sql: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def listed(words) -> str:
    return ", ".join(f"'{x}'" for x in words)


LEGAL_OF = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.LEGAL.items())
SKELETON_OR_FIRST = f"CASE WHEN regexp_matches(token, '^[0-9]+$') THEN token WHEN {SKELETON} = '' THEN left(token, 1) ELSE {SKELETON} END"
STREET_OF = " ".join(f"WHEN w = '{k}' THEN '{v}'" for k, v in text.STREET.items())


def tokens(c: str):
    return text.words(text.basic(F.col(c)))


def T(x: str) -> str:
    return sql_words(sql_basic(x))


def shown(views: dict, *keys: str) -> list:
    return [c.alias(k) for k, c in views.items() if not keys or k in keys]


# normalisation


@query("SELECT doc_id, trim(regexp_replace(lower(strip_accents(regexp_extract(text, '^[A-Za-zäöüßéèàçñóíáÄÖÜÉ ]*'))), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS plain FROM documents WHERE text IS NOT NULL")
def norm_transliterated(s, d):
    """The letters that begin each text, up to its first mark, transliterated."""
    lead = F.regexp_extract("text", "^[A-Za-zäöüßéèàçñóíáÄÖÜÉ ]*", 0)
    return read(s, d, "documents").where("text IS NOT NULL").select("doc_id", records.plain(lead).alias("plain"))


@query(rf"{RX} SELECT tid, trim(regexp_replace(regexp_replace(regexp_replace(lower(address), '[!-,.:-@\[-`{{-~]', ' ', 'g'), '\s*([/-])\s*', '\1', 'g'), '\s+', ' ', 'g')) AS glued FROM rec_targets")
def address_glued(s, d):
    return record(s, d, "rec_targets").select("tid", records.glued(F.col("address")).alias("glued"))


@query(f"""{RX}, t AS (SELECT tid, {T('name')} AS w FROM rec_targets), f AS (SELECT tid, w, list_filter(w, lambda x: x NOT IN ({listed(text.NAME_STOP)})) AS f FROM t),
c AS (SELECT *, list_filter(f, lambda x: x NOT IN ({listed(text.LEGAL)})) AS c FROM f), k AS (SELECT tid, string_agg({SKELETON_OR_FIRST}, ' ' ORDER BY i) AS skel FROM (SELECT tid, unnest(c) AS token, generate_subscripts(c, 1) AS i FROM c) GROUP BY tid)
SELECT tid, array_to_string(c, ' ') AS core, array_to_string(list_sort(list_distinct(list_filter(list_transform(w, lambda x: CASE x {LEGAL_OF} END), lambda x: x IS NOT NULL))), ' ') AS legal,
array_to_string(f, ' ') AS full_name, array_to_string(c, '') AS compact, skel FROM c JOIN k USING (tid)""")
def record_name_views(s, d):
    v = records.name_views(F.col("name"))
    return record(s, d, "rec_targets").select("tid", v["core"].alias("core"), v["legal"].alias("legal"), v["full"].alias("full_name"), v["compact"].alias("compact"), v["skel"].alias("skel"))


@query(f"""{RX}, p AS (SELECT tid, list_filter(list_transform(string_split(lower(address), ','), lambda x: trim(x)), lambda x: x NOT IN ({listed(records.BLANK)})) AS p FROM rec_targets),
r AS (SELECT tid, CASE WHEN len(p) > 1 THEN p[-1] ELSE '' END AS city, CASE WHEN len(p) > 1 THEN p[1:-2] ELSE p END AS r FROM p),
t AS (SELECT tid, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT tid, list_filter({T("array_to_string(r, ' ')")}, lambda x: x NOT IN ('near', 'opposite', 'behind', 'the', 'of')) AS w FROM r)),
c AS (SELECT tid, i, CASE WHEN regexp_extract(w, '^0*([0-9]+)(st|nd|rd|th)?$', 1) <> '' THEN regexp_extract(w, '^0*([0-9]+)(st|nd|rd|th)?$', 1) {STREET_OF} ELSE w END AS w FROM t)
SELECT r.tid, city, coalesce(string_agg(w, ' ' ORDER BY i), '') AS street, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (WHERE regexp_matches(w, '^[0-9]+$')), '') AS nums FROM r LEFT JOIN c ON c.tid = r.tid GROUP BY r.tid, city""")
def record_address_views(s, d):
    return record(s, d, "rec_targets").select("tid", *shown(records.address_views(F.col("address"))))


DICTIONARY = {"foods": "food", "motors": "motor", "tools": "tool", "works": "work"}


@query(f"""{RX}, t AS (SELECT tid, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT tid, {T("regexp_replace(name, '[0-9]', '', 'g')")} AS w FROM rec_targets))
SELECT tid, string_agg(CASE w {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in DICTIONARY.items())} ELSE w END, ' ' ORDER BY i) AS name FROM t GROUP BY tid""")
def dictionary_applied(s, d):
    w = text.words(text.basic(F.regexp_replace("name", "[0-9]", "")))
    return record(s, d, "rec_targets").select("tid", F.array_join(records.learned(w, DICTIONARY), " ").alias("name"))


@query(f"""{RX} SELECT tid, array_to_string(list_sort(list_distinct(list_transform({T('name')}, lambda x: CASE x {LEGAL_OF} ELSE x END))), ' ') AS signature,
length(regexp_replace(name, '[^a-z]', '', 'g')) >= 4 AS name_valid,
length(regexp_replace(address, '[^a-z]', '', 'g')) >= 8 AND len({T('address')}) >= 2 AND regexp_matches(address, '[0-9]') AS address_valid FROM rec_targets""")
def identity_signatures(s, d):
    return record(s, d, "rec_targets").select("tid", *shown(records.identity(F.col("name"), F.col("address"))))


@query(f"""{RX}, h AS (SELECT qid, tid, regexp_extract(aa, '[0-9]+') AS a, regexp_extract(ba, '[0-9]+') AS b FROM rec_pairs WHERE ba <> ''),
i AS (SELECT *, list_filter(range(1, greatest(length(a), length(b)) + 1), lambda i: substr(rpad(a, 12, '_'), i, 1) <> substr(rpad(b, 12, '_'), i, 1)) AS d FROM h)
SELECT qid, tid, round(ln(1 + abs(CAST(a AS BIGINT) - CAST(b AS BIGINT))), 6) AS log_gap, len(d) AS digits, coalesce(list_min(d), 0) AS first, length(a) = length(b) AS alike, contains(b, a) AS within FROM i""")
def house_deviation(s, d):
    a, b = text_digits("aa"), text_digits("ba")
    v = records.house_change(a, b)
    rows = record(s, d, "rec_pairs").where("ba <> ''")
    return rows.select("qid", "tid", F.round(v["log_gap"], 6).alias("log_gap"), v["digits"].cast("long").alias("digits"), v["first"].cast("long").alias("first"), v["alike"].alias("alike"), v["within"].alias("within"))


def text_digits(c: str):
    return F.regexp_extract(c, "[0-9]+", 0)


@query(f"""{RX}, r AS (SELECT tid, co, CAST(regexp_extract(address, '^([0-9]+)-([0-9]+)', 1) AS BIGINT) AS low, CAST(regexp_extract(address, '^([0-9]+)-([0-9]+)', 2) AS BIGINT) AS high, split_part(name, ' ', 2) AS w FROM rec_targets WHERE regexp_matches(address, '^[0-9]+-[0-9]+'))
SELECT r.tid, q.qid FROM r JOIN rec_refs q ON q.co = r.co AND split_part(q.name, ' ', 2) = r.w AND CAST(split_part(q.address, ' ', 1) AS BIGINT) BETWEEN low AND high""")
def join_house_range(s, d):
    """References whose house lies in a target's range, among those of its country that share the name's second word."""
    t = record(s, d, "rec_targets").where("address RLIKE '^[0-9]+-[0-9]+'")
    low, high = (F.regexp_extract("address", "^([0-9]+)-([0-9]+)", k).cast("long") for k in (1, 2))
    t = t.select("tid", "co", low.alias("low"), high.alias("high"), F.split_part("name", F.lit(" "), F.lit(2)).alias("w"))
    q = record(s, d, "rec_refs").select("qid", "co", F.split_part("name", F.lit(" "), F.lit(2)).alias("w"), F.split_part("address", F.lit(" "), F.lit(1)).cast("long").alias("house"))
    return t.join(q, ["co", "w"]).where("house BETWEEN low AND high").select("tid", "qid")


# what changed between a pair's names


CHANGE = f"""{RX}, w AS (SELECT qid, tid, own, co, a, b, p, y, {T('a')} AS x, {T('b')} AS z FROM rec_pairs),
g AS (SELECT *, list_distinct(list_filter(x, lambda t: NOT list_contains(z, t))) AS gone, list_distinct(list_filter(z, lambda t: NOT list_contains(x, t))) AS new FROM w),
swaps AS (SELECT *, gone[1] AS old_word, new[1] AS new_word FROM g WHERE len(gone) = 1 AND len(new) = 1)"""


@query(f"""{CHANGE} SELECT qid, tid, CASE WHEN x = z THEN 'same' WHEN len(gone) = 0 AND len(new) = 0 THEN 'reorder' WHEN len(gone) = 0 THEN 'add' WHEN len(new) = 0 THEN 'drop'
WHEN len(gone) = 1 AND len(new) = 1 AND levenshtein(gone[1], new[1]) <= 2 THEN 'typo' WHEN len(gone) = 1 AND len(new) = 1 THEN 'swap' ELSE 'other' END AS kind FROM g""")
def name_change_kinds(s, d):
    return record(s, d, "rec_pairs").select("qid", "tid", records.change_kind(tokens("a"), tokens("b")).alias("kind"))


def swaps_of(s, d):
    rows = record(s, d, "rec_pairs").withColumns({"x": tokens("a"), "z": tokens("b")})
    return evidence.one_word_swaps(rows, F.col("x"), F.col("z")).select("qid", "tid", "old", "new")


@query(f"""{CHANGE}, s AS (SELECT qid, tid, old_word, new_word FROM swaps), r AS (SELECT s.qid, s.tid, s.old_word AS old, s.new_word AS new,
(SELECT count(*) FROM s u WHERE u.old_word = s.old_word AND u.new_word = s.new_word AND u.qid <> s.qid) AS forward,
(SELECT count(*) FROM s u WHERE u.old_word = s.new_word AND u.new_word = s.old_word AND u.qid <> s.qid) AS backward FROM s)
SELECT *, round((forward + 1) / (forward + backward + 2), 9) AS ratio FROM r""")
def swap_support_left_out(s, d):
    out = evidence.swap_support_without_owner(swaps_of(s, d), "qid")
    return out.withColumn("ratio", F.round("ratio", 9))


@query(f"""{CHANGE}, n AS (SELECT old_word, new_word, count(*) AS n FROM swaps GROUP BY ALL),
b AS (SELECT n.*, coalesce(m.n, 0) AS back FROM n LEFT JOIN n m ON m.old_word = n.new_word AND m.new_word = n.old_word),
bad AS (SELECT s.qid, s.tid FROM swaps s JOIN b USING (old_word, new_word) WHERE n + back >= 2 AND n / (n + back) < 0.7)
SELECT qid, tid FROM rec_pairs ANTI JOIN bad USING (qid, tid)""")
def swap_filter_words(s, d):
    return evidence.drop_unlikely_swaps(record(s, d, "rec_pairs").select("qid", "tid"), swaps_of(s, d), 2, 0.7, ["qid", "tid"])


@query(f"""{CHANGE}, c AS (SELECT word, sum(g) AS gone, sum(k) AS came FROM (SELECT old_word AS word, 1 AS g, 0 AS k FROM swaps UNION ALL SELECT new_word, 0, 1 FROM swaps) GROUP BY 1)
SELECT word, CAST(gone AS BIGINT) AS gone, CAST(came AS BIGINT) AS came, CASE WHEN gone + came < 3 THEN 'rare' WHEN 4 * gone >= 3 * (gone + came) THEN 'old' WHEN 4 * came >= 3 * (gone + came) THEN 'new' ELSE 'both' END AS kind FROM c""")
def swap_word_classes(s, d):
    return evidence.word_classes(swaps_of(s, d), 3)


LEGAL_AT = f"list_min(list_filter(list_transform(z, lambda t, i: CASE WHEN t IN ({listed(text.LEGAL)}) THEN i END), lambda v: v IS NOT NULL))"


@query(f"""{CHANGE} SELECT qid, tid, new_word AS word, CASE WHEN list_position(z, new_word) IS NULL THEN 'none' WHEN {LEGAL_AT} IS NULL THEN CASE WHEN list_position(z, new_word) = len(z) THEN 'end' ELSE 'inside' END
WHEN list_position(z, new_word) < {LEGAL_AT} THEN 'before' WHEN list_position(z, new_word) > {LEGAL_AT} THEN 'after' ELSE 'inside' END AS place FROM swaps""")
def swap_word_position(s, d):
    rows = record(s, d, "rec_pairs").withColumns({"x": tokens("a"), "z": tokens("b")})
    return evidence.one_word_swaps(rows, F.col("x"), F.col("z")).select("qid", "tid", F.col("new").alias("word"), records.legal_position(F.col("z"), F.col("new")).alias("place"))


RIVAL = f"""{RX}, k AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY p DESC, qid) AS r FROM rec_pairs),
v AS (SELECT k.*, o.qid AS rival, o.p AS rival_p, o.a AS ra FROM k LEFT JOIN k o ON o.tid = k.tid AND o.r = CASE WHEN k.r = 1 THEN 2 ELSE 1 END)"""


@query(f"""{RIVAL}, w AS (SELECT qid, tid, p - rival_p AS lead, {T('a')} AS x, {T('ra')} AS o, {T('b')} AS z FROM v WHERE rival IS NOT NULL),
c AS (SELECT *, len(list_filter(list_distinct(list_intersect(x, z)), lambda t: NOT list_contains(o, t))) AS n, len(list_filter(list_distinct(list_intersect(o, z)), lambda t: NOT list_contains(x, t))) AS k FROM w)
SELECT qid, tid, round(lead, 6) AS lead, n AS "distinct", k AS against, n - k AS support, round(len(list_intersect(x, z)) / len(z), 6) AS coverage, len(list_distinct(list_filter(x, lambda t: NOT list_contains(z, t)))) AS conflict FROM c""")
def triad_contrast(s, d):
    pairs = evidence.rivals(record(s, d, "rec_pairs")).where("rival IS NOT NULL")
    names = record(s, d, "rec_refs").select(F.col("qid").alias("rival"), F.col("name").alias("ra"))
    rows = pairs.join(names, "rival").withColumns({"x": tokens("a"), "o": tokens("ra"), "z": tokens("b")})
    v = evidence.contrast(F.col("x"), F.col("o"), F.col("z"))
    whole = [v[k].cast("long").alias(k) for k in ("distinct", "against", "support", "conflict")]
    return rows.select("qid", "tid", F.round(F.col("p") - F.col("rival_p"), 6).alias("lead"), *whole, F.round(v["coverage"], 6).alias("coverage"))


@query(f"""{RX}, a AS (SELECT qid, tid, p, row_number() OVER (PARTITION BY qid ORDER BY p DESC, tid) AS r FROM rec_pairs WHERE p >= 0.8), s AS (SELECT * FROM a WHERE r <= 4)
SELECT x.qid, x.tid, count(s.tid) AS seeds, coalesce(max(s.p), 0) AS best FROM rec_pairs x LEFT JOIN (SELECT * FROM s WHERE r <= 4) s ON s.qid = x.qid AND s.tid <> x.tid GROUP BY x.qid, x.tid""")
def feat_alias_siblings(s, d):
    """For each pair, the accepted targets of its reference (four at most) besides its own: how many, and the best."""
    pairs = record(s, d, "rec_pairs").select("qid", "tid", "p")
    seeds = evidence.sibling_seeds(pairs.where("p >= 0.8"), 4).select(F.col("qid").alias("own"), F.col("tid").alias("seed"), F.col("p").alias("seed_p"))
    met = pairs.select("qid", "tid").join(seeds, (F.col("qid") == F.col("own")) & (F.col("tid") != F.col("seed")), "left")
    return met.groupBy("qid", "tid").agg(F.count("seed").alias("seeds"), F.coalesce(F.max("seed_p"), F.lit(0.0)).alias("best"))


# samples and decisions


#: SplitMix64 in numbers of 128 bits.
SM = [f"(x + {0x9E3779B97F4A7C15}::UHUGEINT) % {2**64}::UHUGEINT", f"(xor(z1, z1 >> 30) * {0xBF58476D1CE4E5B9}::UHUGEINT) % {2**64}::UHUGEINT", f"(xor(z2, z2 >> 27) * {0x94D049BB133111EB}::UHUGEINT) % {2**64}::UHUGEINT"]


@query(f"""{RX}, a AS (SELECT tid, tid::UHUGEINT AS x FROM rec_targets), b AS (SELECT tid, {SM[0]} AS z1 FROM a), c AS (SELECT tid, {SM[1]} AS z2 FROM b), e AS (SELECT tid, {SM[2]} AS z3 FROM c)
SELECT tid, CAST(xor(z3, z3 >> 31) % 20 AS BIGINT) AS bucket FROM e""")
def splitmix_buckets(s, d):
    """One of 20 buckets for each target by SplitMix64; a 1-in-20 sample is one bucket."""
    z = records.splitmix(F.col("tid"))
    high, low = F.shiftrightunsigned(z, 32), z.bitwiseAND(0xFFFFFFFF)
    return record(s, d, "rec_targets").select("tid", ((high * (2**32 % 20) + low) % 20).alias("bucket"))


@query(f"{RX} SELECT qid, tid FROM rec_pairs WHERE greatest(p, CASE WHEN a = b THEN 0.9 ELSE 0 END) >= 0.7")
def active_pairs(s, d):
    return record(s, d, "rec_pairs").where(F.greatest("p", F.when(F.col("a") == F.col("b"), 0.9).otherwise(0.0)) >= 0.7).select("qid", "tid")


@query(f"{RX} SELECT tid, qid FROM (SELECT tid, qid, row_number() OVER (PARTITION BY tid ORDER BY round(p, 1) DESC, CAST(qid AS VARCHAR)) AS r FROM rec_pairs) WHERE r = 1")
def winner_by_id_text(s, d):
    """The best candidate by a coarse score; ties go to the smallest id as text."""
    w = Window.partitionBy("tid").orderBy(F.desc(F.round("p", 1)), F.col("qid").cast("string"))
    return record(s, d, "rec_pairs").withColumn("r", F.row_number().over(w)).where("r = 1").select("tid", "qid")


RULES = f"""{RX}, f AS (SELECT qid, tid, p, ba <> '' AND regexp_extract(aa, '[0-9]+') = regexp_extract(ba, '[0-9]+') AS same_house, a = b AS same_name,
regexp_matches(ba, '^[0-9]+-[0-9]+') AND CAST(regexp_extract(aa, '[0-9]+') AS BIGINT) BETWEEN TRY_CAST(regexp_extract(ba, '^([0-9]+)-([0-9]+)', 1) AS BIGINT) AND TRY_CAST(regexp_extract(ba, '^([0-9]+)-([0-9]+)', 2) AS BIGINT) AS in_range FROM rec_pairs),
e AS (SELECT *, max(CASE WHEN same_house AND p >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS exact FROM f),
acc AS (SELECT qid, tid, 'accept' AS rule FROM e WHERE p >= 0.5 AND NOT (NOT same_house AND exact = 1))"""


@query(f"""{RULES} SELECT * FROM acc UNION ALL SELECT qid, tid, 'sibling' FROM e WHERE p < 0.5 AND p >= 0.3 AND same_name AND same_house AND qid IN (SELECT qid FROM acc)
UNION ALL SELECT qid, tid, 'range' FROM e WHERE p < 0.5 AND p >= 0.3 AND in_range AND NOT same_house""")
def decide_hand_rules(s, d):
    low, high = (F.regexp_extract("ba", "^([0-9]+)-([0-9]+)", k).try_cast("long") for k in (1, 2))
    house = text_digits("aa")
    rows = record(s, d, "rec_pairs").select(
        "qid", "tid", "p", ((F.col("ba") != "") & (house == text_digits("ba"))).alias("same_house"), (F.col("a") == F.col("b")).alias("same_name"),
        F.coalesce(house.cast("long").between(low, high), F.lit(False)).alias("in_range"),
    )
    return repair.hand_rules(rows, 0.5, 0.3)


FLAGS = f"""{CHANGE}, fl AS (SELECT g.qid, g.tid, g.p, len(gone) = 1 AND len(new) = 1 AND levenshtein(gone[1], new[1]) > 2 AS swap, k.ba <> '' AND regexp_extract(k.aa, '[0-9]+') <> regexp_extract(k.ba, '[0-9]+') AS conflict,
len(gone) = 0 AND len(new) = 0 AS recall FROM g JOIN rec_pairs k ON k.qid = g.qid AND k.tid = g.tid),
kept AS (SELECT qid, tid FROM fl WHERE p >= 0.6 AND NOT swap AND NOT conflict)"""


def flagged_of(s, d):
    kind = records.change_kind(tokens("a"), tokens("b"))
    conflict = (F.col("ba") != "") & (text_digits("aa") != text_digits("ba"))
    return record(s, d, "rec_pairs").select("qid", "tid", "p", (kind == "swap").alias("swap"), conflict.alias("conflict"), kind.isin("same", "reorder").alias("recall"))


@query(f"{FLAGS} SELECT qid, tid, swap, conflict, recall FROM fl")
def feat_rule_flags(s, d):
    return flagged_of(s, d).drop("p")


@query(f"""{FLAGS}, r AS (SELECT tid, min(qid) AS qid FROM fl WHERE recall AND NOT swap AND NOT conflict AND tid NOT IN (SELECT tid FROM kept) GROUP BY tid HAVING count(DISTINCT qid) = 1)
SELECT qid, tid FROM kept UNION ALL SELECT qid, tid FROM r""")
def decide_name_patterns(s, d):
    flagged = flagged_of(s, d)
    return repair.pattern_rules(flagged.where("p >= 0.6").select("qid", "tid"), flagged)


@query(f"""{FLAGS} SELECT qid, tid FROM fl WHERE p >= 0.6 AND NOT conflict UNION SELECT qid, tid FROM fl WHERE p < 0.6 AND recall AND NOT conflict AND p >= 0.5""")
def policy_lexical_actions(s, d):
    f = flagged_of(s, d)
    return repair.apply_actions(f.where("p >= 0.6"), f.where("p >= 0.6 AND conflict").select("qid", "tid"), f.where("p < 0.6 AND p >= 0.5 AND recall AND NOT conflict"))


@query(f"""{FLAGS}, u AS (SELECT a, count(*) AS n FROM (SELECT DISTINCT qid, a FROM rec_pairs) GROUP BY a)
SELECT k.qid, k.tid, CASE WHEN k.ba <> '' AND NOT conflict THEN 'addressed' ELSE 'unique_name' END AS family FROM rec_pairs k JOIN fl ON fl.qid = k.qid AND fl.tid = k.tid JOIN u ON u.a = k.a
WHERE (k.ba <> '' AND NOT conflict) OR (n = 1 AND recall)""")
def policy_evidence_families(s, d):
    """Pairs that an action may rest on: an address that agrees, or else a name that one reference alone has."""
    pairs = record(s, d, "rec_pairs").select("qid", "tid", "a", "ba").join(flagged_of(s, d), ["qid", "tid"])
    unique = pairs.select("qid", "a").distinct().groupBy("a").agg(F.count("*").alias("n"))
    addressed = (F.col("ba") != "") & ~F.col("conflict")
    rows = pairs.join(unique, "a").where(addressed | ((F.col("n") == 1) & F.col("recall")))
    return rows.select("qid", "tid", F.when(addressed, "addressed").otherwise("unique_name").alias("family"))


@query(f"""{RX}, c AS (SELECT tid, arg_max(qid, p * 1000000 - qid * 0.0000001) AS qid FROM rec_pairs WHERE p >= 0.9 GROUP BY tid), pr AS (SELECT tid, qid, CASE WHEN a = b THEN 1 ELSE 2 END AS rank FROM rec_pairs WHERE p >= 0.6),
l AS (SELECT tid, min(rank) AS least FROM pr GROUP BY 1), o AS (SELECT pr.tid, min(pr.qid) AS qid FROM pr JOIN l ON l.tid = pr.tid AND l.least = pr.rank GROUP BY 1 HAVING count(DISTINCT pr.qid) = 1)
SELECT o.tid, o.qid, CASE WHEN c.qid IS NULL THEN 'add' WHEN c.qid = o.qid THEN 'same' ELSE 'move' END AS action FROM o LEFT JOIN c ON c.tid = o.tid""")
def repair_from_proposals(s, d):
    pairs = record(s, d, "rec_pairs")
    proposals = pairs.where("p >= 0.6").select("tid", "qid", F.when(F.col("a") == F.col("b"), 1).otherwise(2).alias("rank"))
    current = pairs.where("p >= 0.9").groupBy("tid").agg(F.max_by("qid", F.struct("p", -F.col("qid"))).alias("qid"))
    return repair.repair_actions(proposals, current)


@query(f"""{RX}, dup AS (SELECT qid, tid, co, p, y FROM rec_pairs UNION ALL SELECT qid, -tid - 1, co, p, y FROM rec_pairs WHERE own < 0),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY p DESC, qid) AS r FROM dup) WHERE r = 1 AND p >= 0.6)
SELECT co, count(*) AS accepted, CAST(sum(y) AS BIGINT) AS right, count(*) FILTER (WHERE tid < 0) AS copies FROM w GROUP BY co""")
def stress_orphans_decoded(s, d):
    """Every target without owner once more under a new id; all are decoded again."""
    pairs = record(s, d, "rec_pairs")
    more = repair.with_orphan_copies(pairs.select("qid", "tid", "co", "p", "y"), pairs.where("own < 0").select("tid").distinct())
    w = Window.partitionBy("tid").orderBy(F.desc("p"), "qid")
    won = more.withColumn("r", F.row_number().over(w)).where("r = 1 AND p >= 0.6")
    return won.groupBy("co").agg(F.count("*").alias("accepted"), F.sum("y").cast("long").alias("right"), F.count_if(F.col("tid") < 0).alias("copies"))


@query(f"{RX} SELECT co, count(*) AS unsafe FROM (SELECT t.tid, t.co FROM rec_targets t JOIN rec_refs r ON r.name = t.name AND r.co <> t.co GROUP BY ALL) GROUP BY co")
def country_projection_safety(s, d):
    """By country, targets that have an equal name abroad and would lose that rival in a run of their country alone."""
    t, r = record(s, d, "rec_targets").select("tid", "co", "name"), record(s, d, "rec_refs").select(F.col("co").alias("qco"), "name")
    return t.join(r, "name").where("co <> qco").select("tid", "co").distinct().groupBy("co").agg(F.count("*").alias("unsafe"))


# the output file


OUT = f"""{RX}, m AS (SELECT concat('S1-', qid) AS anchor, string_agg(concat('S', sr, '-', tid), ',' ORDER BY tid) AS ids FROM rec_pairs WHERE p >= 0.5 GROUP BY qid),
x AS (SELECT * FROM m UNION ALL SELECT 'S1-0', 'S1-0,S9-1,S2-x,S2-x,' UNION ALL SELECT 'S1-none', ''), e AS (SELECT anchor, unnest(string_split(ids, ',')) AS id FROM x WHERE ids <> ''),
k AS (SELECT DISTINCT concat('S1-', qid) AS anchor, concat('S', sr, '-', tid) AS id FROM rec_pairs), an AS (SELECT concat('S1-', qid) AS anchor FROM rec_refs), ta AS (SELECT concat('S', sr, '-', tid) AS id FROM rec_targets)"""


@query(f"""{OUT} SELECT kind, count(*) AS n FROM (
SELECT 'duplicate_row' AS kind FROM x GROUP BY anchor HAVING count(*) > 1 UNION ALL SELECT 'duplicate_id' FROM e WHERE id <> '' GROUP BY anchor, id HAVING count(*) > 1
UNION ALL SELECT 'self_match' FROM e WHERE id = anchor UNION ALL SELECT 'bad_prefix' FROM e WHERE id <> '' AND NOT regexp_matches(id, '^S[23]-')
UNION ALL SELECT 'unknown_id' FROM e WHERE regexp_matches(id, '^S[23]-') AND id NOT IN (SELECT id FROM ta) UNION ALL SELECT 'unknown_anchor' FROM x WHERE anchor NOT IN (SELECT anchor FROM an)
UNION ALL SELECT 'missing_anchor' FROM an WHERE anchor NOT IN (SELECT anchor FROM x) UNION ALL SELECT 'empty_id' FROM e WHERE id = ''
UNION ALL (SELECT 'not_a_candidate' FROM (SELECT DISTINCT anchor, id FROM e WHERE id <> '') ANTI JOIN k USING (anchor, id)) UNION ALL SELECT 'two_owners' FROM e WHERE id <> '' GROUP BY id HAVING count(DISTINCT anchor) > 1) GROUP BY kind""")
def validate_file(s, d):
    """An output with faults put in: a repeated anchor, ids that are wrong in each way, and an anchor nobody knows."""
    pairs = record(s, d, "rec_pairs").select(F.concat(F.lit("S1-"), "qid").alias("anchor"), F.concat(F.lit("S"), "sr", F.lit("-"), "tid").alias("id"), "tid", "p")
    good = pairs.where("p >= 0.5").groupBy("anchor").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tid", "id"))), lambda x: x["id"]), ",").alias("ids"))
    bad = s.createDataFrame([("S1-0", "S1-0,S9-1,S2-x,S2-x,"), ("S1-none", "")], "anchor string, ids string")
    candidates = pairs.groupBy("anchor").agg(F.array_join(F.collect_list("id"), ",").alias("ids"))
    anchors = record(s, d, "rec_refs").select(F.concat(F.lit("S1-"), "qid").alias("anchor"))
    targets = record(s, d, "rec_targets").select(F.concat(F.lit("S"), "sr", F.lit("-"), "tid").alias("id"))
    return repair.violations(good.unionByName(bad), candidates, anchors, targets)


# transfer to data without labels


EDGES = adapt.logit_edges(0.3, 0.95, 8)
BIN = " + ".join(f"CASE WHEN p >= {e!r} THEN 1 ELSE 0 END" for e in EDGES)


@query(f"{RX} SELECT co, {BIN} AS bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM rec_pairs GROUP BY ALL")
def calib_score_histogram(s, d):
    return adapt.histogram(record(s, d, "rec_pairs"), EDGES, "co").withColumn("positives", F.col("positives").cast("long"))


def split_by_country(s, d):
    """Even countries have labels, odd ones and one more have none."""
    rows = record(s, d, "rec_pairs").withColumn("group", F.when(F.substring("co", 2, 9).cast("int") % 2 == 0, "source").otherwise("target"))
    return rows.where("group = 'source'"), rows.where("group = 'target' OR co = 'n0'")


@query()
def calib_density_transfer(s, d):
    source, target = split_by_country(s, d)
    curves = adapt.density_transfer(source, target, EDGES, 50)
    return target.select("qid", "tid", F.round(adapt.apply_curve(F.col("p"), F.col("co"), curves, EDGES, 0.02), 9).alias("p"))


@query()
def calib_label_shift(s, d):
    source, target = split_by_country(s, d)
    out = adapt.label_shift(source, target, EDGES)
    rows = [(co, round(x["share"], 9), round(x["distance"], 9)) for co, x in sorted(out.items())]  # a row for each country
    return s.createDataFrame(rows, "co string, share double, distance double")


@query()
def domain_weights(s, d):
    """Weights that make the labelled rows look like the others: clipped density ratios with a mean of 1."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    source, target = split_by_country(s, d)
    both = source.withColumn("domain", F.lit(0.0)).unionByName(target.withColumn("domain", F.lit(1.0)))
    both = both.withColumn("same", (F.col("a") == F.col("b")).cast("double")).withColumn("blank", (F.col("ba") == "").cast("double"))
    rows = VectorAssembler(inputCols=["p", "same", "blank"], outputCol="x").transform(both)
    model = LogisticRegression(featuresCol="x", labelCol="domain", regParam=0.01).fit(rows)
    scored = model.transform(rows.where("domain = 0")).withColumn("ratio", adapt.density_ratio(vector_to_array("probability")[1], 0.2, 5.0))
    factor = adapt.bounded_mean_one(scored, "ratio", 0.2, 5.0)
    return scored.select("qid", "tid", F.round(F.least(F.greatest(F.col("ratio") * factor, F.lit(0.2)), F.lit(5.0)), 9).alias("weight"))


# blocking by skeletons

SKELETON_SQL = f"""{RX}, rec AS (SELECT 1 AS side, qid AS id, co, name, address FROM rec_refs UNION ALL SELECT 2, tid, co, name, address FROM rec_targets),
nw AS (SELECT side, id, co, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM (SELECT side, id, co, {T('name')} AS w FROM rec)),
aw AS (SELECT side, id, co, unnest(w) AS s, generate_subscripts(w, 1) AS i FROM (SELECT side, id, co, list_filter({T('address')}, lambda x: length(x) >= 2) AS w FROM rec)),
u AS (SELECT side, id, co, 'name' AS field, {SKELETON_OR_FIRST} AS s, i FROM nw UNION ALL SELECT side, id, co, 'address', s, i FROM aw),
g AS (SELECT side, id, co, field, s AS token FROM u UNION SELECT x.side, x.id, x.co, x.field, concat(x.s, ' ', y.s) FROM u x JOIN u y ON y.side = x.side AND y.id = x.id AND y.field = x.field AND y.i = x.i + 1
UNION SELECT side, id, co, field, string_agg(s, '' ORDER BY i) FROM u WHERE field = 'name' GROUP BY side, id, co, field),
n AS (SELECT co, count(*) AS n, count(*) FILTER (WHERE side = 1) AS n1 FROM rec GROUP BY co), df AS (SELECT co, field, token, count(*) AS df, count(*) FILTER (WHERE side = 1) AS df1 FROM g GROUP BY ALL),
idf AS (SELECT co, field, token, df1 <= greatest(20, least(2000, n1 * 3 // 100)) AS makes, ln((n + 1) / (df + 1)) + 1 AS idf FROM df JOIN n USING (co)),
v AS (SELECT side, id, co, field, token, makes, idf / sqrt(sum(idf * idf) OVER (PARTITION BY side, id, field)) AS w FROM g JOIN idf USING (co, field, token)),
t AS (SELECT id AS tid, co, field, token, makes, w AS a FROM v WHERE side = 2), q AS (SELECT id AS qid, co, field, token, w AS b FROM v WHERE side = 1),
near AS (SELECT DISTINCT tid, qid FROM t JOIN q USING (co, field, token) WHERE makes),
c AS (SELECT tid, qid, round(coalesce(sum(a * b) FILTER (WHERE field = 'name'), 0), 6) AS name_cos, round(coalesce(sum(a * b) FILTER (WHERE field = 'address'), 0), 6) AS address_cos
FROM near JOIN t USING (tid) JOIN q USING (qid, field, token) GROUP BY tid, qid)
SELECT tid, qid, name_cos, address_cos, score FROM (SELECT *, round(name_cos + address_cos, 6) AS score, row_number() OVER (PARTITION BY tid ORDER BY round(name_cos + address_cos, 6) DESC, qid) AS r FROM c) WHERE r <= 5"""


def runs(w):
    """Distinct words of a list and pairs of neighbours."""
    n = F.size(w) - 1
    pairs = F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n < 1, F.array_distinct(w)).otherwise(F.array_distinct(F.concat(w, pairs)))


@query(SKELETON_SQL)
def block_skeleton(s, d):
    """The five best references of each target by skeletons of names (words, neighbours, all joined) and words of addresses."""
    names, streets = F.transform(tokens("name"), text.skeleton), F.filter(tokens("address"), lambda w: F.length(w) >= 2)
    compact = F.when(F.size("n") > 0, F.array(F.array_join("n", ""))).otherwise(F.array().cast("array<string>"))
    fields = F.array_union(runs(F.col("n")), compact), runs(F.col("a"))

    def worded(name: str, key: str):
        rows = record(s, d, name).select(F.col(key).alias("id"), "co", names.alias("n"), streets.alias("a"))
        return rows.select("id", "co", F.array(*[blocking.hashed(w, i) for i, w in enumerate(fields)]).alias("h"))

    return blocking.field_neighbours(worded("rec_refs", "qid"), worded("rec_targets", "tid"), 20, 5)
