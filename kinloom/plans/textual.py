"""Queries: normalisation, string similarity and candidate generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinloom.functions import similarity, text
from kinloom.operators import blocking, compete
from kinloom.plans.fixtures import FX, part, read
from kinloom.plans.records import RX, record
from kinloom.sources.files import numbered, stored

REGISTRY: dict = {}


def query(sql: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def sql_basic(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', ' ', 'g'), '\s+', ' ', 'g'))"


def sql_words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


#: Names and addresses of all records, references and targets.
NAMES = f"""{RX}, names AS (SELECT co, name AS nm, address AS ad FROM rec_refs UNION ALL SELECT co, name, address FROM rec_targets)"""


def names(s, d):
    both = record(s, d, "rec_refs").unionByName(record(s, d, "rec_targets"), allowMissingColumns=True)
    return both.select("co", F.col("name").alias("nm"), F.col("address").alias("ad"))


@query(f"SELECT p_partkey, {sql_basic('p_name')} AS name, {sql_basic('p_type')} AS type FROM part")
def norm_basic(s, d):
    return read(s, d, "part").select("p_partkey", text.basic(F.col("p_name")).alias("name"), text.basic(F.col("p_type")).alias("type"))


@query()
def norm_compatible(s, d):
    rows = read(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return rows.select("id", text.basic(text.compatible("text")).alias("nm"), text.folded(F.col("text")).alias("folded"))


SKELETON = "token"
for _a, _b in text.DIGRAPHS:
    SKELETON = f"replace({SKELETON}, '{_a}', '{_b}')"
SKELETON = f"replace(translate({SKELETON}, 'cqgdbwz', 'kkktpvs'), 'x', 'ks')"
SKELETON = f"regexp_replace({SKELETON}, '[aeiouyh]', '', 'g')"
# RE2 has no back references, so repeats are collapsed letter by letter.
for _c in "bcdfgjklmnpqrstvwxz0123456789":
    SKELETON = f"regexp_replace({SKELETON}, '{_c}+', '{_c}', 'g')"


@query(f"""WITH t AS (SELECT DISTINCT unnest({sql_words(sql_basic('p_name'))}) AS token FROM part)
SELECT token, CASE WHEN regexp_matches(token, '^[0-9]+$') THEN token WHEN {SKELETON} = '' THEN left(token, 1) ELSE {SKELETON} END AS skeleton FROM t""")
def skeleton(s, d):
    tokens = read(s, d, "part").select(F.explode(text.words(text.basic(F.col("p_name")))).alias("token")).distinct()
    return tokens.select("token", text.skeleton(F.col("token")).alias("skeleton"))


@query(f"""{NAMES}, t AS (SELECT DISTINCT unnest({sql_words(sql_basic('nm'))}) AS token FROM names)
SELECT token, CASE WHEN token IN ({', '.join(f"'{x}'" for x in text.LEGAL)}) THEN 1 WHEN token IN ({', '.join(f"'{x}'" for x in text.NAME_STOP)}) THEN 2 ELSE 0 END AS kind FROM t""")
def name_tokens_classified(s, d):
    return names(s, d).select(F.explode(text.words(text.basic(F.col("nm")))).alias("token")).distinct().select("token", text.kind(F.col("token")).alias("kind"))


@query()
def name_tokens_classified_all(s, d):
    """name_tokens_classified over the whole texts of all documents."""
    w = text.words(text.basic(F.col("text")))
    return read(s, d, "documents").select(F.explode(w).alias("token")).distinct().select("token", text.kind(F.col("token")).alias("kind"))


#: Addresses made of ids, the same in both engines.
ADDRESS = "concat('0', {k} % 97, ' - ', {k} % 97 + {k} % 5, ' main street, floor ', {k} % 7, 'th road')"


def addresses(s, d):
    k = F.col("c_custkey")
    made = F.concat(F.lit("0"), k % 97, F.lit(" - "), k % 97 + k % 5, F.lit(" main street, floor "), k % 7, F.lit("th road"))
    return read(s, d, "customer").select("c_custkey", made.alias("ad"))


AD = f"WITH a AS (SELECT c_custkey, {ADDRESS.format(k='c_custkey')} AS ad FROM customer)"
BARE = "CASE WHEN regexp_replace({x}, '^0+', '') = '' THEN '0' ELSE regexp_replace({x}, '^0+', '') END"


@query(f"""{AD} SELECT c_custkey, {BARE.format(x="regexp_extract(ad, '[0-9]+')")} AS house,
array_to_string(list_transform(regexp_extract_all(ad, '[0-9]+'), lambda x: {BARE.format(x='x')}), ',') AS numbers,
CAST(regexp_extract(ad, '([0-9]+) *- *([0-9]+)', 1) AS BIGINT) AS low, CAST(regexp_extract(ad, '([0-9]+) *- *([0-9]+)', 2) AS BIGINT) AS high FROM a""")
def address_numbers(s, d):
    ad = F.col("ad")
    return addresses(s, d).select("c_custkey", text.house(ad).alias("house"), F.array_join(text.numbers(ad), ",").alias("numbers"), text.house_range(ad, 1).alias("low"), text.house_range(ad, 2).alias("high"))


@query(f"""{AD}, h AS (SELECT c_custkey, {BARE.format(x="regexp_extract(ad, '[0-9]+')")} AS h FROM a)
SELECT x.c_custkey, CASE WHEN x.h = y.h THEN 0 ELSE 1 END AS segment FROM h x JOIN h y ON y.c_custkey = x.c_custkey % 100 + 1""")
def house_segment(s, d):
    a = addresses(s, d)
    b = a.select((F.col("c_custkey") - 1).alias("k"), F.col("ad").alias("other"))
    both = a.join(b, a["c_custkey"] % 100 == b["k"])
    return both.select("c_custkey", text.house_segment(F.col("ad"), F.col("other")).alias("segment"))


@query(f"""{AD}, t AS (SELECT c_custkey, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM (SELECT c_custkey, {sql_words(sql_basic('ad'))} AS w FROM a)),
c AS (SELECT c_custkey, i, CASE WHEN regexp_extract(w, '^0*([0-9]+)(st|nd|rd|th)?$', 1) <> '' THEN regexp_extract(w, '^0*([0-9]+)(st|nd|rd|th)?$', 1)
{' '.join(f"WHEN w = '{k}' THEN '{v}'" for k, v in text.STREET.items())} ELSE w END AS w FROM t)
SELECT c_custkey, string_agg(w, ' ' ORDER BY i) AS ad FROM c GROUP BY 1""")
def address_canonical(s, d):
    tokens = F.transform(text.words(text.basic(F.col("ad"))), text.address_token)
    return addresses(s, d).select("c_custkey", F.array_join(tokens, " ").alias("ad"))


@query(r"""SELECT page_id, regexp_replace(regexp_extract(lower(url), 'https?://([^/\s?#:]+)', 1), '^www\.', '') AS domain,
regexp_matches(lower(url), '^https?://m\.') AS mobile FROM pages""")
def domain_flags(s, d):
    url = F.col("url")
    return read(s, d, "pages").select("page_id", text.domain(url).alias("domain"), F.lower(url).rlike(r"^https?://m\.").alias("mobile"))


@query(f"""SELECT p_partkey, array_to_string(list_sort(list_distinct({sql_words(sql_basic('p_name'))})), ' ') AS key,
array_to_string(list_transform({sql_words(sql_basic('p_name'))}, lambda w: left(w, 1)), '') AS initials FROM part""")
def sorted_token_key(s, d):
    n = text.basic(F.col("p_name"))
    return read(s, d, "part").select("p_partkey", text.sorted_tokens(n).alias("key"), text.initials(n).alias("initials"))


# similarity: names of the records' pairs, and whole texts of the documents' pairs

PAIRS = f"{RX}, x AS (SELECT qid, tid, a, b FROM rec_pairs)"


def pair_texts(s, d):
    return record(s, d, "rec_pairs").select("qid", "tid", "a", "b")


def whole_pair_texts(s, d):
    """Each pair with both texts, dealt out evenly: comparing them takes far longer than reading them."""
    r = part(s, d, "refs").select("qid", F.col("text").alias("a"))
    t = part(s, d, "targets").select("tid", F.col("text").alias("b"))
    x = part(s, d, "pairs").select("qid", "tid").join(r, "qid").join(t, "tid")
    return x.repartition(8 * s.sparkContext.defaultParallelism, "qid", "tid")


@query("""WITH n AS (SELECT DISTINCT p_name AS a FROM part), r AS (SELECT a, row_number() OVER (ORDER BY a) AS i FROM n)
SELECT x.a, y.a AS b, levenshtein(x.a, y.a) AS distance, round(jaro_winkler_similarity(x.a, y.a), 6) AS jw FROM r x JOIN r y ON y.i BETWEEN x.i + 1 AND x.i + 5""")
def sim_levenshtein_jaro_winkler(s, d):
    n = numbered(read(s, d, "part").select(F.col("p_name").alias("a")).distinct(), "a", "i")
    ahead = n.select("a", F.explode(F.sequence(F.col("i") + 1, F.col("i") + 5)).alias("i"))
    pairs = ahead.join(n.select(F.col("a").alias("b"), "i"), "i")
    return pairs.select("a", "b", F.levenshtein("a", "b").cast("long").alias("distance"), F.round(similarity.jaro_winkler_of("a", "b"), 6).alias("jw"))


def ratios(x):
    named = {"ratio": similarity.ratio_of, "sort": similarity.token_sort_of, "set": similarity.token_set_of, "partial": similarity.partial_of}
    return x.select("qid", "tid", *[F.round(f("a", "b"), 6).alias(n) for n, f in named.items()], similarity.subsequence_of("a", "b").alias("inside"))


@query()
def sim_ratios(s, d):
    return ratios(pair_texts(s, d))


@query()
def sim_ratios_whole(s, d):
    """sim_ratios of whole texts; time grows with the product of both lengths."""
    return ratios(whole_pair_texts(s, d))


W = "list_distinct(list_filter(string_split(lower({x}), ' '), lambda w: w <> ''))"


@query(f"""{PAIRS}, w AS (SELECT qid, tid, {W.format(x='a')} AS a, {W.format(x='b')} AS b FROM x),
n AS (SELECT qid, tid, len(list_intersect(a, b)) AS m, len(a) AS n, len(b) AS k FROM w)
SELECT qid, tid, round(CASE WHEN k > 0 THEN m / k ELSE 0 END, 6) AS cover_b, round(CASE WHEN n > 0 THEN m / n ELSE 0 END, 6) AS cover_a, round(CASE WHEN n + k - m > 0 THEN m / (n + k - m) ELSE 0 END, 6) AS jaccard FROM n""")
def sim_token_sets(s, d):
    x = pair_texts(s, d)
    o = similarity.overlap(text.words(F.lower("a")), text.words(F.lower("b")))
    return x.select("qid", "tid", *[F.round(c, 6).alias(n) for n, c in o.items()])


@query()
def sim_token_sets_whole(s, d):
    """sim_token_sets over all words of both texts."""
    x = whole_pair_texts(s, d)
    o = similarity.overlap(text.words(F.lower("a")), text.words(F.lower("b")))
    return x.select("qid", "tid", *[F.round(c, 6).alias(n) for n, c in o.items()])


@query("""WITH r AS (SELECT DISTINCT p_name AS a FROM part), g AS (SELECT a, list_distinct(list_transform(range(1, greatest(length(a) - 1, 1)), lambda i: substr(a, i, 3))) AS g FROM r),
p AS (SELECT x.a, y.a AS b, x.g AS gx, y.g AS gy FROM g x JOIN g y ON left(x.a, 3) = left(y.a, 3) AND x.a < y.a)
SELECT a, b, round(len(list_intersect(gx, gy)) / (len(gx) + len(gy) - len(list_intersect(gx, gy))), 6) AS jaccard FROM p""")
def sim_trigrams(s, d):
    n = read(s, d, "part").select(F.col("p_name").alias("a")).distinct().withColumn("k", F.left("a", F.lit(3))).withColumn("g", similarity.trigrams(F.col("a")))
    o = n.select(F.col("a").alias("b"), "k", F.col("g").alias("h"))
    both = n.join(o, "k").where("a < b")
    return both.select("a", "b", F.round(similarity.overlap(F.col("g"), F.col("h"))["jaccard"], 6).alias("jaccard"))


@query(f"""{AD}, n AS (SELECT c_custkey, list_distinct(regexp_extract_all(ad, '[0-9]+')) AS n FROM a),
p AS (SELECT x.c_custkey, x.n AS a, y.n AS b FROM n x JOIN n y ON y.c_custkey = x.c_custkey % 50 + 1)
SELECT c_custkey, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS jaccard, CASE WHEN len(list_intersect(a, b)) = 0 THEN 1 ELSE 0 END AS conflict,
CASE WHEN len(a) = len(b) AND len(list_intersect(a, b)) = len(a) THEN 1 ELSE 0 END AS equal FROM p""")
def sim_numbers(s, d):
    a = addresses(s, d).select("c_custkey", F.regexp_extract_all("ad", F.lit(r"(\d+)"), F.lit(1)).alias("a"))
    b = a.select((F.col("c_custkey") - 1).alias("k"), F.col("a").alias("b"))
    o = similarity.digit_overlap(F.col("a"), F.col("b"))
    return a.join(b, a["c_custkey"] % 50 == b["k"]).select("c_custkey", F.round(o["jaccard"], 6).alias("jaccard"), o["conflict"].alias("conflict"), o["equal"].alias("equal"))


# blocking

SIDES = f"""{RX}, qt AS (SELECT DISTINCT qid, unnest({W.format(x='name')}) AS token FROM rec_refs),
tt AS (SELECT DISTINCT tid, unnest({W.format(x='name')}) AS token FROM rec_targets)"""


def sides(s, d):
    w = F.explode(F.array_distinct(text.words(F.lower("name")))).alias("token")
    return record(s, d, "rec_refs").select("qid", w), record(s, d, "rec_targets").select("tid", w)


def whole_sides(s, d):
    w = F.array_distinct(text.words(F.lower("text")))
    q = part(s, d, "refs").select("qid", F.explode(w).alias("token"))
    return q, part(s, d, "targets").select("tid", F.explode(w).alias("token"))


#: References that may share a token which makes candidates; n and least are put in.
SHARE_CAP = "greatest({least}, least(2000, {n} * 3 // 100))"
TFIDF = f"""{SIDES}, n AS (SELECT count(DISTINCT qid) AS n FROM qt), df AS (SELECT token, count(*) AS df FROM qt GROUP BY 1),
idf AS (SELECT token, ln((n + 1) / (df + 1)) + 1 AS idf, df <= {SHARE_CAP.format(least=1, n='n')} AS makes FROM df, n),
qw AS (SELECT qid, token, makes, idf / sqrt(sum(idf * idf) OVER (PARTITION BY qid)) AS w FROM qt JOIN idf USING (token)),
tw AS (SELECT tid, token, idf / sqrt(sum(idf * idf) OVER (PARTITION BY tid)) AS w FROM tt JOIN idf USING (token)),
near AS (SELECT DISTINCT tid, qid FROM tw JOIN qw USING (token) WHERE makes),
c AS (SELECT tid, qid, round(sum(qw.w * tw.w), 6) AS score FROM near JOIN tw USING (tid) JOIN qw USING (qid, token) GROUP BY ALL)"""


def tfidf(s, d, k):
    return blocking.best_by_cosine(*tfidf_weights(*named_postings(s, d)), k)


@query(f"{TFIDF} SELECT tid, qid, score FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY score DESC, qid) AS r FROM c) WHERE r <= 5")
def block_token_tfidf_topk(s, d):
    return tfidf(s, d, 5)


#: The same cosines of all pairs that share a word, however common.
TFIDF_ALL = f"""{SIDES}, n AS (SELECT count(DISTINCT qid) AS n FROM qt), df AS (SELECT token, count(*) AS df FROM qt GROUP BY 1),
idf AS (SELECT token, ln((n + 1) / (df + 1)) + 1 AS idf FROM df, n),
qw AS (SELECT qid, token, idf / sqrt(sum(idf * idf) OVER (PARTITION BY qid)) AS w FROM qt JOIN idf USING (token)),
tw AS (SELECT tid, token, idf / sqrt(sum(idf * idf) OVER (PARTITION BY tid)) AS w FROM tt JOIN idf USING (token)),
c AS (SELECT tid, qid, round(sum(qw.w * tw.w), 6) AS score FROM tw JOIN qw USING (token) GROUP BY ALL)"""


@query(f"""{TFIDF_ALL}, r AS (SELECT tid, qid, row_number() OVER (PARTITION BY tid ORDER BY score DESC, qid) AS r FROM c),
o AS (SELECT t.tid, r.r FROM rec_targets t LEFT JOIN r ON r.tid = t.tid AND r.qid = t.own WHERE own >= 0)
SELECT k, count(*) AS owned, count(*) FILTER (WHERE r <= k) AS found, count(*) FILTER (WHERE r <= k) / count(*) AS recall FROM o, (VALUES (1), (3), (5)) v(k) GROUP BY k""")
def block_recall_at_k(s, d):
    """Owners among the best of all references that share a word of the name."""
    q, t = sides(s, d)
    idf = blocking.smoothed_idf(q.distinct(), "qid").select("token", "idf")
    rows = compete.ranked(blocking.best_by_sets(t, q, idf, 5), "tid", F.desc("score"), F.asc("qid"))
    return blocking.recall_at(rows, record(s, d, "rec_targets"), [1, 3, 5])


def tfidf_weights(q, t, least=1):
    """Weights of all tokens of both sides that references have, and the tokens that may make candidates."""
    idf = blocking.smoothed_idf(q, "qid", least)
    most = blocking.share_cap(q.select("qid").distinct().count(), least)
    tokens = idf.select("token", "idf")
    return blocking.weighted(t, "tid", tokens), blocking.weighted(q, "qid", tokens), idf.where(F.col("df") <= most)


def posted(both):
    return [blocking.postings(x, k, F.array("token")) for x, k in zip(both, ("qid", "tid"), strict=True)]


def named_postings(s, d):
    return posted(sides(s, d))


def whole_rows(s, d):
    """References and targets as (id, co, h), with the distinct words of whole texts as hashes, for all as one country.

    Both come from one pass over the members of entities, which are refs and targets of the fixture, and are kept on disk.
    """
    h = F.array(blocking.hashed(F.array_distinct(text.words(F.lower("text"))))).alias("h")
    is_ref = ((F.col("doc_id") == F.col("q")) & (F.col("decoy") == 0)).alias("is_ref")
    rows = stored(part(s, d, "members_").select(F.col("doc_id").alias("id"), F.lit("").alias("co"), h, is_ref))
    return [blocking.rows_by_id(rows.where(c).drop("is_ref")) for c in (F.col("is_ref"), ~F.col("is_ref"))]


def whole_tfidf(s, d, k):
    """The k best by all words."""
    q, t = whole_rows(s, d)
    return blocking.best_by_words(t, q, blocking.reference_idf(q), k)


@query()
def block_token_tfidf_whole(s, d):
    """The five best by all words; words of up to 3 % of the references (2,000) make candidates, and all words count in scores."""
    return whole_tfidf(s, d, 5)


@query()
def block_recall_whole(s, d):
    rows = compete.ranked(whole_tfidf(s, d, 5), "tid", F.desc("score"), F.asc("qid"))
    return blocking.recall_at(rows, part(s, d, "targets"), [1, 3, 5])


@query()
def block_exact_whole(s, d):
    """Equal whole texts in a country, of up to eight references."""
    k = F.xxhash64("text").alias("k")
    rows = [part(s, d, n).select(i, "co", "text", k) for n, i in (("targets", "tid"), ("refs", "qid"))]
    return blocking.exact_keys(*rows, ["co", "k", "text"], 8)


@query(f"{RX} SELECT t.tid, r.qid FROM rec_targets t JOIN rec_refs r ON r.co = t.co AND r.name = t.name")
def block_exact_keys(s, d):
    """Equal names in a country."""
    return blocking.exact_keys(record(s, d, "rec_targets").select("tid", "co", "name"), record(s, d, "rec_refs").select("qid", "co", "name"), ["co", "name"])


@query(f"""{RX}, k AS (SELECT qid, co, address, count(*) OVER (PARTITION BY co, address) AS n FROM rec_refs WHERE address <> '')
SELECT t.tid, k.qid FROM rec_targets t JOIN k ON k.co = t.co AND k.address = t.address WHERE n <= 8""")
def block_exact_recall(s, d):
    """Equal addresses in a country, of up to eight references; a blank address is no key."""
    t, r = (record(s, d, n).where("address <> ''").select(i, "co", "address") for n, i in (("rec_targets", "tid"), ("rec_refs", "qid")))
    return blocking.exact_keys(t, r, ["co", "address"], 8)


@query(f"""{SIDES}, a AS (SELECT *, count(*) OVER (PARTITION BY token) AS dt FROM tt), b AS (SELECT *, count(*) OVER (PARTITION BY token) AS dr FROM qt)
SELECT tid, qid, count(*) AS witnesses, round(sum(1 / sqrt(dr * dt)), 6) AS support FROM a JOIN b USING (token) WHERE dt <= 64 AND dr <= 8 GROUP BY ALL""")
def block_rare_witness(s, d):
    q, t = sides(s, d)
    return blocking.rare_witnesses(t, q, 8, 64)


@query()
def block_rare_witness_whole(s, d):
    """block_rare_witness over all words of both texts."""
    q, t = whole_sides(s, d)
    return blocking.rare_witnesses(t, q, 8, 64)


@query(f"""{FX}, a AS (SELECT tid, qid, row_number() OVER (PARTITION BY tid ORDER BY p DESC, qid) AS r FROM pairs),
b AS (SELECT tid, qid, row_number() OVER (PARTITION BY tid ORDER BY raw DESC, qid) AS r FROM pairs)
SELECT tid, qid, round(sum(1 / (20 + r)), 9) AS rrf FROM (SELECT * FROM a WHERE r <= 3 UNION ALL SELECT * FROM b WHERE r <= 3) GROUP BY ALL""")
def block_rrf_union(s, d):
    lanes = [compete.ranked(part(s, d, "pairs"), "tid", F.desc(c), F.asc("qid")).where("rank <= 3") for c in ("p", "raw")]
    return blocking.rank_fusion(lanes)


@query(f"""{FX}, a AS (SELECT tid, qid, p FROM pairs WHERE p >= 0.3), b AS (SELECT tid, qid, raw AS ext FROM pairs WHERE raw >= 0.6)
SELECT coalesce(a.tid, b.tid) AS tid, coalesce(a.qid, b.qid) AS qid, coalesce(p, 0.000001) AS p, coalesce(ext, 0.000001) AS ext, a.tid IS NULL AS outside FROM a FULL JOIN b ON a.tid = b.tid AND a.qid = b.qid""")
def block_external_union(s, d):
    p = part(s, d, "pairs")
    return blocking.union_scores(p.where("p >= 0.3").select("tid", "qid", "p"), p.where("raw >= 0.6").select("tid", "qid", F.col("raw").alias("ext")), 1e-6)


COS = "round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)), 6)"


@query(f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT q.vec_id AS qid, v.vec_id AS vid, {COS} AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT qid, vid, CAST(rank AS INTEGER) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vid) AS rank FROM c) WHERE rank <= 5""")
def knn_exact_topk(s, d):
    e = read(s, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return blocking.exact_neighbours(queries, e.select(F.col("vec_id").alias("vid"), F.col("embedding").alias("v")), 5)


@query(f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT q.vec_id AS qid, v.vec_id AS vid, {COS} AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT vid AS tid, max(1 / rank) AS reverse FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vid) AS rank FROM c) WHERE rank <= 5 GROUP BY 1""")
def knn_reverse_rank(s, d):
    return knn_exact_topk(s, d).groupBy(F.col("vid").alias("tid")).agg(F.max(1 / F.col("rank")).alias("reverse"))


@query(f"""{FX} SELECT tid FROM (SELECT tid, row_number() OVER (ORDER BY abs(max(p) - 0.5), tid) AS r FROM pairs GROUP BY tid) WHERE r <= 25""")
def select_uncertain(s, d):
    best = part(s, d, "pairs").groupBy("tid").agg(F.abs(F.max("p") - 0.5).alias("u"))
    return best.orderBy("u", "tid").limit(25).select("tid")


@query(f"""{RX}, u AS (SELECT co, name, min(qid) AS qid, min(address) AS address FROM rec_refs GROUP BY co, name HAVING count(*) = 1)
SELECT t.tid, u.qid, CASE WHEN t.address = u.address THEN 1 ELSE 2 END AS rule FROM rec_targets t JOIN u ON u.co = t.co AND u.name = t.name""")
def block_identity_rules(s, d):
    """Targets with a name that one reference of their country alone has: with its address too, or without."""
    unique = record(s, d, "rec_refs").groupBy("co", "name").agg(F.min("qid").alias("qid"), F.min("address").alias("known"), F.count("*").alias("n")).where("n = 1")
    hit = record(s, d, "rec_targets").join(unique, ["co", "name"])
    return hit.select("tid", "qid", F.when(F.col("address") == F.col("known"), 1).otherwise(2).alias("rule"))
