"""The thin queries over the operators of this folder, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import (
    common,
    decontamination,
    html_main,
    jaccard_join,
    quality,
    rotated_codes,
    subword_lattice,
    token_files,
    toxicity,
    url_filter,
    word_bpe,
)

#: The list that op7 judges URLs by.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def judged(scored: DataFrame, divisor: int, held: int) -> DataFrame:
    return scored.select(
        "doc_id",
        (common.remainder(F.col("doc_id"), divisor) == held).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", doc_id="long", text="string")
    labels = common.table(spark, sf_dir, "labels", doc_id="long", toxic="int")
    model = toxicity.train(docs, labels.where(common.remainder(F.col("doc_id"), 5) != 0))
    return judged(toxicity.score(docs, model), 5, 0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", doc_id="long", text="string")
    labels = common.table(spark, sf_dir, "labels", doc_id="long", quality="int")
    model = quality.train(docs, labels.where(common.remainder(F.col("doc_id"), 3) != 1))
    return judged(quality.score(docs, model), 3, 1)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", doc_id="long", text="string")
    items = common.table(spark, sf_dir, "benchmark", item_id="long", text="string")
    found = decontamination.find_items(docs, items, width=10, slop=1)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    ids = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.array_join(F.array_sort(F.col("near").cast("array<string>")), ",").alias("near_items"),
    )


OP3_SQL = f"""
WITH dw AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
  FROM documents
),
iw AS (
  SELECT item_id, regexp_extract_all(translate(text, '{common.UPPER}', '{common.LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM (SELECT item_id, w, least(10, len(w)) AS n FROM iw WHERE len(w) > 0))
),
starts AS (
  SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
),
hits AS (SELECT k, i, n, item_id FROM starts JOIN windows USING (n, t)),
covered AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM hits) GROUP BY k),
items AS (
  SELECT k, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY k
),
gapped AS (
  SELECT k, n, i, g, array_to_string(w[i:i + g - 1] || w[i + g + 1:i + n], ' ') AS t
  FROM (SELECT k, n, i, w, unnest(range(1, n)) AS g
        FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 1)) AS i FROM dw, (SELECT DISTINCT n FROM windows) WHERE len(w) > n))
),
close AS (
  SELECT k, string_agg(s, ',' ORDER BY s) AS near
  FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS s FROM gapped JOIN windows USING (n, t)
        ANTI JOIN (SELECT DISTINCT k, item_id FROM hits) USING (k, item_id)) GROUP BY k
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(near, '') AS near_items
FROM dw LEFT JOIN covered USING (k) LEFT JOIN items USING (k) LEFT JOIN close USING (k)
"""


def op4_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", doc_id="long", text="string")
    held_out = common.remainder(F.col("doc_id"), 7) == 2
    scored = subword_lattice.score_texts(docs.withColumn("training", ~held_out), vocabulary("piece_bpe_32k.model"))
    return scored.select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op5_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages", page_id="long", url="string", html="string")
    text = html_main.extract(pages, html_main.trained())
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", doc_id="long", text="string")
    return jaccard_join.join_components(docs, width=5).drop("key")


OP6_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
),
s AS (
  SELECT DISTINCT k, array_to_string(w[i:i + 4], ' ') AS t
  FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
sets AS (SELECT k, md5(string_agg(t, '|' ORDER BY t)) AS h FROM s GROUP BY k),
rep AS (SELECT min(k) AS k, h FROM sets GROUP BY h),
rs AS (SELECT s.k, s.t FROM s JOIN rep USING (k)),
rare AS (SELECT t FROM rs GROUP BY t HAVING count(*) > 1),
met AS (
  SELECT x.k AS a, y.k AS b, count(*) AS m
  FROM rs x JOIN rare USING (t) JOIN rs y USING (t) WHERE x.k < y.k GROUP BY x.k, y.k
),
links AS (
  SELECT a, b FROM met JOIN n na ON na.k = a JOIN n nb ON nb.k = b WHERE 100 * m >= 80 * (na.n + nb.n - m)
),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(k, r) AS (
  SELECT k, k FROM rep UNION SELECT reach.k, edges.b FROM reach JOIN edges ON edges.a = reach.r
),
comp AS (SELECT k, min(r) AS c FROM reach GROUP BY k),
placed AS (SELECT d.k, d.doc_id, c FROM d JOIN sets USING (k) JOIN rep USING (h) JOIN comp ON comp.k = rep.k),
least AS (SELECT c, min(doc_id) AS component_id FROM placed GROUP BY c)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (k) LEFT JOIN placed USING (k) LEFT JOIN least USING (c)
"""


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages", page_id="long", url="string")
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {listed} AS t(host, path, verdict)")
    return url_filter.filter_urls(pages, rules, default="allow")


OP7_SQL = f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
),
cut AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM rest),
parts AS (
  SELECT row_number() OVER () AS k, page_id, translate(h, '{common.UPPER}', '{common.LOWER}') AS host,
         regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path
  FROM cut
),
best AS (
  SELECT k, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY k
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (k)
"""


def op8_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents", doc_id="long", text="string")
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    rows = word_bpe.decode(word_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings", vec_id="long", embedding="array<double>")
    return rotated_codes.nearest(vectors, lambda vec_id: vec_id % 100 == 0, k=10)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
    AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id, array_distance(q.e, c.e) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
  )
) WHERE rank <= 10
"""


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", doc_id="long", text="string")
    path = common.shared_dir(spark, "token-files")
    token_files.write_token_files(docs, path, vocabulary("byte_bpe_50k.json"), end_id=2)
    rows = token_files.read_token_files(spark, path)
    return rows.mapInArrow(token_files.checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


REGISTERED = [
    op1_toxicity,
    op2_quality,
    op3_decontamination,
    op4_subword_lattice,
    op5_html_main,
    op6_jaccard_join,
    op7_url_filter,
    op8_word_bpe,
    op9_rotated_codes,
    op10_token_files,
    pipeline,
]


def queries() -> dict:
    return {f.__name__: f for f in REGISTERED}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3_SQL, "op6_jaccard_join": OP6_SQL, "op7_url_filter": OP7_SQL, "op9_rotated_codes": OP9_SQL}
