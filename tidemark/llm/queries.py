"""Registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import alignment, classlm, decontamination, hamming, licenses, linededup, maintext, packing, phrases, quality, secrets, sharding, simhash
from tidemark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard(table(spark, sf_dir, "documents"))
    return sharded.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset", "bucket",
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    measured = decontamination.contamination(docs, benchmark)
    return measured.select(
        "doc_id", F.col("n_words").cast("long"), F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(*kinds: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"].isin(*kinds))).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select(
        "doc_id", *(count(kind).alias(f"n_{kind}") for kind in secrets.BASE),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", F.col("base_places").alias("n_base"), "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = classlm.train(docs)
    scored = classlm.score(docs, model)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels))
    return scored.select(
        "doc_id", quality.held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"),
    )


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hamming.top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP9_SQL = """
WITH signs AS (
  SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS s
  FROM embeddings WHERE len(embedding) = 64
), near AS (
  SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id,
         CAST(len(list_filter(list_zip(q.s, v.s), lambda p: p[1] <> p[2])) AS BIGINT) AS distance
  FROM signs q JOIN signs v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM near
)
SELECT query_id, rank, neighbor_id, distance FROM ranked WHERE rank <= 10
"""

WORDS_SQL = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = f"""
WITH item AS (
  SELECT item_id, {WORDS_SQL.format("coalesce(text, '')")} AS w FROM benchmark
), item_window AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k,
         array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS gram
  FROM item, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(p) WHERE len(w) > 0
), doc AS (
  SELECT doc_id, {WORDS_SQL.format("coalesce(text, '')")} AS w FROM documents
), doc_window AS (
  SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS gram
  FROM doc, (SELECT DISTINCT k FROM item_window), unnest(generate_series(1, len(w) - k + 1)) AS t(p)
), hit AS (
  SELECT doc_id, item_id, k, p FROM doc_window JOIN item_window USING (k, gram)
), words AS (
  SELECT doc_id, count(DISTINCT i) AS n_hit FROM hit, unnest(generate_series(p, p + k - 1)) AS t(i) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select(
        "doc_id", F.col("n_lines").cast("long"), F.size("removed_lines").cast("long").alias("n_removed"),
        F.array_join("removed_lines", ",").alias("removed_lines"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = maintext.extract(pages.select("page_id", "url", "html"), maintext.train(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return aligned.withColumn("groups_sha256", digest).drop("groups")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece
), gram AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM worded, (VALUES (1), (2), (3)) AS orders(k), unnest(generate_series(1, len(w) - k + 1)) AS t(i)
), counted AS (
  SELECT lang, k, phrase, count(*) AS f FROM gram GROUP BY lang, k, phrase
), total AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang
), candidate AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k > 1 AND f >= 10
), cut AS (
  SELECT c.lang, c.k, c.phrase, c.a, head, x.f AS l, y.f AS r,
         CAST(1000000 * CAST(c.a AS HUGEINT) * c.a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM candidate c, unnest(generate_series(1, k - 1)) AS t(head)
  JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : head], ' ')
  JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[head + 1 :], ' ')
), lowest AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, head) = 1
), covered AS (
  SELECT DISTINCT short.lang, short.phrase FROM candidate short JOIN candidate long
  ON short.lang = long.lang AND short.k < long.k AND 100 * long.a >= 50 * short.a
  AND contains(' ' || long.phrase || ' ', ' ' || short.phrase || ' ')
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM lowest ANTI JOIN covered USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


QUERIES: dict[str, Query] = {
    "op1_histogram_sort": op1_histogram_sort,
    "op2_packing": op2_packing,
    "op3_decontamination": op3_decontamination,
    "op4_secrets": op4_secrets,
    "op5_licenses": op5_licenses,
    "op6_simhash": op6_simhash,
    "op7_class_lm": op7_class_lm,
    "op8_quality": op8_quality,
    "op9_topk": op9_topk,
    "op10_line_dedup": op10_line_dedup,
    "op11_main_text": op11_main_text,
    "op12_alignment": op12_alignment,
    "op13_collocations": op13_collocations,
    "pipeline": corpus_pipeline.run,
}
ORACLE: dict[str, str] = {"op3_decontamination": OP3_SQL, "op9_topk": OP9_SQL, "op13_collocations": OP13_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
