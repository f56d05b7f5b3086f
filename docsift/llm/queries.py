"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm import jaccard_join, main_text, media, packing, sharding, tiling, tokens, toxicity, urls, warc

SHARDS = 24
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


#: Bytes of an Arrow batch to a Python worker; rows here are texts, and several batches are in memory at once.
BATCH_BYTES = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op2_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)
    return found.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_token_files(tokens.write_token_files(table(spark, sf_dir, "documents"), TOKENIZER))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(table(spark, sf_dir, "pages"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_lossless_webp": op2_lossless_webp,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_sharding": op4_sharding,
    "op5_packing": op5_packing,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_token_files": op8_token_files,
    "op9_main_text": op9_main_text,
    "op10_url_filters": op10_url_filters,
}

#: Base32 of the 40 hex digits in h: 5 digits are 20 bits, which are 4 letters.
_BASE32 = """list_reduce(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  ((CAST('0x' || substr(h, 5 * (k // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) + 1, 1)), lambda a, b: a || b)"""

OP1_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS kept FROM pages)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to, true AS intact FROM p"""

OP3_SQL = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))) END AS shingles FROM w),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS t FROM s),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
roots AS (SELECT x, least(x, min(y)) AS root FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, coalesce(root, s.doc_id) AS component_id FROM s LEFT JOIN roots ON s.doc_id = roots.x"""

#: Rules alone: the given pages have no canonical link and no refresh (test_urls holds the components against brute force).
OP10_SQL = """WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(verdict, rule) AS (VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('allow', 'net/de/'), ('block', 'example.net/de/8'), ('block', 'org/es/')),
parts AS (SELECT verdict, rule, split_part(rule, '/', 1) AS rule_host, substr(rule, instr(rule, '/')) AS rule_path FROM rules),
fits AS (SELECT page_id, max(struct_pack(size := length(rule), rule := rule, verdict := verdict)) AS best FROM p JOIN parts ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT p.page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict, false AS by_alias FROM p LEFT JOIN fits ON p.page_id = fits.page_id"""

#: Without SQL: checksums of tokeniser ids (5, 8), stored media (2), hashes of its own (4), tiles (6), trained scores (7), markup (9).
ORACLE_SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op3_jaccard_join": OP3_SQL, "op10_url_filters": OP10_SQL}
