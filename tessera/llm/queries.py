"""Queries over the corpus tables, one for each operator, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import packing, toxicity
from tessera.llm.bpe import encoded
from tessera.llm.chat import conversation_digests
from tessera.llm.fingerprints import fingerprints_against_next
from tessera.llm.licence import scan_licences, scan_sql
from tessera.llm.near_dup import near_duplicates
from tessera.llm.quality import quality
from tessera.llm.secret_scan import scan_secrets
from tessera.llm.url_filter import filter_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked documents at 85 % shared five-word shingles, whole ``documents`` table."""
    found = near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


ORACLE_SQL["op10_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of the learned decision list for every document."""
    found = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash fingerprints of every text, its edited text and the next one, their likeness, and the verified
    Jaccard similarity of those that meet in a band."""
    return fingerprints_against_next(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every text and the text decoded from them, as digests."""
    import public_tokenizers

    found = encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
    return found.withColumnRenamed("id", "doc_id")


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern and novelty spans of every text."""
    return scan_secrets(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every text; learned from labelled rows whose crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("id").cast("string")) % 5
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold != 0)
    found = toxicity.scored(docs.select(F.col("doc_id").alias("id"), "text"), model).select("id", F.col("toxicity").alias("score"))
    held = F.coalesce(fold == 0, F.lit(False))
    return found.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, and of one made of control strings, read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return conversation_digests(rows.unionByName(extra))


ORACLE_SQL["op7_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(text, '(\\|\[SYS\]|\[INST\]|\[OUT\]|\[/SYS\]|\[/INST\]|\[/OUT\]|\[ROLE\]|\[/ROLE\]|<s>|</s>|<image>|<audio>|<document>)', '*\1', 'g') AS marked FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(length(marked) + 4 + CASE role WHEN 'user' THEN 6 WHEN 'system' THEN 5 WHEN 'assistant' THEN 5 ELSE 13 + length(role) END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all documents' words in optimal length buckets and token-budget batches; the digest is of a row's
    tokens under its mask."""
    out = packing.pack(table(spark, sf_dir, "documents"), packing.words_of(F.col("text")), pad="")
    own = F.transform(F.filter(F.arrays_zip("tokens", "mask"), lambda x: x["mask"]), lambda x: x["tokens"])
    digests = [(F.size("tokens") - F.size(own)).cast("long").alias("padding"), F.sha2(F.array_join(own, " "), 256).alias("tokens_sha256")]
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "n_tokens", "bucket", F.col("bucket_length").cast("long"), "batch", "slot", *digests)


ORACLE_SQL["op1_packing"] = packing.pack_sql()

#: Host, path and verdict (fixed values of the query).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, URL_RULES))} AS rules(host, path, verdict)")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


ORACLE_SQL["op2_url_filter"] = rf"""
WITH r(rhost, rpath, rverdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""


@query
def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families that paragraphs of each document declare."""
    found = scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sure = F.filter("licences", lambda x: x["confirmed"])
    families = F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",")
    return found.select("doc_id", families.alias("families"), F.size(sure).cast("long").alias("n_confirmed"), F.size("licences").cast("long").alias("n_candidates"))


ORACLE_SQL["op3_licence_scan"] = scan_sql()
