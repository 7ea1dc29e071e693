"""The queries of these operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.ann import nearest
from plumbline.llm.dialogue import damage_and_repair
from plumbline.llm.jaccard import near_duplicates
from plumbline.llm.lloyd import report
from plumbline.llm.lmscore import score_documents
from plumbline.llm.mixing import replicate
from plumbline.llm.packing import pack_along_curve
from plumbline.llm.pii import find_pii
from plumbline.llm.quality import judge
from plumbline.llm.ring import place
from plumbline.llm.secretscan import scan_secrets
from plumbline.llm.separators import read_blocks, scan_separators, write_flat_files
from plumbline.llm.shared import new_path, table
from plumbline.llm.urlfilter import RULES, filter_urls
from plumbline.llm.wordtok import default_path


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_along_curve(table(spark, sf_dir, "documents"), default_path())


def op2_forest_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op4_quality_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, from flat files of their ids; 49407 ends a document. A file is named by its number."""
    path = new_path(spark)
    write_flat_files(table(spark, sf_dir, "documents"), path, default_path(), 49407)
    blocks = read_blocks(spark, path).withColumn("file", F.concat(F.lit("tokens-"), F.regexp_extract("file", r"part-(\d+)-", 1)))
    return scan_separators(blocks, 49407)


def op6_pii_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op8_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op7_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source to the same share of as many rows as there are."""
    return replicate(table(spark, sf_dir, "documents"))


def op11_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "embeddings"))


def op12_minplus_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage_and_repair(table(spark, sf_dir, "conversations"))


def op13_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes: a shard's load decides too, so the law is not `key`."""
    dealt = place(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


OP7_SQL = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM counts)::DOUBLE * (SELECT sum(n) FROM counts)::DOUBLE / n::DOUBLE AS rate FROM counts),
cdf(source, k, p, total) AS (
  SELECT source, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT c.source, c.k + 1, c.p * r.rate / (c.k + 1), c.total + c.p * r.rate / (c.k + 1) FROM cdf c JOIN rates r ON c.source IS NOT DISTINCT FROM r.source
  WHERE c.k < CAST(trunc(r.rate + 12 * sqrt(r.rate) + 24) AS INT)),
tables AS (SELECT source, list(total ORDER BY k) AS cdf FROM cdf GROUP BY source),
drawn AS (SELECT d.*, t.cdf, (('0x' || substr(md5('7:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
counted AS (SELECT *, len(list_filter(cdf, lambda c: c < u)) AS times FROM drawn)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, times + 1)) AS copy FROM counted WHERE times > 0
"""

#: A round of Lloyd's algorithm: books{k} from books{k - 1}. DuckDB's // rounds toward zero, so remainders are taken off first.
OP11_ROUND = """
near{k} AS MATERIALIZED (SELECT row_key, part, comp, entry FROM (
  SELECT p.row_key, p.part, p.comp, b.entry, row_number() OVER (PARTITION BY p.row_key, p.part ORDER BY list_sum(list_transform(range(1, len(p.comp) + 1), lambda j: (p.comp[j] - b.comp[j]) * (p.comp[j] - b.comp[j])))::HUGEINT, b.entry) AS place
  FROM parts p JOIN books{before} b USING (part)) WHERE place = 1),
means{k} AS (SELECT part, entry, list(v ORDER BY j) AS comp FROM (
  SELECT part, entry, j, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS v
  FROM (SELECT part, entry, unnest(comp) AS v, generate_subscripts(comp, 1) AS j FROM near{k}) GROUP BY part, entry, j) GROUP BY part, entry),
books{k} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.comp, b.comp)::BIGINT[] AS comp FROM books{before} b LEFT JOIN means{k} m ON m.part = b.part AND m.entry = b.entry),
"""
OP11_SQL = (
    """
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS row_key, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row_key, vec_id, label, part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] AS comp FROM kept, range(8) t(part)),
books0 AS (SELECT part, row_key - 1 AS entry, comp FROM parts WHERE row_key <= 16),
"""
    + "".join(OP11_ROUND.format(k=k, before=k - 1) for k in range(1, 7))
    + """
last AS (SELECT row_key, part, entry, away FROM (
  SELECT row_key, part, entry, away, row_number() OVER (PARTITION BY row_key, part ORDER BY away, entry) AS place FROM (
    SELECT p.row_key, p.part, b.entry, list_sum(list_transform(range(1, len(p.comp) + 1), lambda j: (p.comp[j] - b.comp[j]) * (p.comp[j] - b.comp[j])))::BIGINT AS away FROM parts p JOIN books6 b USING (part))) WHERE place = 1),
coded AS (SELECT row_key, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(away)::BIGINT AS error FROM last GROUP BY row_key),
digest AS (SELECT sha256(string_agg(array_to_string(comp, ','), ',' ORDER BY part, entry)) AS d FROM books6)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT d FROM digest) AS codebooks_sha256 FROM coded JOIN kept USING (row_key)
"""
)

QUERIES = {
    "op1_curve_packing": op1_curve_packing,
    "op2_forest_jaccard": op2_forest_jaccard,
    "op3_context_mixing": op3_context_mixing,
    "op4_quality_risk": op4_quality_risk,
    "op5_separator_scan": op5_separator_scan,
    "op6_pii_candidates": op6_pii_candidates,
    "op7_poisson_mixing": op7_poisson_mixing,
    "op8_multiprobe_neighbours": op8_multiprobe_neighbours,
    "op9_url_cascade": op9_url_cascade,
    "op10_secret_ledger": op10_secret_ledger,
    "op11_filtering_lloyd": op11_filtering_lloyd,
    "op12_minplus_repair": op12_minplus_repair,
    "op13_bounded_ring": op13_bounded_ring,
}
ORACLE_SQL = {
    "op7_poisson_mixing": OP7_SQL,
    "op11_filtering_lloyd": OP11_SQL,
}
