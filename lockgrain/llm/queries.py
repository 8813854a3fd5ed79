"""Queries of the training-data problems, each over its whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockgrain.llm.canonical import canonical_records, collapse, duplicates, json_fields
from lockgrain.llm.mixing import pareto_mix
from lockgrain.llm.tokens import encode_corpus
from lockgrain.llm.topk import frequent_items, top_k
from lockgrain.llm.truncation import evidence, truncated, truncation_rates
from lockgrain.session import table

RECORD = ("name", "version", "ecosystem")


def _reports(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "package_reports").where("payload is not null").select("report_id", json_fields(F.col("payload"), RECORD).alias("r")).where("r is not null")
    return canonical_records(rows, "report_id", [F.col(f"r.{f}") for f in RECORD])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return duplicates(_reports(spark, d)).select("first_id", F.col("id").alias("report_id"))


def p1_copies(spark: SparkSession, d: str) -> DataFrame:
    return collapse(_reports(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return frequent_items(table(spark, d, "package_rows"), ["name", "purl"], 500).select("field", "item")


def p5_top_names(spark: SparkSession, d: str) -> DataFrame:
    return top_k(table(spark, d, "package_rows"), "name", 20)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = encode_corpus(table(spark, d, "documents"), keep=("doc_id", "source"), out="n_tokens", counts_only=True)
    return pareto_mix(sizes, table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p8_weighted(spark: SparkSession, d: str) -> DataFrame:
    """The mix with unequal chances: a document's chance grows with the root of its length, so short ones come more often
    than by their tokens."""
    sizes = encode_corpus(table(spark, d, "documents"), keep=("doc_id", "source"), out="n_tokens", counts_only=True)
    return pareto_mix(sizes.withColumn("weight", F.sqrt("n_tokens")), table(spark, d, "mix_targets"))[0]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated(table(spark, d, "documents"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation_rates(table(spark, d, "documents"))


def p9_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What shows the cuts, and in how many texts."""
    return evidence(table(spark, d, "documents")).groupBy("why").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (p1_found, p1_copies, p5_found, p5_top_names, p7_ids, p8_mix, p8_shares, p8_weighted, p9_found, p9_rates, p9_evidence)}

_CANON = "trim(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_REPORTS = """
fields AS (SELECT report_id, max(CASE WHEN lower(e.key) = 'name' THEN e.value ->> '$' END) AS name,
    max(CASE WHEN lower(e.key) = 'version' THEN e.value ->> '$' END) AS version,
    max(CASE WHEN lower(e.key) = 'ecosystem' THEN e.value ->> '$' END) AS ecosystem
  FROM package_reports, json_each(CAST(payload AS JSON)) e WHERE payload IS NOT NULL GROUP BY report_id),
canon AS (SELECT report_id, {} AS name, {} AS version, {} AS ecosystem FROM fields),
firsts AS (SELECT report_id, min(report_id) OVER (PARTITION BY name, version, ecosystem) AS first_id FROM canon)
""".format(*(_CANON.format(f) for f in RECORD))

SQL = {
    "p1_found": f"WITH {_REPORTS} SELECT first_id, report_id FROM firsts WHERE report_id <> first_id",
    "p1_copies": f"WITH {_REPORTS} SELECT first_id, count(*) AS copies FROM firsts GROUP BY first_id",
    "p5_found": """WITH items AS (SELECT 'name' AS field, name AS item FROM package_rows UNION ALL SELECT 'purl', purl FROM package_rows)
SELECT field, item FROM items WHERE item IS NOT NULL AND item <> '' GROUP BY field, item HAVING count(*) * 500 >= (SELECT count(*) FROM package_rows)""",
    "p5_top_names": "SELECT name AS item, count(*) AS n FROM package_rows WHERE name <> '' GROUP BY name ORDER BY n DESC, name LIMIT 20",
}
