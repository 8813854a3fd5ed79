"""Reachability: advisories of direct packages, symbols, call sites, and the pivot back to packages.

Advisories come as a table (no executor opens a connection); call sites are extracted once per source file and joined by
equality, so no file is searched once per advisory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockgrain.schema import CALL_SITE
from lockgrain.session import bound_batches

_HIDDEN = re.compile(r'//[^\n]*|/\*.*?\*/|"""(?:\\.|.)*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)
_NEW = re.compile(r"\bnew\s+((?:[\w$]+\s*\.\s*)*[\w$]+)\s*(?:<[^;(){}]*>)?\s*\(")


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m.group())


def call_sites_of(text: str) -> list[tuple[str, int, int, int, int]]:
    """(type, line_start, line_end, column_start, column_end) of each object creation; comments and literals don't count."""
    plain = _HIDDEN.sub(_blank, text)
    starts = [0, *(m.end() for m in re.finditer("\n", plain))]
    found = []
    for m in _NEW.finditer(plain):
        begin, close, depth = m.start(), m.end(), 1
        while close < len(plain) and depth:
            depth += {"(": 1, ")": -1}.get(plain[close], 0)
            close += 1
        at = [_line(starts, p) for p in (begin, close)]
        found.append((re.sub(r"\s+", "", m.group(1)), at[0][0], at[1][0], at[0][1], at[1][1]))
    return found


def _line(starts: list[int], at: int) -> tuple[int, int]:
    import bisect

    i = bisect.bisect_right(starts, at) - 1
    return i + 1, at - starts[i] + 1


def _sites(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(p, *s) for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()) for s in call_sites_of(t or "")]
        cols = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.string(), pa.string(), *[pa.int32()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["path", "symbol_text", "line_start", "line_end", "column_start", "column_end"])


def java_call_sites(files: DataFrame) -> DataFrame:
    """CALL_SITE rows of .java files, from (path, text)."""
    bound_batches(files.sparkSession)
    return files.where(F.col("path").endswith(".java") & F.col("text").isNotNull()).select("path", "text").mapInArrow(_sites, CALL_SITE)


def checked_advisories(direct: DataFrame, advisories: DataFrame) -> DataFrame:
    """Advisory rows of direct package URLs."""
    return advisories.join(direct.select("purl").distinct(), "purl", "left_semi")


def detect(advisories: DataFrame, sites: DataFrame) -> DataFrame:
    """(purl, advisory_id, path, positions): call sites whose text is a class symbol's name or value.name."""
    classes = advisories.where("symbol_type = 'class'")
    names = classes.select("purl", "advisory_id", F.explode(F.array_distinct(F.array("symbol_name", F.concat_ws(".", "symbol_value", "symbol_name")))).alias("symbol_text"))
    return names.join(sites, "symbol_text").select("purl", "advisory_id", "symbol_text", "path", "line_start", "line_end", "column_start", "column_end").distinct()


def pivot(advisories: DataFrame, detections: DataFrame) -> DataFrame:
    """(purl, advisories, reachable): all advisories checked of a purl, and those with a detection."""
    hit = detections.select("purl", "advisory_id").distinct().withColumn("hit", F.lit(True))
    both = advisories.select("purl", "advisory_id").distinct().join(hit, ["purl", "advisory_id"], "left")
    return both.groupBy("purl").agg(F.array_sort(F.collect_set("advisory_id")).alias("advisories"), F.array_sort(F.collect_set(F.when(F.col("hit"), F.col("advisory_id")))).alias("reachable"))


def reachable_symbols(detections: DataFrame) -> DataFrame:
    """(purl, locations): map of advisory id to the JSON list of its call sites."""
    one = F.struct(F.col("path").alias("filename"), "line_start", "line_end", "column_start", "column_end", F.col("symbol_text").alias("symbol"))
    each = detections.groupBy("purl", "advisory_id").agg(F.to_json(F.array_sort(F.collect_set(one))).alias("json"))
    return each.groupBy("purl").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("advisory_id", "json")))).alias("locations"))


def affected_purls(pivoted: DataFrame) -> DataFrame:
    """(advisory_id, affects): every advisory checked, with the purls it reaches; none gives an empty list."""
    rows = pivoted.select("purl", F.explode("advisories").alias("advisory_id"), "reachable")
    return rows.groupBy("advisory_id").agg(F.array_sort(F.collect_set(F.when(F.array_contains("reachable", F.col("advisory_id")), F.col("purl")))).alias("affects"))
