"""CycloneDX 1.5 documents from inventory relations.

Components, dependencies and vulnerabilities are built and sorted as DataFrames; only the last step gathers them, since
the result is one document. For inventories that are no single document keep the relations.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockgrain.functions.purl import purl
from lockgrain.functions.positions import clean_locations
from lockgrain.operators.inventory import id_rank

SCHEMA = "http://cyclonedx.org/schema/bom-1.5.schema.json"
#: Prefix of property names, and scoring methods by severity type.
PROPERTY_PREFIX = "osv-scanner:"
METHODS = {"CVSS_V2": "CVSSv2", "CVSS_V3": "CVSSv3", "CVSS_V4": "CVSSv4"}
REACHABLE = "reachable-symbol-location"


def properties(metadata: Column, prefix: str = PROPERTY_PREFIX, reachable_prefix: str = "lockgrain:") -> Column:
    """Sorted array of (name, value) of a metadata map; empty values are left out."""
    kept = F.filter(F.map_entries(metadata), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    named = F.transform(kept, lambda e: F.struct(F.concat(F.when(F.startswith(e["key"], F.lit(REACHABLE)), reachable_prefix).otherwise(prefix), e["key"]).alias("name"), e["value"].alias("value")))
    return F.array_sort(named)


def occurrences(locations: Column) -> Column:
    """JSON texts of valid locations; whether a location is valid is told from its cleaned copy, the text is of the whole."""
    valid = F.filter(locations, lambda x: clean_locations(x["block"], x["name_loc"], x["version_loc"]).isNotNull())
    one = lambda p: F.when(p.isNotNull(), F.struct(p["file_name"].alias("file_name"), p["line_start"].alias("line_start"), p["line_end"].alias("line_end"), p["column_start"].alias("column_start"), p["column_end"].alias("column_end")))
    return F.transform(valid, lambda x: F.to_json(F.struct(one(x["block"]).alias("block"), one(x["name_loc"]).alias("name"), one(x["version_loc"]).alias("version"))))


def library_components(merged: DataFrame, **prefixes: str) -> DataFrame:
    """(bom_ref, type, name, version, purl, properties, occurrences) of packages merged by purl, with metadata and locations."""
    return merged.select(
        F.col("purl").alias("bom_ref"), F.lit("library").alias("type"), "name", "version", "purl", properties(F.col("metadata"), **prefixes).alias("properties"), occurrences(F.col("locations")).alias("occurrences")
    )


def file_components(artifacts: DataFrame, prefix: str = PROPERTY_PREFIX) -> DataFrame:
    """One file component per artifact that has a package URL."""
    made = artifacts.withColumn("purl", purl(F.col("ecosystem"), F.col("name"), F.col("version"))).where("purl is not null and filename is not null")
    one = made.groupBy(F.col("filename").alias("bom_ref")).agg(F.min("purl").alias("of"))
    return one.select(
        "bom_ref", F.lit("file").alias("type"), F.col("bom_ref").alias("name"), F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("purl"),
        F.array(F.struct(F.lit(prefix + "package").alias("name"), F.col("of").alias("value"))).alias("properties"), F.array().cast("array<string>").alias("occurrences"),
    )


def dependency_edges(packages: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(ref, depends_on): artifacts on their parents, and files on artifacts of this source tree that they name.

    ``packages`` has name, version, file (of each location). Edges may repeat. Of artifacts with one name and version
    the first by file counts.
    """
    own = artifacts.withColumn("purl", purl(F.col("ecosystem"), F.col("name"), F.col("version"))).where("purl is not null and depends_on is not null").select(F.col("filename").alias("ref"), F.col("depends_on.filename").alias("depends_on"))
    first = artifacts.groupBy("name", "version").agg(F.min("filename").alias("depends_on"))
    inner = packages.where("file is not null").join(first, ["name", "version"]).select(F.col("file").alias("ref"), "depends_on")
    return own.unionByName(inner)


def vulnerability_rows(vulns: DataFrame) -> DataFrame:
    """One row per vulnerability id, the first by source and purl, from PackageVulns records: what the document tells of it."""
    rows = vulns.select("source_path", F.col("package.purl").alias("at"), F.explode("vulnerabilities").alias("v")).where("v.id is not null")
    first = rows.groupBy(F.col("v.id").alias("id")).agg(F.min_by("v", F.struct("source_path", "at")).alias("v"))
    stamp = lambda c: F.when(F.col(f"v.{c}").isNotNull(), F.date_format(f"v.{c}", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    method = F.create_map(*(F.lit(x) for kv in METHODS.items() for x in kv))
    names = {f.name for f in first.schema["v"].dataType.fields}
    empty = lambda kind: F.array().cast(kind)
    urls = F.transform(F.filter("v.references", lambda r: r["type"] == "ADVISORY"), lambda r: r["url"]) if "references" in names else F.lit(None)
    credits = F.transform("v.credits", lambda c: F.struct(c["name"].alias("name"), c["contact"].alias("url"))) if "credits" in names else F.lit(None)
    return first.select(
        "id", stamp("modified").alias("updated"), stamp("published").alias("published"), stamp("withdrawn").alias("rejected"), F.col("v.summary").alias("description"), (F.col("v.details") if "details" in names else F.lit(None).cast("string")).alias("detail"),
        F.coalesce("v.aliases", empty("array<string>")).alias("references"),
        F.coalesce(F.transform(F.filter("v.affected", lambda a: a["package"].isNotNull()), lambda a: a["package"]["purl"]), empty("array<string>")).alias("affects"),
        F.coalesce(F.transform(F.filter("v.severity", lambda s: s.isNotNull()), lambda s: F.struct(method[s["type"]].alias("method"), s["score"].alias("vector"))), empty("array<struct<method:string,vector:string>>")).alias("ratings"),
        F.coalesce(urls.cast("array<string>"), empty("array<string>")).alias("advisories"),
        F.coalesce(credits.cast("array<struct<name:string,url:array<string>>>"), empty("array<struct<name:string,url:array<string>>>")).alias("credits"),
    )


def vulnerability_json(vulnerabilities: Column) -> Column:
    """JSON text of an array of vulnerabilities: '[]' for none, fields without a value and affected packages without any left out."""
    full = F.filter(vulnerabilities, lambda v: v.isNotNull())
    some = lambda p: (F.coalesce(p["purl"], F.lit("")) != "") | (F.coalesce(p["name"], F.lit("")) != "") | (F.coalesce(p["ecosystem"], F.lit("")) != "")
    bare = F.transform(full, lambda v: v.withField("affected", F.transform(F.filter(v["affected"], lambda a: a.isNotNull()), lambda a: a.withField("package", F.when(some(a["package"]), a["package"])))))
    text = F.to_json(bare, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"})
    return F.coalesce(text, F.lit("[]"))


def ordered_ids(ids: DataFrame, column: str = "id") -> DataFrame:
    return ids.orderBy(id_rank(F.col(column)), column)


def document(components: DataFrame, edges: DataFrame, vulnerabilities: DataFrame) -> dict:
    """The document. ``vulnerabilities`` has id and affects (array of purls, may be empty), and may have the other columns
    of vulnerability_rows."""
    comps = []
    for r in components.orderBy("bom_ref").toLocalIterator():
        c = {"bom-ref": r["bom_ref"], "type": r["type"], "name": r["name"], "version": r["version"], "purl": r["purl"]}
        c = {k: v for k, v in c.items() if v}
        c["properties"] = [{"name": p["name"], "value": p["value"]} for p in r["properties"] or []]
        if r["occurrences"]:
            c["evidence"] = {"occurrences": [{"location": o} for o in r["occurrences"]]}
        comps.append(c)
    deps = [{"ref": r["ref"], "dependsOn": r["on"]} for r in edges.groupBy("ref").agg(F.array_sort(F.collect_list("depends_on")).alias("on")).orderBy("ref").toLocalIterator()]
    vulns = []
    for r in vulnerabilities.orderBy("id").toLocalIterator():
        v = {"bom-ref": r["id"], "id": r["id"]}
        told = r.asDict(recursive=True)
        v |= {k: told[k] for k in ("description", "detail", "published", "updated", "rejected") if told.get(k)}
        lists = {
            "references": [{"id": x} for x in told.get("references") or []],
            "ratings": [{k: x[k] for k in ("method", "vector") if x[k]} for x in told.get("ratings") or []],
            "advisories": [{"url": x} for x in told.get("advisories") or []],
            "affects": [{"ref": x} for x in told["affects"] or []],
        }
        v |= {k: x for k, x in lists.items() if x}
        if told.get("credits"):
            v["credits"] = {"organizations": told["credits"]}
        vulns.append(v)
    return {"$schema": SCHEMA, "bomFormat": "CycloneDX", "specVersion": "1.5", "version": 1, "components": comps, "dependencies": deps, "vulnerabilities": vulns}


def to_text(value: dict) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False) + "\n"
