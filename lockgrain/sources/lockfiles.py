"""Lockfiles to packages: which parser reads a file, which manifests go with it, and the parsing itself.

A lockfile row meets its manifests by a join on folder and kind, then one Arrow pass parses the lockfile and lets its
matchers update the rows. Every file is a row of its own, so parallelism is by file and no folder is gathered. A file
that can't be parsed becomes an error row and nothing else fails.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockgrain.session import bound_batches, cut_lineage
from lockgrain.sources.formats import json_formats, line_formats, manifests, toml_yaml_formats

#: Parser by name; requirements and poms need other files and are read by requirement_packages and lockgrain.sources.poms.
PARSERS: dict[str, Callable[[str, str], list[dict]]] = {
    "Cargo.lock": toml_yaml_formats.cargo,
    "composer.lock": json_formats.composer,
    "conan.lock": json_formats.conan,
    "Gemfile.lock": line_formats.gemfile_lock,
    "go.mod": line_formats.go_mod,
    "gradle.lockfile": line_formats.gradle,
    "gradle/verification-metadata.xml": toml_yaml_formats.gradle_verification,
    "mix.lock": line_formats.mix,
    "package-lock.json": json_formats.npm,
    "packages.lock.json": json_formats.nuget,
    "pdm.lock": toml_yaml_formats.pdm,
    "Pipfile.lock": json_formats.pipenv,
    "pnpm-lock.yaml": toml_yaml_formats.pnpm,
    "poetry.lock": toml_yaml_formats.poetry,
    "pubspec.lock": toml_yaml_formats.pub,
    "renv.lock": json_formats.renv,
    "yarn.lock": line_formats.yarn,
}
REGISTERED = (*PARSERS, "pom.xml", "requirements.txt")

#: Parsers that only an explicit parse_as asks for.
LIBRARY_ONLY: dict[str, Callable[[str, str], list[dict]]] = {
    "apk-installed": line_formats.apk,
    "dpkg-status": line_formats.dpkg,
    "csv": line_formats.csv_rows,
    "results": json_formats.earlier_results,
    "node_modules/.package-lock.json": json_formats.npm,
    "buildscript-gradle.lockfile": line_formats.gradle,
    "verification-metadata.xml": toml_yaml_formats.gradle_verification,
}

#: Matchers of a parser: kinds of manifests in order.
MATCHERS: dict[str, tuple[str, ...]] = {
    "package-lock.json": ("package.json",),
    "yarn.lock": ("package.json",),
    "pnpm-lock.yaml": ("package.json",),
    "composer.lock": ("composer.json",),
    "Pipfile.lock": ("Pipfile",),
    "poetry.lock": ("pyproject.toml",),
    "gradle.lockfile": ("build.gradle",),
    "packages.lock.json": ("csproj",),
    "Gemfile.lock": ("Gemfile", "gemspec"),
}
MATCH: dict[str, Callable[[str, str, list[dict]], None]] = {
    "package.json": manifests.package_json,
    "composer.json": manifests.composer_json,
    "Pipfile": manifests.toml_lines,
    "pyproject.toml": manifests.toml_lines,
    "build.gradle": manifests.build_gradle,
    "csproj": manifests.csproj,
    "Gemfile": manifests.gemfile,
    "gemspec": manifests.gemspec,
}


def list_parsers() -> list[str]:
    return sorted({*REGISTERED, "buildscript-gradle.lockfile"}, key=str.lower)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def parser_of(path: Column) -> Column:
    """Name of the parser for a path; null if none reads it. The order is fixed, so a path never has two."""
    name = base_name(path)
    out = F.when(name.isin("gradle.lockfile", "buildscript-gradle.lockfile"), "gradle.lockfile")
    out = out.when((name == "verification-metadata.xml") & (base_name(folder_of(path)) == "gradle"), "gradle/verification-metadata.xml")
    out = out.when(F.contains(name, F.lit("requirements")) & name.endswith(".txt"), "requirements.txt")
    plain = [p for p in REGISTERED if p not in ("gradle.lockfile", "gradle/verification-metadata.xml", "requirements.txt")]
    return out.when(name.isin(*plain), name)


def enabled(files: DataFrame, parsers: list[str] | None = None) -> DataFrame:
    """(path, text, parser) of files that an enabled parser reads; no list means all."""
    found = files.withColumn("parser", parser_of(F.col("path"))).where("parser is not null")
    return found.where(F.col("parser").isin(*parsers)) if parsers else found


def _manifest_kind(path: Column) -> Column:
    name = base_name(path)
    plain = [k for k in MATCH if k not in ("csproj", "gemspec", "build.gradle")]
    return F.when(name.isin(*plain), name).when(name.endswith(".csproj"), "csproj").when(name.endswith(".gemspec"), "gemspec").when(name.isin("build.gradle", "build.gradle.kts"), "build.gradle")


def manifest_files(files: DataFrame) -> DataFrame:
    """(folder, kind, file, manifest): the one manifest of each kind that goes with a lockfile in a folder.

    Of several csproj or gemspec files the first by name; build.gradle before build.gradle.kts.
    """
    rows = files.select(folder_of(F.col("path")).alias("folder"), _manifest_kind(F.col("path")).alias("kind"), F.col("path").alias("file"), F.col("text").alias("manifest")).where("kind is not null")
    best = F.min_by(F.struct("file", "manifest"), "file")
    return rows.groupBy("folder", "kind").agg(best.alias("m")).select("folder", "kind", "m.*")


_POSITION = pa.struct([("file_name", pa.string()), *((n, pa.int32()) for n in ("line_start", "line_end", "column_start", "column_end"))])
_ARROW = pa.schema(
    [(n, pa.string()) for n in ("source_path", "parser", "name", "version")]
    + [("target_versions", pa.list_(pa.string())), ("commit", pa.string()), ("ecosystem", pa.string()), ("package_manager", pa.string()), ("dep_groups", pa.list_(pa.string())), ("is_direct", pa.bool_())]
    + [(n, _POSITION) for n in ("block", "name_loc", "version_loc")]
    + [("children", pa.list_(pa.string())), ("error", pa.string()), ("includes", pa.list_(pa.string()))]
)
_P = "struct<file_name:string,line_start:int,line_end:int,column_start:int,column_end:int>"
PARSED = (
    "source_path string, parser string, name string, version string, target_versions array<string>, `commit` string, ecosystem string, package_manager string, "
    f"dep_groups array<string>, is_direct boolean, block {_P}, name_loc {_P}, version_loc {_P}, children array<string>, error string, includes array<string>"
)


def parse_text(parser: str, path: str, text: str, manifest: list[tuple[str, str, str]] = ()) -> tuple[list[dict], list[str]]:
    """Python: (package rows sorted by name and version, messages of matchers that failed). ``manifest``: (kind, path, text)."""
    rows = (PARSERS.get(parser) or LIBRARY_ONLY[parser])(path, text)
    failed = []
    for kind, file, body in manifest:
        try:
            MATCH[kind](file, body, rows)
        except Exception as e:  # a manifest must not cost the lockfile's packages
            failed.append(f"{file}: {e}")
    return sorted(rows, key=lambda r: (r["name"], r["version"])), failed


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            try:
                if r["parser"] == "requirements.txt":
                    rows, includes = line_formats.requirements(r["path"], r["text"] or "")
                    out.append({"source_path": r["path"], "parser": r["parser"], "includes": includes})
                    failed = []
                else:
                    given = [(m["kind"], m["file"], m["manifest"]) for m in r["manifests"] or []]
                    order = MATCHERS.get(r["parser"], ())
                    rows, failed = parse_text(r["parser"], r["path"], r["text"] or "", sorted(given, key=lambda m: order.index(m[0])))
                out += [{**row, "source_path": r["path"], "parser": r["parser"]} for row in rows]
                out += [{"source_path": r["path"], "parser": r["parser"], "error": m} for m in failed]
            except Exception as e:  # one bad file is an error row
                out.append({"source_path": r["path"], "parser": r["parser"], "error": f"{type(e).__name__}: {e}"})
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def parse_lockfiles(files: DataFrame, parsers: list[str] | None = None) -> DataFrame:
    """Parsed rows of all files but poms: packages, error rows (error set) and include rows (includes set)."""
    bound_batches(files.sparkSession)
    locks = enabled(files, parsers).where("parser <> 'pom.xml'").withColumn("folder", folder_of(F.col("path")))
    wants = F.create_map(*(x for k, v in MATCHERS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    asked = locks.select("path", "folder", "parser", F.explode(wants[F.col("parser")]).alias("kind"))
    here = manifest_files(files)
    above = here.where("kind = 'build.gradle'").select(F.col("folder").alias("up"), "kind", F.col("file").alias("up_file"), F.col("manifest").alias("up_manifest"))
    met = asked.withColumn("up", folder_of(F.col("folder"))).join(here, ["folder", "kind"], "left").join(above, ["up", "kind"], "left")
    met = met.select("path", "kind", F.coalesce("file", "up_file").alias("file"), F.coalesce("manifest", "up_manifest").alias("manifest")).where("file is not null")
    given = met.groupBy("path").agg(F.collect_list(F.struct("kind", "file", "manifest")).alias("manifests"))  # two at most
    return locks.join(given, "path", "left").select("path", "text", "parser", "manifests").mapInArrow(_parse, PARSED)


def with_included(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Adds the rows of requirement files that are only read because another includes them, under the parser 'included'."""
    parsed = latest = cut_lineage(parsed)
    while True:
        asked = latest.where("size(includes) > 0").select(F.explode("includes").alias("path")).distinct()
        missing = asked.join(parsed.select(F.col("source_path").alias("path")).distinct(), "path", "left_anti")
        more = files.join(missing, "path", "left_semi").select("path", "text", F.lit("requirements.txt").alias("parser"), F.lit(None).cast("array<struct<kind:string,file:string,manifest:string>>").alias("manifests"))
        latest = cut_lineage(more.mapInArrow(_parse, PARSED).withColumn("parser", F.lit("included")))
        if latest.isEmpty():
            return parsed
        parsed = parsed.unionByName(latest)


def parse_as(files: DataFrame, parser: str) -> DataFrame:
    """Packages of all given files by one named parser, whatever their names; errors are raised, as for a single file."""
    if parser not in PARSERS and parser not in LIBRARY_ONLY and parser != "requirements.txt":
        raise ValueError(f"no parser named {parser}; there are {', '.join(list_parsers())}")
    bound_batches(files.sparkSession)
    out = files.select("path", "text", F.lit(parser).alias("parser"), F.lit(None).cast("array<struct<kind:string,file:string,manifest:string>>").alias("manifests")).mapInArrow(_parse, PARSED)
    checked = out.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "source_path", "error"))))
    return checked.where("includes is null and error is null").drop("includes", "error", "children")


def packages_of(parsed: DataFrame) -> DataFrame:
    """Package rows, with those of included requirement files under the file that includes them.

    An included package takes the place of the including file's own package of the same name and version.
    """
    every = parsed.where("error is null and includes is null").drop("error", "includes")
    own = every.where("parser <> 'included'")
    links = parsed.where("size(includes) > 0").select("source_path", F.explode("includes").alias("file"))
    reach = cut_lineage(links.distinct())
    if reach.isEmpty():
        return own
    while True:
        step = reach.join(links.select(F.col("source_path").alias("file"), F.col("file").alias("next")), "file").select("source_path", F.col("next").alias("file"))
        fresh = cut_lineage(step.distinct().join(reach, ["source_path", "file"], "left_anti"))
        if fresh.isEmpty():
            break
        reach = cut_lineage(reach.union(fresh))
    inner = reach.where("source_path <> file").withColumnRenamed("source_path", "root").join(every.withColumnRenamed("source_path", "file"), "file").withColumnRenamed("root", "source_path")
    inner = inner.join(own.select("source_path").union(parsed.where("includes is not null and parser <> 'included'").select("source_path")).distinct(), "source_path", "left_semi").withColumn("parser", F.lit("requirements.txt"))
    both = own.withColumn("__from", F.col("source_path")).withColumn("__inner", F.lit(0)).unionByName(inner.withColumn("__inner", F.lit(1)).withColumnRenamed("file", "__from"))
    needs = both.join(reach.select("source_path").distinct(), "source_path", "left_semi")
    rest = both.join(reach.select("source_path").distinct(), "source_path", "left_anti").drop("__from", "__inner")
    key = ["source_path", "name", "version"]
    cols = [c for c in rest.columns if c not in key]
    best = needs.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct("__inner", "__from")).alias("r")).select(*key, "r.*")
    return rest.unionByName(best)


def edges_of(parsed: DataFrame) -> DataFrame:
    """EDGE rows of the links that lockfiles state between their own packages."""
    rows = parsed.where("size(children) > 0").select("source_path", F.concat_ws("@", "name", "version").alias("parent_key"), F.explode("children").alias("child_key"))
    return rows.distinct()


def errors_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is not null").select(F.col("source_path").alias("path"), "parser", F.col("error").alias("message"))



def apk_packages(files: DataFrame, release_path: str = "/etc/alpine-release") -> DataFrame:
    """Packages of installed databases of Alpine; the release of the same image qualifies the ecosystem.

    ``files`` has image, path and text: every file of an image that is a database or its release.
    """
    from lockgrain.sources.formats.line_formats import apk

    release = files.where(F.col("path") == release_path).groupBy("image").agg(F.min("text").alias("release"))
    bases = files.where(F.col("path").endswith("/lib/apk/db/installed")).join(release, "image", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{**row, "source_path": r["path"], "parser": "apk-installed"} for r in batch.to_pylist() for row in apk(r["path"], r["text"] or "", r["release"])]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return bases.select("path", "text", "release").mapInArrow(run, PARSED).drop("children", "error", "includes")


def go_binary_packages(files: DataFrame) -> DataFrame:
    """Modules of Go programs among (path, content) rows; files that are none give no rows."""
    from lockgrain.sources.formats.go_binary import go_binary, may_be_program

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    found = go_binary(path, raw or b"") if may_be_program(path) else []
                except (ValueError, IndexError):
                    found = []
                rows += [{**row, "source_path": path, "parser": "go-binary"} for row in found]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return files.select("path", "content").mapInArrow(run, PARSED).drop("children", "error", "includes")
