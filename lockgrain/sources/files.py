"""Files of source trees as a DataFrame of (path, text)."""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lockgrain.session import bound_batches
from lockgrain.sources import gitignore

#: Names of files that some parser or matcher reads, as path globs.
WANTED = (
    "Cargo.lock", "composer.lock", "composer.json", "conan.lock", "Gemfile.lock", "Gemfile", "*.gemspec", "go.mod", "*gradle.lockfile", "build.gradle", "build.gradle.kts",
    "verification-metadata.xml", "mix.lock", "package-lock.json", "package.json", "packages.lock.json", "*.csproj", "pdm.lock", "Pipfile.lock", "Pipfile", "pnpm-lock.yaml",
    "poetry.lock", "pyproject.toml", "pom.xml", "pubspec.lock", "renv.lock", "*requirements*.txt", "*.txt", "yarn.lock", "*.java",
)


def decode_bytes(raw: bytes) -> str:
    """UTF-16 with a byte order mark, UTF-8 with or without one; broken bytes become replacement characters."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    return raw.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")


@F.arrow_udf(T.StringType())
def _decoded(content: pa.Array) -> pa.Array:
    return pa.array([None if x is None else decode_bytes(x) for x in content.to_pylist()], pa.string())


def decoded(content: Column) -> Column:
    return _decoded(content)


def plain_path(path: Column) -> Column:
    """Without the file: scheme."""
    return F.regexp_replace(path, r"^file:/+", "/")


def relative_to(path: Column, root: str) -> Column:
    """Without the root in front (the folder of the root, if it is a file), without a leading slash."""
    root = root.rstrip("/")
    return F.regexp_replace(F.when(F.startswith(path, F.lit(root + "/")), F.substr(path, F.lit(len(root) + 1))).otherwise(path), "^/+", "")


def read_tree(spark: SparkSession, root: str, recursive: bool = True, ignore: bool = True) -> DataFrame:
    """(path, text) of the wanted files below a local or shared folder, or of one file.

    Folders named .git are skipped. With ``ignore``, the rules of a local repository apply, whose folders are pruned while
    listing, or those of the ignore files in a shared folder. Contents are read and decoded by the executors.
    """
    bound_batches(spark)
    read = spark.read.format("binaryFile")
    if os.path.isfile(root):
        found = read.load(root)
    elif os.path.isdir(root):
        paths = local_files(root, recursive, ignore)
        if not paths:
            return spark.createDataFrame([], "path string, text string")
        found = read.load(paths)
    else:
        found = read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "{" + ",".join(WANTED) + "}").load(root)
        found = found.where(~F.col("path").rlike(r"(^|/)\.git/"))
        if ignore:
            found = _without_ignored(found, root, recursive)
    return found.select(plain_path(F.col("path")).alias("path"), decoded(F.col("content")).alias("text"))


RULE_BYTES = 16 << 20  # bytes of all ignore files of a shared folder, which travel with the tasks


def _without_ignored(found: DataFrame, root: str, recursive: bool) -> DataFrame:
    """Files of a shared folder that its ignore files leave; the folder counts as the repository's root.

    Spark passes over files whose name begins with a dot, so the file system is asked, level by level.
    """
    spark = found.sparkSession
    jvm = spark.sparkContext._jvm
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:/+"
    top = re.sub(scheme, "/", root).rstrip("/")
    inner = found.withColumn("__rel", relative_to(F.regexp_replace("path", scheme, "/"), top))
    deepest = inner.agg(F.max(F.size(F.split("__rel", "/")))).first()[0] or 0
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rules: list[gitignore.Rule] = []
    size = 0
    for level in range(deepest if recursive else min(deepest, 1)):
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root + "/*" * level + "/.gitignore")) or ():
            size += status.getLen()
            if size > RULE_BYTES:
                raise ValueError(f"the ignore files of {root} hold more than {RULE_BYTES} bytes")
            stream = fs.open(status.getPath())
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            folder = os.path.dirname(re.sub(scheme, "/", status.getPath().toString()))
            rules += gitignore.read_rules(text.splitlines(), folder[len(top) :].strip("/"))
    return drop_ignored(inner, rules, "__rel").drop("__rel") if rules else found


def local_files(root: str, recursive: bool, ignore: bool) -> list[str]:
    from fnmatch import fnmatch

    found: list[str] = []
    known = gitignore.collect_rules(root) if ignore else None
    base, rules = known or (root, [])
    rel = lambda p: os.path.relpath(os.path.abspath(p), base).replace(os.sep, "/")
    if known and rel(root) != "." and gitignore.is_ignored(rules, rel(root) + "/x"):
        return []
    for at, folders, files in os.walk(os.path.abspath(root)):
        folders[:] = [] if not recursive else sorted(f for f in folders if f != ".git" and not gitignore.matches(rules, rel(os.path.join(at, f)), True))
        for f in sorted(files):
            if any(fnmatch(f, w) for w in WANTED) and not gitignore.matches(rules, rel(os.path.join(at, f)), False):
                found.append(os.path.join(at, f))
    return found


def drop_ignored(files: DataFrame, rules: list[gitignore.Rule], path: str = "path") -> DataFrame:
    """Rows whose path (relative to the repository's root) no rule ignores; the rules go along with the tasks."""

    @F.arrow_udf(T.BooleanType())
    def ignored(paths: pa.Array) -> pa.Array:
        return pa.array([None if p is None else gitignore.is_ignored(rules, p) for p in paths.to_pylist()], pa.bool_())

    return files.where(~F.coalesce(ignored(F.col(path)), F.lit(False)))
