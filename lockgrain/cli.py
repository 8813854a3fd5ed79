"""Command line: lockgrain [scan] PATH... writes the inventory of source trees."""

from __future__ import annotations

import argparse
import logging
import sys

from lockgrain.scan import APIFailed, NoPackagesFound, ScanOptions, scan, to_cyclonedx, to_json, write_json_lines
from lockgrain.session import local_session
from lockgrain.sinks.cyclonedx import to_text

#: Exit codes.
OK, FAILED, API_FAILED = 0, 127, 129
FORMATS = ("json", "jsonl", "cyclonedx-1-5", "void")
LEVELS = {"error": logging.ERROR, "warn": logging.WARNING, "info": logging.INFO, "verbose": logging.DEBUG}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lockgrain", description="Inventory of the dependencies in source trees.")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan", help="scan folders or single lockfiles")
    s.add_argument("paths", nargs="+")
    s.add_argument("--format", "-f", choices=FORMATS, default="json")
    s.add_argument("--output", help="file to write to instead of the standard output")
    s.add_argument("--not-recursive", action="store_true", help="don't go into subfolders")
    s.add_argument("--no-ignore", action="store_true", help="read files that ignore rules leave out, too")
    s.add_argument("--reachability", action="store_true")
    s.add_argument("--advisories", help="Parquet table of advisories with purl, advisory_id, symbol_type, symbol_value, symbol_name")
    s.add_argument("--advisories-url", help="service that gives advisories, where there is no table; asked by the driver")
    s.add_argument("--advisories-token", default="", help="token for the service")
    s.add_argument("--advisories-header", default="Authorization", help="header that carries the token")
    s.add_argument("--require-advisories", action="store_true", help="end with 129 if advisories can't be had, instead of going on without reachability")
    s.add_argument("--vulnerabilities", help="Parquet table of vulnerability records (package, vulnerabilities) for the document")
    s.add_argument("--pom-repository", help="Parquet table of poms with path and text")
    s.add_argument("--verbosity", choices=tuple(LEVELS), default="info")
    s.add_argument("--enable-parsers", action="append", default=[], help="only these parsers; may be given several times")
    return p


def _service(url: str | None, token: str, header: str):
    """(session, purls) to advisories from the service at a URL; None without one."""
    if not url:
        return None
    from urllib.parse import urlsplit

    from lockgrain.sources.advisories import Service, fetch

    parts = urlsplit(url)
    service = Service((), parts.netloc, parts.path.lstrip("/"), header, ("", ""))
    return lambda spark, purls: fetch(spark, purls, service, override=f"{parts.scheme}://{parts.netloc}", jwt=token)


def main(argv: list[str] | None = None, spark=None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in ("scan", "-h", "--help"):
        argv.insert(0, "scan")
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return OK if e.code in (0, None) else FAILED
    logging.basicConfig(level=LEVELS[a.verbosity], stream=sys.stderr, format="%(message)s")
    log = logging.getLogger("lockgrain")
    try:
        spark = spark or local_session(app="lockgrain scan")
        table = lambda p: spark.read.parquet(p) if p else None
        options = ScanOptions(tuple(a.paths), not a.not_recursive, not a.no_ignore, tuple(a.enable_parsers), a.reachability, table(a.advisories), _service(a.advisories_url, a.advisories_token, a.advisories_header), a.require_advisories, table(a.pom_repository))
        try:
            result = scan(spark, options)
        except NoPackagesFound:
            log.warning("No package sources found")
            result = None
        if result is not None:
            for e in result.errors.orderBy("path").toLocalIterator():
                log.warning("%s: %s", e["path"], e["message"])
        if a.format == "void":
            return OK
        if a.format == "jsonl":
            if not a.output:
                raise ValueError("--format jsonl needs --output, a folder that all executors share")
            if result is not None:
                write_json_lines(result, a.output)
            return OK
        text = to_text(to_json(result) if a.format == "json" else to_cyclonedx(spark, result, table(a.vulnerabilities)))
        if a.output:
            with open(a.output, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            sys.stdout.write(text)
        return OK
    except APIFailed as e:
        log.error("%s", e)
        return API_FAILED
    except Exception as e:
        log.error("%s", e)
        return FAILED


if __name__ == "__main__":
    sys.exit(main())
