"""Where advisories come from: a table, or a remote service asked once by the driver and turned into that table.

No executor opens a connection. Names of environment variables and of the service are given by the caller.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession

from lockgrain.schema import ADVISORY


@dataclass(frozen=True)
class Service:
    """A symbol service: the prefixes of its variables in order of precedence, its default host, path and header names."""

    prefixes: tuple[str, ...]
    default_host: str
    path: str
    jwt_header: str
    key_headers: tuple[str, str]  # of the API key and the application key


class NoCredentials(ValueError):
    """Neither a token nor both keys are set."""


def variable(service: Service, name: str, env: Mapping[str, str] = os.environ) -> str:
    """The first non-empty variable PREFIX_NAME; '' if there is none."""
    return next((env[k] for p in service.prefixes if env.get(k := f"{p}_{name}")), "")


def base_url(service: Service, override: str = "", env: Mapping[str, str] = os.environ) -> str:
    """An override, else HOSTNAME, else api.SITE, else the default host."""
    if override:
        return override
    host = variable(service, "HOSTNAME", env)
    site = variable(service, "SITE", env)
    return "https://" + (host or (f"api.{site}" if site else service.default_host))


def auth_headers(service: Service, jwt: str = "", env: Mapping[str, str] = os.environ) -> dict[str, str]:
    """A token given or set, else both keys."""
    if token := jwt or variable(service, "JWT_TOKEN", env):
        return {service.jwt_header: token}
    keys = {n: variable(service, n, env) for n in ("API_KEY", "APP_KEY")}
    if missing := [n for n, v in keys.items() if not v]:
        raise NoCredentials(f"missing variables: {', '.join(missing)}")
    return dict(zip(service.key_headers, keys.values()))


def read_response(body: str | bytes) -> list[tuple[str, str, str, str, str]]:
    """ADVISORY rows of a JSON:API answer: results of purls, each with advisories and their symbols."""
    attributes = (json.loads(body).get("data") or {}).get("attributes") or {}
    return [
        (result.get("purl", ""), advisory.get("advisory_id", ""), symbol.get("type", ""), symbol.get("value", ""), symbol.get("name", ""))
        for result in attributes.get("results") or []
        for advisory in result.get("vulnerable_symbols") or []
        for symbol in advisory.get("symbols") or []
    ]


def _post(url: str, headers: Mapping[str, str], body: bytes) -> bytes:
    with urlopen(Request(url, body, dict(headers), method="POST"), timeout=60) as answer:
        return answer.read()


def fetch(spark: SparkSession, purls: DataFrame, service: Service, override: str = "", jwt: str = "", per_call: int = 1000, post: Callable[[str, Mapping[str, str], bytes], bytes] = _post) -> DataFrame:
    """ADVISORY rows for distinct purls, asked in blocks that pass through the driver one after the other.

    Meant for the direct packages of scans; over large inventories give a table of advisories instead.
    """
    url = f"{base_url(service, override)}/{service.path}"
    headers = {"Content-Type": "application/json", **auth_headers(service, jwt)}
    rows: list[tuple] = []
    block: list[str] = []

    def ask(some: Sequence[str]) -> None:
        body = {"data": {"id": "resolve-vulnerable-symbols-request", "type": "resolve-vulnerable-symbols-request", "attributes": {"purls": list(some)}}}
        rows.extend(read_response(post(url, headers, json.dumps(body).encode())))

    for r in purls.select("purl").distinct().toLocalIterator():
        block.append(r["purl"])
        if len(block) == per_call:
            ask(block)
            block = []
    if block:
        ask(block)
    return spark.createDataFrame(rows, ADVISORY)
