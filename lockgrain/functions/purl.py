"""Package URLs as Catalyst expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from lockgrain.schema import PURL_TYPES


def percent_encode(text: Column) -> Column:
    """Percent-encoding of a package URL part; '/' and ':' stay."""
    out = F.url_encode(text)
    for code, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%3A", ":"), ("%2F", "/")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def purl_type(ecosystem: Column) -> Column:
    """Package URL type of an ecosystem; null if it has none."""
    types = F.create_map(*(F.lit(x) for x in chain.from_iterable(PURL_TYPES.items())))
    return F.when(ecosystem.isNotNull(), types[ecosystem])


def purl_parts(ecosystem: Column, name: Column) -> Column:
    """struct(namespace, name); null where the name does not fit its ecosystem (Maven g:a, Composer v/p, Go any path)."""
    part = lambda ns, n: F.struct(ns.alias("namespace"), n.alias("name"))
    colon, slash = F.split(name, ":", -1), F.split(name, "/", -1)
    return (
        F.when(ecosystem == "Maven", F.when(F.size(colon) == 2, part(colon[0], F.get(colon, F.lit(1)))))
        .when(ecosystem == "Packagist", F.when(F.size(slash) == 2, part(slash[0], F.get(slash, F.lit(1)))))
        .when(
            ecosystem == "Go",
            F.when(F.coalesce(name, F.lit("")) != "", part(F.array_join(F.slice(slash, 1, F.size(slash) - 1), "/"), F.element_at(slash, -1))),
        )
        .otherwise(part(F.lit(""), F.coalesce(name, F.lit(""))))
    )


def has_purl(ecosystem: Column, name: Column) -> Column:
    """Whether a package URL can be made, without making it."""
    return F.coalesce(purl_type(ecosystem).isNotNull() & purl_parts(ecosystem, name).isNotNull(), F.lit(False))


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    """pkg:type/namespace/name@version; null where no package URL can be made. A null or empty version is left out."""
    kind, parts = purl_type(ecosystem), purl_parts(ecosystem, name)
    space = F.when(parts["namespace"] != "", F.concat(percent_encode(parts["namespace"]), F.lit("/"))).otherwise(F.lit(""))
    tail = F.when(F.coalesce(version, F.lit("")) != "", F.concat(F.lit("@"), percent_encode(version))).otherwise(F.lit(""))
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), F.when(parts.isNotNull(), space), percent_encode(parts["name"]), tail)
