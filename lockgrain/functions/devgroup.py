"""Whether all dependency groups of a package are development groups, by ecosystem."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Group names that mean development for Bundler.
BUNDLER_DEV_GROUPS = ("dev", "development", "test", "ci", "cucumber", "linting", "rubocop")


def is_dev_group(ecosystem: Column, groups: Column) -> Column:
    """False for null or no groups and for ecosystems without development groups; a null group is no development group."""
    every = lambda test: F.forall(groups, lambda g: F.coalesce(test(g), F.lit(False)))
    by = (
        F.when(ecosystem == "npm", every(lambda g: g.isin("dev", "optional")) & F.array_contains(groups, "dev"))
        .when(ecosystem.isin("Packagist", "PyPI", "Pub", "NuGet"), every(lambda g: g == "dev"))
        .when(ecosystem == "ConanCenter", every(lambda g: g == "build-requires"))
        .when(ecosystem == "Maven", every(lambda g: g.startswith("test")))
        .when(ecosystem == "RubyGems", every(lambda g: g.isin(*BUNDLER_DEV_GROUPS)))
        .otherwise(F.lit(False))
    )
    return F.coalesce((F.size(groups) > 0) & by, F.lit(False))
