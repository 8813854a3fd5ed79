"""SQL of the version orderings, written from each ecosystem's rules apart from the keys the engine sorts by.

Every query gives (ecosystem, name, version, place), the dense rank of each distinct version within its package. Numbers
are HUGEINT here, while the engine's have no bound.
"""

from __future__ import annotations

SEMVER = ("npm", "crates.io", "Go", "Hex", "Pub", "ConanCenter")
ROWS = "SELECT DISTINCT ecosystem, name, version FROM package_rows WHERE name IS NOT NULL AND version IS NOT NULL AND ecosystem IS NOT NULL"


def _of(*ecosystems: str) -> str:
    return f"v AS ({ROWS} AND ecosystem IN ({', '.join(repr(e) for e in ecosystems)}))"


_ALL = f"v AS ({ROWS})"
_RANK = "SELECT ecosystem, name, version, CAST(dense_rank() OVER (PARTITION BY ecosystem, name ORDER BY {}) AS INTEGER) AS place FROM k"
_ZEROS = "[CAST(0 AS HUGEINT) FOR z IN range(40)]"


def _semantic(most: int, pre: str, *ecosystems: str) -> str:
    """Numbers, then release after pre-release, then the pre-release's parts: numbers before words, fewer before more."""
    return (
        rf"""WITH {_of(*ecosystems)},
s AS (SELECT *, regexp_extract(version, '^v?((?:[0-9]+|\.)*)', 1) AS head, regexp_extract(version, '^v?(?:[0-9]+|\.)*(.*)$', 1, 's') AS tail FROM v),
n AS (SELECT *, [x FOR x IN string_split(head, '.') IF x <> ''] AS nums FROM s),
r AS (SELECT *, CASE WHEN len(nums) = 0 AND starts_with(version, 'v') THEN 'v' ELSE '' END || CASE WHEN ends_with(head, '.') THEN '.' ELSE '' END || tail
  || coalesce(array_to_string(['.' || CAST(CAST(x AS HUGEINT) AS VARCHAR) FOR x IN nums[{most + 1}:]], ''), '') AS rest FROM n),
p AS (SELECT *, {pre.format("regexp_replace(regexp_replace(rest, '[+].*$', '', 's'), '^-', '')")} AS pre FROM r),
k AS (SELECT *, list_concat([CAST(x AS HUGEINT) FOR x IN nums[1:{most}]], {_ZEROS})[1:{most}] AS a,
  [{{'w': NOT regexp_full_match(x, '[0-9]+'), 'n': coalesce(TRY_CAST(CASE WHEN regexp_full_match(x, '[0-9]+') THEN x END AS HUGEINT), 0), 's': CASE WHEN regexp_full_match(x, '[0-9]+') THEN '' ELSE x END}} FOR x IN string_split(pre, '.') IF pre <> ''] AS c FROM p)
"""
        + _RANK.format("a, pre = '', c")
    )


_CRAN = (
    f"""WITH {_of("CRAN")},
n AS (SELECT *, [CASE WHEN regexp_full_match(x, '[0-9]+') THEN CAST(x AS HUGEINT) ELSE 0 END FOR x IN string_split(replace(version, '-', '.'), '.')] AS nums FROM v),
k AS (SELECT *, list_concat(nums, {_ZEROS})[1:40] AS a FROM n)
"""
    + _RANK.format("a, len(nums)")
)

#: PEP 440 versions come after all others; those are compared as texts of padded numbers and marked words. A hyphen
#: before a word that sorts below 'final' has no weight (here: words that begin with a to e, and dev).
_PYPI = (
    rf"""WITH {_of("PyPI")},
m AS (SELECT *, regexp_extract(lower(version), '^\s*v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?([0-9]+)?)?(?:-([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]+)?)?([-_.]?dev[-_.]?([0-9]+)?)?(?:[+]([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$',
  ['epoch', 'rel', 'pre', 'pre_n', 'post_a', 'post', 'post_n', 'dev', 'dev_n', 'loc']) AS g FROM v),
t AS (SELECT *, g.rel <> '' AS good, array_to_string([CASE WHEN x = '-' THEN ' *final-' WHEN x IN ('pre', 'preview', 'rc') THEN ' *c' WHEN x = 'dev' THEN ' *@' WHEN regexp_matches(x, '^[0-9]') THEN ' ' || lpad(x, CAST(greatest(8, length(x)) AS INTEGER), '0') ELSE ' *' || x END
  FOR x IN regexp_extract_all(lower(version), '[0-9]+|[a-z]+|-')], '') || ' *final' AS words FROM m),
k AS (SELECT *, CASE WHEN good THEN '' ELSE replace(regexp_replace(regexp_replace(words, '(?: \*final-)+( \*[@a-e])', '\1', 'g'), '(?: 00000000)+( \*)', '\1', 'g'), ' ', '') END AS old,
  coalesce(TRY_CAST(nullif(g.epoch, '') AS HUGEINT), 0) AS epoch, list_concat([CAST(x AS HUGEINT) FOR x IN string_split(g.rel, '.') IF x <> ''], {_ZEROS})[1:40] AS rel,
  g.post_a <> '' OR g.post <> '' AS has_post, g.dev <> '' AS has_dev,
  CASE WHEN g.pre <> '' THEN 1 WHEN NOT (g.post_a <> '' OR g.post <> '') AND g.dev <> '' THEN 0 ELSE 2 END AS pre_k,
  CASE WHEN g.pre IN ('a', 'alpha') THEN 0 WHEN g.pre IN ('b', 'beta') THEN 1 WHEN g.pre <> '' THEN 2 ELSE 0 END AS pre_p, coalesce(TRY_CAST(nullif(g.pre_n, '') AS HUGEINT), 0) AS pre_n,
  coalesce(TRY_CAST(nullif(g.post_a || g.post_n, '') AS HUGEINT), 0) AS post_n, coalesce(TRY_CAST(nullif(g.dev_n, '') AS HUGEINT), 0) AS dev_n,
  [{{'k': CASE WHEN regexp_full_match(x, '[0-9]+') THEN 2 ELSE 1 END, 'n': CASE WHEN regexp_full_match(x, '[0-9]+') THEN CAST(x AS HUGEINT) ELSE 0 END, 's': CASE WHEN regexp_full_match(x, '[0-9]+') THEN '' ELSE x END}} FOR x IN string_split_regex(g.loc, '[._-]')] AS loc FROM t)
"""
    + _RANK.format("good, old, epoch, rel, pre_k, pre_p, pre_n, has_post, post_n, NOT has_dev, dev_n, loc")
)

_PACKAGIST = (
    f"""WITH {_of("Packagist")},
w AS (SELECT *, regexp_extract_all(regexp_replace(regexp_replace(version, '^v', ''), '[-_+]', '.', 'g'), '[0-9]+|[^0-9.]+') AS parts FROM v),
k AS (SELECT *, list_append([CASE WHEN regexp_full_match(x, '[0-9]+') THEN {{'k': 4, 'd': 1, 'n': CAST(x AS HUGEINT)}} ELSE {{'k': CASE WHEN starts_with(x, 'RC') THEN 3 WHEN starts_with(x, 'dev') THEN 0 WHEN starts_with(x, 'a') THEN 1
  WHEN starts_with(x, 'b') THEN 2 WHEN starts_with(x, 'rc') THEN 3 WHEN starts_with(x, '#') THEN 4 WHEN starts_with(x, 'p') THEN 5 ELSE 0 END, 'd': 0, 'n': CAST(0 AS HUGEINT)}} END FOR x IN parts], {{'k': 4, 'd': 0, 'n': CAST(0 AS HUGEINT)}}) AS a FROM w)
"""
    + _RANK.format("a")
)

#: Zeros before the first word and at the end say nothing; a missing part is a zero, and words come before numbers.
_RUBYGEMS = (
    rf"""WITH {_of("RubyGems")},
w AS (SELECT *, regexp_extract_all(version, '[0-9]+|[^0-9.]+') AS parts FROM v),
f AS (SELECT *, coalesce(nullif(list_position([NOT regexp_full_match(x, '[0-9]+') FOR x IN parts], true), 0), len(parts) + 1) AS word_at FROM w),
c AS (SELECT *, regexp_extract_all(regexp_replace(array_to_string(parts[1:word_at - 1], '.'), '(^|\.)0+(\.0+)*$', '') || '.' || array_to_string(parts[word_at:], '.'), '[0-9]+|[^0-9.]+') AS kept FROM f),
k AS (SELECT *, list_concat([{{'k': CASE WHEN regexp_full_match(x, '[0-9]+') THEN 1 ELSE 0 END, 'n': CASE WHEN regexp_full_match(x, '[0-9]+') THEN CAST(x AS HUGEINT) ELSE 0 END, 's': CASE WHEN regexp_full_match(x, '[0-9]+') THEN '' ELSE x END}} FOR x IN kept],
  [{{'k': 1, 'n': CAST(0 AS HUGEINT), 's': ''}} FOR z IN range(40)])[1:40] AS a FROM c)
"""
    + _RANK.format("a")
)


def _debian_part(text: str) -> str:
    """Stretches of other characters with the number behind them; '~' comes before the end, letters before other characters."""
    weights = "[CASE WHEN c = '~' THEN 1 WHEN regexp_full_match(c, '[A-Za-z]') THEN unicode(c) ELSE unicode(c) + 122 END FOR c IN string_split(regexp_extract(x, '^[^0-9]*'), '') IF c <> '']"
    parts = f"[{{'w': list_append({weights}, 2), 'n': coalesce(TRY_CAST(nullif(regexp_extract(x, '[0-9]*$'), '') AS HUGEINT), 0)}} FOR x IN CASE WHEN {text} = '' THEN [''] ELSE regexp_extract_all({text}, '[^0-9]*[0-9]+|[^0-9]+') END]"
    return f"list_append({parts}, {{'w': [2], 'n': CAST(0 AS HUGEINT)}})"


_DEBIAN = (
    f"""WITH {_ALL},
e AS (SELECT *, CASE WHEN contains(trim(version), ':') THEN split_part(trim(version), ':', 1) ELSE '0' END AS epoch, regexp_replace(trim(version), '^[^:]*:', '') AS rest FROM v),
u AS (SELECT *, regexp_replace(rest, '-[^-]*$', '') AS upstream, CASE WHEN contains(rest, '-') THEN regexp_extract(rest, '[^-]*$') ELSE '0' END AS revision FROM e),
k AS (SELECT *, CASE WHEN regexp_full_match(epoch, '[0-9]+') THEN CAST(epoch AS HUGEINT) ELSE 0 END AS n, {_debian_part("upstream")} AS a, {_debian_part("revision")} AS b FROM u)
"""
    + _RANK.format("n, a, b")
)

_FIRST = "coalesce([x FOR x IN {} IF x <> 0][1], 0)"

#: Tokens of Maven versions: mark and value; what says nothing is cut at the end and before hyphens.
_MAVEN_TOKENS = r"""
raw AS (SELECT DISTINCT version, regexp_extract_all(version, '[-.]?(?:[0-9]+|[^-.0-9]+)') AS parts FROM v),
named AS (SELECT version, [{'m': CASE WHEN regexp_matches(parts[i], '^[-.]') THEN parts[i][1] WHEN i = 1 THEN '' ELSE '-' END, 'v': lower(regexp_replace(parts[i], '^[-.]', '')),
  'digit_next': i < len(parts) AND regexp_matches(coalesce(parts[i + 1], ''), '^[0-9]')} FOR i IN range(1, len(parts) + 1)] AS t FROM raw),
word AS (SELECT version, [{'m': x.m, 'v': CASE WHEN regexp_full_match(x.v, '[0-9]+') THEN CAST(CAST(x.v AS HUGEINT) AS VARCHAR) WHEN x.v = 'cr' THEN 'rc' WHEN x.v IN ('ga', 'final', 'release') THEN ''
  WHEN x.v = 'a' AND x.digit_next THEN 'alpha' WHEN x.v = 'b' AND x.digit_next THEN 'beta' WHEN x.v = 'm' AND x.digit_next THEN 'milestone' ELSE x.v END} FOR x IN t] AS t FROM named),
line AS (SELECT version, t[1].v AS head, regexp_replace(array_to_string([x.m || x.v || ';' FOR x IN t[2:]], ''), '(?:[.-]0?;)+(-|$)', '\1', 'g') AS tail FROM word),
tok AS (SELECT version, list_concat([{'m': '', 'v': head}], [{'m': x[1], 'v': x[2:]} FOR x IN string_split(tail, ';') IF x <> '']) AS t FROM line),
"""


def _maven_sign(a: str, b: str) -> str:
    """SQL for the order of two token lists: the first tokens that differ, an ended side standing for nothing."""
    place = "{{'k': CASE WHEN regexp_full_match({0}.v, '[0-9]+') THEN CASE WHEN {0}.m = '-' THEN 2 ELSE 3 END WHEN {0}.m = '-' THEN 1 ELSE 0 END, 'n': CASE WHEN regexp_full_match({0}.v, '[0-9]+') THEN CAST({0}.v AS HUGEINT) ELSE coalesce(nullif(list_position(['alpha', 'beta', 'milestone', 'rc', 'snapshot', '', 'sp'], {0}.v), 0), 8) END, 's': CASE WHEN regexp_full_match({0}.v, '[0-9]+') THEN '' ELSE {0}.v END}}"
    nothing = "{{'m': {0}.m, 'v': CASE WHEN {0}.m <> '-' AND regexp_full_match({0}.v, '[0-9]+') THEN '0' ELSE '' END}}"
    x, y = f"(CASE WHEN i <= len({a}) THEN {a}[i] ELSE {nothing.format(f'{b}[i]')} END)", f"(CASE WHEN i <= len({b}) THEN {b}[i] ELSE {nothing.format(f'{a}[i]')} END)"
    signs = f"[CASE WHEN {place.format(x)} < {place.format(y)} THEN -1 WHEN {place.format(x)} > {place.format(y)} THEN 1 ELSE 0 END FOR i IN range(1, greatest(len({a}), len({b})) + 1)]"
    return _FIRST.format(signs)


_MAVEN = f"""WITH {_of("Maven")},{_MAVEN_TOKENS}
pairs AS (SELECT a.ecosystem, a.name, a.version, b.version AS other, {_maven_sign("y.t", "x.t")} AS sign FROM v a JOIN v b ON a.ecosystem = b.ecosystem AND a.name = b.name JOIN tok x ON a.version = x.version JOIN tok y ON b.version = y.version),
same AS (SELECT ecosystem, name, version, min(other) AS of FROM pairs WHERE sign = 0 GROUP BY ALL)
SELECT p.ecosystem, p.name, p.version, CAST(1 + count(DISTINCT s.of) FILTER (WHERE p.sign < 0) AS INTEGER) AS place FROM pairs p JOIN same s ON p.ecosystem = s.ecosystem AND p.name = s.name AND p.other = s.version GROUP BY ALL"""

_NEIGHBOURS = "n AS (SELECT * FROM (SELECT *, lead(version) OVER (PARTITION BY ecosystem, name ORDER BY version) AS next_version FROM v) WHERE next_version IS NOT NULL)"

MAVEN_COMPARE = f"""WITH {_of("Maven")},{_MAVEN_TOKENS}{_NEIGHBOURS}
SELECT n.ecosystem, n.name, n.version, n.next_version, CAST({_maven_sign("x.t", "y.t")} AS INTEGER) AS sign FROM n JOIN tok x ON n.version = x.version JOIN tok y ON n.next_version = y.version"""

_SUFFIX = "_(?:alpha|beta|pre|rc|cvs|svn|git|hg|p)[0-9]*"
_ALPINE_NUMBER = "CASE WHEN i > 1 AND i <= len(x.nums) AND i <= len(y.nums) AND (starts_with(x.nums[i], '0') OR starts_with(y.nums[i], '0')) THEN CASE WHEN x.nums[i] < y.nums[i] THEN -1 WHEN x.nums[i] > y.nums[i] THEN 1 ELSE 0 END ELSE CAST(sign(CAST(coalesce(nullif(x.nums[i], ''), '0') AS HUGEINT) - CAST(coalesce(nullif(y.nums[i], ''), '0') AS HUGEINT)) AS INTEGER) END"
_ALPINE_SUFFIX = "CASE WHEN coalesce(x.suf[i], {'k': 5, 'n': CAST(0 AS HUGEINT)}) < coalesce(y.suf[i], {'k': 5, 'n': CAST(0 AS HUGEINT)}) THEN -1 WHEN coalesce(x.suf[i], {'k': 5, 'n': CAST(0 AS HUGEINT)}) > coalesce(y.suf[i], {'k': 5, 'n': CAST(0 AS HUGEINT)}) THEN 1 ELSE 0 END"
_SIGN = "CASE WHEN {0} < {1} THEN -1 WHEN {0} > {1} THEN 1 ELSE 0 END"

#: Numbers, letter, suffixes, build, and whether something unknown is left; if so on both sides, the texts decide.
ALPINE_COMPARE = f"""WITH {_ALL},{_NEIGHBOURS},
h AS (SELECT DISTINCT version, regexp_extract(version, '^(?:[0-9]+\\.?)*') AS head, regexp_replace(version, '^(?:[0-9]+\\.?)*', '') AS rest FROM v),
l AS (SELECT *, regexp_extract(rest, '^[a-z]?') AS letter, regexp_replace(rest, '^[a-z]', '') AS tail FROM h),
s AS (SELECT *, [{{'k': CAST(list_position(['alpha', 'beta', 'pre', 'rc', '', 'cvs', 'svn', 'git', 'hg', 'p'], regexp_extract(z, '[a-z]+')) - 1 AS INTEGER), 'n': CAST(coalesce(nullif(regexp_extract(z, '[0-9]*$'), ''), '0') AS HUGEINT)}} FOR z IN regexp_extract_all(tail, '{_SUFFIX}')] AS suf,
  regexp_replace(regexp_replace(tail, '^(?:{_SUFFIX})+', ''), '^~[0-9a-f]+', '') AS more FROM l),
q AS (SELECT version, string_split(head, '.') AS nums, letter, suf, CAST(coalesce(nullif(regexp_extract(more, '^-r([0-9]*)', 1), ''), '0') AS HUGEINT) AS build, more <> '' AND NOT starts_with(more, '-r') AS bad, regexp_replace(more, '^-r[0-9]*', '') = '' AS clean FROM s)
SELECT n.ecosystem, n.name, n.version, n.next_version, CAST(CASE WHEN x.bad AND y.bad THEN {_SIGN.format("n.version", "n.next_version")} ELSE
  coalesce([z FOR z IN [{_FIRST.format(f"[{_ALPINE_NUMBER} FOR i IN range(1, greatest(len(x.nums), len(y.nums)) + 1)]")}, {_SIGN.format("x.letter", "y.letter")}, {_FIRST.format(f"[{_ALPINE_SUFFIX} FOR i IN range(1, greatest(len(x.suf), len(y.suf)) + 1)]")}, {_SIGN.format("x.build", "y.build")}, CASE WHEN x.clean = y.clean THEN 0 WHEN x.clean THEN 1 ELSE -1 END] IF z <> 0][1], 0) END AS INTEGER) AS sign
FROM n JOIN q x ON n.version = x.version JOIN q y ON n.next_version = y.version"""

SORTS = {
    "semver_sort": _semantic(3, "{}", *SEMVER),
    "nuget_sort": _semantic(4, "lower({})", "NuGet"),
    "cran_sort": _CRAN,
    "pypi_sort": _PYPI,
    "packagist_sort": _PACKAGIST,
    "rubygems_sort": _RUBYGEMS,
    "maven_sort": _MAVEN,
    "debian_sort": _DEBIAN,
}
NEWEST = "SELECT ecosystem, name, arg_max(version, {'p': place, 'v': version}) AS newest FROM (" + " UNION ALL ".join(f"SELECT * FROM ({q})" for k, q in SORTS.items() if k != "debian_sort") + ") GROUP BY ecosystem, name"
