"""Texts cut off by field limits or broken transfers, found by word trigrams in SQL.

Every text is read as words with boundaries between sentences and lines. Over all texts each word trigram is counted
inside (something follows within the sentence or line) and at ends (a stop, a line break or the end of the text
follows). A text whose final trigram is frequent inside but almost never at an end was cut. Where the final word itself
was cut, the trigram is unknown, while words that continue it are known after the same two words: their counts are those
of an inside.

Rare words, names and numbers share a class each, so that a sentence counts as the same one whatever package it is
about. Inside a code block no line break is an end, so a text that stops there has an inside trigram. Marks that follow
a cut (white space, an ellipsis, a bracketed ellipsis, a broken character) are taken off first.

A field limit also shows in lengths: where a length in characters or bytes holds far more of a source's texts than
the lengths near it do (``pile_ups``), a text of that length without a closing mark is cut unless its trigram mostly ends sentences.

Defined results: null, empty and blank texts are no case; each row is judged on its own, repeated rows alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lockgrain.session import cut_lineage

#: Characters and longer marks that may follow a cut.
SPACES, OTHER_MARKS, LONG_MARKS = (" ", "\\t", "\\n", "\\u000b", "\\u000c", "\\r"), ("\\u2026", "\\ufffd"), ("[...]", "[\\u2026]", "...")
SPACE, MARKS = "".join(SPACES), (*SPACES, *OTHER_MARKS)
MARK_CHARS = "".join(MARKS)


def _unmarked(text: str, times: int = 3) -> str:
    """SQL for a text without the marks at its end; few texts have one, and only those are trimmed."""
    ends = " OR ".join(f"endswith({text}, '{m}')" for m in (*MARKS, *LONG_MARKS))
    trimmed = text
    for _ in range(times):
        cases = " ".join(f"WHEN endswith(x, '{m}') THEN left(x, length(x) - {len(m.encode().decode('unicode_escape'))})" for m in LONG_MARKS)
        trimmed = f"get(transform(array(rtrim('{MARK_CHARS}', {trimmed})), x -> CASE {cases} ELSE x END), 0)"
    return f"CASE WHEN {ends} THEN rtrim('{MARK_CHARS}', {trimmed}) ELSE {text} END"


FEW_WORDS = 300_000  # common words up to which their table is broadcast
SPELLED = 40  # characters up to which all beginnings of a word are listed; longer ones are compared with the endings looked for

#: Characters of scripts written without spaces, as ranges, since names of scripts are looked up slowly.
UNSPACED_RANGES = (
    (0x3005, 0x3007), (0x3021, 0x3029), (0x3038, 0x303B), (0x3041, 0x3096), (0x309D, 0x309F), (0x30A1, 0x30FA), (0x30FD, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x20000, 0x323AF),
)
UNSPACED = "".join(f"{chr(first)}-{chr(last)}" for first, last in UNSPACED_RANGES)
#: SQL for a text with no such character and none of their stops: one range, which is looked for fast.
_SPACED = f"NOT {{0}} RLIKE '[{chr(0x2E80)}-{chr(0x10FFFF)}]'"


def _plain(x: str) -> str:
    """SQL for prose with ' ⏎ ' at the ends of sentences and lines, in lower case, numbers as 0, unspaced scripts by character."""
    spaced = rf"replace(lower(regexp_replace({x}, '[.!?]+(?=\\s|$)', ' ⏎ ')), '\n', ' ⏎ ')"
    other = rf"regexp_replace(replace(lower(regexp_replace({x}, '([.!?。！？]+)(?=\\s|$|[{UNSPACED}])|([。！？])', ' ⏎ ')), '\n', ' ⏎ '), '([{UNSPACED}、])', ' $1 ')"
    return rf"regexp_replace(CASE WHEN {_SPACED.format(x)} THEN {spaced} ELSE {other} END, '\\p{{{{Nd}}}}+', '0')"


def _code(x: str) -> str:
    """SQL for a code block: its line breaks are words, not boundaries."""
    line = rf"replace(lower({x}), '\n', ' <nl> ')"
    return rf"concat(' ⏎ <code> ', regexp_replace(CASE WHEN {_SPACED.format(x)} THEN {line} ELSE regexp_replace({line}, '([{UNSPACED}、])', ' $1 ') END, '\\p{{{{Nd}}}}+', '0'))"


#: The last part is inside a code block if it never closes. Positions before, before that and behind come from shifted copies.
_WORDS = r"""
WITH base AS (SELECT *, __WHOLE__ AS whole FROM {docs} WHERE text RLIKE '[^__SPACE__]'),
shown AS (SELECT * EXCEPT (whole), __SHOWN__ AS t, instr(whole, '```') > 0 AND (length(whole) - length(replace(whole, '```', ''))) DIV 3 % 2 = 1 AS open FROM base),
parts AS (SELECT *, CASE WHEN open OR instr(t, '```') > 0 THEN split(t, '```', -1) END AS p FROM shown),
coded AS (
  SELECT * EXCEPT (p), CASE WHEN p IS NULL THEN __PLAIN_T__
    ELSE array_join(transform(p, (x, i) -> CASE WHEN (size(p) - 1 - i + CASE WHEN open THEN 1 ELSE 0 END) % 2 = 1
      THEN __CODE__ ELSE concat(CASE WHEN i > 0 THEN ' </code> ⏎ ' ELSE '' END, __PLAIN_X__) END), '') END AS s
  FROM parts),
words AS (SELECT * EXCEPT (s), array_remove(split(s, '\\s+', -1), '') AS w FROM coded),
tri AS (
  SELECT c, b, CASE WHEN b = '⏎' THEN '⏎' ELSE a END AS a, coalesce(next = '⏎', NOT open) AS ends
  FROM (SELECT open, inline(arrays_zip(c, b, a, next)) FROM (SELECT open, w AS c, concat(array('⏎'), w) AS b, concat(array('⏎', '⏎'), w) AS a, slice(w, 2, size(w)) AS next FROM words))
  WHERE c <> '⏎')
"""
for _k, _v in {"__WHOLE__": _unmarked("text"), "__SPACE__": SPACE, "__PLAIN_T__": _plain("t"), "__PLAIN_X__": _plain("x"), "__CODE__": _code("x")}.items():
    _WORDS = _WORDS.replace(_k, _v)
#: All words of a text, or those of its last pieces: words hold no space, so the last eight hold the last three words.
_ALL, _LAST = _WORDS.replace("__SHOWN__", "whole"), _WORDS.replace("__SHOWN__", "substring_index(whole, ' ', -8)")


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(a, b, c, n, at_end): how often each trigram of raw words occurs, and how often at an end."""
    return docs.sparkSession.sql(_ALL + "SELECT a, b, c, count(*) AS n, sum(CASE WHEN ends THEN 1L ELSE 0L END) AS at_end FROM tri WHERE c <> '⏎' GROUP BY a, b, c", docs=docs)


#: The last word of each text with the two before it. stopped: a closing mark follows it.
_FINALS = """
, lasts AS (SELECT * EXCEPT (s), array_remove(split(regexp_replace(s, '[\\\\s⏎]+$', ''), '\\\\s+', -1), '') AS w FROM coded)
SELECT row, source, length(text) AS chars, octet_length(text) AS bytes, open, endswith(text, '\\ufffd') AS broken, substring(t, -1) IN ('.', '!', '?', '。', '！', '？') AS stopped,
  CASE WHEN endswith(t, '.') AND NOT endswith(t, '..') THEN concat(get(w, size(w) - 1), '.') ELSE get(w, size(w) - 1) END AS ending, get(w, size(w) - 1) AS c,
  coalesce(get(w, size(w) - 2), '⏎') AS b,
  CASE WHEN coalesce(get(w, size(w) - 2), '⏎') = '⏎' THEN '⏎' ELSE coalesce(get(w, size(w) - 3), '⏎') END AS a
FROM lasts
"""


def final_words(docs: DataFrame) -> DataFrame:
    """Of each text that isn't blank: row, source, lengths, its last three words and how it stops. Read from its end only."""
    return docs.sparkSession.sql(_LAST + _FINALS, docs=docs)


#: Rare words share a class; of the two words before the last also every name, number and path, common or not.
_CLASS = "CASE WHEN {x} = '⏎' OR {v}.word IS NOT NULL{but} THEN {x} ELSE concat('<x>', regexp_extract({x}, '[,;:)]+$', 0)) END"
_A, _B, _C = (_CLASS.format(x=f"t.{k}", v=f"v{k}", but="" if k == "c" else f" AND NOT t.{k} RLIKE '(?<=[\\\\p{{{{L}}}}0])[-_/@:.=+](?=[\\\\p{{{{L}}}}0])'") for k in "abc")
_CLASSED = f"""
SELECT {{columns}}, {_A} AS a, {_B} AS b, {_C} AS c, vc.word IS NOT NULL AS known
FROM {{t}} t LEFT JOIN {{va}} va ON t.a = va.word LEFT JOIN {{vb}} vb ON t.b = vb.word LEFT JOIN {{vc}} vc ON t.c = vc.word
"""

#: n, e: occurrences and ends of the trigram or pair; more: occurrences of words that continue the last word.
#: code and character are told from the text alone, length needs a pile-up, all others are counts.
_VERDICT = """
SELECT row, a, b, c, ending, stopped, broken, open, piled, n3, e3, n2, e2, n1, e1, more3, more2,
  CASE
    WHEN broken THEN 'character'
    WHEN open THEN 'code'
    WHEN more3 >= 3 AND same3 <= {rate} * more3 THEN 'longer word'
    WHEN more3 = 0 AND NOT known AND more2 >= 5 AND n3 < 4 THEN 'longer word after one'
    WHEN stopped THEN CASE WHEN piled AND n3 >= 20 AND e3 <= {rate} * n3 THEN 'length and trigram' END
    WHEN piled THEN CASE WHEN n3 < 4 THEN 'length' WHEN e3 <= 0.5 * n3 THEN 'length and trigram' END
    WHEN n3 >= 8 THEN CASE WHEN e3 <= {rate} * n3 THEN 'trigram' END
    WHEN n2 >= 8 THEN CASE WHEN e2 <= {rate} * n2 THEN 'pair' END
    WHEN known AND n2 >= 1 AND n1 >= 20 THEN CASE WHEN e1 <= {rate} * n1 THEN 'word' END END AS why
FROM (
  SELECT f.*, coalesce(t3.n, 1) - 1 AS n3, greatest(coalesce(t3.e, 1) - CASE WHEN f.open THEN 0 ELSE 1 END, 0) AS e3,
    CASE WHEN f.known THEN (CASE WHEN f.stopped THEN coalesce(t3.e, 1) ELSE coalesce(t3.n, 1) END) - 1 ELSE 0 END AS same3,
    coalesce(t2.n, 1) - 1 AS n2, greatest(coalesce(t2.e, 1) - 1, 0) AS e2, coalesce(t1.n, 1) - 1 AS n1, greatest(coalesce(t1.e, 1) - 1, 0) AS e1,
    coalesce(p3.n, 0) AS more3, coalesce(p2.n, 0) AS more2
  FROM {finals} f
  LEFT JOIN {t3} t3 ON f.a = t3.a AND f.b = t3.b AND f.c = t3.c
  LEFT JOIN {t2} t2 ON f.b = t2.b AND f.c = t2.c
  LEFT JOIN {t1} t1 ON f.c = t1.c
  LEFT JOIN {p3} p3 ON f.a = p3.a AND f.b = p3.b AND f.ending = p3.p
  LEFT JOIN {p2} p2 ON f.b = p2.b AND f.ending = p2.p)
"""


def pile_ups(docs: DataFrame, around: int = 32, sigmas: float = 6.0, times: float = 5.0) -> DataFrame:
    """(source, unit, size): lengths in characters or bytes that far more of a source's texts have than lengths near them.

    A length's texts are held against the mean over the lengths up to ``around`` shorter or longer: they must exceed it by
    ``sigmas`` times the root of that mean (plus one, for lengths that hardly occur), as counts that fall by chance hardly
    ever do, and be ``times`` that mean, as the slope of an ordinary distribution isn't. The test follows the counts, so
    the same mix is judged alike in a source of any size.
    """
    texts = docs.where("text is not null and text <> ''")
    return _piles(texts.select("source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes")), around, sigmas, times)


def _piles(lengths: DataFrame, around: int = 32, sigmas: float = 6.0, times: float = 5.0) -> DataFrame:
    """pile_ups from (source, chars, bytes)."""
    sizes = lengths.select(F.coalesce("source", F.lit("")).alias("source"), F.expr("stack(2, 'chars', chars, 'bytes', bytes)").alias("unit", "size"))
    counts = sizes.groupBy("source", "unit", "size").agg(F.count("*").alias("n"))
    near = Window.partitionBy("source", "unit").orderBy("size").rangeBetween(-around, around)
    usual = (F.sum("n").over(near) - F.col("n")) / F.lit(2.0 * around)
    return counts.withColumn("usual", usual).where((F.col("n") - F.col("usual") > sigmas * F.sqrt(F.col("usual") + 1)) & (F.col("n") >= times * F.col("usual"))).select("source", "unit", "size")


def verdicts(docs: DataFrame, rate: float = 0.02, share: float = 0.001) -> DataFrame:
    """One row per text that has a word: row (its id), the counts of its final trigram, and why it counts as cut (null: it doesn't).

    ``docs`` has row, source and text. ``rate``: up to this part of a trigram's occurrences may be at ends ("almost never").
    ``share``: a word is common from this share of the texts on (three occurrences at least).

    The texts are read twice, once for all trigrams and once for their ends; all that follows works on counts.
    """
    spark = docs.sparkSession
    raw = cut_lineage(trigram_counts(docs))
    finals = cut_lineage(final_words(docs)).where("c is not null")  # behind the checkpoint, else words would be read twice
    piles = _piles(finals)
    by_unit = lambda unit: piles.where(F.col("unit") == unit).select("source", F.col("size").alias(unit), F.lit(True).alias(f"piled_{unit}"))
    ends = finals.withColumn("source", F.coalesce("source", F.lit(""))).join(by_unit("chars"), ["source", "chars"], "left").join(by_unit("bytes"), ["source", "bytes"], "left")
    ends = ends.withColumn("piled", F.coalesce("piled_chars", "piled_bytes", F.lit(False)))
    least = max(3.0, share * finals.count())
    words = cut_lineage(raw.groupBy(F.col("c").alias("word")).agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("word"))
    near = F.broadcast(words) if words.count() <= FEW_WORDS else words
    t3 = spark.sql(_CLASSED.replace("{columns}", "t.n, t.at_end"), t=raw, va=near, vb=near, vc=near)
    t3 = cut_lineage(t3.groupBy("a", "b", "c").agg(F.sum("n").alias("n"), F.sum("at_end").alias("e"), F.max("known").alias("known")))
    last = cut_lineage(spark.sql(_CLASSED.replace("{columns}", "t.row, t.broken, t.stopped, t.open, t.ending, t.piled"), t=ends, va=near, vb=near, vc=near))
    t2 = t3.groupBy("b", "c").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.max("known").alias("known"))
    t1 = t2.groupBy("c").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))

    def continued(counts: DataFrame, *before: str) -> DataFrame:
        """(before, p, n): occurrences of known words that continue p after the same words. Only words behind which some
        text ends are spelled out."""
        wanted = last.select(*before, F.col("ending").alias("p")).distinct()
        near = counts.where("known").join(wanted.select(*before).distinct(), [*before], "left_semi")
        starts = F.explode(F.transform(F.sequence(F.lit(1), F.length("c") - 1), lambda k: F.left("c", k))).alias("p")
        spelled = near.where(f"length(c) between 2 and {SPELLED}").select(*before, "n", starts).join(wanted, [*before, "p"], "left_semi")
        long = near.where(f"length(c) > {SPELLED}").join(wanted, [*before]).where("startswith(c, p) and c <> p").select(*before, "n", "p")
        return spelled.unionByName(long).groupBy(*before, "p").agg(F.sum("n").alias("n"))

    p3, p2 = continued(t3, "a", "b"), continued(t2, "b")
    return spark.sql(_VERDICT.replace("{rate}", repr(float(rate))), finals=last, t3=t3.drop("known"), t2=t2.drop("known"), t1=t1, p3=p3, p2=p2)


def evidence(docs: DataFrame, doc_id: str = "doc_id", **parameters) -> DataFrame:
    """(doc_id, why): the texts that were cut, and what shows it."""
    judged = verdicts(docs.select(F.col(doc_id).alias("row"), F.col("source").cast("string"), F.col("text").cast("string")), **parameters)
    return judged.where("why is not null").groupBy(F.col("row").alias(doc_id)).agg(F.min("why").alias("why"))


def truncated(docs: DataFrame, doc_id: str = "doc_id", **parameters) -> DataFrame:
    """The ids of the texts that were cut. ``docs`` has the id, source and text; other columns are ignored."""
    return evidence(docs, doc_id, **parameters).select(doc_id)


def truncation_rates(docs: DataFrame, doc_id: str = "doc_id", **parameters) -> DataFrame:
    """(source, n_docs, n_cut, rate): how often each source truncates; texts without a word count as whole."""
    cut = truncated(docs, doc_id, **parameters).withColumn("is_cut", F.lit(1))
    both = docs.select(doc_id, F.col("source").cast("string")).join(cut, doc_id, "left")
    return both.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.coalesce("is_cut", F.lit(0))).alias("n_cut")).withColumn("rate", F.col("n_cut") / F.col("n_docs"))
