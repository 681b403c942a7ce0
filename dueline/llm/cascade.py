"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

A rule rejects a document. The verdict of several rules is the same in any order,
its price is not: a rule costs nothing for a document that an earlier one has
rejected. So each rule is run on a sample, its seconds and the share it rejects
are noted, and rules are tried by rejection per cost, the highest first
(``ordered``). The cascade is one ``CASE`` whose branches Spark tries in turn
(``verdict``): a later rule is never evaluated for a rejected row. The order
changes the time alone, so results do not depend on the sample or the clock.

Nothing is shuffled, and a row needs only its own text: groups of copies, hot
sources and lost executors cost what any other row costs. Null texts count as
empty and have no words; repeated rows are judged each; an empty table gives an
empty one, its rules in the order given. Other columns are left alone, whatever
their names, but those that ``with_features`` adds.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dueline.llm._support import staged

#: Words are runs of anything but these (fixed value).
BLANKS = " \t\n\x0b\f\r"
_BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Words of a window that must not come again, and rows the rules are tried on.
WINDOW = 5
SAMPLE_ROWS = 2000
#: A rule that rejects nothing on the sample, or takes no time, has this much.
_LEAST = 1e-6

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    none = F.array().cast("array<string>")
    return F.when(trimmed == "", none).otherwise(F.split(trimmed, _BLANK_RUN))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    return _let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found)))


def _windows(words: Column, n: Column) -> Column:
    """Structs of neighbouring words; ``n`` is the number of words, ``WINDOW`` at least."""
    return F.arrays_zip(*[F.slice(words, k + 1, n - (WINDOW - 1)) for k in range(WINDOW)])


def repeated_words(words: Column, hashes: Column) -> Column:
    """Words in windows that stand twice or more in the text, the first included.

    Equal windows have equal hashes, so if all hashes differ nothing repeats. Else
    hashes, words and places are sorted, equal neighbours are kept and the words they
    cover counted from left to right.
    """
    n = F.size(words)
    ends = [str(k) for k in range(WINDOW + 1)]

    def covered(ordered: Column) -> Column:
        def alike(e: Column, i: Column) -> Column:
            def same(j: Column) -> Column:
                other = F.get(ordered, j)
                equal = other["0"] == e["0"]
                for k in ends[1:]:
                    equal = equal & (other[k] == e[k])
                return F.coalesce(equal, F.lit(False))

            return same(i - 1) | same(i + 1)

        places = F.sort_array(F.transform(F.filter(ordered, alike), lambda e: e[str(WINDOW + 1)]))
        start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("end"))

        def add(done: Column, place: Column) -> Column:
            end = place + WINDOW
            return F.struct(
                (done["words"] + end - F.greatest(place, done["end"])).alias("words"), end.alias("end")
            )

        return F.aggregate(places, start, add, lambda done: done["words"])

    # One flat struct: Spark compares its fields in order, mostly the hash alone.
    last = n - (WINDOW - 1)
    slices = [F.slice(words, k + 1, last) for k in range(WINDOW)]
    placed = F.arrays_zip(F.slice(hashes, 1, last), *slices, F.sequence(F.lit(1), last))
    exact = _let(F.sort_array(placed), covered)
    return (
        F.when(n <= WINDOW, 0).when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(exact)
    )


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of ``FEATURES`` as longs."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    n = F.size("_words")
    hashes = F.when(n > WINDOW, F.transform(_windows(F.col("_words"), n), lambda w: F.xxhash64(w)))
    held = docs.select("*", body.alias("_body"), words_of(body).alias("_words")).withColumn("_hashes", hashes)
    counts = {
        "n_words": n,
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.regexp_count("_body", F.lit(SYMBOLS)),
        "n_dup_lines": duplicate_lines(F.col("_body")),
        "n_repeat_words": repeated_words(F.col("_words"), F.col("_hashes")),
    }
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in FEATURES]
    return held.select(*kept, *[counts[c].cast("long").alias(c) for c in FEATURES])


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for rows that go; null counts as false."""

    name: str
    rejects: Column


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    share: float

    @property
    def rejection_per_cost(self) -> float:
        return max(self.share, _LEAST) / max(self.seconds, _LEAST)


def base_rules() -> list[Rule]:
    """Too short a text, and too much of it repeated."""
    return [
        Rule("few_words", F.col("n_words") < 10),
        Rule("repeated", 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    ]


def text_rules(text: str = "text") -> list[Rule]:
    """Rules for running prose, on the features and on the text itself."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    n = F.col("n_words")

    def lines(pattern: str) -> Column:
        return F.regexp_count(body, F.lit(pattern))

    blank = r"[\x20\x09\x0B-\x0D]*"
    begun = lines(rf"(?:^|\n){blank}[^\x20\x09-\x0D]")
    return [
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("duplicate_lines", 100 * F.col("n_dup_lines") > 30 * (lines("\n") + 1)),
        Rule("few_letters", 100 * lines(r"[^\p{L}\x20\x09-\x0D]") > 30 * F.col("word_chars")),
        Rule("bullets", 100 * lines(rf"(?:^|\n){blank}[-*•]") > 90 * begun),
        Rule("cut_lines", 100 * lines(rf"(?:\.\.\.|…){blank}(?:\n|$)") > 30 * begun),
    ]


def sampled(df: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows, written once so that each rule meets the same ones."""
    n = df.count()
    return staged(df.sample(min(1.0, rows / n), seed=7) if n > rows else df, "sample")


def estimates(sample: DataFrame, rules: list[Rule]) -> list[Estimate]:
    """Seconds and rejected share of each rule alone, on a sample.

    A pass over the sample without a rule is timed first and taken off.
    """

    def timed(rejects: Column) -> tuple[float, int, int]:
        begin = time.perf_counter()
        n, rejected = sample.agg(F.count("*"), F.count_if(rejects)).first()
        return time.perf_counter() - begin, n, rejected

    everything = [F.coalesce(r.rejects, F.lit(False)) for r in rules]
    timed(F.lit(False))
    empty, n, _ = timed(F.col("n_words") < 0)
    if not n:
        return [Estimate(r, 1.0, 0.0) for r in rules]
    found = []
    for rule, rejects in zip(rules, everything, strict=True):
        seconds, n, rejected = timed(rejects)
        found.append(Estimate(rule, max(seconds - empty, 0.001), rejected / n))
    return found


def ordered(found: list[Estimate]) -> list[Rule]:
    """Rules by rejection per cost; equal ones stay as they were."""
    return [e.rule for e in sorted(found, key=lambda e: -e.rejection_per_cost)]


def verdict(rules: list[Rule]) -> Column:
    """True for rows that no rule rejects; rules are tried in this order."""
    out = F
    for rule in rules:
        out = out.when(rule.rejects, False)
    return out.otherwise(True) if rules else F.lit(True)


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with their features, ``base_failed`` and ``kept``.

    The base rules are asked of every row; a row that they reject is not asked the
    others. ``text`` must not be named like a feature.
    """
    base, rules = base_rules(), text_rules(text)
    sample = sampled(docs.select(F.col(f"`{text}`").alias(text)))
    order = ordered(estimates(staged(with_features(sample, text), "features"), rules))
    failed = base[0].rejects
    for rule in base[1:]:
        failed = failed | rule.rejects
    counted = with_features(docs, text).withColumn("base_failed", failed)
    return counted.withColumn("kept", ~F.col("base_failed") & verdict(order))


def verdicts(docs: DataFrame) -> DataFrame:
    """The features and the verdict of every document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return judged(slim).select("doc_id", *FEATURES, "base_failed", "kept")


#: The same in DuckDB.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d),
windows AS (
  SELECT r, i, w[i:i + 4] AS g
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) > 5)),
twice AS (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM windows),
covered AS (
  SELECT r, count(DISTINCT p) AS n
  FROM (SELECT r, unnest(generate_series(i, i + 4)) AS p FROM twice WHERE n > 1) GROUP BY r),
f AS (
  SELECT doc_id, t, w, l, len(w) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d JOIN lines USING (r) LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
            OR 100 * n_dup_lines > 30 * len(string_split(t, chr(10)))
            OR 100 * len(regexp_extract_all(t, '[^\p{L}\x20\x09-\x0D]')) > 30 * word_chars
            OR 100 * len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{2022}]'))) > 90 * len(l)
            OR 100 * len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$')))
               > 30 * len(l)
           ) AS kept
FROM b"""
