"""Quality rules kept as a ledger: measurements and one failure bit per rule and document.

Every rule is evaluated once. A policy is a versioned set of rules; applying one, or asking
what a policy would do without one of its rules, reads bits only. Built-in functions only.

Words are ``[^\\x20\\x09-\\x0D]+``. A null text has no words. Empty and null texts fail
``few_words``. Rows are judged one by one, so repeated rows get equal answers, ids may be null and an
empty table gives an empty ledger. Input columns that clash with ledger columns are
untouched, because the input row travels in one struct column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.llm.shared import stored

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measurements


RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "100 * n_symbols > 30 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [r.name for r in RULES]
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
STRICT = Policy("strict-1", tuple(r.name for r in RULES))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once; lambdas re-evaluate free expressions for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _once(value: Column) -> Column:
    """A generated column: filters on it stay above, so the optimiser never copies its expression into lambdas."""
    return F.explode(F.array(value))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RUN), "")


def _repeated(items: Column, key: Callable[[Column], Column]) -> Column:
    """Of structs sorted by a key, those that share it with a neighbour."""
    return F.filter(items, lambda e, j: (
        F.coalesce(key(e) == key(F.get(items, j - 1)), F.lit(False)) | F.coalesce(key(e) == key(F.get(items, j + 1)), F.lit(False))
    ))


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in the text.

    Windows are sorted by hash first; only those with an equal neighbour are compared as
    words. The covered words are then counted along the sorted positions.
    """
    count = F.size(words)

    def positions(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        alike = bound(pairs, lambda s: _repeated(s, lambda e: e["h"]))
        spelled = F.transform(alike, lambda e: F.struct(F.array_join(F.slice(words, e["i"] + 1, F.lit(width)), " ").alias("w"), e["i"].alias("i")))
        equal = bound(F.sort_array(spelled), lambda s: _repeated(s, lambda e: e["w"]))
        return F.sort_array(F.transform(equal, lambda e: e["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.least(F.coalesce(F.get(at, j + 1) - p, F.lit(width)), F.lit(width)).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, s: total + s)

    def of_hashes(hashes: Column) -> Column:
        distinct = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(distinct, F.lit(0).cast("long")).otherwise(bound(positions(hashes), covered))

    hashes = F.transform(F.sequence(F.lit(0), count - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(count < width, F.lit(0).cast("long")).otherwise(bound(hashes, of_hashes))


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, measurements, failures): ``row`` is the input row, ``failures`` has bit i for rule i."""
    whole = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    base = base.select("row", _once(words_of(whole)).alias("_words"))
    lines = F.filter(F.split(whole, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    measured = base.withColumn("_lines", bound(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))).select(
        "row",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate(whole, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.col("_lines.n").cast("long").alias("n_lines"),
        (F.col("_lines.n") - F.col("_lines.d")).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"),
    )
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    book = measured.withColumn("failures", failures)
    return book.select("row", _once(F.struct(*MEASURES, "failures")).alias("m")).select("row", "m.*")


def fails(policy: Policy) -> Column:
    return F.col("failures").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(book: DataFrame, policy: Policy) -> DataFrame:
    """The input rows that pass every rule of the policy."""
    return book.filter(~fails(policy)).select("row.*")


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """Per rule (and its bit) of the policy: documents failing it, failing it alone, and kept if it went.

    Documents are first counted per combination of bits, so at most 2^rules rows are left.
    """
    mask = F.lit(policy.mask).cast("long")
    combos = book.groupBy(F.col("failures").bitwiseAND(mask).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    names = [r.name for r in RULES]
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in policy.rules])
    each = combos.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")
    return each.groupBy("rule", "bit").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("failing_alone"),
        F.sum(F.when((F.col("bits") == 0) | alone, F.col("n")).otherwise(0)).alias("kept_without"),
    ).withColumn("policy", F.lit(policy.version))


SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         [l FOR l IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS lines
  FROM documents),
g AS (
  SELECT r, i, array_to_string(words[i:i + 4], ' ') AS win
  FROM (SELECT r, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w WHERE len(words) >= 5)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM g) WHERE c > 1),
c AS (
  SELECT r, sum(least(coalesce(nxt - i, 5), 5)) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM d) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN c USING (r)),
f AS (
  SELECT *, n_words < 10 AS f0, 100 * n_repeat_words > 20 * n_words AS f1, 100 * n_symbols > 30 * n_words AS f2,
         100 * n_dup_lines > 50 * n_lines AS f3, (word_chars < 2 * n_words OR word_chars > 20 * n_words) AS f4
  FROM m),
v AS (
  SELECT *, CAST(f0::INT + 2 * f1::INT + 4 * f2::INT + 8 * f3::INT + 16 * f4::INT AS BIGINT) AS failures FROM f),
a AS (
  SELECT rule, bit, (SELECT count(*) FROM v WHERE failures IN (0, bit)) AS kept_without
  FROM (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('repeated_lines', 8), ('word_length', 16)) t(rule, bit))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f0 OR f1) AS base_failed, failures = 0 AS kept,
       failures, 'strict-1' AS policy, rule AS only_rule, kept_without
FROM v LEFT JOIN a ON bit = failures
"""


def query(spark, folder: str) -> DataFrame:
    """Verdicts and ablations from the stored ledger.

    ``only_rule`` names the rule that alone rejects a document, ``kept_without`` the documents that the
    policy would keep without it.
    """
    book = ledger(spark.read.parquet(f"{folder}/documents.parquet"))
    book = stored(book.select("row.doc_id", *MEASURES, "failures"), "ledger")
    # One row for each rule.
    cut = F.broadcast(ablations(book, STRICT).select(F.col("bit").alias("failures"), F.col("rule").alias("only_rule"), "kept_without"))
    return book.join(cut, "failures", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        fails(BASE).alias("base_failed"), (~fails(STRICT)).alias("kept"), "failures", F.lit(STRICT.version).alias("policy"), "only_rule", "kept_without",
    )


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    return apply_policy(ledger(docs), STRICT)
