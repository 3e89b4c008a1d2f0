"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

All measures are column expressions over one array of words. A few arrays are named in projections of their own,
as Catalyst would otherwise repeat them inside each lambda.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, French, German and Spanish; any language may satisfy the rule.
STOP_WORDS = (
    "a an and are as at be by for from had has have he in is it not of on or she that the they this to was were which with you "
    "au aux avec ce dans de des du elle en est et il la le les mais ne ou par pas pour qui que sa se son sur un une "
    "aber als auch auf das dem den der die ein eine einen er für im ist mit nicht sich sie und von wie zu "
    "al como con del el ella es las lo los más no para pero por su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure that must lie in [low, high]; one that can't be taken (nothing to divide by) doesn't count against a text."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        value = F.expr(self.measure)
        out = F.lit(True)
        if self.low is not None:
            out = out & F.coalesce(value >= F.lit(self.low), F.lit(True))
        if self.high is not None:
            out = out & F.coalesce(value <= F.lit(self.high), F.lit(True))
        return out


#: The threshold table. A new rule is a new line.
RULES = (
    Rule("words", "n_words", low=MIN_WORDS),
    Rule("word_length", "try_divide(word_chars, n_words)", low=1.5, high=25.0),
    Rule("symbols", "try_divide(n_symbols, word_chars)", high=0.1),
    Rule("stop_words", "try_divide(n_stop_words, n_words)", low=0.05),
    Rule("repeated_lines", "try_divide(n_dup_lines, n_lines)", high=0.5),
)


def with_measures(docs: DataFrame) -> DataFrame:
    """docs and the measures n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_repeat_words (long)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stop = F.size(F.filter("_words", lambda x: F.lower(x).isin(STOP_WORDS)))
    out = docs.withColumns({"_words": words, "_lines": lines}).withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_stop_words": stop.cast("long"),
    })
    at = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashed = F.transform(at, lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(WINDOW))))
    out = out.withColumn("_windows", hashed)
    # only a text with an equal pair of windows is sorted: (hash, place), then the places whose hash stands next to its equal
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    none = F.expr("cast(array() as array<struct<hash:bigint,place:int>>)")
    placed = F.transform("_windows", lambda h, i: F.struct(h.alias("hash"), i.alias("place")))
    out = out.withColumn("_sorted", F.when(repeats, F.array_sort(placed)).otherwise(none))
    beside = F.transform("_sorted", lambda e, j: F.when((F.get("_sorted", j - 1)["hash"] == e["hash"]) | (F.get("_sorted", j + 1)["hash"] == e["hash"]), e["place"]))
    out = out.withColumn("_places", F.array_sort(F.array_compact(beside)))
    state = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("_places", state, lambda acc, p: F.struct((acc["covered"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("covered"), p.alias("last")))["covered"]
    return out.withColumn("n_repeat_words", covered).drop("_words", "_lines", "_windows", "_sorted", "_places")


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs' columns, the measures, base_failed, failed_rules array<string> and kept for every row of docs.

    Null and empty texts have no words and are not kept. Rows are judged one by one, so repeated rows, ties and null ids
    change nothing. Columns of docs with the names of measures are replaced.
    """
    new = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words", "base_failed", "failed_rules", "kept", "_words", "_lines", "_windows", "_sorted", "_places"}
    out = with_measures(docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in new)))
    failed = F.array_compact(F.array(*(F.when(~r.holds(), F.lit(r.name)) for r in rules)))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("failed_rules", failed).withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that are kept, with their columns."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]))
    # the row number keeps the filter above the measures; pushed below, it would repeat them inside each other
    out = judged(plain, rules).withColumn("_row", F.monotonically_increasing_id())
    return out.where(F.col("kept") & (F.col("_row") >= 0)).select(*names).toDF(*docs.columns)


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
wins AS (
  SELECT rid, i, w[i:i+4] AS win, count(*) OVER (PARTITION BY rid, w[i:i+4]) AS n
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (
  SELECT rid, sum(least(5, i - prev)) AS covered
  FROM (SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -5) AS prev FROM wins WHERE n > 1) GROUP BY rid),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0)::BIGINT AS n_lines,
    len(list_filter(w, lambda x: list_contains([{", ".join(f"'{x}'" for x in STOP_WORDS)}], lower(x))))::BIGINT AS n_stop,
    coalesce(covered, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (n_words = 0 OR word_chars::DOUBLE / n_words BETWEEN 1.5 AND 25.0)
    AND (word_chars = 0 OR n_symbols::DOUBLE / word_chars <= 0.1)
    AND (n_words = 0 OR n_stop::DOUBLE / n_words >= 0.05)
    AND (n_lines = 0 OR n_dup_lines::DOUBLE / n_lines <= 0.5) AS kept
FROM b
"""
