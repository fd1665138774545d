"""Quality rules: a table of thresholds compiled into one projection, evaluated by Spark's own functions only.

Defined results: a null or blank text has no words, zero counts and fails; rows are judged one by one, so repeated
rows and ties change nothing; an empty table gives an empty result; columns besides the id and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.text import keep_columns, text_of, words_of

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is it that for on with as was are be by this from or an at not "
    "der die das und ist von mit den dem ein eine zu im in auf für sich des nicht auch als "
    "le la les de des du et un une est que qui dans pour par sur pas au avec en "
    "el los las del y se un una por con para su al lo como más que en es"
).split()

#: As they stand in a text and at the start of a sentence.
STOP_FORMS = tuple(dict.fromkeys([*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]))

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document is kept if low <= metric <= high; an open side is None. SQL is over the columns of `measures`."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        value = F.expr(self.metric)
        tests = [value >= self.low] * (self.low is not None) + [value <= self.high] * (self.high is not None)
        passed = tests[0] if len(tests) == 1 else tests[0] & tests[1]
        return F.coalesce(passed, F.lit(False))


#: The production thresholds.
RULES = (
    Rule("mean_word_length", "word_chars / nullif(n_words, 0)", 2.0, 25.0),
    Rule("symbols_to_words", "n_symbols / nullif(n_words, 0)", None, 0.25),
    Rule("shouting_to_words", "n_bangs / nullif(n_words, 0)", None, 0.3),
    Rule("capitals_to_letters", "n_capitals / nullif(word_chars, 0)", None, 0.4),
    Rule("stop_words_to_words", "n_stop_words / nullif(n_words, 0)", 0.01, None),
    Rule("repeated_lines_to_lines", "n_dup_lines / nullif(n_lines, 0)", None, 0.5),
)

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def once(frame: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once a row. A one-row generator stands between, which Catalyst doesn't merge
    with later projections; else a split text would be split again for each use inside a lambda function."""
    made = F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()])))
    return frame.select("*", made)


#: Bits of a window's start in its sort key; the other bits are of its hash.
START_BITS = 24


def window_keys(words: Column) -> Column:
    """One long for each 3-word window, hash bits above start bits: longs sort many times faster than structs."""
    key = lambda i: F.shiftleft(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), START_BITS).bitwiseOR(i.cast("bigint"))
    return F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(words) - 3), key))


def same_window(words: Column, i: Column, j: Column) -> Column:
    return (F.get(words, i) == F.get(words, j)) & (F.get(words, i + 1) == F.get(words, j + 1)) & (F.get(words, i + 2) == F.get(words, j + 2))


def starts_by_words(words: Column) -> Column:
    """Starts of repeated windows from a sort by the words themselves: the exact way for texts whose hashes collide."""
    window = lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i"))
    ordered = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), window))
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    none = F.slice(ordered, 1, 0)
    linked = F.aggregate(
        ordered,
        F.struct(none.alias("found"), F.lit(None).cast("struct<a:string,b:string,c:string,i:int>").alias("last")),
        lambda s, w: F.struct(F.when(F.coalesce(same(s["last"], w), F.lit(False)), F.concat(s["found"], F.array(s["last"], w))).otherwise(s["found"]).alias("found"), w.alias("last")),
        lambda s: s["found"],
    )
    return F.array_distinct(F.transform(linked, lambda w: w["i"]))


def measures(documents: DataFrame, text: str = "text") -> DataFrame:
    """The frame with n_words and the counts that rules refer to; counts are bigint.

    Words covered by repeated windows: windows are sorted by hash within their row, equal neighbours are repeated. If
    neighbours with equal hash bits differ in words, or starts don't fit their bits, the row is sorted by words.
    """
    body = text_of(text)
    frame = once(documents, _text=body, _words=words_of(body), _lines=F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    frame = once(frame, _keys=F.sort_array(window_keys(F.col("_words"))))
    start = lambda key: key.bitwiseAND(F.lit((1 << START_BITS) - 1)).cast("int")
    alike = lambda x, y: F.coalesce(F.shiftrightunsigned(x.bitwiseXOR(y), START_BITS) == 0, F.lit(False))
    frame = once(frame, _found=F.filter("_keys", lambda x, k: F.when(k > 0, alike(x, F.get("_keys", k - 1))).otherwise(F.lit(False)) | alike(x, F.get("_keys", k + 1))))
    pairs_differ = F.exists(F.sequence(F.lit(1), F.size("_found") - 1), lambda k: alike(F.get("_found", k - 1), F.get("_found", k)) & ~same_window(F.col("_words"), start(F.get("_found", k - 1)), start(F.get("_found", k))))
    collided = F.when(F.size("_found") < 2, F.lit(False)).otherwise(pairs_differ) | (F.size("_words") >= (1 << START_BITS))
    starts = F.when(collided, starts_by_words(F.col("_words"))).otherwise(F.transform("_found", start))
    frame = once(frame, _starts=F.sort_array(starts))
    gaps = F.transform("_starts", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("_starts", k + 1) - x, F.lit(3))))
    count = lambda pattern: F.regexp_count("_text", F.lit(pattern)).cast("bigint")
    return frame.select(
        *documents.columns,
        F.size("_words").cast("bigint").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("bigint"), lambda n, w: n + F.length(w)).alias("word_chars"),
        count(f"[{SYMBOLS}]").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.aggregate(gaps, F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        count("!").alias("n_bangs"),
        count(r"\p{Lu}").alias("n_capitals"),
        F.size(F.filter("_words", lambda w: w.isin(*STOP_FORMS))).cast("bigint").alias("n_stop_words"),
    )


def apply_rules(documents: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The frame with its measures, base_failed, failed_rules (names in table order) and kept."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(~rule.passes(), F.lit(rule.name)) for rule in rules]), lambda x: x.isNotNull())
    return measures(documents, text).withColumns({"base_failed": base, "failed_rules": failed}).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def rule_verdicts(documents: DataFrame) -> DataFrame:
    """Digest columns of the rules over documents (doc_id, text)."""
    judged = apply_rules(keep_columns(documents, "doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def rules_sql(table: str = "documents") -> str:
    """The same verdicts in DuckDB's SQL."""
    stop = ", ".join(f"'{w}'" for w in STOP_FORMS)
    tests = {}
    for rule in RULES:
        sides = [f"({rule.metric}) >= {rule.low}"] * (rule.low is not None) + [f"({rule.metric}) <= {rule.high}"] * (rule.high is not None)
        tests[rule.name] = f"coalesce({' AND '.join(sides)}, false)"
    failed = ", ".join(f"CASE WHEN NOT {test} THEN '{name}' END" for name, test in tests.items())
    return rf"""
WITH split_up AS (
  SELECT doc_id, coalesce(text, '') AS body,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM {table}
), keyed AS (SELECT row_number() OVER () AS rid, * FROM split_up),
starts AS (
  SELECT rid, unnest(range(1, len(words) - 1)) AS i FROM keyed WHERE len(words) >= 3
), windows AS (
  SELECT s.rid, s.i, k.words[s.i] AS a, k.words[s.i + 1] AS b, k.words[s.i + 2] AS c FROM starts s JOIN keyed k USING (rid)
), repeated AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT rid, sum(least(3, coalesce(j - i, 3)))::BIGINT AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS j FROM repeated) GROUP BY rid
), measured AS (
  SELECT k.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
         length(regexp_replace(body, '[^!]+', '', 'g'))::BIGINT AS n_bangs,
         length(regexp_replace(body, '[^\p{{Lu}}]+', '', 'g'))::BIGINT AS n_capitals,
         len(list_filter(words, lambda w: w IN ({stop})))::BIGINT AS n_stop_words
  FROM keyed k LEFT JOIN covered c USING (rid)
), judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
         list_filter([{failed}], lambda x: x IS NOT NULL) AS failed_list
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND len(failed_list) = 0 AS kept, array_to_string(failed_list, ',') AS failed_rules
FROM judged
"""
