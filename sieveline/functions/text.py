"""Scalar functions over strings, dates and arrays as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(c: Column) -> Column:
    """Lower case, white space collapsed, null as empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def title_key(c: Column) -> Column:
    """Letters and digits, other runs as one space, for comparing titles."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def sentences(c: Column) -> Column:
    """Pieces that end before white space and a capital, after a full stop, exclamation or question mark."""
    return F.split(F.trim(F.coalesce(c, F.lit(""))), r"(?<=[.!?])\s+(?=[A-Z])")


def weak_label(text: Column, null_words: str, positive_words: str, negated: str) -> tuple[Column, Column]:
    """Label and deciding sentence by lexicons given as patterns: null, positive (after negated clauses are taken out),
    both mixed, neither none; the last matching sentence."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    is_null = lower.rlike(null_words)
    is_positive = F.regexp_replace(lower, negated, " ").rlike(positive_words)
    label = F.when(is_null & is_positive, "mixed").when(is_null, "null").when(is_positive, "positive").otherwise("none")
    hits = F.filter(sentences(text), lambda s: F.lower(s).rlike(f"{null_words}|{positive_words}"))
    return label, F.try_element_at(hits, F.lit(-1))


def shortened(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 1), F.lit("…"))).otherwise(c)


def strip_markup(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4).cast("int"))


# Names of effect scales after case and separators are dropped.
SCALES = {
    "SMD": ("SMD", "HEDGESG", "COHENSD", "STANDARDIZEDMEANDIFFERENCE", "STANDARDISEDMEANDIFFERENCE"),
    "MD": ("MD", "MEANDIFFERENCE", "WMD", "WEIGHTEDMEANDIFFERENCE"),
    "logOR": ("LOGOR", "OR", "ODDSRATIO", "LOGODDSRATIO"),
    "logRR": ("LOGRR", "RR", "RISKRATIO", "RELATIVERISK", "LOGRISKRATIO"),
    "logHR": ("LOGHR", "HR", "HAZARDRATIO", "LOGHAZARDRATIO"),
}


def effect_scale(c: Column) -> Column:
    """The canonical scale of a name, by table, then by what the name contains."""
    key = F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s_()-]", ""))
    out = F.lit(None).cast("string")
    contained = (("HAZARD", "logHR"), ("ODDS", "logOR"), ("RISKRATIO", "logRR"), ("RELATIVERISK", "logRR"), ("STANDARDI", "SMD"), ("MEANDIFFERENCE", "MD"))
    for part, scale in reversed(contained):
        out = F.when(key.contains(part), scale).otherwise(out)
    for scale, names in SCALES.items():
        out = F.when(key.isin(*names), scale).otherwise(out)
    return out


def parse_p_value(c: Column) -> tuple[Column, Column]:
    """Operator (<, >, =) and value of a written p-value; both null unless the value lies in 0..1."""
    pattern = r"([<>=≤≥]?)\s*=?\s*([0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"
    value = F.expr("try_cast(null as double)") if c is None else F.regexp_extract(c, pattern, 2).try_cast("double")
    sign = F.regexp_extract(c, pattern, 1)
    operator = F.when(sign.isin("<", "≤"), "<").when(sign.isin(">", "≥"), ">").otherwise("=")
    valid = value.between(0, 1)
    return F.when(valid, operator), F.when(valid, value)


def latest_day(c: Column) -> Column:
    """The last day that a partial date (year, year and month, full) can mean; null if it is none."""
    year = F.substring(c, 1, 4)
    return (
        F.when(c.rlike(r"^\d{4}$"), F.to_date(F.concat(year, F.lit("-12-31"))))
        .when(c.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.last_day(F.to_date(F.concat(c, F.lit("-01")))))
        .when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"))
    )


def overdue(completed: Column, today: Column) -> Column:
    """More than a year has passed; a 29th of February counts as the 28th. False for no date and for year 9999."""
    return F.coalesce((F.year(completed) < 9999) & (F.add_months(completed, 12) < today), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def usable_vector(a: Column, size: int) -> Column:
    """Not null, of this size, finite, not all zero."""
    fine = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(a) == size) & fine & F.exists(a, lambda x: x != 0), F.lit(False))
