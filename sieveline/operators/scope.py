"""Which works belong to a corpus, and which terms of a population constrain a search.

Defined results: missing columns and nulls never match; term lists keep the order in which terms stand; a null text has no
terms.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of a population that name nobody in particular, sites of the body, and words too broad for a name.
GENERIC = frozenset(
    "adult adults patient patients participant participants people person persons individual individuals population populations subject subjects volunteer volunteers "
    "men women male males female females child children pediatric paediatric adolescent adolescents young younger old older elderly aged age ages aging ageing year years "
    "month months day days healthy general community dwelling communitydwelling post menopausal postmenopausal premenopausal middle middleaged senior seniors who whom have has had "
    "having diagnosed diagnosis confirmed suspected established symptomatic asymptomatic mild moderate severe major minor history risk risks high higher low lower at living suffering "
    "experiencing presenting scheduled elective undergoing eligible enrolled treated untreated baseline underlying previously currently type mellitus chronic acute recent newly stage "
    "stages all any approximately least more less".split()
)
SITES = frozenset(
    "knee knees hip hips elbow elbows shoulder shoulders ankle ankles foot feet wrist wrists hand hands spine spinal lumbar cervical thoracic lung lungs breast prostate kidney kidneys "
    "renal heart cardiac brain colon colorectal rectal liver hepatic skin eye eyes ear ears dental tooth teeth jaw".split()
)
BROAD = frozenset("disease diseases disorder disorders syndrome syndromes condition conditions illness illnesses complication complications health".split())
MOST_ALIASES = 4


def coarse(works: DataFrame, stems: list[str], *columns: str) -> Column:
    """Whether any of the columns that exist holds one of the stems, in any case; one pattern over one text."""
    present = [F.lower(F.col(c).cast("string")) for c in columns if c in works.columns]
    if not present:
        return F.lit(False)
    return F.concat_ws(" ", *present).rlike("|".join(re.escape(s.lower()) for s in stems))


def in_topics(topics: Column, ids: list[str], subfields: list[str]) -> Column:
    """Whether a topic's address ends in one of the ids, or its subfield's in one of the subfields."""
    last = lambda url: F.substring_index(url, "/", -1)
    hit = F.exists(topics, lambda t: F.coalesce(last(t["id"]).isin(*ids), F.lit(False)) | F.coalesce(last(t["subfield"]).isin(*subfields), F.lit(False)))
    return F.coalesce(hit, F.lit(False))


def is_indexed(works: DataFrame, name: str = "pubmed", key: str = "pmid") -> Column:
    """Whether a work has the identifier in its map or its column, or names the index; absent columns say no."""
    tests = []
    if "ids" in works.columns:
        tests.append(F.coalesce(F.length(F.col("ids")[key]) > 0, F.lit(False)))
    if key in works.columns:
        tests.append(F.coalesce(F.length(F.col(key).cast("string")) > 0, F.lit(False)))
    if "indexed_in" in works.columns:
        tests.append(F.coalesce(F.array_contains("indexed_in", name), F.lit(False)))
    return F.greatest(*tests) if len(tests) > 1 else tests[0] if tests else F.lit(False)


def specific_terms(text: Column) -> Column:
    """Distinct words of a population, in order, without generic ones and numbers."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0))
    return F.filter(words, lambda w: ~w.isin(*sorted(GENERIC)) & ~w.rlike(r"^\p{N}+$"))


def population_clause(text: Column, terms: list[str]) -> Column:
    """Whether a text holds any of the terms that are sites, if there are any, and all others; no terms constrain nothing."""
    body = F.lower(F.coalesce(text, F.lit("")))
    sites, others = [t for t in terms if t in SITES], [t for t in terms if t not in SITES]
    clause = F.lit(True)
    for group in ([sites] if sites else []) + [[t] for t in others]:
        clause &= F.coalesce(body.rlike(r"\b(" + "|".join(map(re.escape, group)) + r")\b"), F.lit(False))
    return clause


def reduced_aliases(primary: list[str], aliases: list[list[str]]) -> list[list[str]]:
    """Of the first few aliases, as terms, those that add something: not empty or repeated, not of broad words and sites
    alone, and neither within the primary terms nor around them."""
    kept: list[list[str]] = []
    for terms in aliases[:MOST_ALIASES]:
        telling = set(terms) - BROAD
        if terms and terms not in kept and telling - SITES and not telling <= set(primary) and not set(primary) <= telling:
            kept.append(terms)
    return kept


def screened(works: DataFrame, ids: DataFrame, clause: Column, key: str) -> DataFrame:
    """The works of the ids that pass the clause."""
    return works.join(ids.select(key).distinct(), key, "left_semi").where(F.coalesce(clause, F.lit(False)))


def store_counts(studies: DataFrame, kind: Column, vector: Column) -> DataFrame:
    """One row: studies, those with a vector, and all rows."""
    study = F.coalesce(kind == "study", F.lit(False))
    return studies.agg(F.count_if(study).alias("studies"), F.count_if(study & vector.isNotNull()).alias("embedded"), F.count("*").alias("documents"))
