"""Nested registry records as flat studies, by struct access only.

Defined results: a record whose identifier isn't NCT and eight digits is left out; missing parts give empty text, null
numbers and empty lists; of the analyses of primary outcomes the first comparative one with a known scale and a number
counts, else the first comparative one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = """protocolSection struct<identificationModule:struct<nctId:string,briefTitle:string,officialTitle:string>,
statusModule:struct<overallStatus:string,whyStopped:string,primaryCompletionDateStruct:struct<date:string>>,
descriptionModule:struct<briefSummary:string,detailedDescription:string>,conditionsModule:struct<conditions:array<string>>,
designModule:struct<studyType:string,designInfo:struct<interventionModel:string>,enrollmentInfo:struct<count:string,type:string>>,
armsInterventionsModule:struct<armGroups:array<struct<label:string,type:string>>,interventions:array<struct<name:string>>>,
outcomesModule:struct<primaryOutcomes:array<struct<measure:string>>>,referencesModule:struct<references:array<struct<pmid:string,type:string>>>>,
resultsSection struct<outcomeMeasuresModule:struct<outcomeMeasures:array<struct<title:string,type:string,
analyses:array<struct<groupIds:array<string>,paramType:string,paramValue:string,ciLowerLimit:string,ciUpperLimit:string,ciPctValue:string,pValue:string>>>>>>,
hasResults boolean"""
#: Arms that are a control, and names of scales without spaces and signs.
CONTROLS = ("PLACEBO_COMPARATOR", "ACTIVE_COMPARATOR", "SHAM_COMPARATOR", "NO_INTERVENTION")
SCALES = {
    "hazardratio": "HR", "hazardratiohr": "HR", "hr": "HR", "oddsratio": "OR", "oddsratioor": "OR", "or": "OR", "riskratio": "RR", "relativerisk": "RR",
    "riskratiorr": "RR", "rr": "RR", "standardizedmeandifference": "SMD", "standardisedmeandifference": "SMD", "cohensd": "SMD", "hedgesg": "SMD", "smd": "SMD",
    "meandifference": "MD", "differenceofmeans": "MD", "differenceinmeans": "MD", "meandifferencenet": "MD", "md": "MD", "riskdifference": "RD", "differenceinproportions": "RD",
}


SIGNS = ("<", ">", "=", "≤", "≥")


def number(c: Column) -> Column:
    value = F.translate(F.trim(c), "−,", "-").try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def scale(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair])[F.regexp_replace(F.lower(c), "[^a-z0-9]", "")]


def p_value(c: Column) -> tuple[Column, Column]:
    """Value and operator; null unless the value lies within 0 and 1."""
    text = F.translate(F.replace(F.replace(F.trim(c), F.lit("<="), F.lit("≤")), F.lit(">="), F.lit("≥")), " ", "")
    signed = F.left(text, F.lit(1)).isin(*SIGNS)
    sign = F.when(signed, F.left(text, F.lit(1))).otherwise("")
    value = F.when(signed, F.substr(text, F.lit(2))).otherwise(text).try_cast("double")
    fine = (value >= 0) & (value <= 1)
    return F.when(fine, value), F.when(fine, F.when(sign == "", "=").when(sign == "≤", "<=").when(sign == "≥", ">=").otherwise(sign))


def completed(c: Column) -> Column:
    """The last possible day of a partial date."""
    part = F.split(c, "-")
    year = F.get(part, F.lit(0))
    text = F.when(F.size(part) >= 3, c).when(F.size(part) == 2, F.concat(c, F.lit("-01"))).otherwise(F.concat(year, F.lit("-12-31")))
    day = text.try_cast("date")
    return F.when(F.size(part) == 2, F.last_day(day)).otherwise(day)


def joined(items: Column, name: str | None = None) -> Column:
    texts = F.transform(items, lambda x: F.coalesce(x[name] if name else x, F.lit("")))
    return F.coalesce(F.array_join(texts, "; "), F.lit(""))


def flat_analyses(outcomes: Column) -> Column:
    """Analyses of the primary outcomes in order."""

    def row(outcome: Column, at: Column):  # noqa: ANN202
        def one(a: Column, k: Column) -> Column:
            value, sign = p_value(a["pValue"])
            level = number(a["ciPctValue"])
            return F.struct(
                F.coalesce(outcome["title"], F.lit("")).alias("outcome"), at.alias("outcome_index"), k.alias("analysis_index"), scale(a["paramType"]).alias("effect_type"), number(a["paramValue"]).alias("estimate"),
                number(a["ciLowerLimit"]).alias("ci_low"), number(a["ciUpperLimit"]).alias("ci_high"), F.when((level > 0) & (level < 100), level / 100).alias("ci_level"),
                value.alias("p_value"), sign.alias("p_value_operator"), (F.coalesce(F.size(F.array_distinct(a["groupIds"])), F.lit(0)) >= 2).alias("comparative"),
            )

        return F.transform(outcome["analyses"], one)

    each = F.transform(outcomes, lambda o, i: F.when((o["type"] == "PRIMARY") & o["analyses"].isNotNull(), row(o, i)))
    return F.flatten(F.filter(each, lambda x: x.isNotNull()))


def flat(records: DataFrame, record: str = "record") -> DataFrame:
    """One study a valid record: identity, status, arms, sizes, references and the analysis that counts."""
    protocol, r = F.col(f"{record}.protocolSection"), F.col(record)
    ident, status, design, arms = protocol["identificationModule"], protocol["statusModule"], protocol["designModule"], protocol["armsInterventionsModule"]
    nct, done, count = F.upper(ident["nctId"]), completed(status["primaryCompletionDateStruct"]["date"]), number(design["enrollmentInfo"]["count"])
    whole = F.when(count == F.floor(count), count.cast("bigint"))
    kind = design["enrollmentInfo"]["type"]
    results = F.filter(protocol["referencesModule"]["references"], lambda x: x["type"] == "RESULT")
    pmids = F.transform(results, lambda x: F.regexp_extract(F.trim(x["pmid"]), r"^(?:https?://(?:www\.)?(?:pubmed\.ncbi\.nlm\.nih\.gov/|ncbi\.nlm\.nih\.gov/pubmed/))?(\d+)/?$", 1))
    pmids = F.coalesce(F.array_sort(F.array_distinct(F.filter(pmids, lambda x: x != ""))), F.array().cast("array<string>"))
    groups = F.coalesce(arms["armGroups"], F.array().cast("array<struct<label:string,type:string>>"))
    controls = F.filter(groups, lambda a: a["type"].isin(*CONTROLS))
    single = F.coalesce(design["designInfo"]["interventionModel"] == "SINGLE_GROUP", F.lit(False)) | ((F.size(groups) == 1) & F.coalesce(design["studyType"] == "INTERVENTIONAL", F.lit(False)))
    found = F.coalesce(flat_analyses(r["resultsSection"]["outcomeMeasuresModule"]["outcomeMeasures"]), F.array())
    compared = lambda a: a["comparative"]
    usable = lambda a: a["comparative"] & a["effect_type"].isNotNull() & F.coalesce(a["estimate"], a["ci_low"], a["p_value"]).isNotNull()
    base = records.where(nct.rlike("^NCT[0-9]{8}$")).withColumn("_found", found)
    chosen = base.withColumn("_best", F.coalesce(F.get(F.filter("_found", usable), F.lit(0)), F.get(F.filter("_found", compared), F.lit(0))))
    best = F.col("_best")
    filled = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))
    source = F.concat(F.lit("resultsSection.outcomeMeasuresModule.outcomeMeasures["), best["outcome_index"], F.lit("].analyses["), best["analysis_index"], F.lit("]"))
    return chosen.select(
        nct.alias("id"), F.coalesce(F.nullif(ident["briefTitle"], F.lit("")), F.nullif(ident["officialTitle"], F.lit("")), nct).alias("title"), filled(protocol["descriptionModule"]["briefSummary"], protocol["descriptionModule"]["detailedDescription"]).alias("abstract"),
        joined(protocol["conditionsModule"]["conditions"]).alias("population"), joined(arms["interventions"], "name").alias("intervention"), joined(controls, "label").alias("comparator"),
        F.coalesce(best["outcome"], joined(protocol["outcomesModule"]["primaryOutcomes"], "measure")).alias("outcome"), status["overallStatus"].alias("overall_status"), done.alias("primary_completion_date"), F.year(done).alias("year"),
        F.when(kind == "ACTUAL", whole).alias("enrollment_actual"), F.when(kind == "ESTIMATED", whole).alias("enrollment_planned"),
        F.when(best.isNotNull(), True).when(single, False).when(F.size(controls) > 0, True).alias("has_control"), pmids.alias("result_pmids"), (F.size(pmids) > 0).alias("has_linked_publication"), r["hasResults"].alias("has_results"),
        F.size("_found").alias("n_analyses"), *[best[c].alias(c) for c in ("effect_type", "estimate", "ci_low", "ci_high", "ci_level", "p_value", "p_value_operator")], source.alias("numeric_source"),
    )
