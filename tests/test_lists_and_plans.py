"""Lists, plans, mined findings and ranks against plain versions, with nulls, ties and empty tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sieveline.functions import bibliography, mined
from sieveline.functions.special import NORMAL, beta_cdf
from sieveline.operators import graph
from sieveline.operators import lists as L
from sieveline.operators import planning as P
from sieveline.operators import scope as S


def test_ranks_equal_a_plain_version(spark):
    rng = random.Random(3)
    nodes, links = list(range(12)), [(rng.randrange(12), rng.randrange(14)) for _ in range(30)] + [(1, 1), (0, 5), (0, 5)]
    known = {(a, b) for a, b in links if a != b and b < 12}
    out = {n: [b for a, b in known if a == n] for n in nodes}
    rank = dict.fromkeys(nodes, 1 / 12)
    for _ in range(10):
        lost = sum(rank[n] for n in nodes if not out[n])
        rank = {n: 0.15 / 12 + 0.85 * (sum(rank[m] / len(out[m]) for m in nodes if n in out[m]) + lost / 12) for n in nodes}
    frame = spark.createDataFrame([(n,) for n in nodes], "id bigint")
    found = graph.pagerank(frame, spark.createDataFrame(links, "src bigint, dst bigint"), iterations=10).collect()
    assert {r["id"]: r["rank"] for r in found} == pytest.approx(rank)
    assert graph.pagerank(frame.limit(0), spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_findings_take_the_nearest(spark):
    text = "The odds ratio was 1.05 (95% CI 0.88 to 1.26; p = 0.62). SMD = 0.45 [0.70, 0.20], p < .001. r = 0.08, p=0.30, n = 240."
    frame = spark.createDataFrame([(text,), (None,), ("",), ("p > 0.4 alone (0.5 to 3.7)",)], "t string").withColumn("f", mined.findings(F.col("t")))
    rows = frame.select("t", F.explode_outer("f").alias("f")).withColumn("c", mined.classified(F.col("f"), F.lit(False), F.lit(None).cast("boolean"))).collect()
    seen = [(r["f"]["kind"], r["f"]["estimate"], r["f"]["correlation"], r["f"]["low"], r["f"]["high"], r["f"]["operator"], r["f"]["p"], r["c"]["label"]) for r in rows if r["f"]]
    assert seen == [("OR", 1.05, None, 0.88, 1.26, "=", 0.62, "null"), ("SMD", 0.45, None, 0.2, 0.7, "<", 0.001, "positive"), (None, None, 0.08, None, None, "=", 0.3, "null"), (None, None, None, 0.5, 3.7, ">", 0.4, "null")]
    assert rows[0]["f"]["n"] == 240 and rows[0]["f"]["start"] == 4


@pytest.mark.parametrize("text,value", [("n = 1,204", 1204.0), ("N=12", 12.0), ("N = 3.5", None), ("mean=3", None)])
def test_sizes(text, value):
    assert [x["value"] for x in mined.read_all(text)["sizes"]] == ([value] if value else [])


@pytest.mark.parametrize("text,value", [("p = 1e-4", 1e-4), ("P-value ≤ .05", 0.05), ("p<1.5 × 10^−4", 1.5e-4), ("p values >= 0.5", 0.5), ("p = 1e400", 1.0), ("step = 0.5", None), ("p 0.5", None)])
def test_p_values(text, value):
    assert [x["value"] for x in mined.read_all(text)["p"]] == ([value] if value else [])


def test_long_inverted_text(spark):
    import json

    index = {f"w{k}": [k, k + 6000] for k in range(6000)} | {"a": [0, -1]}
    text = spark.createDataFrame([(json.dumps(index),), (None,), ("{",)], "i string").select(bibliography.text_of_index(F.col("i")).alias("t")).collect()
    assert text[0]["t"] == " ".join(["a", *(f"w{k}" for k in range(1, 6000)), *(f"w{k}" for k in range(6000))]) and text[1]["t"] is None and text[2]["t"] is None


def test_required_sizes():
    def enough(e, v, n):
        cut, sd = NORMAL.inv_cdf(0.975) * math.sqrt(4 / n), math.sqrt(v + 4 / n)
        return NORMAL.cdf((-cut - e) / sd) + NORMAL.cdf((e - cut) / sd) >= 0.8

    for estimate, spread in ((0.5, 0.001), (1.2, 0.01), (-0.4, 0.0)):
        n = P.smallest_n(estimate, spread, 4.0)
        assert n % 2 == 0 and enough(estimate, spread, n) and not any(enough(estimate, spread, k) for k in range(4, n, 2))
    assert P.smallest_n(0.0, 1e-9, 4.0) is None


def test_leans_and_decisions(spark):
    rows = [("a", "effect", "numeric"), ("a", "effect", "reconstructed"), ("a", "failed", None), ("b", "credible_null", "derived"), ("b", "effect", "numeric"), ("b", "reported_null", "text_only"), ("b", "effect", "numeric"), ("c", "inconclusive", None)]
    sums = P.record_sums(spark.createDataFrame(rows, "g string, bucket string, tier string"), ["g"])
    found = {r["g"]: r for r in P.decided(P.leaning(sums), F.when(F.col("g") != "c", 0.1), F.lit(0.3)).collect()}
    assert (found["a"]["successes"], found["a"]["uninformative"], found["c"]["state"], found["b"]["state"]) == (1.75, 1, "unknown", "contested")
    below = beta_cdf(0.5, 2.75, 1.0)
    assert found["a"]["p_open"] == pytest.approx(2 * min(below, 1 - below)) and found["a"]["power"] == pytest.approx(1 - NORMAL.cdf(NORMAL.inv_cdf(0.975) - 3) + NORMAL.cdf(-NORMAL.inv_cdf(0.975) - 3))
    assert found["c"]["power"] is None and (found["c"]["recommendation"], found["b"]["recommendation"]) == ("pursue", "pursue_with_changes")


def test_batches_and_empty_tables(spark):
    ids = random.Random(1).sample(range(10_000), 203)
    frame = spark.createDataFrame([(i,) for i in ids], "id bigint")
    found = {r["id"]: (r["batch"], r["slot"]) for r in L.batches(frame, "id", 40, parts=7).collect()}
    assert found == {i: divmod(k, 40) for k, i in enumerate(sorted(ids))}
    assert L.batches(frame.limit(0), "id", 40).count() == 0 and L.year_axis(spark.createDataFrame([], "year int, n bigint")).count() == 0
    assert L.spin_rate(frame.limit(0), F.lit(True), F.lit(True), F.lit(True)).first()["rate"] is None


@pytest.mark.parametrize("title,found", [("Systematic reviews of care", True), ("A peer review", False), ("Clinical  guidelines for us", True), ("Our guidelines for us", False), ("META-ANALYSIS", True), (None, False)])
def test_synthesis_titles(spark, title, found):
    assert spark.createDataFrame([(title,)], "t string").select(L.is_synthesis(F.col("t"))).first()[0] is found


def test_population_aliases():
    primary = ["knee", "osteoarthritis"]
    aliases = [["gonarthrosis"], ["knee", "disease"], [], ["gonarthrosis"], ["arthrosis"]]
    assert S.reduced_aliases(primary, aliases) == [["gonarthrosis"]]
    assert S.reduced_aliases(primary, [["knee", "osteoarthritis", "pain"], ["osteoarthritis"], ["disease"]]) == []


def test_scope_of_missing_columns(spark):
    works = spark.createDataFrame([(1, "Renal trial", None), (2, None, None)], "id int, title string, pmid string")
    assert [r["id"] for r in works.where(S.coarse(works, ["RENAL"], "title", "abstract")).collect()] == [1]
    assert works.where(S.coarse(works, ["x"], "abstract") | S.is_indexed(works) | S.is_indexed(works.drop("pmid"))).count() == 0
    rows = works.select(S.specific_terms(F.col("title")).alias("t"), S.population_clause(F.col("title"), ["knee", "renal", "trial"]).alias("c"), S.population_clause(F.col("title"), []).alias("all")).collect()
    assert [tuple(r) for r in rows] == [(["renal", "trial"], True, True), ([], False, True)]
