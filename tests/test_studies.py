"""Studies, communities, frames, prior work, mined statistics and registry records on small cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sieveline.functions import mined, registry
from sieveline.functions.special import t_ppf, t_upper
from sieveline.operators import communities as C
from sieveline.queries import studies as queries
from sieveline.operators import novelty as N
from sieveline.operators import studies as S
from sieveline.queries import studies as queries
from sieveline.sources import tables as T
from sieveline.streaming import frames as R

SIX = [
    {"study_id": "S1", "effect": 0.04, "se": 0.08},
    {"study_id": "S2", "effect": -0.02, "se": 0.09},
    {"study_id": "S3", "p_value": 0.18, "p_operator": "=", "test_type": "two_sample_t", "direction": 1, "n1": 40, "n2": 40},
    {"study_id": "S4", "qualitative_label": "null_underpowered"},
    {"study_id": "S5", "methodologically_failed": True},
    {"study_id": "S6", "completed_unreported": True},
]


def study_frame(spark, rows):
    names = [f.split()[0] for f in S.STUDY_SCHEMA.replace("\n", " ").split(", ")]
    return spark.createDataFrame([tuple({"cluster_id": "A", **r}.get(n) for n in names) for r in rows], S.STUDY_SCHEMA)


def test_many_student_points_equal_single_ones():
    cases = [(p, df) for p in (0.4, 0.05, 0.001, 1e-9) for df in (1, 2.5, 78, 900)]
    found = t_upper([p for p, _ in cases], [df for _, df in cases])
    for (p, df), f in zip(cases, found, strict=True):
        if p > 1e-6:
            assert f == pytest.approx(t_ppf(1 - p, df), rel=1e-6)
    assert t_upper([0.025, 0.975, 0.5, 0.0, 0.1], [math.inf, math.inf, 3, 3, 0])[:3] == pytest.approx([1.959963984540054, -1.959963984540054, 0.0])
    assert t_upper([0.01], [9_999])[0] == pytest.approx(t_upper([0.01], [10_001])[0], rel=1e-6)


def test_six_studies(spark):
    tiers = S.tiered(study_frame(spark, SIX))
    rows = {r["study_id"]: r for r in tiers.collect()}
    assert [rows[f"S{k}"]["tier"] for k in range(1, 7)] == ["full_quant", "full_quant", "p_reconstructed", "qualitative", "methodologically_failed", "completed_unreported"]
    assert [rows[f"S{k}"]["finding"] for k in range(1, 5)] == ["clinically_equivalent", "clinically_equivalent", "inconclusive", "inconclusive"]
    assert rows["S3"]["analysis_effect"] == pytest.approx(0.29959678917911076) and rows["S3"]["variance"] == pytest.approx(0.04961539564052168)
    same = tiers.withColumns({"measure": F.lit("hedges_g"), "scale_id": F.lit("s")})
    runs = {r["run"]: r for r in S.analyses(same).collect()}
    first, third = runs["primary"], runs["with_p_reconstruction"]
    assert (first["status"], first["n_eligible"], round(first["score"], 1), round(first["mean"], 6)) == ("uncertain", 2, 72.2, 0.013517)
    assert (third["status"], third["n_eligible"], round(third["score"], 1), round(third["mean"], 6)) == ("uncertain", 3, 77.1, 0.032746)
    differing = {r["run"]: r["status"] for r in S.analyses(tiers).collect()}
    assert differing["primary"] == "uncertain" and differing["with_p_reconstruction"] == "not_poolable"


def test_faults_and_tests(spark):
    base = {"p_value": 0.04, "direction": -1, "n1": 30, "n2": 30}
    rows = [{**base, "study_id": t, "test_type": t} for t in S.MEASURES]
    rows += [{**base, "study_id": n, "test_type": "paired_t", **more} for n, more in {"censored": {"p_operator": "<"}, "zero": {"p_value": 0.0}, "nodir": {"direction": None}, "small": {"n1": 1}, "none": {"n1": None}, "one": {"p_value": 1.0, "two_sided": False}, "flat": {"p_value": 1.0}, "odd": {"test_type": "z"}}.items()]
    found = {r["study_id"]: r for r in S.tiered(study_frame(spark, rows)).collect()}
    t58, t29, t28, z = t_ppf(0.98, 58), t_ppf(0.98, 29), t_ppf(0.98, 28), 2.0537489106318225
    j = 1 - 3 / (4 * 58 - 1)
    assert found["two_sample_t"]["analysis_effect"] == pytest.approx(-j * t58 * math.sqrt(2 / 30))
    assert found["paired_t"]["analysis_effect"] == pytest.approx(-t29 / math.sqrt(30)) == found["one_sample_t"]["analysis_effect"]
    assert found["correlation_t"]["analysis_effect"] == pytest.approx(-math.atanh(t28 / math.sqrt(t28**2 + 28)))
    assert found["chi_square_1df"]["analysis_effect"] == pytest.approx(-z / math.sqrt(30))
    assert {n: found[n]["rebuild_fault"] for n in ("censored", "zero", "nodir", "small", "none", "one", "odd")} == {"censored": "p_operator", "zero": "p_value", "nodir": "direction", "small": "df", "none": "n", "one": "p_value", "odd": "test_type"}
    assert found["flat"]["analysis_effect"] == 0 and S.analyses(S.tiered(study_frame(spark, []))).count() == 0


@pytest.mark.parametrize("bound", [10_000, 0])
def test_communities_equal_a_plain_version(spark, bound):
    draw = random.Random(7)
    links = [(draw.randrange(14), draw.randrange(14), round(draw.random(), 3)) for _ in range(40)] + [(20, 21, 0.5), (21, 22, 0.5), (30, 30, 1.0), (31, None, 1.0), (20, 22, float("nan"))]
    around = {}
    for a, b, w in links:
        if b is not None and a != b and w == w:
            around.setdefault(a, []).append((b, w))
            around.setdefault(b, []).append((a, w))
    label = {n: n for n in around}
    for _ in range(12):
        before = dict(label)
        for n in sorted(around):
            weight = {}
            for o, w in around[n]:
                weight[label[o]] = weight.get(label[o], 0) + round(w * 1e9)
            label[n] = min(weight, key=lambda x: (-weight[x], x))
        if label == before:
            break
    lowest = {}
    for n in sorted(label):
        lowest.setdefault(label[n], n)
    frame = spark.createDataFrame(links, "src bigint, dst bigint, cosine double")
    assert {r["node"]: r["community"] for r in C.communities(frame, group_edges=bound).collect()} == {n: lowest[x] for n, x in label.items()}
    assert C.communities(frame.where("false"), group_edges=bound).count() == 0


def test_frames(spark):
    points = spark.createDataFrame([(1, 0, "a", 9), (1, 1, "b", 9), (2, 0, "c", 9), (None, 0, "x", 9)], "frame int, pos bigint, id string, region int")
    regions = spark.createDataFrame([(1, 0, 5), (1, 2, 5), (3, 0, 6), (2, 2, None), (2, 9, 1)], "frame int, place bigint, region int")
    assert {(r["place"], r["id"], r["region"]) for r in R.folded_points(points, regions).collect()} == {(0, "a", 6), (1, "b", 9), (2, "c", None)}
    state = R.folded_state(spark.createDataFrame([(1, "s", "p"), (2, "t", None)], "frame int, stage string, placement string")).first()
    assert (state["stage"], state["placement"]) == ("t", "p")


def test_prior_work(spark):
    works = spark.createDataFrame([(1, 0.9, False), (2, 0.8, False), (3, 0.7, True), (4, 0.95, False), (None, 1.0, False), (5, 0.2, False)], "id int, s double, gone boolean")
    first = N.candidates(works.where("id IN (1, 2, 3) OR id IS NULL"), F.col("s"), "retrieved", "id", "gone")
    cited = spark.createDataFrame([(1, 0, 4), (1, 1, 2), (2, 0, 5), (2, 1, None), (2, 2, 4)], "id int, place int, ref int")
    found = N.scanned(works, first, cited, F.col("s"), 10, "id", "gone")
    assert [(r["id"], r["relation"]) for r in found.collect()] == [(4, "reference"), (1, "retrieved"), (2, "retrieved"), (5, "reference")]
    assert [r["id"] for r in N.to_read(found, F.col("id") == 1, 10).collect()] == [4, 2]
    assert [r["ref"] for r in N.followed(first, cited, seeds=1).collect()] == [4]


def test_mined_statistics(spark):
    text = "Adjusted odds ratio 1.20 (95% CI: 1.60–0.95; P=.03). Effects were non-significant (p ≥ 0.2), rho(12) = −.4, r = 3; n=1,204; d = 12%; p < 1.5 × 10^-4."
    row = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(mined.p_values(F.col("t")).alias("p"), mined.intervals(F.col("t")).alias("i"), mined.effects(F.col("t")).alias("e"), mined.correlations(F.col("t")).alias("r"), mined.sample_sizes(F.col("t")).alias("n"), mined.bare_intervals(F.lit("1.2 (0.9-1.6)")).alias("b")).collect()
    assert [(p["operator"], p["value"]) for p in row[0]["p"]] == [("=", 0.03), ("≥", 0.2), ("<", 1.5e-4)]
    assert [tuple(i) for i in row[0]["i"]] == [(95.0, 0.95, 1.6)] and [tuple(i) for i in row[0]["b"]] == [(None, 0.9, 1.6)]
    assert row[0]["e"][0]["kind"] == "OR" and row[0]["e"][0]["value"] == 1.2 and row[0]["n"] == [1204.0]
    assert all(not row[k][c] for k in (1, 2) for c in "pier")


def test_registry_edges(spark):
    good = '{"protocolSection": {"identificationModule": {"nctId": "nct00000001"}, "statusModule": {"primaryCompletionDateStruct": {"date": "2019-02"}}, "armsInterventionsModule": {"armGroups": [{"label": "P", "type": "PLACEBO_COMPARATOR"}, {"label": "E", "type": "EXPERIMENTAL"}]}}}'
    rows = spark.createDataFrame([(good,), ('{"protocolSection": {"identificationModule": {"nctId": "x"}}}',), ("{}",), (None,)], "j string")
    found = registry.flat(rows.select(F.from_json("j", registry.SCHEMA).alias("record"))).collect()
    assert len(found) == 1
    r = found[0]
    assert (r["id"], r["title"], str(r["primary_completion_date"]), r["comparator"], r["has_control"], r["n_analyses"], r["result_pmids"]) == ("NCT00000001", "NCT00000001", "2019-02-28", "P", True, 0, [])
    p = spark.createDataFrame([("<= 0.05",), ("0.5",), ("1.5",), ("p",), (None,)], "p string").select(*[c.alias(n) for c, n in zip(registry.p_value(F.col("p")), "vo", strict=True)]).collect()
    assert [tuple(x) for x in p] == [(0.05, "<="), (0.5, "="), (None, None), (None, None), (None, None)]


def test_csv(spark, tmp_path):
    T.write_csv(spark.createDataFrame([(1, 'a "q", b\nc', None), (2, None, 0.5)], "a int, b string, c double"), str(tmp_path / "out"))
    found = T.csv_rows(spark, str(tmp_path / "out"), "c double, a bigint, b string, z int").orderBy("a").collect()
    assert [tuple(r) for r in found] == [(None, 1, 'a "q", b\nc', None), (0.5, 2, None, None)]


def test_one_row_group_is_mined_by_all_cores(spark):
    """A file of one row group is one split; reading its sentences is too slow for one task."""
    found = queries.QUERIES["stat_mining"](spark, "/root/testdata/sf0.001")
    assert spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").rdd.getNumPartitions() == 1
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
