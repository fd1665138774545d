"""Fitted models against plain versions of them."""

import math
import random

import numpy as np
import pytest

from sieveline.functions.bibliography import text_of_index
from sieveline.operators import redundancy as D
from sieveline.operators import regions as R
from sieveline.operators.graph import connected_components


def loss(log_tau2, y, v):
    w = 1 / (v + math.exp(log_tau2))
    mean = (w * y).sum() / w.sum()
    return -np.log(w).sum() + math.log(w.sum()) + (w * (y - mean) ** 2).sum()


def test_reml_equals_a_fine_search(spark):
    draw = np.random.default_rng(5)
    rows = [("same", 0.1, 0.04), ("same", 0.1, 0.04), ("same", 0.1, 0.05), ("one", 0.2, 0.1), ("bad", None, 0.1), ("bad", 1.0, 0.0)]
    y, v = draw.normal(0.3, 0.5, 12), draw.uniform(0.01, 0.1, 12)
    rows += [("spread", float(a), float(b)) for a, b in zip(y, v)]
    found = {r["g"]: r for r in D.reml(spark.createDataFrame(rows, "g string, estimate double, variance double"), ["g"]).collect()}
    assert set(found) == {"same", "spread"}
    assert found["same"]["tau2"] < 1e-9 and found["same"]["mean"] == pytest.approx(0.1)
    grid = np.linspace(math.log(1e-4), math.log(10), 200_001)
    best = math.exp(min(grid[::50], key=lambda t: loss(t, y, v)))
    fine = math.exp(min(np.linspace(math.log(best) - 0.01, math.log(best) + 0.01, 20_001), key=lambda t: loss(t, y, v)))
    assert found["spread"]["tau2"] == pytest.approx(fine, rel=1e-4)
    w = 1 / (v + fine)
    assert found["spread"]["mean"] == pytest.approx((w * y).sum() / w.sum(), rel=1e-4)
    scored = {r["g"]: r for r in D.redundancy(spark.createDataFrame(list(found.values())), -0.2, 0.2).collect()}
    assert all(abs(r["harm"] + r["clinically_negligible"] + r["benefit"] - 1) < 1e-9 and 0 <= r["resolution"] <= 1 for r in scored.values())


def test_kmeans_finds_clumps_and_pca_equals_numpy(spark):
    draw = np.random.default_rng(2)
    centres = np.eye(3)
    x = np.concatenate([centres[i] + 0.02 * draw.normal(size=(20, 3)) for i in range(3)])
    rows = [(i, [float(a) for a in r]) for i, r in enumerate(x)] + [(100, None), (101, [0.0, 0.0, 0.0]), (102, [float("nan"), 1.0, 1.0]), (103, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    _, assigned = R.kmeans(frame, 3, 3)
    region = {r["vec_id"]: r["region"] for r in assigned.collect()}
    assert set(region) == set(range(60)) and all(len({region[i] for i in range(20 * c, 20 * c + 20)}) == 1 for c in range(3)) and len(set(region.values())) == 3
    mean, axes = R.principal_axes(frame, 3)
    _, expected = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(np.abs(axes), np.abs(expected[:, ::-1][:, :2].T))
    placed = {r["vec_id"]: (r["x"], r["y"]) for r in R.projected(frame, mean, axes).collect()}
    assert np.allclose([placed[i] for i in range(60)], (x - mean) @ axes.T)
    assert R.kmeans(frame.where("false"), 3, 3)[1].count() == 0


def test_index_with_collisions_and_broken_json(spark):
    rows = [('{"b": [1], "a": [1, 0], "c": [-1, 2], "d": null}',), ("{}",), (None,), ("nonsense",)]
    out = [r[0] for r in spark.createDataFrame(rows, "i string").select(text_of_index(F_i())).collect()]
    assert out[0] == "a a c" and not out[1] and out[2] is None and out[3] is None


def F_i():
    from pyspark.sql import functions as F

    return F.col("i")


@pytest.mark.parametrize("task_links", [0, 10**6])
def test_components_in_one_task_and_in_rounds(spark, task_links):
    rng = random.Random(task_links)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(190)] + [(k, k + 1) for k in range(500, 560)] + [(900, 900)]
    frame = spark.createDataFrame([*links, (None, 3)], "src bigint, dst bigint").repartition(5)
    part = {n: n for e in links for n in e}
    for a, b in links:
        low, high = sorted((part[a], part[b]))
        part = {n: low if x == high else x for n, x in part.items()}
    assert {r["node"]: r["component"] for r in connected_components(frame, task_links=task_links).collect()} == part
    assert connected_components(frame.where("src > 1000"), task_links=task_links).count() == 0
