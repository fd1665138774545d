"""Exact top-k search by a Voronoi kNN join under the integer inner product.

Vectors become integers, floor(256 * x) of each component. A bounded number of them serve as pivots, and every vector
belongs to its nearest pivot's cell. Each cell is summarised by its size, its radius and the distances of its members
nearest to the pivot. For a query q, a member x of the cell of pivot p satisfies |q.x - q.p| <= |q| * |x - p|. The
nearest members of all cells thus bound q's k-th best score from below, and a cell whose radius bounds its scores
below that isn't searched: q is only sent to the others. Queries are grouped by their own nearest pivots too, into
groups of bounded size, and a cell's data goes only to the groups of which a query may need it. Cells are cut into blocks
of bounded size, so neither a hot cell nor a vector that occurs very often meets in one task; each block returns its k
best per query. Products are exact: of floats where they stay below 2 ** 53, of 64-bit integers beyond.

Defined results: vectors that are null or hold null or non-finite components take no part, and neither do null ids;
of vectors of different length the shorter counts as ending in zeros; rows with the query's own id are no candidates;
of repeated rows each is a candidate, and a query that is repeated is asked once, with its smallest vector; equal
scores rank by the smaller id; a query without candidates has no rows; an empty table gives an empty result; columns
besides the id and the vector aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.llm.text import keep_columns, ship_package
from sieveline.plans.lineage import cut

SCALE = 256
K = 5
QUERY_EVERY = 50
MAX_PIVOTS = 512
#: Rows of a cell, and queries, that meet in one task at most (up to the evenness of a hash).
BLOCK, QUERY_GROUP = 4_096, 1_024
#: Rows (cell, group) that may be broadcast.
BROADCAST_ROWS = 400_000


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v array<bigint>, of the vectors that take part."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = keep_columns(embeddings, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(usable, F.lit(False)))
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("bigint")).alias("v"))


def matrix(vectors: pd.Series, width: int, kind: type = np.float64) -> np.ndarray:
    """Rows of numbers; float64 is exact for integers whose inner products stay below 2 ** 53."""
    out = np.zeros((len(vectors), width), kind)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squared = (x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(axis=1)
    return np.sqrt(np.maximum(squared, 0))


def choose_pivots(vectors: DataFrame, n: int, width: int) -> np.ndarray:
    """Distinct vectors, the first by a hash; about the square root of the number of vectors, MAX_PIVOTS at most."""
    wanted = int(np.clip(np.sqrt(n) / 4, 1, MAX_PIVOTS))
    rows = vectors.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(4 * wanted).toPandas()
    return np.unique(matrix(rows["v"], width), axis=0)[:: max(1, len(rows) // wanted)][:MAX_PIVOTS] if len(rows) else np.zeros((1, width))


def assign_cells(vectors: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """vec_id, v, cell, distance to the cell's pivot."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = distances(matrix(batch["v"], width), shared.value)
            cell = d.argmin(axis=1)
            yield batch.assign(cell=cell.astype("int32"), distance=d[np.arange(len(d)), cell])

    return vectors.mapInPandas(run, "vec_id bigint, v array<bigint>, cell int, distance double")


def summaries(cells: DataFrame, k: int) -> pd.DataFrame:
    """cell, n, radius, nearest (k + 1 smallest distances); one row a pivot. Distances are cut to a grid before they
    are gathered, rounded up, so that equal ones need no list."""
    rough = cells.select("cell", F.ceil(F.col("distance") * 16).alias("step")).groupBy("cell", "step").agg(F.count("*").alias("n"))
    order = W.partitionBy("cell").orderBy("step")
    near = rough.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    nearest = near.groupBy("cell").agg(F.collect_list(F.struct("step", F.least("n", F.lit(k + 1)).alias("n"))).alias("steps"))
    sizes = rough.groupBy("cell").agg(F.sum("n").alias("n"), F.max("step").alias("radius"))
    out = sizes.join(nearest, "cell").toPandas().sort_values("cell").reset_index(drop=True)
    out["radius"] = out["radius"] / 16
    out["nearest"] = [sorted(s["step"] / 16 for s in steps for _ in range(s["n"]))[: k + 1] for steps in out.pop("steps")]
    return out


def cells_to_search(q: np.ndarray, pivots: np.ndarray, cells: pd.DataFrame, k: int) -> np.ndarray:
    """For each query (row) whether each cell (column) may hold one of its k best."""
    at = cells["cell"].to_numpy()
    centre, norm = q @ pivots[at].T, np.sqrt((q**2).sum(axis=1))[:, None]
    upper = centre + norm * cells["radius"].to_numpy()
    owner = np.repeat(np.arange(len(cells)), cells["nearest"].map(len))
    lower = centre[:, owner] - norm * np.concatenate(cells["nearest"].to_numpy())
    if lower.shape[1] <= k:  # the k + 1 best, as one of them may be the query's own row
        return np.ones_like(upper, bool)
    bound = -np.partition(-lower, k, axis=1)[:, k]
    return upper >= bound[:, None] - 1e-6 * (1 + np.abs(bound[:, None]))


def best_rows(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """(score, id) of the k best, ties to the smaller id."""
    if len(scores) > k + 1:
        # Rows of the query's own id are skipped below, so the cut is made without them.
        others = scores[ids != own]
        if len(others) > k:
            near = np.flatnonzero(scores >= -np.partition(-others, k - 1)[k - 1])
            scores, ids = scores[near], ids[near]
    keep = ids != own
    scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return [(int(scores[i]), int(ids[i])) for i in order]


def query_groups(asked: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """For each cell with queries the number of its first group and how many groups its queries are dealt to: cells of few
    queries share a group. A row for each pivot at most comes to the driver."""
    first, numbers, filled, group = {}, {}, 0, 0
    for row in asked.groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell").collect():
        if filled and filled + row["n"] > QUERY_GROUP:
            filled, group = 0, group + 1
        first[row["cell"]], numbers[row["cell"]] = group, -(-row["n"] // QUERY_GROUP)
        filled += row["n"]
        if filled >= QUERY_GROUP:
            filled, group = 0, group + numbers[row["cell"]]
    return first, numbers


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """vectors, queries: vec_id, v of integers. Returns query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ship_package(spark)
    vectors = cut(vectors)
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    width, schema = max(int(size["width"] or 0), 1), "query_id bigint, rank int, vec_id bigint, score bigint"
    if not size["n"]:
        return spark.createDataFrame([], schema)
    kind = np.float64 if width * int(size["most"] or 0) ** 2 < 1 << 53 else np.int64
    pivots = choose_pivots(vectors, size["n"], width)
    cells = cut(assign_cells(vectors, pivots, width))
    summary = summaries(cells, k)
    shared = spark.sparkContext.broadcast((pivots, summary))
    asked = cut(assign_cells(queries.groupBy("vec_id").agg(F.min("v").alias("v")), pivots, width))
    groups, numbers = query_groups(asked)
    blocks = {int(c): -(-int(n) // BLOCK) for c, n in zip(summary["cell"], summary["n"], strict=True)}
    by_cell = lambda values: F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("cell"))
    part = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), n).cast("int")

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, s = shared.value
        for batch in batches:
            at, to = np.nonzero(cells_to_search(matrix(batch["v"], width), p, s, k))
            yield pd.DataFrame({"vec_id": batch["vec_id"].to_numpy()[at], "v": batch["v"].to_numpy()[at], "query_group": batch["query_group"].to_numpy()[at], "cell": s["cell"].to_numpy()[to].astype("int32")})

    if not groups:
        return spark.createDataFrame([], schema)
    grouped = asked.select("vec_id", "v", (by_cell(groups) + part(by_cell(numbers), 5)).cast("int").alias("query_group"))
    sent = cut(grouped.mapInPandas(route, "vec_id bigint, v array<bigint>, query_group int, cell int"))
    needed = cut(sent.select("cell", "query_group").distinct()).toDF("cell", "group_")
    sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0), by_cell(blocks) - 1)))
    data = cells.select("vec_id", "v", "cell", part(by_cell(blocks), 11).alias("block")).join(F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed, "cell").withColumnRenamed("group_", "query_group")

    def solve(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(wanted):
            x, ids = matrix(rows["v"], width, kind), rows["vec_id"].to_numpy()
            own = wanted["vec_id"].to_numpy()
            for start in range(0, len(wanted), 256):
                scores = matrix(wanted["v"].iloc[start : start + 256], width, kind) @ x.T
                for i, row in enumerate(scores):
                    found += [(own[start + i], v, s) for s, v in best_rows(row, ids, own[start + i], k)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    key = ["cell", "block", "query_group"]
    local = data.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(solve, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_vectors(embeddings: DataFrame) -> DataFrame:
    """Every QUERY_EVERY-th id asks all rows."""
    vectors = integer_vectors(embeddings)
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))


KNN_SQL = f"""
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
