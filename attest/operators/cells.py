"""A dense index kept on disk by cells, and searches that read only the cells they probe.

Centres are fitted on a bounded sample; every row then lies with its nearest centre, in a folder of that cell's own, cut
into files of a bounded number of rows. Beside each centre stands how far its members reach from it, as the least cosine
of a member with the centre. From that and a query's cosine with the centre follows the best score a member can
have, so a search knows when no other cell can better what it has.

Three ways to search an index:

* ``search(..., n_probe=n)``: the n cells nearest to each query.
* ``search(..., n_probe=calibrated(...))``: the number of cells that held-out queries needed for a stated recall.
* ``exact_search``: the nearest cells first, then, in one more pass, every cell that can still hold one of the k best. The
  result equals that of ``retrieval.dense_search``.

Vectors that are null, empty or zero score 0, lie in the first cell, and are found there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.vectors import normalise
from ..session import materialised
from .blocks import BROADCAST_CELLS, BROADCAST_QUERIES, CELLS, DIGITS, _frame, _trim, dense_block
from .topk import top_k

# Rows per centre that the fit reads, and rows of a file.
FIT_ROWS = 256
FILE_ROWS = 50_000
# Scores are rounded to ten digits; a bound within this of a score does not rule a cell out.
SLACK = 1e-9
HIT = ["query_id", "rnk", "doc_id", "score"]


def matrix(column, width: int) -> np.ndarray:
    """Rows at unit length; zeros for vectors that are null or of another length."""
    m = np.stack([np.zeros(width) if v is None or len(v) != width else np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, width))
    lengths = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(lengths == 0, 1.0, lengths)


def list_matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """``matrix`` of an Arrow column, from its values as they lie, without an object per row."""
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m, fit = np.zeros((len(column), width)), lengths == width
    m[fit] = (flat if fit.all() else flat[np.repeat(fit, lengths)]).reshape(-1, width)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


def fit_centres(docs: DataFrame, n_cells: int = 100, seed: int = 42, rows_per_cell: int = FIT_ROWS) -> np.ndarray:
    """At most ``n_cells`` unit centres, fitted on the ``rows_per_cell * n_cells`` rows of the smallest hashes of doc_id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    usable = docs.filter(F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double"))) > 0)
    sample = usable.select("doc_id", "vector").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_cell * n_cells)
    rows = sample.select(array_to_vector(normalise(F.col("vector"))).alias("features"))
    few = rows.distinct().limit(n_cells + 1).collect()
    if len(few) <= n_cells:
        # Each direction is a centre of its own.
        centres = np.array(sorted(r["features"].toArray().tolist() for r in few)) if few else np.zeros((1, 1))
        return matrix(centres, centres.shape[1])
    model = KMeans(k=n_cells, seed=seed, maxIter=10, featuresCol="features").fit(rows)
    centres = np.array(model.clusterCenters())
    return matrix(centres, centres.shape[1])


def with_cells(docs: DataFrame, centres: np.ndarray) -> DataFrame:
    """``docs`` with cell_id, the nearest centre (ties to the first), and ``nearness``, the cosine with it."""
    @F.pandas_udf("struct<cell_id:int,nearness:double>")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        near = matrix(vectors, centres.shape[1]) @ centres.T
        cell = near.argmax(axis=1)
        return pd.DataFrame({"cell_id": cell.astype(np.int32), "nearness": near[np.arange(len(cell)), cell]})
    return docs.withColumn("placed", nearest("vector")).select(*docs.columns, "placed.cell_id", "placed.nearness")


@dataclass
class CellIndex:
    """An opened index: one row per cell of its description is held, no vectors."""
    rows: DataFrame
    centres: np.ndarray
    cells: np.ndarray
    n_rows: np.ndarray
    reach: np.ndarray

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    @property
    def geometry(self) -> "Geometry":
        """What tasks need to know of the cells."""
        return Geometry(self.centres, self.cells, self.reach)


@dataclass
class Geometry:
    centres: np.ndarray
    cells: np.ndarray
    reach: np.ndarray

    def near(self, vectors) -> np.ndarray:
        """Cosine of each vector with each centre."""
        return np.clip(matrix(vectors, self.centres.shape[1]) @ self.centres.T, -1.0, 1.0)

    def best(self, near: np.ndarray) -> np.ndarray:
        """The best score a member of each cell can have: it lies within the angle ``reach`` of the centre, so it is nearer
        to the query by at most that angle."""
        return np.cos(np.maximum(np.arccos(near) - np.arccos(np.clip(self.reach, -1.0, 1.0))[None, :], 0.0))


def write_cells(docs: DataFrame, path: str, n_cells: int = 100, seed: int = 42, file_rows: int = FILE_ROWS) -> None:
    """Fits the cells and writes every row of ``docs`` (doc_id, vector, any others) below ``path``.

    The description is written last; a folder without it is no index. A cell of many rows is dealt out over
    files, so no task writes a whole hot cell."""
    centres = fit_centres(docs, n_cells, seed)
    placed = with_cells(docs, centres)
    total = placed.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("nearness").alias("reach"))
    # One row per centre.
    held = F.broadcast(total.select("cell_id", F.ceil(F.col("n_rows") / file_rows).alias("n_files")))
    dealt = placed.join(held, "cell_id").withColumn("file", F.pmod(F.xxhash64("doc_id"), "n_files"))
    dealt.repartition("cell_id", "file").drop("n_files", "file", "nearness").write.partitionBy("cell_id").parquet(f"{path}/cells")
    named = docs.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell_id int, centre array<double>")
    total.join(named, "cell_id").coalesce(1).write.parquet(f"{path}/centres")


def open_cells(spark: SparkSession, path: str) -> CellIndex:
    about = sorted(spark.read.parquet(f"{path}/centres").collect(), key=lambda r: r["cell_id"])
    centres = np.array([r["centre"] for r in about]) if about else np.zeros((0, 1))
    return CellIndex(spark.read.parquet(f"{path}/cells") if about else None, centres,
                     np.array([r["cell_id"] for r in about], dtype=np.int64), np.array([r["n_rows"] for r in about], dtype=np.int64),
                     np.array([r["reach"] for r in about]))


def nearest_cells(space: Geometry, vectors, n_probe: int) -> np.ndarray:
    """The n_probe nearest cells of each vector, a row each."""
    return space.cells[np.argsort(-space.near(vectors), axis=1, kind="stable")[:, :n_probe]].astype(np.int32)


def probes(index: CellIndex, queries: DataFrame, n_probe: int) -> DataFrame:
    """(query_id, vector, cell_id): the n_probe nearest cells of each query."""
    space = index.geometry

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(nearest_cells(space, vectors, n_probe)))
    return queries.select("query_id", "vector", F.explode(nearest("vector")).alias("cell_id"))


def most_probes(index: CellIndex) -> int:
    """Probes that may go to every task."""
    return max(1, min(BROADCAST_QUERIES, BROADCAST_CELLS // index.width))


def hit_schema(index: CellIndex, queries: DataFrame) -> T.StructType:
    return T.StructType([queries.schema["query_id"], index.rows.schema["doc_id"], T.StructField("score", T.DoubleType())])


def scanned(index: CellIndex, few: pd.DataFrame, k: int, ids: T.StructType) -> DataFrame:
    """The k best of the probes ``few`` (query_id, vector, cell_id), whose number is bounded, by one scan of their cells."""
    n, width = few["query_id"].nunique(), index.width
    asking = {int(c): (list(q["query_id"]), matrix(q["vector"], width)) for c, q in few.groupby("cell_id")}
    shared, fields = index.rows.sparkSession.sparkContext.broadcast(asking), to_arrow_schema(ids)
    rows = index.rows.filter(F.col("cell_id").isin(list(asking))).select("cell_id", "doc_id", "vector")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            cells = batch.column("cell_id").to_numpy()
            for cell in np.unique(cells):
                part = batch if (cells == cell).all() else batch.filter(pa.array(cells == cell))
                queries, q = shared.value[int(cell)]
                step = max(1, CELLS // len(queries))
                for begin in range(0, part.num_rows, step):
                    some = part.slice(begin, step)
                    scores = np.round(list_matrix(some.column("vector"), width) @ q.T, DIGITS) + 0.0
                    found = _frame(scores, some.column("doc_id").to_numpy(zero_copy_only=False), queries, k)
                    best = found if best is None else pd.concat([best, found])
            if best is not None and len(best) > 8 * k * n:
                best = _trim(best, k)
        if best is not None and len(best):
            yield pa.RecordBatch.from_pandas(_trim(best, k), fields, preserve_index=False)
    return rows.mapInArrow(scan, ids)


def probed(index: CellIndex, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score): the k best of each query's probed cells, from ``asked`` (query_id, vector, cell_id).

    The probed cells are known before the scan is planned, so the others' folders are not read. Probes of a bounded
    number go to the tasks that scan; more of them meet the cells' files in a task per cell and shard."""
    ids, limit = hit_schema(index, asked), most_probes(index)
    # One job says whether the probes are few and, if so, what they are.
    few = asked.limit(limit + 1).toPandas()
    if len(few) <= limit:
        return scanned(index, few, k, ids)
    wanted = [r["cell_id"] for r in asked.select("cell_id").distinct().collect()]
    rows = index.rows.filter(F.col("cell_id").isin(wanted)).select("cell_id", "doc_id", "vector")
    shards = {int(c): max(1, math.ceil(r / FILE_ROWS)) for c, r in zip(index.cells, index.n_rows)}
    of_cell = F.create_map(*[F.lit(x) for pair in shards.items() for x in pair])
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), of_cell[F.col("cell_id")]).cast("int"))
    asking = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), of_cell[F.col("cell_id")] - 1)))

    def meet(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(d) or not len(q):
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        return dense_block(d[["doc_id", "vector"]], q[["query_id", "vector"]], k)
    return dealt.groupBy("cell_id", "shard").cogroup(asking.groupBy("cell_id", "shard")).applyInPandas(meet, ids)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    return top_k(hits, k, ["query_id"], [F.desc("score"), F.asc("doc_id")]).select(*HIT)


def search(index: CellIndex, queries: DataFrame, k: int, n_probe: int = 10) -> DataFrame:
    """(query_id, rnk, doc_id, score) of the n_probe nearest cells. The probes of a bounded number of queries are found where the
    search is planned, those of more by tasks."""
    limit = most_probes(index) // n_probe
    few = queries.select("query_id", "vector").limit(limit + 1).toPandas()
    if len(few) <= limit:
        few["cell_id"] = list(nearest_cells(index.geometry, few["vector"], n_probe))
        return ranked(scanned(index, few.explode("cell_id"), k, hit_schema(index, queries)), k)
    return ranked(probed(index, probes(index, queries, n_probe), k), k)


def exact_search(index: CellIndex, queries: DataFrame, k: int, n_probe: int = 10) -> tuple[DataFrame, DataFrame]:
    """The k best of all rows, and (query_id, cell_id) of the cells that were read for each query.

    A second pass reads the cells whose bound reaches the k-th score of the first; a query with fewer than k hits
    reads all cells."""
    space = index.geometry
    first = probes(index, queries, n_probe)
    hits = materialised(probed(index, first, k), "first-hits")
    # Each task gave its k best per query.
    kth = ranked(hits, k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))

    @F.pandas_udf("array<int>")
    def open_cells_of(vectors: pd.Series, least: pd.Series) -> pd.Series:
        near = space.near(vectors)
        probed_first = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1) < n_probe
        reaches = space.best(near) >= least.fillna(-2.0).to_numpy(dtype=np.float64)[:, None] - SLACK
        return pd.Series([space.cells[row].astype(np.int32) for row in reaches & ~probed_first])
    second = materialised(queries.select("query_id", "vector").join(kth, "query_id", "left").select(
        "query_id", "vector", F.explode(open_cells_of("vector", F.col("kth").cast("double"))).alias("cell_id")), "second-probes")
    read = first.select("query_id", "cell_id").unionByName(second.select("query_id", "cell_id"))
    return ranked(hits.unionByName(probed(index, second, k)), k), read


def calibration(index: CellIndex, held_out: DataFrame, k: int) -> DataFrame:
    """(n_probe, recall): the share of the exact hits that lie in the n_probe nearest cells, over held-out queries.

    A hit at place p of its query's order of cells is found from p cells on, so one exact search gives the whole curve."""
    space = index.geometry
    hits, _ = exact_search(index, held_out, k)
    located = hits.join(index.rows.select("doc_id", "cell_id"), "doc_id")

    @F.pandas_udf("int")
    def place(vectors: pd.Series, cells: pd.Series) -> pd.Series:
        order = np.argsort(np.argsort(-space.near(vectors), axis=1, kind="stable"), axis=1)
        return pd.Series(order[np.arange(len(cells)), np.searchsorted(space.cells, cells.to_numpy())] + 1)
    places = located.join(held_out.select("query_id", "vector"), "query_id").groupBy(place("vector", "cell_id").alias("n_probe")).agg(F.count(F.lit(1)).alias("n"))
    # One row per number of cells.
    upto = W.orderBy("n_probe").rowsBetween(W.unboundedPreceding, 0)
    return places.select("n_probe", (F.sum("n").over(upto) / F.sum("n").over(W.partitionBy())).alias("recall"))


def calibrated(index: CellIndex, held_out: DataFrame, k: int, recall: float = 0.95) -> int:
    """The least number of cells at which held-out queries keep ``recall`` of their exact hits."""
    row = calibration(index, held_out, k).filter(F.col("recall") >= recall).agg(F.min("n_probe")).first()
    return row[0] or len(index.cells)
