"""Exact vector search that skips: vectors lie by cluster, and bounds on the angle leave whole clusters unread (RANK-2).

A vector at angle ``a`` from its cluster's centre is at least ``b - a`` away from a query at angle ``b`` from it.  With the
largest ``a`` of a cluster, that bounds all its vectors.  A search reads the nearest clusters first; the k-th hit then
tells which of the others can still hold a better one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import WorkTables, work_path
from .search import DEFAULT_SIZE, QUERY_BLOCK, BestOfBatches, shown, top_hits, unit_rows, usable

#: Rows the centres are fitted on, and the most centres: both bound what the driver holds.
SAMPLE_ROWS = 20_000
MOST_CLUSTERS = 1_024
#: Room for the noise of angles.
ANGLE_NOISE = 1e-6


@dataclass
class VectorIndex:
    """``vectors``: ``(doc, v, cluster)`` by folders of ``cluster``; ``centres``, ``radii`` and ``counts`` per cluster."""

    vectors: DataFrame
    doc: str
    centres: np.ndarray
    radii: np.ndarray
    counts: np.ndarray


def fit_centres(vectors: DataFrame, width: int, clusters: int, sample_rows: int = SAMPLE_ROWS, rounds: int = 8) -> np.ndarray:
    """Unit vectors in the middle of the clusters of a sample (spherical k-means, begun with vectors far apart)."""
    sample = vectors.select("v", F.rand(1).alias("_at")).orderBy("_at").limit(sample_rows).select("v")
    rows = unit_rows(np.array([r["v"] for r in sample.collect()], dtype=np.float64).reshape(-1, width))
    if not len(rows):
        return np.zeros((1, width))
    centres = rows[:1]
    nearest = rows @ rows[0]
    for _ in range(min(clusters, len(rows)) - 1):
        far = int(np.argmin(nearest))
        if nearest[far] > 1 - 1e-12:
            break
        centres = np.vstack([centres, rows[far]])
        nearest = np.maximum(nearest, rows @ rows[far])
    for _ in range(rounds):
        own = np.argmax(rows @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.where(norms == 0, 1, norms), centres)
    return centres


def write_vectors(vectors: DataFrame, path: str, doc: str = "staged_id", clusters: int | None = None, sample_rows: int = SAMPLE_ROWS) -> None:
    """Every vector that a search can use, in the folder of its nearest centre.

    Only the centres come from a sample; all vectors are assigned.  ``clusters``: by default the root of the number of
    vectors, ``MOST_CLUSTERS`` at most.  A cluster that holds a large share lies in several files.
    """
    spark = vectors.sparkSession
    width = vectors.agg(F.max(F.size("content_vector"))).first()[0] or 0
    own = vectors.where(usable(width)).select(doc, F.col("content_vector").cast("array<double>").alias("v"))
    wanted = clusters or max(1, min(MOST_CLUSTERS, int(own.count() ** 0.5)))
    fitted = fit_centres(own, width, wanted, sample_rows)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = unit_rows(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                cosines = rows @ fitted.T
                nearest = np.argmax(cosines, axis=1)
                angles = np.arccos(np.clip(cosines[np.arange(len(rows)), nearest], -1, 1))
                # A vector of length 0 has cosine 0 with every query; such vectors are a cluster around 0 of their own.
                empty = np.linalg.norm(rows, axis=1) < 0.5
                nearest, angles = np.where(empty, len(fitted), nearest), np.where(empty, 0.0, angles)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(doc), batch.column("v"), pa.array(nearest.astype("i4")), pa.array(angles)], names=[doc, "v", "cluster", "angle"])

    kind = own.schema[doc].dataType.simpleString()
    assigned = own.mapInArrow(assign, f"`{doc}` {kind}, v array<double>, cluster int, angle double")
    assigned.hint("rebalance", "cluster").write.partitionBy("cluster").parquet(f"{path}/vectors")
    stored = spark.read.schema(assigned.schema).parquet(f"{path}/vectors")
    sizes = {r["cluster"]: r for r in stored.groupBy("cluster").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
    centres = np.vstack([fitted, np.zeros((1, width))])
    rows = [(c, [float(x) for x in centres[c]], float(sizes[c]["radius"]), int(sizes[c]["n"])) for c in sorted(sizes)]
    spark.createDataFrame(rows, "cluster int, centre array<double>, radius double, n long").coalesce(1).write.parquet(f"{path}/clusters")


def read_vectors(spark: SparkSession, path: str, doc: str = "staged_id") -> VectorIndex:
    """The written index; one row per cluster comes to the driver."""
    clusters = sorted(spark.read.parquet(f"{path}/clusters").collect(), key=lambda r: r["cluster"])
    most = clusters[-1]["cluster"] + 1 if clusters else 0
    width = len(clusters[0]["centre"]) if clusters else 0
    centres, radii, counts = np.zeros((most, width)), np.zeros(most), np.zeros(most, dtype=np.int64)
    for r in clusters:
        centres[r["cluster"]], radii[r["cluster"]], counts[r["cluster"]] = r["centre"], r["radius"], r["n"]
    schema = f"cluster int, {doc} string"
    vectors = spark.read.parquet(f"{path}/vectors") if most else spark.createDataFrame([], f"{schema}, v array<double>, angle double")
    return VectorIndex(vectors, doc, centres, radii, counts)


def clustered_hits(
    index: VectorIndex, queries: DataFrame, size: int = DEFAULT_SIZE, block: int = QUERY_BLOCK, observed: list[tuple[int, int]] | None = None,
) -> DataFrame:
    """Exact cosine top hits as ``search.vector_hits``, reading the clusters that can hold them.

    Queries go block by block, about ``block`` of them at a time on the driver and in the tasks, each block's hits
    written before the next.  ``observed`` gets, per block, the vectors read and the pairs compared.
    """
    spark, doc = queries.sparkSession, index.doc
    width = index.centres.shape[1]
    ready = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("v")).where(usable(width, "v"))
    kind = {"query_id": queries.schema["query_id"].dataType, doc: index.vectors.schema[doc].dataType}
    schema = f"query_id {kind['query_id'].simpleString()}, `{doc}` {kind[doc].simpleString()}, score double"
    out = work_path(spark, "vector-hits")
    spark.createDataFrame([], f"{schema}, rank int").write.parquet(out)
    blocks = -(-ready.count() // block)
    for i in range(blocks):
        rows = ready.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()
        if not rows:
            continue
        ids = pa.array([r[0] for r in rows], to_arrow_type(kind["query_id"]))
        matrix = unit_rows(np.array([r[1] for r in rows], dtype=np.float64))
        work = WorkTables(spark)
        angles = np.arccos(np.clip(matrix @ index.centres.T, -1, 1)) - index.radii
        angles[np.linalg.norm(matrix, axis=1) < 0.5] = 0.0  # a query of length 0 is as far from everything
        angles[:, index.counts == 0] = np.inf
        # The nearest clusters that hold enough vectors together.
        order = np.argsort(angles, axis=1)
        before = np.cumsum(index.counts[order], axis=1) - index.counts[order]
        first = np.zeros_like(angles, dtype=bool)
        np.put_along_axis(first, order, before < size, axis=1)
        hits = work.write(top_hits(_scan(index, ids, matrix, first, size, schema), size, doc=doc), "vector-first")
        at = {r["query_id"]: 2.0 * r["score"] - 1.0 for r in hits.where(F.col("rank") == size).select("query_id", "score").collect()}
        reached = np.array([np.arccos(np.clip(at.get(r[0], -1.0), -1, 1)) for r in rows])
        second = (angles <= reached[:, None] + ANGLE_NOISE) & ~first
        if second.any():
            more = _scan(index, ids, matrix, second, size, schema)
            hits = top_hits(more.unionByName(hits.select(*more.columns)), size, doc=doc)
        hits.write.mode("append").parquet(out)
        if observed is not None:
            read = first.any(axis=0).astype(int) + second.any(axis=0)
            observed.append((int((index.counts * np.minimum(read, 1)).sum()), int(((first | second) * index.counts).sum())))
        work.drop()
    return shown(spark.read.schema(f"{schema}, rank int").parquet(out))


def _scan(index: VectorIndex, ids: pa.Array, matrix: np.ndarray, wanted: np.ndarray, size: int, schema: str) -> DataFrame:
    """Best hits per task of each query among the clusters it wants; folders that no query wants are not read."""
    doc, clusters = index.doc, [int(c) for c in np.flatnonzero(wanted.any(axis=0))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = BestOfBatches(ids, size, doc)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = unit_rows(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            names = np.array(batch.column(doc).to_pylist())
            own = batch.column("cluster").to_numpy()
            best.kind = batch.schema.field(doc).type
            for c in np.unique(own):
                here, asked = own == c, np.flatnonzero(wanted[:, c])
                if len(asked):
                    best.add(asked, rows[here] @ matrix[asked].T, names[here])
        yield from best.rows()

    return index.vectors.where(F.col("cluster").isin(clusters)).select(doc, "v", "cluster").mapInArrow(score, schema)
