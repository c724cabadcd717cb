"""Centroid clustering by dimension-sharded Lloyd rounds in exact integers."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import scratch, stored, table

#: Production parameters of the query.
DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, "2"
#: Dimensions of a column block, and vectors whose blocks travel as one row.
BLOCK_DIMS = 32
CHUNK = 2048
#: Scaled components are smaller than this in size, so that a squared distance fits a long.
LIMIT = 2**27
#: Bytes of column blocks in a bucket, and the most buckets that a table may be written in.
BUCKET_BYTES = 16_000_000
TABLE_BUCKETS = 50_000


def scaled(vectors: DataFrame, dims: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, x): ids as they are and components as integers floor(scale * component). Vectors that are null, have another number of components or one that is null or not finite are left out, and those with a component so large (2^27 after scaling) that squared distances would not fit a long."""
    x = F.transform(vector_col, lambda v: v.cast("double") * scale)
    rows = vectors.select(F.col(id_col).alias("vec_id"), x.alias("y")).where((F.size("y") == dims) & F.forall("y", lambda v: v.isNotNull() & (F.abs(v) < LIMIT) & ~F.isnan(v)))
    return rows.select("vec_id", F.transform("y", lambda v: F.floor(v).cast("int")).alias("x"))


def first_centroids(rows: DataFrame, clusters: int, seed: str) -> np.ndarray:
    """The vectors whose ids have the smallest SHA-256 of `<seed>:<vec_id>`, in this order (ties by the vector); at most `clusters`, which bounds what comes to the driver."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    found = rows.select(digest.alias("h"), "x").orderBy("h", "x").limit(clusters).collect()
    return np.array([r["x"] for r in found], np.int64)


def _blocks(rows: DataFrame, dims: int, block_dims: int, chunk: int) -> tuple[DataFrame, DataFrame, str]:
    """Two stored tables of the vectors in chunks, and the name of the second: ids (chunk, ids) in the order of the chunk, and column blocks (shard, chunk, size, data), each with some of the dimensions of all vectors of a chunk as little-endian integers of `size` bytes. Blocks are bucketed by shard and chunk, so that rounds never shuffle them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                piece = batch.slice(at, chunk)
                x = np.asarray(piece.column("x").flatten()).reshape(-1, dims)
                kind = "<i2" if np.abs(x).max() < 2**15 else "<i4"
                data = [x[:, d : d + block_dims].astype(kind).tobytes() for d in range(0, dims, block_dims)]
                ids = pa.array([piece.column("vec_id").to_pylist(), *[None] * len(data)], pa.list_(piece.column("vec_id").type))
                shards = pa.array([-1, *range(len(data))], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + n] * len(shards)), shards, pa.array([int(kind[-1])] * len(shards), pa.int32()), ids, pa.array([None, *data], pa.binary())], ["chunk", "shard", "size", "ids", "data"])
                n += 1

    kind, spark = rows.schema["vec_id"].dataType.simpleString(), rows.sparkSession
    both = stored(rows.mapInArrow(cut, f"chunk long, shard int, size int, ids array<{kind}>, data binary"), "chunks")
    size = both.agg(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0
    n, name = min(TABLE_BUCKETS, max(1, -(-size // BUCKET_BYTES))), f"column_blocks_{uuid.uuid4().hex}"
    keys = ("shard", "chunk")
    both.where("shard >= 0").select(*keys, "size", "data").repartition(n, *keys).write.bucketBy(n, *keys).option("path", scratch(spark, "blocks")).saveAsTable(name)
    return both.where("shard < 0").select("chunk", "ids"), spark.table(name), name


def _slices(centroids: np.ndarray, block_dims: int) -> list[np.ndarray]:
    """The columns of the centroids that each shard has, as views."""
    return [centroids[:, d : d + block_dims] for d in range(0, centroids.shape[1], block_dims)]


def _block(data: bytes, size: int, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{size}").reshape(-1, width).astype(np.int64)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x and c; in floating point where all sums stay below 2^52."""
    if x.shape[1] * int(np.abs(x).max()) * int(np.abs(c).max()) < 2**52:
        products = (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    else:
        products = x @ c.T
    return (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * products


def assigned(blocks: DataFrame, centroids: np.ndarray, block_dims: int = BLOCK_DIMS) -> DataFrame:
    """Rows (chunk, cluster, distance), the latter two as bytes of an integer for each vector of the chunk.

    Each column block gives the exact squared distances of its vectors to the centroids' slices; blocks of a chunk are added by key, and
    the smallest sum, of equals the first, is the cluster. A chunk's sums are bounded by its size and the number of centroids.
    """

    slices = _slices(centroids, block_dims)

    def partial(rows: Iterator[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, np.ndarray]]:
        for shard, chunk, size, data in rows:
            far = _squares(_block(data, size, slices[shard].shape[1]), slices[shard])
            yield chunk, far if far.max(initial=0) >= 2**31 else far.astype(np.int32)

    def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = a.astype(np.int64) + b
        return total if total.max(initial=0) >= 2**31 else total.astype(np.int32)

    def nearest(total: np.ndarray) -> tuple[bytes, bytes]:
        at = total.argmin(1)
        return at.astype("<i4").tobytes(), total[np.arange(len(at)), at].astype("<i8").tobytes()

    sums = blocks.rdd.mapPartitions(partial).reduceByKey(added, max(1, blocks.rdd.getNumPartitions()))
    found = sums.mapValues(nearest).map(lambda r: (r[0], bytearray(r[1][0]), bytearray(r[1][1])))
    return stored(blocks.sparkSession.createDataFrame(found, "chunk long, cluster binary, distance binary"), "assigned")


def moved(blocks: DataFrame, clusters: DataFrame, centroids: np.ndarray, block_dims: int = BLOCK_DIMS) -> np.ndarray:
    """The centroids after an update: in each shard the sums and counts of its own dimensions are added by cluster, and floor(sum / count) is the new slice; a cluster without vectors keeps its place. What comes to the driver has the size of the centroids."""
    k, out = len(centroids), centroids.copy()
    own_slices = _slices(out, block_dims)
    widths = [c.shape[1] for c in own_slices]
    joined = blocks.join(clusters.select(F.explode(F.array(*map(F.lit, range(len(widths))))).alias("shard"), "chunk", "cluster"), ["shard", "chunk"])

    def sums(rows: Iterator[tuple[int, int, int, bytes, bytes]]) -> Iterator[tuple[int, np.ndarray]]:
        own: dict[int, np.ndarray] = {}
        for shard, _, size, data, cluster in rows:
            x, at = _block(data, size, widths[shard]), np.frombuffer(cluster, "<i4")
            total = own.setdefault(shard, np.zeros((k, widths[shard] + 1), np.int64))
            np.add.at(total, at, np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1))
        yield from own.items()

    shards = joined.rdd.mapPartitions(sums).reduceByKey(np.add).mapValues(lambda t: (t[:, :-1] // np.maximum(t[:, -1:], 1), t[:, -1] > 0)).collect()
    for shard, (place, has) in shards:
        own_slices[shard][has] = place[has]
    return out


def lloyd(rows: DataFrame, centroids: np.ndarray, rounds: int, block_dims: int = BLOCK_DIMS, chunk: int = CHUNK) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, cluster, distance) of `scaled` vectors after `rounds` of assignment and update and one more assignment, and the last centroids. Every row has one result, repeated ids too; without vectors there are none."""
    ids, blocks, name = _blocks(rows, centroids.shape[1], block_dims, chunk)
    clusters = assigned(blocks, centroids, block_dims)
    for _ in range(rounds):
        centroids = moved(blocks, clusters, centroids, block_dims)
        clusters = assigned(blocks, centroids, block_dims)
    rows.sparkSession.sql(f"DROP TABLE {name}")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cluster = np.frombuffer(batch.column("cluster")[k].as_py(), "<i4")
                distance = np.frombuffer(batch.column("distance")[k].as_py(), "<i8")
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return ids.join(clusters, "chunk").mapInArrow(spread, f"vec_id {kind}, cluster int, distance long"), centroids


def cluster_report(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`found` with cluster_inertia and inertia, the distances summed over the cluster and over all, and the digest of the cluster's centroid. There is a row of sums for each centroid, so these are broadcast."""
    spark = found.sparkSession
    digests = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    known = sums.join(F.broadcast(total)).join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters of all `embeddings` of 64 finite components after five rounds."""
    rows = scaled(table(spark, sf_dir, "embeddings"), DIMS, SCALE)
    centroids = first_centroids(rows, CLUSTERS, SEED)
    if not len(centroids):
        return rows.select("vec_id", *(F.lit(None).cast(kind).alias(name) for name, kind in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    found, last = lloyd(rows, centroids, ROUNDS)
    return cluster_report(stored(found, "clusters"), last)


def _op13_sql() -> str:
    """The rounds spelled out, a row for each vector and dimension."""
    steps = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda v: CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {DIMS}),
cells AS MATERIALIZED (SELECT r, unnest(range({DIMS})) AS d, unnest(x) AS v FROM kept),
c0 AS MATERIALIZED (SELECT cluster, unnest(range({DIMS})) AS d, unnest(x) AS v FROM (SELECT x, CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS INTEGER) AS cluster FROM kept QUALIFY cluster < {CLUSTERS}))"""
    for k in range(ROUNDS + 1):
        steps += f""",
a{k} AS MATERIALIZED (SELECT r, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM (SELECT r, cluster, CAST(sum((cells.v - c.v) * (cells.v - c.v)) AS BIGINT) AS distance FROM cells JOIN c{k} AS c USING (d) GROUP BY r, cluster) GROUP BY r)"""
        if k < ROUNDS:
            steps += f""",
m{k} AS (SELECT cluster, d, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM cells JOIN a{k} USING (r) GROUP BY cluster, d),
c{k + 1} AS MATERIALIZED (SELECT cluster, d, coalesce(m{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN m{k} USING (cluster, d))"""
    return steps + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, digest AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (r) JOIN (SELECT cluster, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY d)) AS digest FROM c{ROUNDS} GROUP BY cluster) USING (cluster)"""


OP13_SQL = _op13_sql()
