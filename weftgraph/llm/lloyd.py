"""Plain Lloyd clustering of integer vectors, exact at every step.

A vector's component x becomes floor(256 * x), x as double. Vectors are taken that have exactly ``dims`` components, none null or
non-finite, and whose integers are at most 2^26 in size, so that a squared distance fits a long; all others, null vectors too, have no row in the
result. They are written once, as packed integers, and each round reads them: mapInPandas works out the integer squared
differences to each broadcast centroid in NumPy, argmin takes the lowest number among equals, and a task hands on one row of
integer sums for each centroid, merged by groupBy. Only the centroids, clusters times dims integers, pass through the driver. A hot vector or
cluster is no hot key, as tasks sum before anything is dealt.

The first centroids are the vectors of least SHA-256 of '2:' and vec_id; ties (repeated ids) by the vectors' components, in their packed
form. Fewer vectors than clusters: as many clusters as vectors. A centroid without vectors stays. vec_id null: hashed as an empty id.
Sums past a long are null. Repeated rows: each is a vector. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._common import materialize

LARGEST = 1 << 26


def integers(vectors: DataFrame, dims: int = 64, scale: int = 256) -> DataFrame:
    """vec_id and v, the vector as little-endian 32-bit integers."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.size("embedding") == dims)
    finite = F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double") * scale) <= LARGEST, F.lit(False)) & ~F.isnan(c.cast("double")))
    kept = whole.where(finite).select("vec_id", x.alias("x"))

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            flat = b.column("x").flatten().to_numpy(zero_copy_only=False).astype("<i4")
            yield pa.record_batch([b.column("vec_id"), pa.array([r.tobytes() for r in flat.reshape(b.num_rows, dims)], pa.binary())], names=["vec_id", "v"])

    return kept.mapInArrow(pack, "vec_id long, v binary")


def matrix_of(column) -> np.ndarray:
    """Rows of packed integers as a matrix."""
    return np.frombuffer(b"".join(column), dtype="<i4").reshape(len(column), -1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid, the lowest number among equals."""
    most = int(max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)))
    # 32 bits hold every square sum of these sizes, or else 64 bits do
    kind = np.int32 if vectors.shape[1] * (2 * most) ** 2 < 1 << 31 else np.int64
    vectors, centroids = vectors.astype(kind), centroids.astype(kind)
    far = np.empty((len(vectors), len(centroids)), kind)
    for k, c in enumerate(centroids):
        d = vectors - c
        far[:, k] = np.einsum("ij,ij->i", d, d)
    own = far.argmin(axis=1)
    return own, far[np.arange(len(own)), own].astype(np.int64)


def start(kept: DataFrame, clusters: int, seed: str) -> np.ndarray:
    h = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept.select(h.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return matrix_of([bytes(r["v"]) for r in rows]).astype(np.int64) if rows else np.zeros((0, 0), np.int64)


def next_centroids(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's vectors' componentwise floor of the mean; one without vectors stays."""
    dims = centroids.shape[1]
    shared = kept.sparkSession.sparkContext.broadcast(centroids)
    names = [f"s{i}" for i in range(dims)]

    def sums(frames):
        import pandas as pd

        total, n = np.zeros(shared.value.shape, np.int64), np.zeros(len(shared.value), np.int64)
        for f in frames:
            if len(f):
                v = matrix_of(f["v"])
                own, _ = nearest(v, shared.value)
                order = np.argsort(own, kind="stable")
                met, first = np.unique(own[order], return_index=True)
                total[met] += np.add.reduceat(v[order].astype(np.int64), first, axis=0)
                n += np.bincount(own, minlength=len(n))
        out = pd.DataFrame(total, columns=names)
        out.insert(0, "n", n)
        out.insert(0, "cluster", np.arange(len(n), dtype=np.int32))
        yield out[out["n"] > 0]

    part = kept.select("v").mapInPandas(sums, "cluster int, n long, " + ", ".join(f"{c} long" for c in names))
    wide = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("n", *names)]
    # a row a cluster
    merged = part.groupBy("cluster").agg(*wide).collect()
    shared.destroy()
    out = centroids.copy()
    for r in merged:
        out[r["cluster"]] = [int(r[c]) // int(r["n"]) for c in names]
    return out


def fit(kept: DataFrame, clusters: int = 40, rounds: int = 5, seed: str = "2:") -> np.ndarray:
    centroids = start(kept, clusters, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = next_centroids(kept, centroids)
    return centroids


def assign(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance."""
    def run(frames):
        import pandas as pd

        for f in frames:
            if len(f):
                own, far = nearest(matrix_of(f["v"]), centroids)
                yield pd.DataFrame({"vec_id": f["vec_id"].astype("Int64"), "cluster": own.astype(np.int32), "distance": far})

    return kept.mapInPandas(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, clusters: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2:") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each vector taken."""
    spark = vectors.sparkSession
    kept = materialize(integers(vectors, dims, scale), "vectors")
    centroids = fit(kept, clusters, rounds, seed)
    placed = materialize(assign(kept, centroids), "assigned")
    # a row a cluster
    inertia = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    named = [(k, fits(s), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()) for k, s in inertia.items()]
    sums = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
