"""Dense vectors: nearest centroid, k-means with its knee, silhouette."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


#: Numbers of all centroids together that a task may hold (800 MB); more is an error, not a cut.
CENTRES_MOST = 100_000_000


def nearest_centroid(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``key, proche``: the label whose mean vector is nearest; ties go to the smallest label.

    The means are sums over coordinates; packed (labels x width, a bound that is checked) they go to every
    task, which compares whole batches of vectors by one matrix product. Null vectors and labels take no part in
    the means; null vectors have a null answer.
    """
    flat = df.where(F.col(label).isNotNull()).select(label, F.posexplode(vector).alias("i", "v"))
    packed = flat.groupBy(label, "i").agg(F.avg(F.col("v").cast("double")).alias("m")).groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"))
    size = packed.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("c")).alias("w")).first()
    if size["n"] * (size["w"] or 0) > CENTRES_MOST:
        raise ValueError("too many labels for their centroids to be sent to every task")
    rows = sorted((r[label], [x["m"] for x in r["c"]]) for r in packed.collect())  # bounded above
    names, centres = [n for n, _ in rows], np.array([c for _, c in rows], float)
    sent = df.sparkSession.sparkContext.broadcast((names, centres, (centres**2).sum(1) if rows else centres))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = StructType([df.schema[key], StructField("proche", df.schema[label].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, centres, squares = sent.value
        for batch in batches:
            vectors = batch.column(1)
            good = vectors.is_valid().to_numpy(zero_copy_only=False)
            answer: list = [None] * batch.num_rows
            if good.any() and names:
                x = np.array(vectors.filter(vectors.is_valid()).flatten(), float).reshape(good.sum(), -1)
                far = (x**2).sum(1)[:, None] - 2 * x @ centres.T + squares
                for k, best in zip(np.nonzero(good)[0], np.round(far, 9).argmin(1)):
                    answer[k] = names[best]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answer, arrow_of(kinds[label]))], [key, "proche"])

    return df.select(key, vector).mapInArrow(run, out)


def arrow_of(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind]


def knee(values: list[float]) -> int | None:
    """Index of the knee of a falling convex curve (largest distance below the chord), None for a line."""
    if len(values) < 3 or values[0] <= values[-1]:
        return None
    span, n = values[0] - values[-1], len(values) - 1
    gaps = [1 - i / n - (v - values[-1]) / span for i, v in enumerate(values)]
    best = max(range(len(gaps)), key=gaps.__getitem__)
    return best if gaps[best] > 1e-9 else None


ITERATIONS = 100


def kmeans(df: DataFrame, vector: str = "embedding", low: int = 2, high: int = 10, seed: int = 42) -> DataFrame:
    """``cluster, taille, inertie, silhouette``: k at the knee of the inertia (else the middle), refitted.

    The silhouette is the distributed one over squared distances, one for all clusters, on every row.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    data = df.select(array_to_vector(F.col(vector)).alias("features"))
    n = data.count()
    ks = list(range(low, min(high, n) + 1))
    if not ks:
        raise ValueError("too few rows for k-means")
    fits = [KMeans(k=k, seed=seed, maxIter=ITERATIONS, tol=1e-4).fit(data) for k in ks]
    at = knee([f.summary.trainingCost for f in fits])
    model = fits[at if at is not None else len(fits) // 2]
    placed = model.transform(data)
    score = ClusteringEvaluator().evaluate(placed) if len(model.clusterCenters()) > 1 else 0.0
    out = placed.groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("taille"))
    return out.withColumns({"inertie": F.lit(round(model.summary.trainingCost, 6)), "silhouette": F.lit(round(score, 6))})


