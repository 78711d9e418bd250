"""Approximate nearest neighbours by inverted lists: k-means cells as folders, a query reads a few of them.

The centroids are fitted on a bounded sample, every row is indexed. A cell's rows are dealt to
several files, so a large cell is written and read by several tasks. Distances within the
probed cells are exact.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import vectors

SPLITS = 8


class InvertedLists:
    def __init__(self, spark: SparkSession, path: str, metric: str = "cosine"):
        self.spark, self.path, self.metric = spark, path.rstrip("/"), metric

    def _features(self, v: Column) -> Column:
        """What cells are made of: directions for cosine, the vectors themselves otherwise."""
        doubles = vectors.as_doubles(v)
        if self.metric != "cosine":
            return doubles

        def unit(d: Column) -> Column:
            size = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
            return F.get(F.transform(F.array(size), lambda n: F.transform(d, lambda x: F.when(n > 0, x / n).otherwise(0.0))), 0)

        return F.get(F.transform(F.array(doubles), unit), 0)

    def build(self, store: DataFrame, id_col: str = "id", vector_col: str = "vector", lists: int | None = None, sample: int = 100_000, iterations: int = 10, seed: int = 42) -> InvertedLists:
        """lists: about the root of the rows by default. sample bounds the rows the centroids are fitted on; they are chosen by a hash of the id."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        n = store.count()
        lists = lists or max(1, min(65_536, round(n**0.5)))
        rows = store.withColumn("features", array_to_vector(self._features(F.col(vector_col))))
        step = max(1, -(-n // sample))
        model = KMeans(k=lists, maxIter=iterations, seed=seed, predictionCol="cell").fit(rows.where(F.pmod(F.xxhash64(id_col), F.lit(step)) == 0).select("features"))
        centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        self.spark.createDataFrame(centers, "cell int, center array<double>").write.mode("overwrite").parquet(f"{self.path}/centers")
        self.spark.createDataFrame([(id_col, vector_col)], "id_col string, vector_col string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/names")
        placed = model.transform(rows).drop("features")
        placed.repartition("cell", F.pmod(F.xxhash64(id_col), F.lit(SPLITS))).write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/rows")
        self.__dict__.pop("centers", None)
        return self

    @functools.cached_property
    def centers(self) -> list[tuple[int, list[float]]]:
        """At most 65,536 short vectors."""
        return [(r["cell"], list(r["center"])) for r in self.spark.read.parquet(f"{self.path}/centers").orderBy("cell").collect()]

    def add(self, rows: DataFrame) -> None:
        """Places further rows of the same columns; ids that are there already are not looked for."""
        id_col, vector_col = self._names()
        table = F.lit([c for _, c in self.centers]).cast("array<array<double>>")

        def cell(v: Column) -> Column:
            far = F.transform(table, lambda c: F.aggregate(F.zip_with(c, v, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
            return F.get(F.transform(F.array(far), lambda d: (F.array_position(d, F.array_min(d)) - 1).cast("int")), 0)

        placed = rows.withColumn("cell", F.get(F.transform(F.array(self._features(F.col(vector_col))), cell), 0))
        placed.repartition("cell", F.pmod(F.xxhash64(id_col), F.lit(SPLITS))).write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")

    def _names(self) -> tuple[str, str]:
        return tuple(self.spark.read.parquet(f"{self.path}/names").first())

    def cells(self, vector: list[float], probes: int) -> list[int]:
        """The nearest cells of a query."""
        size = sum(x * x for x in vector) ** 0.5 or 1.0
        v = [x / size for x in vector] if self.metric == "cosine" else vector
        by_distance = sorted((sum((a - b) ** 2 for a, b in zip(c, v, strict=True)), i) for i, c in self.centers)
        return [i for _, i in by_distance[:probes]]

    def search(self, vector: list[float], k: int = 5, probes: int = 16, where: Column | None = None) -> DataFrame:
        """Best k of the probed cells first: id, the other columns, score. where is applied after the cut, as in the exact index."""
        from docspark.operators.search import vector_scores

        id_col, vector_col = self._names()
        rows = self.spark.read.parquet(f"{self.path}/rows").where(F.col("cell").isin(self.cells(vector, probes))).drop("cell")
        best = vector_scores(rows, vector, id_col, vector_col, self.metric).orderBy(F.desc("score"), "id").limit(k)
        return best if where is None else best.where(where)
