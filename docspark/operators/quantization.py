"""Product quantization with MLlib k-means per subspace; distances by table lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.vectors import as_doubles


class ProductQuantizer:
    """m subspaces of equal width, k centroids each; centroids are at most m x k short vectors."""

    def __init__(self, m: int = 8, k: int = 256, iterations: int = 20, seed: int = 42):
        self.m, self.k, self.iterations, self.seed = m, k, iterations, seed
        self.centroids: list[list[list[float]]] = []

    def _part(self, v: Column, i: int, width: int) -> Column:
        return F.slice(as_doubles(v), i * width + 1, width)

    def fit(self, df: DataFrame, col: str) -> ProductQuantizer:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        size = df.select(F.max(F.size(col))).first()[0]
        if not size or size % self.m:
            raise ValueError(f"dimension {size} is not a multiple of {self.m}")
        self.width, self.centroids = size // self.m, []
        for i in range(self.m):
            part = df.select(array_to_vector(self._part(F.col(col), i, self.width)).alias("features"))
            model = KMeans(k=self.k, maxIter=self.iterations, seed=self.seed).fit(part)
            self.centroids.append([c.tolist() for c in model.clusterCenters()])
        return self

    def _squares(self, part: Column, i: int) -> Column:
        table = F.lit(self.centroids[i]).cast("array<array<double>>")
        return F.transform(table, lambda c: F.aggregate(F.zip_with(c, part, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))

    def encode(self, v: Column) -> Column:
        """Index of the nearest centroid in each subspace."""
        return F.array(*[(F.array_position(d, F.array_min(d)) - 1).cast("int") for d in (self._squares(self._part(v, i, self.width), i) for i in range(self.m))])

    def decode(self, codes: Column) -> Column:
        return F.flatten(F.array(*[F.get(F.lit(self.centroids[i]).cast("array<array<double>>"), F.get(codes, i)) for i in range(self.m)]))

    def distance(self, codes: Column, query: list[float]) -> Column:
        """Asymmetric squared distance: one table lookup per subspace."""
        out = F.lit(0.0)
        for i in range(self.m):
            q = query[i * self.width : (i + 1) * self.width]
            table = [sum((a - b) ** 2 for a, b in zip(c, q, strict=True)) for c in self.centroids[i]]
            out = out + F.get(F.array(*[F.lit(x) for x in table]), F.get(codes, i))
        return out


class TurboQuantizer:
    """Codes without training: a random rotation, a Gaussian codebook of 2 to 4 bits a coordinate, and one sign bit of the residual's projection.

    After the rotation the coordinates of a unit vector are close to Gaussian whatever the data,
    so the codebook is fixed; the signs make the estimate of the inner product unbiased. Coding
    is dense matrix work, hence Arrow batches and numpy.
    """

    def __init__(self, dimensions: int, bits: int = 3, seed: int = 42):
        import numpy as np

        if bits not in (2, 3, 4):
            raise ValueError("bits is 2, 3 or 4")
        rng = np.random.default_rng(seed)
        self.dimensions, self.bits = dimensions, bits
        self.rotation = np.linalg.qr(rng.standard_normal((dimensions, dimensions)))[0]
        self.projection = rng.standard_normal((dimensions, dimensions))
        # the centroids of equal slices of a large Gaussian sample, refined by Lloyd's rule
        sample = np.sort(rng.standard_normal(200_000))
        book = np.array([s.mean() for s in np.array_split(sample, 1 << bits)])
        for _ in range(60):
            cuts = np.searchsorted(sample, (book[1:] + book[:-1]) / 2)
            book = np.array([s.mean() for s in np.split(sample, cuts)])
        self.book = book / dimensions**0.5

    def encode(self, v: Column) -> Column:
        """Struct of norm, codes (a byte a coordinate), residual's norm and its packed signs."""
        import pandas as pd

        rotation, projection, book = self.rotation, self.projection, self.book

        @F.pandas_udf("norm double, codes binary, rest double, signs binary")
        def run(vectors):
            import numpy as np

            if not len(vectors):
                return pd.DataFrame({"norm": [], "codes": [], "rest": [], "signs": []})
            x = np.stack([np.asarray(a, float) for a in vectors])
            norm = np.linalg.norm(x, axis=1)
            y = x / np.maximum(norm, 1e-300)[:, None] @ rotation.T
            codes = np.searchsorted((book[1:] + book[:-1]) / 2, y).astype(np.uint8)
            left = y - book[codes]
            signs = np.packbits(left @ projection.T > 0, axis=1)
            return pd.DataFrame({"norm": norm, "codes": [c.tobytes() for c in codes], "rest": np.linalg.norm(left, axis=1), "signs": [s.tobytes() for s in signs]})

        return run(v)

    def decode(self, codes: Column) -> Column:
        """The vector the codes stand for, without the signs' correction."""
        import pandas as pd

        rotation, book = self.rotation, self.book

        @F.pandas_udf("array<double>")
        def run(c):
            import numpy as np

            return pd.Series([(book[np.frombuffer(x, np.uint8)] @ rotation * n).tolist() for x, n in zip(c["codes"], c["norm"], strict=True)])

        return run(codes)

    def dot(self, codes: Column, query: list[float]) -> Column:
        """The estimated inner product of the coded vectors with a query."""
        import numpy as np
        import pandas as pd

        turned = self.rotation @ np.asarray(query, float)
        cast, book, d = self.projection @ turned, self.book, self.dimensions

        @F.pandas_udf("double")
        def run(c):
            if not len(c):
                return pd.Series([], dtype=float)
            code = np.stack([np.frombuffer(x, np.uint8) for x in c["codes"]])
            signs = np.unpackbits(np.stack([np.frombuffer(x, np.uint8) for x in c["signs"]]), axis=1)[:, :d] * 2.0 - 1.0
            near = book[code] @ turned
            return pd.Series(c["norm"] * (near + (np.pi / 2) ** 0.5 / d * c["rest"] * (signs @ cast)))

        return run(codes)
