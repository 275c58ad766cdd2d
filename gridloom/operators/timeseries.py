"""Time series as matrices: rows are time points, columns are variables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.matrix import SMALL_STD, Matrix


class TimeSeries(Matrix):
    """A Matrix whose rows are times; windows are partitioned by variable."""

    @classmethod
    def of(cls, a: Matrix) -> TimeSeries:
        return cls(a.df, a.m, a.n)

    def tdiff(self, k: int = 1) -> TimeSeries:
        """x(t) - x(t - k), 0 in the first k rows."""
        if not 0 <= k < self.m:
            raise ValueError("0 <= k < rows is needed")
        if k == 0:
            return self
        before = F.lag("v", k).over(Window.partitionBy("j").orderBy("i"))
        return TimeSeries(self.df.withColumn("v", F.coalesce(F.col("v") - before, F.lit(0.0))), self.m, self.n)

    def moving_average(self, width: int) -> TimeSeries:
        """Centred means of an odd width; the edges are dropped."""
        if width % 2 == 0 or width > self.m:
            raise ValueError("an odd width of at most the rows is needed")
        half = width // 2
        mean = F.avg("v").over(Window.partitionBy("j").orderBy("i").rowsBetween(-half, half))
        inside = self.df.withColumn("v", mean).where(F.col("i").between(half, self.m - 1 - half))
        return TimeSeries(inside.withColumn("i", F.col("i") - half), self.m - width + 1, self.n)

    def detrend(self, p: int = 1) -> TimeSeries:
        """Residuals of a least-squares polynomial of degree p in t / n, t from 1."""
        t = (F.col("i") + 1) / float(self.m)
        if p == 0:
            return TimeSeries(self._centred(), self.m, self.n)
        if p == 1:
            fit = self.df.withColumn("t", t).groupBy("j").agg(F.regr_slope("v", "t").alias("b"), F.regr_intercept("v", "t").alias("a"))
            return TimeSeries(self.df.join(fit, "j").select("i", "j", (F.col("v") - F.col("a") - F.col("b") * t).alias("v")), self.m, self.n)
        # the power sums of each variable are aggregated; only (p + 1)^2 numbers a variable are solved
        powers = [F.pow(t, F.lit(k)) for k in range(2 * p + 1)]
        sums = self.df.groupBy("j").agg(F.array(*[F.sum(x) for x in powers]).alias("s"), F.array(*[F.sum(x * F.col("v")) for x in powers[: p + 1]]).alias("b"))

        def solve(frames):
            for frame in frames:
                out = []
                for s, b in zip(frame["s"], frame["b"]):
                    out.append(np.linalg.lstsq(np.array([[s[r + c] for c in range(p + 1)] for r in range(p + 1)]), np.array(b), rcond=None)[0].tolist())
                yield frame[["j"]].assign(c=out)

        fitted = sums.mapInPandas(solve, "j int, c array<double>")
        trend = sum((F.col("c")[k] * powers[k] for k in range(p + 1)), F.lit(0.0))
        return TimeSeries(self.df.join(fitted, "j").select("i", "j", (F.col("v") - trend).alias("v")), self.m, self.n)

    def _centred(self) -> DataFrame:
        return self.by_column(F.avg("v").alias("a")).select("i", "j", (F.col("v") - F.col("a")).alias("v"))

    def autocovariance(self, lags: int | None = None) -> Matrix:
        """Sums of centred products at lags 0 to lags - 1, not divided."""
        k = self.m - 1 if lags is None else lags
        x = self._centred()
        later = x.select(F.col("i").alias("t"), F.col("j").alias("c"), F.col("v").alias("w"))
        each = x.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        both = each.join(later, (F.col("i") + F.col("lag") == F.col("t")) & (F.col("j") == F.col("c")))
        return Matrix(both.groupBy(F.col("lag").alias("i"), "j").agg(F.sum(F.col("v") * F.col("w")).alias("v")), k, self.n)

    def autocorrelation(self, lags: int | None = None) -> Matrix:
        """Autocovariance over its value at lag 0; deviations up to 5e-13 count as 1."""
        cov = self.autocovariance(lags)
        std = self.df.groupBy("j").agg(F.stddev_pop("v").alias("s"))
        scale = F.when(F.col("s") <= SMALL_STD, 1.0).otherwise(F.col("s") * F.col("s") * self.m)
        return Matrix(cov.df.join(std, "j").select("i", "j", (F.col("v") / scale).alias("v")), cov.m, cov.n)

    def crosscovariance(self, b: Matrix, lag: int = 0, wrap: bool = False) -> Matrix:
        """Means over the rows of products of centred values, b at i + lag; wrap: modulo its rows for positive lags."""
        other = TimeSeries.of(b)._centred().select(F.col("i").alias("t"), F.col("j").alias("c"), F.col("v").alias("w"))
        at = F.col("i") + lag
        both = self._centred().withColumn("at", at % b.m if wrap and lag > 0 else at).join(other, F.col("at") == F.col("t"))
        return Matrix(both.groupBy(F.col("j").alias("i"), F.col("c").alias("j")).agg((F.sum(F.col("v") * F.col("w")) / self.m).alias("v")), self.n, b.n)

    def crosscorrelation(self, b: Matrix, lag: int = 0, wrap: bool = False) -> Matrix:
        """Crosscovariance over the root of both population variances."""
        cov = self.crosscovariance(b, lag, wrap)
        vx = self.df.groupBy(F.col("j").alias("x")).agg(F.var_pop("v").alias("vx"))
        vy = b.df.groupBy(F.col("j").alias("y")).agg(F.var_pop("v").alias("vy"))
        both = cov.df.join(vx, F.col("i") == F.col("x")).join(vy, F.col("j") == F.col("y"))
        return Matrix(both.select("i", "j", (F.col("v") / F.sqrt(F.col("vx") * F.col("vy"))).alias("v")), cov.m, cov.n)


def warp(x: np.ndarray, y: np.ndarray, derivative: bool = False) -> tuple[list[tuple[int, int]], float]:
    """Symmetric dynamic time warping of two series (rows are times): the path (times from 1) and its cost by its length.

    Both series are padded by their first row in front and their last behind. From the pads in front, a diagonal step
    costs the distance, a step along one series a quarter of the distances it spans, steps along a border half of
    theirs; ties prefer the diagonal, then x. With derivative, distances off the borders are those of the slopes.
    """

    def slope(z: np.ndarray) -> np.ndarray:
        before, after = np.vstack([z[:1], z[:-1]]), np.vstack([z[1:], z[-1:]])
        return ((z - before) + (after - before) / 2) / 2

    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))

    px, py = np.vstack([x[:1], x, x[-1:]]), np.vstack([y[:1], y, y[-1:]])
    plain = distances(px, py)
    d = distances(slope(px), slope(py)) if derivative else plain
    m, n = len(x), len(y)
    cost, step = np.zeros((m + 1, n + 1)), np.zeros((m + 1, n + 1), dtype=int)
    cost[1:, 0], step[1:, 0] = np.cumsum(plain[1 : m + 1, 0] / 2), 1
    cost[0, 1:], step[0, 1:] = np.cumsum(plain[0, 1 : n + 1] / 2), 3
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            options = ((cost[i - 1, j - 1] + d[i, j], 2), (cost[i - 1, j] + (d[i, j] + d[i, j + 1]) / 4, 1), (cost[i, j - 1] + (d[i, j] + d[i + 1, j]) / 4, 3))
            cost[i, j], step[i, j] = min(options, key=lambda o: o[0])
    path, i, j = [], m, n
    while i or j:
        path.append((max(i, 1), max(j, 1)))
        s = step[i, j]
        i, j = i - (s in (1, 2)), j - (s in (2, 3))
    return path[::-1], float(cost[-1, -1] / max(1, len(path)))


def align(pairs: DataFrame, derivative: bool = False) -> DataFrame:
    """(pair, score, alignment) of pairs of series given as (pair, x, y) with arrays of rows; every pair is one call.

    alignment: the times of x, a line end, the times of y.
    """

    def one(frames):
        for frame in frames:
            found = [warp(np.array(list(map(list, x))), np.array(list(map(list, y))), derivative) for x, y in zip(frame["x"], frame["y"])]
            lines = ["\n".join(" ".join(str(p[side]) for p in path) for side in (0, 1)) for path, _ in found]
            yield frame[["pair"]].assign(score=[score for _, score in found], alignment=lines)

    return pairs.mapInPandas(one, "pair long, score double, alignment string")
