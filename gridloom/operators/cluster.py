"""Fuzzy c-means, k-means and Gaussian mixtures over row frames (i, x ARRAY<DOUBLE>).

Models hold clusters times dimensions numbers and travel to the tasks; data stay in Spark, where each task sums what a
step needs before the shuffle.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_frame(df: DataFrame, index: str, vector: str) -> DataFrame:
    return df.select(F.col(index).cast("long").alias("i"), F.transform(vector, lambda v: v.cast("double")).alias("x"))


# fuzzy c-means: memberships (c, i, u), prototypes (c, j, p)


def initialize_partition(rows: DataFrame, clusters: int, seed: int = 0) -> DataFrame:
    """Memberships by hash of seed, row and cluster, scaled to sum 1 in each row."""
    each = rows.select("i", F.explode(F.sequence(F.lit(0), F.lit(clusters - 1))).alias("c"))
    raw = each.withColumn("u", (F.pmod(F.xxhash64(F.lit(seed), "i", "c"), F.lit(1 << 30)) + 1) / float(1 << 30))
    return raw.withColumn("u", F.col("u") / F.sum("u").over(Window.partitionBy("i")))


def get_prototypes(rows: DataFrame, memberships: DataFrame, fuzz: float = 2.0) -> DataFrame:
    cells = rows.select("i", F.posexplode("x").alias("j", "v"))
    weight = F.pow("u", F.lit(float(fuzz)))
    return memberships.join(cells, "i").groupBy("c", "j").agg((F.sum(weight * F.col("v")) / F.sum(weight)).alias("p"))


def prototype_distances(rows: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Euclidean distance (i, c, d) of every row to every prototype."""
    cells = rows.select("i", F.posexplode("x").alias("j", "v"))
    return cells.join(F.broadcast(prototypes), "j").groupBy("i", "c").agg(F.sqrt(F.sum((F.col("v") - F.col("p")) * (F.col("v") - F.col("p")))).alias("d"))  # clusters times dimensions


def mahalanobis_distances(rows: DataFrame, memberships: DataFrame, prototypes: DataFrame) -> DataFrame:
    """sqrt(det) times the squared Mahalanobis distance under each cluster's fuzzy covariance."""
    p = {}
    for r in prototypes.collect():  # clusters times dimensions
        p.setdefault(r["c"], {})[r["j"]] = r["p"]
    centre = {c: np.array([v[j] for j in sorted(v)]) for c, v in p.items()}

    def partial(frames):
        import pandas as pd

        total: dict = {}
        for frame in frames:
            for c, x, u in zip(frame["c"], frame["x"], frame["u"]):
                d = np.asarray(x) - centre[c]
                s = total.setdefault(c, [0.0, np.zeros((len(d), len(d)))])
                s[0] += u * u
                s[1] += u * u * np.outer(d, d)
        yield pd.DataFrame([(c, w, s.ravel().tolist()) for c, (w, s) in total.items()], columns=["c", "w", "s"])

    sums: dict = {}
    for r in memberships.join(rows, "i").select("c", "x", "u").mapInPandas(partial, "c int, w double, s array<double>").collect():  # tasks times clusters
        w, s = sums.get(r["c"], (0.0, 0.0))
        sums[r["c"]] = w + r["w"], s + np.array(r["s"])
    model = {}
    for c, (w, s) in sums.items():
        cov = s.reshape(len(centre[c]), -1) / w
        det = np.linalg.det(cov)
        if det > 0:
            model[c] = math.sqrt(det), np.linalg.inv(cov)

    def measure(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for i, x in zip(frame["i"], frame["x"]):
                for c, (root, inverse) in model.items():
                    d = np.asarray(x) - centre[c]
                    out.append((i, c, float(root * d @ inverse @ d)))
            yield pd.DataFrame(out, columns=["i", "c", "d"])

    return rows.mapInPandas(measure, "i long, c int, d double")


def weighted_manhattan_distances(rows: DataFrame, memberships: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Distances (i, c, d) by absolute differences, each column weighted by the fuzzy mean of its differences."""
    cells = rows.select("i", F.posexplode("x").alias("j", "v")).join(F.broadcast(prototypes), "j")  # clusters times dimensions
    apart = cells.select("i", "c", "j", F.abs(F.col("v") - F.col("p")).alias("a"))
    weight = F.col("u") * F.col("u")
    spread = apart.join(memberships, ["i", "c"]).groupBy("c", "j").agg((F.sum(weight * F.col("a")) / F.sum(weight)).alias("s"))
    scaled = apart.join(F.broadcast(spread), ["c", "j"])
    return scaled.groupBy("i", "c").agg(F.sum(F.when(F.col("s") > 0, F.col("a") / F.nullif(F.col("s"), F.lit(0.0))).otherwise(0.0)).alias("d"))


def get_distances(rows: DataFrame, memberships: DataFrame, prototypes: DataFrame, measure: int = 0) -> DataFrame:
    """0: Euclidean, 1: Mahalanobis by cluster, 2: weighted Manhattan."""
    if measure == 1:
        return mahalanobis_distances(rows, memberships, prototypes)
    return weighted_manhattan_distances(rows, memberships, prototypes) if measure == 2 else prototype_distances(rows, prototypes)


def update_partition(distances: DataFrame, fuzz: float = 2.0) -> DataFrame:
    """u = 1 / sum (d_c / d_k)^(2 / (fuzz - 1)) over non-zero d_k; 1 where d is 0."""
    e = 2.0 / (fuzz - 1.0)
    rest = F.sum(F.when(F.col("d") > 0, F.pow(F.col("d"), F.lit(-e)))).over(Window.partitionBy("i"))
    return distances.select("c", "i", F.when(F.col("d") == 0, 1.0).otherwise(F.pow(F.col("d"), F.lit(-e)) / rest).alias("u"))


def fuzzy_cmeans(rows: DataFrame, clusters: int = 2, rounds: int = 1000, tol: float = 0.01, fuzz: float = 2.0, seed: int = 0, write=None, measure: int = 0, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Memberships, prototypes and rounds; measure as in get_distances, start: the first memberships; write cuts lineage."""
    write = write or (lambda df: df.checkpoint())
    u = write(initialize_partition(rows, clusters, seed) if start is None else start)
    for step in range(1, rounds + 1):
        p = get_prototypes(rows, u, fuzz)
        new = write(update_partition(get_distances(rows, u, p, measure), fuzz))
        shift = new.join(u.withColumnRenamed("u", "o"), ["c", "i"]).agg(F.max(F.abs(F.col("u") - F.col("o")))).first()[0]
        u = new
        if shift is None or shift < tol:
            break
    return u, get_prototypes(rows, u, fuzz), step


# k-means


def assign(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """(i, x, c): the nearest centre, ties to the smallest number."""

    def nearest(frames):
        for frame in frames:
            x = np.stack(frame["x"].to_numpy()) if len(frame) else np.zeros((0, centres.shape[1]))
            yield frame.assign(c=((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1))

    return rows.mapInPandas(nearest, "i long, x array<double>, c int")


def kmeans_step(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Means of the rows nearest to each centre; empty clusters become 0."""
    found = assign(rows, centres).select("c", F.posexplode("x").alias("j", "v")).groupBy("c", "j").agg(F.avg("v").alias("v")).collect()  # clusters times dimensions
    out = np.zeros_like(centres)
    for r in found:
        out[r["c"], r["j"]] = r["v"]
    return out


def kmeans(rows: DataFrame, clusters: int, rounds: int = 100, seed: int = 0, centres: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    centres = seeds(rows, clusters, seed) if centres is None else centres
    for _ in range(rounds):
        new = kmeans_step(rows, centres)
        done, centres = np.abs(new - centres).max() < 1e-16, new
        if done:
            break
    return assign(rows, centres).select("i", "c"), centres


def seeds(rows: DataFrame, clusters: int, seed: int = 0) -> np.ndarray:
    """The rows of the smallest hashes."""
    return np.array([r["x"] for r in rows.orderBy(F.xxhash64(F.lit(seed), "i"), "i").limit(clusters).collect()])


# Gaussian mixtures


class GaussianMixture:
    """Expectation maximisation with full or diagonal covariances."""

    def __init__(self, rows: DataFrame, clusters: int, covariance: str = "full", rounds: int = 100, priors=None, seed: int = 0):
        self.rows, self.k, self.covariance, self.rounds, self.seed = rows, clusters, covariance, rounds, seed
        self.priors = np.full(clusters, 1.0 / clusters) if priors is None else np.asarray(priors, dtype=float)
        if self.priors.sum() < 0.999999:
            raise ValueError("priors must sum to 1")
        self.means = self.covariances = None

    def cluster_means(self) -> DataFrame:
        """(c, j, v)"""
        return self._cells(self.means)

    def cluster_covariances(self) -> DataFrame:
        """(c, j, k, v)"""
        rows = [(c, j, k, float(cov[j, k])) for c, cov in enumerate(self.covariances) for j in range(len(cov)) for k in range(len(cov))]
        return self.rows.sparkSession.createDataFrame(rows, "c int, j int, k int, v double")

    def cluster_priors(self) -> DataFrame:
        """(c, v)"""
        return self.rows.sparkSession.createDataFrame([(c, float(p)) for c, p in enumerate(self.priors)], "c int, v double")

    def cluster_memberships(self) -> DataFrame:
        """(i, c, v): the posterior of every cluster for every row."""
        logs = self.posterior_log_likelihoods()
        top = F.array_max("l")
        total = F.aggregate("l", F.lit(0.0), lambda a, x: a + F.exp(x - top))
        return logs.select("i", F.posexplode(F.transform("l", lambda x: F.exp(x - top) / total)).alias("c", "v"))

    def _cells(self, x: np.ndarray) -> DataFrame:
        return self.rows.sparkSession.createDataFrame([(c, j, float(v)) for c, row in enumerate(x) for j, v in enumerate(row)], "c int, j int, v double")

    def initialize(self, method: str = "random") -> GaussianMixture:
        n = len(self.rows.first()["x"])
        self.means = kmeans(self.rows, self.k, self.rounds, self.seed)[1] if method == "kmeans" else seeds(self.rows, self.k, self.seed)
        one = moments(self.rows, lambda x: np.ones((len(x), 1)), 1, n)
        mean = one[1][0] / one[0][0]
        cov = one[2][0] / one[0][0] - np.outer(mean, mean)
        self.covariances = np.stack([self._shape(cov)] * self.k)
        return self

    def _shape(self, cov: np.ndarray) -> np.ndarray:
        return np.diag(np.diag(cov)) if self.covariance == "diagonal" else cov

    @property
    def densities(self):
        """A function from rows to the log of prior times density (row, cluster); it holds the model only."""
        priors, means, covariances = self.priors, self.means, self.covariances

        def logs(x: np.ndarray) -> np.ndarray:
            out = np.empty((len(x), len(priors)))
            for c, cov in enumerate(covariances):
                if np.linalg.det(cov) <= 1e-16:
                    cov = cov + 0.1 * max(np.diag(cov).max(), 1e-12) * np.eye(len(cov))
                d = x - means[c]
                out[:, c] = math.log(max(priors[c], 1e-300)) - 0.5 * (np.einsum("ab,bc,ac->a", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1] + len(cov) * math.log(2 * math.pi))
            return out

        return logs

    def expectation_maximization(self) -> GaussianMixture:
        before = None
        n = self.means.shape[1]
        for _ in range(self.rounds):
            own = self.densities

            def share(x):
                logs = own(x)
                return np.exp(logs - logs.max(axis=1, keepdims=True)) / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)

            weight, first, second = moments(self.rows, share, self.k, n)
            safe = np.maximum(weight, 1e-300)
            self.priors, self.means = weight / weight.sum(), first / safe[:, None]
            self.covariances = np.stack([self._shape(second[c] / safe[c] - np.outer(self.means[c], self.means[c])) for c in range(self.k)])
            now = self.log_likelihood()
            if before is not None and abs(1 - now / before) <= 1e-9:
                break
            before = now
        return self

    def log_likelihood(self) -> float:
        own = self.densities

        def each(frames):
            import pandas as pd

            for frame in frames:
                if len(frame):
                    logs = own(np.stack(frame["x"].to_numpy()))
                    top = logs.max(axis=1)
                    yield pd.DataFrame({"l": [float((top + np.log(np.exp(logs - top[:, None]).sum(axis=1))).sum())]})

        return self.rows.mapInPandas(each, "l double").agg(F.sum("l")).first()[0]

    def posterior_log_likelihoods(self, compat: bool = False) -> DataFrame:
        """(i, l): of each cluster; compat leaves the determinant out."""
        own, means, covs, priors, k = self.densities, self.means, self.covariances, self.priors, self.k

        def each(frames):
            for frame in frames:
                x = np.stack(frame["x"].to_numpy()) if len(frame) else np.zeros((0, means.shape[1]))
                logs = np.stack([-0.5 * np.einsum("ab,bc,ac->a", x - means[c], np.linalg.inv(covs[c]), x - means[c]) + math.log(priors[c]) for c in range(k)], axis=1) if compat else own(x)
                yield frame[["i"]].assign(l=logs.tolist())

        return self.rows.mapInPandas(each, "i long, l array<double>")

    def naive_bayes_classifier(self) -> DataFrame:
        """(i, c): the likeliest cluster, the first of equals."""
        return self.posterior_log_likelihoods().select("i", (F.array_position("l", F.array_max("l")) - 1).cast("int").alias("c"))


def moments(rows: DataFrame, share, clusters: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, weighted sums and weighted outer products of all rows; each task sends one row a cluster."""

    def partial(frames):
        import pandas as pd

        w, s, q = np.zeros(clusters), np.zeros((clusters, n)), np.zeros((clusters, n, n))
        for frame in frames:
            if len(frame):
                x = np.stack(frame["x"].to_numpy())
                u = share(x)
                w, s, q = w + u.sum(axis=0), s + u.T @ x, q + np.einsum("ac,ai,aj->cij", u, x, x)
        yield pd.DataFrame({"c": range(clusters), "w": w, "s": s.tolist(), "q": q.reshape(clusters, -1).tolist()})

    w, s, q = np.zeros(clusters), np.zeros((clusters, n)), np.zeros((clusters, n * n))
    for r in rows.mapInPandas(partial, "c int, w double, s array<double>, q array<double>").collect():  # tasks times clusters
        w[r["c"]] += r["w"]
        s[r["c"]] += r["s"]
        q[r["c"]] += r["q"]
    return w, s, q.reshape(clusters, n, n)
