"""Kernels over rows of a matrix and over graphs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import decomp
from gridloom.operators.matrix import Matrix


class Kernel(Matrix):
    """A square Matrix of similarities."""

    def __init__(self, df, m: int, n: int | None = None):
        super().__init__(df, m, m if n is None else n)
        if self.m != self.n:
            raise ValueError("not square")

    @classmethod
    def compute_from_matrix(cls, a: Matrix, kind: str, param: float | None = None) -> Kernel:
        """linear: XX'; RBF: exp(-d2 / param); graph kernels CT, VN, RF, RWR, RCT of an adjacency matrix."""
        if kind == "linear":
            k = a.row_pairs(lambda x, y: x @ y.T)
        elif kind == "RBF":
            k = a.get_distances("euclidean")
            k = Matrix(k.df.withColumn("v", F.exp(-F.col("v") / float(param))), k.m, k.n)
        else:
            k = Matrix.from_array(a.df.sparkSession, graph_kernel(a.to_numpy(), kind, param))
        return cls(k.df, k.m)

    @classmethod
    def compute_from_graph(cls, graph, kind: str, param: float | None = None) -> Kernel:
        if not graph.is_connected():
            raise ValueError("the graph is not connected")
        return cls.compute_from_matrix(graph.get_adjacency_matrix(), kind, param)

    def get_distance_matrix(self) -> Matrix:
        """Squared distances K_ii + K_jj - 2 K_ij."""
        d = self.df.where("i = j").select(F.col("i").alias("k"), F.col("v").alias("d"))
        both = self.df.join(d.withColumnRenamed("d", "di"), F.col("i") == F.col("k")).drop("k").join(d.withColumnRenamed("d", "dj"), F.col("j") == F.col("k"))
        return Matrix(both.select("i", "j", (F.col("di") + F.col("dj") - 2 * F.col("v")).alias("v")), self.m, self.n)

    def center(self) -> Kernel:
        """K less its column means of both sides, plus the grand mean."""
        means = self.df.groupBy("j").agg(F.avg("v").alias("c"))
        grand = self.df.agg(F.avg("v").alias("g"))  # one row
        both = self.df.join(means, "j").join(means.select(F.col("j").alias("r"), F.col("c").alias("d")), F.col("i") == F.col("r")).join(F.broadcast(grand), F.lit(True))
        return Kernel(both.select("i", "j", (F.col("v") - F.col("c") - F.col("d") + F.col("g")).alias("v")), self.m)

    def diffusion_map(self, k: int) -> Matrix:
        """Leading eigenvectors of the column-normalised, transposed kernel, the trivial one included."""
        scaled = self.df.withColumn("v", F.col("v") / F.sum("v").over(Window.partitionBy("j")))
        x = Matrix(scaled, self.m, self.n).transpose().to_numpy()
        values, vectors = np.linalg.eig(x)
        order = np.argsort(-values.real, kind="stable")[:k]
        return Matrix.from_array(self.df.sparkSession, decomp.canonical(vectors.real[:, order]))


def graph_kernel(a: np.ndarray, kind: str, param: float | None = None) -> np.ndarray:
    degree, one = np.diag(a.sum(axis=0)), np.eye(len(a))
    if kind == "CT":
        return np.linalg.pinv(degree - a)
    if kind == "VN":
        gamma = 1 / (2 * np.abs(np.linalg.eigvals(a)).max()) if param is None else param
        return np.linalg.inv(one - gamma * a)
    if kind == "RF":
        return np.linalg.inv(one + degree - a)
    alpha = 0.99 if param is None else param
    if kind == "RWR":
        return np.linalg.inv(degree - alpha * a) @ degree
    if kind == "RCT":
        return np.linalg.inv(degree - alpha * a)
    raise ValueError(f"no kernel {kind}")
