"""Third-order tensors as coordinate frames (i, j, k, v)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.decomp import EPS, fnnls, nmf
from gridloom.operators.matrix import LOCAL_CELLS, Matrix, divide

AXES = ("i", "j", "k")


class Cube:
    """m x n x o cells; frontal slices are k."""

    def __init__(self, df: DataFrame, m: int, n: int, o: int):
        self.df, self.shape = df.select(*[F.col(c).cast("long").alias(c) for c in AXES], F.col("v").cast("double").alias("v")), (int(m), int(n), int(o))

    @classmethod
    def from_slices(cls, slices: Sequence[Matrix]) -> Cube:
        df = None
        for k, s in enumerate(slices):
            part = s.df.select("i", "j", F.lit(k).alias("k"), "v")
            df = part if df is None else df.unionByName(part)
        return cls(df, max(s.m for s in slices), slices[0].n, len(slices))

    @classmethod
    def from_numpy(cls, spark, x: np.ndarray) -> Cube:
        i, j, k = np.indices(x.shape)
        return cls(spark.createDataFrame(list(zip(i.ravel().tolist(), j.ravel().tolist(), k.ravel().tolist(), x.ravel().tolist())), "i long, j long, k long, v double"), *x.shape)

    def to_numpy(self) -> np.ndarray:
        if np.prod(self.shape) > LOCAL_CELLS:
            raise ValueError("too many cells to decompose locally")
        out, got = np.zeros(self.shape), self.df.toPandas()
        out[got["i"], got["j"], got["k"]] = got["v"]
        return out

    def dims(self) -> tuple[int, int, int]:
        return self.shape

    def get(self, i: int, j: int, k: int) -> float:
        m, n, o = self.shape
        return self.df.where((F.col("i") == i % m) & (F.col("j") == j % n) & (F.col("k") == k % o)).first()["v"]

    def get_slice(self, dim: int, index: int) -> Matrix:
        """2: frontal m x n; 1: lateral m x o; 0: horizontal as o x n."""
        m, n, o = self.shape
        a, b, size = {2: ("i", "j", (m, n)), 1: ("i", "k", (m, o)), 0: ("k", "j", (o, n))}[dim]
        return Matrix(self.df.where(F.col(AXES[dim]) == index % self.shape[dim]).select(F.col(a).alias("i"), F.col(b).alias("j"), "v"), *size)

    def unfold(self, mode: int) -> Matrix:
        """1: m x no, column kn + j; 2: n x mo, column km + i; 3: o x mn, column in + j."""
        m, n, o = self.shape
        row, column, size = {1: ("i", F.col("k") * n + F.col("j"), (m, n * o)), 2: ("j", F.col("k") * m + F.col("i"), (n, m * o)), 3: ("k", F.col("i") * n + F.col("j"), (o, m * n))}[mode]
        return Matrix(self.df.select(F.col(row).alias("i"), column.alias("j"), "v"), *size)

    @classmethod
    def fold(cls, a: Matrix, mode: int, m: int, n: int, o: int) -> Cube:
        if a.dims() != {1: (m, n * o), 2: (n, m * o), 3: (o, m * n)}[mode]:
            raise ValueError("dimensions differ")
        r, c = F.col("i"), F.col("j").cast("long")
        low = {1: n, 2: m, 3: n}[mode]
        minor, major = c % low, F.floor(c / low)
        i, j, k = {1: (r, minor, major), 2: (minor, r, major), 3: (major, minor, r)}[mode]
        return cls(a.df.select(i.alias("i"), j.alias("j"), k.alias("k"), "v"), m, n, o)

    def vect(self) -> Matrix:
        m, n, o = self.shape
        return Matrix(self.df.select((F.col("k") * m * n + F.col("j") * m + F.col("i")).alias("i"), F.lit(0).alias("j"), "v"), m * n * o, 1)

    @classmethod
    def unvect(cls, a: Matrix, m: int, n: int, o: int) -> Cube:
        r = F.col("i")
        return cls(a.df.select((r % m).alias("i"), (F.floor(r / m) % n).alias("j"), F.floor(r / (m * n)).alias("k"), "v"), m, n, o)

    def _pairwise(self, b: Cube, how: str, f: Callable[[Column, Column], Column]) -> Cube:
        if self.shape != b.shape:
            raise ValueError("dimensions differ")
        both = self.df.join(b.df.select(*AXES, F.col("v").alias("w")), list(AXES), how)
        return Cube(both.select(*AXES, f(F.coalesce("v", F.lit(0.0)), F.coalesce("w", F.lit(0.0))).alias("v")), *self.shape)

    def _cells(self, f: Callable[[Column], Column]) -> Cube:
        return Cube(self.df.withColumn("v", f(F.col("v"))), *self.shape)

    def add(self, b: Cube | float) -> Cube:
        return self._pairwise(b, "full", lambda x, y: x + y) if isinstance(b, Cube) else self._cells(lambda x: x + float(b))

    def subtract(self, b: Cube | float, reverse: bool = False) -> Cube:
        if isinstance(b, Cube):
            return self._pairwise(b, "full", lambda x, y: y - x if reverse else x - y)
        return self._cells(lambda x: float(b) - x if reverse else x - float(b))

    def multiply_elementwise(self, b: Cube) -> Cube:
        return self._pairwise(b, "inner", lambda x, y: x * y)

    def divide_elementwise(self, value: float, reverse: bool = False) -> Cube:
        return self._cells(lambda x: divide(F.lit(float(value)), x) if reverse else x / float(value))

    def multiply_with_matrix(self, mode: int, a: Matrix) -> Cube:
        """The mode-n product: axis `mode` is contracted with the columns of a."""
        axis = AXES[mode - 1]
        if a.n != self.shape[mode - 1]:
            raise ValueError("dimensions differ")
        right = a.df.select(F.col("i").alias("r"), F.col("j").cast("long").alias("c"), F.col("v").alias("w"))
        keep = [F.col(x) if x != axis else F.col("r").alias(x) for x in AXES]
        product = self.df.join(right, F.col(axis) == F.col("c")).groupBy(*keep).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
        return Cube(product, *[a.m if n == mode - 1 else s for n, s in enumerate(self.shape)])

    def as_string(self, sep: str = "\t") -> str:
        x = self.to_numpy()
        return "\n".join("".join(f"{sep}{v:.15g}" for v in x[i, :, k]) for k in range(x.shape[2]) for i in range(x.shape[0])) + "\n"

    __str__ = as_string

    def apply(self, f: Callable[[Column], Column]) -> Cube:
        return self._cells(f)

    def _over(self, mode: int, f: Callable) -> Matrix:
        m, n, o = self.shape
        a, b, size = {3: ("i", "j", (m, n)), 2: ("i", "k", (m, o)), 1: ("k", "j", (o, n))}[mode]
        return Matrix(self.df.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(f("v").alias("v")).select(F.col("_a").alias("i"), F.col("_b").alias("j"), "v"), *size)

    def max(self, mode: int) -> Matrix:
        return self._over(mode, F.max)

    def min(self, mode: int) -> Matrix:
        return self._over(mode, F.min)

    def frobenius_norm(self) -> DataFrame:
        return self.df.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("v"))

    __add__, __sub__, __mul__ = add, subtract, multiply_elementwise

    def __truediv__(self, b):
        return self.divide_elementwise(b)


def unfolded(x: np.ndarray, mode: int) -> np.ndarray:
    return np.moveaxis(x, mode, 0).reshape(x.shape[mode], -1)


def khatri_rao(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, None, :] * b[None, :, :]).reshape(-1, a.shape[1])


def leading(x: np.ndarray, k: int) -> np.ndarray:
    return np.linalg.svd(x, full_matrices=False)[0][:, :k]


def compose(core: np.ndarray, factors: Sequence[np.ndarray]) -> np.ndarray:
    return np.einsum("pqr,ip,jq,kr->ijk", core, *factors)


def hosvd(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    factors = [leading(unfolded(x, n), min(x.shape[n], x.size // x.shape[n])) for n in range(3)]
    return np.einsum("ijk,ip,jq,kr->pqr", x, *factors), factors


def cp(x: np.ndarray, k: int, nonnegative: bool = False, rounds: int = 2500, seed: int = 0, symmetric: bool = False, start: Sequence[np.ndarray] | None = None) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Alternating least squares (non-negative: row by row); unit-length columns, their weights, squared error.

    symmetric: the second mode's factor is the first's; start: the first factors, random by seed without.
    """
    draw = np.random.default_rng(seed)
    factors = [draw.random((s, k)) for s in x.shape] if start is None else [np.array(f, dtype=float) for f in start]
    weights, before = np.ones(k), np.inf
    for _ in range(rounds):
        for n in range(3):
            if symmetric and n == 1:
                factors[1] = factors[0]
                continue
            a, b = [factors[q] for q in range(3) if q != n]
            gram, right = (a.T @ a) * (b.T @ b), unfolded(x, n) @ khatri_rao(a, b)
            new = np.stack([fnnls(gram, r) for r in right]) if nonnegative else right @ np.linalg.pinv(gram)
            weights = np.linalg.norm(new, axis=0)
            factors[n] = new / np.where(weights == 0, 1.0, weights)
        error = float(((x - np.einsum("r,ir,jr,kr->ijk", weights, *factors)) ** 2).sum())
        if abs(before - error) <= 1e-6 * max(error, 1e-12):
            break
        before = error
    return factors, weights, error


def ccd(x: np.ndarray, factors: Sequence[np.ndarray], weights: np.ndarray) -> float:
    """Core consistency in percent."""
    a, b, c = factors
    core = np.einsum("ijk,pi,qj,rk->pqr", x, np.linalg.pinv(a * weights), np.linalg.pinv(b), np.linalg.pinv(c))
    ideal = np.zeros_like(core)
    np.einsum("iii->i", ideal)[:] = 1.0
    return float(100 * (1 - ((ideal - core) ** 2).sum() / (ideal**2).sum()))


def tucker(x: np.ndarray, ranks: Sequence[int], rounds: int = 1000) -> tuple[np.ndarray, list[np.ndarray]]:
    factors = [leading(unfolded(x, n), ranks[n]) for n in range(3)]
    before = np.inf
    for _ in range(rounds):
        for n in range(3):
            part = x
            for q in range(3):
                if q != n:
                    part = np.moveaxis(np.tensordot(factors[q].T, part, (1, q)), 0, q)
            factors[n] = leading(unfolded(part, n), ranks[n])
        core = np.einsum("ijk,ip,jq,kr->pqr", x, *factors)
        error = float(((x - compose(core, factors)) ** 2).sum())
        if abs(before - error) <= 1e-6 * max(error, 1e-12):
            break
        before = error
    return core, factors


def ntd(x: np.ndarray, ranks: Sequence[int], rounds: int = 2500, seed: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
    """Non-negative Tucker by multiplicative updates."""
    draw = np.random.default_rng(seed)
    factors, core, before = [draw.random((s, r)) for s, r in zip(x.shape, ranks)], draw.random(tuple(ranks)), np.inf
    for _ in range(rounds):
        for n in range(3):
            part = core
            for q in range(3):
                if q != n:
                    part = np.moveaxis(np.tensordot(factors[q], part, (1, q)), 0, q)
            s = unfolded(part, n)
            new = factors[n] * (unfolded(x, n) @ s.T) / (factors[n] @ (s @ s.T) + EPS)
            norm = np.linalg.norm(new, axis=0)
            factors[n] = new / np.where(norm == 0, 1.0, norm)
            core = np.moveaxis(np.moveaxis(core, n, -1) * norm, -1, n)
        grams = [f.T @ f for f in factors]
        core = core * np.einsum("ijk,ip,jq,kr->pqr", x, *factors) / (np.einsum("abc,pa,qb,rc->pqr", core, *grams) + EPS)
        error = float(((x - compose(core, factors)) ** 2).sum())
        if abs(before - error) <= 1e-6 * max(error, 1e-12):
            break
        before = error
    return core, factors


def tcc(first: Sequence[np.ndarray], second: Sequence[np.ndarray]) -> np.ndarray:
    """Tucker congruence: the product over modes of the cosines between factor columns."""
    out = 1.0
    for a, b in zip(first, second):
        out = out * ((a / np.linalg.norm(a, axis=0)).T @ (b / np.linalg.norm(b, axis=0)))
    return out


def rescal(x: np.ndarray, k: int, rounds: int = 2500) -> tuple[np.ndarray, np.ndarray]:
    """X_p ~ A R_p A'."""
    total = sum(x[:, :, p] + x[:, :, p].T for p in range(x.shape[2]))
    a = np.linalg.eigh(total)[1][:, ::-1][:, :k]
    before = np.inf
    for _ in range(rounds):
        u, s, vt = np.linalg.svd(a, full_matrices=False)
        shrink = np.outer(s, s) / (np.outer(s, s) ** 2 + EPS)
        r = np.stack([vt.T @ (shrink * (u.T @ x[:, :, p] @ u)) @ vt for p in range(x.shape[2])], axis=2)
        error = sum(((x[:, :, p] - a @ r[:, :, p] @ a.T) ** 2).sum() for p in range(x.shape[2]))
        if abs(before - error) <= 1e-6 * max(error, 1e-12):
            break
        before, gram = error, a.T @ a
        top = sum(x[:, :, p] @ a @ r[:, :, p].T + x[:, :, p].T @ a @ r[:, :, p] for p in range(x.shape[2]))
        low = sum(r[:, :, p] @ gram @ r[:, :, p].T + r[:, :, p].T @ gram @ r[:, :, p] for p in range(x.shape[2]))
        a = top @ np.linalg.pinv(low)
    return a, r


def parafac2(slices: Sequence[np.ndarray], k: int, rounds: int = 2500) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, float]:
    """X_p ~ U_p H S_p V' with orthonormal U_p; slices may differ in rows."""
    v = np.linalg.eigh(sum(s.T @ s for s in slices))[1][:, ::-1][:, :k]
    h, s, before = np.eye(k), np.ones((len(slices), k)), np.inf
    for _ in range(rounds):
        us = []
        for p, x in enumerate(slices):
            left, _, right = np.linalg.svd(x @ v @ np.diag(s[p]) @ h.T, full_matrices=False)
            us.append(left @ right)
        y = np.stack([u.T @ x for u, x in zip(us, slices)], axis=2)
        h = unfolded(y, 0) @ khatri_rao(v, s) @ np.linalg.pinv((v.T @ v) * (s.T @ s))
        v = unfolded(y, 1) @ khatri_rao(h, s) @ np.linalg.pinv((h.T @ h) * (s.T @ s))
        s = unfolded(y, 2) @ khatri_rao(h, v) @ np.linalg.pinv((h.T @ h) * (v.T @ v))
        error = sum(((x - u @ h @ np.diag(s[p]) @ v.T) ** 2).sum() for p, (x, u) in enumerate(zip(slices, us)))
        if abs(before - error) <= 1e-6 * max(error, 1e-12):
            break
        before = error
    return us, h, s, v, float(error)


__all__ = ["Cube", "ccd", "compose", "cp", "hosvd", "nmf", "ntd", "parafac2", "rescal", "tcc", "tucker"]
