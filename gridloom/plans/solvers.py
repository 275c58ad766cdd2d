"""Registered queries of solvers and estimators, on inputs for which SQL has a closed form or a plain recursion."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import cluster, decomp, sequences, tensor, timeseries
from gridloom.operators.graph import Graph
from gridloom.operators.kernels import Kernel
from gridloom.operators.matrix import Matrix, rounded
from gridloom.operators.tensor import Cube
from gridloom.operators.timeseries import TimeSeries
from gridloom.plans import inputs
from gridloom.plans.inputs import A, C, G, M, T
from gridloom.sources.container import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], SQL[name] = make, sql


def cells(a: Matrix, digits: int = 6) -> DataFrame:
    return a.df.select(F.col("i").cast("long").alias("i"), F.col("j").cast("int").alias("j"), F.round("v", digits).alias("v"))


def table(s: SparkSession, x, digits: int = 6) -> DataFrame:
    return cells(Matrix.from_array(s, np.atleast_2d(np.asarray(x, dtype=float))), digits)


def number(s: SparkSession, v: float, digits: int = 6) -> DataFrame:
    return s.createDataFrame([(round(float(v), digits),)], "v double")


# the first columns of the embeddings: c0 and c1 as a tall matrix, c2 as the right side
def tall(s: SparkSession, d: str, *columns: int) -> Matrix:
    return inputs.embeddings(s, d).cols(list(columns or (0, 1)))


def gram2(s: SparkSession, d: str) -> Matrix:
    return tall(s, d).gram()


W = """R AS (SELECT vec_id AS i, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
S AS (SELECT count(*) AS m, sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS c, sum(x * z) AS p, sum(y * z) AS q FROM R),
E AS (SELECT *, (a + c - sqrt((a - c) ** 2 + 4 * b * b)) / 2 AS lo, (a + c + sqrt((a - c) ** 2 + 4 * b * b)) / 2 AS hi, a * c - b * b AS det FROM S)"""


def square(v00: str, v01: str, v10: str, v11: str, source: str = "E", digits: int = 6) -> str:
    return " UNION ALL ".join(f"SELECT {i}::BIGINT AS i, {j}::INTEGER AS j, round(({v})::DOUBLE, {digits}) AS v FROM {source}" for i, j, v in ((0, 0, v00), (0, 1, v01), (1, 0, v10), (1, 1, v11)))


def column(v0: str, v1: str, source: str = "E", digits: int = 6) -> str:
    return f"SELECT 0::BIGINT AS i, 0::INTEGER AS j, round(({v0})::DOUBLE, {digits}) AS v FROM {source} UNION ALL SELECT 1, 0, round(({v1})::DOUBLE, {digits}) FROM {source}"


def two(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    register(name, f, f"WITH {W} {sql}")


DET3 = "SELECT round(a00 * (a11 * a22 - a12 * a21) - a01 * (a10 * a22 - a12 * a20) + a02 * (a10 * a21 - a11 * a20), 9) AS v FROM (SELECT " + ", ".join(f"max(v) FILTER (i = {i} AND j = {j}) AS a{i}{j}" for i in range(3) for j in range(3)) + " FROM M)"
register("matrix_det", lambda s, d: number(s, decomp.det(inputs.embeddings(s, d).submatrix(0, 0, 3, 3)), 9), f"WITH {M} {DET3}")
two("matrix_inverse", lambda s, d: cells(decomp.inverse(gram2(s, d))), square("c / det", "-b / det", "-b / det", "a / det"))
two("matrix_solve", lambda s, d: cells(decomp.solve(tall(s, d), tall(s, d, 2))), column("(c * p - b * q) / det", "(a * q - b * p) / det"))
two("matrix_cholesky", lambda s, d: cells(decomp.cholesky(gram2(s, d))), square("sqrt(a)", "b / sqrt(a)", "0", "sqrt(c - b * b / a)"))


def spd_by_shift(s: SparkSession, d: str) -> DataFrame:
    g = gram2(s, d).to_numpy()
    step = np.trace(g) / 10
    return s.createDataFrame([(t, bool(decomp.is_spd(Matrix.from_array(s, g - t * step * np.eye(2))))) for t in range(10)], "t int, v boolean")


two("matrix_is_spd", spd_by_shift, "SELECT t::INTEGER AS t, a - t * (a + c) / 10 > 0 AND (a - t * (a + c) / 10) * (c - t * (a + c) / 10) - b * b > 0 AS v FROM E CROSS JOIN range(10) r(t)")


def symmetric(s: SparkSession, d: str) -> DataFrame:
    whole = inputs.embeddings(s, d).apply(lambda v: F.floor(v * 256).cast("double"))
    block = whole.submatrix(0, 0, 64, 64)
    return s.createDataFrame([(name, x.is_symmetric()) for name, x in (("gram", whole.gram()), ("block", block), ("sum", block + block.transpose()))], "name string, v boolean")


register("matrix_is_symmetric", symmetric, f"""WITH {M}, Z AS (SELECT i, j, floor(v * 256) AS v FROM M), Q AS (SELECT i, j, v FROM Z WHERE i < 64),
    P AS (SELECT 'gram' AS name, a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM Z a JOIN Z b ON a.i = b.i GROUP BY a.j, b.j UNION ALL SELECT 'block', i, j, v FROM Q
        UNION ALL SELECT 'sum', a.i, a.j, a.v + b.v FROM Q a JOIN Q b ON a.i = b.j AND a.j = b.i)
    SELECT a.name, max(abs(a.v - b.v)) <= 1e-15 AS v FROM P a JOIN P b ON a.name = b.name AND a.i = b.j AND a.j = b.i GROUP BY a.name""")
register("matrix_is_equal", lambda s, d: s.createDataFrame([(str(e), (lambda a: a.is_equal(a + e))(inputs.embeddings(s, d))) for e in (0.0, 1e-13, 1e-11, 0.5)], "e string, v boolean"),
         f"WITH {M} SELECT e AS e, max(abs(v + e::DOUBLE - v)) <= 1e-12 AS v FROM M CROSS JOIN (VALUES ('0.0'), ('1e-13'), ('1e-11'), ('0.5')) t(e) GROUP BY e")
VECTOR = "sqrt(b * b + ({0} - a) ** 2)"
FIRST, SECOND = "CASE WHEN abs(b) >= abs({0} - a) THEN abs(b) ELSE b * sign({0} - a) END", "CASE WHEN abs(b) >= abs({0} - a) THEN ({0} - a) * sign(b) ELSE abs({0} - a) END"
two("matrix_eigen", lambda s, d: cells(decomp.eigen(gram2(s, d))[0]), column("lo", "hi"))
two("matrix_eigen_vectors", lambda s, d: cells(decomp.eigen(gram2(s, d))[1]), square(*[f"({part.format(at)}) / {VECTOR.format(at)}" for part in (FIRST, SECOND) for at in ("lo", "hi")]))
two("matrix_power_method", lambda s, d: number(s, decomp.power_method(gram2(s, d), precision=1e-13)[0]), "SELECT round(hi, 6) AS v FROM E")
two("matrix_power_method_vector", lambda s, d: s.createDataFrame([tuple(round(abs(float(v)), 6) for v in decomp.power_method(gram2(s, d), precision=1e-13)[1].to_numpy()[:, 0])], "x double, y double"), f"SELECT round(abs(b) / {VECTOR.format('hi')}, 6) AS x, round(abs(hi - a) / {VECTOR.format('hi')}, 6) AS y FROM E")
two("matrix_spectral_radius", lambda s, d: number(s, decomp.spectral_radius(gram2(s, d))), "SELECT round(hi, 6) AS v FROM E")
two("matrix_svd", lambda s, d: table(s, decomp.svd(tall(s, d))[1][:, None]), column("sqrt(hi)", "sqrt(lo)"))
two("matrix_svd_rebuilt", lambda s, d: table(s, (lambda u, e, v: (u * e) @ v.T)(*decomp.svd(tall(s, d)))), "SELECT i, 0::INTEGER AS j, round(x, 6) AS v FROM R UNION ALL SELECT i, 1, round(y, 6) FROM R")
two("matrix_tall_svd", lambda s, d: cells((lambda u, e, v: u.multiply(Matrix.from_array(s, np.diag(e) @ v.T)))(*decomp.tall_svd(tall(s, d))), 5), "SELECT i, 0::INTEGER AS j, round(x, 5) AS v FROM R UNION ALL SELECT i, 1, round(y, 5) FROM R")
two("matrix_norm2", lambda s, d: number(s, decomp.norm2(tall(s, d))), "SELECT round(sqrt(hi), 6) AS v FROM E")
two("matrix_spectral_norm", lambda s, d: number(s, decomp.spectral_norm(tall(s, d))), "SELECT round(sqrt(hi), 6) AS v FROM E")
two("matrix_rank", lambda s, d: s.createDataFrame([(str(c), decomp.rank(tall(s, d, *c))) for c in ((0, 1), (0, 0), (1,), (0, 1, 0))], "c string, v int"), "SELECT k AS c, (CASE WHEN hi > 0 THEN 1 ELSE 0 END + CASE WHEN n = 2 AND det > 1e-9 * hi * hi THEN 1 ELSE 0 END)::INTEGER AS v FROM E CROSS JOIN (VALUES ('(0, 1)', 2), ('(0, 0)', 1), ('(1,)', 1), ('(0, 1, 0)', 2)) t(k, n)")
two("matrix_pseudoinverse", lambda s, d: cells(decomp.pseudoinverse(tall(s, d))), "SELECT 0::BIGINT AS i, R.i::INTEGER AS j, round((c * x - b * y) / det, 6) AS v FROM R CROSS JOIN E UNION ALL SELECT 1, R.i::INTEGER, round((a * y - b * x) / det, 6) FROM R CROSS JOIN E")
NNLS = ", N AS (SELECT CASE WHEN c * p - b * q >= 0 AND a * q - b * p >= 0 THEN (c * p - b * q) / det WHEN p > 0 AND (q <= 0 OR p * p / a >= q * q / c) THEN p / a ELSE 0 END AS u, CASE WHEN c * p - b * q >= 0 AND a * q - b * p >= 0 THEN (a * q - b * p) / det WHEN q > 0 AND NOT (p > 0 AND p * p / a >= q * q / c) THEN q / c ELSE 0 END AS w FROM E)"
register("matrix_nnls", lambda s, d: cells(decomp.nnls(tall(s, d), tall(s, d, 2))), f"WITH {W}{NNLS} {column('u', 'w', 'N')}")
register("matrix_fnnls", lambda s, d: table(s, decomp.fnnls(gram2(s, d).to_numpy(), tall(s, d).transpose().multiply(tall(s, d, 2)).to_numpy()[:, 0])[:, None]), f"WITH {W}{NNLS} {column('u', 'w', 'N')}")

# factorisations: one round from ones, in the order of their updates
ABS = "X AS (SELECT i, abs(x) AS x, abs(y) AS y, abs(z) AS z FROM R)"
ones = lambda *shape: np.ones(shape)


def factors(s: SparkSession, w: np.ndarray, h: np.ndarray) -> DataFrame:
    """W's column as rows i, j = 0, and H's row as rows i = -1."""
    rows = [(i, 0, float(round(v, 6))) for i, v in enumerate(w[:, 0])] + [(-1, j, float(round(v, 6))) for j, v in enumerate(h[0])]
    return s.createDataFrame(rows, "i long, j int, v double")


def factor_sql(h: str, w: str) -> str:
    return f", H AS ({h}), V AS ({w}) SELECT i, 0::INTEGER AS j, round(w, 6) AS v FROM V UNION ALL SELECT -1, 0, round(h0, 6) FROM H UNION ALL SELECT -1, 1, round(h1, 6) FROM H"


register("matrix_nmf", lambda s, d: (lambda a: factors(s, *decomp.nmf(a, 1, ones(a.m, 1), ones(1, 2), rounds=1)))(tall(s, d).abs()), f"WITH {W}, {ABS}" + factor_sql("SELECT avg(x) AS h0, avg(y) AS h1 FROM X", "SELECT i, (x * h0 + y * h1) / (h0 * h0 + h1 * h1) AS w FROM X CROSS JOIN H"))
mask = lambda m: np.array([[float((i + j) % 3 != 0) for j in range(2)] for i in range(m)])
register("matrix_wnmf", lambda s, d: (lambda a: factors(s, *decomp.wnmf(a, 1, mask(a.m), ones(a.m, 1), ones(1, 2), rounds=1)))(tall(s, d).abs()), f"WITH {W}, {ABS}, K AS (SELECT *, (i % 3 <> 0)::INTEGER AS k0, ((i + 1) % 3 <> 0)::INTEGER AS k1 FROM X), V AS (SELECT i, (k0 * x + k1 * y) / (k0 + k1) AS w FROM K), H AS (SELECT sum(w * k0 * x) / sum(w * w * k0) AS h0, sum(w * k1 * y) / sum(w * w * k1) AS h1 FROM K JOIN V USING (i)) SELECT i, 0::INTEGER AS j, round(w, 6) AS v FROM V UNION ALL SELECT -1, 0, round(h0, 6) FROM H UNION ALL SELECT -1, 1, round(h1, 6) FROM H")


def labelled(s: SparkSession, d: str) -> DataFrame:
    a = tall(s, d).abs()
    labels = np.array([[float(i % 2)] for i in range(a.m)])
    w, h, _ = decomp.ssnmf(a, 1, labels, 0.5, 1, weights=mask(a.m), start=(ones(a.m, 1), ones(1, 2), ones(1, 1)))
    return factors(s, w, h)


register("matrix_ssnmf", labelled, f"WITH {W}, {ABS}, K AS (SELECT *, (i % 3 <> 0)::INTEGER AS k0, ((i + 1) % 3 <> 0)::INTEGER AS k1, i % 2 AS t FROM X)" + factor_sql("SELECT sum(k0 * x) / sum(k0) AS h0, sum(k1 * y) / sum(k1) AS h1 FROM K", "SELECT i, (k0 * x * h0 + k1 * y * h1 + 0.5 * t) / (k0 * h0 * h0 + k1 * h1 * h1 + 0.5 * t) AS w FROM K CROSS JOIN H"))
register("matrix_cnmf", lambda s, d: (lambda a, b: factors(s, *decomp.cnmf(a, 1, b, 1, start=(ones(2, 1), ones(1, 1)))))(tall(s, d).abs(), tall(s, d, 2).abs().to_numpy()), f"WITH {W}, {ABS}" + factor_sql("SELECT sum(x * z) / sum(z * z) AS h0, sum(y * z) / sum(z * z) AS h1 FROM X", "SELECT i, z * (SELECT sum(z * (x * h0 + y * h1)) / (sum(z * z) * (any_value(h0) ** 2 + any_value(h1) ** 2)) FROM X CROSS JOIN H) AS w FROM X"))
two("matrix_bistochastic", lambda s, d: cells(decomp.bistochastic(Matrix.from_array(s, (lambda g: g / np.trace(g) / 2 + 0.5 * np.eye(2))(gram2(s, d).to_numpy())))), square(*[f"{v} + 0.5 + g - {r} - {t}" for v, r, t in (("ga", "r0", "r0"), ("gb", "r0", "r1"), ("gb", "r1", "r0"), ("gc", "r1", "r1"))], source="(SELECT *, (ga + 2 * gb + gc) / 4 AS g, (ga + gb) / 2 AS r0, (gb + gc) / 2 AS r1 FROM (SELECT a / (a + c) / 2 + 0.5 AS ga, b / (a + c) / 2 AS gb, c / (a + c) / 2 + 0.5 AS gc FROM E))"))
two("matrix_binormalize", lambda s, d: cells(decomp.binormalize(gram2(s, d).abs())), square("sqrt(a * c) / (sqrt(a * c) + abs(b))", "abs(b) / (sqrt(a * c) + abs(b))", "abs(b) / (sqrt(a * c) + abs(b))", "sqrt(a * c) / (sqrt(a * c) + abs(b))"))
# one centroid, and two of which the second round changes nothing: columns of which two values are far apart
far = lambda a: a.apply(lambda v: F.when(v > 0, v + 10).otherwise(v))
register("matrix_quantize", lambda s, d: cells(far(tall(s, d)).quantize(1)), f"WITH {W} SELECT i, j::INTEGER AS j, 0.0::DOUBLE AS v FROM R CROSS JOIN range(2) t(j)")
MAHALANOBIS = ", K AS (SELECT var_samp(x) AS vx, covar_samp(x, y) AS vxy, var_samp(y) AS vy FROM R) SELECT a.i AS i, b.i::INTEGER AS j, round(((a.x - b.x) ** 2 * vy - 2 * (a.x - b.x) * (a.y - b.y) * vxy + (a.y - b.y) ** 2 * vx) / (vx * vy - vxy * vxy), 4) AS v FROM R a CROSS JOIN R b CROSS JOIN K"
register("matrix_get_distances_mahalanobis", lambda s, d: (lambda a: a.df.select("i", "j", rounded(F.col("v"), 4).alias("v")))(tall(s, d).get_distances("mahalanobis")), f"WITH {W}{MAHALANOBIS}")
KENDALL = "P AS (SELECT a.i, a.j AS p, b.j AS q, sign(a.v - b.v) AS g FROM M a JOIN M b ON a.i = b.i AND a.j < b.j WHERE a.i < 12 AND a.j < 16 AND b.j < 16), Q AS (SELECT i, sum(abs(g)) AS n FROM P GROUP BY i)"
register("matrix_get_distances_kendall", lambda s, d: cells(inputs.embeddings(s, d).submatrix(0, 0, 12, 16).get_distances("kendall")), f"WITH {M}, {KENDALL} SELECT a.i AS i, b.i::INTEGER AS j, round(sum(a.g * b.g) / sqrt(any_value(x.n) * any_value(y.n)), 6) AS v FROM P a JOIN P b ON a.p = b.p AND a.q = b.q JOIN Q x ON x.i = a.i JOIN Q y ON y.i = b.i GROUP BY a.i, b.i")

# sources, sinks and constructors
register("matrix_new", lambda s, d: cells(Matrix(inputs.read(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("i"), F.lit(0).alias("j"), F.col("n_regionkey").cast("double").alias("v")), 25, 1)), "SELECT n_nationkey::BIGINT AS i, 0::INTEGER AS j, n_regionkey::DOUBLE AS v FROM nation")
register("matrix_dims", lambda s, d: s.createDataFrame([inputs.embeddings(s, d).dims()], "m long, n long"), f"WITH {M} SELECT max(i) + 1 AS m, (max(j) + 1)::BIGINT AS n FROM M")
register("matrix_get", lambda s, d: s.createDataFrame([(k, round(float(inputs.embeddings(s, d).get(k, -1)), 6)) for k in (0, -1, 7)], "k int, v double"), f"WITH {M} SELECT k::INTEGER AS k, round(v, 6) AS v FROM M JOIN (VALUES (0, 0), (-1, (SELECT max(i) FROM M)), (7, 7)) t(k, r) ON M.i = r WHERE j = 63")
for name, value in (("zero", "0.0"), ("one", "1.0")):
    register(f"matrix_{name}", lambda s, d, n=name: cells(getattr(Matrix, n)(s, *inputs.embeddings(s, d).dims())), f"WITH {M} SELECT i, j, {value}::DOUBLE AS v FROM M")
register("matrix_identity", lambda s, d: cells(Matrix.identity(s, inputs.embeddings(s, d).n)), f"WITH {M} SELECT a.j::BIGINT AS i, b.j AS j, (a.j = b.j)::INTEGER::DOUBLE AS v FROM (SELECT DISTINCT j FROM M) a CROSS JOIN (SELECT DISTINCT j FROM M) b")
register("matrix_random", lambda s, d: (lambda a: a.df.agg(F.count("*").alias("n"), F.min(((F.col("v") >= 0) & (F.col("v") < 3)).cast("int")).alias("inside"), F.countDistinct("v").alias("different"), F.round(F.round(F.avg("v"), 1), 0).alias("mean")))(Matrix.random(s, *inputs.embeddings(s, d).dims(), 3.0, 5)), f"WITH {M} SELECT count(*) AS n, 1::INTEGER AS inside, count(*) AS different, 2.0::DOUBLE AS mean FROM M")
register("matrix_clone", lambda s, d: (lambda a: (a.clone().set(0, 0, 9.0), cells(a.clone()))[1])(inputs.embeddings(s, d)), f"WITH {M} SELECT i, j, round(v, 6) AS v FROM M")
register("matrix_release", lambda s, d: (lambda a: (a.release(), cells(a))[1])(tall(s, d)), f"WITH {M} SELECT i, j, round(v, 6) AS v FROM M WHERE j < 2")
register("matrix_from_array", lambda s, d: table(s, inputs.read(s, d, "supplier").orderBy("s_suppkey").select("s_nationkey", "s_acctbal").toPandas().to_numpy()), "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, 0::INTEGER AS j, s_nationkey::DOUBLE AS v FROM supplier UNION ALL SELECT row_number() OVER (ORDER BY s_suppkey) - 1, 1, round(s_acctbal, 6) FROM supplier")
listed = lambda a, kind: a.array_frame(kind).select("n", F.round("v", 6).alias("v"))
register("matrix_as_array", lambda s, d: listed(inputs.embeddings(s, d), "flat"), f"WITH {M} SELECT i * 64 + j AS n, round(v, 6) AS v FROM M")
register("matrix_as_array_rag", lambda s, d: listed(gram3(s, d), "rag"), f"WITH {M}, P AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM M a JOIN M b ON a.i = b.i WHERE a.j < 4 AND b.j < a.j GROUP BY a.j, b.j) SELECT row_number() OVER (ORDER BY i, j) - 1 AS n, round(v, 6) AS v FROM P")


def gram3(s: SparkSession, d: str) -> Matrix:
    return tall(s, d, 0, 1, 2, 3).gram()


def whole(s: SparkSession, d: str) -> Matrix:
    """Nation and region numbers of the nations: whole numbers print alike everywhere."""
    return Matrix.from_array(s, inputs.read(s, d, "nation").orderBy("n_nationkey").select("n_nationkey", "n_regionkey").toPandas().to_numpy())


register("matrix_as_string", lambda s, d: s.createDataFrame([(whole(s, d).as_string(",", ["a", "b"], [f"r{k}" for k in range(25)], "x"),)], "text string"), "SELECT 'x,a,b' || chr(10) || string_agg('r' || n_nationkey || ',' || n_nationkey || ',' || n_regionkey, chr(10) ORDER BY n_nationkey) || chr(10) AS text FROM nation")


def to_file(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "matrix")
    inputs.embeddings(s, d).to_file(path)
    return cells(Matrix.load(s, path)[0])


register("matrix_to_file", to_file, f"WITH {M} SELECT i, j, round(v, 6) AS v FROM M")


def load(s: SparkSession, d: str) -> DataFrame:
    """Suppliers by way of a labelled text file."""
    path = scratch(s, "matrix")
    rows = inputs.read(s, d, "supplier").coalesce(1).sortWithinPartitions("s_suppkey").select(F.concat_ws("\t", "s_name", "s_nationkey", F.round("s_acctbal", 2).cast("string")).alias("value"))
    s.createDataFrame([("name\tnation\tbalance",)], "value string").unionByName(rows).coalesce(1).write.text(path)
    a, names, columns = Matrix.load(s, path, "\t", colnames=True, rownames=True)
    labels = s.createDataFrame(list(enumerate(names)), "i long, name string")
    heads = s.createDataFrame(list(enumerate(columns)), "j int, head string")
    return a.df.join(labels, "i").join(heads, "j").select("name", "head", F.round("v", 2).alias("v"))


register("matrix_load_matrix", load, "SELECT s_name AS name, 'nation' AS head, s_nationkey::DOUBLE AS v FROM supplier UNION ALL SELECT s_name, 'balance', round(s_acctbal, 2) FROM supplier")

# time series
register("ts_new", lambda s, d: cells(TimeSeries(inputs.series(s, d).df, inputs.series(s, d).m, inputs.series(s, d).n), 4), f"WITH {T} SELECT i, j, round(v, 4) AS v FROM T")
register("ts_new_from_matrix", lambda s, d: cells(TimeSeries.of(Matrix(inputs.series(s, d).df, inputs.series(s, d).m, inputs.series(s, d).n)).tdiff(1), 4), f"WITH {T} SELECT i, j, round(coalesce(v - lag(v) OVER (PARTITION BY j ORDER BY i), 0), 4) AS v FROM T")
register("ts_detrend_2", lambda s, d: cells(inputs.series(s, d).detrend(2), 3), f"""WITH {T}, P AS (SELECT i, j, v, i - avg(i) OVER (PARTITION BY j) AS p FROM T), Q AS (SELECT *, p * p - avg(p * p) OVER (PARTITION BY j) AS q FROM P),
    F AS (SELECT j, avg(v) AS a, sum(v * p) / sum(p * p) AS b, sum(v * q) / sum(q * q) AS c FROM Q GROUP BY j) SELECT i, Q.j, round(v - a - b * p - c * q, 3) AS v FROM Q JOIN F USING (j)""")


def warped(s: SparkSession, d: str) -> DataFrame:
    """Each day's values as a series of one time, against those of the first day."""
    rows = inputs.series(s, d).df.groupBy("i").agg(F.array(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda c: c["v"])).alias("x"))
    first = rows.where("i = 0").select(F.col("x").alias("y"))
    found = timeseries.align(rows.join(F.broadcast(first), F.lit(True)).select(F.col("i").alias("pair"), "x", "y"))
    return found.select("pair", F.round("score", 4).alias("score"), "alignment")


register("ts_align", warped, f"WITH {T} SELECT a.i AS pair, round(sqrt(sum((a.v - b.v) ** 2)), 4) AS score, '1' || chr(10) || '1' AS alignment FROM T a JOIN T b ON a.j = b.j AND b.i = 0 GROUP BY a.i")


def warped_pairs(s: SparkSession, d: str) -> DataFrame:
    """Two times of each day and the next against the first two."""
    rows = inputs.series(s, d).df.where("j = 0").select("i", "v")
    nexts = rows.select((F.col("i") - 1).alias("i"), F.col("v").alias("w")).join(rows, "i").select("i", F.array(F.array("v"), F.array("w")).alias("x"))
    first = nexts.where("i = 0").select(F.col("x").alias("y"))
    return timeseries.align(nexts.join(F.broadcast(first), F.lit(True)).select(F.col("i").alias("pair"), "x", "y")).select("pair", F.round("score", 4).alias("score"))


# the grid of 3 x 3 cells written out: s and length of each cell, diagonal first, then a step of x, then of y
def grid_sql() -> str:
    d = lambda i, j: f"abs(x{i} - y{j})"
    best = "list_min([{{'k': {0}, 'o': 1, 'n': {1}}}, {{'k': {2}, 'o': 2, 'n': {3}}}, {{'k': {4}, 'o': 3, 'n': {5}}}])"
    out = f"B AS (SELECT *, {d(1, 0)} / 2 AS s10, ({d(1, 0)} + {d(2, 0)}) / 2 AS s20, {d(0, 1)} / 2 AS s01, ({d(0, 1)} + {d(0, 2)}) / 2 AS s02, 1 AS n10, 2 AS n20, 1 AS n01, 2 AS n02, 0.0 AS s00, 0 AS n00 FROM P)"
    last = "B"
    for i, j in ((1, 1), (1, 2), (2, 1), (2, 2)):
        pick = best.format(f"s{i - 1}{j - 1} + {d(i, j)}", f"n{i - 1}{j - 1} + 1", f"s{i - 1}{j} + ({d(i, j)} + {d(i, j + 1)}) / 4", f"n{i - 1}{j} + 1", f"s{i}{j - 1} + ({d(i, j)} + {d(i + 1, j)}) / 4", f"n{i}{j - 1} + 1")
        out += f", B{i}{j} AS (SELECT *, b.k AS s{i}{j}, b.n AS n{i}{j} FROM (SELECT *, {pick} AS b FROM (SELECT * {'' if last == 'B' else 'EXCLUDE (b)'} FROM {last})))"
        last = f"B{i}{j}"
    return f"{out} SELECT pair, round(s22 / n22, 4) AS score FROM {last}"


register("ts_align_pairs", warped_pairs, f"WITH {T}, Q AS (SELECT a.i, a.v AS v, b.v AS w FROM T a JOIN T b ON a.j = 0 AND b.j = 0 AND b.i = a.i + 1), P AS (SELECT a.i AS pair, a.v AS x0, a.v AS x1, a.w AS x2, a.w AS x3, f.v AS y0, f.v AS y1, f.w AS y2, f.w AS y3 FROM Q a JOIN Q f ON f.i = 0), {grid_sql()}")


# graphs and kernels: the line items between nations 0 and 1, and within each
def two_nations(s: SparkSession, d: str) -> Matrix:
    lines = inputs.read(s, d, "lineitem").join(inputs.read(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(inputs.read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(inputs.read(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    counts = lines.where("c_nationkey < 2 AND s_nationkey < 2").groupBy(F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b")).count().collect()
    x = np.ones((2, 2))
    for r in counts:
        x[r["a"], r["b"]] = x[r["b"], r["a"]] = r["count"] + 1
    return Matrix.from_array(s, x)


PAIR = "Y AS (SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey < 2 AND s_nationkey < 2), E AS (SELECT 1.0::DOUBLE + count(*) FILTER (a = 0 AND b = 0) AS s, 1.0::DOUBLE + count(*) FILTER (a = 0 AND b = 1) AS w, 1.0::DOUBLE + count(*) FILTER (a = 1) AS t FROM Y)"
KERNELS = {
    "ct": ("CT", None, ("1 / (4 * w)", "-1 / (4 * w)", "-1 / (4 * w)", "1 / (4 * w)")),
    "vn": ("VN", 0.0001, tuple(f"({v}) / ((1 - 0.0001 * s) * (1 - 0.0001 * t) - (0.0001 * w) ** 2)" for v in ("1 - 0.0001 * t", "0.0001 * w", "0.0001 * w", "1 - 0.0001 * s"))),
    "rf": ("RF", None, tuple(f"({v}) / (1 + 2 * w)" for v in ("1 + w", "w", "w", "1 + w"))),
    "rct": ("RCT", 0.9, tuple(f"({v}) / ((w + 0.1 * s) * (w + 0.1 * t) - (0.9 * w) ** 2)" for v in ("w + 0.1 * t", "0.9 * w", "0.9 * w", "w + 0.1 * s"))),
    "rwr": ("RWR", 0.9, tuple(f"({v}) / ((w + 0.1 * s) * (w + 0.1 * t) - (0.9 * w) ** 2)" for v in ("(w + 0.1 * t) * (s + w)", "0.9 * w * (w + t)", "0.9 * w * (s + w)", "(w + 0.1 * s) * (w + t)"))),
}
for name, (kind, param, formulas) in KERNELS.items():
    register(f"kernel_{name}", lambda s, d, k=kind, p=param: cells(Kernel.compute_from_matrix(two_nations(s, d), k, p), 8), f"WITH {PAIR} {square(*formulas, digits=8)}")
TOP = "abs(w / (s + w)) >= abs(w / (w + t))"
NORM = "sqrt((w / (s + w)) ** 2 + (w / (w + t)) ** 2)"
register("kernel_diffusion_map", lambda s, d: cells((lambda a: Kernel(a.df, a.m).diffusion_map(2))(two_nations(s, d))), f"WITH {PAIR} {square('1 / sqrt(2)', f'CASE WHEN {TOP} THEN 1 ELSE -1 END * (w / (s + w)) / {NORM}', '1 / sqrt(2)', f'CASE WHEN {TOP} THEN -1 ELSE 1 END * (w / (w + t)) / {NORM}')}")
register("kernel_new", lambda s, d: (lambda a: cells(Kernel(a.df, a.m), 2))(inputs.nations(s, d).get_adjacency_matrix()), f"WITH {A} SELECT i, j, round(v, 2) AS v FROM A")
register("kernel_new_from_matrix", lambda s, d: (lambda a: cells(Kernel(a.df, a.m, a.n).get_distance_matrix(), 2))(gram2(s, d)), f"WITH {W} {square('0', 'a + c - 2 * b', 'a + c - 2 * b', '0', digits=2)}")
register("kernel_compute_from_graph", lambda s, d: cells(Kernel.compute_from_graph(inputs.nations(s, d), "linear"), 2), f"WITH {A} SELECT a.i AS i, b.i::INTEGER AS j, round(sum(a.v * b.v), 2) AS v FROM A a JOIN A b ON a.j = b.j GROUP BY a.i, b.i")


def written(s: SparkSession, d: str, extra: str | None = None) -> str:
    path = scratch(s, "graph")
    lines = inputs.nations(s, d).export().select("line")
    if extra:
        lines = lines.unionByName(s.createDataFrame([(extra,)], "line string"))
    lines.coalesce(1).write.text(path)
    return path


register("graph_read_from_file", lambda s, d: Graph.read(s, written(s, d, "1\t0\t7.5")).edges.select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), "w").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "w"), f"WITH {G} SELECT src, dst, w FROM G WHERE NOT (src = 0 AND dst = 1) UNION ALL SELECT 0, 1, 7.5")


def file_to_matrix(s: SparkSession, d: str) -> DataFrame:
    a, names = Graph.file_to_matrix(s, written(s, d))
    labels = s.createDataFrame([(n, int(x)) for n, x in enumerate(names)], "n int, id long")
    return a.df.join(labels.select(F.col("n").alias("i"), F.col("id").alias("src")), "i").join(labels.select(F.col("n").alias("j"), F.col("id").alias("dst")), "j").select("src", "dst", "v")


register("graph_file_to_matrix", file_to_matrix, f"WITH {A} SELECT a.id AS src, b.id AS dst, v FROM A JOIN V a ON a.n = i JOIN V b ON b.n = j")
register("graph_export_dot", lambda s, d: inputs.nations(s, d).export("dot", size="7,7", splines="true", edge_labels=True).select("part", "line"), f"""WITH {G} SELECT 1::INTEGER AS part, '"' || src || '" -- "' || dst || '" [weight=' || w || ', label="' || w || '"];' AS line FROM G UNION ALL SELECT 0, 'graph g {{ size="7,7"; splines="true";' UNION ALL SELECT 2, '}}'""")
register("graph_relevant_subgraph", lambda s, d: inputs.nations(s, d).get_relevant_subgraph([1, 5, 9], 1e-9, 1).select("src", "dst", F.round("w", 9).alias("w")), f"WITH {G}, D AS (SELECT src AS id, sum(w) AS g FROM B GROUP BY src) SELECT src, dst, round(abs(w / x.g - w / y.g) / 3, 9) AS w FROM G JOIN D x ON x.id = src JOIN D y ON y.id = dst WHERE src IN (1, 5, 9) AND dst IN (1, 5, 9) AND abs(w / x.g - w / y.g) / 3 > 1e-9")
register("graph_connected_components", lambda s, d: near_users(s, d).connected_components(), "WITH RECURSIVE N AS (SELECT event_id, event_id + 1 AS b, event_id // 50 AS g FROM events WHERE event_id < 600 AND event_id % 50 <> 49) SELECT x AS id, min(x) OVER (PARTITION BY x // 50) AS component FROM (SELECT event_id AS x FROM N UNION SELECT b FROM N)")


def near_users(s: SparkSession, d: str) -> Graph:
    """Events in twelve chains of fifty."""
    rows = inputs.read(s, d, "events").where("event_id < 600 AND event_id % 50 <> 49")
    return Graph(rows.select(F.col("event_id").alias("src"), (F.col("event_id") + 1).alias("dst"), F.lit(1.0).alias("w")))


# tensors: the marginals of the cube as factors
def marginals(s: SparkSession, d: str) -> tuple[np.ndarray, list[np.ndarray]]:
    x = inputs.cube(s, d).to_numpy()
    return x, [x.sum(axis=tuple(q for q in range(3) if q != n)) / x.sum() for n in range(3)]


def tensor3(s: SparkSession, x: np.ndarray, digits: int = 6) -> DataFrame:
    return Cube.from_numpy(s, x).df.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("k").cast("long").alias("k"), F.round("v", digits).alias("v"))


def outer(s: SparkSession, d: str) -> np.ndarray:
    return np.einsum("i,j,k->ijk", *marginals(s, d)[1]) * 1000


CUBE = f"""{C}, U AS (SELECT sum(v) AS n FROM C), A1 AS (SELECT i, sum(v) / any_value(n) AS a FROM C CROSS JOIN U GROUP BY i), A2 AS (SELECT j, sum(v) / any_value(n) AS b FROM C CROSS JOIN U GROUP BY j), A3 AS (SELECT k, sum(v) / any_value(n) AS c FROM C CROSS JOIN U GROUP BY k),
    GRID AS (SELECT i, j, k, a, b, c FROM (SELECT range AS i FROM range(25)) LEFT JOIN A1 USING (i) CROSS JOIN A2 CROSS JOIN A3)"""
OUTER = f"WITH {CUBE} SELECT i, j, k, round(1000 * coalesce(a, 0) * b * c, 4) AS v FROM GRID"
rebuild = lambda f, w: np.einsum("r,ir,jr,kr->ijk", w, *f)
register("cube_cp", lambda s, d: tensor3(s, (lambda f, w, _: rebuild(f, w))(*tensor.cp(outer(s, d), 1)), 4), OUTER)
register("cube_nncp", lambda s, d: tensor3(s, (lambda f, w, _: rebuild(f, w))(*tensor.cp(outer(s, d), 1, nonnegative=True)), 4), OUTER)
register("cube_tucker", lambda s, d: tensor3(s, tensor.compose(*tensor.tucker(outer(s, d), (1, 1, 1))), 4), OUTER)
register("cube_ntd", lambda s, d: tensor3(s, tensor.compose(*tensor.ntd(outer(s, d), (1, 1, 1))), 4), OUTER)
register("cube_hosvd", lambda s, d: tensor3(s, tensor.compose(*tensor.hosvd(inputs.cube(s, d).to_numpy())), 3), f"WITH {CUBE} SELECT g.i, g.j, g.k, round(coalesce(v, 0)::DOUBLE, 3) AS v FROM GRID g LEFT JOIN C ON g.i = C.i AND g.j = C.j AND g.k = C.k")
register("cube_rescal", lambda s, d: tensor3(s, (lambda a, r: np.einsum("ip,pqk,jq->ijk", a, r, a))(*tensor.rescal((lambda f: np.einsum("i,j,k->ijk", f[0], f[0], f[2]) * 1000)(marginals(s, d)[1]), 1)), 4), f"WITH {CUBE}, Z AS (SELECT range AS i, coalesce(a, 0) AS a FROM range(25) LEFT JOIN A1 ON range = i) SELECT x.i AS i, y.i AS j, k, round(1000 * x.a * y.a * c, 4) AS v FROM Z x CROSS JOIN Z y CROSS JOIN A3")
register("cube_parafac2", lambda s, d: tensor3(s, (lambda x, us, h, w, v, _: np.stack([u @ h @ np.diag(w[p]) @ v.T for p, u in enumerate(us)], axis=2))(*(lambda x: (x, *tensor.parafac2([x[:, :, p] for p in range(x.shape[2])], 1)))(outer(s, d))), 4), OUTER)
unit = lambda f: [(v / np.linalg.norm(v))[:, None] for v in f]
register("cube_ccd", lambda s, d: number(s, (lambda x, f: tensor.ccd(x / x.sum(), unit(f), np.array([0.5])))(*marginals(s, d))), f"WITH {CUBE}, L AS (SELECT (SELECT sum(a * a) FROM A1) AS qa, (SELECT sum(b * b) FROM A2) AS qb, (SELECT sum(c * c) FROM A3) AS qc), K AS (SELECT sum(v * a * b * c) / any_value(n) / sqrt(any_value(qa) * any_value(qb) * any_value(qc)) / 0.5 AS g FROM C JOIN A1 USING (i) JOIN A2 USING (j) JOIN A3 USING (k) CROSS JOIN U CROSS JOIN L) SELECT round(100 * (1 - (1 - g) ** 2), 6) AS v FROM K")


def congruence(s: SparkSession, d: str) -> DataFrame:
    x, first = marginals(s, d)
    second = [x.max(axis=tuple(q for q in range(3) if q != n)) for n in range(3)]
    return number(s, tensor.tcc([f[:, None] for f in first], [f[:, None] for f in second])[0, 0])


COSINE = "(SELECT sum(f * g) / sqrt(sum(f * f) * sum(g * g)) FROM (SELECT sum(v) AS f, max(v) AS g FROM C GROUP BY {0}))"
register("cube_tcc", congruence, f"WITH {C} SELECT round({' * '.join(COSINE.format(x) for x in 'ijk')}, 6) AS v")
register("cube_new", lambda s, d: (lambda c: tensor3(s, Cube(c.df, *c.shape).to_numpy(), 2))(inputs.cube(s, d)), f"WITH {CUBE} SELECT g.i, g.j, g.k, round(coalesce(v, 0)::DOUBLE, 2) AS v FROM GRID g LEFT JOIN C ON g.i = C.i AND g.j = C.j AND g.k = C.k")
register("cube_get", lambda s, d: s.createDataFrame([(k, float(inputs.cube(s, d).get(3, 1, k))) for k in (0, 1)], "k long, v double"), f"WITH {C} SELECT k, v FROM C WHERE i = 3 AND j = 1 AND k < 2")


# clustering: three columns of the embeddings, memberships of two clusters by number
def three(s: SparkSession, d: str) -> DataFrame:
    return inputs.read(s, d, "embeddings").select(F.col("vec_id").alias("i"), F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double")).alias("x"))


def halves(s: SparkSession, d: str) -> DataFrame:
    own = F.when(F.col("i") % 2 == F.col("c"), 0.8).otherwise(0.2)
    return three(s, d).select("i", F.explode(F.array(F.lit(0), F.lit(1))).alias("c")).select("c", "i", own.alias("u"))


FCM = f"{W}, U AS (SELECT c::INTEGER AS c, i, CASE WHEN i % 2 = c THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END AS u FROM R CROSS JOIN range(2) t(c)), P AS (SELECT c, sum(u * u * x) / sum(u * u) AS px, sum(u * u * y) / sum(u * u) AS py FROM U JOIN R USING (i) GROUP BY c)"
register("fcm_initialize_partition_matrix", lambda s, d: cluster.initialize_partition(three(s, d), 3, 4).groupBy("i").agg(F.round(F.sum("u"), 9).alias("total"), F.count("*").alias("n"), F.min((F.col("u") > 0).cast("int")).alias("positive")), f"WITH {W} SELECT i, 1.0::DOUBLE AS total, 3::BIGINT AS n, 1::INTEGER AS positive FROM R")
MAHA = f"{FCM}, V AS (SELECT c, sum(u * u * (x - px) ** 2) / sum(u * u) AS vx, sum(u * u * (x - px) * (y - py)) / sum(u * u) AS vxy, sum(u * u * (y - py) ** 2) / sum(u * u) AS vy FROM U JOIN R USING (i) JOIN P USING (c) GROUP BY c), D AS (SELECT i, c, sqrt(vx * vy - vxy * vxy) * ((x - px) ** 2 * vy - 2 * (x - px) * (y - py) * vxy + (y - py) ** 2 * vx) / (vx * vy - vxy * vxy) AS d FROM R CROSS JOIN P JOIN V USING (c))"
MANH = f"{FCM}, V AS (SELECT c, sum(u * u * abs(x - px)) / sum(u * u) AS sx, sum(u * u * abs(y - py)) / sum(u * u) AS sy FROM U JOIN R USING (i) JOIN P USING (c) GROUP BY c), D AS (SELECT i, c, abs(x - px) / sx + abs(y - py) / sy AS d FROM R CROSS JOIN P JOIN V USING (c))"
EUCL = f"{FCM}, D AS (SELECT i, c, sqrt((x - px) ** 2 + (y - py) ** 2) AS d FROM R CROSS JOIN P)"
measured = lambda s, d, m: cluster.get_distances(three(s, d), halves(s, d), cluster.get_prototypes(three(s, d), halves(s, d)), m)
for measure, (name, source) in enumerate((("euclidean", EUCL), ("mahalanobis", MAHA), ("manhattan", MANH))):
    register(f"fcm_{name}" if name == "mahalanobis" else f"fcm_get_distances_{name}", lambda s, d, m=measure: measured(s, d, m).select("i", "c", F.round("d", 5).alias("d")), f"WITH {source} SELECT i, c, round(d, 5) AS d FROM D")
    register(f"fcm_fuzzy_cmeans_{name}", lambda s, d, m=measure: cluster.fuzzy_cmeans(three(s, d), 2, 1, write=lambda df: df, measure=m, start=halves(s, d))[0].select("c", "i", F.round("u", 5).alias("u")), f"WITH {source} SELECT c, i, round(d ** -2 / sum(d ** -2) OVER (PARTITION BY i), 5) AS u FROM D")
STEP = f"{W}, Z AS (SELECT i AS c, x AS cx, y AS cy FROM R WHERE i < 2), N AS (SELECT R.i, x, y, min_by(c, (x - cx) ** 2 + (y - cy) ** 2) AS c FROM R CROSS JOIN Z GROUP BY ALL), Z2 AS (SELECT c, avg(x) AS cx, avg(y) AS cy FROM N GROUP BY c)"
register("kmeans", lambda s, d: cluster.kmeans(three(s, d), 2, 1, centres=np.array([r["x"] for r in three(s, d).where("i < 2").orderBy("i").collect()]))[0].select("i", F.col("c").cast("long").alias("c")), f"WITH {STEP} SELECT R.i, min_by(c, (x - cx) ** 2 + (y - cy) ** 2) AS c FROM R CROSS JOIN Z2 GROUP BY R.i")


def mixture(s: SparkSession, d: str, rounds: int = 0, kind: str = "diagonal") -> cluster.GaussianMixture:
    model = cluster.GaussianMixture(three(s, d), 2, kind, rounds, priors=[0.4, 0.6])
    model.means = np.array([[0.0, 0.0], [0.1, -0.1]])
    model.covariances = np.array([np.diag([0.02, 0.03]), np.diag([0.05, 0.04])])
    return model.expectation_maximization() if rounds else model


GMM = f"""{W}, L AS (SELECT i, x, y, ln(0.4) - 0.5 * (x * x / 0.02 + y * y / 0.03 + ln(0.02 * 0.03)) - ln(2 * pi()) AS l0, ln(0.6) - 0.5 * ((x - 0.1) ** 2 / 0.05 + (y + 0.1) ** 2 / 0.04 + ln(0.05 * 0.04)) - ln(2 * pi()) AS l1 FROM R),
    P AS (SELECT *, 1 / (1 + exp(l1 - l0)) AS g0, 1 / (1 + exp(l0 - l1)) AS g1 FROM L), Q AS (SELECT 0::INTEGER AS c, i, x, y, g0 AS g FROM P UNION ALL SELECT 1, i, x, y, g1 FROM P),
    H AS (SELECT c, avg(g) AS prior, sum(g * x) / sum(g) AS mx, sum(g * y) / sum(g) AS my, sum(g * x * x) / sum(g) AS xx, sum(g * x * y) / sum(g) AS xy, sum(g * y * y) / sum(g) AS yy FROM Q GROUP BY c)"""
means = lambda df: df.select("c", "j", F.round("v", 6).alias("v"))
MEANS = "SELECT c, 0::INTEGER AS j, round(mx, 6) AS v FROM H UNION ALL SELECT c, 1, round(my, 6) FROM H"
register("gmm_new", lambda s, d: mixture(s, d).cluster_priors(), "SELECT * FROM (VALUES (0::INTEGER, 0.4::DOUBLE), (1, 0.6)) t(c, v)")
register("gmm_initialize", lambda s, d: (lambda g: g.cluster_covariances().where("c = 0").select("j", "k", F.round("v", 6).alias("v")))(cluster.GaussianMixture(three(s, d), 2, "full").initialize()), f"WITH {W}, K AS (SELECT var_pop(x) AS vx, covar_pop(x, y) AS vxy, var_pop(y) AS vy FROM R) SELECT 0::INTEGER AS j, 0::INTEGER AS k, round(vx, 6) AS v FROM K UNION ALL SELECT 0, 1, round(vxy, 6) FROM K UNION ALL SELECT 1, 0, round(vxy, 6) FROM K UNION ALL SELECT 1, 1, round(vy, 6) FROM K")
register("gmm_cluster_means", lambda s, d: means(mixture(s, d, 1).cluster_means()), f"WITH {GMM} {MEANS}")
register("gmm_expectation_maximization", lambda s, d: means(mixture(s, d, 1, "full").cluster_means()), f"WITH {GMM} {MEANS}")
register("gmm_cluster_covariances", lambda s, d: mixture(s, d, 1, "full").cluster_covariances().select("c", "j", "k", F.round("v", 6).alias("v")), f"WITH {GMM} SELECT c, 0::INTEGER AS j, 0::INTEGER AS k, round(xx - mx * mx, 6) AS v FROM H UNION ALL SELECT c, 0, 1, round(xy - mx * my, 6) FROM H UNION ALL SELECT c, 1, 0, round(xy - mx * my, 6) FROM H UNION ALL SELECT c, 1, 1, round(yy - my * my, 6) FROM H")
register("gmm_cluster_priors", lambda s, d: mixture(s, d, 1).cluster_priors().select("c", F.round("v", 6).alias("v")), f"WITH {GMM} SELECT c, round(prior, 6) AS v FROM H")
register("gmm_cluster_memberships", lambda s, d: mixture(s, d).cluster_memberships().select("i", F.col("c").cast("int").alias("c"), F.round("v", 6).alias("v")), f"WITH {GMM} SELECT i, c, round(g, 6) AS v FROM Q")
register("gmm_log_likelihood", lambda s, d: number(s, mixture(s, d).log_likelihood(), 4), f"WITH {GMM} SELECT round(sum(ln(exp(l0) + exp(l1))), 4) AS v FROM L")
register("gmm_posterior_log_likelihoods", lambda s, d: mixture(s, d).posterior_log_likelihoods().select("i", F.round(F.col("l")[0], 5).alias("l0"), F.round(F.col("l")[1], 5).alias("l1")), f"WITH {GMM} SELECT i, round(l0, 5) AS l0, round(l1, 5) AS l1 FROM L")
register("gmm_classify", lambda s, d: mixture(s, d).naive_bayes_classifier(), f"WITH {GMM} SELECT i, (l1 > l0)::INTEGER AS c FROM L")

# relevance vectors
vectors = lambda s, d: sequences.RelevanceVectors([0, 1], [3.0, -2.0], 0.25)
register("rvm_new", lambda s, d: vectors(s, d).get_relevance_vectors(s), "SELECT * FROM (VALUES (0::BIGINT, 3.0::DOUBLE), (1, -2.0), (-1, 0.25)) t(idx, weight)")
RVM = "SELECT i, (t > 0)::INTEGER AS c, round(1 / (1 + exp(-abs(t))), 6) AS p FROM (SELECT i, 3 * x - 2 * y + 0.25 AS t FROM R)"
register("rvm_classify", lambda s, d: vectors(s, d).classify_rows(three(s, d)).select("i", "c", F.round("p", 6).alias("p")), f"WITH {W} {RVM}")
register("rvm_bernoulli", lambda s, d: tall(s, d).sigmoid().apply(sequences.bernoulli).df.select("i", "j", F.round("v", 6).alias("v")), f"WITH {M} SELECT i, j, round(exp(-v) / (1 + exp(-v)) ** 2, 6) AS v FROM M WHERE j < 2")


# hidden Markov models over the event types of each user
def model() -> sequences.HiddenMarkov:
    return sequences.HiddenMarkov(["low", "high"], ["a", "b", "c", "d", "e"], [[0.7, 0.3], [0.4, 0.6]], [[0.3, 0.3, 0.2, 0.1, 0.1], [0.1, 0.1, 0.2, 0.3, 0.3]])


def symbols(s: SparkSession, d: str) -> DataFrame:
    from gridloom.plans.catalog import symbols as numbered

    return numbered(s, d)


EM = "EM AS (SELECT * FROM (VALUES (0, 0.3::DOUBLE, 0.1::DOUBLE), (1, 0.3, 0.1), (2, 0.2, 0.2), (3, 0.1, 0.3), (4, 0.1, 0.3)) t(sym, b0, b1))"
OBS = f"Y AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS sym FROM (SELECT DISTINCT event_type FROM events)), {EM}, O AS (SELECT user_id AS seq_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS t, (count(*) OVER (PARTITION BY user_id))::INTEGER AS n, sym, b0, b1 FROM events JOIN Y USING (event_type) JOIN EM USING (sym))"
FW = """FW AS (SELECT seq_id, t, 0.5 * b0 / (0.5 * b0 + 0.5 * b1) AS f0, 0.5 * b1 / (0.5 * b0 + 0.5 * b1) AS f1, 0.5 * b0 + 0.5 * b1 AS c FROM O WHERE t = 0
    UNION ALL SELECT seq_id, t, g0 / (g0 + g1), g1 / (g0 + g1), g0 + g1 FROM (SELECT O.seq_id, O.t, b0 * (f0 * 0.7 + f1 * 0.4) AS g0, b1 * (f0 * 0.3 + f1 * 0.6) AS g1 FROM FW JOIN O ON O.seq_id = FW.seq_id AND O.t = FW.t + 1))"""
BW = """BW AS (SELECT FW.seq_id, FW.t, 1 / c AS r0, 1 / c AS r1 FROM FW JOIN O ON O.seq_id = FW.seq_id AND O.t = FW.t WHERE O.t = n - 1
    UNION ALL SELECT FW.seq_id, FW.t, (0.7 * b0 * r0 + 0.3 * b1 * r1) / c, (0.4 * b0 * r0 + 0.6 * b1 * r1) / c FROM BW JOIN FW ON FW.seq_id = BW.seq_id AND FW.t = BW.t - 1 JOIN O ON O.seq_id = BW.seq_id AND O.t = BW.t)"""
GA = "GA AS (SELECT seq_id, t, f0 * r0 / (f0 * r0 + f1 * r1) AS g0, f1 * r1 / (f0 * r0 + f1 * r1) AS g1 FROM FW JOIN BW USING (seq_id, t))"
XI = """XI AS (SELECT seq_id, t, x00 / z AS x00, x01 / z AS x01, x10 / z AS x10, x11 / z AS x11 FROM (SELECT *, x00 + x01 + x10 + x11 AS z FROM (SELECT FW.seq_id, FW.t, f0 * 0.7 * b0 * r0 AS x00, f0 * 0.3 * b1 * r1 AS x01, f1 * 0.4 * b0 * r0 AS x10, f1 * 0.6 * b1 * r1 AS x11
    FROM FW JOIN BW ON BW.seq_id = FW.seq_id AND BW.t = FW.t + 1 JOIN O ON O.seq_id = FW.seq_id AND O.t = FW.t + 1)))"""
HMM = f"WITH RECURSIVE {OBS}, {FW}, {BW}, {GA}, {XI}"


def states(source: str, first: str, second: str) -> str:
    return f"{HMM} SELECT seq_id, t, 0::INTEGER AS state, round({first}, 6) AS v FROM {source} UNION ALL SELECT seq_id, t, 1, round({second}, 6) FROM {source}"


for name, source in (("forward", ("FW", "f0", "f1")), ("backward", ("BW", "r0", "r1")), ("gamma", ("GA", "g0", "g1"))):
    register(f"hmm_{name}", lambda s, d, n=name: model().over(symbols(s, d), n).withColumn("v", F.round("v", 6)), states(*source))
register("hmm_xi", lambda s, d: model().over(symbols(s, d), "xi").withColumn("v", F.round("v", 6)), HMM + " " + " UNION ALL ".join(f"SELECT seq_id, t, {i}::INTEGER AS state, {j}::INTEGER AS state2, round(x{i}{j}, 6) AS v FROM XI" for i in (0, 1) for j in (0, 1)))
register("hmm_likelihood", lambda s, d: model().over(symbols(s, d), "likelihood").select("seq_id", F.round(F.ln(F.greatest("v", F.lit(1e-300))), 4).alias("v")), f"{HMM} SELECT seq_id, round(greatest(sum(ln(c)), ln(1e-300)), 4) AS v FROM FW GROUP BY seq_id")
VT = """VT AS (SELECT seq_id, t, n, -ln(0.5) - ln(b0) AS v0, -ln(0.5) - ln(b1) AS v1, '0' AS p0, '1' AS p1 FROM O WHERE t = 0
    UNION ALL SELECT O.seq_id, O.t, O.n, least(v0 - ln(0.7), v1 - ln(0.4)) - ln(b0), least(v0 - ln(0.3), v1 - ln(0.6)) - ln(b1),
        CASE WHEN v0 - ln(0.7) <= v1 - ln(0.4) THEN p0 ELSE p1 END || '0', CASE WHEN v0 - ln(0.3) <= v1 - ln(0.6) THEN p0 ELSE p1 END || '1' FROM VT JOIN O ON O.seq_id = VT.seq_id AND O.t = VT.t + 1)"""
# the costs of the paths that both find: which of equally good ones is taken depends on rounding
register("hmm_viterbi", lambda s, d: path_costs(s, d), f"WITH RECURSIVE {OBS}, {VT} SELECT seq_id, round(least(v0, v1), 4) AS cost, n::BIGINT AS n FROM VT WHERE t = n - 1")


def path_costs(s: SparkSession, d: str) -> DataFrame:
    m = model()
    logs = lambda x: F.array(*[F.array(*[F.lit(float(-np.log(v))) for v in row]) for row in x])
    both = m.decode(symbols(s, d)).join(symbols(s, d), "seq_id").select("seq_id", F.posexplode(F.arrays_zip("path", "symbols")).alias("t", "z")).select("seq_id", "t", F.col("z.path").alias("p"), F.col("z.symbols").alias("y"))
    from pyspark.sql import Window

    before = F.lag("p").over(Window.partitionBy("seq_id").orderBy("t"))
    moved = both.withColumn("q", before).select("seq_id", (F.coalesce(F.get(F.get(logs(m.a), F.col("q")), F.col("p")), F.lit(float(-np.log(0.5)))) + F.get(F.get(logs(m.b), F.col("p")), F.col("y"))).alias("cost"))
    return moved.groupBy("seq_id").agg(F.round(F.sum("cost"), 4).alias("cost"), F.count("*").alias("n"))


def trained(s: SparkSession, d: str) -> DataFrame:
    m = model()
    m.train(symbols(s, d), 1)
    return table(s, np.hstack([m.pi[:, None], m.a, m.b]))


register("hmm_train", trained, HMM + ", T1 AS (SELECT avg(g0) AS p0, avg(g1) AS p1 FROM GA WHERE t = 0), T2 AS (SELECT sum(x00) AS x00, sum(x01) AS x01, sum(x10) AS x10, sum(x11) AS x11 FROM XI), T3 AS (SELECT sum(g0) AS g0, sum(g1) AS g1 FROM GA JOIN O USING (seq_id, t) WHERE t < n - 1), T4 AS (SELECT sym, sum(g0) AS g0, sum(g1) AS g1 FROM GA JOIN O USING (seq_id, t) GROUP BY sym) SELECT 0::BIGINT AS i, 0::INTEGER AS j, round(p0, 6) AS v FROM T1 UNION ALL SELECT 1, 0, round(p1, 6) FROM T1" + "".join(f" UNION ALL SELECT {i}, {1 + j}, round(x{i}{j} / g{i}, 6) FROM T2 CROSS JOIN T3" for i in (0, 1) for j in (0, 1)) + "".join(f" UNION ALL SELECT {i}, (3 + sym)::INTEGER, round(g{i} / sum(g{i}) OVER (), 6) FROM T4" for i in (0, 1)))
register("hmm_new", lambda s, d: model().transitions(s).groupBy("state").agg(F.round(F.sum("v"), 9).alias("v")), "SELECT * FROM (VALUES ('low', 1.0::DOUBLE), ('high', 1.0)) t(state, v)")
register("hmm_transitions", lambda s, d: model().transitions(s), "SELECT * FROM (VALUES ('low', 'low', 0.7::DOUBLE), ('low', 'high', 0.3), ('high', 'low', 0.4), ('high', 'high', 0.6)) t(state, state2, v)")
register("hmm_emissions", lambda s, d: model().emissions(s), f"WITH {EM} SELECT 'low' AS state, substr('abcde', sym + 1, 1) AS symbol, b0 AS v FROM EM UNION ALL SELECT 'high', substr('abcde', sym + 1, 1), b1 FROM EM")
NUMBERED = "SELECT user_id AS seq_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS t, sym::INTEGER AS idx FROM events JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS sym FROM (SELECT DISTINCT event_type FROM events)) USING (event_type)"
each = lambda s, d: symbols(s, d).select("seq_id", F.posexplode("symbols").alias("t", "idx"))
register("hmm_idx_to_symbols", lambda s, d: model().idx_to_symbols(each(s, d)).select("seq_id", "t", "name"), f"SELECT seq_id, t, substr('abcde', idx + 1, 1) AS name FROM ({NUMBERED})")
register("hmm_idx_to_states", lambda s, d: model().idx_to_states(each(s, d).withColumn("idx", F.col("idx") % 3)).select("seq_id", "t", "name"), f"SELECT seq_id, t, CASE idx % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' END AS name FROM ({NUMBERED})")
ring = lambda: sequences.HiddenMarkov(3, 3, np.roll(np.eye(3), 1, axis=1), np.eye(3)[::-1], start=[1.0, 0.0, 0.0])
register("hmm_generate_sequence", lambda s, d: s.createDataFrame(list(enumerate(ring().generate(30, 1))), "t long, symbol long"), "SELECT range AS t, 2 - range % 3 AS symbol FROM range(30)")
register("hmm_generate_symbol", lambda s, d: s.createDataFrame([(k, ring().generate_symbol(k, np.random.default_rng(k))) for k in range(3)], "state long, symbol long"), "SELECT range AS state, 2 - range AS symbol FROM range(3)")
