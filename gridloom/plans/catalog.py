"""Registered queries and their SQL: one entry per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators import cluster, decomp, imaging, labware, sequences, tensor, timeseries
from gridloom.operators.kernels import Kernel
from gridloom.operators.matrix import Matrix, rounded
from gridloom.operators.tensor import Cube
from gridloom.plans import handles, inputs, solvers
from gridloom.plans.inputs import A, C, G, H, K, L, M, O, T
from gridloom.sources import container

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def register(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = make
    if sql:
        SQL[name] = sql


def cells(a: Matrix, digits: int = DIGITS) -> DataFrame:
    return a.df.select("i", "j", F.round("v", digits).alias("v"))


def pair_cells(a: Matrix, digits: int) -> DataFrame:
    """As cells, for all pairs of rows, which are many."""
    return a.df.select("i", "j", rounded(F.col("v"), digits).alias("v"))


def cells3(c: Cube, digits: int = DIGITS) -> DataFrame:
    return c.df.select("i", "j", "k", F.round("v", digits).alias("v"))


def out(source: str, select: str, tail: str = "") -> str:
    return f"WITH {source} SELECT {select} {tail}"


def matrix(name: str, f: Callable[[Matrix], Matrix], select: str, tail: str = "FROM M", digits: int = DIGITS) -> None:
    """An operator on the embeddings; select gives i, j, v."""
    i, j, v = select.split(";")
    register(f"matrix_{name}", lambda s, d: cells(f(inputs.embeddings(s, d)), digits), out(M, f"({i})::BIGINT AS i, ({j})::INTEGER AS j, round({v}, {digits}) AS v", tail))


ROWS = "(SELECT max(i) + 1 FROM M)"
# addressing
matrix("transpose", Matrix.transpose, "j;i;v")
matrix("flip_v", lambda a: a.flip(v=True), "i;63 - j;v")
matrix("flip_h", lambda a: a.flip(h=True), f"{ROWS} - 1 - i;j;v")
matrix("vect", Matrix.vect, f"j * {ROWS} + i;0;v")
matrix("unvect", lambda a: a.vect().unvect(a.m, a.n), "i;j;v")
matrix("row", lambda a: a.row(-1), "0;j;v", f"FROM M WHERE i = {ROWS} - 1")
matrix("col", lambda a: a.col(-1), "i;0;v", "FROM M WHERE j = 63")
matrix("rows", lambda a: a.rows([3, 1, 3]), "p;j;v", "FROM M JOIN (VALUES (0, 3), (1, 1), (2, 3)) x(p, r) ON i = r")
matrix("cols", lambda a: a.cols([5, 5, 0]), "i;p;v", "FROM M JOIN (VALUES (0, 5), (1, 5), (2, 0)) x(p, r) ON j = r")
matrix("extract", lambda a: a.extract([2, 0], [1, 4]), "p;q;v", "FROM M JOIN (VALUES (0, 2), (1, 0)) x(p, r) ON i = r JOIN (VALUES (0, 1), (1, 4)) y(q, c) ON j = c")
matrix("set", lambda a: a.set(-1, 2, 9.0), "i;j;v", f"FROM (SELECT i, j, CASE WHEN i = {ROWS} - 1 AND j = 2 THEN 9 ELSE v END AS v FROM M)")
matrix("set_rows", lambda a: a.set_rows([0, 1], a.rows([2, 3])), "i;j;v", "FROM (SELECT a.i, a.j, coalesce(b.v, a.v) AS v FROM M a LEFT JOIN M b ON a.j = b.j AND a.i + 2 = b.i AND a.i < 2)")
matrix("set_cols", lambda a: a.set_cols([0], a.cols([7])), "i;j;v", "FROM (SELECT a.i, a.j, coalesce(b.v, a.v) AS v FROM M a LEFT JOIN M b ON a.i = b.i AND a.j = 0 AND b.j = 7)")
matrix("submatrix", lambda a: a.submatrix(10, 5, 30, 20), "i - 10;j - 5;v", "FROM M WHERE i BETWEEN 10 AND 39 AND j BETWEEN 5 AND 24")
matrix("set_block", lambda a: a.set_block(2, 3, a.submatrix(0, 0, 5, 5)), "i;j;v", "FROM (SELECT a.i, a.j, coalesce(b.v, a.v) AS v FROM M a LEFT JOIN M b ON a.i - 2 = b.i AND a.j - 3 = b.j AND b.i < 5 AND b.j < 5)")
matrix("delete_row", lambda a: a.delete_row(4), "i - (i > 4)::INTEGER;j;v", "FROM M WHERE i <> 4")
matrix("delete_rows", lambda a: a.delete_rows(4, 9), "CASE WHEN i > 9 THEN i - 6 ELSE i END;j;v", "FROM M WHERE i NOT BETWEEN 4 AND 9")
matrix("delete_col", lambda a: a.delete_col(0), "i;j - 1;v", "FROM M WHERE j <> 0")
matrix("delete_cols", lambda a: a.delete_cols(1, 3), "i;CASE WHEN j > 3 THEN j - 3 ELSE j END;v", "FROM M WHERE j NOT BETWEEN 1 AND 3")
matrix("diag", Matrix.diag, "i;0;v", "FROM M WHERE i = j")
matrix("diag_of_vector", lambda a: a.row(0).diag(), "a.j;b.j;CASE WHEN a.j = b.j THEN a.v ELSE 0.0 END", "FROM M a CROSS JOIN (SELECT DISTINCT j FROM M) b WHERE a.i = 0")
# joins
matrix("add", lambda a: a + a.flip(v=True), "i;j;v", "FROM (SELECT a.i, a.j, a.v + b.v AS v FROM M a JOIN M b ON a.i = b.i AND a.j = 63 - b.j)")
matrix("subtract_matrix", lambda a: a - a.flip(h=True), "i;j;v", f"FROM (SELECT a.i, a.j, a.v - b.v AS v FROM M a JOIN M b ON a.j = b.j AND a.i = {ROWS} - 1 - b.i)")
matrix("subtract_reverse", lambda a: 1.0 - a, "i;j;1 - v")
matrix("multiply_elementwise", lambda a: a * a, "i;j;v * v")
matrix("multiply", lambda a: a.transpose() @ a, "a.j;b.j;sum(a.v * b.v)", "FROM M a JOIN M b ON a.i = b.i GROUP BY a.j, b.j", 4)
matrix("gram", lambda a: a.gram(), "a.j;b.j;sum(a.v * b.v)", "FROM M a JOIN M b ON a.i = b.i GROUP BY a.j, b.j", 4)
matrix("multiply_scalar", lambda a: a * 2.5, "i;j;v * 2.5")
matrix("divide", lambda a: a / 4.0, "i;j;v / 4")
matrix("divide_reverse", lambda a: 1.0 / (a.abs() + 1.0), "i;j;1 / (abs(v) + 1)")
matrix("kronecker_product", lambda a: a.kron(a.submatrix(0, 0, 2, 2)), "a.i * 2 + b.i;a.j * 2 + b.j;a.v * b.v", "FROM M a CROSS JOIN M b WHERE b.i < 2 AND b.j < 2")
matrix("khatri_rao_product", lambda a: a.khatri_rao_product(a.submatrix(0, 0, 3, 64)), "a.i * 3 + b.i;a.j;a.v * b.v", "FROM M a JOIN M b ON a.j = b.j WHERE b.i < 3")
matrix("euclidean_distances", lambda a: a.euclidean_distances(a), "a.j;b.j;sum((a.v - b.v) ** 2)", "FROM M a JOIN M b ON a.i = b.i GROUP BY a.j, b.j", 4)
ROW = "R AS (SELECT vec_id AS i, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings)"
register("matrix_get_distances_euclidean", lambda s, d: pair_cells(inputs.embeddings(s, d).get_distances("euclidean"), 4), out(ROW, "a.i::BIGINT AS i, b.i::INTEGER AS j, round(list_distance(a.x, b.x) ** 2, 4) AS v", "FROM R a CROSS JOIN R b"))
register("matrix_get_distances_manhattan", lambda s, d: pair_cells(inputs.embeddings(s, d).get_distances("manhattan"), 4), out(ROW, "a.i::BIGINT AS i, b.i::INTEGER AS j, round(list_sum(list_transform(list_zip(a.x, b.x), lambda p: abs(p[1] - p[2]))), 4) AS v", "FROM R a CROSS JOIN R b"))
register("matrix_get_distances_cosine", lambda s, d: pair_cells(inputs.embeddings(s, d).get_distances("cosine"), 4), out(ROW, "a.i::BIGINT AS i, b.i::INTEGER AS j, round(CASE WHEN list_inner_product(a.x, b.x) = 0 THEN 1 ELSE list_inner_product(a.x, b.x) / sqrt(list_inner_product(a.x, a.x) * list_inner_product(b.x, b.x)) END, 4) AS v", "FROM R a CROSS JOIN R b"))
for measure in ("pearson", "jaccard"):
    shift = "list_avg" if measure == "pearson" else "list_sum"
    centred = ROW + f", Z AS (SELECT i, list_transform(x, lambda e: e - s) AS x FROM (SELECT i, x, {shift}(x) AS s FROM R)), N AS (SELECT i, x, list_inner_product(x, x) AS q FROM Z)"
    formula = "list_inner_product(a.x, b.x) / sqrt(a.q * b.q)" if measure == "pearson" else "list_inner_product(a.x, b.x) / (a.q + b.q - list_inner_product(a.x, b.x))"
    register(f"matrix_get_distances_{measure}", lambda s, d, m=measure: pair_cells(inputs.embeddings(s, d).get_distances(m), 4), out(centred, f"a.i::BIGINT AS i, b.i::INTEGER AS j, round({formula}, 4) AS v", "FROM N a CROSS JOIN N b"))
register("matrix_get_distances_mahalanobis", lambda s, d: pair_cells(inputs.embeddings(s, d).get_distances("mahalanobis"), 4))
register("matrix_get_distances_kendall", lambda s, d: pair_cells(inputs.embeddings(s, d).get_distances("kendall"), 4))
matrix("bind_row", lambda a: a.bind(a, row=True), "i;j;v", f"FROM (SELECT i, j, v FROM M UNION ALL SELECT i + {ROWS}, j, v FROM M)")
matrix("bind_column", lambda a: a.bind(a, column=True), "i;j;v", "FROM (SELECT i, j, v FROM M UNION ALL SELECT i, j + 64, v FROM M)")


# aggregations over all line items
def aggregate(name: str, f: Callable[[Matrix], DataFrame], sql: str) -> None:
    register(f"matrix_{name}", lambda s, d: f(inputs.items(s, d)), f"WITH {L} {sql}")


for name, method, f in (("means", Matrix.means, "avg(v)"), ("variances", Matrix.variances, "var_samp(v)"), ("col_max", Matrix.col_max, "max(v)"), ("col_min", Matrix.col_min, "min(v)")):
    aggregate(name, lambda a, m=method: cells(m(a)), f"SELECT 0::BIGINT AS i, j, round({f}, 6) AS v FROM L GROUP BY j")
aggregate("col_sums", lambda a: cells(a.col_sums(), 2), "SELECT 0::BIGINT AS i, j, round(sum(v), 2) AS v FROM L GROUP BY j")
aggregate("max", lambda a: a.max(), "SELECT max(v) AS v FROM L")
aggregate("min", lambda a: a.min(), "SELECT min(v) AS v FROM L")
aggregate("col_sum", lambda a: a.col_sum(0).select(F.round("v", 2).alias("v")), "SELECT round(sum(v), 2) AS v FROM L WHERE j = 0")
aggregate("frobenius_norm", lambda a: a.frobenius_norm().select(F.round("v", 4).alias("v")), "SELECT round(sqrt(sum(v * v)), 4) AS v FROM L")
aggregate("count_non_zero_elements", lambda a: a.count_non_zero_elements(), "SELECT count(*) FILTER (abs(v) > 1e-12) AS n FROM L")
aggregate("covariance", lambda a: cells(a.covariance(), 4), "SELECT a.j::BIGINT AS i, b.j AS j, round(covar_samp(a.v, b.v), 4) AS v FROM L a JOIN L b ON a.i = b.i GROUP BY a.j, b.j")
aggregate("correlation", lambda a: cells(a.correlation()), "SELECT a.j::BIGINT AS i, b.j AS j, round(CASE WHEN a.j = b.j THEN 1 ELSE corr(a.v, b.v) END, 6) AS v FROM L a JOIN L b ON a.i = b.i GROUP BY a.j, b.j")
matrix("row_sums", Matrix.row_sums, "i;0;sum(v)", "FROM M GROUP BY i")
register("matrix_row_sum", lambda s, d: inputs.embeddings(s, d).row_sum(-1).select(F.round("v", 6).alias("v")), out(M, "round(sum(v), 6) AS v", f"FROM M WHERE i = {ROWS} - 1"))
register("matrix_trace", lambda s, d: inputs.embeddings(s, d).trace().select(F.round("v", 6).alias("v")), out(M, "round(sum(v), 6) AS v", "FROM M WHERE i = j"))
register("matrix_find_non_zero_elements", lambda s, d: inputs.embeddings(s, d).find_non_zero_elements(3), out(M, "i", "FROM M WHERE j = 3 AND abs(v) > 1e-12"))
register("matrix_find_zeros", lambda s, d: inputs.items(s, d).find_zeros(2).agg(F.count("*").alias("n")), out(L, "count(*) AS n", "FROM L WHERE j = 2 AND abs(v) <= 1e-12"))
# sorts, functions and normalisers
matrix("sort_rows", lambda a: a.sort_rows(0), "r;M.j;M.v", "FROM M JOIN (SELECT i, row_number() OVER (ORDER BY v DESC, i) - 1 AS r FROM M WHERE j = 0) x ON M.i = x.i")
matrix("sort_cols", lambda a: a.sort_cols(0), "M.i;r;M.v", "FROM M JOIN (SELECT j, row_number() OVER (ORDER BY v DESC, j) - 1 AS r FROM M WHERE i = 0) x ON M.j = x.j")
for name, f, sql in (
    ("abs", Matrix.abs, "abs(v)"), ("exp", Matrix.exp, "exp(v)"), ("sqrt", lambda a: a.abs().sqrt(), "sqrt(abs(v))"), ("pow", lambda a: a.pow(2.0), "v ** 2"),
    ("sigmoid", Matrix.sigmoid, "1 / (1 + exp(-v))"), ("log", lambda a: (a.abs() + 0.5).log(), "ln(abs(v) + 0.5)"), ("apply", lambda a: a.apply(lambda x: x * x + 1), "v * v + 1"),
):
    matrix(name, f, f"i;j;{sql}")
matrix("standardize", Matrix.standardize, "i;j;(v - avg(v) OVER (PARTITION BY j)) / stddev_samp(v) OVER (PARTITION BY j)")
matrix("normalize_sum", lambda a: a.abs().normalize("sum"), "i;j;abs(v) / sum(abs(v)) OVER (PARTITION BY j)")
matrix("normalize_length", lambda a: a.normalize("length"), "i;j;v / sqrt(sum(v * v) OVER (PARTITION BY j))")
register("matrix_sym_normalize", lambda s, d: cells(inputs.embeddings(s, d).gram().sym_normalize()), out(M + ", P AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM M a JOIN M b ON a.i = b.i GROUP BY a.j, b.j)", "P.i::BIGINT AS i, P.j AS j, round(P.v / sqrt(x.v * y.v), 6) AS v", "FROM P JOIN P x ON x.i = x.j AND x.i = P.i JOIN P y ON y.i = y.j AND y.i = P.j"))
register("matrix_quantize", lambda s, d: cells(inputs.embeddings(s, d).quantize(4)))


# linear algebra on the 64 x 64 Gram matrix, plus the identity
def spd(s: SparkSession, d: str) -> Matrix:
    a = inputs.embeddings(s, d).gram()
    return Matrix.from_array(s, a.to_numpy() / a.m + np.eye(a.m))


def one(s: SparkSession, **values) -> DataFrame:
    return s.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{k} double" for k in values))


register("matrix_inverse", lambda s, d: cells(spd(s, d) @ decomp.inverse(spd(s, d))), out(M, "a.j::BIGINT AS i, b.j AS j, CASE WHEN a.j = b.j THEN 1.0 ELSE 0.0 END::DOUBLE AS v", "FROM (SELECT DISTINCT j FROM M) a CROSS JOIN (SELECT DISTINCT j FROM M) b"))
register("matrix_det", lambda s, d: one(s, v=decomp.det(spd(s, d))))
register("matrix_solve", lambda s, d: cells(decomp.solve(inputs.embeddings(s, d).cols(range(1, 64)), inputs.embeddings(s, d).col(0))))
register("matrix_cholesky", lambda s, d: cells((lambda u: u.transpose() @ u)(decomp.cholesky(spd(s, d))), 4), out(M, "a.j::BIGINT AS i, b.j AS j, round(sum(a.v * b.v) / 64 + CASE WHEN a.j = b.j THEN 1 ELSE 0 END, 4) AS v", "FROM M a JOIN M b ON a.i = b.i GROUP BY a.j, b.j"))
register("matrix_is_spd", lambda s, d: s.createDataFrame([(decomp.is_spd(spd(s, d)),)], "v boolean"), "SELECT true AS v")
register("matrix_is_symmetric", lambda s, d: s.createDataFrame([(spd(s, d).is_symmetric(),)], "v boolean"), "SELECT true AS v")
register("matrix_is_equal", lambda s, d: s.createDataFrame([((lambda a: a.is_equal(a.transpose().transpose()))(inputs.embeddings(s, d)),)], "v boolean"), "SELECT true AS v")
register("matrix_eigen", lambda s, d: cells(decomp.eigen(spd(s, d))[0]))
register("matrix_power_method", lambda s, d: one(s, v=round(decomp.power_method(spd(s, d), precision=1e-12)[0], 6)))
register("matrix_svd", lambda s, d: cells(Matrix.from_array(s, decomp.svd(inputs.embeddings(s, d))[1][:, None])))
register("matrix_norm2", lambda s, d: one(s, v=decomp.norm2(inputs.embeddings(s, d))))
register("matrix_rank", lambda s, d: one(s, v=decomp.rank(inputs.embeddings(s, d))))
register("matrix_pseudoinverse", lambda s, d: cells(decomp.pseudoinverse(inputs.embeddings(s, d))))
register("matrix_nnls", lambda s, d: cells((lambda a: decomp.nnls(a.cols(range(1, 64)), a.col(0)))(inputs.embeddings(s, d))))
register("matrix_nmf", lambda s, d: cells((lambda w, h: Matrix.from_array(s, h))(*decomp.nmf(inputs.embeddings(s, d).abs(), 4))))
register("matrix_bistochastic", lambda s, d: cells(decomp.bistochastic(spd(s, d))))
register("matrix_binormalize", lambda s, d: cells(decomp.binormalize(spd(s, d).abs())))


# time series
def ts(name: str, f: Callable, sql: str | None, digits: int = 4) -> None:
    register(f"ts_{name}", lambda s, d: cells(f(inputs.series(s, d)), digits), sql and f"WITH {T}{sql}")


ts("tdiff", lambda x: x.tdiff(2), " SELECT i, j, round(coalesce(v - lag(v, 2) OVER (PARTITION BY j ORDER BY i), 0), 4) AS v FROM T")
ts("moving_average", lambda x: x.moving_average(5), " SELECT (i - 2)::BIGINT AS i, j, round(m, 4) AS v FROM (SELECT i, j, avg(v) OVER (PARTITION BY j ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM T) WHERE i BETWEEN 2 AND (SELECT max(i) FROM T) - 2")
ts("detrend_0", lambda x: x.detrend(0), " SELECT i, j, round(v - avg(v) OVER (PARTITION BY j), 4) AS v FROM T")
ts("detrend_1", lambda x: x.detrend(1), " SELECT T.i, T.j, round(v - a - b * (T.i + 1), 4) AS v FROM T JOIN (SELECT j, regr_slope(v, i + 1) AS b, regr_intercept(v, i + 1) AS a FROM T GROUP BY j) f ON T.j = f.j")
ts("detrend_2", lambda x: x.detrend(2), None)
CENTRED = "Z AS (SELECT i, j, v - avg(v) OVER (PARTITION BY j) AS v FROM T)"
ts("autocovariance", lambda x: x.autocovariance(5), f", {CENTRED} SELECT (b.i - a.i)::BIGINT AS i, a.j AS j, round(sum(a.v * b.v), 2) AS v FROM Z a JOIN Z b ON a.j = b.j AND b.i - a.i BETWEEN 0 AND 4 GROUP BY b.i - a.i, a.j", 2)
ts("autocorrelation", lambda x: x.autocorrelation(5), f", {CENTRED} SELECT (b.i - a.i)::BIGINT AS i, a.j AS j, round(sum(a.v * b.v) / any_value(q), 4) AS v FROM Z a JOIN Z b ON a.j = b.j AND b.i - a.i BETWEEN 0 AND 4 JOIN (SELECT j, sum(v * v) AS q FROM Z GROUP BY j) n ON n.j = a.j GROUP BY b.i - a.i, a.j")
ts("crosscovariance", lambda x: x.crosscovariance(x, 1), f", {CENTRED} SELECT a.j::BIGINT AS i, b.j AS j, round(sum(a.v * b.v) / (SELECT max(i) + 1 FROM T), 2) AS v FROM Z a JOIN Z b ON b.i = a.i + 1 GROUP BY a.j, b.j", 2)
ts("crosscorrelation", lambda x: x.crosscorrelation(x, 1), f", {CENTRED}, N AS (SELECT j, var_pop(v) AS q FROM T GROUP BY j) SELECT a.j::BIGINT AS i, b.j AS j, round(sum(a.v * b.v) / (SELECT max(i) + 1 FROM T) / sqrt(any_value(x.q) * any_value(y.q)), 4) AS v FROM Z a JOIN Z b ON b.i = a.i + 1 JOIN N x ON x.j = a.j JOIN N y ON y.j = b.j GROUP BY a.j, b.j")

def ts_align(s: SparkSession, d: str) -> DataFrame:
    """Warping of every event type's series against that of the first."""
    x = inputs.series(s, d)
    one_ = x.df.groupBy("j").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda c: F.array(c["v"])).alias("x"))
    first = one_.where("j = 0").select(F.col("x").alias("y"))
    return timeseries.align(one_.join(F.broadcast(first), F.lit(True)).select(F.col("j").cast("long").alias("pair"), "x", "y"))


register("ts_align", ts_align)
# kernels
register("kernel_linear", lambda s, d: pair_cells(Kernel.compute_from_matrix(inputs.embeddings(s, d), "linear"), 4), out(ROW, "a.i::BIGINT AS i, b.i::INTEGER AS j, round(list_inner_product(a.x, b.x), 4) AS v", "FROM R a CROSS JOIN R b"))
register("kernel_rbf", lambda s, d: pair_cells(Kernel.compute_from_matrix(inputs.embeddings(s, d), "RBF", 245.0), 4), out(ROW, "a.i::BIGINT AS i, b.i::INTEGER AS j, round(exp(-(list_distance(a.x, b.x) ** 2) / 245), 4) AS v", "FROM R a CROSS JOIN R b"))
register("kernel_distance", lambda s, d: cells(Kernel.compute_from_matrix(inputs.nations(s, d).get_adjacency_matrix(), "linear").get_distance_matrix(), 2), out(A, "a.i, b.i::INTEGER AS j, round(sum((a.v - b.v) ** 2), 2) AS v", "FROM A a JOIN A b ON a.j = b.j GROUP BY a.i, b.i"))
register("kernel_center", lambda s, d: cells((lambda a: Kernel(a.df, a.m).center())(inputs.nations(s, d).get_adjacency_matrix()), 4), out(A, "i, j, round(v - avg(v) OVER (PARTITION BY j) - avg(v) OVER (PARTITION BY i) + avg(v) OVER (), 4) AS v", "FROM A"))
for kind in ("CT", "VN", "RF", "RWR", "RCT"):
    register(f"kernel_{kind.lower()}", lambda s, d, k=kind: cells(Kernel.compute_from_matrix(inputs.nations(s, d).get_adjacency_matrix(), k)))
register("kernel_diffusion_map", lambda s, d: cells((lambda a: Kernel(a.df, a.m).diffusion_map(3))(inputs.nations(s, d).get_adjacency_matrix())))
# graphs
register("graph_edges", lambda s, d: inputs.nations(s, d).edges, out(G, "src, dst, w", "FROM G"))
register("graph_degree", lambda s, d: inputs.nations(s, d).degree(), out(G, "src AS id, sum(CASE WHEN w = 0 THEN 1 ELSE w END) AS degree", "FROM B GROUP BY src"))
register("graph_adjacency", lambda s, d: cells(inputs.nations(s, d).get_adjacency_matrix()), out(A, "i, j, v", "FROM A"))
register("graph_neighbours", lambda s, d: inputs.nations(s, d).neighbours(3), out(G, "dst AS id", "FROM B WHERE src = 3"))
register("graph_export_layout", lambda s, d: inputs.nations(s, d).export().select("line"), out(G, "src || chr(9) || dst || chr(9) || w AS line", "FROM G"))
register("graph_community", lambda s, d: (lambda c, q: s.createDataFrame([(k, v, round(q, 9)) for k, v in c.items()], "id long, community long, modularity double"))(*inputs.nations(s, d).community()))
register("graph_relevant_subgraph", lambda s, d: inputs.nations(s, d).get_relevant_subgraph([1, 5, 9], 0.0001, 10))


# tensors
def cube3(name: str, f: Callable[[Cube], Cube], select: str, tail: str = "FROM C", digits: int = 4) -> None:
    register(f"cube_{name}", lambda s, d: cells3(f(inputs.cube(s, d)), digits), out(C, f"{select}", tail))


SLICES = "(SELECT max(k) + 1 FROM C)"
register("cube_unfold_1", lambda s, d: cells(inputs.cube(s, d).unfold(1)), out(C, "i, (k * 3 + j)::INTEGER AS j, v", "FROM C"))
register("cube_unfold_2", lambda s, d: cells(inputs.cube(s, d).unfold(2)), out(C, "j AS i, (k * 25 + i)::INTEGER AS j, v", "FROM C"))
register("cube_unfold_3", lambda s, d: cells(inputs.cube(s, d).unfold(3)), out(C, "k AS i, (i * 3 + j)::INTEGER AS j, v", "FROM C"))
for mode in (1, 2, 3):
    cube3(f"fold_{mode}", lambda c, m=mode: Cube.fold(c.unfold(m), m, *c.shape), "i, j, k, v")
register("cube_vect", lambda s, d: cells(inputs.cube(s, d).vect()), out(C, "(k * 75 + j * 25 + i)::BIGINT AS i, 0::INTEGER AS j, v", "FROM C"))
cube3("unvect", lambda c: Cube.unvect(c.vect(), *c.shape), "i, j, k, v")
register("cube_slice_frontal", lambda s, d: cells(inputs.cube(s, d).get_slice(2, 0)), out(C, "i, j::INTEGER AS j, v", "FROM C WHERE k = 0"))
register("cube_slice_lateral", lambda s, d: cells(inputs.cube(s, d).get_slice(1, 1)), out(C, "i, k::INTEGER AS j, v", "FROM C WHERE j = 1"))
register("cube_slice_horizontal", lambda s, d: cells(inputs.cube(s, d).get_slice(0, 2)), out(C, "k AS i, j::INTEGER AS j, v", "FROM C WHERE i = 2"))
cube3("add", lambda c: c + c, "i, j, k, v + v AS v")
cube3("subtract", lambda c: c.subtract(1.0, reverse=True), "i, j, k, 1 - v AS v")
cube3("multiply_elementwise", lambda c: c * c, "i, j, k, v * v AS v")
cube3("divide_elementwise", lambda c: c / 8.0, "i, j, k, round(v / 8, 4) AS v")
cube3("apply", lambda c: c.apply(lambda x: F.sqrt(x)), "i, j, k, round(sqrt(v), 4) AS v")
cube3("multiply_with_matrix", lambda c: c.multiply_with_matrix(2, Matrix.from_array(c.df.sparkSession, [[1.0, 2.0, 3.0], [0.0, 1.0, 0.0]])), "i, r AS j, k, sum(v * x) AS v", "FROM C JOIN (VALUES (0::BIGINT, 0, 1.0::DOUBLE), (0, 1, 2.0), (0, 2, 3.0), (1, 0, 0.0), (1, 1, 1.0), (1, 2, 0.0)) a(r, c, x) ON C.j = a.c GROUP BY i, r, k")
register("cube_max", lambda s, d: cells(inputs.cube(s, d).max(3)), out(C, "i, j::INTEGER AS j, max(v) AS v", "FROM C GROUP BY i, j"))
register("cube_min", lambda s, d: cells(inputs.cube(s, d).min(1)), out(C, "k AS i, j::INTEGER AS j, min(v) AS v", "FROM C GROUP BY k, j"))
register("cube_frobenius_norm", lambda s, d: inputs.cube(s, d).frobenius_norm().select(F.round("v", 4).alias("v")), out(C, "round(sqrt(sum(v * v)), 4) AS v", "FROM C"))
register("cube_dims", lambda s, d: s.createDataFrame([inputs.cube(s, d).dims()], "m long, n long, o long"), out(C, "(max(i) + 1)::BIGINT AS m, (max(j) + 1)::BIGINT AS n, (max(k) + 1)::BIGINT AS o", "FROM C"))


def fit_error(f: Callable[[np.ndarray], float]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: one(s, v=f(inputs.cube(s, d).to_numpy()))


def rebuilt(x: np.ndarray, core: np.ndarray, factors) -> float:
    return float(np.linalg.norm(x - tensor.compose(core, factors)) / np.linalg.norm(x))


register("cube_hosvd", fit_error(lambda x: round(rebuilt(x, *tensor.hosvd(x)), 6)), "SELECT 0.0::DOUBLE AS v")
register("cube_cp", fit_error(lambda x: tensor.cp(x, 2)[2] / float((x**2).sum())))
register("cube_nncp", fit_error(lambda x: tensor.cp(x, 2, nonnegative=True)[2] / float((x**2).sum())))
register("cube_ccd", fit_error(lambda x: (lambda f, w, _: tensor.ccd(x, f, w))(*tensor.cp(x, 2))))
register("cube_tucker", fit_error(lambda x: rebuilt(x, *tensor.tucker(x, (2, 2, 2)))))
register("cube_ntd", fit_error(lambda x: rebuilt(x, *tensor.ntd(x, (2, 2, 2)))))
register("cube_tcc", fit_error(lambda x: round(float((lambda f: np.diag(tensor.tcc(f, f)).sum())(tensor.cp(x, 2)[0])), 6)), "SELECT 2.0::DOUBLE AS v")
register("cube_rescal", fit_error(lambda x: (lambda y, a, r: float(np.linalg.norm(y - np.einsum("ip,pqk,jq->ijk", a, r, a)) / np.linalg.norm(y)))(np.einsum("ijk,ljk->ilk", x, x), *tensor.rescal(np.einsum("ijk,ljk->ilk", x, x), 2))))
register("cube_parafac2", fit_error(lambda x: tensor.parafac2([x[:, :, k] for k in range(x.shape[2])], 2)[4] / float((x**2).sum())))


# clustering
def rows_of(s: SparkSession, d: str) -> DataFrame:
    return cluster.row_frame(inputs.read(s, d, "embeddings"), "vec_id", "embedding")


def by_label(s: SparkSession, d: str) -> DataFrame:
    """Memberships from the labels: 0.7 in one's own cluster, the rest even."""
    own = inputs.read(s, d, "embeddings").select(F.col("vec_id").alias("i"), "label", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("c"))
    return own.select("c", "i", F.when(F.col("c") == F.col("label"), 0.7).otherwise(0.3 / 9).alias("u"))


FCM = M + """, X AS (SELECT unnest(range(10))::INTEGER AS c), U AS (SELECT c, vec_id AS i, CASE WHEN c = label THEN 0.7::DOUBLE ELSE 0.3::DOUBLE / 9 END AS u FROM embeddings CROSS JOIN X),
P AS (SELECT c, j, sum(u * u * v) / sum(u * u) AS p FROM U JOIN M USING (i) GROUP BY c, j), D AS (SELECT i, c, sqrt(sum((v - p) ** 2)) AS d FROM M JOIN P USING (j) GROUP BY i, c)"""
register("fcm_prototypes", lambda s, d: cluster.get_prototypes(rows_of(s, d), by_label(s, d)).select("c", "j", F.round("p", 6).alias("p")), out(FCM, "c, j, round(p, 6) AS p", "FROM P"))
register("fcm_distances", lambda s, d: cluster.prototype_distances(rows_of(s, d), cluster.get_prototypes(rows_of(s, d), by_label(s, d))).select("i", "c", F.round("d", 5).alias("d")), out(FCM, "i, c, round(d, 5) AS d", "FROM D"))
register("fcm_update", lambda s, d: cluster.update_partition(cluster.prototype_distances(rows_of(s, d), cluster.get_prototypes(rows_of(s, d), by_label(s, d)))).select("c", "i", F.round("u", 5).alias("u")), out(FCM, "c, i, round(d ** -2 / sum(d ** -2) OVER (PARTITION BY i), 5) AS u", "FROM D"))
register("fcm_mahalanobis", lambda s, d: cluster.mahalanobis_distances(rows_of(s, d), by_label(s, d), cluster.get_prototypes(rows_of(s, d), by_label(s, d))))


def start(s: SparkSession, d: str, k: int = 5) -> np.ndarray:
    """The first k vectors as centres."""
    return np.array([r["x"] for r in rows_of(s, d).where(F.col("i") < k).orderBy("i").collect()])


KM = ROW + """, S AS (SELECT i AS c, x FROM R WHERE i < 5), W AS (SELECT R.i, min_by(c, list_distance(R.x, S.x) * 1000000 + c * 1e-9) AS c FROM R CROSS JOIN S GROUP BY R.i)"""
register("kmeans_assign", lambda s, d: cluster.assign(rows_of(s, d), start(s, d)).select("i", F.col("c").cast("long").alias("c")), out(KM, "i, c", "FROM W"))
register("kmeans_step", lambda s, d: cells(Matrix.from_array(s, cluster.kmeans_step(rows_of(s, d), start(s, d)))), out(KM + ", " + M, "c::BIGINT AS i, j, round(avg(v), 6) AS v", "FROM M JOIN W ON M.i = W.i GROUP BY c, j"))
register("kmeans", lambda s, d: cluster.kmeans(rows_of(s, d), 5, 20)[0])


def gmm(s: SparkSession, d: str) -> cluster.GaussianMixture:
    x = inputs.read(s, d, "lineitem").select(F.monotonically_increasing_id().alias("i"), F.array((F.col("l_quantity") / 50.0), F.col("l_discount") * 10.0, F.col("l_tax") * 10.0).alias("x"))
    return cluster.GaussianMixture(x, 2, "diagonal", rounds=5).initialize().expectation_maximization()


register("gmm_log_likelihood", lambda s, d: one(s, v=gmm(s, d).log_likelihood()))
register("gmm_classify", lambda s, d: gmm(s, d).naive_bayes_classifier().groupBy("c").agg(F.count("*").alias("n")))


# sequences
def symbols(s: SparkSession, d: str) -> DataFrame:
    """Event types of each user in order of time, numbered by name."""
    df = inputs.read(s, d, "events")
    names = df.select("event_type").distinct().select("event_type", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("int").alias("sym"))  # a handful of types
    return df.join(F.broadcast(names), "event_type").groupBy(F.col("user_id").alias("seq_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "sym"))), lambda x: x["sym"]).alias("symbols"))


def two_states() -> sequences.HiddenMarkov:
    return sequences.HiddenMarkov(2, 5, [[0.7, 0.3], [0.4, 0.6]], [[0.3, 0.3, 0.2, 0.1, 0.1], [0.1, 0.1, 0.2, 0.3, 0.3]])


def hmm_train(s: SparkSession, d: str) -> DataFrame:
    model = two_states()
    model.train(symbols(s, d), 3)
    return cells(Matrix.from_array(s, np.hstack([model.a, model.b])))


register("hmm_encode", lambda s, d: symbols(s, d).select("seq_id", F.array_join(F.transform("symbols", lambda x: x.cast("string")), ",").alias("symbols")), "WITH Y AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS sym FROM (SELECT DISTINCT event_type FROM events)) SELECT user_id AS seq_id, string_agg(sym::VARCHAR, ',' ORDER BY ts, event_id) AS symbols FROM events JOIN Y USING (event_type) GROUP BY user_id")
register("hmm_viterbi", lambda s, d: two_states().decode(symbols(s, d)).select("seq_id", F.array_join(F.transform("path", lambda x: x.cast("string")), "").alias("path")))
register("hmm_train", hmm_train)


def rvm(s: SparkSession, d: str) -> DataFrame:
    got = inputs.read(s, d, "embeddings").orderBy("vec_id").toPandas()  # a design matrix of the driver's size
    x, t = np.stack(got["embedding"].to_numpy()).astype(float), (got["label"].to_numpy() < 5).astype(float)
    model = sequences.RelevanceVectors().train(x, t, rounds=200)
    found = model.classify(x)
    return s.createDataFrame([(int(i), int(c), float(round(p, 6))) for i, (c, p) in zip(got["vec_id"], found)], "i long, c int, p double")


register("rvm_classify", rvm)


# labware and imaging
def plates(s: SparkSession, d: str) -> DataFrame:
    """A 96-well plate for each nation."""
    return inputs.read(s, d, "nation").select(F.col("n_name").alias("plate_id"), F.lit(8).alias("nrows"), F.lit(12).alias("ncols"))


P = "P AS (SELECT n_name AS plate_id, chr((65 + r)::INTEGER) || (c + 1) AS position, chr((65 + r)::INTEGER) AS row, (r + 1)::INTEGER AS row_idx, (c + 1)::INTEGER AS col, (r * 12 + c + 1)::INTEGER AS idx FROM nation CROSS JOIN range(8) a(r) CROSS JOIN range(12) b(c))"
WELL = ("plate_id", "position", "row", "row_idx", "col", "idx")
register("labware_layout", lambda s, d: labware.layout(plates(s, d)).select(*WELL), out(P, "*", "FROM P"))
register("labware_get_well", lambda s, d: labware.get_well(labware.layout(plates(s, d)), "C04").select(*WELL), out(P, "*", "FROM P WHERE position = 'C4'"))
register("labware_get_well_by_idx", lambda s, d: labware.get_well_by_idx(labware.layout(plates(s, d)), 30).select(*WELL), out(P, "*", "FROM P WHERE idx = 30"))
register("labware_get_row", lambda s, d: labware.get_row(labware.layout(plates(s, d)), "B").select(*WELL), out(P, "*", "FROM P WHERE row = 'B'"))
register("labware_get_col", lambda s, d: labware.get_col(labware.layout(plates(s, d)), 7).select(*WELL), out(P, "*", "FROM P WHERE col = 7"))
register("labware_replicate", lambda s, d: labware.replicate(labware.layout(plates(s, d)), 3).select(*WELL), out(P, "plate_id || '-' || n AS plate_id, position, row, row_idx, col, idx", "FROM P CROSS JOIN range(1, 4) x(n)"))
held = lambda s, d: inputs.read(s, d, "customer").join(inputs.read(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("plate_id"), F.concat(F.char((F.lit(65) + F.col("c_custkey") % 4).cast("long")), (F.col("c_custkey") % 12 + 1).cast("string")).alias("position"), F.col("c_custkey").alias("item_id"))
HELD = "Q AS (SELECT n_name AS plate_id, chr((65 + c_custkey % 4)::INTEGER) || (c_custkey % 12 + 1) AS position, c_custkey AS item_id FROM customer JOIN nation ON c_nationkey = n_nationkey)"
register("labware_filled_wells", lambda s, d: labware.filled_wells(labware.layout(plates(s, d)), held(s, d)).select(*WELL), out(f"{P}, {HELD}", "*", "FROM P WHERE EXISTS (SELECT 1 FROM Q WHERE Q.plate_id = P.plate_id AND Q.position = P.position)"))
register("labware_duplicate", lambda s, d: labware.duplicate(held(s, d), ("NATION_3", "A1"), ("NATION_5", "B2")), out(HELD, "plate_id, position, item_id", "FROM Q WHERE NOT (plate_id = 'NATION_5' AND position = 'B2') UNION ALL SELECT 'NATION_5', 'B2', item_id FROM Q WHERE plate_id = 'NATION_3' AND position = 'A1'"))
listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
register("imaging_tracking", lambda s, d: imaging.tracking_data(inputs.tracking(s, d)).select("idx", listed("children"), listed("parents")), out(K, "idx, coalesce(string_agg(child::VARCHAR, ',' ORDER BY child), '') AS children, coalesce(string_agg(parent::VARCHAR, ',' ORDER BY parent), '') AS parents", "FROM (SELECT obj_idx1 AS idx, obj_idx2 AS child, NULL AS parent FROM K UNION ALL SELECT obj_idx2, NULL, obj_idx1 FROM K) GROUP BY idx"))
register("imaging_objects_by_time", lambda s, d: imaging.objects_by_time(inputs.objects(s, d), 5).select("idx", "obj_label_id"), out(O, "idx, obj_label_id", "FROM O WHERE time_idx = 5"))
register("imaging_children", lambda s, d: imaging.children(inputs.objects(s, d), inputs.tracking(s, d), 10).select("idx"), out(K, "obj_idx2 AS idx", "FROM K WHERE obj_idx1 = 10"))
register("imaging_parents", lambda s, d: imaging.parents(inputs.objects(s, d), inputs.tracking(s, d), 904).select("idx"), out(K, "obj_idx1 AS idx", "FROM K WHERE obj_idx2 = 904"))
links = lambda s, d: inputs.tracking(s, d).select(F.col("obj_label_id").alias("obj_id"), (F.row_number().over(Window.partitionBy("obj_label_id").orderBy("ts", "obj_idx1"))).alias("pos"), F.col("obj_idx1").alias("idx1"), F.col("obj_idx2").alias("idx2"))
register("imaging_events", lambda s, d: imaging.all_events(links(s, d)).select("obj_id", listed("objects")), out(O, "obj_label_id AS obj_id, string_agg(idx::VARCHAR, ',' ORDER BY ts, idx) AS objects", "FROM O GROUP BY obj_label_id HAVING count(*) > 1"))
classes = lambda s, d: imaging.all_classes(inputs.read(s, d, "nation").select(F.col("n_nationkey").alias("ord"), (F.col("n_nationkey") + 1).alias("label"), F.col("n_name").alias("name"), F.lit("#fff").alias("color")))
register("imaging_classes", lambda s, d: classes(s, d).select(F.col("idx").cast("long").alias("idx"), F.col("label").cast("long").alias("label"), "name", "color"), "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS idx, (n_nationkey + 1)::BIGINT AS label, n_name AS name, '#fff' AS color FROM nation")
# containers
register("container_groups", lambda s, d: container.list_children(inputs.paths(s, d), "/", "group"), out(H, "name", "FROM H WHERE parent = '/' AND kind = 'group'"))
register("container_all_groups", lambda s, d: container.list_below(inputs.paths(s, d)), out(H, "path, len(string_split(path, '/'))::INTEGER AS depth", "FROM H WHERE kind = 'group'"))
register("container_datasets", lambda s, d: inputs.paths(s, d).where("kind = 'dataset'").select("parent", "name"), out(H, "parent, name", "FROM H WHERE kind = 'dataset'"))
register("container_slice", lambda s, d: container.hyperslab(inputs.embeddings(s, d).df.select(F.array("i", F.col("j").cast("long")).alias("idx"), F.col("v").alias("value")), [1, 2], [3, 10], [100, 4], [2, 3]).select(F.col("idx")[0].alias("i"), F.col("idx")[1].alias("j"), F.round("value", 6).alias("v")), out(M, "i, j::BIGINT AS j, round(v, 6) AS v", "FROM M WHERE i >= 1 AND i < 1 + 99 * 3 + 2 AND (i - 1) % 3 < 2 AND j >= 2 AND j < 2 + 3 * 10 + 3 AND (j - 2) % 10 < 3"))
for module in (handles, solvers):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
