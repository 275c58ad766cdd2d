"""The array operators against NumPy, DuckDB and invariants."""

import duckdb
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gridloom.operators import cluster, decomp, imaging, kernels, labware, sequences, tensor, timeseries
from gridloom.operators.graph import Graph, limited_walks
from gridloom.operators.matrix import Matrix, rounded, row_measure
from gridloom.operators.tensor import Cube
from gridloom.plans.catalog import QUERIES, SQL
from gridloom.sources.container import Container

X = np.random.default_rng(0).normal(size=(12, 5))


@pytest.fixture(scope="module")
def a(spark):
    return Matrix.from_array(spark, X)


def same(m, x, tolerance=1e-9):
    assert m.dims() == np.shape(x)
    assert np.allclose(m.to_numpy(), x, atol=tolerance)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 64 * 64
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_addressing(a):
    same(a.row(-1), X[-1:])
    same(a.col(1), X[:, 1:2])
    same(a.extract([3, 3, 0], [4, 1]), X[[3, 3, 0]][:, [4, 1]])
    same(a.submatrix(2, 1, 4, 3), X[2:6, 1:4])
    same(a.delete_rows(1, 3), np.delete(X, [1, 2, 3], axis=0))
    same(a.delete_col(2), np.delete(X, 2, axis=1))
    same(a.flip(v=True, h=True), X[::-1, ::-1])
    same(a.vect().unvect(12, 5), X)
    y = X.copy()
    y[[0, 5]] = X[[1, 2]]
    same(a.set_rows([0, 5], a.rows([1, 2])), y)
    assert a.get(-1, -1) == X[-1, -1] and a.set(0, 0, 7.0).get(0, 0) == 7.0
    with pytest.raises(ValueError):
        a.submatrix(10, 0, 5, 5)


def test_algebra(spark, a):
    same(a.transpose() @ a, X.T @ X)
    same(a.gram(), X.T @ X)
    same(a + a, 2 * X)
    same(1.0 - a, 1 - X)
    same(a * a, X * X)
    same(a.kron(a.submatrix(0, 0, 2, 2)), np.kron(X, X[:2, :2]))
    same(a.standardize(), (X - X.mean(0)) / X.std(0, ddof=1))
    same(a.correlation(), np.corrcoef(X.T))
    same(a.sort_rows(2), X[np.argsort(-X[:, 2], kind="stable")])
    assert a.is_equal(a) and not a.is_equal(a + 1.0)
    zero = Matrix.zero(spark, 2, 2)
    assert np.isinf((1.0 / zero).to_numpy()).all() and np.isneginf(zero.log().to_numpy()).all()
    with pytest.raises(ValueError):
        a @ a


def test_text_round_trip(spark, a, tmp_path):
    (tmp_path / "m.txt").write_text(a.as_string(rownames=[f"r{i}" for i in range(12)], colnames=list("abcde"), corner="x"))
    m, rows, columns = Matrix.load(spark, str(tmp_path / "m.txt"), "\t", colnames=True, rownames=True)
    same(m, X)
    assert columns == list("abcde") and rows == [f"r{i}" for i in range(12)]


@pytest.mark.parametrize("measure", ["pearson", "cosine", "mahalanobis", "jaccard", "manhattan", "euclidean", "kendall", "none"])
def test_distances(a, measure, monkeypatch):
    monkeypatch.setattr("gridloom.operators.matrix.BLOCK_ROWS", 5)
    same(a.get_distances(measure), row_measure(measure, X, X, np.linalg.inv(np.cov(X.T))))


def test_solvers(spark, a):
    spd = Matrix.from_array(spark, X.T @ X)
    same(decomp.inverse(spd) @ spd, np.eye(5))
    u = decomp.cholesky(spd).to_numpy()
    assert np.allclose(u.T @ u, X.T @ X) and decomp.is_spd(spd)
    values, vectors = decomp.eigen(spd)
    assert np.allclose(X.T @ X @ vectors.to_numpy(), vectors.to_numpy() * values.to_numpy()[:, 0])
    assert decomp.power_method(spd, precision=1e-12)[0] == pytest.approx(values.to_numpy().max())
    assert decomp.rank(a) == 5 and decomp.norm2(a) == pytest.approx(np.linalg.norm(X, 2))
    b = np.abs(X[:, :1])
    x = decomp.nnls(a, Matrix.from_array(spark, b)).to_numpy()
    gradient = X.T @ (b - X @ x)
    assert (x >= 0).all() and (gradient < 1e-8).all() and np.allclose(gradient * x, 0, atol=1e-8)
    w, h = decomp.nmf(a.abs(), 3)
    assert np.linalg.norm(np.abs(X) - w @ h) < np.linalg.norm(np.abs(X))
    q = decomp.bistochastic(Matrix.from_array(spark, np.abs(X.T @ X))).to_numpy()
    assert np.allclose(q.sum(axis=1), 1, atol=1e-6)


def test_time_series(spark, a):
    t = timeseries.TimeSeries.of(a)
    same(t.tdiff(2), np.vstack([np.zeros((2, 5)), X[2:] - X[:-2]]))
    same(t.moving_average(3), (X[:-2] + X[1:-1] + X[2:]) / 3)
    for p in (0, 1, 2, 3):
        design = np.vander((np.arange(12) + 1) / 12, p + 1)
        same(t.detrend(p), X - design @ np.linalg.lstsq(design, X, rcond=None)[0], 1e-6)
    c = X - X.mean(0)
    same(t.autocovariance(3), np.array([(c[: 12 - k] * c[k:]).sum(0) for k in range(3)]))
    assert np.allclose(t.autocorrelation(3).to_numpy()[0], 1)
    same(t.crosscovariance(t, 2, wrap=True), c.T @ np.roll(c, -2, axis=0) / 12)
    assert timeseries.warp(X, X)[1] == 0 and timeseries.warp(X, X[3:])[1] == pytest.approx(timeseries.warp(X[3:], X)[1])


def test_kernels(spark, a):
    k = kernels.Kernel.compute_from_matrix(a, "linear")
    centred = X - X.mean(0)
    same(k.center(), centred @ centred.T)
    same(k.get_distance_matrix(), row_measure("euclidean", X, X))
    with pytest.raises(ValueError):
        kernels.Kernel(a.df, 12, 5)


def test_tensor(spark):
    x = np.random.default_rng(1).random((4, 3, 5))
    c = Cube.from_numpy(spark, x)
    for mode in (1, 2, 3):
        assert np.allclose(Cube.fold(c.unfold(mode), mode, 4, 3, 5).to_numpy(), x)
    assert np.allclose(Cube.unvect(c.vect(), 4, 3, 5).to_numpy(), x)
    b = np.random.default_rng(2).random((2, 3))
    assert np.allclose(c.multiply_with_matrix(2, Matrix.from_array(spark, b)).to_numpy(), np.einsum("ijk,rj->irk", x, b))
    same(c.max(3), x.max(axis=2))
    core, factors = tensor.hosvd(x)
    assert np.allclose(tensor.compose(core, factors), x)
    low = np.einsum("ir,jr,kr->ijk", *[np.random.default_rng(s).random((n, 2)) for s, n in enumerate((4, 3, 5))])
    factors, weights, error = tensor.cp(low, 2)
    assert error < 1e-3 * (low**2).sum() and tensor.ccd(low, factors, weights) > 80
    assert np.allclose(np.diag(tensor.tcc(factors, factors)), 1)
    for f in (tensor.tucker, tensor.ntd):
        assert np.linalg.norm(low - tensor.compose(*f(low, (2, 2, 2)))) < 0.1 * np.linalg.norm(low)
    assert tensor.parafac2([low[:, :, k] for k in range(5)], 2)[4] < 1e-2 * (low**2).sum()


def test_graph(spark, tmp_path):
    (tmp_path / "g.txt").write_text("a\tb\nb\tc\t2\na\ta\t5\nb\ta\t3\nd\te\t0\n//NODECLASS a 7\n")
    g = Graph.read(spark, str(tmp_path / "g.txt"))
    assert sorted(map(tuple, g.edges.collect())) == [("a", "b", 3.0), ("b", "c", 2.0)]
    assert {r["id"]: r["degree"] for r in g.degree().collect()} == {"a": 3.0, "b": 5.0, "c": 2.0}
    same(g.get_adjacency_matrix(), [[0, 3, 0], [3, 0, 2], [0, 2, 0]])
    write = lambda df: spark.createDataFrame(df.collect(), df.schema)
    pairs = Graph(spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (7, 9, 1.0)], "src long, dst long, w double"))
    assert {r["id"]: r["component"] for r in pairs.connected_components(write).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 9: 7}
    blocks = [(i, j, 1.0) for s in (0, 4) for i in range(s, s + 4) for j in range(i + 1, s + 4)] + [(0, 4, 0.1)]
    label, q = Graph(spark.createDataFrame(blocks, "src long, dst long, w double")).community()
    assert len(set(label.values())) == 2 and q > 0.4
    path = np.diag(np.ones(3), 1) + np.diag(np.ones(3), -1)
    walks = limited_walks(path, [0, 3], 60)
    assert (walks >= 0).all() and np.allclose(walks, walks[::-1, ::-1])  # the path is its own mirror image


def test_clusters(spark):
    draw = np.random.default_rng(3)
    x = np.vstack([draw.normal(0, 0.2, (30, 2)), draw.normal(4, 0.2, (30, 2))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, x array<double>")
    label = {r["i"]: r["c"] for r in cluster.kmeans(rows, 2)[0].collect()}
    assert len({label[i] for i in range(30)}) == 1 and label[0] != label[59]
    write = lambda df: spark.createDataFrame(df.collect(), df.schema)
    u, p, _ = cluster.fuzzy_cmeans(rows, write=write)
    sums = u.groupBy("i").agg(F.sum("u").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in sums)
    g = cluster.GaussianMixture(rows, 2, rounds=20).initialize("kmeans")
    before = g.log_likelihood()
    assert g.expectation_maximization().log_likelihood() >= before
    assert {r["c"] for r in g.naive_bayes_classifier().collect()} == {0, 1}


def test_sequences(spark):
    m = sequences.HiddenMarkov(["H", "L"], list("ACGT"), [[0.5, 0.5], [0.4, 0.6]], [[0.2, 0.3, 0.3, 0.2], [0.3, 0.2, 0.2, 0.3]], [0.5, 0.5])
    path, chance = m.viterbi([2, 2, 1, 0, 1, 3, 2, 0, 0])
    assert path == [0, 0, 0, 1, 1, 1, 1, 1, 1] and chance == pytest.approx(4.25e-8, rel=0.01)
    seq = [0, 1, 2, 3, 1]
    total = sum(np.prod([m.pi[p[0]] * m.b[p[0], seq[0]], *[m.a[p[t - 1], p[t]] * m.b[p[t], seq[t]] for t in range(1, 5)]]) for p in np.ndindex(*[2] * 5))
    assert m.likelihood(seq) == pytest.approx(total)
    assert np.allclose(m.gamma(seq).sum(axis=0), 1) and np.allclose(m.xi(seq).sum(axis=(1, 2)), 1)
    data = spark.createDataFrame([(k, m.generate(20, k)) for k in range(10)], "seq_id long, symbols array<int>")
    first = m.train(data, 1)
    assert m.train(data, 5) >= first
    draw = np.random.default_rng(5)
    x = draw.normal(size=(80, 3))
    t = (x[:, 0] > 0).astype(float)
    found = sequences.RelevanceVectors().train(x, t, rounds=100).classify(x)
    assert (found[:, 0] == t).mean() > 0.95 and (found[:, 1] >= 0.5).all()


def test_labware(spark, tmp_path):
    row, wells = labware.plate(spark, "Plate1", rows=2, cols=4, type="8-well plate", owner="x")
    assert [r["position"] for r in wells.orderBy("idx").collect()] == ["A1", "A2", "A3", "A4", "B1", "B2", "B3", "B4"]
    assert labware.get_well(wells, "B03").first()["idx"] == 7 and row.select(labware.attribute(row, "owner")).first()[0] == "x"
    held = labware.fill(None, "Plate1", "A1", [0, 1], spark)
    held = labware.fill(held, "Plate1", "A1", [5], spark)
    assert held.count() == 2
    assert labware.duplicate(held, ("Plate1", "A1"), ("Plate2", "C1")).count() == 4
    assert [r["position"] for r in labware.filled_wells(wells, held).collect()] == ["A1"]
    assert {r["plate_id"] for r in labware.replicate(wells, 3).collect()} == {"Plate1-1", "Plate1-2", "Plate1-3"}
    samples = labware.items(spark, "sample", [{"name": "s1", "color": "red"}, {"name": "s2"}])
    assert labware.set_attribute(samples, "color", "blue").first()["attrs"]["color"] == "blue"
    back = labware.retrieve(spark, labware.store({"wells": wells}, str(tmp_path / "p")), ["wells"])
    assert back["wells"].count() == 8
    with pytest.raises(ValueError):
        labware.plate(spark, "x", wells=7)


def test_imaging(spark):
    links = spark.createDataFrame([(1, 0, 5, 3), (1, 1, 3, 9), (2, 0, 4, 5)], "obj_id long, pos long, idx1 long, idx2 long")
    assert {r["obj_id"]: r["objects"] for r in imaging.all_events(links).collect()} == {1: [5, 3, 9], 2: [4, 5]}
    plane = spark.createDataFrame([(y, x, 10 * y + x) for y in range(4) for x in range(4)], "y int, x int, v int")
    boxes = spark.createDataFrame([(1, -1, 2, 3, 3)], "idx long, top int, left int, height int, width int")
    got = {(r["y"], r["x"]): r["v"] for r in imaging.crop(plane, boxes).collect()}
    assert len(got) == 9 and got[0, 0] == 0 and got[1, 0] == 2 and got[2, 2] == 0 and got[2, 1] == 13
    tiles = plane.withColumn("ord", F.lit(0)).unionByName(plane.withColumn("ord", F.lit(1)))
    assert imaging.image_dims(imaging.make_gallery(tiles)).first()["width"] == 8
    assert imaging.pgm(plane).startswith("P2\n4 4\n255\n0 1 2 3 10")


def test_container(spark, tmp_path):
    c = Container(spark, f"file://{tmp_path}/c")
    for g in ("/G1", "/G1/G2", "/G1/G3"):
        c.create_group(g)
    cells = spark.createDataFrame([([i, j], float(10 * i + j)) for i in range(3) for j in range(4)], "idx array<long>, value double")
    c.write_data("/G1/G2/D", cells, [3, 4])
    assert c.move("/G1/G3", "/G1/G2", "G4") == "/G1/G2/G4"
    again = c.reopen()
    assert sorted(r["path"] for r in again.get_all_groups("/G1").collect()) == ["/G1/G2", "/G1/G2/G4"]
    assert again.dims("/G1/G2/D") == [3, 4] and again.get_parent("/G1/G2/D") == "/G1/G2"
    assert sorted(r["value"] for r in again.read_data_slice("/G1/G2/D", [1, 0], [1, 2], [2, 2], [1, 1]).collect()) == [10.0, 12.0, 20.0, 22.0]
    other = Container(spark, f"file://{tmp_path}/o")
    other.create_group("/X")
    again.mount("/G1/G2", other)
    assert {r["name"] for r in again.get_groups("/G1/G2").collect()} == {"G4", "X"}


@pytest.mark.parametrize("name", ["matrix_gram", "matrix_covariance", "ts_autocovariance", "graph_adjacency", "cube_unfold_2", "imaging_tracking", "container_all_groups", "kmeans_step"])
def test_queries_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "orders", "lineitem", "events", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    own, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(SQL[name]).df()
    columns = sorted(own.columns)
    assert columns == sorted(want.columns) and len(own) == len(want)
    own, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (own, want))
    for c in columns:
        assert np.allclose(own[c], want[c]) if own[c].dtype.kind in "if" else (own[c] == want[c]).all()


def plain_warp(x, y):
    """The recursion of the warping as it is written, over padded series."""
    from functools import lru_cache

    px, py = [x[0], *x, x[-1]], [y[0], *y, y[-1]]
    d = lambda i, j: math.dist(px[i], py[j])

    @lru_cache(None)
    def best(i, j):
        if i == 0 and j == 0:
            return 0.0, 0
        if j == 0:
            return best(i - 1, 0)[0] + d(i, 0) / 2, best(i - 1, 0)[1] + 1
        if i == 0:
            return best(0, j - 1)[0] + d(0, j) / 2, best(0, j - 1)[1] + 1
        options = [
            (best(i - 1, j - 1)[0] + d(i, j), 0, best(i - 1, j - 1)[1] + 1),
            (best(i - 1, j)[0] + (d(i, j) + d(i, j + 1)) / 4, 1, best(i - 1, j)[1] + 1),
            (best(i, j - 1)[0] + (d(i, j) + d(i + 1, j)) / 4, 2, best(i, j - 1)[1] + 1),
        ]
        cost, _, length = min(options)
        return cost, length

    cost, length = best(len(x), len(y))
    return cost / length


def test_warp_by_its_recursion():
    assert timeseries.warp(np.array([[0.0]]), np.array([[5.0]])) == ([(1, 1)], 5.0)
    draw = np.random.default_rng(7)
    for m, n in ((12, 9), (1, 6), (6, 1), (5, 5), (15, 20)):
        x, y = draw.random((m, 2)), draw.random((n, 2))
        path, score = timeseries.warp(x, y)
        assert score == pytest.approx(plain_warp(x.tolist(), y.tolist()))
        assert path[-1] == (m, n) and all(b[0] - a[0] in (0, 1) and b[1] - a[1] in (0, 1) for a, b in zip(path, path[1:]))


def test_components_of_a_long_chain(spark):
    ids = list(range(1000))
    np.random.default_rng(1).shuffle(ids)
    edges = [(a, b, 1.0) for a, b in zip(ids, ids[1:])] + [(5000, 5001, 1.0), (6000, 6000, 1.0)]
    got = {r["id"]: r["component"] for r in Graph(spark.createDataFrame(edges, "src long, dst long, w double")).connected_components().collect()}
    assert got == {**{i: 0 for i in ids}, 5000: 5000, 5001: 5000, 6000: 6000}


def test_products_in_blocks(spark):
    draw = np.random.default_rng(2)
    x, y = draw.random((300, 600)), draw.random((600, 5))
    assert np.allclose(Matrix.from_array(spark, x).multiply(Matrix.from_array(spark, y)).to_numpy(), x @ y)
    u, s, v = decomp.tall_svd(Matrix.from_array(spark, y))
    assert np.allclose((u.to_numpy() * s) @ v.T, y) and np.allclose(u.to_numpy().T @ u.to_numpy(), np.eye(5))


def test_weighted_factorisations(spark):
    draw = np.random.default_rng(3)
    x = draw.random((30, 2)) @ draw.random((2, 8))
    seen = (draw.random(x.shape) < 0.8).astype(float)
    w, h = decomp.wnmf(Matrix.from_array(spark, x), 2, seen, seed=1)
    assert np.abs(seen * (x - w @ h)).sum() < 0.05 * x.sum()
    labels = np.zeros((30, 1))
    labels[::2] = x[::2, :1]
    w, h, b = decomp.ssnmf(Matrix.from_array(spark, x), 2, labels, 1.0, weights=seen, seed=1)
    assert np.abs(seen * (x - w @ h)).sum() < 0.05 * x.sum() and np.abs(labels[::2] - (w @ b)[::2]).sum() < 0.1 * labels.sum()


NAMES = """matrix_eigen matrix_nnls matrix_wnmf matrix_load_matrix matrix_is_symmetric ts_align_pairs kernel_rwr graph_read_from_file graph_file_to_matrix cube_cp
fcm_fuzzy_cmeans_manhattan gmm_cluster_covariances hmm_gamma hmm_train hmm_viterbi rvm_classify labware_well_data labware_sample_name labware_retrieve imaging_object_get_image
imaging_image_png imaging_object_class container_file_mount container_group_move container_dataset_write_data""".split()


@pytest.mark.parametrize("name", NAMES)
def test_queries_against_sql(spark, sf_dir, name):
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for table in "region nation customer supplier part orders lineitem events embeddings pages".split():
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    want = db.execute(f"SELECT {listed} FROM ({SQL[name]})").fetchall()
    plain = lambda rows: sorted((tuple(str(float(v) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows))
    assert plain(got.select(*columns).collect()) == plain(want)


def test_row_pairs_shuffle_rows_once(spark, a, monkeypatch):
    for name, value in (("BLOCK_ROWS", 5), ("PART_BLOCKS", 1), ("PAIR_CELLS", 7)):
        monkeypatch.setattr(f"gridloom.operators.matrix.{name}", value)
    for pairs, want in ((a.get_distances("euclidean"), row_measure("euclidean", X, X)), (kernels.Kernel.compute_from_matrix(a, "linear"), X @ X.T)):
        plan = pairs.df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "FlatMapCoGroups" not in plan  # blocks are read again, not copied for each other block
        assert pairs.df.count() == 144
        same(pairs, want)
    inverse = np.linalg.inv(np.cov(X.T))
    d = X[:, None] - X[None]
    assert np.allclose(row_measure("mahalanobis", X, X, inverse), np.einsum("abi,ij,abj->ab", d, inverse, d))
    assert np.allclose(row_measure("mahalanobis", X, X, -inverse), -np.einsum("abi,ij,abj->ab", d, inverse, d))


def test_rounded(spark):
    v = [0.00005, -0.00005, 1.23445, -0.00001, 2.0, 1e300, -1e300, float("inf"), float("nan"), None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "v double").select(rounded(F.col("v"), 4)).collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 4)", [x]).fetchone()[0] for x in v]
    assert str(got) == str([x if x is None else x + 0.0 for x in want])


def test_array_frame_beyond_the_local_limit(spark, sf_dir, a, monkeypatch):
    for kind in ("flat", "rag"):
        square = a.submatrix(0, 0, 5, 5)
        want = square.as_array(kind) if kind == "flat" else [v for row in square.as_array(kind) for v in row]
        assert [(r["n"], r["v"]) for r in square.array_frame(kind).orderBy("n").collect()] == list(enumerate(want))
    monkeypatch.setattr("gridloom.operators.matrix.LOCAL_CELLS", 10)
    assert QUERIES["matrix_as_array"](spark, sf_dir).count() == duckdb.execute(f"SELECT 64 * count(*) FROM '{sf_dir}/embeddings.parquet'").fetchone()[0]


def test_power_method_with_near_eigenvalues(spark):
    for gap in (1e-3, 1e-5):
        value, vector = decomp.power_method(Matrix.from_array(spark, [[1.0, gap], [gap, 1.0]]), precision=1e-13)
        assert value == pytest.approx(1 + gap, abs=1e-12)
        same(vector, [[math.sqrt(0.5)], [math.sqrt(0.5)]])
    assert decomp.power_method(Matrix.from_array(spark, [[-3.0, 0.0], [0.0, 2.999]]))[0] == pytest.approx(-3)
    with pytest.raises(np.linalg.LinAlgError):
        decomp.power_method(Matrix.from_array(spark, [[0.0, 1.0], [0.0, 0.0]]))


def test_mean_of_random_at_other_sizes(spark, tmp_path):
    # of 6,000 rows the mean is just below 1.5
    spark.range(6000).selectExpr("id AS vec_id", "array_repeat(0.0, 64) AS embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert QUERIES["matrix_random"](spark, str(tmp_path)).collect()[0].asDict() == {"n": 384000, "inside": 1, "different": 384000, "mean": 2.0}


def test_lines_of_many_blocks(spark, tmp_path):
    settings = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    Matrix.grid(spark, 2000, 64, F.xxhash64("i", "j") % 1000000 + F.col("i")).to_file(str(tmp_path / "m"))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        back = Matrix.load(spark, str(tmp_path / "m"))[0]
        assert "rangepartitioning" not in back.df._jdf.queryExecution().executedPlan().toString()
        assert back.m == 2000 and back.df.where("v = xxhash64(i, j) % 1000000 + i").count() == back.df.count() == 128000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_markov_frames_are_bounded(spark, monkeypatch):
    monkeypatch.setattr("gridloom.operators.sequences.FRAME_ROWS", 16)
    seen = []
    m = sequences.HiddenMarkov(2, 5, [[0.7, 0.3], [0.4, 0.6]], [[0.3, 0.3, 0.2, 0.1, 0.1], [0.1, 0.1, 0.2, 0.3, 0.3]])
    data = [(k, m.generate(n, k) if n else []) for k, n in enumerate((30, 1, 0, 3, 2, 5))]

    class Frames:
        def select(self, *names):
            return self

        def mapInPandas(self, run, schema):
            import pandas as pd

            seen[:] = list(run([pd.DataFrame(data, columns=["seq_id", "symbols"])]))
            return spark.createDataFrame(pd.concat(seen), schema)

    for what in ("forward", "backward", "gamma", "xi", "likelihood"):
        got = [tuple(r) for r in m.over(Frames(), what).collect()]
        assert max(map(len, seen)) <= 16
        monkeypatch.setattr("gridloom.operators.sequences.FRAME_ROWS", 1 << 16)
        assert got == [tuple(r) for r in m.over(Frames(), what).collect()] and len(seen) == 1
        monkeypatch.setattr("gridloom.operators.sequences.FRAME_ROWS", 16)
        if what == "xi":
            assert got == [(k, t, i, j, m.xi(q)[t, i, j]) for k, q in data if q for t in range(len(q) - 1) for i in (0, 1) for j in (0, 1)]
        if what == "gamma":
            assert got == [(k, t, i, m.gamma(q)[i, t]) for k, q in data if q for t in range(len(q)) for i in (0, 1)]
