"""Matrices as coordinate frames (i, j, v) with declared dimensions.

Relational operators stay lazy DataFrame plans. Operators that need a dense solver work on matrices whose size is
checked first (`LOCAL_CELLS`), or on the n x n Gram matrix of a tall one, which partitions sum up before the shuffle.
Indices start at 0 and are taken modulo the dimensions. `overwrite` has no meaning for immutable frames.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Cells that a matrix may have to be solved by NumPy on the driver.
LOCAL_CELLS = 4_000_000
#: Rows of a block in all-pairs measures, blocks of a partition, and cells that a task yields at once.
BLOCK_ROWS, PART_BLOCKS, PAIR_CELLS = 1024, 4, 1 << 17
#: Rows of which differences are taken at once, so that they stay in a core's cache.
DIFFERENCE_ROWS = 32
#: Tolerances of comparisons and of zero.
EQUAL, SYMMETRIC, ZERO, SMALL_STD, EPS = 1e-12, 1e-15, 1e-12, 5e-13, 2.220446049250313e-16


#: Columns up to which one row a column is broadcast; rows and columns of a block of a product.
BROADCAST_COLUMNS, PRODUCT_BLOCK = 100_000, 256


def positive_infinity() -> Column:
    return F.lit(float("inf"))


def divide(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is infinite, 0/0 not a number."""
    nan = F.lit(float("nan"))
    return F.when(b != 0, a / F.nullif(b, F.lit(0.0))).when(a > 0, positive_infinity()).when(a < 0, -positive_infinity()).otherwise(nan)


def rounded(v: Column, digits: int) -> Column:
    """v to some digits, halves away from zero, in plain arithmetic: F.round's decimals cost a microsecond a cell."""
    scaled = F.abs(v) * 10.0**digits
    return F.when(scaled < float(1 << 52), F.signum(v) * F.floor(scaled + 0.5) / 10.0**digits + 0.0).otherwise(v)


class Matrix:
    """A coordinate frame with m rows and n columns; every cell has a row in the frame unless made with sparse=True."""

    #: (i, x), where the rows are at hand as arrays.
    vectors: DataFrame | None = None

    def __init__(self, df: DataFrame, m: int, n: int):
        self.df, self.m, self.n = df.select(F.col("i").cast("long").alias("i"), F.col("j").cast("int").alias("j"), F.col("v").cast("double").alias("v")), int(m), int(n)

    # sources and literal constructors

    @classmethod
    def grid(cls, spark: SparkSession, m: int, n: int, value: Column) -> Matrix:
        """Every cell by an expression over i and j."""
        cells = spark.range(m).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"))
        return cls(cells.withColumn("v", value), m, n)

    @classmethod
    def zero(cls, spark: SparkSession, m: int, n: int) -> Matrix:
        return cls.grid(spark, m, n, F.lit(0.0))

    @classmethod
    def one(cls, spark: SparkSession, m: int, n: int) -> Matrix:
        return cls.grid(spark, m, n, F.lit(1.0))

    @classmethod
    def identity(cls, spark: SparkSession, m: int, n: int | None = None) -> Matrix:
        return cls.grid(spark, m, n or m, F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))

    @classmethod
    def random(cls, spark: SparkSession, m: int, n: int, top: float = 1.0, seed: int = 0) -> Matrix:
        """Uniform in [0, top), by hash of seed and place, so that a lost task makes the same cells again."""
        unit = F.pmod(F.xxhash64(F.lit(seed), "i", "j"), F.lit(1 << 53)) / float(1 << 53)
        return cls.grid(spark, m, n, unit * top)

    @classmethod
    def from_array(cls, spark: SparkSession, rows: Sequence[Sequence[float]], dims: tuple[int, int] | None = None) -> Matrix:
        x = np.asarray(rows, dtype=float)
        x = x.reshape(len(rows), -1)
        if dims and x.shape != tuple(dims):
            raise ValueError("dimensions differ")
        i, j = np.indices(x.shape)
        cells = list(zip(i.ravel().tolist(), j.ravel().tolist(), x.ravel().tolist()))
        return cls(spark.createDataFrame(cells, "i long, j int, v double"), *x.shape)

    @classmethod
    def from_vectors(cls, df: DataFrame, index: str, vector: str, m: int, n: int) -> Matrix:
        """Rows from an index column and an array column."""
        out = cls(df.select(F.col(index).alias("i"), F.posexplode(vector).alias("j", "v")), m, n)
        out.vectors = df.select(F.col(index).alias("i"), F.transform(vector, lambda v: v.cast("double")).alias("x"))
        return out

    @classmethod
    def load(cls, spark: SparkSession, path: str, sep: str = r"\s+", colnames: bool = False, rownames: bool = False) -> tuple[Matrix, list[str], list[str]]:
        """Delimited text; blank lines are skipped; the first line's fields are the column labels in any case."""
        rows = numbered_lines(text_lines(spark, path).where(F.trim("value") != ""))
        rows = rows.select("r", F.split(F.trim("value") if not rownames else F.rtrim("value"), sep).alias("f"))
        head = rows.where("r = 0").first()["f"]
        columns = head[1:] if rownames else list(head)
        body = rows.where("r > 0").withColumn("r", F.col("r") - 1) if colnames else rows
        cells = F.slice("f", 2, F.size("f") - 1) if rownames else F.col("f")
        m = body.count()
        if rownames and m > LOCAL_CELLS:
            raise ValueError(f"{m} row labels are too many to return")
        names = [r["n"] for r in body.select("r", F.col("f")[0].alias("n")).orderBy("r").collect()] if rownames else []
        return cls(body.select(F.col("r").alias("i"), F.posexplode(F.transform(cells, lambda x: x.cast("double"))).alias("j", "v")), m, len(columns)), names, columns

    # sinks

    def rows_frame(self) -> DataFrame:
        """(i, x): each row as an array in column order; the source's own arrays where the matrix has them."""
        if self.vectors is not None:
            return self.vectors
        return self.df.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda c: c["v"]).alias("x"))

    def to_numpy(self) -> np.ndarray:
        if self.m * self.n > LOCAL_CELLS:
            raise ValueError(f"{self.m} x {self.n} cells are too many to solve locally; use the Gram matrix")
        out = np.zeros((self.m, self.n))
        got = self.df.toPandas()
        out[got["i"], got["j"]] = got["v"]
        return out

    def as_array(self, kind: str = "") -> list:
        """Rows; 'rag': the strict lower triangle; 'flat': all cells by rows. A list of the driver: array_frame has no limit."""
        x = self.to_numpy()
        if kind == "rag":
            return [x[k, :k].tolist() for k in range(self.m)]
        return x.ravel().tolist() if kind == "flat" else x.tolist()

    def array_frame(self, kind: str = "flat") -> DataFrame:
        """(n, v): the cells of as_array("flat") or ("rag") by their place in it, however many."""
        if kind == "rag":
            return self.df.where("j < i").select((F.expr("i * (i - 1) div 2") + F.col("j")).alias("n"), "v")
        return self.df.select((F.col("i") * self.n + F.col("j")).alias("n"), "v")

    def text_rows(self, sep: str = "\t", labels: DataFrame | None = None) -> DataFrame:
        """(i, line): each row as text, after its label if labels (i, label) are given."""
        rows = self.rows_frame()
        line = F.array_join(F.transform("x", lambda v: v.cast("string")), sep)
        if labels is None:
            return rows.select("i", line.alias("line"))
        return rows.join(labels, "i").select("i", F.concat_ws(sep, "label", line).alias("line"))

    def as_string(self, sep: str = "\t", colnames: Sequence[str] = (), rownames: Sequence[str] = (), corner: str = "") -> str:
        head = [sep.join([*([corner] if rownames else []), *colnames])] if colnames else []
        body = [sep.join([*([rownames[k]] if rownames else []), *[f"{v:.15g}" for v in row]]) for k, row in enumerate(self.to_numpy())]
        return "\n".join([*head, *body]) + "\n"

    __str__ = as_string

    def to_file(self, path: str, sep: str = "\t") -> None:
        """Writes text rows, in order, as a folder of text files."""
        self.text_rows(sep).repartitionByRange("i").sortWithinPartitions("i").select("line").write.mode("overwrite").text(path)

    # addressing and updates

    def clone(self) -> Matrix:
        """A matrix of the same cells; frames never change, so nothing is copied."""
        return Matrix(self.df.select("i", "j", "v"), self.m, self.n)

    def release(self) -> None:
        """Frees what is cached of the cells."""
        self.df.unpersist()

    def dims(self) -> tuple[int, int]:
        return self.m, self.n

    def get(self, i: int, j: int) -> float:
        return self.df.where((F.col("i") == i % self.m) & (F.col("j") == j % self.n)).first()["v"]

    def set(self, i: int, j: int, value: float) -> Matrix:
        here = (F.col("i") == i % self.m) & (F.col("j") == j % self.n)
        return Matrix(self.df.withColumn("v", F.when(here, float(value)).otherwise(F.col("v"))), self.m, self.n)

    def row(self, i: int) -> Matrix:
        return Matrix(self.df.where(F.col("i") == i % self.m).withColumn("i", F.lit(0)), 1, self.n)

    def col(self, j: int) -> Matrix:
        return Matrix(self.df.where(F.col("j") == j % self.n).withColumn("j", F.lit(0)), self.m, 1)

    def _gather(self, axis: str, wanted: Sequence[int], size: int) -> DataFrame:
        pairs = self.df.sparkSession.createDataFrame([(p, k % size) for p, k in enumerate(wanted)], "p long, k long")
        other = "j" if axis == "i" else "i"
        return self.df.join(F.broadcast(pairs), F.col(axis) == F.col("k")).select(F.col("p").alias(axis), other, "v")  # a list that came as an argument

    def rows(self, wanted: Sequence[int]) -> Matrix:
        return Matrix(self._gather("i", wanted, self.m), len(wanted), self.n)

    def cols(self, wanted: Sequence[int]) -> Matrix:
        return Matrix(self._gather("j", wanted, self.n), self.m, len(wanted))

    def extract(self, rows: Sequence[int], cols: Sequence[int]) -> Matrix:
        return self.rows(rows).cols(cols)

    def _overlay(self, b: DataFrame) -> Matrix:
        own, new = self.df.alias("a"), b.select("i", "j", F.col("v").alias("w")).alias("b")
        return Matrix(own.join(new, ["i", "j"], "left").select("i", "j", F.coalesce("w", "v").alias("v")), self.m, self.n)

    def set_rows(self, wanted: Sequence[int], b: Matrix) -> Matrix:
        if b.n != self.n:
            raise ValueError("column counts differ")
        pairs = self.df.sparkSession.createDataFrame([(p, k % self.m) for p, k in enumerate(wanted)], "p long, k long")
        return self._overlay(b.df.join(F.broadcast(pairs), F.col("i") == F.col("p")).select(F.col("k").alias("i"), "j", "v"))

    def set_cols(self, wanted: Sequence[int], b: Matrix) -> Matrix:
        if b.m != self.m:
            raise ValueError("row counts differ")
        return self.transpose().set_rows(wanted, b.transpose()).transpose()

    def submatrix(self, a: int, b: int, i: int, j: int) -> Matrix:
        if a < 0 or b < 0 or a + i > self.m or b + j > self.n:
            raise ValueError("the block ends outside")
        inside = F.col("i").between(a, a + i - 1) & F.col("j").between(b, b + j - 1)
        return Matrix(self.df.where(inside).select((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j"), "v"), i, j)

    def set_block(self, a: int, b: int, block: Matrix) -> Matrix:
        if a + block.m > self.m or b + block.n > self.n:
            raise ValueError("the block ends outside")
        return self._overlay(block.df.select((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j"), "v"))

    def delete_rows(self, first: int, last: int) -> Matrix:
        if not 0 <= first <= last < self.m:
            raise ValueError("no such rows")
        kept = self.df.where(~F.col("i").between(first, last))
        return Matrix(kept.withColumn("i", F.when(F.col("i") > last, F.col("i") - (last - first + 1)).otherwise(F.col("i"))), self.m - (last - first + 1), self.n)

    def delete_row(self, i: int) -> Matrix:
        return self.delete_rows(i % self.m, i % self.m)

    def delete_cols(self, first: int, last: int) -> Matrix:
        return self.transpose().delete_rows(first, last).transpose()

    def delete_col(self, j: int) -> Matrix:
        return self.delete_cols(j % self.n, j % self.n)

    def diag(self, m: int | None = None, n: int | None = None) -> Matrix:
        """The diagonal of a matrix as a column; of a vector, the matrix with it on the diagonal."""
        if self.m > 1 and self.n > 1:
            return Matrix(self.df.where("i = j").withColumn("j", F.lit(0)), min(self.m, self.n), 1)
        m, n = m or max(self.m, self.n), n or m or max(self.m, self.n)
        vector = self.df.select((F.col("i") + F.col("j")).alias("i"), (F.col("i") + F.col("j")).alias("j"), "v")
        return Matrix.zero(self.df.sparkSession, m, n)._overlay(vector)

    def transpose(self) -> Matrix:
        return Matrix(self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), self.n, self.m)

    def flip(self, v: bool = False, h: bool = False) -> Matrix:
        if not (v or h):
            raise ValueError("v or h is needed")
        return Matrix(self.df.select((self.m - 1 - F.col("i") if h else F.col("i")).alias("i"), (self.n - 1 - F.col("j") if v else F.col("j")).alias("j"), "v"), self.m, self.n)

    def vect(self) -> Matrix:
        return Matrix(self.df.select((F.col("j").cast("long") * self.m + F.col("i")).alias("i"), F.lit(0).alias("j"), "v"), self.m * self.n, 1)

    def unvect(self, m: int, n: int) -> Matrix:
        if self.n != 1 or m * n != self.m:
            raise ValueError("a column of m * n cells is needed")
        return Matrix(self.df.select((F.col("i") % m).alias("i"), F.floor(F.col("i") / m).alias("j"), "v"), m, n)

    def is_equal(self, b: Matrix | float, tolerance: float = EQUAL) -> bool:
        if not isinstance(b, Matrix):
            return self.df.where(F.abs(F.col("v") - float(b)) > tolerance).limit(1).count() == 0
        if b.dims() != self.dims():
            return False
        both = self.df.join(b.df.select("i", "j", F.col("v").alias("w")), ["i", "j"], "full")
        return both.where(F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("w", F.lit(0.0))) > tolerance).limit(1).count() == 0

    def is_symmetric(self) -> bool:
        if self.m != self.n:
            raise ValueError("not square")
        return self.is_equal(self.transpose(), SYMMETRIC)

    def count_non_zero_elements(self) -> DataFrame:
        return self.df.agg(F.count_if(F.abs("v") > ZERO).alias("n"))

    def find_non_zero_elements(self, j: int) -> DataFrame:
        return self.df.where((F.col("j") == j % self.n) & (F.abs("v") > ZERO)).select("i")

    def find_zeros(self, j: int) -> DataFrame:
        return self.df.where((F.col("j") == j % self.n) & (F.abs("v") <= ZERO)).select("i")

    # joins

    def _pairwise(self, b: Matrix, how: str, f: Callable[[Column, Column], Column]) -> Matrix:
        both = self.df.join(b.df.select("i", "j", F.col("v").alias("w")), ["i", "j"], how)
        return Matrix(both.select("i", "j", f(F.coalesce("v", F.lit(0.0)), F.coalesce("w", F.lit(0.0))).alias("v")), max(self.m, b.m), max(self.n, b.n))

    def _cells(self, f: Callable[[Column], Column]) -> Matrix:
        return Matrix(self.df.withColumn("v", f(F.col("v"))), self.m, self.n)

    def add(self, b: Matrix | float) -> Matrix:
        return self._pairwise(b, "full", lambda x, y: x + y) if isinstance(b, Matrix) else self._cells(lambda x: x + float(b))

    def subtract(self, b: Matrix | float, reverse: bool = False) -> Matrix:
        if isinstance(b, Matrix):
            return self._pairwise(b, "full", lambda x, y: y - x if reverse else x - y)
        return self._cells(lambda x: float(b) - x if reverse else x - float(b))

    def multiply_elementwise(self, b: Matrix) -> Matrix:
        if self.dims() != b.dims():
            raise ValueError("dimensions differ")
        return self._pairwise(b, "inner", lambda x, y: x * y)

    def multiply(self, b: Matrix | float) -> Matrix:
        """Matrix product in blocks: each block pair is one NumPy product, and sums over the inner blocks follow."""
        if not isinstance(b, Matrix):
            return self._cells(lambda x: x * float(b))
        for one, other in ((self, b), (b, self)):
            if one.dims() == (1, 1):
                return other.multiply(one.get(0, 0))
        if self.n != b.m:
            raise ValueError("inner dimensions differ")
        side = lambda size: F.lit(max(0, -(-size // PRODUCT_BLOCK) - 1))
        block = lambda c: F.floor(F.col(c) / PRODUCT_BLOCK).cast("long")
        left = self.df.select("i", "j", "v", block("i").alias("ib"), block("j").alias("kb"), F.explode(F.sequence(F.lit(0), side(b.n)).cast("array<long>")).alias("jb"))
        right = b.df.select(F.col("i").alias("k"), F.col("j").alias("c"), F.col("v").alias("w"), F.explode(F.sequence(F.lit(0), side(self.m)).cast("array<long>")).alias("ib2"), block("i").alias("kb2"), block("j").alias("jb2"))

        def product(key, x, y):
            import pandas as pd

            if not len(x) or not len(y):
                return pd.DataFrame({"i": [], "j": [], "v": []})
            rows, x_at = np.unique(x["i"].to_numpy(), return_inverse=True)
            columns, y_at = np.unique(y["c"].to_numpy(), return_inverse=True)
            first = np.zeros((len(rows), PRODUCT_BLOCK))
            second = np.zeros((PRODUCT_BLOCK, len(columns)))
            first[x_at, x["j"].to_numpy() % PRODUCT_BLOCK] = x["v"]
            second[y["k"].to_numpy() % PRODUCT_BLOCK, y_at] = y["w"]
            return pd.DataFrame({"i": np.repeat(rows, len(columns)), "j": np.tile(columns, len(rows)).astype(np.int32), "v": (first @ second).ravel()})

        parts = left.groupBy("ib", "kb", "jb").cogroup(right.groupBy("ib2", "kb2", "jb2")).applyInPandas(product, "i long, j int, v double")
        return Matrix(parts.groupBy("i", "j").agg(F.sum("v").alias("v")), self.m, b.n)

    def gram(self) -> Matrix:
        """A'A: one pass over the rows, each task sums its own n x n matrix."""
        n = self.n

        def partial(batches):
            total = np.zeros((n, n))
            for frame in batches:
                x = np.stack(frame["x"].to_numpy()) if len(frame) else np.zeros((0, n))
                total += x.T @ x
            i, j = np.indices((n, n))
            import pandas as pd

            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

        parts = self.rows_frame().select("x").mapInPandas(partial, "i long, j int, v double")
        return Matrix(parts.groupBy("i", "j").agg(F.sum("v").alias("v")), n, n)

    def divide(self, value: float, reverse: bool = False) -> Matrix:
        if isinstance(value, Matrix):
            raise TypeError("matrices do not divide")
        if not reverse and value == 0:
            raise ZeroDivisionError("division by zero")
        return self._cells(lambda x: divide(F.lit(float(value)), x) if reverse else x / float(value))

    def kronecker_product(self, b: Matrix) -> Matrix:
        """Every cell times every cell of b: the result is that large, so b's cells are joined as one array a row."""
        packed = b.df.groupBy("i").agg(F.collect_list(F.struct("j", "v")).alias("c")).select(F.col("i").alias("k"), "c")
        both = self.df.join(packed, F.lit(True)).select("i", "j", "v", "k", F.explode("c").alias("c"))
        return Matrix(both.select((F.col("i") * b.m + F.col("k")).alias("i"), (F.col("j") * b.n + F.col("c.j")).alias("j"), (F.col("v") * F.col("c.v")).alias("v")), self.m * b.m, self.n * b.n)

    kron = kronecker_product

    def khatri_rao_product(self, b: Matrix) -> Matrix:
        if self.n != b.n:
            raise ValueError("column counts differ")
        both = self.df.join(b.df.select(F.col("i").alias("k"), "j", F.col("v").alias("w")), "j")
        return Matrix(both.select((F.col("i") * b.m + F.col("k")).alias("i"), "j", (F.col("v") * F.col("w")).alias("v")), self.m * b.m, self.n)

    def euclidean_distances(self, b: Matrix) -> Matrix:
        """Squared distances between the columns of both."""
        if self.m != b.m:
            raise ValueError("row counts differ")
        both = self.df.join(b.df.select("i", F.col("j").alias("c"), F.col("v").alias("w")), "i")
        return Matrix(both.groupBy(F.col("j").alias("i"), F.col("c").alias("j")).agg(F.sum((F.col("v") - F.col("w")) * (F.col("v") - F.col("w"))).alias("v")), self.n, b.n)

    def get_distances(self, measure: str) -> Matrix:
        """A measure between all pairs of rows.

        pearson and cosine are 1 where the cross product is 0, euclidean and mahalanobis are squared, jaccard works on
        values less their row's sum, kendall is 1 where a denominator is 0; an unknown name gives zeros.
        """
        inverse = np.linalg.inv(self.covariance().to_numpy()) if measure == "mahalanobis" else None
        return self.row_pairs(lambda x, y: row_measure(measure, x, y, inverse))

    def row_pairs(self, measure: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Matrix:
        """A symmetric measure between all pairs of rows, in blocks: each pair of blocks is one bounded NumPy task.

        The rows are shuffled once, into blocks; tasks of the Cartesian product read them again and again, so that the
        disk grows with the rows and not with their pairs. Tasks yield at most PAIR_CELLS cells at once.
        """
        blocks = max(1, -(-self.m // BLOCK_ROWS))
        parts = min(blocks, max(8, -(-blocks // PART_BLOCKS)))
        rows = self.rows_frame().select(F.floor(F.col("i") / BLOCK_ROWS).cast("int").alias("b"), F.struct(F.col("i").cast("long").alias("i"), "x").alias("r"))
        packed = rows.repartition(parts, "b").groupBy("b").agg(F.collect_list("r").alias("r"))
        pairs = packed.select(F.col("b").alias("lb"), F.col("r").alias("l")).hint("shuffle_replicate_nl").join(packed.select(F.col("b").alias("rb"), "r"), F.col("lb") <= F.col("rb"))

        def unpacked(rows):
            at, x = rows.values.flatten()
            return at.to_numpy(), x.flatten().to_numpy().reshape(len(at), -1)

        def measured(batches):
            import pyarrow as pa

            whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))
            for batch in batches:
                for lb, rb, left, right in zip(*(batch.column(c) for c in ("lb", "rb", "l", "r"))):
                    (i, x), (j, y) = unpacked(left), unpacked(right)
                    step = max(1, PAIR_CELLS // len(j))
                    for k in range(0, len(i), step):
                        at, v = i[k : k + step], measure(x[k : k + step], y)
                        for one, other, cells in ((at, j, v), (j, at, v.T))[: 1 if lb == rb else 2]:
                            yield pa.RecordBatch.from_arrays([whole(one), whole(other.astype(np.int32)), whole(cells.ravel())], ["i", "j", "v"])

        # one row for many cells until here, which the JVM takes apart
        tiles = pairs.mapInArrow(measured, "i array<bigint>, j array<int>, v array<double>").select("i", "j", F.posexplode("v").alias("p", "v"))
        return Matrix(tiles.select(F.expr("get(i, int(p div size(j)))").alias("i"), F.expr("get(j, p % size(j))").alias("j"), "v"), self.m, self.m)

    def bind(self, b: Matrix, row: bool = False, column: bool = False) -> Matrix | None:
        if row:
            if self.n != b.n:
                raise ValueError("column counts differ")
            return Matrix(self.df.unionByName(b.df.withColumn("i", F.col("i") + self.m)), self.m + b.m, self.n)
        if column:
            if self.m != b.m:
                raise ValueError("row counts differ")
            return Matrix(self.df.unionByName(b.df.withColumn("j", F.col("j") + self.n)), self.m, self.n + b.n)
        return None

    # aggregations

    def _by_column(self, f: Column) -> Matrix:
        return Matrix(self.df.groupBy("j").agg(f.alias("v")).select(F.lit(0).alias("i"), "j", "v"), 1, self.n)

    def means(self) -> Matrix:
        return self._by_column(F.avg("v"))

    def variances(self) -> Matrix:
        return self._by_column(F.var_samp("v"))

    def col_max(self) -> Matrix:
        return self._by_column(F.max("v"))

    def col_min(self) -> Matrix:
        return self._by_column(F.min("v"))

    def col_sums(self) -> Matrix:
        return self._by_column(F.sum("v"))

    def row_sums(self) -> Matrix:
        return Matrix(self.df.groupBy("i").agg(F.sum("v").alias("v")).select("i", F.lit(0).alias("j"), "v"), self.m, 1)

    def max(self) -> DataFrame:
        return self.df.agg(F.max("v").alias("v"))

    def min(self) -> DataFrame:
        return self.df.agg(F.min("v").alias("v"))

    def row_sum(self, i: int) -> DataFrame:
        return self.df.where(F.col("i") == i % self.m).agg(F.sum("v").alias("v"))

    def col_sum(self, j: int) -> DataFrame:
        return self.df.where(F.col("j") == j % self.n).agg(F.sum("v").alias("v"))

    def trace(self, compat: bool = False) -> DataFrame:
        """The sum of the diagonal; compat: its product."""
        return self.df.where("i = j").agg((F.product("v") if compat else F.sum("v")).alias("v"))

    def frobenius_norm(self) -> DataFrame:
        return self.df.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("v"))

    def by_column(self, *aggregates: Column) -> DataFrame:
        """The cells with aggregates of their column, which tasks combine before the shuffle; one row a column is joined."""
        sums = self.df.groupBy("j").agg(*aggregates)
        return self.df.join(F.broadcast(sums) if self.n <= BROADCAST_COLUMNS else sums, "j")

    def covariance(self) -> Matrix:
        """Sample covariance of columns, over the Gram matrix of centred rows."""
        centred = Matrix(self.by_column(F.avg("v").alias("a")).select("i", "j", (F.col("v") - F.col("a")).alias("v")), self.m, self.n)
        return centred.gram().multiply(1.0 / max(1, self.m - 1))

    def correlation(self) -> Matrix:
        """Pearson correlation of columns; deviations up to 5e-13 count as 1; the diagonal is 1."""
        cov = self.covariance().df
        std = cov.where("i = j").select(F.col("i").alias("k"), F.when(F.sqrt("v") <= SMALL_STD, 1.0).otherwise(F.sqrt("v")).alias("s"))
        std = F.broadcast(std) if self.n <= BROADCAST_COLUMNS else std  # one row a column
        both = cov.join(std.withColumnRenamed("s", "si"), F.col("i") == F.col("k")).drop("k").join(std.withColumnRenamed("s", "sj"), F.col("j") == F.col("k"))
        return Matrix(both.select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("v") / (F.col("si") * F.col("sj"))).alias("v")), self.n, self.n)

    # sorts

    def sort_rows(self, col: int | None = None, vector: Matrix | None = None) -> Matrix:
        """Rows by a column or by a companion column vector, descending and stable."""
        if col is None and vector is None:
            raise ValueError("a column or a vector is needed")
        keys = (self.col(col) if vector is None else vector).df.select("i", F.col("v").alias("key"))
        ranked = range_rank(keys)
        return Matrix(self.df.join(ranked, "i").select(F.col("r").alias("i"), "j", "v"), self.m, self.n)

    def sort_cols(self, row: int | None = None, vector: Matrix | None = None) -> Matrix:
        return self.transpose().sort_rows(row, vector.transpose() if vector is not None else None).transpose()

    # element-wise functions and normalisers

    def abs(self) -> Matrix:
        return self._cells(F.abs)

    def exp(self) -> Matrix:
        return self._cells(F.exp)

    def log(self) -> Matrix:
        return self._cells(lambda x: F.when(x > 0, F.ln(x)).when(x == 0, -positive_infinity()).otherwise(F.lit(float("nan"))))

    def sqrt(self) -> Matrix:
        return self._cells(F.sqrt)

    def pow(self, e: float) -> Matrix:
        return self._cells(lambda x: F.pow(x, F.lit(float(e))))

    def sigmoid(self) -> Matrix:
        return self._cells(lambda x: 1.0 / (1.0 + F.exp(-x)))

    def apply(self, f: Callable) -> Matrix:
        """A function of a Column, or one of a pandas Series, over every cell."""
        try:
            out = f(F.col("v"))
            if isinstance(out, Column):
                return Matrix(self.df.withColumn("v", out), self.m, self.n)
        except (TypeError, AttributeError):
            pass
        import pandas as pd

        def run(batches):
            for frame in batches:
                yield frame.assign(v=pd.Series(f(frame["v"])))

        return Matrix(self.df.mapInPandas(run, self.df.schema), self.m, self.n)

    def standardize(self) -> Matrix:
        both = self.by_column(F.avg("v").alias("a"), F.stddev_samp("v").alias("s"))
        z = divide(F.col("v") - F.col("a"), F.col("s"))
        return Matrix(both.select("i", "j", F.when(F.abs(z) < 1e-16, 0.0).otherwise(z).alias("v")), self.m, self.n)

    def normalize(self, type: str = "sum") -> Matrix:
        both = self.by_column((F.sum("v") if type == "sum" else F.sqrt(F.sum(F.col("v") * F.col("v")))).alias("s"))
        return Matrix(both.select("i", "j", F.when(F.col("s") == 0, 0.0).otherwise(F.col("v") / F.nullif(F.col("s"), F.lit(0.0))).alias("v")), self.m, self.n)

    def sym_normalize(self) -> Matrix:
        d = self.df.where("i = j").select(F.col("i").alias("k"), F.col("v").alias("d"))
        both = self.df.join(d.withColumnRenamed("d", "di"), F.col("i") == F.col("k")).drop("k").join(d.withColumnRenamed("d", "dj"), F.col("j") == F.col("k"))
        scale = F.sqrt(F.col("di") * F.col("dj"))
        return Matrix(both.select("i", "j", F.when(scale == 0, 0.0).otherwise(F.col("v") / F.nullif(scale, F.lit(0.0))).alias("v")), self.m, self.n)

    def quantize(self, k: int, rounds: int = 101) -> Matrix:
        """k-means of each column by itself; ids by decreasing centroid; the first k rows start it."""

        def one(frame):
            frame = frame.sort_values("i")
            x = frame["v"].to_numpy()
            centre = np.sort(x[:k])[::-1].copy()
            for _ in range(rounds):
                label = np.abs(x[:, None] - centre[None, :]).argmin(axis=1)
                new = np.array([x[label == c].mean() if (label == c).any() else centre[c] for c in range(len(centre))])
                new = np.sort(new)[::-1]
                if np.abs(new - centre).max() < EQUAL:
                    break
                centre = new
            return frame.assign(v=np.abs(x[:, None] - centre[None, :]).argmin(axis=1).astype(float))

        return Matrix(self.df.groupBy("j").applyInPandas(one, self.df.schema), self.m, self.n)

    def __add__(self, b):
        return self.add(b)

    __radd__ = __add__

    def __sub__(self, b):
        return self.subtract(b)

    def __rsub__(self, b):
        return self.subtract(b, reverse=True)

    def __matmul__(self, b):
        return self.multiply(b)

    def __mul__(self, b):
        return self.multiply_elementwise(b) if isinstance(b, Matrix) else self.multiply(b)

    __rmul__ = __mul__

    def __truediv__(self, b):
        return self.divide(b)

    def __rtruediv__(self, b):
        return self.divide(b, reverse=True)


def numbered_lines(lines: DataFrame) -> DataFrame:
    """Lines of text_lines with r, their place from 0: offsets of the blocks of the files plus places within a block.

    A range sort would not do: the counts need fewer columns than the lines, so that it runs once for each, by samples of
    its own and with partitions merged by other sizes.
    """
    local = lines.withColumn("_local", F.row_number().over(Window.partitionBy("p", "b").orderBy("o")) - 1)
    counts = lines.groupBy("p", "b").agg(F.count("*").alias("n"))  # one row a block
    before = counts.select("p", "b", F.coalesce(F.sum("n").over(Window.orderBy("p", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(before), ["p", "b"]).withColumn("r", F.col("_before") + F.col("_local")).drop("_local", "_before")


def numbered(df: DataFrame, *order) -> DataFrame:
    """df with r, its rank from 0 in an order, by a range sort: partition offsets plus local row numbers.

    df has no columns but those of the order, so that counts and rows come from one shuffle.
    """
    spread = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    local = spread.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    counts = spread.groupBy("_part").agg(F.count("*").alias("n"))  # one row a partition
    before = counts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(before), "_part").withColumn("r", F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


def range_rank(keys: DataFrame) -> DataFrame:
    """(i, r): ranks from 0 by key descending, then i."""
    return numbered(keys, F.col("key").desc(), F.col("i")).select("i", "r")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, and what orders the lines of text files: p (file), b (block) and o (place within a task)."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("o"))


def row_measure(measure: str, x: np.ndarray, y: np.ndarray, inverse: np.ndarray | None = None) -> np.ndarray:
    """One measure between all rows of x and all rows of y."""
    if measure in ("pearson", "cosine"):
        if measure == "pearson":
            x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
        cross = x @ y.T
        scale = np.sqrt((x * x).sum(axis=1)[:, None] * (y * y).sum(axis=1)[None, :])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(cross == 0, 1.0, cross / scale)
    if measure == "mahalanobis":
        try:  # the squared distance after a change of axes
            root = np.linalg.cholesky((inverse + inverse.T) / 2)
        except np.linalg.LinAlgError:  # the inverse of a covariance that is nearly singular
            return np.stack([((y - r) @ inverse * (y - r)).sum(axis=1) for r in x])
        x, y = (x - y.mean(axis=0)) @ root, (y - y.mean(axis=0)) @ root
    if measure in ("euclidean", "mahalanobis", "manhattan"):
        out, columns = np.zeros((len(x), len(y))), np.ascontiguousarray(y.T)
        for k in range(0, len(x), DIFFERENCE_ROWS):
            part = out[k : k + DIFFERENCE_ROWS]
            difference = np.empty_like(part)
            for one, other in zip(x[k : k + DIFFERENCE_ROWS].T, columns):
                np.subtract(one[:, None], other, out=difference)
                part += np.abs(difference, out=difference) if measure == "manhattan" else np.multiply(difference, difference, out=difference)
        return out
    if measure == "jaccard":
        x, y = x - x.sum(axis=1, keepdims=True), y - y.sum(axis=1, keepdims=True)
        cross = x @ y.T
        with np.errstate(divide="ignore", invalid="ignore"):
            return cross / ((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - cross)
    if measure == "kendall":
        a, b = np.triu_indices(x.shape[1], 1)
        sx, sy = np.sign(x[:, a] - x[:, b]), np.sign(y[:, a] - y[:, b])
        agree = sx @ sy.T
        ex, ey = np.abs(sx), np.abs(sy)
        scale = ex.sum(axis=1)[:, None] * ey.sum(axis=1)[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(scale == 0, 1.0, agree / np.sqrt(scale))
    return np.zeros((len(x), len(y)))
