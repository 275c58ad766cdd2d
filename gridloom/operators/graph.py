"""Weighted undirected graphs: edges (src, dst, w) with src <= dst, and vertex attributes (id, name, value)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.matrix import Matrix, numbered, text_lines

#: Vertices up to which dense graph algorithms run on the driver.
LOCAL_VERTICES = 5000


class Graph:
    def __init__(self, edges: DataFrame, attributes: DataFrame | None = None):
        self.edges = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.coalesce(F.col("w").cast("double"), F.lit(1.0)).alias("w"))
        self.attributes = attributes

    @classmethod
    def read(cls, spark, path: str, keep_self: bool = False, format: str = "biolayout", sep: str = "\t") -> Graph:
        """biolayout: edge lines, default weight 1, without zero weights, later lines win; matrix: a labelled table."""
        lines = text_lines(spark, path).withColumn("o", F.struct("p", "b", "o"))
        if format == "matrix":
            parts = lines.select("o", F.split("value", sep).alias("f"))
            head = parts.orderBy("o").first()["f"]
            cells = parts.orderBy("o").offset(1).select(F.col("f")[0].alias("src"), F.posexplode(F.slice("f", 2, len(head) - 1)).alias("p", "w"))
            names = spark.createDataFrame(list(enumerate(head[1:])), "p int, dst string")
            edges = cells.join(names, "p").select("src", "dst", F.col("w").cast("double").alias("w")).where("w <> 0")
            pairs = edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("w").alias("w"))
            return cls(pairs)
        fields = F.split("value", "\t")
        rows = lines.where(~F.col("value").startswith("//") & (F.size(fields) >= 2)).select("o", F.least(fields[0], fields[1]).alias("src"), F.greatest(fields[0], fields[1]).alias("dst"), F.coalesce(F.try_element_at(fields, F.lit(3)).try_cast("double"), F.lit(1.0)).alias("w"))
        last = rows.groupBy("src", "dst").agg(F.max_by("w", "o").alias("w")).where("w <> 0")
        marks = lines.where(F.col("value").startswith("//NODECLASS")).select("o", F.split("value", r"\s+").alias("f"))
        attributes = marks.groupBy(F.col("f")[1].alias("id")).agg(F.max_by(F.col("f")[2], "o").alias("value")).select("id", F.lit("NODECLASS").alias("name"), "value")
        return cls(last if keep_self else last.where("src <> dst"), attributes)

    @classmethod
    def file_to_matrix(cls, spark, path: str, keep_self: bool = False) -> tuple[Matrix, list]:
        """An edge list as a dense symmetric matrix, and its nodes in order; zero weights are kept as zeros."""
        fields = F.split("value", "\t")
        rows = text_lines(spark, path).where(~F.col("value").startswith("//") & (F.size(fields) >= 2))
        edges = rows.select(F.struct("p", "b", "o").alias("o"), F.least(fields[0], fields[1]).alias("src"), F.greatest(fields[0], fields[1]).alias("dst"), F.coalesce(F.try_element_at(fields, F.lit(3)).try_cast("double"), F.lit(1.0)).alias("w"))
        last = edges.groupBy("src", "dst").agg(F.max_by("w", "o").alias("w"))
        graph = cls(last if keep_self else last.where("src <> dst"))
        names = [r["id"] for r in graph.vertices().orderBy("id").limit(LOCAL_VERTICES + 1).collect()]
        if len(names) > LOCAL_VERTICES:
            raise ValueError("too many vertices for a dense matrix")
        return graph.get_adjacency_matrix(), names

    def export(self, format: str = "layout", size: str | None = None, orientation: str | None = None, splines: str | None = None, edge_labels: bool = False) -> DataFrame:
        """Lines of a layout or dot file, as (part, line); parts order the file. The options are those of dot files."""
        label = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
        if format == "dot":
            body = self.edges.select(F.lit(1).alias("part"), F.concat(label("src"), F.lit(" -- "), label("dst"), F.lit(" [weight="), F.col("w").cast("string"), *([F.lit(", label="), label("w")] if edge_labels else []), F.lit("];")).alias("line"))
            options = [f'{name}="{value}";' for name, value in (("size", size), ("orientation", orientation), ("splines", splines)) if value is not None]
            ends = self.edges.sparkSession.createDataFrame([(0, " ".join(["graph g {", *options])), (2, "}")], "part int, line string")
            return body.unionByName(ends)
        body = self.edges.select(F.lit(0).alias("part"), F.concat_ws("\t", "src", "dst", F.col("w").cast("string")).alias("line"))
        if self.attributes is not None:
            body = body.unionByName(self.attributes.where("name = 'NODECLASS'").select(F.lit(1).alias("part"), F.concat_ws("\t", F.lit("//NODECLASS"), "id", "value").alias("line")))
        return body

    def vertices(self) -> DataFrame:
        return self.edges.select(F.col("src").alias("id")).unionByName(self.edges.select(F.col("dst").alias("id"))).distinct()

    def both_ways(self) -> DataFrame:
        turned = self.edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
        return self.edges.unionByName(turned)

    def neighbours(self, vertex) -> DataFrame:
        return self.both_ways().where(F.col("src") == vertex).select(F.col("dst").alias("id"))

    def degree(self) -> DataFrame:
        """Weighted degree of every vertex; weight 0 counts as 1."""
        return self.both_ways().groupBy(F.col("src").alias("id")).agg(F.sum(F.when(F.col("w") == 0, 1.0).otherwise(F.col("w"))).alias("degree"))

    def index(self) -> DataFrame:
        """(id, n): vertices numbered from 0 in order of id; for graphs that become matrices."""
        return numbered(self.vertices(), "id").select("id", F.col("r").cast("int").alias("n"))

    def get_adjacency_matrix(self) -> Matrix:
        """Dense symmetric weights, vertices in order of id."""
        number = self.index()
        size = number.count()
        both = self.both_ways().join(number.select(F.col("id").alias("src"), F.col("n").alias("a")), "src").join(number.select(F.col("id").alias("dst"), F.col("n").alias("b")), "dst")
        cells = both.select(F.col("a").cast("long").alias("i"), F.col("b").alias("j"), "w")
        grid = Matrix.zero(self.edges.sparkSession, size, size).df.join(cells, ["i", "j"], "left").select("i", "j", F.coalesce("w", "v").alias("v"))
        return Matrix(grid, size, size)

    def connected_components(self, write=None, rounds: int = 200) -> DataFrame:
        """(id, component): the smallest id reachable, by alternating stars, whose rounds grow with the logarithm of the
        longest path; write cuts lineage."""
        write = write or (lambda df: df.checkpoint())
        pairs = write(self.edges.where("src <> dst").select("src", "dst").distinct())
        seen = None
        for _ in range(rounds):
            for larger in (True, False):  # first the larger neighbours of a node, then the smaller, meet its least one
                turned = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
                sided = pairs.unionByName(turned) if larger else turned
                least = sided.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("low"))
                met = sided.join(least, F.col("src") == F.col("node"))
                kept = met.where("dst > src").select("low", "dst") if larger else met.select("low", "dst").unionByName(met.select("low", F.col("src").alias("dst")))
                pairs = write(kept.where("low <> dst").select(F.col("low").alias("src"), "dst").distinct())
            now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
            if now == seen:
                break
            seen = now
        else:
            raise RuntimeError("components did not settle")
        roots = pairs.select(F.col("dst").alias("id"), F.col("src").alias("component"))
        return self.vertices().join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))

    def is_connected(self) -> bool:
        return self.connected_components().select("component").distinct().count() <= 1

    def _dense(self) -> tuple[list, np.ndarray]:
        names = [r["id"] for r in self.vertices().orderBy("id").limit(LOCAL_VERTICES + 1).collect()]
        if len(names) > LOCAL_VERTICES:
            raise ValueError("too many vertices for a dense algorithm")
        at = {v: n for n, v in enumerate(names)}
        a = np.zeros((len(names), len(names)))
        for r in self.edges.collect():  # at most LOCAL_VERTICES squared
            a[at[r["src"]], at[r["dst"]]] = a[at[r["dst"]], at[r["src"]]] = r["w"]
        return names, a

    def community(self, rounds: int = 100) -> tuple[dict, float]:
        """Louvain moves over vertices in order of id: the community of each vertex, and the modularity."""
        names, a = self._dense()
        return louvain(names, a, rounds)

    def get_relevant_subgraph(self, seeds: list, threshold: float = 0.001, longest: int = 50) -> DataFrame:
        """Edges whose expected net passages of limited walks between the seeds exceed a threshold: (src, dst, w)."""
        names, a = self._dense()
        at = {v: n for n, v in enumerate(names)}
        chosen = [at[s] for s in seeds if s in at]
        if len(chosen) < 2:
            raise ValueError("two seeds at least are needed")
        passages = limited_walks(a, chosen, longest)
        score = np.abs(passages - passages.T)
        found = [(names[i], names[j], float(score[i, j])) for i, j in zip(*np.nonzero(np.triu(score > threshold, 1)))]
        kind = self.edges.schema["src"].dataType.simpleString()
        return self.edges.sparkSession.createDataFrame(found, f"src {kind}, dst {kind}, w double")


def louvain(names: list, a: np.ndarray, rounds: int = 100) -> tuple[dict, float]:
    """One phase of greedy moves."""
    total, degree = a.sum(), a.sum(axis=1)
    label = np.arange(len(names))

    def modularity() -> float:
        return sum(a[np.ix_(label == c, label == c)].sum() / total - (degree[label == c].sum() / total) ** 2 for c in np.unique(label))

    before = modularity()
    for _ in range(rounds):
        moved = False
        for i in range(len(names)):
            own, label[i] = label[i], -1
            best, gain = own, 0.0
            for c in sorted({own, *label[(a[i] != 0) & (label >= 0)].tolist()}):
                g = 2 * a[i, label == c].sum() / total - 2 * degree[i] * degree[label == c].sum() / total**2
                if g > gain + 1e-15:
                    best, gain = c, g
            label[i] = best
            moved |= best != own
        now = modularity()
        if not moved or now <= before:
            break
        before = now
    return dict(zip(names, label.tolist())), float(modularity())


def limited_walks(a: np.ndarray, seeds: list[int], longest: int) -> np.ndarray:
    """Expected passages over each directed edge of walks of up to `longest` steps from each seed to the others."""
    degree = a.sum(axis=1, keepdims=True)
    chance = np.divide(a, degree, out=np.zeros_like(a), where=degree > 0)
    passages = np.zeros_like(a)
    for start in seeds:
        absorbing = np.zeros(len(a), dtype=bool)
        absorbing[[s for s in seeds if s != start]] = True
        inner = chance * ~absorbing[:, None] * ~absorbing[None, :]
        ahead = np.zeros((longest + 1, len(a)))
        ahead[0, start] = 1.0
        for step in range(1, longest + 1):
            ahead[step] = ahead[step - 1] @ inner
        back = np.zeros((longest + 1, len(a)))  # absorbed after exactly that many steps
        back[1] = (chance * absorbing[None, :]).sum(axis=1) * ~absorbing
        for step in range(2, longest + 1):
            back[step] = inner @ back[step - 1]
        remaining = np.cumsum(back, axis=0)
        for step in range(1, longest):
            passages += inner * ahead[step - 1][:, None] * remaining[longest - step][None, :] / len(seeds)
        passages += chance * ~absorbing[:, None] * absorbing[None, :] * ahead[:longest].sum(axis=0)[:, None] / len(seeds)
    return passages
