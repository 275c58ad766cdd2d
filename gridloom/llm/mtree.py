"""Exact top-k inner products by best-first search over M-trees.

The tree's upper level deals vectors to the nearest of some pivots, the routing objects of subtrees (a subtree that gets
far more vectors than others is split by hash). Each subtree is bulk-loaded into pages: leaves hold vectors near a
routing object, nodes hold routing objects of pages, every entry with its distance to the parent's routing object and
every page with its covering radius. Pages are rows of a written table, so lost executors read them again.

The metric is Euclidean. As 2 q.x = |q|^2 + |x|^2 - d(q, x)^2, a page with routing object p, covering radius r and
largest norm m bounds the product by (|q|^2 + m^2 - max(0, d(q, p) - r)^2) / 2 and by q.p + |q| r. Before the distance
to a routing object is computed, the stored distance to the parent gives, by the triangle inequality,
d(q, p) >= |d(q, parent) - d(parent, p)|, and entries whose bound then falls below the k-th best product so far are
skipped without it. Pages are visited best bound first; a page is read only while its bound can still win or tie.

Subtrees are searched best first as well, in two rounds: every query first meets the subtree of its best root bound,
then, with the k-th product found there, those whose root bound can still win or tie. Queries meet a subtree in blocks,
so every task is bounded. Products are whole numbers, computed exactly (in float64 where that is exact, else in Python
integers); bounds carry a slack for rounding.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do rows with a null
id; shorter vectors count as padded by zeros; an id is never its own candidate; repeated candidate rows are all
candidates; repeated query rows give one result; ties go to the smaller id; components and scores beyond a long are held
at its limits, where they tie; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import materialise

#: Vectors of a subtree, about, and of a leaf page; queries of a block; routing objects of a node.
TREE, LEAF, BLOCK, FANOUT = 16_384, 128, 4096, 16
#: Numbers of a page that are written as bytes, with their types.
ARRAYS = {"routing": "<f8", "to_parent": "<f8", "radii": "<f8", "norms": "<f8", "centres": "<f8", "children": "<i8", "ids": "<i8", "x": "<i8"}
LONG = (1 << 63) - 1


def whole(df: DataFrame, scale: int, key: str, vector: str) -> DataFrame:
    """id and whole-number components floor(scale * x), of the vectors that take part."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    good = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    return df.where(good).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * float(scale))).alias("x"))


def bulk_load(ids: np.ndarray, x: np.ndarray) -> list[dict]:
    """Pages of an M-tree over vectors (float64, whole numbers); page 0 is the root."""
    pages: list[dict] = []

    def build(rows: np.ndarray) -> int:
        own = x[rows]
        number = len(pages)
        pages.append({})
        if len(rows) <= LEAF:
            centre = own.mean(axis=0)
            routing = own[((own - centre) ** 2).sum(axis=1).argmin()]
            to_parent = np.sqrt(((own - routing) ** 2).sum(axis=1))
            order = np.argsort(ids[rows], kind="stable")
            pages[number] = {"leaf": True, "routing": routing, "radius": float(to_parent.max()), "norm": float(np.sqrt((own**2).sum(axis=1)).max()), "rows": rows[order], "to_parent": to_parent[order]}
            return number
        # farthest-point routing objects, then every vector to its nearest
        nearest = ((own - own[0]) ** 2).sum(axis=1)
        chosen, label, fan = [0], np.zeros(len(rows), dtype=np.int64), min(FANOUT, math.ceil(len(rows) / LEAF) + 1)
        while len(chosen) < fan and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            d = ((own - own[chosen[-1]]) ** 2).sum(axis=1)
            closer = d < nearest
            label[closer], nearest[closer] = len(chosen) - 1, d[closer]
        groups = [rows[label == c] for c in range(len(chosen))]
        groups = [g for g in groups if len(g)]
        if len(groups) == 1 or max(map(len, groups)) > 0.95 * len(rows):  # alike vectors or outliers: halves keep the depth bounded
            groups = np.array_split(rows[np.argsort(nearest, kind="stable")], max(2, min(FANOUT, math.ceil(len(rows) / LEAF))))
        children = [build(g) for g in groups]
        routing = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmin()]
        centres = np.stack([pages[c]["routing"] for c in children])
        to_parent = np.sqrt(((centres - routing) ** 2).sum(axis=1))
        radii = np.array([pages[c]["radius"] for c in children])
        pages[number] = {"leaf": False, "routing": routing, "radius": float(np.sqrt(((own - routing) ** 2).sum(axis=1)).max()), "norm": max(pages[c]["norm"] for c in children), "children": np.array(children), "to_parent": to_parent, "radii": radii, "norms": np.array([pages[c]["norm"] for c in children]), "centres": centres}
        return number

    if len(ids):
        build(np.arange(len(ids)))
    return pages


def search(pages: list[dict], ids: np.ndarray, x: np.ndarray, own: int, exact: np.ndarray, k: int, stats: dict | None = None, floor: float = -math.inf) -> list[tuple[int, int]]:
    """The k best (product, id) over one tree, best first, ties to the smaller id; best-first over page bounds.

    exact: the query as whole numbers; floor: products below it are not wanted.
    """
    if not pages:
        return []
    query = exact.astype(np.float64)
    norm2 = float(query @ query)
    norm = math.sqrt(norm2)
    best: list[tuple[int, int]] = []  # heap of (product, -id): the worst first
    root = pages[0]
    slack = lambda value: 1e-9 * (norm2 + root["norm"] ** 2) + 1e-6
    give = slack(0)

    def limit() -> float:
        return max(best[0][0], floor) if len(best) == k else floor

    def bound(d, radius, largest):
        low = np.maximum(0.0, d - radius)
        return (norm2 + largest * largest - low * low) / 2 + give

    d_root = math.sqrt(max(0.0, float(((query - root["routing"]) ** 2).sum())))
    queue = [(-math.inf, 0, d_root)]
    while queue:
        negative, number, d = heapq.heappop(queue)
        if -negative < limit():
            break
        page = pages[number]
        least = np.abs(d - page["to_parent"])  # triangle inequality over the stored distances
        if page["leaf"]:
            rows = page["rows"]
            possible = (norm2 + page["norm"] ** 2 - least * least) / 2 + give >= limit()
            if not possible.all():
                rows = rows[possible]
            if stats is not None:
                stats["computed"] = stats.get("computed", 0) + len(rows)
                stats["spared"] = stats.get("spared", 0) + len(possible) - len(rows)
            if len(rows):
                score = x[rows] @ exact
                hit = np.flatnonzero(score >= best[0][0]) if len(best) == k else np.arange(len(rows))
                if len(hit) > 2 * k and score.dtype != object:
                    hit = hit[np.lexsort((ids[rows[hit]], -score[hit]))[: 2 * k + np.count_nonzero(ids[rows[hit]] == own)]]
                for h in hit.tolist():
                    candidate = int(ids[rows[h]])
                    if candidate == own:
                        continue
                    entry = (int(score[h]), -candidate)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
        else:
            possible = np.flatnonzero(bound(least, page["radii"], page["norms"]) >= limit())
            if stats is not None:
                stats["spared"] = stats.get("spared", 0) + len(page["children"]) - len(possible)
            if len(possible):
                centres = page["centres"][possible]
                dist = np.sqrt(((centres - query) ** 2).sum(axis=1))
                bounds = np.minimum(bound(dist, page["radii"][possible], page["norms"][possible]), centres @ query + norm * page["radii"][possible] + give)
                for b, c, dd in zip(bounds.tolist(), page["children"][possible].tolist(), dist.tolist()):
                    if b >= limit():
                        heapq.heappush(queue, (-b, c, dd))
    return [(s, -i) for s, i in sorted(best, key=lambda e: (-e[0], -e[1]))]


def matrix(vectors: list, width: int) -> np.ndarray:
    """Rows of whole numbers padded by zeros."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for n, x in enumerate(vectors):
        out[n, : len(x)] = x
    return out


def exact_pair(x: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which their products are exact: float64, or Python integers."""
    reach = [max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))) for m in (x, asked)]
    kind = np.float64 if reach[0] * reach[1] * max(1, x.shape[1]) < 1 << 53 else object
    return x.astype(kind), asked.astype(kind)


def root_bounds(x: np.ndarray, centres: np.ndarray, radii: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """The largest product that each subtree may hold for each query (query, subtree), with a slack for rounding."""
    norm2 = (x**2).sum(axis=1)[:, None]
    inner = x @ centres.T
    distance = np.sqrt(np.maximum(0.0, norm2 + (centres**2).sum(axis=1)[None, :] - 2 * inner))
    low = np.maximum(0.0, distance - radii[None, :])
    slack = 1e-9 * (norm2 + norms.max() ** 2) + 1e-6
    # the distance of large vectors that are close loses half of its digits
    low = np.maximum(0.0, low - 1e-6 * (np.sqrt(norm2) + norms.max()))
    return np.minimum((norm2 + norms[None, :] ** 2 - low**2) / 2, inner + np.sqrt(norm2) * radii[None, :]) + slack


def dealt_to_trees(candidates: DataFrame, n: int, width: int, tree: int) -> DataFrame:
    """candidates with _tree: the nearest of about n / tree pivots, and a part of it where it has far more than tree."""
    spark = candidates.sparkSession
    wanted = math.ceil(n / tree)
    if wanted <= 1:
        return candidates.withColumn("_tree", F.lit(0))
    # the vectors of smallest hash as pivots: as many as subtrees, whatever else the table holds
    chosen = candidates.select("x").distinct().orderBy(F.xxhash64("x", F.lit(7)), "x").limit(wanted).collect()
    pivots = spark.sparkContext.broadcast(matrix([r["x"] for r in chosen], width).astype(np.float64))

    def near(batches):
        p = pivots.value
        own = (p**2).sum(axis=1)
        for batch in batches:
            x = matrix(batch.column(1).to_pylist(), width).astype(np.float64)
            best = np.concatenate([(own[None, :] - 2 * (x[at : at + 1024] @ p.T)).argmin(axis=1) for at in range(0, len(x), 1024)]) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.int32())], names=["id", "x", "_pivot"])

    placed = materialise(candidates.select("id", "x").mapInArrow(near, "id long, x array<long>, _pivot int"), "placed")
    parts = placed.groupBy("_pivot").agg(F.ceil(F.count("*") / (2 * tree)).cast("int").alias("_parts"))  # as many rows as pivots
    part = F.pmod(F.xxhash64("id", "x"), F.col("_parts")).cast("int")
    return placed.join(F.broadcast(parts), "_pivot").select("id", "x", (F.col("_pivot") + part * wanted).alias("_tree"))


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding", tree: int = TREE, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), id and score of the k best candidates in df of every query."""
    spark = df.sparkSession
    candidates = materialise(whole(df, scale, key, vector), "vectors")
    asked = materialise(whole(queries, scale, key, vector).groupBy("id").agg(F.min("x").alias("x")), "queries")
    n, q = candidates.count(), asked.count()
    blocks = max(1, math.ceil(q / block))
    width = max(r[0] or 0 for r in (candidates.agg(F.max(F.size("x"))).first(), asked.agg(F.max(F.size("x"))).first()))

    def index(part: pa.Table) -> pa.Table:
        ids = np.array(part["id"].to_pylist(), dtype=np.int64)
        x = matrix(part["x"].to_pylist(), width)
        rows = []
        for number, page in enumerate(bulk_load(ids, x.astype(np.float64))):
            if page["leaf"]:
                page |= {"ids": ids[page["rows"]], "x": x[page["rows"]]}
            rows.append({"_tree": part["_tree"][0].as_py(), "page": number, "radius": page["radius"], "norm": page["norm"], **{c: np.ascontiguousarray(page[c], dtype=kind).tobytes() if c in page else None for c, kind in ARRAYS.items()}})
        return pa.Table.from_pylist(rows, schema=pa.schema([("_tree", pa.int32()), ("page", pa.int32()), ("radius", pa.float64()), ("norm", pa.float64()), *[(c, pa.binary()) for c in ARRAYS]]))

    kinds = "_tree int, page int, radius double, norm double, " + ", ".join(f"{c} binary" for c in ARRAYS)
    pages = materialise(dealt_to_trees(candidates, n, width, tree).groupBy("_tree").applyInArrow(index, kinds), "pages")
    roots = pages.where("page = 0").select("_tree", "radius", "norm", "routing").orderBy("_tree").collect()  # one row for about `tree` vectors, without the vectors
    shipped = spark.sparkContext.broadcast((
        np.array([r["_tree"] for r in roots], dtype=np.int32),
        np.frombuffer(b"".join(bytes(r["routing"]) for r in roots), dtype="<f8").reshape(len(roots), width),
        np.array([r["radius"] for r in roots]),
        np.array([r["norm"] for r in roots]),
    ))

    def meets(first: bool):
        """Queries with the subtree of their best bound, or with all others whose bound reaches their k-th product."""

        def run(batches):
            names, centres, radii, norms = shipped.value
            for batch in batches:
                x = matrix(batch.column(1).to_pylist(), width).astype(np.float64)
                for at in range(0, len(x) if len(names) else 0, 256):
                    bounds = root_bounds(x[at : at + 256], centres, radii, norms)
                    best = bounds.argmax(axis=1)
                    floors = np.full(len(bounds), -np.inf) if first else np.array([-np.inf if v is None else float(v) for v in batch.column(2).slice(at, 256).to_pylist()])
                    hit = np.zeros(bounds.shape, dtype=bool) if first else bounds >= floors[:, None] - 1e-9 * np.abs(floors[:, None])
                    hit[np.arange(len(bounds)), best] = first
                    rows, trees = np.nonzero(hit)
                    own = pa.array(rows + at)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(names[trees]), pa.array(floors[rows])], names=["id", "x", "_tree", "floor"])

        return run

    def answer(key_, page_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if page_rows.num_rows and query_rows.num_rows:
            stored, ids, x, at = [], [], [], 0
            for row in sorted(page_rows.to_pylist(), key=lambda r: r["page"]):
                page = {c: np.frombuffer(row[c], dtype=kind) for c, kind in ARRAYS.items() if row[c] is not None}
                page |= {"radius": row["radius"], "norm": row["norm"], "leaf": row["ids"] is not None}
                if page["leaf"]:
                    page["rows"] = np.arange(at, at + len(page["ids"]))
                    ids.append(page["ids"])
                    x.append(page["x"].reshape(-1, width))
                    at += len(page["ids"])
                else:
                    page["centres"] = page["centres"].reshape(-1, width)
                stored.append(page)
            vectors, asked_x = exact_pair(np.concatenate(x), matrix(query_rows["x"].to_pylist(), width))
            ids = np.concatenate(ids)
            for own, query, floor in zip(query_rows["id"].to_pylist(), asked_x, query_rows["floor"].to_pylist()):
                out += [(own, i, max(-LONG - 1, min(LONG, s))) for s, i in search(stored, ids, vectors, own, query, k, floor=floor)]
        columns = list(zip(*out)) if out else [[]] * 3
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("query_id", "id", "score"), columns)})

    def searched(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "pairs")
        wanted = pairs.select(F.col("_tree").alias("_t"), F.col("_block").alias("_b")).distinct()
        per_block = pages.join(wanted, F.col("_tree") == F.col("_t"))
        return per_block.groupBy("_t", "_b").cogroup(pairs.groupBy("_tree", "_block")).applyInArrow(answer, "query_id long, id long, score long")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    pair_kinds = "id long, x array<long>, _tree int, floor double"
    first = materialise(searched(asked.mapInArrow(meets(True), pair_kinds)), "first")
    if len(roots) > 1:
        floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).select("query_id", "least")
        second = asked.join(floors, asked["id"] == floors["query_id"], "left").select("id", "x", "least")
        first = first.unionByName(searched(second.mapInArrow(meets(False), pair_kinds)))
    return first.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
