"""SimHash near-duplicates by tiled exact comparison.

Every text gets a fingerprint of `lanes` times 64 bits: bit b is 1 if it is set in over half of the hashes of the
text's word shingles. Distinct fingerprints are put in cells by the population counts of their words (of 16 bits by
default), cells are dealt into tiles of a bounded size, and a pair of tiles is compared, by exclusive-or and bit counts
over whole arrays, only where the population counts allow a distance within the radius: the differences of the words'
counts add up to a lower bound of the distance. Nothing else is skipped, so the links are exact.

Within a pair of tiles the links found are thinned to a spanning forest before they leave the task, which keeps their
components and never emits all pairs of a group. Components come from alternating star contractions over written
tables. Exact copies share one fingerprint and meet only as its members.

With `similarity`, a text counts by its set of distinct shingles, and fingerprints only find candidates: tiles are dealt
by the sizes of the sets and compared where the smaller is at least that share of the larger, as sets that differ more
cannot be so similar. Within the components of the candidates a link is kept only where the exact Jaccard similarity of
the two sets reaches `similarity`; components larger than a tile of sets are compared tile by tile. The radius must be
wide enough that pairs of that similarity stay within it.

Defined results: null text has no word; a text without words has fingerprint zero and is linked like any other; a text
with fewer words than a shingle is one shingle; very long texts are taken whole, their bits counted in blocks; repeated rows share fingerprint and component; a null doc_id never is
the smallest of its component unless all are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import binary_lists, materialise, per_batch, small_batches

SEED = 42
#: Fingerprints in a tile, about; tiles of one cell that a key of the join of tiles holds, about.
TILE, SPLIT = 2048, 16
#: Nodes that hold more than this share of all links (and more than so many) are spread over so many keys.
HUB_SHARE, HUB_LINKS, SALTS = 1 / 256, 256, 64
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15
#: Sets, and shingles in all of them, of a tile whose pairs are compared exactly.
SET_TILE, SET_TILE_SHINGLES = 1024, 1 << 20


def shingle_hashes(raw: bytes, shingle: int) -> np.ndarray:
    """The hash of every word shingle of a text, in order and with repeats."""
    words = raw.lower().split()  # both work on ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, dtype="<u8")
    joined = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    starts = [0, *stops[: n - 1].tolist()]
    ends = (stops[min(shingle, len(words)) - 1 :] - 1).tolist()
    xxh, view = xxhash.xxh64_intdigest, memoryview(joined)
    return np.fromiter((xxh(view[a:b], SEED) for a, b in zip(starts, ends)), dtype="<u8", count=n)


def mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """The hashes of another lane; those of the first are the hashes themselves."""
    if lane == 0:
        return hashes
    x = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lanes_of(hashes: np.ndarray, lanes: int) -> tuple[int, ...]:
    """The lanes of the fingerprint of these hashes, as unsigned integers."""
    if not len(hashes):
        return (0,) * lanes
    out = []
    for lane in range(lanes):
        votes = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), BLOCK):
            part = np.ascontiguousarray(mixed(hashes[at : at + BLOCK], lane))
            votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0]))
    return tuple(out)


def lane_names(lanes: tuple[int, ...]) -> str:
    return "".join(f"{x:016x}" for x in lanes)


def fingerprints(df: DataFrame, shingle: int = 3, lanes: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, node (the fingerprint as lower-case hex) and size (number of shingles) of every whole text."""
    small_batches(df.sparkSession)
    source = df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [shingle_hashes(t or b"", shingle) for t in binary_lists(batch, "_text")]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([lane_names(lanes_of(h, lanes)) for h in found], pa.string()), pa.array([len(h) for h in found], pa.int64())], names=["doc_id", "node", "size"])

        return work

    return source.mapInArrow(per_batch(make), f"doc_id {kind}, node string, size long")


def set_fingerprints(df: DataFrame, shingle: int, lanes: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, doc (hash of the text), and of the set of its distinct shingles node (fingerprint), own (digest) and size."""
    small_batches(df.sparkSession)
    source = df.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("doc"), F.col(text).cast("string").alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [np.unique(shingle_hashes(t or b"", shingle)) for t in binary_lists(batch, "_text")]
            nodes = pa.array([lane_names(lanes_of(h, lanes)) for h in found], pa.string())
            owns = pa.array([xxhash.xxh3_128_hexdigest(h.tobytes()) for h in found], pa.string())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), nodes, owns, pa.array([len(h) for h in found], pa.int64())], names=["doc_id", "doc", "node", "own", "size"])

        return work

    return source.mapInArrow(per_batch(make), f"doc_id {kind}, doc long, node string, own string, size long")


def count_cells(words: int, radius: int) -> tuple[Callable, Callable]:
    """Cells by the population counts of `words` words of a 64-bit lane, and the cells within reach, each pair once."""
    base = 64 // words + 1
    moves: list[tuple[int, ...]] = [()]
    for _ in range(words):
        moves = [(*m, d) for m in moves for d in range(-radius, radius + 1) if sum(map(abs, m)) + abs(d) <= radius]
    scale = [base**k for k in range(words)]
    steps = [(m, sum(d * s for d, s in zip(m, scale))) for m in moves]
    steps = [(m, s) for m, s in steps if s >= 0]

    def cell(lanes: np.ndarray, size: np.ndarray) -> np.ndarray:
        parts = np.bitwise_count(np.ascontiguousarray(lanes[:, :1]).view(f"<u{8 // words}"))
        return (parts.astype(np.int64) * np.array(scale)).sum(axis=1)

    def reach(own: int) -> list[int]:
        digits = [own // s % base for s in scale]
        return [own + s for m, s in steps if all(0 <= a + d < base for a, d in zip(digits, m))]

    return cell, reach


def size_cells(similarity: float) -> tuple[Callable, Callable]:
    """Cells by shingle counts: those that are similar enough are in the same cell or the next."""
    width = -math.log(similarity) * (1 + 1e-9)

    def cell(lanes: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.floor(np.log(np.maximum(size, 1)) / width).astype(np.int64) + (size > 0)

    def reach(own: int) -> list[int]:
        return [own] if own == 0 else [own, own + 1]

    return cell, reach


def forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect the same components as all of these."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out = []
    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def compare(a: np.ndarray, b: np.ndarray, radius: int, size_a: np.ndarray | None = None, size_b: np.ndarray | None = None, similarity: float = 0.0) -> list[tuple[int, int]]:
    """A spanning forest of the links between the fingerprints of two tiles (n x lanes): pairs (row, len(a) + column)."""
    first = np.full(len(b), -1, dtype=np.int64)  # the first row that each column is linked to stands for the column
    links: list[np.ndarray] = []
    step = max(1, (1 << 21) // max(1, len(b)))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        distance = np.bitwise_count(part[:, None, 0] ^ b[None, :, 0])
        for lane in range(1, a.shape[1]):
            distance = distance + np.bitwise_count(part[:, None, lane] ^ b[None, :, lane])
        near = distance <= radius
        if size_a is not None and near.any():
            x, y = size_a[at : at + step, None], size_b[None, :]
            near &= np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9
        rows, columns = np.nonzero(near)
        if len(rows):
            rows = rows + at
            new = columns[first[columns] < 0]
            if len(new):
                fresh, where = np.unique(columns, return_index=True)
                open_ = first[fresh] < 0
                first[fresh[open_]] = rows[where[open_]]
                links.append(np.stack([rows[where[open_]], len(a) + fresh[open_]], axis=1))
            other = first[columns] != rows
            if other.any():
                links.append(np.unique(np.stack([first[columns[other]], rows[other]], axis=1), axis=0))
    return forest(np.concatenate(links)) if links else []


def linked(prints: DataFrame, lanes: int, radius: int, words: int = 4, similarity: float = 0.0, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints, thinned to forests; prints: distinct (node, size)."""
    cell, reach = size_cells(similarity) if similarity else count_cells(words, radius)

    def lane_array(nodes: list[str]) -> np.ndarray:
        return np.frombuffer(bytes.fromhex("".join(nodes)), dtype=">u8").astype("<u8").reshape(-1, lanes)

    def in_cells():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, sizes = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell(lane_array(nodes), sizes), pa.int64())], names=["node", "size", "cell"])

        return work

    placed = materialise(prints.select("node", "size").mapInArrow(per_batch(in_cells), "node string, size long, cell long"), "cells")
    subs = placed.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("subs"))  # at most (64 / words + 1) ** words cells, or as many as sizes have
    dealt = placed.join(subs, "cell").withColumn("sub", F.pmod(F.xxhash64("node"), F.col("subs")).cast("int"))
    tiles = dealt.groupBy("cell", "sub").agg(F.sort_array(F.collect_list(F.struct("node", "size"))).alias("m"))
    tiles = materialise(tiles.select("cell", "sub", F.array_join("m.node", "").alias("nodes"), F.col("m.size").alias("sizes")), "tiles")

    def near(batches):
        for batch in batches:
            cells = batch.column(0).to_pylist()
            cells = [reach(c) for c in cells]
            owner = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
            yield pa.RecordBatch.from_arrays([pa.array([x for c in cells for x in c], pa.int64()), *[batch.column(k).take(pa.array(owner)) for k in range(4)]], names=["at", "cell_a", "sub_a", "nodes_a", "sizes_a"])

    left = tiles.mapInArrow(near, "at long, cell_a long, sub_a int, nodes_a string, sizes_a array<long>")
    # the tiles of a full cell are spread over several keys, and those they meet are sent to each
    keys = subs.select(F.col("cell").alias("cell_k"), F.ceil(F.col("subs") / SPLIT).cast("int").alias("keys"))
    left = left.join(keys, F.col("at") == F.col("cell_k")).withColumn("key", F.explode(F.sequence(F.lit(0), F.col("keys") - 1)))
    right = tiles.join(keys, F.col("cell") == F.col("cell_k")).select("cell", "sub", "nodes", "sizes", F.pmod("sub", "keys").alias("key_b"))
    pairs = left.join(right, (F.col("at") == F.col("cell")) & (F.col("key") == F.col("key_b")) & ((F.col("cell_a") < F.col("cell")) | (F.col("sub_a") <= F.col("sub"))))

    def links(batches):
        for batch in batches:
            found_a, found_b = [], []
            for na, sa, nb, sb in zip(*(batch.column(k) for k in range(4))):
                na, nb = na.as_py(), nb.as_py()
                a, b = lane_array([na]), lane_array([nb])
                pa_, pb = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
                if pa_.min() - pb.max() > radius or pb.min() - pa_.max() > radius:
                    continue
                sizes = (sa.values.to_numpy(), sb.values.to_numpy(), similarity) if similarity else (None, None, 0.0)
                width = 16 * lanes
                for x, y in compare(a, b, radius, *sizes):
                    p = na[x * width : (x + 1) * width]
                    q = nb[(y - len(a)) * width : (y - len(a) + 1) * width] if y >= len(a) else na[y * width : (y + 1) * width]
                    if p != q:
                        found_a.append(min(p, q))
                        found_b.append(max(p, q))
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.array(found_a), pa.array(found_b)], names=["a", "b"])

    return pairs.select("nodes_a", "sizes_a", "nodes", "sizes").mapInArrow(links, "a string, b string").distinct()


def hubs_of(both: DataFrame, links: int) -> list[str]:
    """The nodes with very many links; fewer than 2 / HUB_SHARE, whatever the links."""
    least = max(HUB_LINKS, links * HUB_SHARE)
    if links <= least:
        return []
    return [r["a"] for r in both.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > least).select("a").collect()]


def with_least(rows: DataFrame, least: DataFrame, node: str, other: str, hubs: list[str]) -> DataFrame:
    """rows with the column m of least joined by node; the rows of a hub are spread by their other end."""
    if not hubs:
        return rows.join(least, node)
    hub = F.col(node).isin(hubs)
    spread = rows.withColumn("_salt", F.when(hub, F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    each = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(hub, F.lit(SALTS - 1)).otherwise(F.lit(0)))))
    return spread.join(each, [node, "_salt"]).drop("_salt")


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """node and root (the smallest node of its component) of every node of the links (a < b).

    Large and small stars in turn: each node hands its larger, then its smaller neighbours to the smallest one, until
    every link leads to a root. Every round is a written table.
    """
    edges = materialise(links.select("a", "b").where("a < b").distinct(), "links")
    seen, count = None, edges.count()
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hubs = hubs_of(both, count)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = with_least(both.where("b > a"), least, "a", "b", hubs).select(F.col("m").alias("a"), "b").where("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = with_least(large, low, "b", "a", hubs)
        star = small.select(F.col("m").alias("a"), "b").unionByName(small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        edges = materialise(star, "stars")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == seen:
            break
        seen, count = state, state["n"]
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def similar_pairs(sets: list[np.ndarray], tiles: list[int], similarity: float) -> list[tuple[int, int]]:
    """Pairs of sets of Jaccard similarity `similarity` or more that connect the same components as all of these.

    Where the sets are of two tiles, only pairs across them are compared; each set has distinct values.
    """
    n, sizes, tile = len(sets), np.array([len(x) for x in sets]), np.array(tiles)
    across = len(set(tiles)) > 1
    _, numbers = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(numbers, np.cumsum(sizes)[:-1])
    held, label, place, out = np.zeros(len(numbers), dtype=bool), np.arange(n), np.arange(n), []
    for i in range(n):
        fits = (place > i) & (label != label[i]) & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]) - 1e-9) & (sizes > 0)
        if across:
            fits &= tile != tile[i]
        others = np.nonzero(fits)[0]
        if not len(others):
            continue
        held[parts[i]] = True
        common = np.add.reduceat(held[np.concatenate([parts[j] for j in others])], np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
        held[parts[i]] = False
        for j in others[common >= similarity * (sizes[others] + sizes[i] - common) - 1e-9].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def exact_links(df: DataFrame, distinct: DataFrame, shingle: int, similarity: float, text: str, key: str) -> DataFrame:
    """Links (a, b) between sets (own) of one candidate component (root) that are similar enough, thinned to forests.

    distinct: own, root, size and least (is null, doc_id, doc: one document that holds the set).
    """
    counts = distinct.groupBy("root").agg(F.count("*").alias("_n"), F.sum("size").alias("_total")).where("_n > 1")
    subs = F.ceil(F.greatest(F.col("_n") / SET_TILE, F.col("_total") / SET_TILE_SHINGLES)).cast("int")
    # written, so that the join may split a component with very many sets
    asked = distinct.join(materialise(counts.select("root", subs.alias("subs")), "counts"), "root").select("own", "root", "subs", F.col("least.doc_id").alias("_id"), F.col("least.doc").alias("_doc"))
    texts = df.select(F.col(key).alias("_key"), F.xxhash64(F.col(text).cast("string")).alias("_hash"), F.col(text).cast("string").alias("_text"))
    found = asked.join(texts, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_doc"))).select("own", "root", "subs", "_text")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [np.unique(shingle_hashes(t or b"", shingle)).tobytes() for t in binary_lists(batch, "_text")]
            return pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], pa.array(sets, pa.binary())], names=["own", "root", "subs", "set"])

        return work

    sets = materialise(found.mapInArrow(per_batch(make), "own string, root string, subs int, set binary"), "sets")
    tile = F.pmod(F.xxhash64("own"), F.col("subs")).cast("int")
    dealt = sets.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    dealt = dealt.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other")).drop("subs", "other")

    def links(group: pa.Table) -> pa.Table:
        # a document that repeats gives its set several times
        held = {own: (np.frombuffer(raw, dtype="<u8"), n) for own, raw, n in zip(group["own"].to_pylist(), group["set"].to_pylist(), group["tile"].to_pylist())}
        names = sorted(held)
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        whole = low == high or len({held[x][1] for x in names}) > 1  # else one of the tiles has no set
        pairs = similar_pairs([held[x][0] for x in names], [held[x][1] for x in names], similarity) if whole and len(names) > 1 else []
        return pa.table({"a": pa.array([names[i] for i, _ in pairs], pa.string()), "b": pa.array([names[j] for _, j in pairs], pa.string())})

    return dealt.groupBy("root", "low", "high").applyInArrow(links, "a string, b string")


def similar_groups(df: DataFrame, shingle: int, radius: int, lanes: int, similarity: float, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Every row (doc_id, doc, node, own, size), and every own with its component (root) and its smallest row.

    least: no_id, doc_id and doc (hash of the text) of the smallest row, null doc_ids last.
    """
    prints = materialise(set_fingerprints(df, shingle, lanes, text, key), "prints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc")).alias("least")
    distinct = materialise(prints.groupBy("own", "node", "size").agg(least), "distinct")
    near = components(linked(distinct.select("node", "size").distinct(), lanes, radius, similarity=similarity))
    candidates = distinct.join(near, "node", "left").select("own", F.coalesce("root", "node").alias("root"), "size", "least")
    candidates = materialise(candidates, "candidates")
    exact = components(exact_links(df, candidates, shingle, similarity, text, key)).withColumnRenamed("node", "own")
    return prints, candidates.drop("root").join(exact, "own", "left").select("own", F.coalesce("root", "own").alias("root"), "least")


def near_duplicates(df: DataFrame, shingle: int = 3, radius: int = 2, lanes: int = 1, words: int = 4, similarity: float = 0.0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint and component_id (the smallest doc_id reachable over links) of every row."""
    if similarity:
        prints, labelled = similar_groups(df, shingle, radius, lanes, similarity, text, key)
        smallest = labelled.groupBy("root").agg(F.min("least").getField("doc_id").alias("component_id"))
        final = labelled.join(smallest, "root").select("own", "component_id")
        return prints.join(final, "own").select("doc_id", F.col("node").alias("fingerprint"), "component_id")
    prints = materialise(fingerprints(df, shingle, lanes, text, key), "prints")
    distinct = materialise(prints.groupBy("node").agg(F.min("doc_id").alias("least")).withColumn("size", F.lit(0).cast("long")), "distinct")
    roots = components(linked(distinct, lanes, radius, words))
    labelled = distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    final = labelled.join(materialise(smallest, "smallest"), "root").select("node", "component_id")
    return prints.join(final, "node").select("doc_id", F.col("node").alias("fingerprint"), "component_id")
