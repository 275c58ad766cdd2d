"""Best-fit packing of token sequences, bulk-synchronous.

Documents are encoded, cut only where longer than the capacity, and the pieces are packed so that few sequences are
needed. Pieces are counted by length before they are shuffled: a run is a length with the ranks of its pieces, and as
lengths are whole numbers up to the capacity, there are at most `capacity` runs, whatever the size of the corpus. Gaps
are runs of neighbouring sequence numbers with the same gap.

Pieces above half of the capacity open a sequence each, as in any packing. Then every round deals the runs of pieces
and gaps to ranges of their sizes, one task a range, and all ranges sweep at once: from the longest length down, a sweep
matches the pieces to their successor (the smallest gap that holds them). Where more pieces want a gap than it holds,
those of lower rank get it; the others go on to the next successor, and beyond the last gap of the range to the next
round, whose ranges are twice as wide. Gaps shrink by what they took and go to the range of their new size. No piece
takes a gap that a longer one of another range could take, as that range holds larger gaps only. In the round whose one
range holds all sizes, pieces without a gap open new sequences.

Every round is a job over tables of runs in the shared folder; the driver reads totals, and at the end the flows (which
ranks of a length go to which sequences), whose number depends on the capacity and not on the rows. Ranking pieces
within their length and giving every piece the place of its rank are distributed, with hot lengths salted over buckets.

Defined results: null text is an empty document (one piece, only the end id); repeated rows are packed each; an empty
table gives no piece; other columns are ignored; a null doc_id is kept.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import materialise, per_batch, small_batches, string_parts
from gridloom.llm.tokens import CHUNK_CHARS, drops_space, space_memo, spliced_ids

#: Pieces that one salted bucket of a length holds on average.
BUCKET_ROWS = 200_000

#: Ranges of sizes in the first round; every round halves them.
RANGES = 8

#: Columns of a flow; runs of pieces and gaps have the same, with their size as length.
FLOW = ("length", "rank", "n", "first", "per", "offset")


def token_pieces(df: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each piece: key, piece, start, length and ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    small_batches(df.sparkSession)
    source = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kind = source.schema["_key"].dataType.simpleString()

    def make():
        memo = space_memo(path) if drops_space(path) else None
        end = np.array([end_id], dtype="<u4")

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            owner, rows = [], []
            every = (ids for part in string_parts(batch.column(1)) for ids in (memo.ids_many(part) if memo is not None else (np.concatenate([x.astype("<u4") for x in spliced_ids(path, t, CHUNK_CHARS)]) for t in part.to_pylist())))
            for n, ids in enumerate(every):
                raw = np.concatenate([ids, end]).tobytes()
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    piece = raw[at : at + 4 * capacity]
                    owner.append(n)
                    rows.append((k, k * capacity, len(piece) // 4, zlib.crc32(piece)))
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int32())), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["_key", "piece", "start", "length", "ids_crc32"])

        return work

    return source.mapInArrow(per_batch(make), f"_key {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("_key", key)


def sweep(runs: dict[int, int], capacity: int, ranks: dict[int, int] | None = None, gaps: dict[int, list[tuple[int, int]]] | None = None, opens: bool = True) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Matches runs of pieces to gaps, longest first; the flows (length, first rank, how many, first sequence, per sequence, offset) and the number of sequences opened.

    runs has how many pieces of each length there are, ranks their first ranks (0 where absent), gaps the runs (first
    sequence, how many) of each gap; all are updated to what is left. Without opens, pieces that no gap holds are left.
    Rank r of a flow goes to sequence first + (r - rank) // per, at offset + (r - rank) % per * length.
    """
    flows: list[tuple[int, int, int, int, int, int]] = []
    ranks = {} if ranks is None else ranks
    gaps = {} if gaps is None else gaps
    sizes = sorted(gaps)
    opened = 0

    def leave(gap: int, first: int, count: int) -> None:
        if gap > 0 and count > 0:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, count))

    for length in sorted(runs, reverse=True):
        left, rank = runs.pop(length), ranks.pop(length, 0)
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            elif opens:
                gap, first = capacity, opened
                count = -(-left // (capacity // length))
                opened += count
            else:
                runs[length], ranks[length] = left, rank
                break
            per = gap // length
            full = min(count, left // per)
            if full:
                flows.append((length, rank, full * per, first, per, capacity - gap))
                leave(gap - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < count and left:  # the last sequence of this round takes fewer
                flows.append((length, rank, left, first + full, left, capacity - gap))
                leave(gap - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            leave(gap, first + full, count - full)
    return flows, opened


def matched(runs: DataFrame, capacity: int) -> DataFrame:
    """Flows of all runs (length, n), round by round."""

    def row(kind: str, size, rank, n, first, per, offset) -> list:
        return [F.lit(kind).alias("kind"), *[(x if hasattr(x, "alias") else F.lit(x)).cast("long").alias(c) for c, x in zip(FLOW, (size, rank, n, first, per, offset))]]

    length, n, half = F.col("length"), F.col("n"), F.col("length") * 2 > capacity
    own = F.shiftleft(length.cast("long"), 40)  # sequences of the long pieces; those of the last round count from 0
    flows = [runs.where(half).select(*row("flow", length, 0, n, own, 1, 0)).drop("kind")]
    state = runs.where(~half).select(*row("piece", length, 0, n, 0, 0, 0)).unionAll(runs.where(half & (length < capacity)).select(*row("gap", F.lit(capacity) - length, 0, n, own, 0, 0)))
    ranges = RANGES
    while ranges:
        state = materialise(state.withColumn("range", F.floor(F.col("length") * ranges / (capacity + 1))).groupBy("range").applyInArrow(_range_sweep(capacity, ranges == 1), state.schema), "round")
        flows.append(state.where("kind = 'flow'").drop("kind"))
        state = state.where("kind != 'flow'")
        ranges //= 2
    return reduce(DataFrame.unionAll, flows)


def _range_sweep(capacity: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        runs, ranks, gaps = {}, {}, {}
        # in a fixed order, so that a task that runs again finds the same flows
        for kind, size, rank, n, first in sorted(zip(*[table.column(c).to_pylist() for c in ("kind", "length", "rank", "n", "first")])):
            if kind == "piece":
                runs[size], ranks[size] = n, rank
            else:
                gaps.setdefault(size, []).append((first, n))
        flows, _ = sweep(runs, capacity, ranks, gaps, last)
        rows = [("flow", *f) for f in flows]
        rows += [("piece", size, ranks[size], n, 0, 0, 0) for size, n in runs.items()]
        rows += [("gap", size, 0, n, first, 0, 0) for size, found in gaps.items() for first, n in found]
        columns = list(zip(*rows)) or [()] * 7
        return pa.table([pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["kind", *FLOW])

    return run


def pack(pieces: DataFrame, capacity: int = 4096, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to a frame with a column length (1 to capacity)."""
    spark = pieces.sparkSession
    runs = materialise(pieces.groupBy("length").agg(F.count("*").alias("n")), "runs")  # at most `capacity` rows
    total, hot, least, most = runs.agg(F.sum("n"), F.max("n"), F.min("length"), F.max("length")).first()
    if total and not 0 < least <= most <= capacity:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    total, hot = total or 0, hot or 0
    flows = [tuple(r) for r in matched(runs, capacity).collect()]  # their number depends on the capacity, not on the rows
    buckets = max(1, math.ceil(hot / BUCKET_ROWS), spark.sparkContext.defaultParallelism if total > BUCKET_ROWS else 1, 16)
    names = pieces.columns
    salted = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counted = salted.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select(F.col("length").alias("_length"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy(*order, *[c for c in names if c not in order and c != "length"])
    ranked = salted.withColumn("_local", F.row_number().over(within) - 1).join(offsets, (F.col("length") == F.col("_length")) & (F.col("_bucket") == F.col("_b"))).select(*names, (F.col("_before") + F.col("_local")).alias("_rank"))
    table = np.array(sorted(flows), dtype=np.int64).reshape(-1, 6)
    shipped = spark.sparkContext.broadcast(table)  # bounded by the runs of lengths and gaps, not by the rows
    schema = ranked.select(*names, F.col("_rank").alias("sequence_id"), F.col("_rank").alias("offset")).schema

    def run(batches):
        flow = shipped.value
        keys = flow[:, 0] << 44 | flow[:, 1]
        for batch in batches:
            if batch.num_rows:
                length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
                rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False).astype(np.int64)
                own = flow[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
                step = rank - own[:, 1]
                columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(own[:, 3] + step // own[:, 4]), pa.array(own[:, 5] + step % own[:, 4] * own[:, 0])], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack_documents(df: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of all documents with their place: key, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(df, path, capacity, end_id, text, key)
    return pack(materialise(pieces, "pieces"), capacity, (key, "piece"))
