"""Quality rules with cross-document line frequency.

Lines are normalised (ASCII letters lower-cased, single spaces) and hashed. For each host (column `source`) and line
the distinct documents that hold it are counted over the whole corpus. Lines in more than `max_documents` documents of
a host are removed from its documents, and documents of which less than `least_left` of their words remain are
rejected as depleted, besides those that fail the base rules.

Documents are distinct up to true copies: a document counts by the hash of all its normalised lines in order, so a
group of copies counts once, however large, and is left for deduplication. Documents that differ in any line count each.

Defined results: null text has no word and fails the base rules; a null source is a host of its own; equal rows are one
document; very long texts are measured whole; an empty table gives an empty result; other columns are ignored by
line_statistics and kept by clean_lines, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gridloom.llm.common import binary_lists, free_name, materialise, per_batch, small_batches

#: Lines in more distinct documents of a host than this are removed.
MAX_DOCUMENTS = 20
#: Documents that keep less than this share of their words are depleted.
LEAST_LEFT = 0.5
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
#: Frequent lines up to this many are sent to every executor; beyond, they are joined by shuffle.
BROADCAST_LINES = 50_000


def line_key(line: bytes) -> int:
    """Hash of a normalised line, signed."""
    return xxhash.xxh64_intdigest(b" ".join(line.lower().split())) - (1 << 63)


def base_rules(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    words = raw.split()
    chars = sum(len(w) for w in words)
    if not raw.isascii():
        chars -= int(np.count_nonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) == 0x80))
    symbols = sum(raw.count(c) for c in SYMBOLS)
    lines = [line for line in raw.split(b"\n") if line.strip(b" \t\r\x0b\x0c")]
    repeated = 0
    if len(words) > 3:
        number: dict[bytes, int] = {}
        n = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
        size = len(number)
        if size < 2_000_000:
            windows = (n[:-2] * size + n[1:-1]) * size + n[2:]
            _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
        else:
            _, back, counts = np.unique(np.stack([n[:-2], n[1:-1], n[2:]], axis=1), axis=0, return_inverse=True, return_counts=True)
        again = counts[back.ravel()] > 1
        if again.any():
            cover = np.zeros(len(words), dtype=bool)
            for k in range(3):
                cover[k : k + len(again)] |= again
            repeated = int(cover.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def measured(df: DataFrame, text: str, key: str, host: str) -> DataFrame:
    """The base figures of every row, the hash of its normalised text, and its distinct lines: hash and words."""
    small_batches(df.sparkSession)
    source = df.select(F.col(key).alias("doc_id"), F.col(host).cast("string").alias("_host"), F.col(text).cast("string").alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def make():
        lines_type = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int32())]))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            figures, lines, copies = [], [], []
            for raw in binary_lists(batch, "_text"):
                raw = raw or b""
                figures.append(base_rules(raw))
                count: dict[int, int] = {}
                whole = xxhash.xxh64()
                for line in raw.split(b"\n"):
                    if n := len(line.split()):
                        h = line_key(line)
                        count[h] = count.get(h, 0) + n
                        whole.update(h.to_bytes(8, "little", signed=True))
                lines.append([{"h": h, "w": n} for h, n in count.items()])
                copies.append(whole.intdigest() - (1 << 63))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in zip(*figures)], pa.array(copies, pa.int64()), pa.array(lines, lines_type)], names=names)

        return work

    names = ["doc_id", "_host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_copy", "lines"]
    longs = ", ".join(f"{c} long" for c in names[2:8])
    return source.mapInArrow(per_batch(make), f"doc_id {kind}, _host string, {longs}, lines array<struct<h:long,w:int>>")


def frequent_lines(rows: DataFrame, max_documents: int) -> DataFrame:
    """_host and h of the lines in more than so many distinct documents of a host."""
    each = rows.select("_host", "_copy", F.explode("lines.h").alias("h"))
    distinct = each.groupBy("_host", "h", "_copy").agg(F.lit(1).alias("one"))
    return distinct.groupBy("_host", "h").agg(F.sum("one").alias("n")).where(F.col("n") > max_documents).select("_host", "h", "n")


def line_statistics(df: DataFrame, max_documents: int = MAX_DOCUMENTS, least_left: float = LEAST_LEFT, text: str = "text", key: str = "doc_id", host: str = "source") -> DataFrame:
    """doc_id, the base figures, base_failed, kept, n_left (words outside removed lines) of every row."""
    rows = materialise(measured(df, text, key, host).withColumn("_row", F.monotonically_increasing_id()), "lines")
    frequent = materialise(frequent_lines(rows, max_documents), "frequent")
    each = rows.select("_row", "_host", F.explode("lines").alias("l")).select("_row", "_host", F.col("l.h").alias("h"), F.col("l.w").alias("w"))
    other = frequent.select(F.col("_host").alias("_fh"), F.col("h").alias("_h"))
    if frequent.count() <= BROADCAST_LINES:
        other = F.broadcast(other)
    hit = each.join(other, F.col("_host").eqNullSafe(F.col("_fh")) & (F.col("h") == F.col("_h")))
    lost = hit.groupBy("_row").agg(F.sum("w").alias("lost"))
    joined = rows.drop("lines", "_copy").join(lost, "_row", "left").withColumn("n_left", F.col("n_words") - F.coalesce("lost", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("n_left") >= least_left * F.col("n_words"))).alias("kept"), "n_left")


def clean_lines(df: DataFrame, max_documents: int = MAX_DOCUMENTS, least_left: float = LEAST_LEFT, text: str = "text", key: str = "doc_id", host: str = "source") -> DataFrame:
    """The rows of df that are kept, their text without removed lines."""
    spark = df.sparkSession
    names = df.columns
    frequent = materialise(frequent_lines(measured(df, text, key, host), max_documents), "frequent")
    kinds = StructType([StructField(f.name, f.dataType) for f in df.schema])
    host_name, text_name, row_name, gone_name = (free_name(names, n) for n in ("_host", "_text", "_row", "_gone"))
    source = df.select(*[F.col(f"`{c}`") for c in names], F.col(host).cast("string").alias(host_name), F.col(text).cast("string").alias(text_name))

    def keep(batches, removed):
        for batch in batches:
            hosts, texts = batch.column(len(names)).to_pylist(), binary_lists(batch, text_name)
            out, mask = [], []
            for n, (h, raw) in enumerate(zip(hosts, texts)):
                gone = removed(n, h, batch)
                raw = raw or b""
                n_words, _, _, _, repeated = base_rules(raw)
                lines = raw.split(b"\n")
                left = [x for x in lines if not x.strip(b" \t\r\x0b\x0c") or line_key(x) not in gone] if gone else lines
                n_left = sum(len(x.split()) for x in left) if len(left) < len(lines) else n_words
                mask.append(n_words >= MIN_WORDS and 100 * repeated <= 50 * n_words and n_left >= least_left * n_words)
                out.append(b"\n".join(left).decode("utf-8", "replace"))
            kept = pa.array(out, batch.schema.field(names.index(text)).type)
            yield pa.RecordBatch.from_arrays([kept if c == text else batch.column(n) for n, c in enumerate(names)], names=names).filter(pa.array(mask))

    if frequent.count() <= BROADCAST_LINES:
        lines: dict = {}
        for r in frequent.collect():  # at most BROADCAST_LINES, as just counted
            lines.setdefault(r["_host"], set()).add(r["h"])
        shipped = spark.sparkContext.broadcast(lines)
        return source.mapInArrow(lambda batches: keep(batches, lambda n, h, batch: shipped.value.get(h, ())), kinds)
    # too many to send: the removed lines of each row come by joins
    rows = materialise(source.withColumn(row_name, F.monotonically_increasing_id()), "documents")
    own = rows.select(F.col(row_name).alias("row"), F.col(host_name).alias("host"), F.col(text_name).alias("text"))
    lines_of = measured(own, "text", "row", "host").select(F.col("doc_id").alias("row"), "_host", F.explode("lines.h").alias("h"))
    listed = frequent.select(F.col("_host").alias("frequent_host"), F.col("h").alias("frequent_line"))
    gone = lines_of.join(listed, F.col("_host").eqNullSafe(F.col("frequent_host")) & (F.col("h") == F.col("frequent_line"))).groupBy("row").agg(F.collect_set("h").alias("gone"))
    joined = rows.join(gone, rows[row_name] == gone["row"], "left").select(*[rows[f"`{c}`"] for c in names], rows[host_name], rows[text_name], gone["gone"].alias(gone_name))
    return joined.mapInArrow(lambda batches: keep(batches, lambda n, h, batch: set(batch.column(len(names) + 2)[n].as_py() or ())), kinds)
