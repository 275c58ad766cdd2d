"""Substring deduplication by hashing lines.

A text is cut into lines. Lines are normalised (letters, marks and digits of any script, lower-cased, single spaces;
each ideograph or kana is a word) and digested to 128 bits; digests are grouped over the whole corpus, the occurrence
with the smallest (doc_id, text hash, position) is kept, and every other one is removed, however short it is.

Passages also repeat inside lines, so a line of several sentences gives its sentences as further units (ends in any
script, where its words stand apart only before white space; sentences of more than `LONG_UNIT` words are cut where a
hash of two neighbouring words says so, and so alike wherever they stand). A sentence is digested together with as many
of those before it in its line as make `CONTEXT_WORDS` words, and without that many it is no unit. So a sentence goes
only where it stands after the same words as in an earlier occurrence; short phrases that recur by chance stay.

The grouping is one range sort by digest and rank, so a digest however frequent spreads over as many tasks as its rows
need; each task flags all but the first of a digest, and whether its own first row goes on from an earlier task is
settled from one row a task.

Defined results: null text has no unit and stays null; lines without letter or digit are no units and stay; texts are
taken whole, and a very long line is one unit and its sentences others; rows with a null doc_id rank last, by text hash;
equal rows (same doc_id and text) are one document and are treated alike; a text of which all lines go becomes empty; an
empty table gives an empty result; other columns are kept, whatever their names. Removed spans are offsets in code
points of the original text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from gridloom.llm.common import free_name, materialise_mapped, small_batches

#: Ends of lines, and of sentences.
BOUNDARY = regex.compile(r"\n|(?<=[\p{STerm}…])[ \t]+|(?<=[。！？｡．])")
WORDS = regex.compile(r"(?V1)[\p{Han}\p{Hiragana}\p{Katakana}]|[[\p{L}\p{M}\p{N}]--[\p{Han}\p{Hiragana}\p{Katakana}]]+")
#: Texts without these characters hold no marks and no script but Latin, and the same patterns have a plainer form.
WIDE = re.compile("[\u0300-\u1fff\u20d0-\u20ff\u2c00-\U0010ffff]")
LATIN_BOUNDARY, LATIN_WORDS = re.compile(r"\n|(?<=[.!?…‼‽⁇⁈⁉])[ \t]+"), re.compile(r"[^\W_]+")
#: Sentences of more words are cut by content, into parts of about so many.
LONG_UNIT, PART = 40, 12
#: Words that a sentence is digested with, at least.
CONTEXT_WORDS = 8


def parts(text: str, start: int, stop: int, found: list) -> list[tuple[int, int, list[str]]]:
    """A long sentence in parts: cut between two words (found: their matches) where their hash says so."""
    words = [m.group() for m in found]
    plain = " ".join(words).lower().split(" ")
    hashed = xxhash.xxh32_intdigest
    cuts = [n for n, (a, b) in enumerate(zip(plain, plain[1:]), 1) if hashed(f"{a} {b}") % PART == 0]
    edges = [(a, b) for a, b in zip([0, *cuts], [*cuts, len(words)])]
    return [(found[a].start() if a else start, found[b - 1].end() if b < len(words) else stop, words[a:b]) for a, b in edges]


def lines_of(text: str) -> list[tuple[int, int, list[tuple[int, int, list[str]]]]]:
    """(start, end, sentences) of each line that has a word, sentences as (start, end, words)."""
    out, at, start, found = [], 0, 0, []
    boundary, in_words = (BOUNDARY, WORDS) if WIDE.search(text) else (LATIN_BOUNDARY, LATIN_WORDS)
    words_in = in_words.findall
    for m in [*boundary.finditer(text), None]:
        stop = m.start() if m else len(text)
        if words := words_in(text, at, stop):
            found += [(at, stop, words)] if len(words) <= LONG_UNIT else parts(text, at, stop, list(in_words.finditer(text, at, stop)))
        at = m.end() if m else stop
        if m is None or m.group() == "\n":
            if found:
                out.append((start, stop, found))
            start, found = at, []
    return out


def contexts(sentences: list[tuple[int, int, list[str]]]) -> list[int]:
    """For each sentence of a line the first one that it is digested with, -1 for none."""
    out = []
    for n in range(len(sentences)):
        first, held = n, len(sentences[n][2])
        while held < CONTEXT_WORDS and first:
            first -= 1
            held += len(sentences[first][2])
        out.append(first if held >= CONTEXT_WORDS else -1)
    return out


def units(text: str) -> list[tuple[int, int, bool, str, int]]:
    """(start, end, whether a whole line, normalised words, seed) of each unit in order, a line before its sentences."""
    out = []
    for start, stop, found in lines_of(text):
        plain = [" ".join(words).lower() for _, _, words in found]
        out.append((start, stop, True, " ".join(plain), 0))
        if len(found) > 1:
            # several sentences are told from one by the seed
            out += [(a, b, False, " ".join(plain[first : n + 1]), int(first < n)) for n, ((a, b, _), first) in enumerate(zip(found, contexts(found))) if first >= 0]
    return out


def digests(text: str | None) -> np.ndarray:
    """The digest of each unit, as two signed numbers a row."""
    found = b"".join([xxhash.xxh3_128_digest(words.encode(), seed) for _, _, _, words, seed in units(text or "")])
    return np.frombuffer(found, dtype="<i8").reshape(-1, 2)


def removed_spans(text: str, repeats: set[int]) -> list[tuple[int, int]]:
    """The spans of the units at these positions; a repeated line goes whole, sentences that adjoin as one span."""
    out: list[tuple[int, int]] = []
    gone = 0  # the end of the last repeated line
    for n, (start, stop, line, _, _) in enumerate(units(text)):
        if n in repeats and (line or start >= gone):
            if not line and out and not text[out[-1][1] : start].strip(" \t") and out[-1][1] > gone:
                out[-1] = (out[-1][0], stop)
            else:
                out.append((start, stop))
            gone = stop if line else gone
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; a line that is left empty goes with its line end."""
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:a])
        if (a == 0 or text[a - 1] == "\n") and b < len(text) and text[b] == "\n":
            b += 1
        elif a and text[a - 1] in " \t" and b < len(text) and text[b] in " \t":
            b += 1
        at = b
    return "".join([*parts, text[at:]])


def every_unit(df: DataFrame, text: str, key: str) -> DataFrame:
    """_key, _doc (hash of the text), pos, hi and lo (digest) of every unit, written to the shared folder."""
    source = df.select(F.col(key).alias("_key"), F.xxhash64(F.col(text).cast("string")).alias("_doc"), F.col(text).cast("string").alias("_text"))

    def cut(batches):
        for batch in batches:
            found = [digests(t) for t in batch.column(2).to_pylist()]
            counts = np.array([len(d) for d in found], dtype=np.int64)
            total, which = int(counts.sum()), np.repeat(np.arange(len(found)), counts)
            pos = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
            both = np.concatenate(found) if found else np.empty((0, 2), dtype="<i8")
            columns = [batch.column(0).take(pa.array(which)), batch.column(1).take(pa.array(which)), pa.array(pos.astype(np.int32)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(columns, names=["_key", "_doc", "pos", "hi", "lo"])

    return materialise_mapped(source, cut, f"_key {source.schema['_key'].dataType.simpleString()}, _doc long, pos int, hi long, lo long", "units")


def differs(batch: pa.RecordBatch, columns: list[int]) -> np.ndarray:
    """For every row but the first, whether one of the columns differs from the row before; nulls are equal."""
    out = np.zeros(batch.num_rows - 1, dtype=bool)
    for n in columns:
        a, b = batch.column(n).slice(1), batch.column(n).slice(0, batch.num_rows - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        out |= ~same.to_numpy(zero_copy_only=False)
    return out


def flag(batches):
    """Of rows in order: the repeats within this task (kind 0), its first row (kind 1) and its last (kind 2)."""
    part, last, past = TaskContext.get().partitionId(), None, False
    names = ["_key", "_doc", "pos", "hi", "lo", "kind", "part"]

    def listed(rows: pa.RecordBatch, kind: int) -> pa.RecordBatch:
        n = rows.num_rows
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32())], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        if last is None:
            yield listed(batch.slice(0, 1), 1)
            rows = batch
        else:  # the row before stands first
            rows = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        new = np.concatenate([[True], differs(rows, [3, 4])])
        other = np.concatenate([[False], differs(rows, [0, 1, 2])]) & ~new
        seen = np.cumsum(other) + past  # a unit of another place than the keeper's, in this run of a digest
        runs_at = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        base = np.where(runs_at == 0, 0, seen[runs_at])
        repeat = seen > base
        past = bool(repeat[-1])
        mask = repeat if last is None else repeat[1:]
        if mask.any():
            yield listed(batch.filter(pa.array(mask)), 0)
        last = batch.slice(batch.num_rows - 1, 1)
    if last is not None:
        yield listed(last, 2)


def repeated_units(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """_key, _doc and repeats (positions of the units that an earlier one equals) of every document that has some."""
    small_batches(df.sparkSession)
    every = every_unit(df, text, key)
    order = ["hi", "lo", F.col("_key").asc_nulls_last(), "_doc", "pos"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in every.schema)
    flagged = materialise_mapped(every.repartitionByRange(*order).sortWithinPartitions(*order), flag, f"{kinds}, kind int, part int", "flags")
    # two rows a task, as for the bounds of a range sort
    edges = sorted(flagged.where("kind > 0").select("part", "kind", "hi", "lo").collect())
    again = [b["part"] for a, b in zip(edges, edges[1:]) if b["kind"] == 1 and (a["hi"], a["lo"]) == (b["hi"], b["lo"])]
    gone = flagged.where((F.col("kind") == 0) | ((F.col("kind") == 1) & F.col("part").isin(again)) if again else F.col("kind") == 0)
    return gone.groupBy("_key", "_doc").agg(F.collect_set("pos").alias("repeats"))


def dedup_lines(df: DataFrame, text: str = "text", key: str = "doc_id", spans: str | None = "_spans") -> DataFrame:
    """All rows and columns of df, the text without repeats, and the spans (array of start and end) that were removed.

    spans: the name of that column, with underscores added where df has it; None leaves it out.
    """
    names = df.columns
    at, spans_type = names.index(text), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    added = [] if spans is None else [free_name(names, spans)]
    gone = repeated_units(df, text, key)

    def cut(batches):
        for batch in batches:
            texts, found = batch.column(at).to_pylist(), []
            for t, repeats in zip(texts, batch.column(len(names)).to_pylist()):
                found.append(removed_spans(t, set(repeats)) if t and repeats else [])
            kept = pa.array([without(t, s) if s else t for t, s in zip(texts, found)], batch.schema.field(at).type)
            columns = [kept if n == at else batch.column(n) for n in range(len(names))]
            if added:
                columns.append(pa.array([[{"start": a, "end": b} for a, b in s] for s in found], spans_type))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    listed = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
    schema = StructType([*[StructField(f.name, f.dataType) for f in df.schema], *[StructField(n, listed) for n in added]])
    other = gone.select(F.struct("_key", "_doc").alias("_gone"), "repeats")
    same = df[f"`{key}`"].eqNullSafe(other["_gone"]["_key"]) & (F.xxhash64(df[f"`{text}`"].cast("string")) == other["_gone"]["_doc"])
    joined = df.join(other, same, "left").select(*[df[f"`{c}`"] for c in names], other["repeats"].alias(free_name(names, "_repeats")))
    return joined.mapInArrow(cut, schema)
