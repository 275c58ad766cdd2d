"""Secret scans: base patterns, and dictionary-primed compression novelty.

Base kinds are found by pattern. The method adds spans of kind `novel`: candidate strings of any length with a sensitive
word near on either side are compressed after the text around them by zstandard primed with a dictionary: code words, and
the identifiers of the corpus, that is, the runs of letters that stand in most documents (runs of 3 to 16 letters, so that
no key gets into it). The bytes a candidate adds to the compressed context are its novelty. Identifiers, paths and prose cost
few bytes; keys and passwords cost nearly all of theirs. Candidates that add at least `least` bytes a character are
reported; long ones are measured in consecutive blocks, and neighbouring blocks reported as one span. Candidates with
only white space and punctuation between them (the lines of a key) share their sensitive words.

Defined results: null text is empty and has no span; overlapping spans of different kinds are all reported, novel
spans are of what base spans leave of a candidate; repeated rows give repeated rows; an empty table gives an empty result; other
columns are ignored by scan and kept by redact, whatever their names; very long texts are scanned whole.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialise, per_batch, small_batches

#: The base kinds, in the order of their listing.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGNED = 6
#: Candidates of the method, and the words that make their context sensitive.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ADJOINING = re.compile(r"""[\s"'\\,;:.>#*|()]*""")
SENSITIVE = re.compile(r"auth|bearer|credential|key|passw|passphrase|private|pwd|secret|signature|token", re.ASCII | re.IGNORECASE)
#: Characters on either side of a candidate in which a sensitive word counts, and those compressed as context.
NEAR, CONTEXT = 40, 256
#: Runs of letters that identifiers are made of, and how many of the most frequent prime the compressor.
IDENTIFIER, IDENTIFIERS = "[A-Za-z][a-z]{2,15}", 4_000
#: The shortest string that is measured, and the blocks in which long ones are.
SHORTEST, MEASURED = 16, 512
#: Compressed bytes that a candidate must add for each of its characters.
LEAST = 0.6
#: What primes the compressor: code words, and names that identifiers are made of.
CODE_WORDS = (
    "import from return def class self None True False function const let var public private static void int string bool struct package func type interface extends implements "
    "if else elif for while try except catch finally throw raise new this super null undefined lambda yield async await with as in is not and or "
    "config settings option default value values name names index count total length size number user users client server host port path file files directory request response "
    "header headers content data database table column row query select insert update delete where order group connection session cookie parameter argument result error message "
    "version release branch commit build test tests example examples sample placeholder changeme your_api_key_here xxxxxxxx 1234567890 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    "https:// http:// www. .com .org .net .json .yaml .html /usr/local/bin /home/user/ application/json text/plain utf-8 sha256 base64 uuid timestamp created_at updated_at "
    "password passwd secret token api_key apikey access_key private_key public_key authorization bearer signature credential credentials"
)


class Novelty:
    """Marginal compressed bytes of strings in a context, under a compressor primed with code words and identifiers."""

    def __init__(self, identifiers: str = "", level: int = 3):
        primed = zstandard.ZstdCompressionDict(f"{identifiers} {CODE_WORDS}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=level)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=primed, write_checksum=False, write_content_size=False)

    def added(self, context: str, candidate: str) -> int:
        head = context.encode("utf-8", "replace")
        return len(self.compressor.compress(head + candidate.encode("utf-8", "replace"))) - len(self.compressor.compress(head))


def corpus_identifiers(df: DataFrame, text: str = "text", most: int = IDENTIFIERS) -> str:
    """The letter runs that stand in most documents, the most frequent last, where the compressor finds them cheapest.

    Counts fall in bins of a twelfth of their size; the highest bins that hold `most` runs in all are taken whole, so the
    driver reads a row for each bin and at most that many runs, whatever the corpus.
    """
    runs = F.array_distinct(F.regexp_extract_all(F.col(text).cast("string"), F.lit(IDENTIFIER), F.lit(0)))
    counts = df.select(F.explode(runs).alias("run")).groupBy("run").agg(F.count("*").alias("n")).where("n > 1")
    counts = materialise(counts.withColumn("bin", F.floor(F.log2("n") * 8)), "identifiers")
    held, least = 0, None
    for r in counts.groupBy("bin").agg(F.count("*").alias("runs")).orderBy(F.desc("bin")).collect():  # at most 8 * 64 rows
        held += r["runs"]
        if held > most:
            break
        least = r["bin"]
    if least is None:
        return ""
    found = counts.where(F.col("bin") >= least).collect()  # at most so many
    return " ".join(r["run"] for r in sorted(found, key=lambda r: (r["n"], r["run"])))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGNED]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def sensitive_candidates(text: str) -> list[tuple[int, int]]:
    """Candidates with a sensitive word near them, or near one of those they adjoin."""
    out: list[tuple[int, int]] = []
    group: list[tuple[int, int]] = []
    near = False
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if group and not (a - group[-1][1] <= NEAR and ADJOINING.fullmatch(text, group[-1][1], a)):
            out += group if near else []
            group, near = [], False
        group.append((a, b))
        near = near or bool(SENSITIVE.search(text, max(0, a - NEAR), a) or SENSITIVE.search(text, b, b + NEAR))
    return out + (group if near else [])


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, least: float = LEAST) -> list[tuple[int, int, int]]:
    """Spans that the method adds: candidates near a sensitive word whose novelty is high."""
    out: list[tuple[int, int, int]] = []
    for a, b in sensitive_candidates(text):
        free, at = [], a
        for s, _, e in base:
            if s < b and at < e:
                free.append((at, s))
                at = e
        for x, y in [*free, (at, b)]:
            while y - x >= SHORTEST:
                end = y if y - x < MEASURED + SHORTEST else x + MEASURED
                if novelty.added(f"{text[y : y + CONTEXT]}\n{text[max(0, x - CONTEXT) : x]}", text[x:end]) >= least * (end - x):
                    if out and out[-1][2] == x:
                        out[-1] = (out[-1][0], 3, end)
                    else:
                        out.append((x, 3, end))
                x = end
    return out


def scan(df: DataFrame, least: float = LEAST, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep and found: array of (kind, start, end) by start and kind; offsets in code points."""
    small_batches(df.sparkSession)
    source = df.select(*keep, F.col(text).cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text")
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    identifiers = corpus_identifiers(df, text)

    def make():
        novelty = Novelty(identifiers)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            for t in batch.column(batch.schema.get_field_index("_text")).to_pylist():
                base = base_spans(t) if t else []
                found.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(base + (novel_spans(t, base, novelty, least) if t else []))])
            kept = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            return pa.RecordBatch.from_arrays([*kept, pa.array(found, span)], names=[*keep, "found"])

        return work

    return source.mapInArrow(per_batch(make), f"{kinds}, found array<struct<kind:string,start:long,end:long>>")


def redacted(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """The text with every span, overlapping ones joined, replaced by a mark."""
    parts, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redact(df: DataFrame, least: float = LEAST, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of df, with the secrets in the text replaced by a mark."""
    small_batches(df.sparkSession)
    names = df.columns
    at = names.index(text)

    identifiers = corpus_identifiers(df, text)

    def make():
        novelty = Novelty(identifiers)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for t in batch.column(at).to_pylist():
                base = base_spans(t) if t else []
                spans = base + (novel_spans(t, base, novelty, least) if t else [])
                out.append(redacted(t, [(a, b) for a, _, b in spans], mark) if spans else t)
            return pa.RecordBatch.from_arrays([pa.array(out, batch.schema.field(at).type) if n == at else batch.column(n) for n in range(len(names))], names=names)

        return work

    return df.mapInArrow(per_batch(make), df.schema)
