"""Token counts by overlap resynchronisation.

Huge documents are never encoded in one piece: overlapping chunks are encoded with offsets, and neighbours are
spliced where both hold the same token boundary and that boundary is proven stable, that is, no token and no
normalisation step of the tokenizer can cross it. Where an overlap holds no such boundary it is widened, at worst
to the whole document, so counts always equal those of one encoding.

A boundary is proven stable when it lies between a character that is not white space and a following white-space
character and the tokenizer's file shows that pre-tokens end there (`proven_boundaries`): word BPE drops white space,
byte BPE and piece BPE put it in front of the next word, and no added special string holds any. Files that show neither
are refused for texts longer than one chunk.

A text of up to `CHUNK_CHARS` is one chunk and needs no splicing. Tokenizers that drop white space encode it from one
stable boundary to the next, each distinct string between two of them once, through a bounded memo.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated rows; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Memo, per_batch, small_batches, string_parts

#: White space at which every tokenizer here ends a pre-token.
SPACE = " \t\n\r\x0b\x0c"
STABLE = re.compile(rf"(?<=[^\s\x1c-\x1f\x85])(?=[{SPACE}])")
#: Documents longer than this many characters are encoded in overlapping chunks.
CHUNK_CHARS = 65_536
OVERLAP_CHARS = 512
#: Fixed value: the split pattern under which words and punctuation may be encoded apart.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Entries of one memo generation in a worker.
MEMO_ENTRIES = 500_000
#: Kinds of bytes: 1 ASCII punctuation, 2 digits and small letters, 3 capitals, 0 all others.
BYTE_KINDS = np.array([3 if 65 <= b <= 90 else 2 if chr(b).isalnum() and b < 128 else 1 if 33 <= b < 127 else 0 for b in range(256)], dtype=np.uint8)
#: Stands between chunks that are encoded together; chunks that hold it are encoded alone.
SENTINEL = "\x01"


def specification(path: str) -> dict:
    """The contents of a tokenizer file; nothing for files of the other library."""
    if not path.endswith(".json"):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def steps_of(spec: dict, part: str, members: str) -> list[dict]:
    """The steps of a normalizer or pre-tokenizer, those of a sequence in order."""
    whole = spec.get(part) or {}
    return whole.get(members, [whole] if whole else [])


def drops_space(path: str) -> bool:
    """True for tokenizer files whose pre-tokenizer drops white space, so that white space separates encodings."""
    spec = specification(path)
    split = any(s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert") and "\\s" in str(s.get("pattern")) for s in steps_of(spec, "pre_tokenizer", "pretokenizers"))
    whole = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or set(t["content"]) & set(SPACE) for t in spec.get("added_tokens", []))
    return split and not whole


def splits_words(path: str) -> bool:
    """True for files whose pattern and normalizer are those that words and their punctuation may be encoded apart by.

    The normalizer must be made of steps that change no lower-case Latin letter in composed form, and the pre-tokenizer
    must be the fixed pattern, under which a run of letters is one pre-token and a run of punctuation after it another.
    """
    spec = specification(path)
    normal = steps_of(spec, "normalizer", "normalizers")
    known = all(s.get("type") in ("NFC", "Lowercase") or s.get("type") == "Replace" and s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " " for s in normal)
    before = steps_of(spec, "pre_tokenizer", "pretokenizers")
    pattern = len(before) == 2 and before[0].get("pattern") == {"Regex": WORD_PATTERN} and before[1].get("type") == "ByteLevel" and not before[1].get("add_prefix_space") and not before[1].get("use_regex")
    return known and pattern and drops_space(path)


def lower_cases(path: str) -> bool:
    return any(s.get("type") == "Lowercase" for s in steps_of(specification(path), "normalizer", "normalizers"))


def plain_letters() -> str:
    """Latin letters that are one code point in composed form and stay one when lower-cased, as a character class."""
    return "A-Za-z" + "".join(c for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and len(c.lower()) == 1 and unicodedata.normalize("NFC", c) == c and unicodedata.normalize("NFC", c.lower()) == c.lower())


def proven_boundaries(path: str) -> bool:
    """Whether the tokenizer file proves that a pre-token ends where white space begins.

    Files that drop white space do by their pattern; byte-level files without normalizer do by the library's own
    pattern; sentencepiece models do as they put a word's mark in front and no piece holds one further in.
    """
    if not path.endswith(".json"):
        lib = library(path)
        return not any("\u2581" in lib.piece.id_to_piece(n).lstrip("\u2581") for n in range(lib.piece.get_piece_size()))
    spec = specification(path)
    before = spec.get("pre_tokenizer") or {}
    level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not spec.get("normalizer")
    special = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or set(t["content"]) & set(SPACE) for t in spec.get("added_tokens", []))
    return (level and not special) or drops_space(path)


class Library:
    """The tokenizer library for a file: ids, and ids with character offsets."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            self.piece = None
        else:
            import sentencepiece

            self.piece = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, text: str) -> list[int]:
        if self.piece is not None:
            return self.piece.encode(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and the start offset of each, in characters."""
        if self.piece is not None:
            found = self.piece.encode(text, return_type="proto").pieces
            head = (np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80  # the library counts bytes
            chars = np.concatenate([np.cumsum(head) - 1, [len(text)]])
            return np.array([p.id for p in found], dtype=np.int64), chars[np.array([p.begin for p in found], dtype=np.int64)]
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(found.ids, dtype=np.int64), np.array([a for a, _ in found.offsets], dtype=np.int64)


@lru_cache(maxsize=4)
def library(path: str) -> Library:
    return Library(path)


@lru_cache(maxsize=4)
def stable(path: str) -> bool:
    return proven_boundaries(path)


class SpaceMemo:
    """Ids of texts, for tokenizers that drop white space.

    Texts are cut at white space and made distinct by Arrow; a bounded map gives the ids of each distinct chunk. Where
    the file allows it (`splits_words`), words and punctuation are parted before and ASCII letters lower-cased, so that
    there are fewer chunks; words of plain letters need no normaliser.
    """

    def __init__(self, path: str, entries: int = MEMO_ENTRIES):
        self.library, self.chunks = library(path), Memo(entries)
        self.split, self.lower = splits_words(path), lower_cases(path)
        self.plain = re.compile(f"[{plain_letters()}]+")
        self.special = [t["content"].lower().encode() for t in specification(path).get("added_tokens", [])]
        self.bare, self.ends = self.bare_model() if self.split else (None, None)
        sentinel = self.library.ids(SENTINEL)
        self.sentinel = sentinel[0] if len(sentinel) == 1 else None

    def bare_model(self):
        """The library's model without normaliser and pattern, and which ids end a word; nothing where the model does
        not mark word ends."""
        from tokenizers import Tokenizer, pre_tokenizers

        whole = self.library.tokenizer
        suffix = getattr(whole.model, "end_of_word_suffix", None)
        if not suffix:
            return None, None
        bare = Tokenizer(whole.model)
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = whole.get_vocab(with_added_tokens=True)
        ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, n in vocabulary.items():
            ends[n] = token.endswith(suffix)
        return bare, ends

    def encode_all(self, found: list[str]) -> list[bytes]:
        """Ids of each string as little-endian unsigned 32-bit integers by the library, many in one call."""
        out: list = [None] * len(found)
        if self.bare is not None:
            plain = self.plain.fullmatch
            easy = [i for i, w in enumerate(found) if plain(w)]
            for at in range(0, len(easy), 512):
                part = easy[at : at + 512]
                words = " ".join([found[i] for i in part])
                ids = np.array(self.bare.encode(words.lower() if self.lower else words, add_special_tokens=False).ids, dtype="<u4")
                stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
                if len(stops) == len(part):
                    raw, start = ids.tobytes(), 0
                    for i, stop in zip(part, stops):
                        out[i] = raw[4 * start : 4 * stop]
                        start = stop
        rest = [i for i, value in enumerate(out) if value is None]
        for i, value in zip(rest, self.encode_marked([found[i] for i in rest])):
            out[i] = value
        return out

    def encode_marked(self, texts: list[str]) -> list[bytes]:
        """Ids of any strings by the library, many in one call, told apart by a sentinel."""
        plain = [i for i, t in enumerate(texts) if SENTINEL not in t] if self.sentinel is not None else []
        out: list = [None] * len(texts)
        for at in range(0, len(plain), 256):
            part = plain[at : at + 256]
            ids = np.array(self.library.ids(f" {SENTINEL} ".join(texts[i] for i in part)), dtype="<u4")
            cut = np.flatnonzero(ids == self.sentinel)
            if len(cut) == len(part) - 1:
                edges = [0, *(cut + 1).tolist()], [*cut.tolist(), len(ids)]
                for i, a, b in zip(part, *edges):
                    out[i] = ids[a:b].tobytes()
        for i, value in enumerate(out):
            if value is None:
                out[i] = np.array(self.library.ids(texts[i]), dtype="<u4").tobytes()
        return out

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        """The map from chunks to ids, with all of these in it."""
        if missing := self.chunks.missing(chunks):
            self.chunks.young.update(zip(missing, self.encode_all(missing)))
        return self.chunks.young

    def parted(self, texts: pa.Array) -> pa.Array:
        """The texts with a space between a word and ASCII punctuation beside it, and ASCII letters lower-cased.

        Both sides of such a place are encoded apart anyway: a run of letters and a run of punctuation are pre-tokens of
        their own, but for an apostrophe in front of a letter. Texts that hold a special string stay as they are.
        """
        texts = pa.concat_arrays([texts.cast(pa.string())])
        if not len(texts) or texts.buffers()[2] is None:
            return texts
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        kind = BYTE_KINDS[raw]
        low = np.where(kind == 3, raw | 32, raw) if self.lower else raw
        if len(raw) < 2 or any(s in low.tobytes() for s in self.special):
            return texts
        word = kind >= 2
        word[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)  # the letters from U+00C0 to U+00FF
        mark = kind == 1
        cut = np.zeros(len(raw) + 1, dtype=np.int64)
        cut[1:-1] = (word[:-1] & mark[1:]) | (mark[:-1] & (raw[:-1] != 0x27) & (kind[1:] >= 2))
        before = np.cumsum(cut)
        out = np.full(len(raw) + int(before[-1]), 32, dtype=np.uint8)
        out[np.arange(len(raw)) + before[:-1]] = low
        return pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends + before[ends]).astype(np.int32).tobytes()), pa.py_buffer(out.tobytes()))

    def distinct(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Of texts without nulls: where each one's chunks end, the number of each chunk, and the ids of each number."""
        split = pc.ascii_split_whitespace(self.parted(texts) if self.split else texts)
        ends = split.offsets.to_numpy()[1:].astype(np.int64) - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.learn(names)
        return ends, coded.indices.to_numpy(zero_copy_only=False), list(map(known.__getitem__, names))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        ends, which, found = self.distinct(texts)
        total = np.concatenate([[0], np.cumsum(np.array([len(x) // 4 for x in found], dtype=np.int64)[which])])
        return total[ends] - total[np.concatenate([[0], ends[:-1]])]

    def ids_many(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        ends, which, found = self.distinct(texts)
        every, sizes = np.frombuffer(b"".join(found), dtype="<u4"), np.array([len(x) // 4 for x in found], dtype=np.int64)
        starts, own = np.cumsum(sizes) - sizes, sizes[which]
        total = np.cumsum(own)
        ids = every[np.repeat(starts[which] - (total - own), own) + np.arange(total[-1] if len(total) else 0)]
        return np.split(ids, np.concatenate([[0], total])[ends])[:-1]


@lru_cache(maxsize=2)
def space_memo(path: str) -> SpaceMemo:
    """One memo for each worker process, kept over tasks."""
    return SpaceMemo(path)


def splice_point(text: str, lo: int, hi: int, left: tuple, right: tuple, single: bool = False) -> int:
    """A stable boundary in (lo, hi) where both encodings start a token and agree on the one after it, or -1.

    single: only at one space between two other characters, for tokenizers that fold white space.

    left and right: ids and absolute offsets. The middle of the overlap is tried first, away from both cut ends.
    """
    found = [m.start() for m in STABLE.finditer(text, lo + 1, hi)]
    middle = (lo + hi) // 2
    starts = [{} for _ in range(2)]
    for ids, at, start in ((*left, starts[0]), (*right, starts[1])):
        a, b = np.searchsorted(at, [lo, hi])
        for k in range(a, b):
            start.setdefault(int(at[k]), int(ids[k]))
    for p in sorted(found, key=lambda p: abs(p - middle)):
        if single and not (text[p] == " " and text[p + 1 : p + 2].strip()):
            continue
        stop = p
        while stop < hi and text[stop] in SPACE:
            stop += 1
        for q in (p, *range(p + 1, stop + 1)):  # the token after the boundary may begin with or after the white space
            if q in starts[0] and starts[0][q] == starts[1].get(q, -1):
                return q
    return -1


def spliced_ids(path: str, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
    """Yields arrays of the ids of a whole text, chunk by chunk; their concatenation equals one encoding."""
    lib = library(path)
    size = len(text)
    if size <= chunk:
        yield lib.spans(text)[0]
        return
    if not stable(path):
        raise ValueError("the tokenizer's file does not prove that pre-tokens end at white space")
    start, end = 0, chunk
    ids, at = lib.spans(text[:end])
    first = 0  # tokens of the current chunk that start before this offset are already out
    while end < size:
        width, grow = overlap, chunk
        while True:
            begin, stop = max(start, end - width), min(size, end - width + grow if end - width > start else end + grow)
            new_ids, new_at = lib.spans(text[begin:stop])
            new_at = new_at + begin
            point = splice_point(text, max(begin, first), end, (ids, at), (new_ids, new_at), lib.piece is not None) if begin > start else -1
            if point >= 0:
                a, b = np.searchsorted(at, [first, point])
                yield ids[a:b]
                first, ids, at, start, end = point, new_ids, new_at, begin, stop
                break
            if begin <= max(start, first):  # no boundary anywhere: one longer chunk from the same start
                stop = min(size, end + grow)
                ids, at = lib.spans(text[start:stop])
                at, end = at + start, stop
                break
            width, grow = width * 4, max(grow, width * 8)
    yield ids[np.searchsorted(at, first) :]


def count_tokens(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """The columns of keep, and n_bytes and n_tokens of every whole text."""
    small_batches(df.sparkSession)
    source = df.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = source.select(*keep, F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema

    def make():
        memo = space_memo(path) if drops_space(path) else None

        def counts(part: pa.Array) -> list[int]:
            sizes = pc.utf8_length(part).to_numpy(zero_copy_only=False)
            found = memo.counts(pc.if_else(pa.array(sizes <= chunk), part, "")).tolist() if memo is not None else [0] * len(part)
            for k in np.flatnonzero(sizes > (chunk if memo is not None else 0)).tolist():
                found[k] = sum(len(ids) for ids in spliced_ids(path, part[k].as_py(), chunk, overlap))
            return found

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(batch.schema.get_field_index("_text"))
            kept = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            found = [n for part in string_parts(texts) for n in counts(part)]
            return pa.RecordBatch.from_arrays([*kept, pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), pa.array(found, pa.int64())], names=[*keep, "n_bytes", "n_tokens"])

        return work

    return source.mapInArrow(per_batch(make), schema)
