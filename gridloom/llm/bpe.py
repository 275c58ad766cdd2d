"""Byte-pair encoding and decoding by prefix-sharing trie traversal.

For byte-level BPE whose merges are numbered in rank order, the encoding of a word ends in the one token t for which
the encoding of the word without t ends in a token that may stand before t. So every prefix of a word has one last
token, and last tokens of longer prefixes follow from those of shorter ones. Distinct words are inserted in a trie
(their sorted order is its depth-first order); the traversal keeps the last tokens of the path from the root, so the
states of a shared prefix are computed once. The ids of a word are read backwards along its last tokens.

Defined results: null text is empty (no id, empty decoding); repeated rows give repeated rows; very long texts are encoded
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Memo, binary_lists, parts_of, per_batch, small_batches

#: Unicode White_Space, as the tokenizer's pattern means by \s.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters of the Latin and Cyrillic blocks (no character in these ranges is anything else).
LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0400-\u0481\u048a-\u052f"
#: Runs between which the pattern of byte-level BPE never joins characters: letters up to an ASCII character that is none
#: (so that words are found again whatever mark follows them), or everything up to white space.
RUNS = re.compile(rf" ?[{LETTERS}]++(?![^\x00-\x7f])| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Fixed value: the split pattern of byte-level BPE.
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
MEMO_ENTRIES = 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: bytes that print stand for themselves, others follow from 256 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printing]
    return {chr(b): b for b in printing} | {chr(256 + n): b for n, b in enumerate(others)}


class Vocabulary:
    """Tokens as bytes, the merge of each pair, the two halves of each token, and the special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        pre = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or spec.get("normalizer") or model.get("end_of_word_suffix"):
            raise ValueError("a byte-level BPE file without normalizer or prefix space is needed")
        self.id = {bytes(alphabet[c] for c in token): n for token, n in model["vocab"].items()}
        self.bytes = {n: token for token, n in self.id.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes.update({n: s.encode() for s, n in self.special.items()})
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        raw = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        for n, (a, b) in enumerate(raw):
            x, y = bytes(alphabet[c] for c in a), bytes(alphabet[c] for c in b)
            pair, whole = (self.id[x], self.id[y]), self.id[x + y]
            self.rank.setdefault(pair, n)
            self.halves.setdefault(whole, pair)
        #: The rank at which a token comes to be; single bytes come before all merges.
        self.born = {token: -1 for token in self.bytes} | {whole: self.rank[pair] for whole, pair in self.halves.items()}
        self.fits: dict[int, bool] = {}
        self.ending = ahocorasick.Automaton()
        for token, n in self.id.items():
            self.ending.add_word(token.decode("latin-1"), (n, len(token)))
        self.ending.make_automaton()

    def may_follow(self, left: int, right: int) -> bool:
        """True if encoding the bytes of both tokens gives these two tokens again.

        The tokens are unfolded in the reverse order of their merges. Whenever the pair that meets at the seam has a
        merge of its own that would have come before the merge just unfolded, the seam would have closed.
        """
        key = left << 20 | right
        if (known := self.fits.get(key)) is not None:
            return known
        rank, halves, born = self.rank, self.halves, self.born
        limit, a, b = 1 << 40, left, right
        while True:
            seam = rank.get((a, b))
            if seam is not None and seam < limit:
                fits = False
                break
            if born[a] > born[b]:
                limit, a = born[a], halves[a][1]
            elif born[b] >= 0:  # of equal merges the one further left comes first, and that is the seam's
                limit, b = born[b] + 1, halves[b][0]
            else:
                fits = True
                break
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[key] = fits
        return fits


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_words(words: list[bytes], voc: Vocabulary) -> dict[bytes, tuple[int, ...]]:
    """Ids of distinct words, by one depth-first traversal of their trie.

    At each node the automaton gives the tokens that end there, longest first; the first that may follow the last
    token of the prefix before it is the node's last token.
    """
    may_follow, fits, ending = voc.may_follow, voc.fits, voc.ending.iter
    last: list[tuple[int, int]] = [(-1, 0)]  # of each prefix on the path: its last token and that token's length
    before, out = b"", {}
    for word in sorted(words):
        done, most = 0, min(len(before), len(word))
        while done < most and before[done] == word[done]:
            done += 1
        del last[done + 1 :]
        for at, state in ending(word.decode("latin-1")):
            if at < done:
                continue
            t, size = state
            if size <= at:
                left = last[at + 1 - size][0]
                ok = fits.get(left << 20 | t)
                if not (ok or ok is None and may_follow(left, t)):
                    continue
            last.append(state)
            done = at + 1
        ids, at = [], len(word)
        while at:
            t, size = last[at]
            ids.append(t)
            at -= size
        out[word] = tuple(reversed(ids))
        before = word
    return out


class Codec:
    """Encodes texts; keeps bounded maps from runs of text and from words to their ids."""

    def __init__(self, path: str, entries: int = MEMO_ENTRIES):
        self.voc = vocabulary(path)
        self.runs, self.words = Memo(entries), Memo(entries)
        specials = sorted(self.voc.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None

    def learn(self, runs: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """The map from runs to (the ids as decimals each with a comma, the decoded bytes)."""
        missing = self.runs.missing(runs)
        if missing:
            # nothing but letters behind a space is one word of the pattern
            split = {run: [run.encode()] if run.removeprefix(" ").isalpha() else [w.encode() for w in PATTERN.findall(run)] for run in missing}
            new = self.words.missing({w for parts in split.values() for w in parts})
            words, made = self.words.young, self.voc.bytes
            for word, ids in encode_words(new, self.voc).items():
                decoded = b"".join([made[t] for t in ids])
                words[word] = b"".join([b"%d," % t for t in ids]), word if decoded == word else decoded
            young = self.runs.young
            for run, parts in split.items():
                if len(parts) == 1:
                    young[run] = words[parts[0]]
                else:
                    found = [words[w] for w in parts]
                    young[run] = b"".join([x[0] for x in found]), b"".join([x[1] for x in found])
        return self.runs.young

    def encode_many(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """For each text: how many ids, the ids as decimals joined by commas, and the decoded bytes."""
        split = [[part if part in self.voc.special else RUNS.findall(part) for part in (self.special.split(t) if any(x in t for x in self.voc.special) else (t,)) if part] for t in texts]
        known = self.learn([run for parts in split for part in parts if isinstance(part, list) for run in part])
        out = []
        for parts in split:
            found = []
            for part in parts:
                if isinstance(part, str):
                    found.append((b"%d," % self.voc.special[part], part.encode()))
                else:
                    found.extend(map(known.__getitem__, part))
            ids, decoded = map(b"".join, zip(*found)) if found else (b"", b"")
            out.append((ids.count(b","), ids[:-1], decoded))
        return out

    def encode(self, text: str) -> tuple[int, bytes, bytes]:
        return self.encode_many([text])[0]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each worker process, kept over tasks."""
    return Codec(path)


def decode_ids(ids: list[int], path: str) -> str:
    """The text of ids; bytes that are no UTF-8 become replacement characters."""
    made = vocabulary(path).bytes
    return b"".join(made[t] for t in ids if t in made).decode("utf-8", "replace")


def encode_decode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, n_tokens, ids (decimals joined by commas) and decoded (UTF-8) of every whole text."""
    small_batches(df.sparkSession)
    source = df.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = source.select(*keep, F.lit(0).cast("long").alias("n_tokens"), F.lit(b"").alias("ids"), F.lit(b"").alias("decoded")).schema

    def make():
        own = codec(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [x for part in parts_of(binary_lists(batch, "_text")) for x in own.encode_many([t.decode("utf-8", "replace") for t in part])]
            kept = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            return pa.RecordBatch.from_arrays([*kept, pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary()), pa.array([x[2].decode("utf-8", "replace").encode() for x in found], pa.binary())], names=[*keep, "n_tokens", "ids", "decoded"])

        return work

    return source.mapInArrow(per_batch(make), schema)
