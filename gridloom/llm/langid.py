"""Language identification by segmentation-marginalised unigrams.

Over a fixed public vocabulary of pieces, every language has probabilities of the pieces. The probability of a word is
the sum over all its segmentations into pieces, by a forward recursion; that of a text is the product over its words.
Probabilities are fitted by expectation maximisation over the segmentations (forward and backward recursions) of the
words of a bounded, documented sample of the labelled rows: about `per_language` documents of each language, by hash of
the key. Characters outside the vocabulary have one small probability that is the same for every language.

Words are scored whole, however long; the fit cuts those of more than `MAX_WORD` letters into parts.

Defined results: null texts and texts without a letter (digits and other numerals are none) get `und` and score 0, as does every text if nothing is
labelled; ties go to the language that sorts first; rows with a null key are never learnt from and are not held out;
repeated rows give repeated rows, and are learnt from each; very long texts are scored whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import Memo, parts_of, per_batch, small_batches

#: Documents of each language that the fit takes, about; most words of a language that it takes.
PER_LANGUAGE, MAX_WORDS = 600, 30_000
ROUNDS, SMOOTHING, UNKNOWN = 3, 0.05, 1e-7
#: Longest piece of the vocabulary; words of more letters than this are scored by a recursion that keeps its scale.
MAX_PIECE, MAX_WORD = 16, 40
RUNS, LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
START = "▁"
MEMO_ENTRIES = 450_000


@lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, int]:
    """Numbers of the vocabulary's pieces that hold letters only, lower-cased; 0 stands for none."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    good = sorted(p for p in found if p == START or p.removeprefix(START).isalpha() and len(p) <= MAX_PIECE)
    return {p: n for n, p in enumerate(good, 1)}


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased, each whole and after the mark of a word's start."""
    out = []
    for w in RUNS.findall(text.lower()):
        out += [START + w] if w.isalpha() else [START + x for x in LETTERS.findall(w)]
    return out


def short_parts(word: str) -> list[str]:
    """A word of the fit in parts of a bounded length."""
    return [word] if len(word) <= MAX_WORD else [word[at : at + MAX_WORD] for at in range(0, len(word), MAX_WORD)]


def lattice(words: list[str], vocabulary: dict[str, int]) -> np.ndarray:
    """Piece numbers (word, end, length): the piece of that length that ends there, 0 for none."""
    width = max(map(len, words))
    out = np.zeros((len(words), width + 1, MAX_PIECE + 1), dtype=np.int32)
    get = vocabulary.get
    for n, word in enumerate(words):
        own = out[n]
        for end in range(1, len(word) + 1):
            row = own[end]
            for size in range(1, min(end, MAX_PIECE) + 1):
                if p := get(word[end - size : end]):
                    row[size] = p
    return out


def forward(grid: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of every prefix (word, end, language); chance: (piece, language), row 0 zero."""
    n, ends, _ = grid.shape
    alpha = np.zeros((n, ends, chance.shape[1]))
    alpha[:, 0] = 1.0
    for end in range(1, ends):
        total = UNKNOWN * alpha[:, end - 1]
        for size in range(1, min(end, MAX_PIECE) + 1):
            total = total + alpha[:, end - size] * chance[grid[:, end, size]]
        alpha[:, end] = total
    return alpha


def long_logs(words: list[str], vocabulary: dict[str, int], chance: np.ndarray) -> np.ndarray:
    """Log probabilities (word, language) of words of any length: the forward sums of the last ends only, rescaled as they fall."""
    get, out = vocabulary.get, np.zeros((len(words), chance.shape[1]))
    recent, logs = [np.ones((len(words), chance.shape[1]))], np.zeros((len(words), 1))
    sizes = np.array([len(w) for w in words])
    for end in range(1, sizes.max() + 1):
        total = UNKNOWN * recent[-1]
        for size in range(1, min(end, MAX_PIECE) + 1):
            total = total + recent[-size] * chance[[get(w[end - size : end], 0) if end <= len(w) else 0 for w in words]]
        recent = [*recent[-MAX_PIECE + 1 :], total]
        done = sizes == end
        out[done] = np.log(np.maximum(total[done], 1e-300)) + logs[done]
        if end % 8 == 0:
            top = np.where(sizes > end, total.max(axis=1), 1.0)[:, None]
            recent, logs = [r / top for r in recent], logs + np.log(top)
    return out


def expected(grid: np.ndarray, lengths: np.ndarray, weight: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Expected counts of each piece over the segmentations of weighted words, for one language (piece,)."""
    alpha = forward(grid, chance[:, None])[:, :, 0]
    n, ends, _ = grid.shape
    beta = np.zeros((n, ends))
    beta[np.arange(n), lengths] = 1.0
    for end in range(ends - 2, -1, -1):
        beta[:, end] += UNKNOWN * beta[:, end + 1]
        for size in range(1, min(MAX_PIECE, ends - 1 - end) + 1):
            beta[:, end] += beta[:, end + size] * chance[grid[:, end + size, size]]
    scale = weight / alpha[np.arange(n), lengths]
    out = np.zeros(len(chance))
    for end in range(1, ends):
        for size in range(1, min(end, MAX_PIECE) + 1):
            p = grid[:, end, size]
            out += np.bincount(p, weights=scale * alpha[:, end - size] * chance[p] * beta[:, end], minlength=len(chance))
    out[0] = 0.0
    return out


def fit(counts: dict[str, dict[str, int]], vocabulary: dict[str, int], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the probability of each piece in each (piece, language)."""
    languages = sorted(counts)
    size = len(vocabulary) + 1
    table = np.zeros((size, len(languages)))
    for n, language in enumerate(languages):
        chance = np.full(size, 1.0 / size)
        chance[0] = 0.0
        by_length = sorted(counts[language].items(), key=lambda x: (len(x[0]), x[0]))
        blocks = []
        for at in range(0, len(by_length), 5000):
            part = by_length[at : at + 5000]
            words = [w for w, _ in part]
            blocks.append((lattice(words, vocabulary), np.array([len(w) for w in words]), np.array([c for _, c in part], dtype=float)))
        for _ in range(rounds):
            total = sum((expected(grid, lengths, weight, chance) for grid, lengths, weight in blocks), np.zeros(size))
            chance = (total + SMOOTHING) / (total[1:].sum() + SMOOTHING * (size - 1))
            chance[0] = 0.0
        table[:, n] = chance
    return languages, table


class Scorer:
    """Log probabilities of words in every language, kept in a bounded map."""

    def __init__(self, vocabulary: dict[str, int], table: np.ndarray, entries: int = MEMO_ENTRIES):
        self.vocabulary, self.table, self.memo = vocabulary, table, Memo(entries)

    def learn(self, words: list[str]) -> dict[str, np.ndarray]:
        missing = sorted(self.memo.missing(words), key=len)
        for at in range(0, len(missing), 4000):
            part = missing[at : at + 4000]
            alpha = forward(lattice(part, self.vocabulary), self.table)
            logs = np.log(np.maximum(alpha[np.arange(len(part)), [len(w) for w in part]], 1e-300))
            self.memo.young.update(zip(part, map(tuple, logs.tolist())))
        return self.memo.young

    def totals(self, texts: list[str]) -> list[np.ndarray | None]:
        """For each text its log probability in every language; None without a letter."""
        split = [words_of(t) for t in texts]
        known = self.learn([w for words in split for w in words if len(w) <= MAX_WORD])
        long = sorted({w for words in split for w in words if len(w) > MAX_WORD}, key=len)
        extra = {}
        for at in range(0, len(long), 256):
            extra |= dict(zip(long[at : at + 256], map(tuple, long_logs(long[at : at + 256], self.vocabulary, self.table).tolist())))
        return [np.array([known[w] if len(w) <= MAX_WORD else extra[w] for w in words]).sum(axis=0) if words else None for words in split]


#: The scorer of this worker process and the digest of its model; kept over tasks.
KEPT: dict[bytes, Scorer] = {}


def kept_scorer(path: str, table: np.ndarray) -> Scorer:
    digest = hashlib.sha1(table.tobytes()).digest()
    if digest not in KEPT:
        KEPT.clear()
        KEPT[digest] = Scorer(pieces(path), table)
    return KEPT[digest]


def sample_counts(labelled: DataFrame, per_language: int, max_words: int, key: str, text: str, lang: str) -> dict[str, dict[str, int]]:
    """Word counts of each language over a sample by hash of about so many documents a language; bounded by parameters."""
    totals = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not totals:
        return {}
    share = F.lit(0.0)
    for language, n in totals.items():
        share = F.when(F.col(lang) == language, F.lit(min(1.0, per_language / n))).otherwise(share)
    spread = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.where(spread < share).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches):
        for batch in batches:
            total: dict[tuple[str, str], int] = {}
            for language, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in (x for word in words_of(t or "") for x in short_parts(word)):
                    total[language, w] = total.get((language, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["lang", "word", "n"])

    words = chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    out: dict[str, dict[str, int]] = {}
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    ranked = words.withColumn("rank", rank).where(F.col("rank") <= max_words)  # at most so many of each language
    for r in ranked.collect():
        out.setdefault(r["lang"], {})[r["word"]] = r["n"]
    for language in totals:
        out.setdefault(language, {})
    return out


def predict(df: DataFrame, labelled: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> DataFrame:
    """The columns of keep, lang_pred and score (the posterior under equal priors) of every whole text."""
    spark = df.sparkSession
    small_batches(spark)
    vocabulary = pieces(path)
    languages, table = fit(sample_counts(labelled, per_language, MAX_WORDS, key, text, lang), vocabulary)
    shipped = spark.sparkContext.broadcast((languages, table))  # vocabulary times languages
    source = df.select(*keep, F.col(text).cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text")

    def make():
        names, chances = shipped.value
        scorer = kept_scorer(path, chances) if names else None

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(batch.schema.get_field_index("_text")).to_pylist()
            out = []
            for total in (x for part in parts_of(texts) for x in (scorer.totals([t or "" for t in part]) if scorer else [None] * len(part))):
                if total is None:
                    out.append(("und", 0.0))
                else:
                    best = int(total.argmax())
                    out.append((names[best], float(1.0 / np.exp(np.minimum(total - total[best], 0.0)).sum())))
            kept = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            return pa.RecordBatch.from_arrays([*kept, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=[*keep, "lang_pred", "score"])

        return work

    return source.mapInArrow(per_batch(make), f"{kinds}, lang_pred string, score double")
