"""Language identification: known words first, then ever shorter character n-grams.

A word seen in training is scored by its log frequency in each language. An unseen word falls back to
its character n-grams, longest order first: the first order of which any n-gram was seen decides, by
the mean log frequency of those n-grams. A text's language is the one with the largest sum.

The model is fitted on a bounded sample, the same number of texts for every language, chosen by hash over
all of the training fold. Their words are counted where they lie; the driver gets the counts of the most
frequent words only.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, small_batches

TRAIN_TEXTS = 1_000  # the fit reads at most so many different texts of each language, of any length, smallest hash first
RANKS = 1 << 30
WORDS_PER_LANGUAGE = 50_000
GRAMS_PER_ORDER = 20_000
MAX_ORDER = 5
CACHE_WORDS = 300_000
UNKNOWN = "und"

_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, lower case. The pattern also takes numbers that are not digits; they part words."""
    found = _LETTERS.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [w for f in found for w in "".join(c if c.isalpha() else " " for c in f).split()]


def grams_of(word: str, n: int) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Model:
    """words: word -> log frequencies, one for each language; grams[n]: n-gram -> the same."""

    def __init__(self, langs: list[str], words: dict[str, tuple], grams: dict[int, dict[str, tuple]]):
        self.langs, self.words, self.grams = langs, words, grams
        self._forget()

    def __getstate__(self):
        return self.langs, self.words, self.grams

    def __setstate__(self, state):
        self.__init__(*state)

    def _forget(self) -> None:
        self._at: dict[str, int] = {}
        self._rows = np.zeros((1024, max(1, len(self.langs))))

    def word(self, word: str) -> tuple:
        """Log frequencies of one word, by backoff where it was not seen."""
        if (known := self.words.get(word)) is not None:
            return known
        for n in range(MAX_ORDER, 0, -1):
            seen = [g for x in grams_of(word, n) if (g := self.grams.get(n, {}).get(x)) is not None]
            if seen:
                return tuple(sum(x) / len(seen) for x in zip(*seen, strict=True))
        return (0.0,) * len(self.langs)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, posterior between 0 and 1); und and 0 for null, no letter, or an empty model."""
        if not text or not self.langs:
            return UNKNOWN, 0.0
        words = words_of(text)
        if not words:
            return UNKNOWN, 0.0
        if len(self._at) > CACHE_WORDS:
            self._forget()
        at = self._at
        for w in words:
            if w not in at:
                k = len(at)
                if k >= len(self._rows):
                    self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
                self._rows[k] = self.word(w)
                at[w] = k
        total = self._rows[np.fromiter(map(at.__getitem__, words), np.int64, len(words))].sum(axis=0)
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())


def train(rows: list[tuple[str, str]]) -> Model:
    """Fit on (lang, text) rows."""
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, text in rows:
        counts[lang].update(words_of(text))
    return build(counts)


def build(counts: dict[str, Counter]) -> Model:
    """A model of counted words by language. Languages are in alphabetical order, so ties have one outcome."""
    langs = sorted(k for k, v in counts.items() if v)

    def logs(table: dict[str, Counter], most: int) -> dict[str, tuple]:
        total = {k: sum(table[k].values()) for k in langs}
        kept = sorted({x for k in langs for x, _ in sorted(table[k].items(), key=lambda p: (-p[1], p[0]))[:most]})
        size = len(kept) + 1
        return {x: tuple(math.log((table[k][x] + 0.5) / (total[k] + 0.5 * size)) for k in langs) for x in kept}

    grams = {}
    for n in range(1, MAX_ORDER + 1):
        table = {}
        for k in langs:
            c: Counter = Counter()
            for w, times in counts[k].items():
                for g in grams_of(w, n):
                    c[g] += times
            table[k] = c
        grams[n] = logs(table, GRAMS_PER_ORDER)
    return Model(langs, logs(counts, WORDS_PER_LANGUAGE), grams)


def sample(docs: DataFrame, train_texts: int = TRAIN_TEXTS) -> DataFrame:
    """(lang, text): at most `train_texts` different texts of each language outside the held-out fold.

    Texts are ranked by hash of doc_id and text without moving them. How many different rows a language
    has tells up to which hash some twice the bound lie, so only so many of a hot language ever meet to be
    cut at it. Copies of a row count once.
    """
    usable = docs.where("text is not null and lang is not null and doc_id is not null").where(~held_out())
    usable = usable.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(RANKS)), "h"))
    rank = F.pmod("h", F.lit(RANKS))
    least = usable.groupBy("lang").agg((F.lit(2 * train_texts * RANKS) / F.approx_count_distinct("h")).alias("below"))
    few = usable.select("lang", "h").join(F.broadcast(least), "lang").where(rank <= F.col("below")).select("lang", "h")
    picked = few.distinct().withColumn("nth", nth).where(F.col("nth") <= train_texts).select("lang", "h")
    return usable.join(F.broadcast(picked), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text")


def _counted(batches):
    for b in batches:
        counts: Counter = Counter()
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            counts.update((lang, w) for w in words_of(text))
        rows = list(counts.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["lang", "word", "n"])


def fit(docs: DataFrame, train_texts: int = TRAIN_TEXTS) -> Model:
    """Fit on the sample of docs(doc_id, text, lang). The driver gets at most WORDS_PER_LANGUAGE counts for each language."""
    counted = sample(docs, train_texts).mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, word, n in counted.withColumn("nth", nth).where(F.col("nth") <= WORDS_PER_LANGUAGE).select("lang", "word", "n").collect():
        counts[lang][word] = n
    return build(counts)


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _scorer(shared):
    def run(batches):
        model = shared.value
        for b in batches:
            found = [model.predict(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            out = pa.table({"lang_pred": pa.array([x[0] for x in found], pa.string()), "score": pa.array([x[1] for x in found], pa.float64())})
            keep = [n for n in b.schema.names if n != "text"]
            for part in pa.table([b.column(b.schema.get_field_index(n)) for n in keep], names=keep).append_column("lang_pred", out["lang_pred"]).append_column("score", out["score"]).to_batches():
                yield part

    return run


def language_ids(docs: DataFrame, model: Model | None = None, train_texts: int = TRAIN_TEXTS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs(doc_id, text, lang).

    Null text, or text without a letter: `und`, score 0. With no usable training row every text is
    `und`. A null doc_id counts as the empty id. Texts are read whole, however long. Equal scores go to the
    first language by name. Repeated rows each come back; an empty table gives an empty result. Only
    doc_id, text and lang are read; lang only for the fit.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model or fit(docs, train_texts))
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scorer(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, least: float = 0.5, train_texts: int = TRAIN_TEXTS) -> DataFrame:
    """Rows of docs with a recognised language: not `und`, and posterior of at least `least`.

    Null texts and texts without a letter go. Columns stay as they are, whatever they are called. An empty
    table gives an empty result. If texts are there but none can train a model (no lang, or no doc_id),
    nothing can be recognised or rejected by it: that is an error, not an empty corpus.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = fit(docs, train_texts)
    if not model.langs and not docs.where(F.col("text").rlike(r"\p{L}")).isEmpty():
        raise ValueError("no text with a language and a doc_id to learn from; nothing was rejected")
    shared = spark.sparkContext.broadcast(model)
    at = free_name(docs, "_text")
    rows = docs.withColumn(at, F.col("text").cast("string"))

    def run(batches):
        model = shared.value
        for b in batches:
            found = [model.predict(t) for t in b.column(b.num_columns - 1).to_pylist()]
            known = pa.RecordBatch.from_arrays(b.columns[:-1], b.schema.names[:-1])
            yield known.filter(pa.array([x[0] != UNKNOWN and x[1] >= least for x in found], pa.bool_()))

    return rows.mapInArrow(run, docs.schema)
