"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Each line with a word is described by a few numbers. The chain scores labels by those numbers and by
neighbouring pairs of labels; Viterbi decoding finds the best sequence. The share of characters on
content lines decides whether a document stays. Weights are fitted by gradient ascent on the exact
likelihood (forward and backward sums).

Labels are of documents, and a chain that only sees whole documents of one label learns never to switch.
So the fit also reads spliced sequences: runs of lines from good and from bad documents in turn, each
with its own label. They teach the chain where content begins and ends, and that both stand together.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

TRAIN_TEXTS = 1_500  # the fit reads at most so many different labelled texts of each quality, of any length, smallest hash first
SEGMENT_LINES = 64  # a text is read as segments of so many lines
TRAIN_SEGMENTS = 4_000  # of which at most so many of each quality are kept, smallest hash first
RUN_LINES = 6  # mean length of a run in a spliced sequence
ROUNDS = 150
LEAST_SHARE = 0.5
SYMBOLS = "#*$%&|<>"

_SYMBOL = re.compile(r"[#*$%&|<>]")
FEATURES = 14


def line_features(lines: list[list[str]], texts: list[str]) -> np.ndarray:
    """One row of numbers for each line, given as its words and its text."""
    out = np.zeros((len(lines), FEATURES))
    seen: Counter = Counter()
    for k, (words, text) in enumerate(zip(lines, texts, strict=True)):
        n, size = len(words), max(1, len(text))
        letters = sum(map(str.isalpha, text)) or 1
        upper = sum(map(str.isupper, text))
        marks = len(_SYMBOL.findall(text))
        distinct = len(set(words)) / n
        runs = sum(map(str.__eq__, words, words[1:])) / n
        out[k] = (
            1.0, min(n, 40) / 40, n <= 3, min(1.0, 8 * marks / size), marks > n / 4, upper > 0.6 * letters, min(1.0, 4 * text.count("!") / n),
            1 - distinct, runs, text.count("|") > n / 4, letters < 0.6 * size, text.rstrip()[-1:] in ".?!\"", seen[text] > 0, min(1.0, sum(map(len, words)) / n / 20),
        )
        seen[text] += 1
    return out


class Chain:
    """Two labels, 0 boilerplate and 1 content: unary weights (features x 2) and pair scores (2 x 2)."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    @classmethod
    def neutral(cls) -> Chain:
        """Without training rows every line is content."""
        unary = np.zeros((FEATURES, 2))
        unary[0, 1] = 1
        return cls(unary, np.zeros((2, 2)))

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi: the best label of each line; equal scores prefer content."""
        score = x @ self.unary
        n = len(score)
        if not n:
            return np.zeros(0, np.int64)
        u, p = score.tolist(), self.pair.tolist()
        back = []
        a, b = u[0]
        for s0, s1 in u[1:]:
            f0, f1 = (b + p[1][0] >= a + p[0][0]), (b + p[1][1] >= a + p[0][1])
            back.append((f0, f1))
            a, b = s0 + (b + p[1][0] if f0 else a + p[0][0]), s1 + (b + p[1][1] if f1 else a + p[0][1])
        at = int(b >= a)
        out = [at]
        for f in reversed(back):
            at = int(f[at])
            out.append(at)
        return np.array(out[::-1], np.int64)


def spliced(good: list[np.ndarray], bad: list[np.ndarray], run_lines: int = RUN_LINES, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sequences of runs from a good and a bad segment in turn, with a label for each line; the same for the same segments."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(max(len(good), len(bad)) if good and bad else 0):
        pair = (bad[k % len(bad)], good[k % len(good)])
        at, turn, rows, labels = [0, 0], int(rng.integers(2)), [], []
        while at[0] < len(pair[0]) or at[1] < len(pair[1]):
            n = int(rng.geometric(1 / run_lines))
            part = pair[turn][at[turn] : at[turn] + n]
            at[turn] += n
            rows.append(part)
            labels.append(np.full(len(part), turn))
            turn = 1 - turn
        out.append((np.concatenate(rows), np.concatenate(labels)))
    return out


def fit_chain(documents: list[tuple[np.ndarray, int | np.ndarray]], rounds: int = ROUNDS, rate: float = 0.5, decay: float = 1e-3) -> Chain:
    """Maximum likelihood by gradient ascent; documents are (line features, one label for all lines or one for each).

    Documents of about equal length are run through the chain together, padded to the longest of their group.
    """
    documents = [(x, np.broadcast_to(y, len(x))) for x, y in documents if len(x)]
    if len({int(k) for _, y in documents for k in np.unique(y)}) < 2:
        return Chain.neutral()
    unary, pair = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    order = sorted(documents, key=lambda d: len(d[0]))
    groups = []
    for at in range(0, len(order), 256):
        part = order[at : at + 256]
        x = np.zeros((len(part), len(part[-1][0]), FEATURES))
        mask = np.zeros(x.shape[:2], bool)
        gold = np.zeros(mask.shape, np.int64)
        for i, (f, y) in enumerate(part):
            x[i, : len(f)], mask[i, : len(f)], gold[i, : len(f)] = f, True, y
        groups.append((x, mask, gold))
    total = sum(len(f) for f, _ in documents)
    for _ in range(rounds):
        gu, gp = np.zeros_like(unary), np.zeros_like(pair)
        for x, mask, y in groups:
            s = x @ unary
            n = s.shape[1]
            fwd, bwd = np.zeros_like(s), np.zeros_like(s)
            fwd[:, 0] = s[:, 0]
            for t in range(1, n):
                step = np.logaddexp(fwd[:, t - 1, :1] + pair[0], fwd[:, t - 1, 1:] + pair[1]) + s[:, t]
                fwd[:, t] = np.where(mask[:, t, None], step, fwd[:, t - 1])
            for t in range(n - 2, -1, -1):
                nxt = s[:, t + 1] + bwd[:, t + 1]
                step = np.logaddexp(pair[:, 0] + nxt[:, :1], pair[:, 1] + nxt[:, 1:])
                bwd[:, t] = np.where(mask[:, t + 1, None], step, 0)
            z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
            prob = np.exp(fwd + bwd - z[:, None, None]) * mask[..., None]
            gold = np.eye(2)[y] * mask[..., None]
            gu += np.einsum("dtf,dtk->fk", x, gold - prob)
            if n > 1:
                both = np.exp(np.clip(fwd[:, :-1, :, None] + pair + (s + bwd)[:, 1:, None, :] - z[:, None, None, None], -700, 0)) * mask[:, 1:, None, None]
                gp -= both.sum(axis=(0, 1))
                np.add.at(gp, (y[:, :-1], y[:, 1:]), mask[:, 1:])
        unary += rate * (8 * gu / total - decay * unary)
        pair += rate * (8 * gp / total - decay * pair)
    return Chain(unary, pair)


def lines_of(text: str) -> tuple[list[list[str]], list[str]]:
    """The lines with a word: their words and their texts."""
    words, texts = [], []
    for line in text.split("\n"):
        if w := ascii_words(line):
            words.append(w)
            texts.append(line)
    return words, texts


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_words(text: str) -> list[str]:
    """Words between ASCII blanks. str.split also parts at other blanks, so it serves only without them."""
    return text.split() if text.isascii() and not _OTHER.search(text) else _WORD.findall(text)


_OTHER = re.compile(r"[\x1c-\x1f]")


def base_counts(words: list[str], text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    n = len(words)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif _WORD.search(line):
            seen.add(line)
    repeat = 0
    if n > 3:
        threes = list(zip(words, words[1:], words[2:], strict=False))
        count = Counter(threes)
        if len(count) < len(threes):
            ends = 0
            for i, t in enumerate(threes):
                if count[t] > 1:
                    repeat += i + 3 - max(ends, i)
                    ends = i + 3
    return n, sum(map(len, words)), len(_SYMBOL.findall(text)), dup, repeat


def judge(text: str | None, chain: Chain, least_share: float = LEAST_SHARE):
    """The columns of quality_rules for one text."""
    text = text or ""
    base = base_counts(ascii_words(text), text)
    failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
    lines, texts = lines_of(text)
    share = 0.0
    if lines:
        label = chain.decode(line_features(lines, texts))
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        share = float(size[label == 1].sum() / size.sum())
    return *base, failed, not failed and share >= least_share, share


def _segments(batches):
    """Features of the lines of labelled texts, cut into segments; the text's hash and the segment's place give its rank."""
    for b in batches:
        rows = []
        for quality, h, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            x = line_features(*lines_of(text))
            rows += [(quality, h ^ (at * 0x9E3779B9), x[at : at + SEGMENT_LINES].tobytes()) for at in range(0, len(x), SEGMENT_LINES)]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["quality", "h", "x"])


def sample(docs: DataFrame, labels: DataFrame, train_texts: int = TRAIN_TEXTS) -> DataFrame:
    """(quality, h, text): at most `train_texts` different texts of each quality, of any length.

    A document with two labels counts as bad. Row numbers that are cut at a limit are cut in every map task first.
    """
    told = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    picked = [told.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_texts) for q in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    rows = docs.where("text is not null").join(F.broadcast(ids), "doc_id").select("quality", F.xxhash64("doc_id", "text").alias("h"), "text")
    nth = F.row_number().over(Window.partitionBy("quality").orderBy("h"))
    return rows.dropDuplicates(["quality", "h"]).withColumn("nth", nth).where(F.col("nth") <= train_texts).select("quality", "h", "text")


def fit(docs: DataFrame, labels: DataFrame, train_texts: int = TRAIN_TEXTS, train_segments: int = TRAIN_SEGMENTS) -> Chain:
    """Fit on a bounded sample of docs(doc_id, text) with labels(doc_id, quality).

    Texts stay on the executors; the driver gets at most 2 * train_segments segments of SEGMENT_LINES lines in numbers.
    """
    found = sample(docs, labels, train_texts).mapInArrow(_segments, "quality int, h long, x binary")
    nth = F.row_number().over(Window.partitionBy("quality").orderBy("h", "x"))
    rows = found.withColumn("nth", nth).where(F.col("nth") <= train_segments).orderBy("quality", "nth").select("quality", "x").collect()
    parts: list[list[np.ndarray]] = [[], []]
    for quality, x in rows:
        parts[quality].append(np.frombuffer(x).reshape(-1, FEATURES))
    return fit_chain([(x, q) for q in (0, 1) for x in parts[q]] + spliced(parts[1], parts[0]))


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def quality_rules(docs: DataFrame, labels: DataFrame, least_share: float = LEAST_SHARE, train_texts: int = TRAIN_TEXTS, chain: Chain | None = None) -> DataFrame:
    """SCHEMA's columns for every row of docs(doc_id, text).

    Null or empty text has no word and fails. Without labels of both kinds every line counts as content.
    Equal scores of a path prefer content. Texts are read whole, however long: a task holds one text and
    its lines at a time. The chain is fitted on a sample of `train_texts` texts of each quality, or given.
    Repeated rows each come back; an empty table gives an empty result. Other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(chain or fit(docs, labels, train_texts))

    def run(batches):
        chain = shared.value
        kinds = [pa.int64()] * 6 + [pa.bool_(), pa.bool_(), pa.float64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            rows = [judge(t, chain, least_share) for t in b.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds[1:], strict=True))], names)

    return docs.mapInArrow(run, SCHEMA)
