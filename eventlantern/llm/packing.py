"""Mixture-controlled packing: deficit round-robin over one queue for each source.

Every source is a queue of tokens: its documents one after the other. A window of `length` tokens takes
from each queue its target share. What a queue is owed beyond whole tokens is its deficit; it carries
over to the next window, and the queue with the most urgent next token is served first. Targets are
proportions given by source. A queue that runs dry leaves its place to the others, in proportion to
their targets. Without targets a source's target is its share of all tokens, which lets every queue last
to the final window. Either way only the final window is not full.

Serving by urgency has a closed form: token x of a queue with weight w is due at (x + 1/2) / w, and the
first `length * s` tokens in order of due time (ties: by queue) lie before window s. So a task finds
the state at any window on its own from the queues' sizes and weights, and partitions carry deficits
over without a sequential pass. Tokens are made once, written as two-byte ids, and cut where they lie:
no shuffle.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, remove, scratch, small_batches

LENGTH = 4096
END_ID = 2
CACHE_PIECES = 1_000_000
FEW_QUEUES = 1024  # up to this, plain loops and a literal map; beyond, arrays and a join, with the same result
STATE_BYTES = 256 << 20
SHARE_UNITS = 10**9  # targets are read to so many parts of the whole
BROADCAST_ROWS = 200_000

# The normalisation and splitting of the tokenizer file, as its JSON states them.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")


# Latin-1 letters, numbers and white space in lower case, for splitting by the faster of two engines.
_LETTER, _NUMBER, _BLANK = "a-z\xdf-\xf6\xf8-\xff\xaa\xb5\xba", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t-\\r\\x20\x85\xa0"
_LATIN = re.compile(f"[{_LETTER}]+|[{_NUMBER}]|[^{_BLANK}{_LETTER}{_NUMBER}]+").findall


_PLAIN = re.sub(rf"[^{_LETTER}0-9]", "", "".join(map(chr, range(256)))).encode("latin-1") + b" \t\n\r.,"


def spaced(text: str) -> str | None:
    """The lower-case text with full stops and commas apart, if those are its only marks and never touch; else None.

    Every chunk between blanks is then a run of letters and digits or one mark, whatever stands next to it.
    """
    low = text.lower()
    try:
        if low.encode("latin-1").translate(None, _PLAIN):
            return None
    except UnicodeEncodeError:
        return None
    if ".." in low or ",," in low or ".," in low or ",." in low:
        return None
    return low.replace(".", " . ").replace(",", " , ")


class Encoder:
    """Ids of whole texts as little-endian uint16 bytes; a piece between splits is encoded once.

    The tokenizer splits a normalised text into pieces that are encoded independently, so the ids of a
    text are the ids of its pieces in order. Texts with a special token's string, and tokenizers that
    split by another rule, are encoded whole.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [x for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        self.by_piece = steps == ["NFC", "Replace", "Lowercase"] and bool(spec["model"].get("end_of_word_suffix")) and [x["pattern"] for x in splits] == [{"Regex": SPLIT}]
        if self.whole.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids of more than two bytes")
        if self.by_piece:  # the same merges for pieces that are already normal and apart
            blank = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
            level = [x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] != "Split"]
            self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [blank, *level]}}))
            suffix = spec["model"]["end_of_word_suffix"]
            self.ends = np.zeros(1 << 16, bool)
            self.ends[[i for w, i in spec["model"]["vocab"].items() if w.endswith(suffix)]] = True
        self.find = regex.compile(SPLIT).findall
        self.known: dict[str, bytes] = {}

    def one(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Plain texts are cut and counted off by Arrow, each distinct chunk looked up once."""
        if not self.by_piece:
            return [self.one(t) for t in texts]
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        out: list[bytes | None] = [None] * len(texts)
        plain, at = [], []
        for k, t in enumerate(texts):
            if (chunks := spaced(t)) is not None:
                plain.append(chunks)
                at.append(k)
            elif any(s in t for s in SPECIAL):
                out[k] = self.one(t)
            else:
                row = self.split(t)
                self.learn([w for w in set(row) if w not in self.known])
                out[k] = b"".join(map(self.known.__getitem__, row))
        if plain:
            lists = pc.ascii_split_whitespace(pa.array(plain, pa.large_string()))
            coded = lists.values.dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            self.learn([w for w in distinct if w not in self.known])
            ids = [self.known[w] for w in distinct]
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
            begin, data = np.cumsum(size) - size, np.frombuffer(b"".join(ids), np.uint16)
            chunk = coded.indices.to_numpy()
            n = size[chunk]
            ends = np.cumsum(n)
            every = data[np.repeat(begin[chunk] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
            cut = 2 * np.r_[0, ends][lists.offsets.to_numpy()]
            for k, a, b in zip(at, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                out[k] = every[a:b]
        return out

    def learn(self, new: list[str]) -> None:
        """Make the ids of chunks known: of letters alone as one piece, of others by their pieces."""
        mixed = {c: self.find(c) for c in new if not c.isalpha()}
        pieces = list({w for ws in mixed.values() for w in ws if w not in self.known} | {c for c in new if c not in mixed})
        for at in range(0, len(pieces), 2048):
            part = pieces[at : at + 2048]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint16)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                raw, begin = ids.tobytes(), 0
                for w, end in zip(part, (2 * ends).tolist(), strict=True):
                    self.known[w] = raw[begin:end]
                    begin = end
            else:
                self.known.update((w, self.one(w)) for w in part)
        self.known.update({c: b"".join(map(self.known.__getitem__, ws)) for c, ws in mixed.items()})

    def split(self, text: str) -> list[str]:
        """The pieces. Latin-1 texts are their own normal form; an apostrophe can begin a longer piece."""
        try:
            if "'" not in text:
                text.encode("latin-1")
                return _LATIN(text.lower())
        except UnicodeEncodeError:
            pass
        low = unicodedata.normalize("NFC", text)
        low = "".join(c.lower() for c in low) if "\u03a3" in low or "\u0130" in low else low.lower()
        return self.find(low)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, so that pieces stay known from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _tokens(path: str):
    def run(batches):
        from pyspark import TaskContext

        encode = encoder(path)
        part = TaskContext.get().partitionId()
        filled: dict[str, int] = {}
        row = 0
        end = np.array([END_ID], np.uint16).tobytes()
        for b in batches:
            ids, texts, queue = b.column(0), [t or "" for t in b.column(1).to_pylist()], b.column(2).to_pylist()
            out = [x + end for x in encode.batch(texts)]
            counts = [len(x) // 2 for x in out]
            starts = []
            for q, n in zip(queue, counts, strict=True):
                starts.append(filled.get(q, 0))
                filled[q] = starts[-1] + n
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [ids, b.column(2), pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(out, pa.binary())],
                ["doc_id", "queue", "part", "row", "start", "n", "ids"],
            )
            row += n

    return run


def time_of(sizes, weights, taken: int) -> tuple[int, int]:
    """The due time (a fraction) by which about `taken` tokens are due: queues that are dry by then count whole."""
    left, active = taken, sum(map(int, weights))
    if sizes is weights:
        return left, active
    for k in sorted(range(len(sizes)), key=lambda k: int(sizes[k]) / int(weights[k])):
        if int(sizes[k]) * active > left * int(weights[k]):
            break
        left -= int(sizes[k])
        active -= int(weights[k])
    return (left, active) if active else (max(int(n) // int(w) + 1 for n, w in zip(sizes, weights, strict=True)), 1)


def window_state(sizes: list[int], taken: int, weights: list[int] | None = None) -> list[int]:
    """How many tokens of each queue are among the first `taken` in order of due time.

    Those due by the time at which about `taken` are due are a first guess; then the last due go or the
    next due come. Weights are positive whole numbers; without them a queue's weight is its size.
    """
    weights = sizes if weights is None else weights
    taken = min(taken, sum(sizes))
    if not sum(sizes):
        return [0] * len(sizes)
    at, of = time_of(sizes, weights, taken)
    got = [min(t, (2 * at * w + of) // (2 * of)) for t, w in zip(sizes, weights, strict=True)]
    _settle(got, sizes, weights, taken - sum(got), range(len(sizes)))
    return got


def many_window_state(sizes: np.ndarray, taken: int, weights: np.ndarray | None = None) -> np.ndarray:
    """window_state for many queues: only those that can be among the next or last due are compared one by one."""
    weights = sizes if weights is None else weights
    taken = min(taken, int(sizes.sum()))
    at, of = time_of(sizes, weights, taken)
    if 2 * at * int(weights.max()) + of < 1 << 63:
        got = np.minimum(sizes, (2 * at * weights + of) // (2 * of))
    else:
        got = np.array([min(t, (2 * at * w + of) // (2 * of)) for t, w in zip(sizes.tolist(), weights.tolist(), strict=True)], np.int64)
    more = taken - int(got.sum())
    if more:
        at = np.flatnonzero(got < sizes if more > 0 else got > 0)
        due = (2 * got[at] + (1 if more > 0 else -1)) / weights[at] * (1 if more > 0 else -1)
        if abs(more) < len(at):
            cut = np.partition(due, abs(more) - 1)[abs(more) - 1]
            at = at[due <= cut + 1e-12 * abs(cut)]
        some = got[at].tolist()
        _settle(some, sizes[at].tolist(), weights[at].tolist(), more, at.tolist())
        got[at] = some
    return got


def _settle(got: list[int], sizes: list[int], weights: list[int], more: int, names) -> None:
    """Take the `more` tokens due next, or give back the last due; names break ties."""
    ahead = more > 0
    kind, step = (_Due, 2) if ahead else (_Late, -2)
    due = [(kind(2 * g + step // 2, w, k), i) for i, (g, t, w, k) in enumerate(zip(got, sizes, weights, names, strict=True)) if (g < t if ahead else g)]
    heapq.heapify(due)
    for _ in range(abs(more)):
        x, i = heapq.heappop(due)
        got[i] += step // 2
        if got[i] < sizes[i] if ahead else got[i]:
            heapq.heappush(due, (kind(x.x + step, x.t, x.k), i))


class _Due:
    """Twice the due time of a token, as a fraction compared exactly; ties by queue."""

    __slots__ = ("k", "t", "x")

    def __init__(self, x: int, t: int, k: int):
        self.x, self.t, self.k = x, t, k

    def __lt__(self, other) -> bool:
        a, b = self.x * other.t, other.x * self.t
        return a < b or a == b and self.k < other.k

    def __gt__(self, other) -> bool:
        return other < self


class _Late(_Due):
    """The same in reverse order."""

    __slots__ = ()

    def __lt__(self, other) -> bool:
        return _Due.__lt__(other, self)


def _cut(sizes: list[int], length: int, weights: list[int] | None = None):
    total, natural = sum(sizes), weights is None
    many = np.array(sizes, np.int64) if len(sizes) > FEW_QUEUES else None
    many_weights = many if natural or many is None else np.array(weights, np.int64)

    def before(k: int, x: int) -> int:
        """About how many tokens are due before token x of queue k."""
        if natural:
            return x * total // sizes[k]
        return sum(min(t, int((x + 0.5) * w / weights[k] + 0.5)) for t, w in zip(sizes, weights, strict=True))

    def run(batches):
        states: dict[int, np.ndarray] = {}
        begins: dict[int, np.ndarray] = {}
        most = max(4, min(50_000, STATE_BYTES // (8 * max(1, len(sizes)))))

        def state(s: int) -> np.ndarray:
            if s not in states:
                if len(states) > most:
                    states.clear()
                states[s] = np.array(window_state(sizes, s * length, weights), np.int64) if many is None else many_window_state(many, s * length, many_weights)
            return states[s]

        def begin(s: int, k: int) -> int:
            """Where queue k begins in window s."""
            if many is None:
                return int((state(s + 1)[:k] - state(s)[:k]).sum())
            if s not in begins:
                if len(begins) > most:
                    begins.clear()
                taken = state(s + 1) - state(s)
                begins[s] = np.cumsum(taken) - taken
            return int(begins[s][k])

        def window_of(k: int, x: int) -> int:
            """The window that holds token x of queue k."""
            s = before(k, x) // length
            while state(s)[k] > x:
                s -= 1
            while state(s + 1)[k] <= x:
                s += 1
            return s

        for b in batches:
            doc, queue, start, count = (b.column(i).to_pylist() for i in range(4))
            out: list[list] = [[] for _ in range(7)]
            for d, k, x, n, raw in zip(doc, queue, start, count, b.column(4).to_pylist(), strict=True):
                ids = np.frombuffer(raw, np.uint16).astype("<u4")
                s, at = window_of(k, x), 0
                while at < n:
                    here, then = state(s), state(s + 1)
                    take = min(n - at, int(then[k]) - (x + at))
                    if take > 0:
                        offset = begin(s, k) + x + at - int(here[k])
                        for col, v in zip(out, (d, at, take, zlib.crc32(ids[at : at + take].tobytes()), n, s, offset), strict=True):
                            col.append(v)
                        at += take
                    s = s + 1 if many is None or at >= n else window_of(k, x + at)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def queue_weights(sizes: dict[str, int], targets: dict[str | None, float]) -> dict[str, int]:
    """Whole weights of the queues for target proportions by source; sources without one share what is left by size."""
    if any(not 0 < v <= 1 for v in targets.values()) or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("targets are proportions over 0 that add up to 1 at most")
    told = {_queue_of(s): v for s, v in targets.items()}
    others = {q: n for q, n in sizes.items() if q not in told}
    left = 1 - sum(told.values())
    if others and left * SHARE_UNITS < 1:
        raise ValueError(f"no share is left for {len(others)} sources without a target")
    total = sum(others.values())
    shares = {q: told[q] if q in told else left * others[q] / total for q in sizes}
    return {q: max(1, round(v * SHARE_UNITS)) for q, v in shares.items()}


def _queue_of(source: str | None) -> str:
    return "" if source is None else f"={source}"


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, targets: dict[str | None, float] | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of docs(doc_id, text, source).

    Null and empty texts are one token, the end id. Every source is a queue of its own, at any number of
    sources, and so is a null source. Every row, repeated or not, is a document of its own. All
    sequences are full but the last. An empty table gives no piece. Other columns are not looked at.

    targets: source -> its proportion of the tokens of a window. Sources that are not named share what the
    named ones leave, by size. While no queue is dry a queue is within a few tokens of its target at every
    window; once one is, the others fill its place in proportion to their targets. Every token is packed.
    A document of any length is cut by windows; a task holds one batch of texts and their ids.
    """
    spark = docs.sparkSession
    small_batches(spark, 2000)
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), source.alias("queue"))
    made = scratch(spark, "tokens")
    rows.mapInArrow(_tokens(tokenizer_path), "doc_id long, queue string, part int, row long, start long, n long, ids binary").write.option("compression", "zstd").parquet(made)
    tokens = spark.read.parquet(made)
    filled = tokens.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = materialize(filled.select("queue", "part", "n", F.coalesce(before, F.lit(0)).alias("before")), "queues")
    sizes = {r[0]: r[1] for r in ahead.groupBy("queue").agg(F.sum("n")).collect()}  # a row for each source
    order = sorted(sizes)
    if len(order) > FEW_QUEUES:
        ahead = ahead.join(spark.createDataFrame(list(zip(order, range(len(order)), strict=True)), "queue string, k int"), "queue").select("queue", "part", "before", "k")
    else:
        index = F.create_map(*[x for k, q in enumerate(order) for x in (F.lit(q), F.lit(k))]) if order else F.create_map().cast("map<string,int>")
        ahead = ahead.select("queue", "part", "before", index[F.col("queue")].alias("k"))
    ahead = F.broadcast(ahead) if ahead.count() <= BROADCAST_ROWS else ahead
    placed = tokens.join(ahead, ["queue", "part"]).select("doc_id", "k", (F.col("start") + F.col("before")).alias("start"), "n", "ids")
    weights = queue_weights(sizes, targets) if targets else None
    cut = _cut([sizes[q] for q in order], length, [weights[q] for q in order] if weights else None)
    pieces = materialize(placed.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"), "pieces")
    remove(spark, made)
    return pieces
