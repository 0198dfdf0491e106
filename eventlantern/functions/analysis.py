"""Words and identifiers of whole batches of texts, in Arrow: what text.word_list and identifiers.identifiers give, at a fraction of their cost.

A text is parted at white space. No pattern but that of registry paths can match across it, so identifiers are looked
for once in every distinct piece that holds a mark they need, and what a piece gave is kept for the pieces like it.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SEARCH_STOPWORDS
from .identifiers import CATEGORIES, DASHED, DOTTED, FILE, HASH, HOST, IP, NUMERIC, REGISTRY, UUID, canonical

IDS = "struct<" + ",".join(f"{c}:array<string>" for c in CATEGORIES) + ">"
ANALYSED = f"struct<ids:{IDS},tokens:array<string>>"
KEPT = 100_000  # pieces, and as many values, remembered by a worker; then it starts anew
SHORT = 200  # characters of a value that is worth remembering

for _name in (__name__, canonical.__module__):  # sent along with a task, so that workers need not have the package
    cloudpickle.register_pickle_by_value(sys.modules[_name])

_RE = {p: re.compile(p, re.ASCII) for p in (IP, DOTTED, HASH, UUID, FILE, REGISTRY, HOST, DASHED, NUMERIC)}
_PLAIN = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
_STOP = frozenset(SEARCH_STOPWORDS)
_ROOTS = ("hkey_", "hklm", "hkcu", "hkcr", "hku", "\\machine")


class _Letters(dict):
    """Non-ASCII letters as `_`, every other character as it is."""

    def __missing__(self, c: int) -> int:
        self[c] = got = 95 if c > 127 and chr(c).isalpha() else c
        return got


_LETTERS = _Letters()


def words(low: str) -> list[str]:
    """As text.word_list, of a text in lower case."""
    return [w for w in low.encode().translate(_PLAIN).decode("ascii").split() if w not in _STOP]


def _bounded(text: str) -> str:
    return text if text.isascii() else text.translate(_LETTERS)


def _all(pattern: str, text: str) -> list[str]:
    return [x for x in dict.fromkeys(map(canonical, _RE[pattern].findall(text))) if x]


def _hostlike(x: str) -> bool:
    return not (_RE[FILE].fullmatch(x) or _RE[NUMERIC].fullmatch(x))


def _read(text: str, registry: list[str]) -> tuple[list[list[str]], list[str], list[str]]:
    """(values of the categories but hosts, dotted hosts, dashed hosts) of a bounded text whose registry paths are known."""
    dot, dash = "." in text, "-" in text
    dotted = [x for x in _all(DOTTED, text) if not _RE[IP].fullmatch(x)] if dot else []
    plain = [_all(IP, text) if dot else [], dotted, _all(HASH, text) if len(text) > 31 else [], _all(UUID, text) if dash else [], _all(FILE, text) if dot else [], registry]
    other = {x for values in plain for x in values}
    own = [x for x in _all(HOST, text) if _hostlike(x) and x not in other] if dot else []
    dashed: list[str] = []
    if dash:  # outside the spans of accepted hosts
        left = _RE[HOST].sub(lambda m: " " if canonical(m[0]) in own else m[0], text) if own else text
        dashed = [x for x in _all(DASHED, left) if _hostlike(x)]
    return plain, own, dashed


_kept: dict[str, tuple | None] = {}


def _of_piece(piece: str) -> tuple | None:
    """(((category, values), ...) of those that are there, dotted hosts, dashed hosts), or None."""
    if len(_kept) >= KEPT:
        _kept.clear()
    plain, own, dashed = _read(_bounded(piece), [])
    got = (tuple((k, v) for k, v in enumerate(plain) if v), own, dashed)
    _kept[piece] = got = got if any(got) else None
    return got


def _registry(text: str, low: str) -> list[str]:
    return _all(REGISTRY, _bounded(text)) if ("\\" in text or "/" in text) and any(h in low for h in _ROOTS) else []


def _marked(piece: str) -> bool:
    return "." in piece or "-" in piece or len(piece) > 31


def _known(piece: str) -> tuple | None:
    got = _kept.get(piece, 0)
    return _of_piece(piece) if got == 0 else got


def _combined(found: Iterable[tuple], registry: list[str], text: Callable[[], str]) -> list[list[str]]:
    """The values of every category from what the pieces gave, by position; text gives the whole text."""
    plain: list[list[str]] = [[] for _ in CATEGORIES[:-2]]
    own: list[str] = []
    dashed: list[str] = []
    for got in found:
        for k, values in got[0]:
            plain[k] += values
        own += got[1]
        dashed += got[2]
    plain = [list(dict.fromkeys(values)) if len(values) > 1 else values for values in plain] + [registry]
    if own and any(plain) and not {x for values in plain for x in values}.isdisjoint(own):  # a piece's host is something else in another piece
        plain, own, dashed = _read(_bounded(text()), plain[-1])
    return [*plain, list(dict.fromkeys(own + dashed))]


def identifier_lists(text: str, low: str) -> list[list[str]]:
    """As identifiers.identifiers: the values of every category. low is the text in lower case."""
    found = map(_known, filter(_marked, dict.fromkeys(text.split())))
    return _combined([got for got in found if got], _registry(text, low), lambda: text)


def _offsets(lengths) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))


def _lists(rows: Iterable[list[str]]) -> pa.Array:
    lengths, flat = [], []
    for row in rows:
        flat += row
        lengths.append(len(row))
    return pa.ListArray.from_arrays(_offsets(lengths), pa.array(flat, pa.string()))


def _laid(pool: pa.Array, lengths: np.ndarray, order: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Lists made of runs of a pool: the runs lie there side by side by their lengths; order names those of all lists in turn, ends how many they are up to each list's end."""
    starts = np.cumsum(lengths) - lengths
    size = lengths[order]
    upto = np.cumsum(size)
    at = np.arange(int(size.sum())) + np.repeat(starts[order] - (upto - size), size)
    upto = np.concatenate([[0], upto])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto[ends]]).astype(np.int32)), pool.take(pa.array(at)))


def _result(ids: list[list[list[str]]], tokens: Callable[[list[str], np.ndarray], pa.Array]) -> pa.Array:
    """tokens is given the values of all rows and how many each has."""
    flat = [v for row in ids for values in row for v in values]
    many = np.array([sum(map(len, row)) for row in ids], np.int64)
    held = pa.StructArray.from_arrays([_lists(row[k] for row in ids) for k in range(len(CATEGORIES))], names=list(CATEGORIES))
    return pa.StructArray.from_arrays([held, tokens(flat, many)], names=["ids", "tokens"])


def _filtered(lists: pa.Array, keep: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of lists that are to be kept, and how many each list keeps."""
    upto = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    ends = lists.offsets.to_numpy()
    ends = ends - ends[0]
    return lists.flatten().filter(keep), upto[ends[1:]] - upto[ends[:-1]]


def analysed_text(text: Column) -> Column:
    """struct<ids, tokens> of a text: its words, then its identifiers, one for each category.

    Texts are parted and their parts sorted out by Arrow; only pieces with a mark become strings here, each once in a batch.
    """

    def run(texts: pa.Array) -> pa.Array:
        told = [x or "" for x in texts.to_pylist()]
        lows = [t.lower() for t in told]
        parted = pc.ascii_split_whitespace(pa.array([low.encode().translate(_PLAIN).decode("ascii") for low in lows], pa.string()))
        own, many = _filtered(parted, pc.invert(pc.is_in(parted.flatten(), value_set=pa.array(["", *sorted(_STOP)]))))
        pieces = pc.utf8_split_whitespace(pa.array(told, pa.string()))
        flat = pieces.flatten()
        marked = pc.or_(pc.or_(pc.match_substring(flat, "."), pc.match_substring(flat, "-")), pc.greater(pc.binary_length(flat), 31))
        flat, counts = _filtered(pieces, marked)
        flat = flat.dictionary_encode()
        known = [_known(p) for p in flat.dictionary.to_pylist()]
        at, ids, a = flat.indices.to_pylist(), [], 0
        for t, low, n in zip(told, lows, counts.tolist()):
            found = [known[k] for k in dict.fromkeys(at[a:a + n])]
            ids.append(_combined([got for got in found if got], _registry(t, low), lambda: t))  # noqa: B023
            a += n

        def tokens(values: list[str], each: np.ndarray) -> pa.Array:
            n = len(told)
            order = np.arange(2 * n).reshape(2, n).T.reshape(-1)
            return _laid(pa.concat_arrays([own, pa.array(values, pa.string())]), np.concatenate([many, each]), order, 2 * np.arange(1, n + 1))

        return _result(ids, tokens)

    return F.arrow_udf(run, ANALYSED)(text)


_values: dict[str, tuple] = {}


def _of_value(value: str) -> tuple[list[str], list[tuple], bool]:
    """(words, what the pieces gave, whether a registry path can begin in it)."""
    got = _values.get(value)
    if got is None:
        low = value.lower()
        found = map(_known, filter(_marked, dict.fromkeys(value.split())))
        got = (words(low), [x for x in found if x], any(h in low for h in _ROOTS))
        if len(value) <= SHORT:
            if len(_values) >= KEPT:
                _values.clear()
            _values[value] = got
    return got


def analysed_fields(told: Column, name_words: Callable[[str], str]) -> Column:
    """struct<ids, tokens> of array<struct<name,value>>: words of every name and value, identifiers of the values joined by blanks.

    Every distinct name and value is read once in a batch; a row's tokens are runs of theirs.
    """

    def run(told: pa.Array) -> pa.Array:
        flat = told.flatten()
        names, values = flat.field("name").dictionary_encode(), flat.field("value").dictionary_encode()
        of_name = [words(name_words(n).lower()) for n in names.dictionary.to_pylist()]
        texts = values.dictionary.to_pylist()
        of_value = [_of_value(v) for v in texts]
        live = [v if v[1] or v[2] else None for v in of_value]  # the others give no identifier
        ends = told.offsets.to_numpy()
        ends = (ends - ends[0]).astype(np.int64)
        at, ids, registry = values.indices.to_pylist(), [], {}
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            found, rest = [], None
            for k in range(a, b):
                got = live[at[k]]
                if got is not None:
                    found += got[1]
                    if got[2] and rest is None:  # paths can run on into later values
                        rest = " ".join([texts[i] for i in at[k:b]])
            paths = [] if rest is None else registry.get(rest)
            if paths is None:
                paths = registry[rest] = _registry(rest, rest.lower())
            ids.append(_combined(found, paths, lambda: " ".join([texts[i] for i in at[a:b]])))  # noqa: B023

        def tokens(extra: list[str], each: np.ndarray) -> pa.Array:
            runs = [*of_name, *(v[0] for v in of_value)]
            pool = pa.array([*(w for r in runs for w in r), *extra], pa.string())
            n, e = len(ids), len(at)
            rows = np.arange(n)
            place = 2 * np.arange(e) + np.repeat(rows, np.diff(ends))  # a row's names and values in turn, then its identifiers
            order = np.empty(2 * e + n, np.int64)
            order[place] = names.indices.to_numpy()
            order[place + 1] = len(of_name) + values.indices.to_numpy()
            order[2 * ends[1:] + rows] = len(runs) + rows
            return _laid(pool, np.concatenate([np.array([len(r) for r in runs], np.int64), each]), order, 2 * ends[1:] + rows + 1)

        return _result(ids, tokens)

    return F.arrow_udf(run, ANALYSED)(told)


def likely_terms(terms: Column, asked: list[str]) -> Column:
    """The distinct terms of an array that may match a term asked, exactly, by its beginning or within scoring.fuzzy_limit edits; never fewer.

    Each edit changes at most one letter, so a term must share all but so many letters with what is asked. Other than
    ASCII terms all stay.
    """

    def near(codes: np.ndarray, lengths: np.ndarray, a: int, wanted: np.ndarray, limit: int) -> np.ndarray:
        ok = (lengths > 4) & (np.abs(lengths - a) <= limit)
        shared = np.zeros(len(ok), np.int64)
        for c, n in zip(*np.unique(wanted, return_counts=True)):
            shared += np.minimum((codes[: a + limit] == c).sum(axis=0, dtype=np.uint8 if a < 200 else np.int64), n)
        return ok & (np.maximum(lengths, a) - shared <= limit)

    def run(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().dictionary_encode()
        told = flat.dictionary.cast(pa.string())
        lengths = pc.binary_length(told).to_numpy(zero_copy_only=False).astype(np.int64)
        keep = pc.not_equal(pc.utf8_length(told), pc.binary_length(told)).to_numpy(zero_copy_only=False).copy()
        plain = [q for q in asked if q.isascii()]
        if len(plain) < len(asked):
            keep[:] = True
        sizes = [len(q) for q in plain if len(q) > 4]
        small = np.flatnonzero((lengths > 4) & (lengths >= min(sizes, default=0) - 3) & (lengths <= max(sizes, default=0) + 3))
        if len(small):
            size, taken = lengths[small], told.take(pa.array(small))
            codes = np.zeros((len(small), int(size.max())), np.uint8)
            codes[np.arange(codes.shape[1]) < size[:, None]] = np.frombuffer(taken.buffers()[2], np.uint8)[: int(size.sum())]
            codes = np.ascontiguousarray(codes.T)  # by place in the term
        for q in plain:
            keep |= pc.is_in(told, value_set=pa.array([q[:k] for k in range(1, len(q) + 1)], pa.string())).to_numpy(zero_copy_only=False)
            keep |= pc.starts_with(told, q).to_numpy(zero_copy_only=False)
            if len(small) and len(q) > 4:
                keep[small] |= near(codes, size, len(q), np.frombuffer(q.encode(), np.uint8), 1 if len(q) <= 4 else 2 if len(q) <= 8 else 3)
        ends = lists.offsets.to_numpy()
        ends = ends - ends[0]
        index = flat.indices.to_numpy(zero_copy_only=False)
        hit = np.flatnonzero(keep[index]) if len(index) else np.zeros(0, np.int64)
        row = np.searchsorted(ends, hit, "right") - 1
        pairs = np.unique(row * max(1, len(keep)) + index[hit])
        counts = np.bincount(pairs // max(1, len(keep)), minlength=len(lists))
        return pa.ListArray.from_arrays(_offsets(counts), told.take(pa.array(pairs % max(1, len(keep)))))

    return F.arrow_udf(run, "array<string>")(terms)
