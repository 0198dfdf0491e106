"""Text normalisation and words, as columns and for single strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import QUESTION_STOPWORDS, SEARCH_STOPWORDS


def normalize(text: Column) -> Column:
    """Lower case; every run of other characters than a-z and 0-9 is one blank; no blank at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def word_list(text: Column, stopwords=SEARCH_STOPWORDS) -> Column:
    """Words in order, repeats kept, without stopwords; null gives none."""
    words = F.split(normalize(F.coalesce(text, F.lit(""))), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*stopwords))


def question_words(text: Column) -> Column:
    return word_list(text, QUESTION_STOPWORDS)


def padded(words: Column) -> Column:
    """Words joined with a blank around each, so that containment of sequences is containment of text."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def contains_sequence(hay: Column, needle: Column) -> Column:
    return (F.size(needle) > 0) & F.contains(padded(hay), padded(needle))


_OTHER = re.compile("[^a-z0-9]+")


def normalize_text(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def words_of(text: str, stopwords=SEARCH_STOPWORDS) -> list[str]:
    return [w for w in normalize_text(text).split() if w not in stopwords]


# Stems and endings that field names run together.
_FUSED = re.compile(r"\b(source|destination|event|logsource|severity|connector)(ip|id)\b")


def field_name_words(name: str) -> str:
    """What a non-empty field's name adds to a record's words: as it is, parted, and with fused stems parted."""
    parted = re.sub("[._-]+", " ", name)
    return " ".join((name, parted, _FUSED.sub(r"\1 \2", parted)))
