"""Identifiers in text: addresses, hashes, files, registry paths, hosts. As columns and for single strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FILE_EXTENSIONS

# The grammar, in the order of extraction.
_EXT = "|".join(FILE_EXTENSIONS)
IP = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
DOTTED = r"\b[0-9]+(?:\.[0-9]+){1,3}\b"
HASH = r"\b[a-fA-F0-9]{32,64}\b"
UUID = r"\b[a-fA-F0-9]{8}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{12}\b"
FILE = rf"(?i)\b[A-Za-z0-9_$~+%-][A-Za-z0-9_$~+%.-]*\.(?:{_EXT})\b"
REGISTRY = r"(?i)(?:\\machine|hkey_local_machine|hklm|hkey_current_user|hkcu|hkey_classes_root|hkcr|hkey_users|hku)(?:[\\/][A-Za-z0-9_. -]+)+"
HOST = r"\b(?=[A-Za-z0-9.-]*[A-Za-z])(?=[A-Za-z0-9.-]*\.)[A-Za-z0-9][A-Za-z0-9.-]{2,}[A-Za-z0-9]\b"
DASHED = r"\b(?=[A-Za-z0-9-]*[A-Za-z])(?=[A-Za-z0-9-]*[0-9])(?=[A-Za-z0-9-]*-)[A-Za-z0-9][A-Za-z0-9-]{2,}[A-Za-z0-9]\b"
NUMERIC = r"[0-9]+(?:\.[0-9]+)+"
HIVES = ("\\", "hkey_", "hklm", "hkcu", "hkcr", "hku")
TRIM = ".,;:()[]{}\"'"
CATEGORIES = ("ip", "dotted_numeric", "hash", "uuid", "file_name", "registry_path", "hostname")
STRICT = ("ip", "dotted_numeric", "hash", "uuid", "registry_path")
FUZZY = ("file_name", "hostname")


def bounded(text: Column) -> Column:
    """Non-ASCII letters as `_`, so that word boundaries are the same in every engine."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x00-\x7F\P{L}]", "_")


def _canonical(value: Column) -> Column:
    low = F.lower(F.btrim(F.trim(value), F.lit(TRIM)))
    hive = low.startswith(HIVES[0])
    for h in HIVES[1:]:
        hive = hive | low.startswith(h)
    return F.regexp_replace(F.when(hive, F.translate(low, "/", "\\")).otherwise(low), r"\\+", r"\\")


# What any match must hold, cheaper to look for than the pattern itself.
_NEEDS = {
    IP: lambda t: t.rlike(r"[0-9]\.[0-9]"), DOTTED: lambda t: t.rlike(r"[0-9]\.[0-9]"), HASH: lambda t: t.rlike("[a-fA-F0-9]{32}"), UUID: lambda t: t.contains("-"),
    FILE: lambda t: t.rlike(rf"(?i)\.(?:{_EXT})\b"), REGISTRY: lambda t: t.contains("\\") | t.contains("/"), DASHED: lambda t: t.contains("-"),
}


def _all(text: Column, pattern: str) -> Column:
    """Distinct canonical matches, by position."""
    found = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), _canonical), lambda x: x != ""))
    return F.when(_NEEDS[pattern](text), found).otherwise(F.array().cast("array<string>"))


def _whole(value: Column, pattern: str) -> Column:
    body = pattern.removeprefix("(?i)")
    return value.rlike(f"{'(?i)' if pattern != body else ''}^(?:{body})$")


def let(body, **values: Column) -> Column:
    """body(s) with s.name evaluated once, also where body uses it for every element of an array."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def _hostlike(x: Column) -> Column:
    return ~(_whole(x, FILE) | _whole(x, NUMERIC))


def identifiers(text: Column) -> Column:
    """struct of array<string> columns, one for each category."""
    none = F.array().cast("array<string>")

    def plain(s: Column) -> Column:
        t = s["t"]
        return let(
            hosts, t=t, ip=_all(t, IP), dotted_numeric=F.filter(_all(t, DOTTED), lambda x: ~_whole(x, IP)), hash=_all(t, HASH), uuid=_all(t, UUID),
            file_name=_all(t, FILE), registry_path=_all(t, REGISTRY), found=F.when(t.contains("."), F.regexp_extract_all(t, F.lit(HOST), F.lit(0))).otherwise(none),
        )

    def hosts(s: Column) -> Column:
        other = F.concat(*[s[c] for c in CATEGORIES[:-1]])
        named = F.filter(F.array_distinct(F.transform(s["found"], _canonical)), lambda x: (x != "") & _hostlike(x))
        return let(dashed, p=s, hosts=F.array_except(named, other))

    def dashed(s: Column) -> Column:
        """Dashed names count outside the spans of accepted hosts: lay those spans blank and search again."""
        t, own = s["p"]["t"], s["hosts"]
        shown = F.transform(s["p"]["found"], lambda m: F.when(F.array_contains(own, _canonical(m)), F.lit(" ")).otherwise(m))
        left = F.array_join(F.zip_with(F.split(t, HOST, -1), shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        more = F.when(_NEEDS[DASHED](t), F.filter(_all(F.when(F.size(own) > 0, left).otherwise(t), DASHED), _hostlike)).otherwise(none)
        return F.struct(*[s["p"][c].alias(c) for c in CATEGORIES[:-1]], F.array_distinct(F.concat(own, more)).alias("hostname"))

    return let(plain, t=bounded(text))


def values_of(ids: Column, categories=CATEGORIES) -> Column:
    """All values of the categories in one array; a value of two categories comes twice."""
    return F.concat(*[ids[c] for c in categories])


# The same for one string on the driver: a query is never large.

_PY = {c: re.compile(p, re.ASCII) for c, p in zip(("ip", "dotted_numeric", "hash", "uuid", "file_name", "registry_path", "host", "dashed"), (IP, DOTTED, HASH, UUID, FILE, REGISTRY, HOST, DASHED), strict=True)}
_LETTER = re.compile(r"[^\x00-\x7F]")


def canonical(value: str) -> str:
    low = value.strip().strip(TRIM).lower()
    return re.sub(r"\\+", r"\\", low.replace("/", "\\") if low.startswith(HIVES) else low)


def identifiers_of(text: str) -> dict[str, list[str]]:
    """Category -> values, both in order of first appearance."""
    pre = _LETTER.sub(lambda m: "_" if m[0].isalpha() else m[0], text)
    spots: dict[tuple[str, str], int] = {}

    def add(category: str, m: re.Match) -> None:
        if value := canonical(m[0]):
            spots.setdefault((category, value), m.start())

    for category in CATEGORIES[:-1]:
        for m in _PY[category].finditer(pre):
            if category != "dotted_numeric" or not _PY["ip"].fullmatch(m[0]):
                add(category, m)
    plain = {v for _, v in spots}
    numeric = re.compile(NUMERIC)
    taken = []
    for kind in ("host", "dashed"):
        for m in _PY[kind].finditer(pre):
            value = canonical(m[0])
            inside = any(a <= m.start() and m.end() <= b for a, b in taken) if kind == "dashed" else value in plain
            if inside or _PY["file_name"].fullmatch(value) or numeric.fullmatch(value):
                continue
            if kind == "host":
                taken.append(m.span())
            add("hostname", m)
    out: dict[str, list[str]] = {}
    for (category, value), _ in sorted(spots.items(), key=lambda p: (p[1], *p[0])):
        out.setdefault(category, []).append(value)
    return out
