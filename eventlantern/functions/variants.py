"""Paths into schemaless events, compiled to expressions over VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELD = "struct<scalar:boolean,items:array<string>>"


def payload(event: Column) -> Column:
    """The decoded payload: an object as it is, text parsed; null where there is none or it is invalid."""
    inner = F.try_variant_get(event, "$.utf8_payload", "variant")
    text = F.try_variant_get(event, "$.utf8_payload", "string")
    is_object = F.schema_of_variant(inner).startswith("OBJECT")
    # Text that parses is an object if its first mark is a brace, which is cheaper to see than the schema.
    return F.when(is_object, inner).when(text.rlike(r"^\s*\{"), F.try_parse_json(text))


def _steps(path: str) -> list[tuple[str, bool]]:
    """JSON paths between fan-outs, each with whether an array is expected at its end."""
    out, keys = [], []
    for part in path.split("."):
        keys.append(part.removesuffix("[]"))
        if part.endswith("[]"):
            out.append(("$" + "".join(f"['{k}']" for k in keys), True))
            keys = []
    if keys:
        out.append(("$" + "".join(f"['{k}']" for k in keys), False))
    return out


def _texts(values: Column) -> Column:
    """JSON text of every value that is not null, once, in order."""
    there = F.filter(values, lambda x: x.isNotNull() & ~F.is_variant_null(x))
    return F.array_distinct(F.transform(there, lambda x: F.to_json(x)))


def _fan(root: Column, steps: list[tuple[str, bool]]) -> Column:
    (path, many), rest = steps[0], steps[1:]
    if not many:
        return F.array(F.try_variant_get(root, path, "variant"))
    found = F.coalesce(F.try_variant_get(root, path, "array<variant>"), F.array().cast("array<variant>"))
    return found if not rest else F.flatten(F.transform(found, lambda x: _fan(x, rest)))


def read_path(event: Column, decoded: Column, path: str) -> Column:
    """FIELD of one path, null where a path without fan-out finds nothing."""
    root, _, inner = path.partition(".")
    base = event if root in ("event", "e") else decoded
    if "[]" in path:
        return F.struct(F.lit(False).alias("scalar"), _texts(_fan(base, _steps(inner))).alias("items"))
    found = F.try_variant_get(base, _steps(inner)[0][0], "variant")
    listed = F.schema_of_variant(found).startswith("ARRAY")
    items = F.when(listed, F.transform(F.try_variant_get(found, "$", "array<variant>"), lambda x: F.to_json(x))).otherwise(F.array(F.to_json(found)))
    return F.when(found.isNotNull() & ~F.is_variant_null(found), F.struct((~listed).alias("scalar"), items.alias("items")))


def has_value(field: Column) -> Column:
    """Null, an empty list and an empty text are empty; an empty object, 0 and false are not."""
    items = field["items"]
    return F.coalesce((F.size(items) > 0) & ~(field["scalar"] & (F.get(items, F.lit(0)) == '""')), F.lit(False))


def read_field(event: Column, decoded: Column, paths: list[str]) -> Column:
    """The first path with a value; else an empty list if any path fans out, else null."""
    read = [read_path(event, decoded, p) for p in paths]
    return F.coalesce(*[F.when(has_value(r), r) for r in read], _nothing(paths))


def _nothing(paths: list[str]) -> Column:
    return F.struct(F.lit(False).alias("scalar"), F.array().cast("array<string>").alias("items")) if any("[]" in p for p in paths) else F.lit(None).cast(FIELD)


LEAF = None  # of a tree of paths: the value as it is


class Tree:
    """Paths of one root as a schema: a cast by it reads an event once and passes over whole objects that are not there.

    A node is LEAF, or {(key, many): node}. Keys that the cast could not tell apart are refused.
    """

    def __init__(self):
        self.top: dict = {}

    def add(self, path: str) -> bool:
        """False, and nothing added, if the path does not fit in: a node with two kinds of use, or a name in two cases."""
        steps = [(p.removesuffix("[]"), p.endswith("[]")) for p in path.split(".")]
        node = self.top
        for k, step in enumerate(steps):
            last = k == len(steps) - 1
            if step in node:
                if (node[step] is LEAF) != last:
                    return False
            elif not step[0] or any(step[0].lower() == key.lower() for key, _ in node):
                return False
            else:  # all below is new
                for s in reversed(steps[k + 1:]):
                    if not s[0]:
                        return False
                below = LEAF
                for s in reversed(steps[k + 1:]):
                    below = {s: below}
                node[step] = below
                return True
            node = node[step]
        return True

    def schema(self, node="top") -> str:
        node = self.top if node == "top" else node
        if node is LEAF:
            return "variant"
        kinds = {key: f"array<{self.schema(below)}>" if many else self.schema(below) for (key, many), below in node.items()}
        return "struct<" + ",".join(f"`{k.replace('`', '``')}`:{v}" for k, v in kinds.items()) + ">"


def _let(body, value: Column) -> Column:
    """body(value) with value evaluated once, and not at all where it is null."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _leaves(at: Column, steps: list[tuple[str, bool]]) -> Column:
    """Array of the values below a cast value; an object or element that is not there gives a null or none."""
    for k, (key, many) in enumerate(steps):
        at = at.getField(key)
        if many:
            rest = steps[k + 1:]
            if not rest:
                return at
            if any(m for _, m in rest):
                none = F.array().cast("array<variant>")
                return F.flatten(F.transform(at, lambda x: F.coalesce(_leaves(x, rest), none)))
            return F.transform(at, lambda x: _one(x, rest))
    return F.array(at)


def _one(at: Column, steps: list[tuple[str, bool]]) -> Column:
    for key, _ in steps:
        at = at.getField(key)
    return at


def _one_value(found: Column) -> Column:
    """FIELD of a value that is there and not empty, else null. The text of a list, and of nothing else, begins with a bracket."""

    def told(j: Column) -> Column:
        many = F.transform(F.try_variant_get(found, "$", "array<variant>"), lambda x: F.to_json(x))
        items = F.when(j.startswith("["), many).otherwise(F.array(j))
        return F.when(~j.isin("null", '""', "[]"), F.struct((~j.startswith("[")).alias("scalar"), items.alias("items")))

    return F.when(found.isNotNull(), _let(told, F.to_json(found)))


def _many_values(values: Column) -> Column:
    """FIELD of the values of a fan-out, null where there is none."""
    told = lambda t: F.when(F.size(t) > 0, F.struct(F.lit(False).alias("scalar"), t.alias("items")))
    return F.when(F.size(values) > 0, _let(told, _texts(values)))


def read_fields(event: Column, decoded: Column, mapping: dict[str, list[str]]) -> Column:
    """Map of every field's FIELD: as read_field, with one walk over each event.

    All of it stands inside one lambda: as generated code so many fields make methods that the JVM never compiles.
    What is done to each value is said once, for an array of them, so that the plan stays small.
    """
    trees, fits = {"e": Tree(), "p": Tree()}, {}
    for path in dict.fromkeys(p for paths in mapping.values() for p in paths):
        root, _, inner = path.partition(".")
        base = "e" if root in ("event", "e") else "p"
        if trees[base].add(inner):
            fits[path] = (f"{base}_read", [(p.removesuffix("[]"), p.endswith("[]")) for p in inner.split(".")])
    kinds = {"one": [p for p in fits if "[]" not in p], "many": [p for p in fits if "[]" in p]}
    cast = [F.try_variant_get(at, "$", trees[base].schema()).alias(f"{base}_read") for base, at in (("e", event), ("p", decoded)) if trees[base].top]

    def body(s: Column) -> Column:
        held = []
        if kinds["one"]:
            held.append(F.transform(F.array(*[_one(s[fits[p][0]], fits[p][1]) for p in kinds["one"]]), _one_value).alias("one"))
        if kinds["many"]:
            held.append(F.transform(F.array(*[_leaves(s[fits[p][0]], fits[p][1]) for p in kinds["many"]]), _many_values).alias("many"))

        def fields(h: Column) -> Column:
            def read(path: str) -> Column:
                if path in fits:
                    kind = "many" if "[]" in path else "one"
                    return F.get(h[kind], F.lit(kinds[kind].index(path)))
                r = read_path(s["e"], s["p"], path)
                return F.when(has_value(r), r)

            return F.create_map(*[x for name, paths in mapping.items() for x in (F.lit(name), F.coalesce(*[read(p) for p in paths], _nothing(paths)))])

        return _let(fields, F.struct(*held)) if held else fields(F.lit(None))

    return _let(body, F.struct(event.alias("e"), decoded.alias("p"), *cast))


# The marks of JSON text that carry something: strings, numbers, true and false.
_LEAF = r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|true|false'
_SIMPLE = r'^"[^"\\\x00-\x1F]*"\z'


def _text_of(token: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(token), "$", "string")


def plain(item: Column) -> Column:
    """The text of a JSON value: a string without quotes; of objects and arrays every name and value in turn, names in order.

    Empty texts and nulls inside are left out.
    """
    leaves = F.filter(F.transform(F.regexp_extract_all(item, F.lit(_LEAF), F.lit(0)), _text_of), lambda x: x.isNotNull() & (x != ""))
    simple = item.rlike(_SIMPLE)  # nothing to decode between the quotes
    return F.when(simple, item.substr(F.lit(2), F.length(item) - 2)).when(item.rlike(r"^\s*[\[{]"), F.array_join(leaves, " ")).otherwise(_text_of(item))
