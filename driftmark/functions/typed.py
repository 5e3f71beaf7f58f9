"""Canonical JSON of typed columns as native expressions.

The schema is walked on the driver.  Each leaf becomes one column of JSON
text; records, pointer maps and hashes are put together from those, so Catalyst
prunes what a query does not use and ignored fields are never read.  Arrow
functions only serve what Spark prints differently: floats (shortest digits),
decimals of small scale, arrays and maps of either, and strings that may not be
normalised.  Floats whose digits Spark prints alike and strings that surely are in
form are gated: they pass null.  Other arrays and maps are printed element by
element inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InputError
from . import canonical, pointers
from .canonical import CanonicalPolicy

#: The code points that Python's str.split() takes as blanks.
_BLANK = "[\\u0009-\\u000D\\u001C-\\u0020\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"
#: Characters without which a string is in a form already: none below U+0300 for NFC, no ASCII for NFKC.
_MAYBE_NOT = {"NFC": "[^\\x{0}-\\x{2FF}]", "NFKC": "[^\\x{0}-\\x{7F}]"}


def _normalised(text: Column, policy: CanonicalPolicy) -> Column:
    """A string in the policy's form; only those that may not be in it go through Python."""
    if policy.unicode_form == "none":
        return text

    @F.arrow_udf(T.StringType())
    def in_form(texts: pa.Array) -> pa.Array:
        if texts.null_count == len(texts):
            return texts
        return pa.array([None if t is None else canonical.normalise(t, policy) for t in texts.to_pylist()], pa.string())

    return F.coalesce(in_form(F.when(text.rlike(_MAYBE_NOT[policy.unicode_form]), text)), text)


#: Texts of floats that Spark and Python print alike: plain digits without zeros at the end.  Up to 15 digits
#: no two decimals are the same float, so these are the shortest.
_PLAIN, _PLAIN_WIDTH = "^-?(0|[1-9][0-9]{0,6})[.](0|[0-9]*[1-9])$", 16


@F.arrow_udf(T.StringType())
def _float_text(values: pa.Array) -> pa.Array:
    if values.null_count == len(values):
        return values.cast(pa.string())
    return pa.array([None if v is None else repr(v or 0.0) for v in values.to_pylist()], pa.string())


def _float(c: Column) -> tuple[Column, Column]:
    """The text of what is no number, and the shortest digits of the others; only rare ones go through Python."""
    text, infinity = c.cast("string"), F.lit(float("inf"))
    plain = text.rlike(_PLAIN) & (F.length(text) <= _PLAIN_WIDTH) & (c != 0)
    named = F.when(F.isnan(c), "nan").when(c == infinity, "inf").when(c == -infinity, "-inf")
    known = F.when(c == 0, "0.0").when(plain, text)
    return named, F.coalesce(known, _float_text(F.when(named.isNull() & known.isNull(), c)))


def _any_json(value: Column, policy: CanonicalPolicy) -> Column:
    @F.arrow_udf(T.StringType())
    def written(values: pa.Array) -> pa.Array:
        if values.null_count == len(values):
            return pa.nulls(len(values), pa.string())
        return pa.array([None if v is None else canonical.canonical_json(canonical.lowered(v), policy) for v in values.to_pylist()], pa.string())

    return written(value)


@F.arrow_udf(T.StringType())
def _decimal_text(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else str(v) for v in values.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def spaced(texts: pa.Array) -> pa.Array:
    """Canonical JSON with the blanks that Python's json.dumps puts by default."""
    import json

    return pa.array([None if t is None else json.dumps(json.loads(t), ensure_ascii=False) for t in texts.to_pylist()], pa.string())


#: What JSON escapes with a letter of its own; other control characters take the long form.
_SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r", "\b": "\\b", "\f": "\\f"}


def quoted(text: Column) -> Column:
    """A JSON string; control characters as Python escapes them.

    Texts without anything to escape pass as they are, and only those with
    unusual control characters are taken apart.
    """
    escaped = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), _SHORT.items(), text)
    long_form = lambda c: F.concat(F.lit("\\u00"), F.lower(F.lpad(F.hex(F.ascii(c)), 2, "0")))
    taken = F.array_join(F.transform(F.split(escaped, ""), lambda c: F.when((c < " ") & (c != ""), long_form(c)).otherwise(c)), "")
    rare, any_ = text.rlike("[\\x{0}-\\x{7}\\x{B}\\x{E}-\\x{1F}]"), text.rlike('[\\x{0}-\\x{1F}"\\\\]')
    return F.concat(F.lit('"'), F.when(~any_, text).when(rare, taken).otherwise(escaped), F.lit('"'))


def short_hash(json: Column) -> Column:
    return F.substring(F.sha2(json, 256), 1, 16)


def label(text: Column) -> Column:
    """Blanks collapsed, cut to the label width."""
    flat = F.trim(F.regexp_replace(text, _BLANK, " "))
    width = canonical.LABEL_WIDTH
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.substring(flat, 1, width - 3), F.lit("...")))


def _timestamp(c: Column, zone: str) -> Column:
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)), F.lit(zone))


def _text_or_json(c: Column, kind: T.DataType) -> tuple[Column | None, Column | None] | None:
    """The raw text of what becomes a JSON string, or the JSON of anything else; None for types that take more than Spark's functions."""
    match kind:
        case T.StringType() | T.CharType() | T.VarcharType():
            return c.cast("string"), None
        case T.BooleanType() | T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return None, c.cast("string")
        case T.DateType():
            return F.date_format(c, "yyyy-MM-dd"), None
        case T.TimestampNTZType():
            return _timestamp(c, ""), None
        case T.TimestampType():
            return _timestamp(F.to_utc_timestamp(c, F.current_timezone()), "+00:00"), None
        case T.BinaryType():
            return F.regexp_replace(F.base64(c), "[\\r\\n]", ""), None
        case T.DecimalType() if kind.scale <= 6:
            return c.cast("string"), None
        case T.NullType():
            return None, F.lit(None).cast("string")
    return None


def _prints(kind: T.DataType) -> bool:
    """Whether ``_json`` can print values of a type."""
    match kind:
        case T.ArrayType():
            return _prints(kind.elementType)
        case T.MapType():
            return _prints(kind.keyType) and _prints(kind.valueType)
        case T.StructType():
            return len({canonical.normalise(f.name) for f in kind.fields}) == len(kind.fields) and all(_prints(f.dataType) for f in kind.fields)
    return _text_or_json(F.lit(None), kind) is not None


def _json(c: Column, kind: T.DataType, policy: CanonicalPolicy) -> Column:
    """The JSON of a value whose strings are in the policy's form; null for null."""
    inner = lambda x, t: F.coalesce(_json(x, t, policy), F.lit("null"))

    def listed(items: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(F.array_sort(items) if policy.list_strategy == "sort" else items, ","), F.lit("]"))

    match kind:
        case T.ArrayType():
            return listed(F.transform(c, lambda x: inner(x, kind.elementType)))
        case T.MapType():
            return listed(F.transform(F.map_entries(c), lambda e: listed(F.array(inner(e["key"], kind.keyType), inner(e["value"], kind.valueType)))))
        case T.StructType():
            named = sorted((canonical.normalise(f.name, policy), f.name, f.dataType) for f in kind.fields)
            parts = [x for i, (key, name, t) in enumerate(named) for x in (F.lit(("," if i else "") + canonical.dumps(key) + ":"), inner(c.getField(name), t))]
            return F.when(c.isNotNull(), F.concat(F.lit("{"), *parts, F.lit("}")))
    text, json = _text_or_json(c, kind)
    return json if text is None else quoted(text)


def _collection_json(c: Column, kind: T.DataType, policy: CanonicalPolicy) -> Column:
    """The JSON of an array or map: by Spark's functions where these can print the type, and the text is surely normalised."""
    if not _prints(kind):
        return _any_json(c, policy)
    json = _json(c, kind, policy)
    texts = any(name in kind.simpleString() for name in ("string", "char"))
    if not texts or policy.unicode_form == "none":
        return json
    return F.coalesce(_any_json(F.when(json.rlike(_MAYBE_NOT[policy.unicode_form]), c), policy), json)


@dataclass
class Leaf:
    """One leaf field: where it is, its text and its JSON."""

    path: str
    value: Column
    kind: T.DataType
    name: str = ""  # of its columns
    policy: CanonicalPolicy = canonical.DEFAULT

    def text_or_json(self) -> tuple[Column | None, Column | None]:
        """The raw text of what becomes a JSON string, or the JSON of anything else; null for null."""
        c = self.value
        match self.kind:
            case T.StringType() | T.CharType() | T.VarcharType():
                return _normalised(c.cast("string"), self.policy), None
            case T.FloatType() | T.DoubleType():
                return _float(c.cast("double"))
            case T.DecimalType() if self.kind.scale > 6:
                return _decimal_text(c), None
            case T.ArrayType() | T.MapType():
                return None, _collection_json(c, self.kind, self.policy)
        found = _text_or_json(c, self.kind)
        if found is None:
            raise InputError(f"{self.path}: a {self.kind.simpleString()} column has no JSON form")
        return found

    def json_type(self) -> str:
        match self.kind:
            case T.BooleanType():
                return "boolean"
            case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
                return "integer"
            case T.FloatType() | T.DoubleType():
                return "number"
            case T.ArrayType() | T.MapType():
                return "array"
        return "string"


@dataclass
class Tree:
    """A record type after ``ignore``: leaves and objects by normalised key."""

    path: str
    value: Column | None
    members: dict[str, Leaf | Tree] = field(default_factory=dict)

    def leaves(self) -> list[Leaf]:
        return [x for m in self.members.values() for x in ([m] if isinstance(m, Leaf) else m.leaves())]


def tree(schema: T.StructType, ignore: tuple[str, ...] = (), base: Column | None = None, path: str = "", policy: CanonicalPolicy = canonical.DEFAULT) -> Tree:
    """The record type of a schema without the ignored fields."""
    out = Tree(path, base)
    for f in schema.fields:
        key = canonical.normalise(f.name, policy)
        if key in out.members:
            raise InputError(f"two columns are {key!r} once normalised")
        value = F.col("`" + f.name.replace("`", "``") + "`") if base is None else base.getField(f.name)
        below = pointers.join(path, key)
        out.members[key] = tree(f.dataType, (), value, below, policy) if isinstance(f.dataType, T.StructType) else Leaf(below, value, f.dataType, policy=policy)
    for name in ignore:
        here: Leaf | Tree | None = out
        *way, last = pointers.split(name)
        for key in way:
            here = here.members.get(key) if isinstance(here, Tree) else None
        if isinstance(here, Tree):
            here.members.pop(last, None)
    out.members = dict(sorted(out.members.items()))
    return out


def leaf_columns(root: Tree) -> list[Column]:
    """Columns t0, j0, t1, j1, ...: the text (strings) and JSON of each leaf; they name the leaves."""
    out = []
    for i, leaf in enumerate(root.leaves()):
        leaf.name = str(i)
        text, json = leaf.text_or_json()
        none = F.lit(None).cast("string")
        out += [(none if text is None else text).alias(f"t{i}"), (none if json is None else json).alias(f"j{i}")]
    return out


def json_columns(root: Tree) -> list[Column]:
    """Columns q0, q1, ...: the whole JSON of each leaf, from those of ``leaf_columns``; records, maps and hashes are put together from them."""
    return [F.coalesce(quoted(F.col("t" + leaf.name)), F.col("j" + leaf.name), F.lit("null")).alias("q" + leaf.name) for leaf in root.leaves()]


def json_of(node: Leaf | Tree) -> Column:
    """The canonical JSON of a field; needs the columns of ``json_columns`` and ``null_flags``."""
    if isinstance(node, Leaf):
        return F.col("q" + node.name)
    parts: list[Column] = []
    for i, (key, member) in enumerate(node.members.items()):
        parts += [F.lit(("," if i else "") + canonical.dumps(key) + ":"), json_of(member)]
    body = F.concat(F.lit("{"), *parts, F.lit("}"))
    return body if node.value is None else F.when(F.col(_null_flag(node)), F.lit("null")).otherwise(body)


def _null_flag(node: Tree) -> str:
    return "`o" + node.path.replace("`", "``") + "`"


def null_flags(root: Tree) -> list[Column]:
    """A column for each object below the root that tells where it is null."""
    out = []
    for m in root.members.values():
        if isinstance(m, Tree):
            out += [m.value.isNull().alias("o" + m.path), *null_flags(m)]
    return out


def leaf_pairs(node: Leaf | Tree) -> Column:
    """array<struct<path, json>> of the leaves of a field."""
    def pair(path: str, json: Column) -> Column:
        return F.struct(F.lit(path).alias("path"), json.alias("json"))

    if isinstance(node, Leaf):
        return F.array(pair(node.path, json_of(node)))
    plain = [pair(m.path, json_of(m)) for m in node.members.values() if isinstance(m, Leaf)]
    deep = [leaf_pairs(m) for m in node.members.values() if isinstance(m, Tree)]
    if not node.members:
        body = F.array(pair(node.path, F.lit("{}"))) if node.value is not None else F.array().cast("array<struct<path:string,json:string>>")
    else:
        body = F.concat(*([F.array(*plain)] if plain else []), *deep)
    return body if node.value is None else F.when(F.col(_null_flag(node)), F.array(pair(node.path, F.lit("null")))).otherwise(body)


def _type(leaf: Leaf) -> Column:
    return F.when(F.col("t" + leaf.name).isNotNull(), "string").when(F.col("j" + leaf.name).isNotNull(), leaf.json_type()).otherwise("null")


def type_pairs(node: Leaf | Tree) -> Column:
    """array<struct<path, type>> of a field and those below it (not of the root)."""
    def pair(path: str, kind: Column) -> Column:
        return F.struct(F.lit(path).alias("path"), kind.alias("type"))

    if isinstance(node, Leaf):
        return F.array(pair(node.path, _type(node)))
    below = [type_pairs(m) for m in node.members.values()]
    if node.value is None:
        return F.concat(*below) if below else F.array().cast("array<struct<path:string,type:string>>")
    whole = F.concat(F.array(pair(node.path, F.lit("object"))), *below)
    return F.when(F.col(_null_flag(node)), F.array(pair(node.path, F.lit("null")))).otherwise(whole)


def leaf_map(root: Tree, value: Callable[[Column], Column] = lambda json: json) -> Column:
    """Pointer -> ``value`` of the JSON of each leaf of a record."""
    if _flat(root):
        return _fixed_map(root, lambda leaf: value(json_of(leaf)))
    return F.map_from_entries(F.transform(leaf_pairs(root), lambda x: F.struct(x["path"].alias("key"), value(x["json"]).alias("value"))))


def type_map(root: Tree) -> Column:
    """Pointer -> JSON type of each field of a record."""
    return _fixed_map(root, _type) if _flat(root) else F.map_from_entries(type_pairs(root))


def _flat(root: Tree) -> bool:
    """Whether all records have the same fields, none of them an object: then compiled code makes the maps."""
    return bool(root.members) and all(isinstance(m, Leaf) for m in root.members.values())


def _fixed_map(root: Tree, value: Callable[[Leaf], Column]) -> Column:
    leaves = root.leaves()
    return F.map_from_arrays(F.array(*[F.lit(leaf.path) for leaf in leaves]), F.array(*map(value, leaves)))
