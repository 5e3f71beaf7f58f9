import datetime
import decimal

import pytest

from driftmark import CanonicalPolicy, canonical_json, canonicalize
from driftmark.errors import CanonicalError
from driftmark.functions import canonical, pointers
from driftmark.sources import strict_json


def test_keys_are_sorted_and_composed():
    assert canonical_json({"b": 1, "a": "é"}) == canonical_json({"a": "é", "b": 1}) == '{"a":"é","b":1}'


def test_lists_keep_or_sort():
    assert canonical_json([3, "a", 1]) == '[3,"a",1]'
    assert canonical_json([3, "a", 1], CanonicalPolicy(list_strategy="sort")) == '["a",1,3]'
    assert canonicalize("ﬁ", CanonicalPolicy(unicode_form="NFKC")) == "fi"
    assert canonicalize("é", CanonicalPolicy(unicode_form="none")) == "é"
    with pytest.raises(ValueError):
        CanonicalPolicy(unicode_form="NFD")
    with pytest.raises(ValueError):
        CanonicalPolicy(list_strategy="shuffle")


BAD = [float("nan"), float("inf"), datetime.date(2020, 1, 1), decimal.Decimal(1), (1, 2), {1: 2}, object(), 10**4300, "\ud800", "\udc00x", {"\u00e9": 1, "e\u0301": 2}]


@pytest.mark.parametrize("value", BAD, ids=map(str, range(len(BAD))))
def test_what_is_not_json(value):
    with pytest.raises(CanonicalError):
        canonicalize({"v": value})


def test_errors_name_the_place():
    with pytest.raises(CanonicalError, match=r"\$\.a\[1\]"):
        canonicalize({"a": [1, float("nan")]})


def test_values():
    assert canonicalize(-0.0) == 0.0 and str(canonicalize(-0.0)) == "0.0"
    assert canonicalize("😀") == "\U0001f600"
    assert canonicalize({"$non_finite": "x"}) == {"$non_finite": "x"}
    assert canonical.canonical_bytes("é") == '"é"'.encode()
    assert [canonical.json_type(v) for v in (None, True, 1, 1.0, "", [], {})] == ["null", "boolean", "integer", "number", "string", "array", "object"]


def test_lowered():
    assert canonical.lowered({"b": b"\x00", "n": [float("nan")], "d": decimal.Decimal("0E-10"), "t": datetime.timedelta(seconds=1.5), "p": (("k", 1),)}) == {"b": "AA==", "n": ["nan"], "d": "0E-10", "t": 1.5, "p": [["k", 1]]}
    assert canonical.lowered(datetime.datetime(2020, 1, 2, 3, 4, 5, 60)) == "2020-01-02T03:04:05.000060"


def test_leaves_and_pointers():
    assert list(canonical.leaves({})) == []
    assert list(canonical.leaves({"a/b": {"c~": [1]}, "e": {}})) == [("/a~1b/c~0", [1]), ("/e", {})]
    assert pointers.split("/a~1b/c~0") == ["a/b", "c~"] and pointers.split("a/b") == ["a/b"]
    record = {"m": {"x": 1}, "a/b": 2}
    for name in ("/m/x", "a/b", "/no/where", "none"):
        canonical.drop(record, name)
    assert record == {"m": {}}


def test_labels():
    assert canonical.label(" a \x1c b ") == "a b"
    assert canonical.label("x" * 73) == "x" * 69 + "..."


@pytest.mark.parametrize("text", ['{"a":1,"a":2}', '{"a":{"b":1,"b":1}}', "NaN", "-Infinity", "1e400", "1" * 4301, "{", "﻿{}", "[" * 100_000], ids=map(str, range(10)))
def test_strict_json_refuses(text):
    with pytest.raises(ValueError):
        strict_json.loads(text)


def test_strict_json_reads():
    assert strict_json.loads('{"a": [1, 1.0, "1", null]}') == {"a": [1, 1.0, "1", None]}
    assert strict_json.loads("-" + "9" * 4300) == -(10**4300 - 1)


def test_one_task_of_rows_is_decoded_by_many(spark):
    """A table that comes in one task (small on disk, however many rows) has its texts decoded by several, to the same entries."""
    from pyspark.sql import functions as F

    from driftmark.operators.matching import Match
    from driftmark.sources import readers

    rows = spark.range(400).select(F.lit("t").alias("src"), F.lit(0).alias("file_rank"), F.col("id").alias("pos"), F.format_string('{"b":{"x":[%d,null]},"a":"é%d"}', "id", "id").alias("text")).coalesce(1)
    found = readers.entries_from_json(rows, "text", Match("content")).select("pos", "types", "leaves", "err", F.spark_partition_id().alias("task")).collect()
    assert len({r["task"] for r in found}) > 1 and len(found) == 400
    for r in found:
        assert r["err"] is None and r["types"] == {"/a": "string", "/b": "object", "/b/x": "array"}
        assert r["leaves"] == {"/a": f'"é{r["pos"]}"', "/b/x": f'[{r["pos"]},null]'}


@pytest.mark.parametrize(("value", "place"), [({"a": [1, {"b": float("nan")}]}, "$.a[1].b: nan"), ({"é": {"c": "\ud800"}}, "$.é.c: a lone"), ({"a": {1: 2}}, "$.a: the mapping key 1"), ([object()], "$[0]: values of type")])
def test_errors_name_their_place(value, place):
    with pytest.raises(CanonicalError) as found:
        canonical.canonicalize(value)
    assert str(found.value).startswith(place)
