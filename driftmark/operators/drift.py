"""Schema profiles and what changed between two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.typed import quoted


def present(profile: DataFrame) -> DataFrame:
    """(path, present, types) for a profile (path, type, n); types maps each JSON type to its records."""
    return profile.groupBy("path").agg(F.sum("n").alias("present"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("types"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change, before, after): fields added, removed, or with another set of JSON types.

    Profiles have a row for each field and type.  Where names of fields are data there are many, so this stays a table.
    """
    kinds = lambda p, name: p.groupBy("path").agg(F.sort_array(F.collect_set("type")).alias(name))
    both = kinds(before, "before").join(kinds(after, "after"), "path", "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "retyped")
    return both.withColumn("change", change).where("change is not null").select("path", "change", "before", "after")


def members(profile: DataFrame) -> DataFrame:
    """The profile as the snapshot file holds it: ``value``, a member of a JSON object for each field, in the order of their names."""
    types = F.array_join(F.transform(F.map_entries("types"), lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"].cast("string"))), ",")
    value = F.concat(quoted(F.col("path")), F.lit(':{"present":'), F.col("present").cast("string"), F.lit(',"types":{'), types, F.lit("}}"))
    return present(profile).orderBy("path").select(value.alias("value"))
