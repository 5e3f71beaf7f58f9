"""One query for each operator, over versions derived from the test tables, and the same in DuckDB SQL."""

from __future__ import annotations

import contextlib
import io
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from .functions import typed
from .functions.canonical import CanonicalPolicy
from .operators import compare as cmp
from .operators import drift, snapshot
from .operators import entries as ent
from .operators.matching import Match
from .plans import json_report, scratch
from .plans.scratch import materialise
from .plans.report import render_json, render_text
from .sources import files as source_files
from .sources import readers

Query = Callable[[SparkSession, str], DataFrame]
BY_ORDER = Match("id", ("o_orderkey",))
BY_TEXT = Match("key", ("text",))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(df: DataFrame, pos: str) -> DataFrame:
    return df.withColumns({"src": F.lit("table"), "file_rank": F.lit(0), "pos": F.col(pos).cast("long")})


def entries(df: DataFrame, pos: str, match: Match, ignore: tuple[str, ...] = ()) -> DataFrame:
    return ent.from_columns(placed(df, pos), match, ignore)


def version(df: DataFrame, pos: str, match: Match, ignore: tuple[str, ...] = ()) -> snapshot.Snapshot:
    return snapshot.from_entries(entries(df, pos, match, ignore), "table", match, ignore)


def orders_after(orders: DataFrame) -> DataFrame:
    """The second version of orders: removals, edits of two fields, copies under new keys."""
    key = F.col("o_orderkey")
    kept = orders.where(key % 11 != 0)
    edited = kept.withColumn("o_totalprice", F.when(key % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    edited = edited.withColumn("o_orderpriority", F.when(key % 13 == 0, F.lit("0-CHANGED")).otherwise(F.col("o_orderpriority")))
    return edited.unionByName(orders.where(key % 17 == 0).withColumn("o_orderkey", key + 10_000_000))


def documents_after(documents: DataFrame) -> DataFrame:
    return documents.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit(" (edited)"))).otherwise(F.col("text")))


def orders_diff(spark: SparkSession, sf_dir: str, ignore: tuple[str, ...] = ()) -> cmp.DatasetDiff:
    orders = table(spark, sf_dir, "orders")
    return cmp.compare(version(orders, "o_orderkey", BY_ORDER, ignore), version(orders_after(orders), "o_orderkey", BY_ORDER, ignore))


def documents_diff(spark: SparkSession, sf_dir: str) -> cmp.DatasetDiff:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return cmp.compare(version(documents, "doc_id", BY_TEXT), version(documents_after(documents), "doc_id", BY_TEXT))


def _kinds(diff: cmp.DatasetDiff) -> DataFrame:
    return diff.classified.groupBy("kind").agg(F.count("*").alias("n"))


def diff_counts_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(orders_diff(spark, sf_dir))


def diff_ignore_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(orders_diff(spark, sf_dir, ("o_totalprice",)))


def diff_changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_diff(spark, sf_dir).changed.select("id", F.array_join("changed", ",").alias("fields"))


def diff_field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_diff(spark, sf_dir).field_counts.select("path", "n")


def diff_top_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_diff(spark, sf_dir).field_counts.select("path", "n").limit(1)


def diff_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_diff(spark, sf_dir).removed.select("id", F.col("b_label").alias("label"))


def diff_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_diff(spark, sf_dir).added.select("id", F.col("a_label").alias("label"))


def diff_first_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_diff(spark, sf_dir).changed.limit(3).select("id", F.array_join("changed", ",").alias("fields"))


def diff_order_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether order changed: as it is, and with places reversed on one side."""
    orders = table(spark, sf_dir, "orders")
    before, after = version(orders, "o_orderkey", BY_ORDER), orders_after(orders)
    same = cmp.compare(before, version(after, "o_orderkey", BY_ORDER)).order_changed
    turned = ent.from_columns(placed(after, "o_orderkey").withColumn("pos", -F.col("pos")), BY_ORDER)
    other = cmp.compare(before, snapshot.from_entries(turned, "table", BY_ORDER)).order_changed
    return spark.createDataFrame([("same", same), ("reversed", other)], "version string, order_changed boolean")


def diff_key_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_diff(spark, sf_dir).rekeyed.select("before_id", "id", F.array_join("changed", ",").alias("fields"))


def diff_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = documents_diff(spark, sf_dir)
    return spark.createDataFrame([(k, n) for k, n in diff.counts.items()], "kind string, n long")


def diff_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    sides = [version(d.select("doc_id", "text", "lang"), "doc_id", Match("content"), ("doc_id",)) for d in (documents, documents_after(documents))]
    return _kinds(cmp.compare(*sides))


def duplicate_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.monotonically_increasing_id().alias("place"))
    rows = entries(lines.select("l_orderkey", "l_linenumber", "place"), "place", Match("key", ("l_orderkey", "l_linenumber")), ("place",))
    return ent.numbered(rows).select("raw_id", "id")


def duplicate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return ent.duplicates(entries(lines.withColumn("place", F.lit(0)), "place", Match("key", ("l_orderkey", "l_linenumber"))))


def record_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(table(spark, sf_dir, "customer"), "c_custkey", Match("id", ("c_custkey",))).select(F.col("raw_id").alias("id"), "hash")


def field_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(table(spark, sf_dir, "customer"), "c_custkey", Match("id", ("c_custkey",))).select(F.col("raw_id").alias("id"), F.explode("fields").alias("path", "field_hash"))


def key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_orderpriority")
    return entries(orders, "o_orderkey", Match("key", ("o_orderpriority", "o_custkey"))).select("pos", "raw_id", "rest", "label")


def content_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return entries(documents, "doc_id", Match("content")).select("pos", "label")


def schema_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")))
    return ent.profile(entries(orders, "o_orderkey", BY_ORDER))


def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    later = orders.drop("o_orderstatus").withColumn("o_custkey", F.col("o_custkey").cast("string")).withColumn("o_note", F.lit("new"))
    changes = drift.drift(ent.profile(entries(orders, "o_orderkey", BY_ORDER)), ent.profile(entries(later, "o_orderkey", BY_ORDER)))
    return changes.select("path", "change", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


def dataset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    made = version(orders, "o_orderkey", BY_ORDER)
    return spark.createDataFrame([(made.dataset_hash, made.order_hash)], "dataset_hash string, order_hash string")


def nested_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of a nested object below a pointer."""
    events = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("props"))
    rows = entries(events, "event_id", Match("id", ("event_id",)))
    return rows.select("pos", F.explode("leaves").alias("path", "json")).where("path <> '/event_id'")


def strict_json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records from JSON text by the strict decoder."""
    events = placed(table(spark, sf_dir, "events").select("event_id", "props"), "event_id")
    return readers.entries_from_json(events, "props", Match("content")).select("pos", "hash", F.element_at("leaves", "/k").alias("k"))


def typed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON of an order's date, status and price."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    root = typed.tree(orders.schema)
    leaves = orders.select("o_orderkey", *typed.leaf_columns(root))
    return leaves.select("o_orderkey", *typed.json_columns(root)).select("o_orderkey", typed.json_of(root).alias("json"))


def _written(df: DataFrame, kind: str, files: int = 3) -> str:
    """A new folder of ``df`` as JSON Lines, JSON, CSV or Parquet files: ``files`` of them, or as many as tasks read it."""
    folder = scratch.new_path(df.sparkSession, f"source-{kind}")
    some = df.repartitionByRange(max(files, df.rdd.getNumPartitions()), df.columns[0])
    if kind == "lines":
        some.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(folder)
    elif kind == "json":  # one array a file
        rows = some.groupBy(F.spark_partition_id()).agg(F.collect_list(F.struct(*df.columns)).alias("rows"))
        rows.select(F.to_json("rows", {"ignoreNullFields": "false"}).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    elif kind == "csv":
        some.write.option("header", True).option("escape", '"').csv(folder)
    else:
        some.write.parquet(folder)
    ending = {"lines": ".jsonl", "json": ".json", "csv": ".csv"}.get(kind)
    if ending:
        source_files.renamed(df.sparkSession, folder, ending if kind == "csv" else ".txt", ending)
    return folder


def _one_file(df: DataFrame, kind: str) -> str:
    """``df`` in the order of its columns as one CSV file or JSON array; tasks write its parts, which are joined as bytes."""
    spark = df.sparkSession
    parts, path = scratch.new_path(spark, "parts"), f"{scratch.new_path(spark, 'one')}/all.{kind}"
    some = df.orderBy(*df.columns)
    if kind == "json":
        some.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.option("lineSep", ",").text(parts)
        source_files.joined(spark, path, [b"[", source_files.Parts(parts, 1), b"]\n"])
    else:
        some.write.option("escape", '"').csv(parts)
        source_files.joined(spark, path, [(",".join(df.columns) + "\n").encode(), source_files.Parts(parts, 0)])
    return path


def _read_back(df: DataFrame, kind: str) -> DataFrame:
    rows = readers.read_rows(df.sparkSession, _written(df, kind))
    return rows.select("data", F.col("err").isNull().alias("usable"))


def read_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of JSON Lines files, as canonical JSON."""
    return _read_back(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "lines")


def read_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(table(spark, sf_dir, "nation"), "json")


def read_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "csv")


def read_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of Parquet files with integers, text, floats, dates and a nested object."""
    orders = table(spark, sf_dir, "orders")
    return _read_back(orders.select("o_orderkey", "o_totalprice", F.struct("o_orderstatus", "o_orderdate").alias("state")), "parquet")


def _read_by_ranges(df: DataFrame, kind: str) -> DataFrame:
    """One file, read in ranges of 64 KiB whatever its size."""
    spark = df.sparkSession
    path = _one_file(df, kind)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = readers.read_rows(spark, path, 0)
        return materialise(rows.select("position", "data", F.col("err").isNull().alias("usable")), "ranges")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def read_csv_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CSV file with quotes and line breaks in its fields, by ranges."""
    orders = table(spark, sf_dir, "orders")
    note = F.concat("o_orderpriority", F.lit('\n"x",\r\n'), F.col("o_orderstatus"))
    return _read_by_ranges(orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("customer"), note.alias("note")), "csv")


def read_json_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON array of nested objects with brackets and quotes in their text, by ranges."""
    customer = table(spark, sf_dir, "customer")
    note = F.concat("c_mktsegment", F.lit(' }],"{[ \\'))
    return _read_by_ranges(customer.select("c_custkey", F.struct(note.alias("note"), F.array("c_nationkey", "c_nationkey").alias("pair")).alias("more")), "json")


def read_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records a directory of mixed formats gives, by file ending."""
    some = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    folder = scratch.new_path(spark, "mixed")
    for kind, ending in (("lines", "jsonl"), ("csv", "csv"), ("parquet", "parquet")):
        source_files.moved(spark, _written(some, kind), f"{folder}/{ending}")
    rows = readers.read_entries(spark, folder, Match("id", ("c_custkey",)))
    return rows.groupBy(F.regexp_extract("src", "[.]([a-z]+)$", 1).alias("ending")).agg(F.count("*").alias("n"), F.count_distinct("raw_id").alias("ids"))


def detected_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By what records are matched where nothing is said: with and without a field id."""
    nation = table(spark, sf_dir, "nation")
    found = [(kind, named, readers.detect_match(spark, _written(df, kind)).by) for kind in ("lines", "json", "csv", "parquet") for named, df in (("id", nation.withColumnRenamed("n_nationkey", "id")), ("other", nation))]
    return spark.createDataFrame(found, "format string, field string, matched_by string")


def strict_json_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which made-up texts are no strict JSON: repeated keys, NaN, infinities, overlong integers, other values than objects."""
    k = F.col("n_nationkey").cast("string")
    texts = F.array(*[F.concat(F.lit(a), k, F.lit(b)) for a, b in (('{"a":', "}"), ('{"a":1,"a":', "}"), ('{"b":{"c":', ',"c":1}}'), ('{"a":NaN,"b":', "}"), ('{"a":-Infinity,"b":', "}"), ('{"a":1e999,"b":', "}"), ("[", "]"), ("", " x"), ('{"a":' + "1" * 4300, "}"))])
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(texts).alias("case", "text"))
    rows = rows.withColumn("place", F.col("n_nationkey") * 9 + F.col("case"))
    found = readers.entries_from_json(placed(rows, "place"), "text", Match("content"))
    return found.select("pos", F.col("err").isNull().alias("usable"))


def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON of text whose accents are separate characters, of floats and of a list."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" e\u0301\u0301 \u001f\t")).alias("accents"), (F.col("p_retailprice") * 1e18).alias("price"), F.array("p_size", F.lit(None).cast("int")).alias("sizes"))
    return readers.read_rows(spark, _written(part, "parquet")).select("data")


def canonical_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical records in compatibility form with sorted lists: a ligature, lists of numbers and texts, a list of objects, a map."""
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.array("p_size", F.lit(None).cast("int"), F.col("p_partkey").cast("int")).alias("numbers"), F.array("p_type", F.concat("p_brand", F.lit(" \ufb01"))).alias("words"),
        F.array(F.struct(F.col("p_type").alias("z"), F.col("p_size").alias("a")), F.struct(F.lit(None).cast("string").alias("z"), F.lit(0).alias("a"))).alias("objects"), F.create_map("p_brand", "p_type").alias("pairs"),
    )
    policy = CanonicalPolicy(unicode_form="NFKC", list_strategy="sort")
    return ent.from_columns(placed(part, "p_partkey"), Match("id", ("p_partkey",)), policy=policy).select("raw_id", "record", "hash")


def lowered_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical records of Parquet values that JSON lacks: bytes, decimals, a map, no number and infinity, dates in a list."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    odd = F.when(key % 3 == 0, F.lit(float("nan"))).when(key % 3 == 1, F.lit(float("-inf")))
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.encode("o_orderpriority", "UTF-8").alias("bytes"), F.floor(price).cast("decimal(12,2)").alias("exact"), F.create_map("o_orderstatus", key % 5).alias("pairs"),
        odd.alias("odd"), F.array(F.to_date("o_orderdate"), F.lit(None).cast("date")).alias("days"),
    )
    return readers.read_rows(spark, _written(orders, "parquet")).select("data")


def diff_clustered_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders are unchanged, changed, removed and added between two stored snapshots, neither of which is shuffled."""
    stored = []
    for df in (table(spark, sf_dir, "orders"), orders_after(table(spark, sf_dir, "orders"))):
        path = scratch.new_path(spark, "clustered")
        version(df, "o_orderkey", BY_ORDER).save_tables(path)
        stored.append(snapshot.load_tables(spark, path).entries)
    return cmp.classify(*stored).groupBy("kind").agg(F.count("*").alias("n"))


def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that differ between data and its own snapshot, saved as a file and as tables and loaded again."""
    made = version(table(spark, sf_dir, "orders"), "o_orderkey", BY_ORDER)
    file, tables = scratch.new_path(spark, "snapshot") + ".json", scratch.new_path(spark, "snapshot")
    made.save(file)
    made.save_tables(tables)
    rows = []
    for form, back in (("file", snapshot.load(spark, file)), ("tables", snapshot.load_tables(spark, tables))):
        diff = cmp.compare(back, made)
        rows.append((form, back.records, diff.counts["unchanged"], diff.has_changes, snapshot.is_snapshot(spark, file)))
    return spark.createDataFrame(rows, "form string, records long, unchanged long, changes boolean, recognised boolean")


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines of a text report: sources, matching, counts, changed fields."""
    text = render_text(orders_diff(spark, sf_dir), 0)
    return spark.createDataFrame([(i, x) for i, x in enumerate(text.splitlines())], "line long, text string")


def report_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The examples of a text report, with values of both sides."""
    orders = table(spark, sf_dir, "orders")
    sides = [snapshot.from_entries(entries(df, "o_orderkey", BY_ORDER), "table", BY_ORDER, keep_values=True) for df in (orders, orders_after(orders))]
    lines = render_text(cmp.compare(*sides), 3).splitlines()
    return spark.createDataFrame(list(enumerate(lines[lines.index("examples") + 1 :])), "line long, text string")


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changed customers of a JSON report, with its counts."""
    before = table(spark, sf_dir, "customer")
    after = before.withColumn("c_acctbal", F.when(F.col("c_custkey") % 2 == 0, F.lit(0.5)).otherwise(F.col("c_acctbal")))
    match = Match("id", ("c_custkey",))
    data = json.loads(render_json(cmp.compare(version(before, "c_custkey", match), version(after, "c_custkey", match))))
    return spark.createDataFrame([(x["id"], ",".join(x["fields"]), data["counts"]["changed"], data["order_changed"]) for x in data["changed"]], "id string, fields string, n_changed long, order_changed boolean")


def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON report in a file, of orders in JSON Lines whose field names are data: what is listed of changed fields, schema and records."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.create_map(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.col("o_totalprice").cast("long")).alias("price"))
    later = orders.where("o_orderkey % 11 > 0").withColumn("price", F.when(F.col("o_orderkey") % 5 == 0, F.transform_values("price", lambda k, v: v + 1)).otherwise(F.col("price")))
    path = scratch.new_path(spark, "report") + ".json"
    json_report.write(cmp.compare(*(snapshot.build_snapshot(spark, _written(df, "lines"), BY_ORDER) for df in (orders, later))), path)
    items = json_report.read(spark, path).where(F.col("section").isin("fields_changed", "changed", "removed", "added", "schema added", "schema removed"))
    section, value = F.col("section"), F.col("value")
    entry = F.map_entries(F.from_json(F.concat(F.lit("{"), F.when(section == "fields_changed", value), F.lit("}")), "map<string,bigint>"))[0]
    text = F.from_json(F.concat(F.lit("["), F.when(section.startswith("schema "), value), F.lit("]")), "array<string>")[0]
    record = F.from_json(F.when(section.isin("changed", "removed", "added"), value), "id string, fields array<string>")
    parsed = items.select(F.when(section == "fields_changed", "fields").otherwise(section).alias("section"), entry.alias("entry"), text.alias("text"), record.alias("record"))
    listed = F.coalesce(F.col("entry.value").cast("string"), F.array_join("record.fields", ","))
    return parsed.select("section", F.coalesce("entry.key", "text", "record.id").alias("name"), listed.alias("value"))


def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit status of comparisons: same data, other data, no data."""
    nation = table(spark, sf_dir, "nation")
    one, other = _written(nation, "parquet"), _written(nation.withColumn("n_name", F.lower("n_name")), "parquet")
    with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
        found = [(name, cli.main(["diff", one, path, "--id", "n_nationkey"])) for name, path in (("same", one), ("other", other), ("none", one + "-none"))]
    return spark.createDataFrame(found, "name string, status long")


def snapshot_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots from the command line, compared with data: what is printed, options taken over and in conflict, exit statuses."""
    orders = table(spark, sf_dir, "orders")
    one, other = (_written(df, "parquet") for df in (orders, orders_after(orders)))
    file, folder = scratch.new_path(spark, "command") + ".json", scratch.new_path(spark, "command")
    settings = ["--id", "o_orderkey", "--ignore", "o_totalprice"]
    found = []
    for name, words in (
        ("file", ["snapshot", one, "-o", file, *settings]), ("tables", ["snapshot", one, "-o", folder, "--tables", *settings]), ("repeats", ["snapshot", one, "-o", scratch.new_path(spark, "command") + ".json", "--id", "o_orderpriority"]),
        ("same", ["diff", file, one]), ("changed", ["diff", folder, other, "--examples", "0"]), ("other id", ["diff", file, one, "--id", "o_custkey"]), ("other fields", ["diff", folder, one, "--ignore", "o_custkey"]), ("same path", ["snapshot", one, "-o", one, *settings]),
    ):
        out, err = io.StringIO(), io.StringIO()
        with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
            status = cli.main(words)
        lines = [x.strip() for x in out.getvalue().splitlines()]
        said = [x.partition(": ")[2] for x in lines] if words[0] == "snapshot" else lines[1:2] + [x for x in lines if x.startswith("changed ")]
        found.append((name, status, " / ".join(" ".join(x.split()) for x in said), bool(err.getvalue())))
    return spark.createDataFrame(found, "name string, status long, said string, failed boolean")


def report_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of two versions of orders by customer: notes of repeated ids, ignored fields, a field that goes and one that comes."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lit("x").alias("o_old"))
    later = orders.where("o_orderkey % 3 > 0").withColumnRenamed("o_old", "o_new")
    match, ignore = Match("id", ("o_custkey",)), ("o_orderkey",)
    at = F.col("o_custkey") * 10_000_000_000 + F.col("o_orderkey")
    sides = [snapshot.from_entries(ent.from_columns(df.withColumns({"src": F.lit("orders"), "file_rank": F.lit(0), "pos": at}), match, ignore), "orders", match, ignore) for df in (orders, later)]
    return spark.createDataFrame(list(enumerate(render_text(cmp.compare(*sides), 0).splitlines())), "line long, text string")


_ALL: tuple[Query, ...] = (
    read_json_lines, read_json, read_csv, read_parquet, read_csv_ranges, read_json_ranges, read_directory, detected_matching, strict_json_errors, normalised_text, canonical_policy, lowered_values, snapshot_round_trip, snapshot_command, report_notes, diff_clustered_snapshots, report_lines, report_examples, report_json, report_file, command_line,
    diff_counts_by_id, diff_ignore_fields, diff_changed_fields, diff_field_counts, diff_top_fields, diff_removed, diff_added, diff_first_examples,
    diff_order_changed, diff_key_edited, diff_key_counts, diff_content, duplicate_numbering, duplicate_count, record_hash, field_hash, key_hash,
    content_label, schema_profile, schema_drift, dataset_hash, nested_leaves, strict_json_text, typed_text,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


_ORDERS = """
with a as (select * from orders), b as (
  select o_orderkey, o_custkey, o_orderstatus, case when o_orderkey % 7 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice, o_orderdate,
    case when o_orderkey % 13 = 0 then '0-CHANGED' else o_orderpriority end as o_orderpriority
  from orders where o_orderkey % 11 <> 0
  union all select o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders where o_orderkey % 17 = 0
), d as (
  select coalesce(a.o_orderkey, b.o_orderkey) as k, a.o_orderkey is null as new, b.o_orderkey is null as gone,
    list_filter(['/o_custkey', '/o_orderdate', '/o_orderpriority', '/o_orderstatus', '/o_totalprice'], lambda x, i:
      [a.o_custkey is distinct from b.o_custkey, a.o_orderdate is distinct from b.o_orderdate, a.o_orderpriority is distinct from b.o_orderpriority,
       a.o_orderstatus is distinct from b.o_orderstatus, a.o_totalprice is distinct from b.o_totalprice][i]) as fields
  from a full join b on a.o_orderkey = b.o_orderkey
), k as (
  select *, case when new then 'added' when gone then 'removed' when len(fields) = 0 then 'unchanged' else 'changed' end as kind from d
)
"""
_CHANGED = "select cast(k as varchar) as id, array_to_string(fields, ',') as fields from k where kind = 'changed'"
_COUNTS = "select path, count(*) as n from (select unnest(fields) as path from k where kind = 'changed') group by path order by n desc"

_DOCUMENTS = """
with v as (
  select 0 as side, doc_id, text, lang, source, n_chars from documents
  union all select 1, doc_id, case when doc_id % 13 = 0 then text || ' (edited)' else text end, lang, source, n_chars from documents where doc_id % 11 <> 0
), e as (
  select *, 'k:' || left(sha256('[' || cast(to_json(text) as varchar) || ']'), 16) as raw_id,
    left(sha256('{"doc_id":' || doc_id || ',"lang":' || cast(to_json(lang) as varchar) || ',"n_chars":' || n_chars || ',"source":' || cast(to_json(source) as varchar) || '}'), 16) as rest
  from v
), n as (
  select *, raw_id || case when row_number() over w > 1 then '#' || row_number() over w else '' end as id, row_number() over w > 1 as again
  from e window w as (partition by side, raw_id order by doc_id)
), o as (select * from n where side = 0), m as (select * from n where side = 1),
gone as (select * from o where id not in (select id from m)), new as (select * from m where id not in (select id from o)),
pairs as (
  select gone.id as before_id, new.id as id,
    array_to_string(list_filter(['/doc_id', '/lang', '/n_chars', '/source', '/text'], lambda x, i: [gone.doc_id <> new.doc_id, gone.lang <> new.lang, gone.n_chars <> new.n_chars, gone.source <> new.source, gone.text <> new.text][i]), ',') as fields
  from gone join new using (rest)
  where rest in (select rest from gone group by rest having count(*) = 1) and rest in (select rest from new group by rest having count(*) = 1)
)
"""


def oracle_sql() -> dict[str, str]:
    balance = "case when c_acctbal = 0 then '0.0' else cast(c_acctbal as varchar) end"  # one zero
    record = f"'{{\"c_acctbal\":' || {balance} || ',\"c_custkey\":' || c_custkey || ',\"c_mktsegment\":' || cast(to_json(c_mktsegment) as varchar) || ',\"c_name\":' || cast(to_json(c_name) as varchar) || ',\"c_nationkey\":' || c_nationkey || '}}'"
    text_json = lambda c: f"cast(to_json({c}) as varchar)"
    flat = "trim(regexp_replace(text, '[\\x{9}-\\x{D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))"
    short = lambda x: f"left(sha256({x}), 16)"
    order = "'{\"o_orderdate\":\"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '\",\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":' || cast(to_json(o_orderstatus) as varchar) || ',\"o_totalprice\":' || cast(o_totalprice as varchar) || '}'"
    fields = " union all ".join(f"select cast(c_custkey as varchar) as id, '/{c}' as path, {short(x)} as field_hash from customer" for c, x in (("c_acctbal", balance), ("c_custkey", "cast(c_custkey as varchar)"), ("c_mktsegment", "cast(to_json(c_mktsegment) as varchar)"), ("c_name", "cast(to_json(c_name) as varchar)"), ("c_nationkey", "cast(c_nationkey as varchar)")))
    line = "'k:' || left(sha256('[' || l_orderkey || ',' || l_linenumber || ']'), 16)"
    return {
        "read_json_lines": f"""select '{{"doc_id":' || doc_id || ',"lang":' || coalesce({text_json("lang")}, 'null') || ',"text":' || coalesce({text_json("text")}, 'null') || '}}' as data, true as usable from documents""",
        "read_json": f"""select '{{"n_name":' || {text_json("n_name")} || ',"n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}}' as data, true as usable from nation""",
        "read_csv": f"""select '{{"p_brand":' || {text_json("p_brand")} || ',"p_name":' || {text_json("p_name")} || ',"p_partkey":"' || p_partkey || '","p_type":' || {text_json("p_type")} || '}}' as data, true as usable from part""",
        "read_parquet": f"""select '{{"o_orderkey":' || o_orderkey || ',"o_totalprice":' || cast(o_totalprice as varchar) || ',"state":{{"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '","o_orderstatus":' || {text_json("o_orderstatus")} || '}}}}' as data, true as usable from orders""",
        "read_csv_ranges": f"""select row_number() over (order by o_orderkey, cast(o_custkey as varchar), o_orderpriority, o_orderstatus) as position, '{{"customer":"' || o_custkey || '","note":' || {text_json("o_orderpriority || chr(10) || '' || chr(34) || 'x' || chr(34) || ',' || chr(13) || chr(10) || o_orderstatus")} || ',"o_orderkey":"' || o_orderkey || '"}}' as data, true as usable from orders""",
        "read_json_ranges": f"""select row_number() over (order by c_custkey) as position, '{{"c_custkey":' || c_custkey || ',"more":{{"note":' || {text_json("c_mktsegment || ' }],' || chr(34) || '{[ ' || chr(92)")} || ',"pair":[' || c_nationkey || ',' || c_nationkey || ']}}}}' as data, true as usable from customer""",
        "read_directory": "select ending, count(*) as n, count(*) as ids from customer, (values ('jsonl'), ('csv'), ('parquet')) t(ending) group by ending",
        "detected_matching": "select format, field, case field when 'id' then 'id' else 'content' end as matched_by from (values ('lines'), ('json'), ('csv'), ('parquet')) a(format), (values ('id'), ('other')) b(field)",
        "strict_json_errors": "select cast(n_nationkey * 9 + c as bigint) as pos, c = 0 as usable from nation, (select unnest(range(9)) as c)",
        "normalised_text": f"""select '{{"accents":' || replace({text_json("p_name || ' ' || chr(233) || chr(769) || ' '")}, ' "', ' ') || '\\u001f\\t","p_partkey":' || p_partkey || ',"price":' || cast(p_retailprice * 1e18 as varchar) || ',"sizes":[' || p_size || ',null]}}' as data from part""",
        "canonical_policy": f"""with x as (select p_partkey, '{{"numbers":[' || array_to_string(list_sort([cast(p_size as varchar), 'null', cast(p_partkey as varchar)]), ',') || '],"objects":[' || array_to_string(list_sort(['{{"a":0,"z":null}}', '{{"a":' || p_size || ',"z":' || {text_json("p_type")} || '}}']), ',')
            || '],"p_partkey":' || p_partkey || ',"pairs":[[' || array_to_string(list_sort([{text_json("p_brand")}, {text_json("p_type")}]), ',') || ']],"words":[' || array_to_string(list_sort([{text_json("p_type")}, {text_json("p_brand || ' fi'")}]), ',') || ']}}' as record from part)
            select cast(p_partkey as varchar) as raw_id, record, {short("record")} as hash from x""",
        "lowered_values": f"""select '{{"bytes":"' || base64(encode(o_orderpriority)) || '","days":["' || strftime(o_orderdate, '%Y-%m-%d') || '",null],"exact":"' || cast(cast(floor(o_totalprice) as decimal(12,2)) as varchar) || '","o_orderkey":' || o_orderkey
            || ',"odd":' || case o_orderkey % 3 when 0 then '"nan"' when 1 then '"-inf"' else 'null' end || ',"pairs":[[' || {text_json("o_orderstatus")} || ',' || (o_orderkey % 5) || ']]}}' as data from orders""",
        "diff_clustered_snapshots": _ORDERS + "select kind, count(*) as n from k group by kind",
        "snapshot_command": _ORDERS + """, c as (select count(*) filter (where kind = 'changed' and fields <> ['/o_totalprice']) as n from k), o as (select count(*) as n, count(distinct o_orderpriority) as p from orders)
            select name, cast(status as bigint) as status, case name when 'file' then format('{:,}', o.n) || ' records, matched by id field ''o_orderkey''' when 'tables' then format('{:,}', o.n) || ' records, matched by id field ''o_orderkey'''
              when 'repeats' then format('{:,}', o.n) || ' records (' || format('{:,}', o.n - o.p) || ' with a repeated id), matched by id field ''o_orderpriority'''
              when 'same' then 'records matched by id field ''o_orderkey'', ignoring o_totalprice / changed 0' when 'changed' then 'records matched by id field ''o_orderkey'', ignoring o_totalprice / changed ' || format('{:,}', c.n) else '' end as said, status = 2 as failed
            from c, o, (values ('file', 0), ('tables', 0), ('repeats', 0), ('same', 0), ('changed', 1), ('other id', 2), ('other fields', 2), ('same path', 2)) t(name, status)""",
        "report_notes": """with n as (select count(*) as before, count(*) filter (where o_orderkey % 3 > 0) as after, count(*) - count(distinct o_custkey) as b, count(*) filter (where o_orderkey % 3 > 0) - count(distinct case when o_orderkey % 3 > 0 then o_custkey end) as a from orders),
            w as (select *, cast(greatest(5, length(format('{:,}', before))) as integer) as w from n)
            select unnest(range(0, 20)) as line, unnest(['orders -> orders', 'records matched by id field ''o_custkey'', ignoring o_orderkey', '', '  before      ' || lpad(format('{:,}', before), w, ' '), '  after       ' || lpad(format('{:,}', after), w, ' '), '',
              '  unchanged   ' || lpad('0', w, ' '), '  changed     ' || lpad(format('{:,}', after), w, ' '), '  removed     ' || lpad(format('{:,}', before - after), w, ' '), '  added       ' || lpad('0', w, ' '),
              '  note: ' || format('{:,}', b) || ' repeated IDs in before (orders), numbered #2, #3, ...', '  note: ' || format('{:,}', a) || ' repeated IDs in after (orders), numbered #2, #3, ...', '',
              'fields changed (records)', '  /o_new  ' || lpad(format('{:,}', after), w, ' '), '  /o_old  ' || lpad(format('{:,}', after), w, ' '), '', 'schema', '  + /o_new', '  - /o_old']) as text from w""",
        "snapshot_round_trip": "select form, count(*) as records, count(*) as unchanged, false as changes, true as recognised from orders, (values ('file'), ('tables')) t(form) group by form",
        "report_lines": _ORDERS + """, n as (select (select count(*) from a) as before, (select count(*) from b) as after, count(*) filter (where kind = 'unchanged') as unchanged, count(*) filter (where kind = 'changed') as changed,
              count(*) filter (where kind = 'removed') as removed, count(*) filter (where kind = 'added') as added from k),
            f as (select row_number() over (order by n desc) as i, path, n from (select path, count(*) as n from (select unnest(fields) as path from k where kind = 'changed') group by path)),
            w as (select cast(greatest(5, length(format('{:,}', before)), length(format('{:,}', after))) as integer) as w from n)
            select unnest(range(0, 10)) as line, unnest(['table -> table', 'records matched by id field ' || chr(39) || 'o_orderkey' || chr(39), '', '  before      ' || lpad(format('{:,}', before), w, ' '), '  after       ' || lpad(format('{:,}', after), w, ' '), '',
              '  unchanged   ' || lpad(format('{:,}', unchanged), w, ' '), '  changed     ' || lpad(format('{:,}', changed), w, ' '), '  removed     ' || lpad(format('{:,}', removed), w, ' '), '  added       ' || lpad(format('{:,}', added), w, ' ')]) as text from n, w
            union all select * from (values (10, ''), (11, 'fields changed (records)'))
            union all select 11 + i, '  ' || rpad(path, (select max(length(path)) from f)::int, ' ') || '  ' || lpad(format('{:,}', n), (select w from w)::int, ' ') from f""",
        "report_examples": _ORDERS + """, picked as (select k, kind, fields, row_number() over (partition by kind order by k) as i from k), e as (
              select picked.k, kind, case kind when 'changed' then 0 when 'removed' then 1 else 2 end as s, fields, a.o_orderpriority as p0, b.o_orderpriority as p1, a.o_totalprice as t0, b.o_totalprice as t1
              from picked left join a on a.o_orderkey = picked.k left join b on b.o_orderkey = picked.k where i <= 3 and kind <> 'unchanged'),
            l as (select s, k, 0 as f, '  ' || rpad(kind, 11, ' ') || k as text from e
              union all select s, k, 1 + i, ['             /o_orderpriority', '               - "' || p0 || '"', '               + "' || p1 || '"'][i] from e, (select unnest([1, 2, 3]) as i) where s = 0 and list_contains(fields, '/o_orderpriority')
              union all select s, k, 5 + i, ['             /o_totalprice', '               - "' || t0 || '"', '               + "' || t1 || '"'][i] from e, (select unnest([1, 2, 3]) as i) where s = 0 and list_contains(fields, '/o_totalprice'))
            select row_number() over (order by s, k, f) - 1 as line, text from l""",
        "report_json": "with x as (select * from customer where c_custkey % 2 = 0 and c_acctbal <> 0.5) select cast(c_custkey as varchar) as id, '/c_acctbal' as fields, (select count(*) from x) as n_changed, false as order_changed from x",
        "command_line": "select * from (values ('same', 0::bigint), ('other', 1::bigint), ('none', 2::bigint)) t(name, status)",
        "diff_counts_by_id": _ORDERS + "select kind, count(*) as n from k group by kind",
        "diff_ignore_fields": _ORDERS + "select case when kind = 'changed' and fields = ['/o_totalprice'] then 'unchanged' else kind end as kind, count(*) as n from k group by 1",
        "diff_changed_fields": _ORDERS + _CHANGED,
        "diff_field_counts": _ORDERS + _COUNTS,
        "diff_top_fields": _ORDERS + _COUNTS + " limit 1",
        "diff_removed": _ORDERS + "select cast(k as varchar) as id, cast(k as varchar) as label from k where kind = 'removed'",
        "diff_added": _ORDERS + "select cast(k as varchar) as id, cast(k as varchar) as label from k where kind = 'added'",
        "diff_first_examples": _ORDERS + _CHANGED + " order by k limit 3",
        "diff_order_changed": _ORDERS + ", r as (select k, row_number() over (order by k) as x, row_number() over (order by -k) as y from k where not new and not gone) select 'same' as version, bool_or(x <> x) as order_changed from r union all select 'reversed', bool_or(x <> y) from r",
        "diff_key_edited": _DOCUMENTS + "select before_id, id, fields from pairs",
        "diff_key_counts": _DOCUMENTS + """select * from (values
            ('unchanged', (select count(*) from o join m using (id) where o.rest = m.rest)), ('changed', (select count(*) from o join m using (id) where o.rest <> m.rest)),
            ('key_edited', (select count(*) from pairs)), ('removed', (select count(*) from gone) - (select count(*) from pairs)), ('added', (select count(*) from new) - (select count(*) from pairs)),
            ('duplicates_before', (select count(*) from o where again)), ('duplicates_after', (select count(*) from m where again))) t(kind, n)""",
        "diff_content": """with v as (select 0 as side, doc_id, text, lang from documents union all select 1, doc_id, case when doc_id % 13 = 0 then text || ' (edited)' else text end, lang from documents where doc_id % 11 <> 0),
            n as (select side, text, lang, row_number() over (partition by side, text, lang order by doc_id) as i from v)
            select case when b.i is null then 'removed' when a.i is null then 'added' else 'unchanged' end as kind, count(*) as n
            from (select * from n where side = 0) a full join (select * from n where side = 1) b on a.text is not distinct from b.text and a.lang is not distinct from b.lang and a.i = b.i group by 1""",
        "duplicate_numbering": f"with x as (select {line} as raw_id from lineitem), y as (select raw_id, row_number() over (partition by raw_id) as i from x) select raw_id, raw_id || case when i > 1 then '#' || i else '' end as id from y",
        "duplicate_count": "select count(*) - (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem)) as duplicates from lineitem",
        "record_hash": f"select cast(c_custkey as varchar) as id, {short(record)} as hash from customer",
        "field_hash": fields,
        "key_hash": f"select o_orderkey as pos, 'k:' || {short("'[' || cast(to_json(o_orderpriority) as varchar) || ',' || o_custkey || ']'")} as raw_id, {short("'{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":' || cast(to_json(o_orderstatus) as varchar) || '}'")} as rest, o_orderpriority || ' | ' || o_custkey as label from orders",
        "content_label": f"select doc_id as pos, case when text is null or text = '' then {short("'{\"doc_id\":' || doc_id || ',\"text\":' || coalesce(cast(to_json(text) as varchar), 'null') || '}'")} when length({flat}) <= 72 then {flat} else left({flat}, 69) || '...' end as label from documents",
        "schema_profile": "select path, type, count(*) as n from (select unnest([{'path': '/o_orderkey', 'type': 'integer'}, {'path': '/o_custkey', 'type': 'integer'}, {'path': '/o_orderstatus', 'type': case when o_orderkey % 5 <> 0 then 'string' else 'null' end}, {'path': '/o_totalprice', 'type': 'number'}, {'path': '/o_orderdate', 'type': 'string'}, {'path': '/o_orderpriority', 'type': 'string'}], recursive := true) from orders) group by all",
        "report_file": """
            with x as (select cast(o_orderkey as varchar) as id, '/price/c' || cast(o_custkey as varchar) as path, o_orderkey % 11 = 0 as gone, o_orderkey % 5 = 0 as edited from orders)
            select 'fields' as section, path as name, cast(count(*) as varchar) as value from x where edited and not gone group by path
            union all select 'changed', id, path from x where edited and not gone
            union all select 'removed', id, null from x where gone
            union all select 'schema removed', path, null from x group by path having bool_and(gone)""",
        "schema_drift": "select * from (values ('/o_orderstatus', 'removed', 'string', null), ('/o_custkey', 'retyped', 'integer', 'string'), ('/o_note', 'added', null, 'string')) t(path, change, before, after)",
        "dataset_hash": f"with e as (select cast(o_orderkey as varchar) as id, o_orderkey, {short(order)} as hash from orders) select sha256('[' || string_agg('[\"' || id || '\",\"' || hash || '\"]', ',' order by id, hash) || ']') as dataset_hash, sha256('[' || string_agg('\"' || id || '\"', ', ' order by o_orderkey) || ']') as order_hash from e",
        "nested_leaves": "select event_id as pos, '/props/k' as path, cast(json_extract(props, '$.k') as varchar) as json from events",
        "strict_json_text": f"select event_id as pos, {short("'{\"k\":' || cast(json_extract(props, '$.k') as varchar) || '}'")} as hash, cast(json_extract(props, '$.k') as varchar) as k from events",
        "typed_text": f"select o_orderkey, {order} as json from orders",
    }
