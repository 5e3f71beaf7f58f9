"""Benchmark decontamination by winnowed k-gram fingerprints.

A window is N consecutive words of a benchmark item (all words of a shorter
item).  Both sides are fingerprinted alike: of the hashes of all K-grams, each
run of N-K+1 of them keeps its minimum.  A shared window holds one such run on
either side, so it shares at least one kept fingerprint.  Fingerprints are
joined; each hit is extended to the windows around it, and a window counts
only if its words are equal to an item's.

Items of fewer than N words cannot be winnowed against longer texts; their
whole word sequence is looked up at every place of a text instead.

If the benchmark's fingerprints and windows are few enough (their number and
bytes are checked) they are sent to all executors and the texts are read once
with no shuffle.  A larger benchmark takes the second way: fingerprints of
both sides are joined by a shuffle, texts with hits are extended, and their
windows are joined with the items' windows.  Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialise
from .words import ALNUM_RULE, Block, blocks, grams

N, K = 10, 5
#: The benchmark is sent to all executors up to so many windows and bytes of window text.
SMALL_WINDOWS, SMALL_BYTES = 200_000, 64 << 20


def winnow(runs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions of the K-grams that are the least of some N-K+1 consecutive ones of one text (all of equal least ones)."""
    width = N - K + 1
    if len(runs) < width:
        return np.zeros(0, dtype=np.int64)
    low = runs[: len(runs) - width + 1].copy()
    for j in range(1, width):
        np.minimum(low, runs[j : j + len(low)], out=low)
    whole = np.zeros(len(low) + 1, dtype=np.int32)  # windows of N words inside one text
    a, b = first[:-1], first[1:] - N + 1
    ok = b > a
    np.add.at(whole, np.minimum(a[ok], len(low)), 1)
    np.add.at(whole, np.minimum(b[ok], len(low)), -1)
    low[np.cumsum(whole[:-1]) == 0] = 0  # no text's window: keeps nothing (a hash of 0 at most adds a candidate)
    high = np.zeros(len(runs), dtype=np.uint64)
    for j in range(width):
        np.maximum(high[j : j + len(low)], low, out=high[j : j + len(low)])
    return np.flatnonzero(runs == high)


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, block in blocks(batch, "text", ALNUM_RULE):
            ids = part.column(part.schema.get_field_index("item_id")).to_pylist()
            kept = set(winnow(grams(block.hashes(), K), block.first).tolist())
            runs = grams(block.hashes(), K).astype(np.int64)
            items, lengths, windows, prints = [], [], [], []
            for item, a, b in zip(ids, block.first[:-1].tolist(), block.first[1:].tolist(), strict=True):
                n = min(N, b - a)
                for i in range(a, b - n + 1 if n else a):
                    items.append(item)
                    lengths.append(n)
                    windows.append(block.joined(i, i + n))
                    prints.append([int(runs[j]) for j in range(i, i + N - K + 1) if j in kept] if n == N else [])
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(lengths, pa.int32()), pa.array(windows, pa.binary()), pa.array(prints, pa.list_(pa.int64()))], ["item_id", "n", "window", "prints"])


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id string, n, window, prints) for each window of each item; items without words have none."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return items.mapInArrow(_item_windows, "item_id string, n int, window binary, prints array<long>")


def _places(block: Block, runs: np.ndarray, hits: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, first word, last word + 1) of the windows of N words that hold a hit fingerprint."""
    texts = np.searchsorted(block.first, hits, side="right") - 1
    done = -1
    for hit, t in zip(hits.tolist(), texts.tolist(), strict=True):
        for i in range(max(int(block.first[t]), hit - (N - K), done + 1), min(hit, int(block.first[t + 1]) - N) + 1):
            done = i
            yield t, i, i + N


def _short_places(block: Block, hashes: np.ndarray, wanted: dict[int, np.ndarray]) -> Iterator[tuple[int, int, int]]:
    for n, some in wanted.items():
        runs = grams(hashes, n)
        if not len(runs) or not len(some):
            continue
        for i in np.flatnonzero(_among(runs, some)).tolist():
            t = int(np.searchsorted(block.first, i, side="right")) - 1
            if i + n <= block.first[t + 1]:
                yield t, i, i + n


def _among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values occur in the sorted array ``some``."""
    if not len(some):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(some, values)
    at[at == len(some)] = 0
    return some[at] == values


def _covered(spans: list[tuple[int, int]]) -> int:
    total = end = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _short_hashes(windows: list[tuple[int, bytes]]) -> dict[int, np.ndarray]:
    """By length, the sorted hashes of short items' word sequences."""
    out: dict[int, list[int]] = {}
    for n, window in windows:
        if n < N:
            from .words import cut

            out.setdefault(n, []).append(int(grams(cut(pa.array([window.decode()]), ALNUM_RULE).hashes(), n)[0]))
    return {n: np.unique(np.array(v, dtype=np.uint64)) for n, v in out.items()}


def _read_once(batches: Iterator[pa.RecordBatch], prints: np.ndarray, short: dict[int, np.ndarray], items: dict[bytes, list[str]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, block in blocks(batch, "text", ALNUM_RULE):
            hashes = block.hashes()
            runs = grams(hashes, K)
            kept = winnow(runs, block.first)
            hits = kept[_among(runs[kept], prints)]
            spans: dict[int, list[tuple[int, int]]] = {}
            held: dict[int, set[str]] = {}
            for places in (_places(block, runs, hits), _short_places(block, hashes, short)):
                for t, a, b in places:
                    own = items.get(block.joined(a, b))
                    if own:
                        spans.setdefault(t, []).append((a, b))
                        held.setdefault(t, set()).update(own)
            n = len(block)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column(part.schema.get_field_index("doc_id")),
                "text_hash": part.column(part.schema.get_field_index("text_hash")),
                "n_words": pa.array(block.counts(), pa.int64()),
                "n_hit": pa.array([_covered(spans.get(t, [])) for t in range(n)], pa.int64()),
                "items": pa.array([sorted(held.get(t, ())) for t in range(n)], pa.list_(pa.string())),
            })


_SCHEMA = "doc_id long, text_hash long, n_words long, n_hit long, items array<string>"


def scan(documents: DataFrame, benchmark: DataFrame, small: tuple[int, int] = (SMALL_WINDOWS, SMALL_BYTES)) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit and items (sorted distinct ids) for every row of ``documents``.

    Words are runs of ASCII digits, letters (A-Z lower-cased) and characters
    beyond ASCII.  Null and wordless texts have no words and no hits, such
    items no windows; a null item_id is the id ``null``.  Equal windows of
    several items count once in n_hit and once for each item in items.  Rows
    repeated in either table change nothing for others.
    """
    items = benchmark.withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("null")))
    windows = materialise(item_windows(items), "windows")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    n, size = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("window") + F.octet_length("item_id")), F.lit(0))).first()
    if n > small[0] or size > small[1]:
        return _by_joins(docs, windows)
    found: dict[bytes, set[str]] = {}
    prints: set[int] = set()
    lengths: dict[bytes, int] = {}
    for row in windows.toLocalIterator():  # bounded by the check above
        found.setdefault(bytes(row["window"]), set()).add(row["item_id"])
        lengths[bytes(row["window"])] = row["n"]
        prints.update(row["prints"])
    sent = documents.sparkSession.sparkContext.broadcast((
        np.sort(np.array(list(prints), dtype=np.int64).astype(np.uint64)),
        _short_hashes([(k, w) for w, k in lengths.items()]),
        {w: sorted(ids) for w, ids in found.items()},
    ))
    return docs.mapInArrow(lambda batches: _read_once(batches, *sent.value), _SCHEMA)


def _all_prints(batches: Iterator[pa.RecordBatch], lengths: list[int]) -> Iterator[pa.RecordBatch]:
    """Each text's key and its distinct fingerprints, with those of short items' lengths."""
    for batch in batches:
        for part, block in blocks(batch, "text", ALNUM_RULE):
            hashes = block.hashes()
            runs = grams(hashes, K)
            kept = winnow(runs, block.first)
            keys = part.column(part.schema.get_field_index("key"))
            where, prints, kinds = [np.searchsorted(block.first, kept, side="right") - 1], [runs[kept]], [np.full(len(kept), N)]
            for n in lengths:
                short = grams(hashes, n)
                t = np.searchsorted(block.first, np.arange(len(short)), side="right") - 1
                inside = np.arange(len(short)) + n <= block.first[t + 1]
                where.append(t[inside])
                prints.append(short[inside])
                kinds.append(np.full(int(inside.sum()), n))
            t, h, n = np.concatenate(where), np.concatenate(prints).astype(np.int64), np.concatenate(kinds)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(t)), pa.array(h), pa.array(n, pa.int32())], ["key", "print", "n"])


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows (key, start, n, window) around the hit fingerprints of texts (key, text, hits)."""
    for batch in batches:
        for part, block in blocks(batch, "text", ALNUM_RULE):
            hashes = block.hashes()
            runs = grams(hashes, K)
            kept = winnow(runs, block.first)
            keys, hit = part.column(part.schema.get_field_index("key")), part.column(part.schema.get_field_index("hits")).to_pylist()
            wanted: dict[int, set[int]] = {}
            for own in hit:
                for x in own:
                    wanted.setdefault(x["n"], set()).add(x["print"])
            some = {n: np.sort(np.array(list(v), dtype=np.int64).astype(np.uint64)) for n, v in wanted.items()}
            long = some.pop(N, np.zeros(0, dtype=np.uint64))
            rows = [*_places(block, runs, kept[_among(runs[kept], long)]), *_short_places(block, hashes, some)]
            yield pa.RecordBatch.from_arrays([
                keys.take(pa.array([t for t, _, _ in rows], pa.int64())),
                pa.array([a - int(block.first[t]) for t, a, _ in rows], pa.int64()),
                pa.array([b - a for _, a, b in rows], pa.int32()),
                pa.array([block.joined(a, b) for _, a, b in rows], pa.binary()),
            ], ["key", "start", "n", "window"])


def _short_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(n, w) for n, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        pairs = [(n, int(h)) for n, hs in _short_hashes(rows).items() for h in hs.astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array([h for _, h in pairs], pa.int64()), pa.array([n for n, _ in pairs], pa.int32())], ["print", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, block in blocks(batch, "text", ALNUM_RULE):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(block.counts(), pa.int64())], ["doc_id", "text_hash", "key", "n_words"])


def _by_joins(docs: DataFrame, windows: DataFrame) -> DataFrame:
    # texts with the same key have the same words, so repeated rows share one result
    docs = docs.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    lengths = [r["n"] for r in windows.where(f"n < {N}").select("n").distinct().collect()]  # at most N-1 rows
    long = windows.select(F.explode("prints").alias("print")).select("print", F.lit(N).alias("n"))
    short = windows.where(f"n < {N}").select("n", "window").mapInArrow(_short_prints, "print long, n int")
    prints = long.unionByName(short).distinct()
    keyed = docs.select("key", "text")
    hits = keyed.mapInArrow(lambda it: _all_prints(it, lengths), "key string, print long, n int").join(prints, ["print", "n"]).distinct()
    hits = hits.groupBy("key").agg(F.collect_list(F.struct("print", "n")).alias("hits"))
    texts = keyed.join(hits, "key").dropDuplicates(["key"])
    places = texts.mapInArrow(_extended, "key string, start long, n int, window binary").distinct()
    equal = materialise(places.join(windows.select("window").distinct(), "window", "left_semi").select("key", "start", "n", "window"), "hits")
    before = F.max(F.col("start") + F.col("n")).over(_order("key", "start"))
    union = equal.groupBy("key", "start").agg(F.max("n").alias("n")).withColumn("end", F.col("start") + F.col("n")).withColumn("before", before)
    union = union.groupBy("key").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("before", F.lit(0))))).alias("n_hit"))
    held = equal.select("key", "window").distinct().join(windows.select("window", "item_id").distinct(), "window").groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    counted = docs.select("doc_id", "text_hash", "key", "text").mapInArrow(_counted, "doc_id long, text_hash long, key string, n_words long")
    out = counted.join(union, "key", "left").join(held, "key", "left")
    return out.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _order(key: str, position: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
