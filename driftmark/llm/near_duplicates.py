"""MinHash near-duplicate groups with sequential Bayesian verification.

1. Every text becomes its set of distinct five-word shingles (64-bit hashes),
   a fingerprint of the set and a 128-value MinHash signature.
2. Texts with equal sets are one class, found by a plain aggregation; from
   here on only one representative of each class takes part, however often it
   was copied.
3. Signatures are cut into 32 bands of 4 values; representatives that agree
   on a band are candidates (a pair at similarity 0.75 is missed with
   probability (1 - 0.75**4)**32, about 5e-6).
4. Candidates with too many shingles of their own to reach the threshold with
   any other leave.  Each bucket's members are first compared with one pivot,
   those of crowded buckets with some more.  A bucket of which a few members
   are then outside its largest group is compared pair by pair, another in
   bounded blocks (where crowds are light all in all, at once and without
   further pivots): a task takes two chunks of the bucket's members and returns
   a spanning forest of their links, so no group is listed as pairs and no
   possible link is dropped.  Members that are in one group already, or that
   met in another bucket's blocks, are not compared again.
5. A pair's signatures are compared 16 values at a time; the pair is pruned as
   soon as the posterior probability that its similarity reaches the threshold
   falls below ``MISS``.  Survivors are verified on their full sets.
6. Verified links go to :func:`components`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialise
from .columns import few
from .components import components
from .words import BLANK_RULE, blocks, grams, mix

K = 5
BANDS, ROWS = 32, 4
SIGNATURE = BANDS * ROWS
BATCH = 16
MISS = 1e-6
PERCENT = 75
#: A bucket with at most so many members outside its largest group is compared pair by pair, another in blocks.
FEW = 4
#: Second pivots of a crowded bucket.
PIVOTS = 8
#: Members of a bucket that are joined in one task.
CROWD = 4096
#: Units of a chunk of a block: shingles, and UNIT more for each member (8 MB of shingles, at most about 2,000 members).
CHUNK, UNIT = 1_000_000, 500
#: Crowded buckets with at most so many pairs (of two members, either way round) in all are compared in blocks at once: the steps that spare comparisons would cost more.
LIGHT = 50_000_000
#: Signatures of up to so many bytes, as JSON, are sent to all executors; beyond, the same joins shuffle.
SENT = 8 << 20

_MULTIPLY = mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(1001, SIGNATURE + 1001, dtype=np.uint64))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of 128 hash functions over a set, as uint32."""
    low = np.full(SIGNATURE, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 512):
        np.minimum(low, (shingles[i : i + 512, None] * _MULTIPLY + _ADD).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _sets(batches: Iterator[pa.RecordBatch], with_set: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, block in blocks(batch, "text", BLANK_RULE):
            words = block.hashes()
            runs = grams(words, K)
            counts, keys, signatures, sets = [], [], [], []
            for a, b in zip(block.first[:-1], block.first[1:], strict=True):
                if b - a >= K:
                    own = np.unique(runs[a : b - K + 1])
                elif b > a:
                    own = grams(words[a:b], int(b - a)) ^ np.uint64(b - a)
                else:
                    own = np.zeros(0, dtype=np.uint64)
                raw = own.tobytes()
                counts.append(len(own))
                keys.append(hashlib.blake2b(raw, digest_size=16).digest())
                signatures.append(signature(own).tobytes() if len(own) else None)
                sets.append(raw)
            out = {"doc_id": part.column(part.schema.get_field_index("doc_id")), "text_hash": part.column(part.schema.get_field_index("text_hash")), "n_shingles": pa.array(counts, pa.int64()), "set_key": pa.array(keys, pa.binary()), "signature": pa.array(signatures, pa.binary())}
            if with_set:
                out["shingles"] = pa.array(sets, pa.binary())
            yield pa.RecordBatch.from_pydict(out)


_SCHEMA = "doc_id long, text_hash long, n_shingles long, set_key binary, signature binary"


def least_matches(threshold: float = PERCENT / 100, miss: float = MISS) -> list[int]:
    """For 16, 32, ... compared values, the fewest equal ones with which a pair goes on.

    With a uniform prior the posterior of the similarity after m of n equal
    values is Beta(m+1, n-m+1), whose upper tail at the threshold is the
    chance of at most m successes in n+1 trials.
    """
    out = []
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                out.append(m)
                break
    return out


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sa, sb) whose signatures leave the threshold possible, as (a, b)."""
    least = least_matches()
    for batch in batches:
        n = batch.num_rows
        left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint32).reshape(n, SIGNATURE) for i in (2, 3))
        alive, equal = np.arange(n), np.zeros(n, dtype=np.int64)
        for step, fewest in enumerate(least):
            cols = slice(step * BATCH, (step + 1) * BATCH)
            equal[alive] += (left[alive, cols] == right[alive, cols]).sum(axis=1)
            alive = alive[equal[alive] >= fewest]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive))], ["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sa, sb) that reach the threshold on their full sets, as (a, b)."""
    for batch in batches:
        keep = []
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=np.uint64) for c in (2, 3))
            if len(x) > len(y):
                x, y = y, x
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
            if both and 100 * both >= PERCENT * (len(x) + len(y) - both):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])


def _both(pairs: DataFrame, facts: DataFrame, column: str) -> DataFrame:
    left = facts.select(F.col("node").alias("a"), F.col(column).alias("sa"))
    right = facts.select(F.col("node").alias("b"), F.col(column).alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")


def _links(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    kept = _both(pairs, few(facts.select("node", "signature"), size=SENT), "signature").mapInArrow(_promising, "a long, b long")
    return _both(kept, facts, "shingles").mapInArrow(_verified, "a long, b long")


def _few(rows: DataFrame) -> DataFrame:
    """``rows`` written, and marked for broadcast if they are few enough to be sent everywhere."""
    return few(materialise(rows, "few"))


def groups(documents: DataFrame) -> DataFrame:
    """Near-duplicate groups of ``documents`` (doc_id, text, any other columns).

    Returns doc_id, text_hash, n_shingles, set_key, component_id, kept, first_copy for every row.

    Texts of fewer than five words are one shingle, their whole word sequence.
    Null, empty and wordless texts have no shingle, link with nothing and form
    their own component.  A null doc_id takes part; it never names a component
    unless all of the component's ids are null.  Rows that repeat a doc_id are
    rows of their own.  ``kept`` holds where doc_id is the component's smallest
    (null-safe); ``first_copy`` holds for exactly one row of each component.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    # the row number is frozen by the write; signatures stay with their rows
    rows = materialise(docs.mapInArrow(lambda it: _sets(it, False), _SCHEMA).withColumn("row", F.monotonically_increasing_id()), "signatures")
    classes = rows.where("n_shingles > 0").groupBy("set_key").agg(F.min("row").alias("node"), F.count("*").alias("rows"))
    classes = materialise(classes, "classes")
    nodes = rows.join(classes.select(F.col("node").alias("row")), "row").select(F.col("row").alias("node"), "doc_id", "text_hash", "set_key", "signature")
    bands = nodes.select("node", F.explode(F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(signature, i * {4 * ROWS} + 1, {4 * ROWS})))")).alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = materialise(bands.join(shared, "bucket"), "members")
    wanted = materialise(nodes.drop("signature").join(members.select("node").distinct(), "node"), "wanted")
    places = few(wanted.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))
    # one text of each class is read again, however many rows repeat it
    again = docs.join(places, docs["doc_id"].eqNullSafe(places["_id"]) & (docs["text_hash"] == places["_hash"]), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    full = again.mapInArrow(lambda it: _sets(it, True), _SCHEMA + ", shingles binary")
    facts = full.join(few(wanted.select("node", "set_key")), "set_key").select("node", "signature", "shingles")
    facts = materialise(facts, "facts")
    found = _compare(_possible(members, facts), facts)
    # a class of one row without a link needs no look-up
    nodes = classes.join(found, "node", "left").where("`rows` > 1 or comp is not null").select("set_key", F.coalesce("comp", "node").alias("comp"))
    return _result(rows, nodes)


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            own = np.frombuffer(batch.column(1)[i].as_buffer(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), batch.column(0)[i].as_py())), pa.array(own)], ["node", "shingle"])


def _possible(members: DataFrame, facts: DataFrame) -> DataFrame:
    """Members (node, bucket, n, c) that may still have a link; n is the set's size, c a bound on any intersection.

    A shingle that no other candidate has lies in no intersection, so with c
    other shingles a set of n meets one of size m with similarity at most
    c / (n + m - c).  This drops, without comparing anything, texts that only
    share a passage, and copies with too many edits of their own.
    """
    held = facts.select("node", "shingles").mapInArrow(_shingle_rows, "node long, shingle long")
    common = held.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1")
    bounds = held.join(common, "shingle", "left").groupBy("node").agg(F.count("times").alias("c"), F.count("*").alias("n")).where(f"100 * c >= {PERCENT} * n")
    left = materialise(members.join(bounds, "node"), "bounded")
    least = left.groupBy("bucket").agg(F.min("n").alias("least"), F.count("*").alias("k")).where("k > 1")
    return materialise(left.join(_few(least), "bucket").where(_within("n", "least", "c")).select("node", "bucket", "n", "c", "k"), "possible")


def _within(n: str, m: str, c: str) -> str:
    """SQL: sets of sizes n and m with at most c common members can reach the threshold."""
    return f"{PERCENT} * ({n} + {m} - {c}) <= 100 * {c}"


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """All links between two chunks of a dense block (or within one), reduced to a spanning forest of (a, b).

    Signatures are compared first, in steps; exact intersections of the
    survivors come from products of 0/1 matrices over slices of the shingles
    that occur more than once here.
    """
    none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    one = pdf["ci"].iloc[0] == pdf["cj"].iloc[0]
    left = pdf if one else pdf[pdf["chunk"] == pdf["ci"]]
    right = pdf if one else pdf[pdf["chunk"] == pdf["cj"]]
    if not len(left) or not len(right):
        return none
    # a null `seen` is NaN here and equals nothing
    alive = np.logical_and(*(left[x].to_numpy()[:, None] != right[x].to_numpy()[None, :] for x in ("comp", "seen")))
    if one:
        alive = np.triu(alive, 1)
    equal = np.zeros(alive.shape, dtype=np.int16)
    sl, sr = (np.frombuffer(b"".join(x["signature"]), dtype=np.uint32).reshape(len(x), SIGNATURE) for x in (left, right))
    for step, fewest in enumerate(least_matches()):
        for k in range(step * BATCH, (step + 1) * BATCH):
            equal += sl[:, k, None] == sr[None, :, k]
        alive &= equal >= fewest
    if not alive.any():
        return none
    xs, ys = ([np.frombuffer(s, dtype=np.uint64) for s in x["shingles"]] for x in (left, right))
    nx, ny = (np.array([len(s) for s in x]) for x in (xs, ys))
    known = np.intersect1d(np.concatenate(xs), np.concatenate(ys))
    both = np.zeros(alive.shape, dtype=np.float32)

    def matrix(sets: list[np.ndarray], some: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sets), len(some)), dtype=np.float32)
        for r, s in enumerate(sets):
            at = np.minimum(np.searchsorted(some, s), len(some) - 1)
            out[r, at[some[at] == s]] = 1
        return out

    for k in range(0, len(known), 4096):
        both += matrix(xs, known[k : k + 4096]) @ matrix(ys, known[k : k + 4096]).T
    alive &= 100 * both >= PERCENT * (nx[:, None] + ny[None, :] - both)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    ids_l, ids_r, out = left["node"].to_numpy(), right["node"].to_numpy(), []
    for r, s in zip(*np.nonzero(alive), strict=True):
        a, b = find(int(ids_l[r])), find(int(ids_r[s]))
        if a != b:
            root[a] = b
            out.append((int(ids_l[r]), int(ids_r[s])))
    return pd.DataFrame(out, columns=["a", "b"]) if out else none


def _live(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members (bucket, node, n, c) of buckets that hold more than one component, with comp, k (the bucket's members), big (its largest component) and few.

    ``few`` says that so few members are outside the largest component that
    comparing each of them with all of the bucket takes at most FEW pairs a member.
    """
    members = members.join(few(found), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    parts = members.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    stats = parts.groupBy("bucket").agg(F.sum("k").alias("k"), F.count("*").alias("comps"), F.max(F.struct("k", "comp")).alias("most")).where("comps > 1")
    stats = stats.select("bucket", "k", F.col("most.comp").alias("big"), (F.col("k") - F.col("most.k") <= FEW).alias("few"))
    return materialise(members.select("bucket", "node", "n", "c", "comp").join(_few(stats), "bucket"), "live")


def _met(members: DataFrame, mine: DataFrame, once: str) -> DataFrame:
    """Distinct pairs (a, b) of members (with k) and the chosen nodes ``mine`` (bucket, p, pn, pc, k, ...) of their buckets.

    A crowded bucket is dealt in parts of about CROWD members and the chosen
    nodes are sent to each, so no bucket is joined in one task.
    """
    parts = F.ceil(F.col("k") / CROWD).cast("int")
    left = members.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).drop("k")
    right = _few(mine.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("k"))
    on = (left["bucket"] == right["bucket"]) & (left["part"] == right["part"]) & F.expr(once) & F.expr(_within("n", "pn", "least(c, pc)"))
    return left.join(right, on).select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()


def _blocks(members: DataFrame, facts: DataFrame, settled: str) -> DataFrame:
    """Links among members (bucket, node, n, comp, seen) of crowded buckets; pairs with equal ``settled`` need no comparison.

    Within its bucket each settled class of more than CHUNK units is dealt in
    chunks of its own, smaller ones share chunks; a unit is a shingle, and a
    member has UNIT more.  A pair of chunks is one task of bounded memory,
    and pairs of chunks of one class are left out.
    """
    weight = F.sum(F.col("n") + UNIT)
    parts = members.groupBy("bucket", settled).agg(weight.alias("w"))
    large = parts.where(F.col("w") > CHUNK).select("bucket", settled, F.ceil(F.col("w") / CHUNK).alias("own"))
    bins = parts.where(F.col("w") <= CHUNK).groupBy("bucket").agg(F.ceil(F.sum("w") / CHUNK).alias("bins"))
    dealt = members.join(_few(large), ["bucket", settled], "left").join(_few(bins), "bucket", "left")
    chunk = F.when(F.col("own").isNotNull(), F.xxhash64(settled, F.pmod(F.xxhash64("node"), F.col("own")))).otherwise(F.pmod(F.xxhash64(settled), F.col("bins")))
    dealt = materialise(dealt.withColumn("chunk", chunk).withColumn("class", F.when(F.col("own").isNotNull(), F.col(settled))).drop("own", "bins", "n"), "chunks")
    chunks = dealt.select("bucket", "chunk", "class").distinct()
    other = chunks.select("bucket", F.col("chunk").alias("cj"), F.col("class").alias("other"))
    pairs = chunks.join(other, "bucket").where("chunk <= cj and (class is null or other is null or class <> other)").select("bucket", F.col("chunk").alias("ci"), "cj")
    sides = pairs.select("bucket", F.col("ci").alias("chunk"), "ci", "cj").unionByName(pairs.where("ci <> cj").select("bucket", F.col("cj").alias("chunk"), "ci", "cj"))
    return dealt.join(sides, ["bucket", "chunk"]).join(facts, "node").groupBy("bucket", "ci", "cj").applyInPandas(_forest, "a long, b long")


def _light(crowded: DataFrame) -> bool:
    """Whether so few pairs share a crowded bucket that comparing all of them is little work; a member stands for k pairs."""
    return (crowded.agg(F.sum("k")).first()[0] or 0) <= LIGHT


def _crowded_links(members: DataFrame, facts: DataFrame, light: bool = False) -> DataFrame:
    """All links of crowded buckets, where these are not ``light`` in two waves: the largest bucket of each node, then what they left."""
    members = members.select("bucket", "node", "n", "comp", "k")
    if light:
        return _blocks(members.withColumn("seen", F.lit(None).cast("long")), facts, "comp")
    first = members.groupBy("node").agg(F.max(F.struct("k", "bucket")).alias("most")).select(F.col("most.bucket").alias("bucket")).distinct()
    first = materialise(first, "waves")
    wave = members.join(_few(first), "bucket", "left_semi").withColumn("seen", F.lit(None).cast("long"))
    links = materialise(_blocks(wave, facts, "comp"), "crowd")
    # two nodes that were in one bucket of the first wave have been compared
    seen = wave.groupBy("node").agg(F.min("bucket").alias("seen"))
    now = components(links.unionByName(members.select(F.col("node").alias("a"), F.col("comp").alias("b")).distinct()))
    rest = members.drop("comp").join(_few(first), "bucket", "left_anti").join(seen, "node").join(now, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_ = rest.groupBy("bucket").agg((F.min("comp") < F.max("comp")).alias("comps"), (F.min("seen") < F.max("seen")).alias("seens")).where("comps and seens").select("bucket")
    rest = materialise(rest.join(_few(open_), "bucket", "left_semi"), "rest")
    return links if rest.isEmpty() else links.unionByName(_blocks(rest, facts, "seen"))


def _compare(members: DataFrame, facts: DataFrame) -> DataFrame:
    """(node, comp) of all nodes that have a verified link; see step 4 above."""
    # the member with the fewest shingles of its own is the likeliest to link with many
    best = members.groupBy("bucket").agg(F.max(F.struct(F.col("c") / F.col("n"), (-F.col("node")).alias("minus"), "n", "c")).alias("best"), F.count("*").alias("k"))
    mine = best.select("bucket", (-F.col("best.minus")).alias("p"), F.col("best.n").alias("pn"), F.col("best.c").alias("pc"), "k")
    found = materialise(components(_links(_met(members, mine, "node <> p"), facts)), "found")
    old = lambda: found.select(F.col("node").alias("a"), F.col("comp").alias("b"))
    live = _live(members, found)
    crowded = live.where("not few")
    light = _light(crowded)
    if not light:
        picked = crowded.groupBy("bucket", F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("pick")).agg(F.min(F.struct(F.xxhash64("node"), "node", "n", "c", "comp", "k")).alias("one"))
        mine = picked.select("bucket", F.col("one.node").alias("p"), F.col("one.n").alias("pn"), F.col("one.c").alias("pc"), F.col("one.comp").alias("other"), F.col("one.k").alias("k"))
        found = materialise(components(_links(_met(crowded, mine, "comp <> other"), facts).unionByName(old())), "found")
        live = _live(members, found)
        crowded = live.where("not few")
    some = live.where("few")
    mine = some.where("comp <> big").select("bucket", F.col("node").alias("p"), F.col("n").alias("pn"), F.col("c").alias("pc"), F.col("comp").alias("other"), "k")
    links = _links(_met(some, mine, "comp <> other and (comp = big or node < p)"), facts)
    if not crowded.isEmpty():
        links = links.unionByName(_crowded_links(crowded, facts, light))
    links = materialise(links, "late_links")
    return found if links.isEmpty() else materialise(components(links.unionByName(old())), "found")


def _result(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    rows = rows.select("doc_id", "text_hash", "n_shingles", "set_key", "row").join(_few(nodes), "set_key", "left")
    comp = F.when(F.col("n_shingles") > 0, F.coalesce("comp", "row")).otherwise(-1 - F.col("row"))
    with_comp = materialise(rows.withColumn("comp", comp), "components")
    # null ids sort last in the struct that picks a component's first row
    heads = with_comp.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("head"), F.count("*").alias("n")).where("n > 1")
    out = with_comp.join(_few(heads.select("comp", "head")), "comp", "left")
    alone = F.col("head").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id"))
    out = out.withColumn("component_id", component).withColumn("first_copy", alone | (F.col("row") == F.col("head.row")))
    return out.select("doc_id", "text_hash", "n_shingles", "set_key", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "first_copy")
