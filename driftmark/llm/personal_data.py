"""Personal data and the words that give it away.

Addresses, card and phone numbers are found by fixed patterns.  Each distinct
value is a protected entity.  Over the whole corpus the words that stand near
an entity are counted, and all words are.  With c(e) words near e and T words in
all, a word tells log2(p T / c(e)) of the log2(T / c(e)) bits that name the
entity, where p is how surely an occurrence of the word means the entity.  The share of
the word's occurrences that stand within WINDOW words of e is only an estimate
of p; what counts is its lower confidence bound (Wilson's, at Z) for the number of
different texts that it comes from, so support and not rarity decides.  The
same is worked out with the entity's documents in place of the WINDOW for words that stand near
it once.  Where a share reaches GENERALISE (REMOVE), the word is told of the
entity.  A word that only one text has near a value is never told of it, however rare it is.
All counts are of different texts, so copies add nothing: a text counts in the
document with the smallest doc_id.  In each document that holds the
entity all occurrences of a told word, near it or not, are generalised to their
shape (removed).  Documents without the value stay as they are.

Texts are read once to count: entities, nearby words and word counts leave that
pass as rows; counts are combined in each task first, and a frequent entity or
word is only ever summed.  Texts that hold an entity of which words are told
are read again, and their words are joined to the told ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialise
from .columns import few
from .words import ALNUM_RULE, Block, blocks

WINDOW, SUPPORT, GENERALISE, REMOVE = 8, 2, 0.95, 0.98
#: Of the lower bound: one-sided 95 %.
Z = 1.645
KINDS = ("email", "ip", "card", "phone")
#: Word counts kept in a task before they are passed on.
HELD = 2_000_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does, which keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain; only the run before each @ can begin one."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
        at = text.find("@", max(at + 1, last if domain else 0))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind as listed and start; code points, end exclusive."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if "." in text:
        for m in _IP.finditer(text):
            parts = (text[m.start() : m.start(1) - 1], *m.groups())
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
                out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


class _Counts:
    """Occurrences of word hashes, merged now and then."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, hashes: np.ndarray) -> None:
        self.parts.append(np.unique(hashes, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > HELD:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in self.parts] or [np.zeros(0, np.uint64)])
        times = np.concatenate([n for _, n in self.parts] or [np.zeros(0, np.int64)])
        keys, at = np.unique(keys, return_inverse=True)
        self.parts = [(keys, np.bincount(at, weights=times, minlength=len(keys)).astype(np.int64))]
        self.size = len(keys)
        return self.parts[0]

    def flush(self) -> pa.RecordBatch:
        keys, times = self.merge()
        self.parts, self.size = [], 0
        return _batch(len(keys), term=pa.array(keys.astype(np.int64)), times=pa.array(times))


_FIELDS = {"doc_id": pa.int64(), "text_hash": pa.int64(), "n_email": pa.int64(), "n_ip": pa.int64(), "n_card": pa.int64(), "n_phone": pa.int64(), "base": pa.string(), "words": pa.int64(), "entities": pa.list_(pa.int64()), "near": pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])), "term": pa.int64(), "times": pa.int64()}
_SCHEMA = "doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base string, words long, entities array<long>, near array<struct<entity:long,term:long,first:long,last:long>>, term long, times long"


def _batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(n, t)) for k, t in _FIELDS.items()], list(_FIELDS))


def _outside(block: Block, i: int, text: str, spans: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Starts and ends of the words of text i, which are inside spans, and (entity, first word, word after) of each span."""
    a, b = int(block.first[i]), int(block.first[i + 1])
    begin = int(block.offsets[i])
    starts, ends = block.starts[a:b] - begin, block.ends[a:b] - begin
    size = int(block.offsets[i + 1]) - begin
    if size != len(text):  # from bytes to code points
        points = np.concatenate(([0], np.cumsum((block.data[begin : begin + size] & 0xC0) != 0x80)))
        starts, ends = points[starts], points[ends]
    inside = np.zeros(b - a, dtype=bool)
    places = []
    for kind, s, e in spans:
        lo, hi = int(np.searchsorted(ends, s, side="right")), int(np.searchsorted(starts, e))
        inside[lo:hi] = True
        name = hashlib.blake2b(f"{kind}:{text[s:e].lower()}".encode(), digest_size=8).digest()
        places.append((int.from_bytes(name, "little", signed=True), lo, hi))
    return starts, ends, inside, places


def _near(block: Block, i: int, text: str, spans: list[tuple[str, int, int]], hashes: np.ndarray) -> tuple[list[int], list[dict[str, int]]]:
    """Entities of text i, and words outside all spans, within WINDOW words of each span."""
    a, b = int(block.first[i]), int(block.first[i + 1])
    starts, ends, inside, places = _outside(block, i, text, spans)
    out: dict[tuple[int, int], dict[str, int]] = {}
    for entity, lo, hi in places:
        for k in (*range(max(0, lo - WINDOW), lo), *range(hi, min(b - a, hi + WINDOW))):
            if not inside[k]:
                out[entity, k] = {"entity": entity, "term": int(hashes[a + k].astype(np.int64)), "first": int(starts[k]), "last": int(ends[k])}
    return sorted({entity for entity, _, _ in places}), list(out.values())


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, term, first, last, entities) of all words outside spans."""
    for batch in batches:
        for part, block in blocks(batch, "text", ALNUM_RULE):
            hashes = block.hashes().view(np.int64)
            names = ["doc_id", "text_hash", "term", "first", "last"]
            of, terms, firsts, lasts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, text in enumerate(part.column(part.schema.get_field_index("text")).to_pylist()):
                starts, ends, inside, _ = _outside(block, i, text or "", find(text or ""))
                kept = np.flatnonzero(~inside)
                of.append(np.full(len(kept), i))
                terms.append(hashes[int(block.first[i]) + kept])
                firsts.append(starts[kept])
                lasts.append(ends[kept])
            rows = pa.array(np.concatenate(of))
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(x)).take(rows) for x in names[:2]), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (terms, firsts, lasts)), part.column(part.schema.get_field_index("entities")).take(rows)], [*names, "entities"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _Counts()
    for batch in batches:
        for part, block in blocks(batch, "text", ALNUM_RULE):
            hashes = block.hashes()
            first = np.asarray(part.column(part.schema.get_field_index("first")).fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
            counts.add(hashes[first[block.text_of_word()]])
            base, held, near, tally = [], [], [], {k: [] for k in KINDS}
            for i, text in enumerate(part.column(part.schema.get_field_index("text")).to_pylist()):
                spans = find(text) if text else []
                base.append(",".join(f"{k}:{s}:{e}" for k, s, e in spans))
                entities, words = _near(block, i, text, spans, hashes) if spans else ([], [])
                held.append(entities)
                near.append(words)
                for k in KINDS:
                    tally[k].append(sum(x[0] == k for x in spans))
            yield _batch(
                len(block), doc_id=part.column(part.schema.get_field_index("doc_id")), text_hash=part.column(part.schema.get_field_index("text_hash")), base=pa.array(base), words=pa.array(block.counts().astype(np.int64)), entities=pa.array(held, _FIELDS["entities"]), near=pa.array(near, _FIELDS["near"]), **{f"n_{k}": pa.array(v, pa.int64()) for k, v in tally.items()}
            )
            if counts.size > HELD:
                yield counts.flush()
    yield counts.flush()


def _sure(both: Column, times: Column, texts: Column) -> Column:
    """Wilson's lower bound of both / times, where ``both`` comes from so many texts; occurrences count as the texts they are worth."""
    p = both / times
    n = texts / p
    z2 = Z * Z
    return (p + z2 / (2 * n) - Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_email, n_ip, n_card, n_phone, base, terms, spans for every row of ``documents``.

    ``base`` and ``spans`` are kind:start:end lists; ``terms`` is an array of
    (first, last, action) of the words that give an entity away.  Null and
    empty texts have no spans.  Equal values of a kind are one entity in any
    letter case.  Rows repeating a doc_id are rows of their own; rows that
    repeat a doc_id and a text only add to the counts of words in all.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    # later copies of a text are not counted; a null id is the last
    copies = docs.groupBy("text_hash").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select(F.col("text_hash").alias("_hash"), "least")
    copies = few(materialise(copies, "copies"))
    marked = docs.join(copies, docs["text_hash"] == copies["_hash"], "left").withColumn("first", F.col("_hash").isNull() | F.col("doc_id").eqNullSafe(F.col("least"))).select("doc_id", "text_hash", "text", "first")
    found = materialise(marked.mapInArrow(_scan, _SCHEMA).withColumn("row", F.monotonically_increasing_id()), "personal")
    rows = found.where("base is not null").drop("term", "times")
    near = rows.where("size(near) > 0").select("text_hash", "row", F.inline("near"))
    pairs = near.groupBy("entity", "term", "text_hash", "row").agg(F.count("*").alias("n")).groupBy("entity", "term", "text_hash").agg(F.max("n").alias("n"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count("*").alias("docs"))
    pairs = materialise(pairs, "pairs")
    mass = pairs.groupBy("entity").agg(F.sum("both").alias("near"))
    counts = found.where("term is not null").select("term", "times")
    total = float(counts.agg(F.sum("times")).first()[0] or 1)
    held = rows.where("size(entities) > 0").select("row", "doc_id", "text_hash", "words", F.explode("entities").alias("entity"))
    scarce = held.groupBy("entity", "text_hash").agg(F.max("words").alias("words")).groupBy("entity").agg(F.count("*").alias("all_docs"), F.sum("words").cast("double").alias("words"))
    known = materialise(pairs.join(scarce, "entity").where(F.col("docs") >= SUPPORT).drop("all_docs"), "known")
    times = counts.join(few(known.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("times").alias("times"))
    share = lambda both, mass, texts: F.coalesce(F.try_divide(F.log2(_sure(F.col(both), F.col("times"), F.col(texts)) * total / F.col(mass)), F.log2(total / F.col(mass))), F.lit(0.0))
    known = known.join(times, "term").join(mass, "entity").withColumn("share", share("both", "near", "docs"))
    # beside the window the whole document counts; an entity's documents must have room for enough of the word's occurrences
    known = known.where((F.col("share") >= GENERALISE) | (F.col("times") * F.pow(F.col("words") / total, 1 - GENERALISE) <= F.col("words")))
    known = materialise(known.select("entity", "term", "times", "words", "share"), "candidates")
    # texts with such an entity are read again; equal rows have equal places, so each is read once
    held = materialise(held.join(few(known.select("entity").distinct()), "entity", "left_semi"), "held")
    again = few(held.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("entity").alias("entities")))
    texts = docs.join(again, docs["doc_id"].eqNullSafe(again["_id"]) & (docs["text_hash"] == again["_hash"])).drop("_id", "_hash").dropDuplicates(["doc_id", "text_hash"])
    places = texts.mapInArrow(_places, "doc_id long, text_hash long, term long, first long, last long, entities array<long>")
    places = places.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "term", "first", "last", F.explode("entities").alias("entity"))
    places = materialise(places.join(few(known.select("entity", "term")), ["entity", "term"]), "places").withColumnRenamed("entity", "_entity")
    placed = held.join(places, (held["entity"] == places["_entity"]) & (held["text_hash"] == places["_hash"]) & held["doc_id"].eqNullSafe(places["_id"])).select("row", "entity", "term", "first", "last")
    placed = materialise(placed, "placed")
    once = placed.join(rows.select("row", "text_hash"), "row").select("entity", "term", "text_hash", "first", "last").distinct()
    told = known.join(once.groupBy("entity", "term").agg(F.count("*").alias("inside"), F.count_distinct("text_hash").alias("texts")), ["entity", "term"]).withColumn("share", F.greatest("share", share("inside", "words", "texts")))
    told = told.where(F.col("share") >= GENERALISE).select("entity", "term", F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise").alias("action"))
    # a word told of two entities is removed if either asks for it
    marked = placed.join(few(materialise(told, "told")), ["entity", "term"]).groupBy("row", "first", "last").agg(F.max("action").alias("action"))
    marked = marked.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "last", "action"))).alias("terms"))
    out = rows.drop("near", "entities", "words").join(marked, "row", "left")
    listed = F.transform(F.coalesce("terms", F.array().cast("array<struct<first:long,last:long,action:string>>")), lambda t: F.concat_ws(":", F.lit("term"), t["first"].cast("string"), t["last"].cast("string")))
    spans = F.array_join(F.filter(F.concat(F.array("base"), listed), lambda x: x != ""), ",")
    return out.withColumn("spans", spans).drop("row")


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shape = str.maketrans({**{chr(c): "x" for c in range(97, 123)}, **{chr(c): "X" for c in range(65, 91)}, **{chr(c): "0" for c in range(48, 58)}})
    for batch in batches:
        out = []
        for text, base, terms in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            edits = [(int(s), int(e), f"[{k.upper()}]") for k, s, e in (x.split(":") for x in (base or "").split(",") if x)]
            edits += [(t["first"], t["last"], "" if t["action"] == "remove" else "".join(c if c.isascii() else "x" for c in (text or "")[t["first"] : t["last"]].translate(shape))) for t in terms or []]
            done, at = [], 0
            for s, e, new in sorted(edits):
                if s >= at:  # of overlapping finds the first is written
                    done += [text[at:s], new]
                at = max(at, e)
            out.append(text if text is None else "".join([*done, text[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["_id", "_hash", "clean"])


def sanitised(documents: DataFrame) -> DataFrame:
    """The columns of :func:`scan` with ``clean``: the text with personal data replaced by its kind and disclosing words generalised or removed.

    ``clean`` is null where there is nothing to replace.
    """
    found = materialise(scan(documents), "spans")
    some = found.where("spans <> ''").dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "base", "terms")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    texts = docs.join(few(some), docs["doc_id"].eqNullSafe(some["_id"]) & (docs["text_hash"] == some["_hash"])).dropDuplicates(["doc_id", "text_hash"])
    clean = texts.select("doc_id", "text_hash", "text", "base", "terms").mapInArrow(_rewritten, "_id long, _hash long, clean string")
    clean = materialise(clean, "clean")
    both = found.join(clean, found["doc_id"].eqNullSafe(clean["_id"]) & (found["text_hash"] == clean["_hash"]), "left")
    return both.drop("_id", "_hash")


def sanitise(documents: DataFrame) -> DataFrame:
    """(doc_id, text) of every row of ``documents``, sanitised."""
    clean = sanitised(documents).where("spans <> ''").dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "clean")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = docs.join(clean, docs["doc_id"].eqNullSafe(clean["_id"]) & (F.xxhash64(docs["text"]) == clean["_hash"]), "left")
    return both.select("doc_id", F.coalesce("clean", "text").alias("text"))
