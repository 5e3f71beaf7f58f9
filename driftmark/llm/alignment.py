"""Alignment of two tokenizers over a corpus by a dictionary of groups.

Both tokenizers cut the bytes of a text.  Places where both cut divide it into
groups, each some A tokens over the same bytes as some B tokens; every A token
of a group is linked with every B token of it.  A corpus has few distinct
groups beside its tokens, so groups are interned:

* A task interns the groups of a block of documents (about BLOCK bytes of
  text) and hands on, for each document, numbers and frequencies of its
  distinct groups, the block's dictionary once, and for each linked (A id, B id) how
  many documents of the block hold it.  Links are expanded once for each
  distinct group.  A pair found in one group only is held by the documents of that
  group; for pairs of several groups distinct documents are counted.
* Spark adds up the pairs, expands each distinct group of the corpus once,
  joins its links to the pairs' counts, and sums them to two numbers a group.
* These are joined back by group to the blocks' dictionaries, and each block's
  documents are worked out from their frequencies.

So tokens never travel, and a block is all that a task ever holds.  Cutting
between a character that is no white space and a blank is a boundary for both
tokenizers (checked when they are loaded; else a unit is a whole text), so
each distinct unit between such boundaries is encoded once a block.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialise
from .words import mix

BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text whose groups are interned together, and units that a task remembers at most meanwhile.
BLOCK, UNITS = 32 << 20, 1_000_000
#: Longer units are encoded but not remembered.
LONG_UNIT = 256
#: Characters of text that are worked on at once, and of units that are encoded together.
CHUNK, PART = 1 << 20, 1 << 14

_BOUNDARY = re.compile("(?<=[^\\s\u180e])(?= )")  # U+180E was white space in older tables
_PLAIN = re.compile("\\s |\u180e")


def default_folder() -> str:
    """Where the installed public tokenizers are."""
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path(BYTE_FILE))


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokenizers:
    """A and B with the bytes of each of their tokens."""

    def __init__(self, folder: str, byte_file: str, piece_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "false", "1"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        path = os.path.join(folder, byte_file)
        self.a = Tokenizer.from_file(path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, piece_file))
        alphabet, vocabulary = _byte_alphabet(), self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (1 + max(self.a.get_vocab().values()))
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token)
        self.blank = self.b.piece_to_id("▁")
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in table], dtype=np.int64) for table in (self.a_bytes, self.b_bytes))
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cuts_a = spec["normalizer"] is None and (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel" and spec["pre_tokenizer"].get("use_regex")
        self.cut = bool(cuts_a) and not any("▁" in p.lstrip("▁") for p in pieces)

    def units(self, text: str) -> list[str]:
        """``text``, which begins with a blank, in pieces that both tokenizers treat on their own."""
        if not self.cut:
            return [text]
        if _PLAIN.search(text) is None:  # each blank follows what is no white space
            return [" " + x for x in text[1:].split(" ")]
        return _BOUNDARY.split(text)

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """A and B tokens of one or more units, or None if either's bytes are not those of ``text``."""
        a = self.a.encode(text, add_special_tokens=False).ids
        b = self.b.encode(text[1:]) if len(text) > 1 else [self.blank]  # B adds the blank, but not to an empty text
        same = b"".join(map(self.a_bytes.__getitem__, a)) == text.encode() == b"".join(map(self.b_bytes.__getitem__, b))
        return (a, b) if same else None


_loaded: dict[tuple[str, str, str], Tokenizers] = {}


def _tokenizers(*where: str) -> Tokenizers:
    if where not in _loaded:
        _loaded[where] = Tokenizers(*where)
    return _loaded[where]


def _segments(ends: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token of each group and the number of tokens in it, for tokens that end at ``ends``."""
    of = np.searchsorted(common, ends)
    first = np.searchsorted(of, np.arange(len(common) + 1))
    return first[:-1], np.diff(first)


def _sum_of_marks(ids: np.ndarray, first: np.ndarray, counts: np.ndarray, seed: int) -> np.ndarray:
    place = np.arange(len(ids)) - np.repeat(first, counts)
    marks = mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(place.astype(np.uint64) + np.uint64(seed)))
    return np.add.reduceat(marks, first)


def _distinct(a: np.ndarray, b: np.ndarray, sides: tuple[tuple[np.ndarray, np.ndarray], ...]) -> tuple[np.ndarray, np.ndarray]:
    """(an example of each distinct group, the distinct group of each), by hashes that are then compared id by id."""
    for seed in range(1, 100):
        marks = mix(_sum_of_marks(a, *sides[0], seed)) + _sum_of_marks(b, *sides[1], seed + 1000)
        _, example, which = np.unique(marks, return_index=True, return_inverse=True)
        like, equal = example[which], True
        for ids, (first, counts) in zip((a, b), sides, strict=True):
            equal = equal and np.array_equal(counts[like], counts)
            equal = equal and np.array_equal(ids[np.arange(len(ids)) + np.repeat(first[like] - first, counts)], ids)
        if equal:
            return example, which
    raise AssertionError("no seed tells the groups apart")


def _parts(units: list[str]) -> Iterator[list[str]]:
    """Units that may be encoded together: none but the last ends in white space."""
    part, size = [], 0
    for unit in units:
        part.append(unit)
        size += len(unit)
        if size >= PART or unit[-1].isspace() or unit[-1] == "\u180e":
            yield part
            part, size = [], 0
    if part:
        yield part


class _Block:
    """Units and groups of some documents, interned."""

    def __init__(self, tokenizers: Tokenizers, number: int) -> None:
        self.t, self.number, self.bytes = tokenizers, number, 0
        self.unit_of: dict[str, int] = {}
        self.shown: list[str] = []  # of each unit, its groups as text
        self.fits = np.zeros(0, dtype=bool)
        self.sizes = np.zeros((0, 4), dtype=np.int64)  # A tokens, B tokens, groups, links
        self.groups, self.first = np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)  # of unit u: groups[first[u]:first[u + 1]]
        self.group_of: dict[str, int] = {}
        self.members: list[tuple[list[int], list[int]]] = []  # of each group, its A and B ids
        self.held: list[tuple[np.ndarray, np.ndarray]] = []  # document, group: once each
        self.documents = 0

    def intern(self, units: list[str]) -> None:
        """Encode ``units`` and cut them into groups."""
        fits, a, b = [], [], []
        for part in _parts(units):  # what holds for units on their own holds for them together
            found = self.t.encode("".join(part))
            each = [found] if found else [self.t.encode(u) for u in part]
            fits += [True] * len(part) if found else [x is not None for x in each]
            for x in filter(None, each):
                a += x[0]
                b += x[1]
        kept = np.flatnonzero(fits)
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        a_ends, b_ends = np.cumsum(self.t.a_sizes[a]), np.cumsum(self.t.b_sizes[b])
        unit_ends = np.cumsum([len(units[k].encode()) for k in kept], dtype=np.int64)
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        sides = _segments(a_ends, common), _segments(b_ends, common)
        n_a, n_b = sides[0][1], sides[1][1]
        groups, names = np.zeros(0, dtype=np.int64), []
        if len(common):
            example, which = _distinct(a, b, sides)
            known = []
            for e in example.tolist():
                x, y = (ids[first[e] : first[e] + counts[e]].tolist() for ids, (first, counts) in zip((a, b), sides, strict=True))
                key = f"{','.join(map(str, x))}|{','.join(map(str, y))}"
                g = self.group_of.setdefault(key, len(self.members))
                if g == len(self.members):
                    self.members.append((x, y))
                known.append((g, key))
            groups = np.array([g for g, _ in known])[which]
            names = np.array([key for _, key in known], dtype=object)[which].tolist()
        ends = np.zeros(len(units), dtype=np.int64)
        ends[kept] = np.searchsorted(common, unit_ends, side="right")
        ends = np.maximum.accumulate(ends)
        starts = np.concatenate(([0], ends[:-1]))
        links = np.concatenate(([0], np.cumsum(n_a * n_b)))
        counted = [np.diff(np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], ends))]) for n in (n_a, n_b)]
        self.sizes = np.concatenate([self.sizes, np.stack([*counted, ends - starts, links[ends] - links[starts]], axis=1)])
        self.fits = np.concatenate([self.fits, np.array(fits, dtype=bool)])
        self.first = np.concatenate([self.first, ends + len(self.groups)])
        self.groups = np.concatenate([self.groups, groups])
        self.unit_of.update(zip(units, range(len(self.shown), len(self.shown) + len(units)), strict=True))
        self.shown += [";".join(names[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]

    def add(self, ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        """Rows of the documents ``texts``."""
        cut = [self.t.units(" " + t) if t else [] for t in texts]
        new = [u for u in set().union(*cut) if u not in self.unit_of]
        if new:
            self.intern(new)
        rows = [list(map(self.unit_of.__getitem__, units)) for units in cut]
        if not self.fits.all():
            rows = [r if self.fits[r].all() else [] for r in rows]
        digests = [hashlib.sha256(";".join(map(self.shown.__getitem__, r)).encode()).hexdigest() if r else "" for r in rows]
        lengths = np.fromiter(map(len, rows), dtype=np.int64)
        flat = np.fromiter((u for r in rows for u in r), dtype=np.int64, count=int(lengths.sum()))
        ends = np.concatenate(([0], np.cumsum(lengths)))
        totals = [np.diff(np.concatenate(([0], np.cumsum(self.sizes[flat, k])))[ends]) for k in range(4)]
        n_units, n_groups = max(1, len(self.shown)), max(1, len(self.members))
        units, times = np.unique(np.repeat(np.arange(len(rows)), lengths) * n_units + flat, return_counts=True)
        docs, units = units // n_units, units % n_units
        counts = self.sizes[units, 2]
        inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        groups = self.groups[np.repeat(self.first[units], counts) + inside]
        keys, at = np.unique(np.repeat(docs, counts) * n_groups + groups, return_inverse=True)
        times = np.bincount(at, weights=np.repeat(times, counts), minlength=len(keys)).astype(np.int32)
        docs, groups = keys // n_groups, (keys % n_groups).astype(np.int32)
        self.held.append(((docs + self.documents).astype(np.int32), groups))
        self.documents += len(rows)
        offsets = pa.array(np.searchsorted(docs, np.arange(len(rows) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (groups, times)]
        for unit in (u for u in new if len(u) > LONG_UNIT):
            del self.unit_of[unit]
        block = pa.array(np.full(len(rows), self.number), pa.int64())
        return _batch(len(rows), doc_id=ids, **dict(zip(("n_a", "n_b", "n_groups", "n_links"), map(pa.array, totals), strict=True)), groups_sha256=pa.array(digests, pa.string()), block=block, groups=lists[0], times=lists[1])

    def finish(self) -> Iterator[pa.RecordBatch]:
        """The dictionary, and how many documents hold each linked pair of ids."""
        keys, n = list(self.group_of), len(self.members)
        for at in range(0, n, 100_000):
            part = keys[at : at + 100_000]
            yield _batch(len(part), block=pa.array(np.full(len(part), self.number), pa.int64()), place=pa.array(np.arange(at, at + len(part)), pa.int32()), key=pa.array(part))
        if not n:
            return
        links = [sorted({x << 32 | y for x in set(a) for y in set(b)}) for a, b in self.members]  # once for each distinct group
        counts = np.array([len(x) for x in links])
        pairs, pair = np.unique(np.array([x for link in links for x in link], dtype=np.int64), return_inverse=True)
        first = np.concatenate(([0], np.cumsum(counts)))
        docs, groups = (np.concatenate(x) for x in zip(*self.held, strict=True))
        documents = np.bincount(groups, minlength=n)
        shared = np.bincount(pair, minlength=len(pairs)) > 1
        total = np.zeros(len(pairs), dtype=np.int64)
        owner = np.repeat(np.arange(n), counts)
        total[pair[~shared[pair]]] = documents[owner[~shared[pair]]]  # of one group: its documents
        some = np.logical_or.reduceat(shared[pair], first[:-1])
        step = max(1, 4_000_000 // int(counts.max()))
        order = np.argsort(docs, kind="stable")  # whole documents at a time
        docs, groups = docs[order], groups[order]
        keep = some[groups]
        docs, groups = docs[keep], groups[keep]
        at = 0
        while at < len(docs):
            end = int(np.searchsorted(docs, docs[min(at + step, len(docs)) - 1], side="right"))
            d, g = docs[at:end].astype(np.int64), groups[at:end]
            width = counts[g]
            inside = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
            p = pair[np.repeat(first[g], width) + inside]
            d = np.repeat(d, width)[shared[p]]
            held = np.unique(d * len(pairs) + p[shared[p]])  # of several groups: distinct documents
            total += np.bincount(held % len(pairs), minlength=len(pairs))
            at = end
        yield _batch(len(pairs), a=pa.array((pairs >> 32).astype(np.int32)), b=pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), docs=pa.array(total))


_FIELDS = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "block": pa.int64(), "groups": pa.list_(pa.int32()), "times": pa.list_(pa.int32()), "place": pa.int32(), "key": pa.string(), "a": pa.int32(), "b": pa.int32(), "docs": pa.int64()}
_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, groups array<int>, times array<int>, place int, key string, a int, b int, docs long"


def _batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(n, t)) for k, t in _FIELDS.items()], list(_FIELDS))


def _scan(where: tuple[str, str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block = _Block(_tokenizers(*where), number)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < batch.num_rows:
                some, size = [], 0
                while at + len(some) < batch.num_rows and (size < CHUNK or not some):
                    some.append(texts[at + len(some)].as_py())
                    size += len(some[-1] or "")
                yield block.add(ids.slice(at, len(some)), some)
                at, block.bytes = at + len(some), block.bytes + size
                if block.bytes >= BLOCK or len(block.unit_of) >= UNITS:
                    yield from block.finish()
                    number += 1
                    block = _Block(block.t, number)
        yield from block.finish()

    return run


def _worked_out(documents: pa.Table, dictionary: pa.Table) -> pa.Table:
    """n_best and count_sum of a block's documents, from the two numbers of each of its groups."""
    place = dictionary.column("place").to_numpy()
    values = {}
    for name in ("best", "total"):
        values[name] = np.zeros(int(place.max(initial=-1)) + 1, dtype=np.int64)
        values[name][place] = dictionary.column(name).to_numpy()
    lists = documents.column("groups").combine_chunks()
    flat, times = lists.flatten().to_numpy(zero_copy_only=False), documents.column("times").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    out = documents.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    for name, column in (("best", "n_best"), ("total", "count_sum")):
        sums = np.concatenate(([0], np.cumsum(values[name][flat] * times)))[np.concatenate(([0], ends))]
        out = out.append_column(column, pa.array(np.diff(sums), pa.int64()))
    return out.append_column("groups_sha256", documents.column("groups_sha256"))


def scan(documents: DataFrame, folder: str | None = None, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE) -> DataFrame:
    """Rows of documents, of the blocks' dictionaries (``key`` set) and of pair counts (``a`` set), written as a table."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(docs.mapInArrow(_scan((folder or default_folder(), byte_file, piece_file)), _SCHEMA), "groups")


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, n, best): documents of ``scan``'s corpus that hold A id a linked with B id b, and the highest such count of a."""
    counts = materialise(found.where("a is not null").groupBy("a", "b").agg(F.sum("docs").alias("n")), "pairs")
    best = counts.groupBy("a").agg(F.max("n").alias("best"))
    return counts.join(F.broadcast(best), "a")  # a row for each entry of A's vocabulary at most


def _with_times(ids: Column) -> Column:
    """Distinct ids of an array, each with how often it stands there."""
    return F.transform(F.array_distinct(ids), lambda x: F.struct(x.cast("int").alias("id"), F.size(F.filter(ids, lambda y: y == x)).cast("long").alias("times")))


def align(documents: DataFrame, folder: str | None = None, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``documents``.

    A text that is null or empty, or whose tokens do not spell a blank and the
    text, has no tokens: zeros, and '' for the hash.  Rows that repeat a doc_id or
    a text are documents of their own.  ``folder`` holds the tokenizer files on
    every executor.
    """
    found = scan(documents, folder, byte_file, piece_file)
    counts = pair_counts(found)
    dictionary = found.where("key is not null").select("block", "place", "key")
    sides = F.split("key", "\\|")
    groups = dictionary.select("key").distinct().select("key", _with_times(F.split(sides[0], ",")).alias("a"), _with_times(F.split(sides[1], ",")).alias("b"))
    links = groups.select("key", "b", F.inline("a").alias("a", "a_times")).select("key", "a", "a_times", F.inline("b").alias("b", "b_times"))
    links = links.select("key", "a", "b", (F.col("a_times") * F.col("b_times")).alias("times")).join(counts, ["a", "b"])
    values = links.groupBy("key").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("n")).alias("total"))
    values = dictionary.join(values, "key").select(F.col("block").alias("of_block"), "place", "best", "total")
    rows = found.where("groups is not null").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "groups", "times")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("block").cogroup(values.groupBy("of_block")).applyInArrow(_worked_out, schema)
