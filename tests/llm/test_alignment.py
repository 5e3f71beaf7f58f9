"""Tokenizer alignment against whole texts encoded one by one."""

import collections
import hashlib

import pytest

from driftmark.llm import alignment, queries

TEXTS = ["", None, "a▁b", "  two  blanks \n\n x　 y   z\t <|endoftext|> <s> <0x41> ", "日本語のテキスト 𝒳𝒴 é é ", " ", "x" * 5_000, "\u0000 \x1c \x85 ᠎ a", "it's we'll I'D  'tis\n'twas 12,345.67 !!?", " " * 3_000 + "y", "a\r\n b  c d"]


def plain(rows, tokenizers):
    out = []
    for doc_id, text in rows:
        spaced = (" " + (text or "")).encode()
        a, b = (tokenizers.a.encode(spaced.decode(), add_special_tokens=False).ids, tokenizers.b.encode(text)) if text else ([], [])
        groups = []
        if b"".join(tokenizers.a_bytes[i] for i in a) == spaced == b"".join(tokenizers.b_bytes[i] for i in b):
            ends = []
            for ids, table in ((a, tokenizers.a_bytes), (b, tokenizers.b_bytes)):
                at, found = 0, []
                for i in ids:
                    at += len(table[i])
                    found.append(at)
                ends.append(found)
            common, i, j = sorted(set(ends[0]) & set(ends[1])), 0, 0
            for c in common:
                x, y = i, j
                while i < len(a) and ends[0][i] <= c:
                    i += 1
                while j < len(b) and ends[1][j] <= c:
                    j += 1
                groups.append((a[x:i], b[y:j]))
        out.append((doc_id, groups))
    counts = collections.Counter(p for _, groups in out for p in {(x, y) for g in groups for x in g[0] for y in g[1]})
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    rows = []
    for doc_id, groups in out:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(shown.encode()).hexdigest() if groups else ""
        rows.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), sha))
    return rows, counts


@pytest.fixture(scope="module")
def docs(spark, tiny):
    rows = [(9_000 + i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], None), (9_004, TEXTS[4], "clash"), (9_004, TEXTS[4], "clash")]
    return spark.read.parquet(f"{tiny}/documents.parquet").selectExpr("doc_id", "text", "'x' as key").unionByName(spark.createDataFrame(rows, "doc_id long, text string, key string"))


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers(alignment.default_folder(), alignment.BYTE_FILE, alignment.PIECE_FILE)


def order(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("block", [None, 1])
def test_rows(docs, tokenizers, block, monkeypatch):
    if block:  # many blocks; the workers are forked with the constant
        monkeypatch.setattr(alignment, "BLOCK", block)
        docs = docs.repartition(7)
    want, counts = plain([(r["doc_id"], r["text"]) for r in docs.collect()], tokenizers)
    assert order(alignment.align(docs).collect()) == order(want)
    found = alignment.pair_counts(alignment.scan(docs)).collect()
    assert {(r["a"], r["b"]): r["n"] for r in found} == counts


def test_blocks_cut_anywhere(tokenizers):
    import pyarrow as pa

    texts = [t for t in TEXTS if t] * 3
    want, counts = plain(list(enumerate(texts)), tokenizers)
    found, docs = collections.Counter(), []
    for at in range(0, len(texts), 4):
        block = alignment._Block(tokenizers, at)
        docs += block.add(pa.array(range(at, at + len(texts[at : at + 4]))), texts[at : at + 4]).to_pylist()
        for batch in block.finish():
            for r in batch.to_pylist():
                if r["a"] is not None:
                    found[r["a"], r["b"]] += r["docs"]
    assert found == counts
    assert [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in docs] == [(*w[:5], w[7]) for w in want]


def test_groups_are_told_apart_beyond_their_hashes(monkeypatch, tokenizers):
    tries = []

    def poor(ids, first, counts, seed, good=alignment._sum_of_marks):
        tries.append(seed)
        marks = good(ids, first, counts, seed)
        return marks * 0 if seed in (1, 1001) else marks  # the first seed tells nothing

    monkeypatch.setattr(alignment, "_sum_of_marks", poor)
    block = alignment._Block(tokenizers, 0)
    block.intern([" one", " two", " three", " won't,"])
    assert 2 in tries and len(block.group_of) == len(block.members) > 3


def test_no_rows(docs):
    assert alignment.align(docs.limit(0)).collect() == []


def test_query(spark, tiny, tokenizers):
    rows = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    assert order(queries.op13_tokenizer_alignment(spark, tiny).collect()) == order(plain(rows, tokenizers)[0])
