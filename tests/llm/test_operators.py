"""Each operator against brute force, over the tiny tables and rows made to be awkward."""

import binascii
import collections
import hashlib
import itertools
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from driftmark.llm import chat, columns, decontamination, licenses, mixing, near_duplicates, personal_data, quality, queries, sharding, toxicity, warc
from driftmark.plans.scratch import materialise

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, size int"  # the last two clash on purpose
BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, rule=ALNUM):
    return rule.findall((text or "").translate(LOWER))


AWKWARD = [
    None, "", " \n\t ", "one", "One TWO three four", "a b c d e " * 30, "É ß İ K ñandú\u0085x y", "line\nline\n\nline\n \nother", "#*$%&|<> " * 60,
    "x" * 50_000, "word " * 20_000, "Released under the MIT License. mit license mit  license", "Licensed under CC BY-NC 4.0", "under the terms of the GNU Lesser General Public License",
    "mail a.b@c-d.example.org, x@y, @z.com q@r.s@t.u +49 (30) 1234567. 4111 1111 1111 1111 10.0.0.255 10.0.0.256 1.2.3.4.5 001.2.3.4", "+1 2 +12345678901234567 12345678901234567890",
    "AAAA BBBB " + " ".join(f"w{i}" for i in range(80)), "AAAA BBBB " + " ".join(f"w{i}" for i in range(79)) + " zz",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward texts, with repeated rows, null columns and ids."""
    rows = [(i, t, ["en", None, "de"][i % 3], ["b", None, "a", "c"][i % 4], None, "clash", 7) for i, t in enumerate(AWKWARD)]
    rows += [(None, AWKWARD[5], "en", "a", None, None, None), (None, None, None, None, None, None, None), rows[4], rows[4], (3, AWKWARD[16], "en", "b", 1, "", 0)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def both(spark, docs, tiny):
    """The tiny documents and the awkward ones."""
    real = spark.read.parquet(f"{tiny}/documents.parquet")
    return real.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100_000), allowMissingColumns=True)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# quality rules


def base_counts(text):
    w, lines = words(text, BLANKS), [x for x in (text or "").split("\n") if BLANKS.search(x)]
    w = BLANKS.findall(text or "")
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(both):
    for r in quality.statistics(both).select("*").join(both.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), ["doc_id", "text_hash"]).collect():
        want = base_counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r["text"]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_binomial_tail_is_exact(spark):
    cases = [(1, 0), (50, 0), (50, 3), (1000, 10), (100_000, 900), (100_000, 1001)]
    df = spark.createDataFrame(cases, "n long, k long").withColumn("p", quality.binomial_tail(F.col("n"), F.col("k"), 0.01))
    for r in df.collect():
        if r["k"] > r["n"] * 0.01:
            assert r["p"] == 1
        else:
            logs = [math.lgamma(r["n"] + 1) - math.lgamma(i + 1) - math.lgamma(r["n"] - i + 1) + i * math.log(0.01) + (r["n"] - i) * math.log(0.99) for i in range(r["k"] + 1)]
            assert r["p"] == pytest.approx(sum(map(math.exp, logs)), rel=1e-6)


STATS = "doc_id long, stratum string, text_hash long, base_failed boolean, symbols long, dup_lines long, repeats long, capitals long, word_length long"


def test_cutoffs_keep_the_promise(spark):
    """With enough good labels a harmful statistic gets a cutoff; with few, copies of few, or none harmful, there is none."""
    cases = {"big": (2000, 1, 5), "few": (60, 1, 5), "copies": (60, 40, 5), "same": (2000, 1, 2)}
    rows, labels = [], []
    for k, (stratum, (texts, copies, period)) in enumerate(cases.items()):
        for i in range(texts):
            value = 400 if i % period == 0 or stratum == "same" else 1
            for c in range(copies):
                doc_id = 1_000_000 * k + 1000 * i + c
                rows.append((doc_id, stratum, k * 10_000 + i, False, value, 0, 0, 0, 50))
                labels.append((doc_id, int(i % period > 0)))
    rows.append((0, "big", 99, False, 1, 0, 0, 0, 50))  # a doc_id with two texts says nothing
    stats = spark.createDataFrame(rows, STATS)
    got = {r["stratum"]: r["cut_symbols"] for r in quality.cutoffs(stats, spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id long, quality int")).collect()}
    assert got.pop("big") == 300 and set(got.values()) <= {None}
    assert quality.trials(stats, spark.createDataFrame(labels, "doc_id long, quality int")).where("stratum = 'copies'").count() == 60


def test_rules_are_certified_one_after_the_other(spark):
    """A statistic that loses too many good texts of the holdout is left out, the better ones before it stay."""
    rows, labels = [], []
    for i in range(4000):
        bad = i % 4 == 0
        late = hashlib.md5(str(i).encode()).hexdigest()[0] < "8"  # the certifying half
        rows.append((i, "s", i, False, 400 if bad else 1, 400 if bad and i % 8 == 0 or late and i % 9 == 1 else 0, 0, 0, 50))
        labels.append((i, int(not bad)))
    got = quality.cutoffs(spark.createDataFrame(rows, STATS), spark.createDataFrame(labels, "doc_id long, quality int")).first()
    assert got["cut_symbols"] == 300 and got["cut_dup_lines"] is None


def test_cutoffs_act_on_the_small_tables(spark):
    """At sf0.01 a cutoff rejects documents that pass the base rules, so the comparison with SQL covers it."""
    out = queries.op1_quality_rules(spark, "/root/testdata/sf0.01")
    assert out.where("not base_failed and not kept").count() > 20


def test_quality_without_labels_or_documents(spark, both, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.judge(both, labels)
    assert out.count() == both.count() and out.where("kept = base_failed").count() == 0
    assert quality.judge(none, labels).count() == 0


# near duplicates


def shingles(text):
    w = words(text, BLANKS)
    return frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    """doc_id -> smallest id reachable, for rows (doc_id, text) with unique ids."""
    sets, root = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, x), (j, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i, _ in rows}


def edited(base, share, rng):
    return " ".join(f"e{rng.randrange(10**9)}" if rng.random() < share else w for w in base)


def test_near_duplicates(spark, tiny):
    rng = random.Random(5)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    base = [f"b{rng.randrange(3000)}" for _ in range(90)]
    rows += [(10_000 + i, edited(base, (i % 60) / 400, rng)) for i in range(300)]  # a crowd, from equal to unlike
    rows += [(20_000 + i, t) for i, t in enumerate(AWKWARD)] + [(30_000 + i, "one two three four five six " * 3) for i in range(40)]
    found = near_duplicates.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) == r["first_copy"] for r in found)
    assert {r["doc_id"]: r["n_shingles"] for r in found} == {i: len(shingles(t)) for i, t in rows}


@pytest.mark.parametrize("spread", [1 / 6, 1 / 2])
def test_crowds_in_small_blocks(spark, monkeypatch, spread):
    """Many chunks, in both waves, give the same components as one."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, edited(base, rng.random() * spread, rng)) for i in range(120)]
    # a chain: each text shares half of its words with the next
    rows += [(1000 + i, " ".join(f"c{j}" for j in range(20 * i, 20 * i + 80))) for i in range(60)]
    monkeypatch.setattr(near_duplicates, "CHUNK", 4000)
    monkeypatch.setattr(near_duplicates, "FEW", 0)
    monkeypatch.setattr(near_duplicates, "PIVOTS", 1)
    monkeypatch.setattr(near_duplicates, "CROWD", 7)
    found = near_duplicates.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_components(rows)


def test_blocks_find_every_link(spark, tiny):
    """Both waves of blocks over made-up buckets against all pairs, and no member is sent more often than its buckets have chunks."""
    sets = {i: frozenset((3 * i + j) % 500 for j in range(40)) for i in range(90)}  # each is near the next alone
    facts = []
    for i, own in sets.items():
        x = near_duplicates.np.sort(near_duplicates.mix(near_duplicates.np.array(sorted(own), dtype="uint64")))
        facts.append((i, bytearray(near_duplicates.signature(x).tobytes()), bytearray(x.tobytes())))
    facts = spark.createDataFrame(facts, "node long, signature binary, shingles binary")
    # buckets of 30 that chain through shared members
    rows = [(b, i, 40, i, 30) for b in range(7) for i in range(10 * b, 10 * b + 30)]
    members = spark.createDataFrame(rows, "bucket long, node long, n long, comp long, k long")
    links = near_duplicates._crowded_links(members, facts).collect()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    got = {}
    for r in links:
        assert 100 * len(sets[r["a"]] & sets[r["b"]]) >= 75 * len(sets[r["a"]] | sets[r["b"]])
        root[find(r["a"])] = find(r["b"])
    got = {i: find(i) for i in sets}
    for b in range(7):
        for x, y in itertools.combinations(range(10 * b, 10 * b + 30), 2):
            if 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                assert got[x] == got[y]
    assert links


def test_many_rows_of_one_node(spark):
    """Thousands of copies of two near texts without an id are one group, in bounded time."""
    base = " ".join(f"w{i}" for i in range(100))
    df = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, base).otherwise(base + " end").alias("text"))
    out = near_duplicates.groups(df).groupBy("component_id", "kept").agg(F.count("*").alias("n"), F.count_if("first_copy").alias("first")).collect()
    assert [tuple(r) for r in out] == [(None, True, 5000, 1)]


def test_light_crowds_take_few_steps(spark, monkeypatch):
    """Unlike texts that share a bucket: where all their pairs are little work, no pivots and waves come before the blocks; the groups are the same."""
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*words, *(f"x{i % 9}y{j}" for j in range(6)), *(f"z{i}" for _ in range(i % 3))])) for i in range(60)]
    made, found = [], []
    for light in (0, near_duplicates.LIGHT):
        names = []
        with monkeypatch.context() as m:
            m.setattr(near_duplicates, "LIGHT", light)
            m.setattr(near_duplicates, "FEW", 0)
            m.setattr(near_duplicates, "materialise", lambda df, name, names=names: names.append(name) or materialise(df, name))
            found.append(sorted((r["doc_id"], r["component_id"]) for r in near_duplicates.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
        made.append(names)
    assert found[0] == found[1] == sorted(brute_components(rows).items()) and len({c for _, c in found[0]}) > 1
    assert "waves" in made[0] and "waves" not in made[1] and "chunks" in made[1] and len(made[1]) < len(made[0])


def test_near_duplicates_of_awkward_rows(docs, none):
    out = near_duplicates.groups(docs).collect()
    assert len(out) == docs.count() and near_duplicates.groups(none).count() == 0
    assert sum(r["first_copy"] for r in out if r["doc_id"] == 4) == 1  # repeated rows: one first copy
    assert all(r["n_shingles"] == 0 for r in out if r["doc_id"] in (0, 1, 2))


def test_pruning_bounds():
    least = near_duplicates.least_matches()
    assert len(least) == 8 and least == sorted(least) and 60 < least[-1] < 96


# decontamination


def brute_hits(text, items):
    w, hit, held = words(text), set(), set()
    for item_id, own in items:
        n = min(10, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                held.add(item_id)
    return len(w), len(hit), sorted(held)


def test_decontamination_both_ways(spark, tiny, both):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    items += [(900, "four"), (901, "One two THREE"), (902, None), (903, " ,"), (904, "b c d e a b c d e a b"), (None, "x y"), (905, items[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    split = [("null" if i is None else str(i), words(t)) for i, t in items]
    extra = spark.createDataFrame([(500_000, "intro " + items[0][1] + " middle " + items[1][1].upper() + " end one two three", None)], "doc_id long, text string, lang string")
    table = both.unionByName(extra, allowMissingColumns=True)
    want = sorted((r["doc_id"] or -1, *brute_hits(r["text"], split)) for r in table.select("doc_id", "text").collect())
    for small in ((10**9, 10**9), (0, 0)):
        found = decontamination.scan(table, benchmark, small).collect()
        assert sorted((r["doc_id"] or -1, r["n_words"], r["n_hit"], r["items"]) for r in found) == want
    assert any(r[2] for r in want)


def test_decontamination_of_nothing(spark, both, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.scan(both, empty).where("n_hit > 0").count() == 0
    assert decontamination.scan(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


# personal data


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute_personal(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    cards = [(m, re.sub("[^0-9]", "", m.group())) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)]
    out += [("card", m.start(), m.end()) for m, d in cards if 13 <= len(d) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_personal_data_patterns(spark, both):
    found = {(r["doc_id"], r["text_hash"]): r["base"] for r in personal_data.scan(both).collect()}
    for r in both.where("text is null or length(text) < 40000").select("doc_id", "text", F.xxhash64("text").alias("h")).collect():
        assert found[r["doc_id"], r["h"]] == brute_personal(r["text"] or "")
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("a1.9@+-( )4é") for _ in range(rng.randrange(40)))
        assert ",".join(f"{k}:{a}:{b}" for k, a, b in personal_data.find(text)) == brute_personal(text), text


def test_words_that_give_an_entity_away(spark, none):
    rng = random.Random(4)
    noise = lambda n: " ".join(f"n{rng.randrange(500)}" for _ in range(n))
    rows = [(i, f"é {noise(30)} Zaphod{i % 2} writes to z{i % 2}@beeblebrox.org {noise(30)}") for i in range(40)] + [(100 + i, noise(60)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = personal_data.scan(df).collect()
    for r in out:
        own = [(t["first"], t["last"]) for t in r["terms"] or []]
        texts = [dict(rows)[r["doc_id"]][a:b] for a, b in own]
        assert (f"Zaphod{r['doc_id'] % 2}" in texts) == (r["doc_id"] < 100)
        if r["doc_id"] >= 100:
            assert r["spans"] == "" and not own
        assert r["spans"].startswith(r["base"])
    clean = {r["doc_id"]: r["text"] for r in personal_data.sanitise(df).collect()}
    assert "[EMAIL]" in clean[0] and "Zaphod" not in clean[0] and clean[100] == dict(rows)[100] and len(clean) == len(rows)
    assert personal_data.scan(none).count() == 0


def test_told_words_are_marked_all_over(spark):
    rng = random.Random(6)
    noise = lambda n: " ".join(f"n{rng.randrange(300)}" for _ in range(n))
    rows = [(i, f"{noise(20)} Zaphod writes to z@beeblebrox.org {noise(30)} {'Zaphod' if i % 2 else 'n1'} {noise(20)}") for i in range(40)]
    rows += [(200, f"{noise(20)} Trillian writes to t@heart.org {noise(30)} Trillian {noise(5)}"), (201, f"Zaphod {noise(40)}"), (None, f"{noise(20)} Marvin has m@heart.org {noise(30)} Marvin")]
    rows += [rows[1]] + [(300 + i, noise(60)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = collections.defaultdict(list)
    for r in personal_data.sanitise(df).collect():
        clean[r["doc_id"]].append(r["text"])
    assert all("Zaphod" not in t for i in range(40) for t in clean[i]) and len(clean[1]) == 2
    assert "Trillian" in clean[200][0] and "Marvin" in clean[None][0]  # one text tells nothing
    assert clean[201] == [dict(rows)[201]]


def plain_terms(texts):
    """text -> (first, last, action) of its told words, by dictionaries over different texts (numeric ids, ASCII)."""
    entities, near, held, times = {}, collections.defaultdict(collections.Counter), collections.defaultdict(set), collections.Counter()
    places = {}
    for t in set(texts):
        spans = [x.split(":") for x in brute_personal(t).split(",") if x]
        ws = [(m.group(), m.start(), m.end()) for m in ALNUM.finditer(t.translate(LOWER))]
        times.update(w for w, _, _ in ws)
        inside = [any(a < int(e) and b > int(s) for _, s, e in spans) for _, a, b in ws]
        places[t] = [(w, a, b) for (w, a, b), x in zip(ws, inside, strict=True) if not x]
        marks = collections.defaultdict(set)
        for kind, s, e in spans:
            entity = kind, t[int(s) : int(e)].lower()
            held[entity].add(t)
            lo, hi = sum(b <= int(s) for _, _, b in ws), sum(a < int(e) for _, a, _ in ws)
            marks[entity] |= {k for k in (*range(max(0, lo - personal_data.WINDOW), lo), *range(hi, min(len(ws), hi + personal_data.WINDOW))) if not inside[k]}
        for entity, ks in marks.items():
            near[entity].update((ws[k][0], t) for k in ks)
        entities[t] = set(marks)
    total = sum(times.values())
    sizes = {t: len(words(t)) for t in set(texts)}

    def share(both, mass, w, texts):
        p, z2 = both / times[w], personal_data.Z**2
        n = texts / p
        sure = (p + z2 / (2 * n) - personal_data.Z * math.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
        return math.log2(sure * total / mass) / math.log2(total / mass)

    out = {t: {} for t in set(texts)}
    for entity, own in near.items():
        mass, words_ = sum(own.values()), sum(sizes[t] for t in held[entity])
        for w in {w for w, _ in own}:
            docs = {t for x, t in own if x == w}
            if len(docs) < personal_data.SUPPORT:
                continue
            inside = sum(x == w for t in held[entity] for x, _, _ in places[t])
            texts_ = sum(any(x == w for x, _, _ in places[t]) for t in held[entity])
            value = max(share(sum(n for (x, _), n in own.items() if x == w), mass, w, len(docs)), share(inside, words_, w, texts_))
            if value >= personal_data.GENERALISE:
                for t in held[entity]:
                    for x, a, b in places[t]:
                        if x == w:
                            out[t][a, b] = max(out[t].get((a, b), ""), "remove" if value >= personal_data.REMOVE else "generalise")
    return {t: sorted((a, b, x) for (a, b), x in v.items()) for t, v in out.items()}


def test_disclosing_words_equal_a_plain_count(spark):
    rng = random.Random(11)
    noise = lambda n: " ".join(f"n{rng.randrange(120)}" for _ in range(n))
    texts = [f"{noise(20)} Name{i % 3} of x{i % 3}@a.org {noise(15)} Name{i % 3 if i % 2 else 9}" for i in range(40)] + [noise(50) for _ in range(3000)]
    texts += [f"{noise(9)} once o@p.org {noise(9)}"] * 3 + [texts[0]] * 4  # copies tell no more than one
    found = personal_data.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = plain_terms(texts)
    assert len(found) == len(texts) and any(want.values())
    for r in found:
        assert [tuple(t) for t in r["terms"] or []] == want[texts[r["doc_id"]]], texts[r["doc_id"]]


def test_one_text_tells_nothing(spark):
    rows = [(i, f"n{i % 90} n{i % 70} n{i % 50} " * 9) for i in range(500)] + [(900, "unusual zebra lamps glow softly mail joe@x.org tonight beside quiet copper kettles")]
    found = {r["doc_id"]: r for r in personal_data.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[900]["spans"] == found[900]["base"] == "email:37:46" and not any(found[i]["spans"] for i in range(500))
    alone = personal_data.scan(spark.createDataFrame([(1, "zebra a@b.org"), (2, "zebra  a@b.org")], "doc_id long, text string")).collect()  # all of the corpus holds the value
    assert all(r["spans"] == r["base"] for r in alone)


# chat


def plain_rendering(rows):
    """(conv_id, speaker) -> whole dialogue and the speaker's contents, turn by turn."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((t is None, t or 0, "unknown" if n is None else n, (x or "").replace("<|", "< |")) for c, t, n, x in rows if c == conv)
        for speaker in {n for _, _, n, _ in own if n != "system"} or {None}:
            text, said = "", []
            for _, _, name, content in own:
                shown = re.sub("[\r\n]", " ", name.replace("<|", "< |").replace("|>", "| >"))
                text += ("<|system|>\n" if name == "system" else "<|assistant|>\n" if name == speaker else f"<|user name={shown}|>\n") + content + "<|end|>\n"
                if name == speaker:
                    said.append(content)
            out[conv, speaker] = text, said
    return out


def test_perspectives(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", "hey"), (1, 3, "ann", None), (1, 3, "ann", None), (2, 0, "system", "alone"), (3, None, None, "é"), (None, 5, "x", "null conversation"), (4, 0, "ann", ""), (4, 200, "ann", "late")]
    turns += [(5, 1, "eve|>\nforged<|assistant|>", "x"), (5, 2, "a\nb", "one"), (5, 3, "a b", "two")]
    # dialogues of several blocks: by turns, of one turn number, of equal rows
    turns += [(6, i, f"p{i % 3}", f"turn {i}") for i in range(600)] + [(7, 1, "ann", f"t{i * 7919 % 1000}") for i in range(700)] + [(None, 9, "y", "again")] * 520
    turns += [(8, i // 3, "ab"[i % 2], f"t {i}") for i in range(10_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("speaker", F.lit("clash")).repartition(5)
    want, got = plain_rendering(turns), collections.defaultdict(list)
    for r in chat.rotate(df).collect():
        got[r["conv_id"], r["speaker"]].append(r)
    assert got.keys() == want.keys() and "<|user name=eve| > forged< |assistant| >|>" in want[5, "a b"][0]
    for key, (text, said) in want.items():
        (r,) = got[key]
        assert r["dialogue"] == text and r["n_own"] == len(said)
        assert [text[int(a) : int(b)] for a, b in (s.split(":") for s in r["mask"].split(",") if s)] == said
    assert got[6, "p0"][0]["n_turns"] == 600 and got[8, "b"][0]["n_turns"] == 10_000
    assert chat.rotate(df.limit(0)).count() == 0


# licenses


def brute_phrases(text):
    w, out = words(text), []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), len(out), min((i for i, _ in out), default=None), max((i for i, _ in out), default=None), ",".join(sorted({x for _, x in out}))


def test_license_phrases(both, none):
    want = sorted(map(repr, ((r["doc_id"], *brute_phrases(r["text"])) for r in both.select("doc_id", "text").collect())))
    out = licenses.scan(both).collect()
    assert sorted(map(repr, ((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out))) == want
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in out)
    assert licenses.scan(none).count() == 0


def test_altered_notices_and_bodies(spark):
    body = licenses.BODIES["mit"]
    rng = random.Random(9)
    edited_body = " ".join(w for w in body.split() if rng.random() > 0.05)
    cases = [
        ("cc-by,cc-by-nc", "Licensed under CC BY-NC 4.0"), ("bsd", "Redistribution and use in source and binary forms, with or without any modification, are permitted"),
        ("lgpl", "under the terms of the GNU Lesser General Public License"), ("", "terms of use and the source of the public"),
        ("mit", f"intro {body} outro"), ("mit", edited_body), ("", " ".join(body.split()[:40])), ("", " ".join(rng.sample(body.split(), len(body.split())))),
        ("zlib", licenses.BODIES["zlib"].upper()), ("apache", licenses.BODIES["apache"]), ("gpl", licenses.BODIES["gpl"]), ("boost", licenses.BODIES["boost"]),
        ("", "M\u0130T L\u0130CENSE"), ("mit", "mit license " * 3000),
        ("mpl", "// SPDX-License-Identifier: MPL-2.0"), ("agpl", "the GNU Affero General Public License"), ("bsd,bsd-3-clause", f"{licenses.BODIES['bsd']} {licenses.CLAUSES['bsd endorsement'][1]}"),
        ("apache", licenses.CLAUSES["apache grant"][1]), ("mpl", licenses.CLAUSES["mpl grant"][1]), ("agpl", licenses.CLAUSES["agpl network"][1]),
        ("", "licensed under the mozilla license version 2 0"), ("lgpl", "under all terms of the GNU Lesser General Public License"), ("", "under the terms of the GNU Greater General Public License"),
        ("mit", "mit license mit license released under the mit license"),
    ]
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame([(i, t, 1) for i, (_, t) in enumerate(cases)], "doc_id long, text string, row int")).collect()}
    for i, (labels, text) in enumerate(cases):
        got = set(out[i]["labels"].split(",")) - ({"mit"} if i == 6 else set())  # the first sentence of the body is a notice of its own
        assert got - {""} == set(labels.split(",")) - {""}, (i, text[:60], out[i]["labels"])
    assert out[4]["score"] == 1 and 0.7 <= out[5]["score"] < 1


# mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0)
    free = set(names)
    while free and left > 1e-9:
        unit = left / sum(weight[s] for s in free)
        left, full = 0.0, set()
        for s in list(free):
            target[s] += unit * weight[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                full.add(s)
        free -= full
    return target


def test_mixing(spark, both, none):
    for table in (both, spark.createDataFrame([(i, "w " * (10 if i % 7 else 300), f"s{i % 9}" if i % 9 else None) for i in range(900)], "doc_id long, text string, source string")):
        sizes = collections.Counter()
        for r in table.select("text", "source").collect():
            sizes[r["source"]] += len(BLANKS.findall(r["text"] or ""))
        want, out = brute_targets(sizes), mixing.mix(table).collect()
        assert len(out) == table.count()
        for r in out:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
            assert r["copies"] in (math.floor(r["target"] / max(1, r["source_size"])), math.floor(r["target"] / max(1, r["source_size"])) + 1) and r["copies"] <= 2
        assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix(table.repartition(5)).collect()))
        assert mixing.mixed(table).count() == sum(r["copies"] for r in out) and mixing.mixed(table).columns == table.columns
    taken = collections.Counter()
    for r in out:
        taken[r["source"]] += r["size"] * r["copies"]
    assert sum(taken.values()) == pytest.approx(sum(want.values()), rel=0.1)
    assert mixing.mix(none).count() == 0


def test_very_many_sources(spark):
    """Over 100,000 sources, sums beyond 64 bits, and the same fixed point as step-by-step sharing."""
    many = spark.range(120_000).select(F.concat(F.lit("s"), F.col("id")).alias("source"), (F.col("id") % 1000 * 10**13).alias("size"))
    assert mixing.targets(many).where("target <= 2 * source_size").count() == 120_000
    some = {f"s{i:03}": (i * 37 % 101) ** 3 for i in range(300)} | {None: 5}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(some.items()), "source string, size long")).collect()}
    assert got == pytest.approx(brute_targets(some))


# sharding


def test_sharding(spark, both, none, tmp_path):
    path = str(tmp_path / "map")
    out = sharding.shard(both, path).collect()
    assert len(out) == both.count() and {r["size"] for r in out if r["doc_id"] == 100_000} == {8}
    for s in range(24):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    want = sorted((len((r["text"] or "").encode()) + 8, binascii.crc32((r["text"] or "").encode())) for r in both.collect())
    assert sorted((r["size"], r["text_crc32"]) for r in out) == want
    assert sharding.latest(spark, path) == 2 and {r["shard"] for r in sharding.read_map(spark, path, 1).where("slot = 25").collect()} == {1}
    table = {(r["slot"], r["sub"]): r["shard"] for r in sharding.read_map(spark, path, 2).collect()}
    assert all(table[r["virtual_slot"], r["sub"]] == r["shard"] for r in out)
    assert sharding.digest(none).count() == 0


def test_growing_tables_keep_their_places(spark, tmp_path):
    """A hot key, copies, a rerun over other partitions and a grown table."""
    row = lambda n, at: spark.range(at, at + n).select(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(1).alias("doc_id"), F.when(F.col("id") % 2 == 0, "same text").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    path = str(tmp_path / "map")
    first = sharding.shard(row(6000, 0).repartition(3), path).collect()
    sizes = collections.Counter()
    for r in first:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 24 and max(sizes.values()) <= 1.03 * sum(sizes.values()) / 24 and min(sizes.values()) >= 0.97 * sum(sizes.values()) / 24
    places = lambda rows: collections.Counter((r["doc_id"], r["text_crc32"], r["shard"]) for r in rows)
    again = sharding.shard(row(6000, 0).repartition(7), path).collect()
    assert (places(again) & places(first)).total() > 0.99 * 6000  # next to nothing to mend
    grown = sharding.shard(row(6000, 0).unionByName(row(3000, 6000)), path).collect()
    stayed = (places(first) & places(grown)).total()
    assert sharding.latest(spark, path) == 4 and stayed > 0.85 * 6000
    sizes = collections.Counter()
    for r in grown:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) <= 1.05 * sum(sizes.values()) / 24


def test_rebalancing_moves_little():
    rng = random.Random(1)
    slots = [(i, 0, rng.randrange(500, 1500)) for i in range(4096)]
    old = sharding.rebalance({}, slots, 24)
    grown = [(i, s, n + (2000 if old[i, s] == 3 else 0)) for i, s, n in slots]
    new = sharding.rebalance(old, grown, 24)
    load = collections.Counter()
    for i, s, n in grown:
        load[new[i, s]] += n
    assert max(load.values()) <= 1.02 * sum(load.values()) / 24
    assert sum(old[k] != new[k] for k in old) < 500 and all(old[k] == 3 for k in old if old[k] != new[k])
    wider = sharding.rebalance(old, slots, 25)
    assert all(v == old[k] or v == 24 for k, v in wider.items()) and 24 in wider.values()


# archives


def test_archives(spark, tiny, tmp_path):
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()]
    big = "é\r\n\r\nWARC/1.1\r\n" * 200
    pages += [(1000, "http://a/\r\nx y", big), (1001, None, big), (1002, "u", big), (1003, "u", None), (1004, "u", ""), (1005, "u", "small"), (1006, "u", "small"), (None, "u", big), (1002, "u", big), (1007, "u", "x" * 999), (1008, "u", "x" * 999)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = warc.archive(df)
    rows = out.collect()
    assert len(rows) == len(pages)
    groups = collections.defaultdict(list)
    for p, _, h in pages:
        groups[hashlib.sha1((h or "").encode()).hexdigest()].append(p)
    for r in rows:
        raw = next(h or "" for p, _, h in pages if p == r["page_id"]).encode()
        top = max((p for p in groups[r["payload_digest"]] if p is not None), default=None)
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == hashlib.sha1(raw).hexdigest()
        if len(raw) < 1000 or len(groups[r["payload_digest"]]) == 1:
            assert r["record_type"] == "response" and r["refers_to"] is None and bytes(r["payload"]) == raw
        elif r["record_type"] == "revisit":
            assert r["refers_to"] == top and r["payload"] is None
        else:
            assert r["page_id"] == top
    assert sum(r["record_type"] == "response" for r in rows if r["payload_digest"] == hashlib.sha1(big.encode()).hexdigest()) == 1
    back = warc.resolved(out).collect()
    assert sorted((r["page_id"] or -1, bytes(r["payload"]).decode()) for r in back) == sorted((p or -1, h or "") for p, _, h in pages)
    assert warc.archive(df.limit(0)).count() == 0
    check_files(spark, df, tmp_path)


@pytest.mark.parametrize("sent", [True, False])
def test_a_digest_on_most_pages(spark, monkeypatch, sent):
    """Hot digests, also of one page repeated, give the same records whether their facts are sent or dealt to parts."""
    monkeypatch.setattr(warc, "LEAST", 5)
    monkeypatch.setattr(warc, "SHARE", 20)
    if not sent:
        monkeypatch.setattr(warc, "few", lambda rows: rows)
    pages = [(i, "u", "a" * 1200) for i in range(300)] + [(500, "v", "b" * 1200)] * 40 + [(600 + i % 3, "w", "c" * 1200) for i in range(4)] + [(700, "x", "d" * 1200)]
    out = warc.archive(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5))
    seen = collections.Counter((r["payload_digest"], r["record_type"], r["refers_to"]) for r in out.collect())
    name = lambda c: hashlib.sha1(c.encode() * 1200).hexdigest()
    assert seen == {
        (name("a"), "response", None): 1, (name("a"), "revisit", 299): 299, (name("b"), "response", None): 1, (name("b"), "revisit", 500): 39,
        (name("c"), "response", None): 1, (name("c"), "revisit", 602): 3, (name("d"), "response", None): 1,
    }
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in warc.resolved(out).collect()) == sorted((p, h) for p, _, h in pages)


def check_files(spark, df, tmp_path):
    """Each record is a gzip member of its own, files are bounded and begin with warcinfo, and revisits name their response's record."""
    path = str(tmp_path / "warc")
    warc.write(df.withColumns({"record_type": F.lit("clash"), "payload_digest": F.lit(1)}).repartition(2), path, file_bytes=20_000)
    ids, refers, records = {}, [], 0
    names = [f for f in os.listdir(path) if f.endswith(".warc.gz")]
    assert len(names) > 3
    for name in names:
        members = [m for m in warc._members(memoryview(open(f"{path}/{name}", "rb").read())) if m]
        assert members[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and os.path.getsize(f"{path}/{name}") < 20_000 + 60_000
        for m in members[1:]:
            head = dict(x.split(": ", 1) for x in m.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
            records += 1
            assert m.endswith(b"\r\n\r\n") and head["WARC-Record-ID"] not in ids
            ids[head["WARC-Record-ID"]] = head
            if head["WARC-Type"] == "revisit":
                refers.append(head)
    assert records == df.count() and refers
    for head in refers:
        target = ids[head["WARC-Refers-To"]]
        assert target["WARC-Type"] == "response" and target["WARC-Payload-Digest"] == head["WARC-Payload-Digest"]
    assert warc.read(spark, path).count() == records


# toxicity


def test_toxicity(spark, none):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(3000):
        bad = i % 8 == 0
        w = [f"v{int(rng.paretovariate(0.7)) % 3000}" for _ in range(60)]
        if bad:
            w[rng.randrange(60)] = rng.choice(["nasty", "awful", f"badroot{rng.randrange(400)}"])
            w[rng.randrange(60)] = rng.choice(["nasty", "awful", f"badroot{rng.randrange(400)}"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    rows += [(None, "nasty"), (9001, None), (9002, ""), (1, "v1")]
    labels += [(None, 1, 1), (5, 1, None), (88_888, 1, 1)]
    out = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 3000 and r["held_out"]]
    assert all(binascii.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    right = [r["predicted"] == (r["doc_id"] % 8 == 0) for r in held if r["doc_id"] > 1]
    assert sum(right) / len(right) > 0.97
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(none, empty).count() == 0
    assert {r["predicted"] for r in toxicity.score(spark.createDataFrame(rows[:50], "doc_id long, text string"), empty).collect()} == {0}


def toxic_texts(spark):
    """Texts of which one in eight is toxic, a word in three toxic training texts, and one in 50 training texts, 30 of them toxic."""
    rng = random.Random(5)
    counted = [i for i in range(4000) if binascii.crc32(str(i).encode()) % 5 in (1, 2, 3)]
    bad, good = ([i for i in counted if (i % 8 == 0) == x] for x in (True, False))
    extra = dict.fromkeys(bad[:3], " seldom") | dict.fromkeys(bad[10:40] + good[:20], " mixed")
    text = lambda i: " ".join(f"v{int(rng.paretovariate(0.7)) % 3000}" for _ in range(40)) + (" nasty nasty" if i % 8 == 0 else "") + extra.get(i, "")
    rows = [(i, text(i)) for i in range(4000)] + [(9001, "seldom"), (9002, "mixed"), (9003, "unheard")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(4000)], "doc_id long, quality int, toxic int")


def plain_evidence(rows, marks, texts):
    """Evidence of texts for each length, by dictionaries: two Kneser-Ney spelling models with shared lower orders."""
    grams = lambda w: [("^" + w + "$")[max(0, i + 1 - toxicity.ORDER) : i + 1] for i in range(1, len(w) + 2)]
    counts, first = (collections.Counter(), collections.Counter()), {}
    for i, t in rows:
        if i in marks and (t, marks[i]) not in first:
            first[t, marks[i]] = i
            counts[marks[i]].update(g for w in words(t) for g in grams(w))
    parts = {g[k:] for c in counts for g in c for k in range(len(g))}
    seen = collections.Counter(g[1:] for g in parts if len(g) > 1)
    whole, kinds = collections.Counter(), collections.Counter()
    for g, n in seen.items():
        whole[g[:-1]] += n
        kinds[g[:-1]] += 1
    alphabet, d = len([g for g in parts if len(g) == 1]) + 1, toxicity.DISCOUNT

    def shared(g):
        if not g:
            return 1 / alphabet
        return max(seen[g] - d, 0) / whole[g[:-1]] + d * kinds[g[:-1]] / whole[g[:-1]] * shared(g[1:])

    total, types = [[collections.Counter() for _ in (0, 1)] for _ in (0, 1)]
    for c in (0, 1):
        for g, n in counts[c].items():
            total[c][g[:-1]] += n
            types[c][g[:-1]] += 1
    room = lambda c, h: d * types[c][h] / total[c][h] if total[c][h] else 1.0

    def ratio(g):
        h = g[:-1]
        if not counts[0][g] + counts[1][g]:
            return math.log(room(1, h) / room(0, h))
        p = [(max(counts[c][g] - d, 0) / total[c][h] if total[c][h] else 0) + room(c, h) * shared(g[1:]) for c in (0, 1)]
        return math.log(p[1] / p[0])

    out = []
    for t in texts:
        v = [sum(map(ratio, grams(w))) for w in words(t)]
        best = [max(sum(v[i : i + n]) for i in range(max(1, len(v) - n + 1))) / n for n in toxicity.LENGTHS if n]
        out.append([*best, sum(v) / max(1, len(v))])
    return out


def test_evidence_equals_a_plain_model(spark, monkeypatch):
    documents, labels = toxic_texts(spark)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()] + [(9100, None), (9101, " "), (9102, "é日本𝒳 nasté nas"), (9103, "v1 " * 200 + "nasty")]
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["doc_id"] % 3 == 0}
    marked = spark.createDataFrame(list(marks.items()), "doc_id long, toxic int")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    some = [x for x in rows if x[0] > 9000 or x[0] % 97 == 0]
    want = dict(zip([i for i, _ in some], plain_evidence(rows, marks, [t for _, t in some]), strict=True))
    ratios = toxicity.Model(table, marked).ratios()
    for hot in (toxicity.HOT, 200):  # the second way: most expressions go by a shuffle
        monkeypatch.setattr(toxicity, "HOT", hot)
        got = {r["doc_id"]: r["runs"] for r in toxicity.evidence(table, ratios).collect()}
        assert len(got) == len(rows)
        for i, runs in want.items():
            assert got[i] == pytest.approx(runs, abs=1e-9), i


def test_little_evidence_counts(spark):
    documents, labels = toxic_texts(spark)
    found = {r["doc_id"]: r for r in toxicity.score(documents.withColumn("score", F.lit("clash")), labels).where("doc_id > 9000").collect()}
    assert found[9001]["evidence"] > found[9003]["evidence"] and found[9002]["evidence"] > 0


# all


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(name, spark, tiny, oracle, same_rows):
    same_rows(queries.queries()[name](spark, tiny).toPandas(), oracle(queries.oracle_sql()[name]))


@pytest.mark.parametrize("name", ["op1_quality_rules", "op4_chat_perspectives", "op5_license_scan", "op6_source_mixing"])
def test_native_plans(name, spark, tiny):
    plan = queries.queries()[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rejected_rows_leave_alone(spark, docs):
    gone = docs.where("doc_id = 3 and text = 'one' or doc_id is null and text is null").select("doc_id", F.xxhash64("text").alias("text_hash"))
    left = columns.without_rows(docs, gone).collect()
    assert len(left) == docs.count() - 2 and any(r["doc_id"] == 3 for r in left)


def test_rows_of_one_id_have_draws_of_their_own(spark):
    rows = [(7, "a b c d e f g h", "x")] * 3000 + [(None, "a b", None)] * 1000 + [(i, "one two three", "y") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, other = (sorted(map(tuple, mixing.mix(d).select("doc_id", "size", "source", "target", "copies").collect()), key=str) for d in (df.repartition(7), df.coalesce(1)))
    assert one == other and len(one) == len(rows)
    for source in ("x", "y", None):
        taken, target = sum(r[1] * r[4] for r in one if r[2] == source), next(r[3] for r in one if r[2] == source)
        assert abs(taken - target) < 0.05 * target
