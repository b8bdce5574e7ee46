"""Passages, near duplicates and lines against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from pricetide.llm import common, components, decontaminate, jaccard, language, lines, substring, toxicity
from pricetide.llm.common import words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [(None, None), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One two"), (6, "one two"), (7, "one two three four"), (None, "no id " * 20), (8, "x" * 50_000), (9, "é ü ÀB  z")]


def corpus(seed=3):
    """Texts that share passages, near copies, exact copies, repeated rows, and the edge cases."""
    r = random.Random(seed)
    say = lambda n: [r.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + str(r.randrange(60)) for _ in range(n)]
    passages = [say(r.randrange(30, 90)) for _ in range(4)]
    out, texts = list(EDGES), []
    for i in range(60):
        words = say(r.randrange(5, 120))
        if i % 3 == 0:
            words[2:2] = r.choice(passages)[: r.randrange(20, 90)]
        if texts and i % 4 == 0:
            words = list(r.choice(texts))
            for _ in range(r.randrange(0, 6)):
                words[r.randrange(len(words))] = "new" + str(r.randrange(99))
        if i % 10 == 0:
            words = words + ["the same"] * 50
        texts.append(words)
        out.append((100 + i, "".join(w + (r.choice([" ", "\n", "  ", " ", " "])) for w in words)))
    out += [(500, out[20][1]), (501, out[20][1]), out[21], out[21]]
    out.append((900, "again and again " * 400))
    return out


def covered(texts, width=35):
    where = {}
    split = [WORD.findall(t or "") for t in texts]
    for i, w in enumerate(split):
        for k in range(len(w) - width + 1):
            where.setdefault(tuple(w[k : k + width]), []).append((i, k))
    gone = [set() for _ in texts]
    for places in where.values():
        if len(places) > 1:
            for i, k in places:
                gone[i].update(range(k, k + width))
    return split, gone


def test_words_and_grams():
    texts = ["a bb  ccc", "", None, "é \n x", "bb ccc"]
    (w,) = words_of(pa.array(texts))
    assert np.diff(w.first).tolist() == [3, 0, 0, 2, 2]
    assert w.hashes[1] == w.hashes[5] and w.hashes[2] == w.hashes[6] and len(set(w.hashes.tolist())) == 5
    grams, first = w.grams(2)
    assert np.diff(first).tolist() == [2, 0, 0, 1, 1] and grams[1] == grams[3]
    assert next(iter(words_of(pa.array(["AÀ"]), lower=True))).hashes[0] == next(iter(words_of(pa.array(["aÀ"])))).hashes[0]


@pytest.mark.parametrize("seed", [3, 4])
def test_substring_against_all_windows(docs_of, seed):
    rows = corpus(seed)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(substring.remove(docs_of(rows).repartition(3))).collect())
    split, gone = covered([t for _, t in rows])
    want = []
    for (i, _), w, g in zip(rows, split, gone):
        kept = " ".join(x for k, x in enumerate(w) if k not in g)
        want.append((str(i), len(w), len(g), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == sorted(want)
    assert sum(len(g) for g in gone) > 1000


def test_factors_copy_their_sources(docs_of):
    """Every factor's words stand at its source, none goes on where the one before ends, and together they are the spans."""
    rows = [r for r in corpus(5) if r[0] is not None]
    docs = docs_of(rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    words = {(r.doc_id, r.key): WORD.findall(r.text) for r in docs.collect()}
    n = 0
    for r in substring.factors(docs).collect():
        w, last = words[r.doc_id, r.key], None
        for f in r.factors:
            assert f.high - f.low >= substring.WINDOW and w[f.low : f.high] == words[f.source_id, f.source_key][f.source_low : f.source_low + f.high - f.low]
            begin = (f.source_id, f.source_key, f.source_low, f.low)
            # The windows of the factor before end here or earlier, and its copy does not go on here.
            assert last is None or last[3] <= f.low and last != begin
            last = (f.source_id, f.source_key, f.source_low + f.high - f.low - substring.WINDOW + 1, f.high - substring.WINDOW + 1)
            n += 1
        assert {k for s in r.spans for k in range(s.low, s.high)} == {k for f in r.factors for k in range(f.low, f.high)}
    assert n > 30


def test_one_change_makes_two_factors(docs_of):
    first = [f"w{i}" for i in range(900)]
    rows = [(1, " ".join(first)), (2, " ".join(["x", *first[:400], "new", *first[401:]]))]
    docs = docs_of(rows).select("doc_id", "text", F.xxhash64("text").alias("key"))
    got = {r.doc_id: [(f.low, f.high, f.source_id, f.source_low) for f in r.factors] for r in substring.factors(docs).collect()}
    assert got == {1: [(0, 400, 1, 0), (401, 900, 1, 401)], 2: [(1, 401, 1, 0), (402, 901, 1, 401)]}


def shingles(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()


def components_of(sets):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_against_all_pairs(docs_of, seed):
    rows = corpus(seed)
    sets = [shingles(t) for _, t in rows]
    label = components_of(sets)
    want = []
    for (i, _), s, x in zip(rows, sets, label):
        ids = [d for (d, _), y in zip(rows, label) if y == x and d is not None] if s else [i]
        want.append((str(i), len(s), str(min(ids) if ids and ids[0] is not None else None)))
    got = [(str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.near_duplicates(docs_of(rows).repartition(3)).collect()]
    assert sorted(got) == sorted(want)
    assert len(set(label)) < len(rows)


@pytest.mark.parametrize("small", [1, 8, 10_000])
def test_links_of_a_family_and_strangers(monkeypatch, small):
    """All sizes of cells give the components of all pairs."""
    monkeypatch.setattr(jaccard, "SMALL_CELL", small)
    r = np.random.default_rng(small)
    base = [r.choice(10_000, 60, replace=False) + 10_000 * f for f in range(4)]
    sets = []
    for i in range(160):
        s = base[i % 4].copy()
        s[r.choice(60, r.integers(0, 8), replace=False)] = r.integers(10**6, 10**7, 1)
        sets.append(np.unique(s.astype(np.uint64)))
    want = components_of([frozenset(s.tolist()) for s in sets])
    label = list(range(len(sets)))
    for a, b in jaccard.links(sets):
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = [new if x == old else x for x in label]
    assert label == want and jaccard.links([]) == []


def test_jaccard_blocks_of_a_large_region(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_SHINGLES", 300)
    base = [f"w{i}" for i in range(70)]
    rows = []
    for i in range(40):
        w = list(base)
        for k in range(i % 4):
            w[(i * 7 + k) % 70] = f"x{i}"
        rows.append((i, " ".join(w)))
    label = components_of([shingles(t) for _, t in rows])
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs_of(rows)).collect()}
    assert [got[i] for i in range(40)] == label


def linked(pairs):
    """node, root of a graph by plain union."""
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def graph(seed):
    """A star, a path in random order, and small random components, with repeated links."""
    r = random.Random(seed)
    at = r.sample(range(-(10**6), 10**6), 2000)
    path = at[600:1000]
    pairs = [(at[300], at[i]) for i in range(300)] + list(zip(path, path[1:])) + [(at[1000 + 8 * k + r.randrange(8)], at[1000 + 8 * k + r.randrange(8)]) for k in range(125) for _ in range(7)]
    pairs = [(a, b) for a, b in [*pairs, *pairs[::7]] if a != b]
    r.shuffle(pairs)
    return pairs


@pytest.mark.parametrize("most", [1, 50, 1 << 19])
def test_components_of_a_graph(spark, monkeypatch, most):
    """Integers and bytes; a task that holds few links at once gives the same."""
    monkeypatch.setattr(components, "MOST_LINKS", most)
    pairs = graph(most)
    want = linked(pairs)
    stars = [(x.as_py(), y.as_py()) for batch in components.contract(pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in pairs[k : k + 20]]) for k in range(0, len(pairs), 20)) for x, y in zip(*batch.columns)]
    assert linked(stars) == want and all(a > b for a, b in stars)
    if most > 50:
        links = spark.createDataFrame(pairs, "a long, b long").repartition(5)
        got = [(r.node, r.root) for r in components.components(links).collect()]
        assert sorted(got) == sorted(want.items())
        named = {x: f"{x + 10**6:08d}".encode() for p in pairs for x in p}
        links = spark.createDataFrame([(named[a], named[b]) for a, b in pairs], "a binary, b binary").repartition(3)
        got = [(bytes(r.node), bytes(r.root)) for r in components.components(links).collect()]
        assert sorted(got) == sorted((named[x], named[y]) for x, y in want.items())


def test_components_in_few_rounds(spark, monkeypatch):
    """Families whose links stand in one partition are settled by the first pass: two tables are written."""
    written = []
    monkeypatch.setattr(components, "stage", lambda df, name, to=components.stage: written.append(name) or to(df, name))
    pairs = [(f * 1000 + i, f * 1000 + i + 1) for f in range(4) for i in range(500)]
    got = components.components(spark.createDataFrame(pairs, "a long, b long").repartition(1)).collect()
    assert sorted((r.node, r.root) for r in got) == sorted(linked(pairs).items())
    assert len(written) == 2


def test_frequent_shingles_in_few_jobs(spark, docs_of):
    """The number of jobs does not grow with that of the shuffle's partitions."""
    rows = [(i, " ".join(f"w{(i * k) % 13}" for k in range(30 + i % 7))) for i in range(400)]
    docs = docs_of(rows).select(F.encode("text", "utf-8").alias("key"), "text")
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    kept, jobs = {k: spark.conf.get(k) for k in names}, []
    try:
        spark.conf.set(names[1], "false")
        for n in ("2", "40"):
            spark.conf.set(names[0], n)
            before = max(spark.sparkContext.statusTracker().getJobIdsForGroup(), default=0)
            found = jaccard._frequent(docs, 4)
            docs.count()
            jobs.append(max(spark.sparkContext.statusTracker().getJobIdsForGroup()) - before)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(found) and (np.diff(found.astype(object)) > 0).all()
    assert jobs[1] <= jobs[0] + 2


def test_empty_tables(docs_of):
    empty = docs_of([(1, "x")]).where("false")
    assert substring.remove(empty).count() == 0
    assert jaccard.near_duplicates(empty).count() == 0
    assert lines.dedup_lines(empty).count() == 0


def test_patience_alignment():
    a, b = list("abcxdef"), list("zabcydqf")
    matched = lines.align(a, b)
    assert matched == [(0, 1), (1, 2), (2, 3), (4, 5), (6, 7)]
    assert [len(x) for x in lines.blocks(matched)] == [3, 1, 1]
    # A moved block: only the longest common order is aligned.
    assert lines.align(list("12345"), list("45123")) == [(0, 2), (1, 3), (2, 4)]
    assert lines.align([], [1]) == [] and lines.align([1, 1], [1]) == [(0, 0)]
    assert lines.common_lines([1, 2, 3], [1, 2, 9], [4, 3, 9], 8) == [] and lines.common_lines([1, 2, 3], [1, 2, 9], [4, 4, 9], 8) == [0, 1]


def test_lines_against_first_holders(docs_of):
    long = "this line has a good number of words in it"
    rows = [
        (5, f"{long}\nfive\nsix"), (2, f"  {long} \nfive\nseven"), (3, f"three\n{long}\n\nthree"), (3, f"three\n{long}\n\nthree"),
        (7, "a b c\nd e f\ng h i"), (8, "new\na b c\nd e f\ng h i\nlast"), (9, None), (10, ""), (None, long), (11, "short\nline"), (12, "short\nother"),
    ]
    got = lines.dedup_lines(docs_of(rows).repartition(2)).collect()
    texts = sorted((str(r.doc_id), str(r.text), r.n_removed, r.words_left) for r in got)
    assert texts == sorted([
        ("5", "six", 2, True), ("2", f"  {long} \nfive\nseven", 0, True), ("3", "three\n\nthree", 1, True), ("3", "three\n\nthree", 1, True),
        ("7", "a b c\nd e f\ng h i", 0, True), ("8", "new\nlast", 3, True), ("9", "None", 0, True), ("10", "", 0, True), ("None", "", 1, False),
        ("11", "short\nline", 0, True), ("12", "short\nother", 0, True),
    ])
    assert set(got[0].asDict()) >= {"kept", "score", "source", "n_lines"}


def test_profiles_never_part_linked_sets():
    r = np.random.default_rng(5)
    for n in (1, 5, 40, 255, 256, 300, 2100):
        for _ in range(30):
            s = np.unique(r.integers(0, 10**9, n).astype(np.uint64))
            t = s.copy()
            t[r.choice(len(s), r.integers(0, len(s) // 6 + 1), replace=False)] = r.integers(10**9, 10**10, 1)
            t = np.unique(np.concatenate([t, r.integers(10**9, 10**10, r.integers(0, n // 12 + 1)).astype(np.uint64)]))
            both = len(np.intersect1d(s, t))
            if 100 * both >= 85 * (len(s) + len(t) - both):
                assert jaccard.may_link(jaccard.profile(s), jaccard.profile(t), len(s) + len(t))
    a, b = (np.unique(r.integers(0, 10**9, 400).astype(np.uint64)) for _ in range(2))
    assert not jaccard.may_link(jaccard.profile(a), jaccard.profile(b), 800)


@pytest.mark.parametrize("listed", [1, 4, 64])
def test_long_regions_are_chained(docs_of, monkeypatch, listed):
    monkeypatch.setattr(jaccard, "MOST_LISTED", listed)
    rows = corpus(7)
    sets = [shingles(t) for _, t in rows]
    label = components_of(sets)
    got = [(str(r.doc_id), r.component_id) for r in jaccard.near_duplicates(docs_of(rows)).collect()]
    want = []
    for (i, _), s, x in zip(rows, sets, label):
        ids = [d for (d, _), y in zip(rows, label) if y == x and d is not None] if s else [i]
        want.append((str(i), min(ids) if ids and ids[0] is not None else None))
    assert sorted(got, key=str) == sorted(want, key=str)


def strangers(count, own=80, common=24):
    """Texts that share a passage of fewer words than their own: their shingles meet in regions, but none links."""
    r = random.Random(count)
    passage = " ".join(f"same{i}" for i in range(common))
    return [(i, " ".join([passage, *(f"w{r.randrange(10**6)}" for _ in range(own + i % 5))])) for i in range(count)]


@pytest.mark.parametrize("count", [40, 150])
def test_strangers_of_a_region_are_not_joined(docs_of, monkeypatch, count):
    """Texts that share frequent shingles only, also more than are listed, are sent to no task to be joined."""
    monkeypatch.setattr(jaccard, "MOST_FREQUENT", 0)
    sent = []
    monkeypatch.setattr(jaccard, "_units", lambda members, to=jaccard._units: sent.append(members.count()) or to(members))
    rows = [*strangers(count), (900, strangers(count)[7][1] + " end"), (901, strangers(count)[7][1] + " ends")]
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs_of(rows)).collect()}
    assert got == {i: 7 if i > 800 else i for i, _ in rows}
    assert sent == [3]


@pytest.mark.parametrize("listed, compared", [(1, 8192), (3, 8192), (1, 5), (128, 20)])
def test_regions_and_hubs_of_any_size(docs_of, monkeypatch, listed, compared):
    """Small, long and chained regions and hubs give the components of all pairs."""
    monkeypatch.setattr(jaccard, "MOST_LISTED", listed)
    monkeypatch.setattr(jaccard, "MOST_COMPARED", compared, raising=False)
    base = [r for r in corpus(8) if r[0] is None or r[0] != 900]
    r = random.Random(6)
    family = [(2000 + i, " ".join(w if r.random() > 0.01 else f"n{i}" for w in (f"f{k}" for k in range(60 + i % 9)))) for i in range(45)]
    rows = [*base, *family, *strangers(12)]
    sets = [shingles(t) for _, t in rows]
    label = components_of(sets)
    want = []
    for (i, _), s, x in zip(rows, sets, label):
        ids = [d for (d, _), y in zip(rows, label) if y == x and d is not None] if s else [i]
        want.append((str(i), min(ids) if ids and ids[0] is not None else None))
    got = [(str(r.doc_id), r.component_id) for r in jaccard.near_duplicates(docs_of(rows).repartition(2)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_connected_asks_what_it_must():
    """The components of all neighbours, with few questions in a large family."""
    r = np.random.default_rng(4)
    for n in (1, 2, 30, 200):
        near = r.random((n, n)) < 1.2 / n
        near |= near.T
        label = jaccard.connected(n, lambda i: np.flatnonzero(near[i]))
        want = linked([(i, int(k)) for i in range(n) for k in [i, *np.flatnonzero(near[i])]])
        assert label.tolist() == [want[i] for i in range(n)]
    asked = []
    assert set(jaccard.connected(500, lambda i: asked.append(i) or np.arange(500)).tolist()) == {0} and asked == [0]


def test_only_what_may_be_in_a_table_is_told_so(spark, monkeypatch):
    rows = spark.range(4000).select(F.when(F.col("id") != 3, F.col("id")).alias("x"), F.col("id").cast("string").alias("y"))
    keys = rows.where("y in ('3', '40', '777')").select(F.col("x").alias("a"), F.col("y").alias("b"))
    for most, limit in ((common.MOST_BITS, 60), (64, 4000)):
        monkeypatch.setattr(common, "MOST_BITS", most)
        told = common.may_be_in(rows, [F.col("x"), F.col("y")], keys, ["a", "b"])
        found = {r.y for r in told.where("_in").collect()}
        assert told.columns == ["x", "y", "_in"] and told.count() == 4000 and {"3", "40", "777"} <= found and len(found) < limit
    assert not common.may_be_in(rows, [F.col("x"), F.col("y")], keys.where("false"), ["a", "b"]).where("_in").count()


def test_texts_that_are_not_joined_stay(docs_of, monkeypatch):
    """Of rows without a neighbour none is told to be shuffled with the texts to be joined."""
    rows = [*strangers(60), (900, strangers(60)[7][1] + " end")]
    told = []
    monkeypatch.setattr(jaccard, "may_be_in", lambda *a, to=jaccard.may_be_in: told.append(to(*a)) or told[-1])
    jaccard.near_duplicates(docs_of(rows)).collect()
    assert {r.doc_id for r in told[0].where("_in").collect()} >= {7, 900} and told[0].where("_in").count() <= 12


def test_lines_beside_columns_of_any_name(docs_of):
    long = "this line has more than eight words in it, truly"
    rows = [(1, f"a\n{long}"), (2, f"b\n{long}"), (None, f"c\n{long}")]
    docs = docs_of(rows).withColumns({"gone": F.lit(9), "_key": F.lit("k"), "_OWN": F.lit(1.5), "_doc_id": F.lit(0), "_gone": F.lit(7), "a b": F.lit(4)})
    got = sorted((r.text, r.gone, r["_key"], r["_OWN"], r["_doc_id"], r["_gone"], r["a b"]) for r in lines.dedup_lines(docs).collect())
    assert got == [(f"a\n{long}", 9, "k", 1.5, 0, 7, 4), ("b", 9, "k", 1.5, 0, 7, 4), ("c", 9, "k", 1.5, 0, 7, 4)]


def test_very_long_texts(spark, docs_of):
    """Two texts of 3 MB that share all but their ends, next to short ones."""
    r = random.Random(4)
    words = [f"word{r.randrange(5000)}x{i % 977}" for i in range(230_000)]
    first, second = " ".join(words), " ".join([*words[:-20], *(f"other{i}" for i in range(20))])
    docs = docs_of([(1, first), (2, second), (3, "short one"), (4, None)]).repartition(2)
    n = {r.doc_id: (r.n_words, r.n_removed) for r in substring.digests(substring.remove(docs)).collect()}
    assert n == {1: (230_000, 229_980), 2: (230_000, 229_980), 3: (2, 0), 4: (0, 0)}
    near = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 4}
    assert [r.n_lines for r in lines.dedup_lines(docs).orderBy("doc_id").collect()] == [1, 1, 1, 0]
    item = spark.createDataFrame([(1, " ".join(words[100_000:100_030]))], "item_id long, text string")
    assert sorted((r.doc_id, r.start) for r in decontaminate.leaks(docs, item).collect()) == [(1, 100_000), (2, 100_000)]
    assert {r.doc_id: r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit("en"))).collect()} == {1: "en", 2: "en", 3: "en", 4: "und"}
    labels = spark.createDataFrame([(1, 0, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, labels).count() == 4
