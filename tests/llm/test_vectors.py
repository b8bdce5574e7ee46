"""Whitening, ranked search and near duplicates of embeddings against brute force."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pricetide.llm import lattice, queries, ranked, whitening
from tools.check import canonical

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def vectors_of(spark):
    """An embeddings table from (vec_id, entries) rows, with columns whose names clash with results."""

    def make(rows):
        return spark.createDataFrame([(i, v, 3, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, n long, key long, x string")

    return make


BAD = [(900, None), (901, []), (902, [1.0, None, 2.0, 0.5]), (903, [1.0, math.nan, 2.0, 0.5]), (904, [1.0, math.inf, 2.0, 0.5]), (None, None)]


# ---- whitening --------------------------------------------------------------------------------


@pytest.mark.parametrize("d, rank", [(1, 1), (2, 2), (3, 3), (12, 12), (40, 40), (30, 5)])
def test_eigenvectors(d, rank):
    r = np.random.default_rng(d)
    m = r.normal(size=(d, rank)) * np.linspace(1, 9, rank)
    v = m @ m.T
    values, vectors = whitening.leading(v, d)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], atol=1e-12 * np.abs(v).max() * d)
    assert np.allclose(v @ vectors, vectors * values, atol=1e-11 * np.abs(v).max() * d)
    assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-11)


@pytest.mark.parametrize("values", [[5, 5, 5, 2, 2, 1, 1, 1], [3, 3 - 1e-13, 3 - 2e-13, 1, 0, 0], [1] * 6, [0] * 4, [1e-300, 5e-301, 1e-301], [1e300, 1e299, 1e10]])
def test_eigenvectors_of_equal_and_extreme_values(values):
    """Clusters, a multiple of the identity, a null matrix, entries near the ends of what doubles hold."""
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(d, d)))[0]
    size = max(values) or 1.0
    v = (q * (np.array(values, float) / size)) @ q.T * size
    found, vectors = whitening.leading((v + v.T) / 2, d)
    assert np.allclose(found / size, np.array(values, float) / size, atol=1e-13)
    assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-11)
    assert np.allclose((v / size) @ vectors, vectors * (found / size), atol=1e-12)


def test_tridiagonal_and_sturm_counts():
    v = np.cov(np.random.default_rng(5).normal(size=(9, 50)))
    a, b, mirrors = whitening.tridiagonal(v)
    t = np.diag(a) + np.diag(b, 1) + np.diag(b, -1)
    for k, u in reversed(list(enumerate(mirrors))):
        h = np.eye(9)
        h[k + 1 :, k + 1 :] -= 2 * np.outer(u, u)
        t = h @ t @ h
    assert np.allclose(t, v)
    values = np.linalg.eigvalsh(v)
    points = np.append(values - 1e-9, values + 1e-9)
    assert whitening.below(a, b, points).tolist() == [int((values < x).sum()) for x in points]


@pytest.mark.parametrize("most", [10, 2**20, 2**30, 2**45, 2**60])
def test_squares_are_exact(most):
    y = np.random.default_rng(0).integers(-most, most, (20, 7))
    assert whitening.squares(y) == [sum(int(k) ** 2 for k in row) for row in y]
    assert whitening.squares(y.astype(object)) == whitening.squares(y)


def test_distance_from_the_mean_is_exact():
    x = np.array([[10**6, 5], [-(2**40), 7]])
    for n in (2, 10**12):
        sums = [n * 3 + 1, -n * 2]
        assert [[int(k) for k in row] for row in whitening.from_mean(x, n, sums)] == [[n * int(k) - s for k, s in zip(row, sums)] for row in x]


def plain_whitening(rows, k=32):
    x = np.floor(64 * np.array(rows)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return ((n * x - s) ** 2).sum(axis=1), y @ vectors / np.sqrt(values), values / np.trace(v)


def test_whitening(vectors_of):
    r = np.random.default_rng(3)
    good = (r.normal(size=(300, 4)) * [3, 2, 1, 0.5]).tolist()
    rows = list(enumerate(good)) + [(None, good[0]), (7, good[7]), *BAD, (905, [1.0, 2.0]), (906, [1e300, 0.0, 0.0, 0.0])]
    got = whitening.whiten(vectors_of(rows).repartition(5)).toPandas()
    used = [v for i, v in rows if i is None or i < 900 if v]
    deviation, w, explained = plain_whitening(used)
    assert len(got) == 302 * 4 and set(got.n) == {302} and (got.identity_error <= 1e-10).all()
    by_row = {i: got[got.vec_id == i].sort_values("component") for i in (0, 7, 123)}
    sign = np.sign([by_row[123].whitened.iloc[k] * w[123, k] for k in range(4)])
    for i in (0, 123):
        assert np.allclose(by_row[i].whitened, w[i] * sign, atol=1e-9)
        assert {int(x) for x in by_row[i].deviation} == {int(deviation[i])}
    assert len(by_row[7]) == 8
    assert np.allclose(got.groupby("component").explained.first(), explained, rtol=1e-9)


@pytest.mark.parametrize("rows", [[], BAD, [(1, [1.0, 2.0])], [(i, [0.5, 0.25, 2.0]) for i in range(9)]])
def test_whitening_without_spread(vectors_of, rows):
    assert whitening.whiten(vectors_of(rows)).count() == 0


def test_whitening_leaves_out_directions_without_spread(vectors_of):
    r = np.random.default_rng(8)
    got = whitening.whiten(vectors_of([(i, [float(a), float(b), float(a), 1.0]) for i, (a, b) in enumerate(r.normal(size=(50, 2)))]))
    assert {x.component for x in got.select("component").distinct().collect()} == {1, 2}
    assert got.first().identity_error < 1e-9


# ---- ranked search ----------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def plain_search(docs, items, best=50):
    texts = [(i, Counter(TERM.findall((t or "").translate(_LOWER)))) for i, t in docs]
    texts = [(i, c) for i, c in texts if c]
    number, length = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(TERM.findall((t or "").translate(_LOWER)))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c in texts:
            m = 50 + 50 * sum(c.values()) * number // length
            score = sum(int(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1)))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, rank, i, -score) for rank, (score, i) in enumerate(sorted(found)[:best], 1)]
    return sorted(out)


def some_docs(n, seed=4):
    r = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    say = lambda k: " ".join(words[int(i)] for i in np.minimum(r.zipf(1.3, k), 400) - 1)
    docs = [(i * 3, say(int(r.integers(1, 90)))) for i in range(n)]
    docs += [(1, None), (2, ""), (4, " -- \t"), (None, say(30)), (5, "W1, w1;W2"), (5, "W1, w1;W2"), (7, "É é w3 ünï"), (8, "w5 " * 30_000 + say(9000)), (10, docs[0][1]), (11, docs[0][1])]
    items = [(i, say(12)) for i in range(12)] + [(50, None), (51, ""), (52, "É nowhere"), (None, "w1"), (53, "w1"), (53, "w2 w9"), (54, "w1 " * 50 + "w399")]
    return docs, items


@pytest.mark.parametrize("layout", [ranked.Layout(), ranked.Layout(docs=64, block=4, span=16, seeds=2), ranked.Layout(docs=300, postings=2000, block=8, span=100, seeds=3)])
def test_search(spark, docs_of, layout):
    """Whole shards, and shards, blocks and ranges so small that every bound is at work."""
    docs, items = some_docs(700)
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")
    want = plain_search(docs, items)
    for most in (ranked.MOST_TERMS, 20):
        got = ranked.search(docs_of(docs).repartition(3), table, most_terms=most, layout=layout)
        assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, ranked.search(docs_of(docs), table, best=3, layout=layout).collect())) == plain_search(docs, items, 3)


def test_search_of_nothing(spark, docs_of):
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert ranked.search(docs_of([(1, "w1")]).where("false"), items).count() == 0
    assert ranked.search(docs_of([(1, "w1")]), items.where("false")).count() == 0
    assert ranked.search(docs_of([(1, None), (2, "??")]), items).count() == 0


def test_blocks_come_back():
    r = np.random.default_rng(0)
    for most in (1, 2, 300, 2**40):
        for n in (1, 2, 127, 128):
            docs = np.cumsum(r.integers(1, most + 1, n))
            counts = r.integers(1, most + 1, n)
            back = ranked.decompressed(memoryview(ranked.compressed(docs, counts)), int(docs[0]))
            assert (back[0] == docs).all() and (back[1] == counts).all()


def test_block_maxima_save_work():
    """Common terms stay packed where the least score rules their blocks out."""
    r = np.random.default_rng(1)
    n = 4000
    rare = r.choice(n, 40, replace=False)
    each = np.full(n, 1) + np.isin(np.arange(n), rare)
    terms = np.concatenate([[1, 2] if k == 2 else [1] for k in each]).astype(np.int64)
    counts = np.where(terms == 1, r.integers(1, 4, len(terms)), r.integers(1, 50, len(terms)))
    row = ranked.shard(np.arange(n) * 2, np.full(n, 100), each, terms, counts).to_pylist()[0]
    shard = ranked.Shard(row)
    ids, scores = shard.search(np.array([1, 2]), np.array([10, 5000]), 1, 10)
    part = lambda c: 10**9 * c // (1000 * c + 2000)
    count_of = {(d, t): int(c) for d, t, c in zip(np.repeat(np.arange(n), each).tolist(), terms.tolist(), counts)}
    want = sorted((-(10 * part(count_of[d, 1]) + 5000 * part(count_of[d, 2])), int(d) * 2) for d in rare)[:10]
    assert sorted(zip((-scores).tolist(), ids.tolist())) == want
    # The rare term's only block, and less than all of the common one's.
    again = ranked.Shard(row)
    again.search(np.array([1, 2]), np.array([10, 5000]), int(scores.min()), 10)
    assert again.work.candidates == 40 and again.work.rejected > 0
    assert again.work.unpacked < again.work.blocks == 1 + math.ceil(n / ranked.Layout.block)


# ---- near duplicates of embeddings ------------------------------------------------------------


def plain_links(rows, cosine=lattice.COSINE):
    good = [k for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = {k: np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in good}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    links, group = [0] * len(rows), {k: {k} for k in range(len(rows))}
    for a in good:
        for b in good:
            if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                links[a] += 1
                if group[a] is not group[b]:
                    group[a] |= group[b]
                    for k in group[b]:
                        group[k] = group[a]
    out = []
    for k, (i, _) in enumerate(rows):
        least = min((rows[m][0] for m in group[k] if rows[m][0] is not None), default=None)
        out.append((str(i), links[k], str(least), i is not None and i == least))
    return sorted(out)


def some_vectors(d, seed=2):
    r = np.random.default_rng(seed)
    out = []
    for g in range(12):
        centre = r.normal(size=d)
        centre /= np.linalg.norm(centre)
        for _ in range(int(r.integers(1, 14))):
            out.append(centre + r.normal(size=d) * r.choice([0.002, 0.02, 0.03]) * 8 / np.sqrt(d))
    out += list(r.normal(size=(150, d)))
    rows = [(i, v.tolist()) for i, v in zip(r.permutation(len(out)).tolist(), out)]
    same = rows[5][1]
    rows += [(500 + k, same) for k in range(20)] + [(600, [3 * x for x in same]), (601, [-x for x in same]), (None, same), (None, r.normal(size=d).tolist()), (610, [1e300 * x for x in same])]
    return rows + [rows[8]] + BAD + [(907, [0.0] * d), (908, [0.0, -0.0]), (909, [1.0, 2.0]), (910, [1.0, 2.1]), (911, [2.0]), (912, [3.0])]


def told(rows):
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in rows)


@pytest.mark.parametrize("d, cell", [(64, 1024), (64, 3), (5, 1024), (5, 7)])
def test_near_duplicates(vectors_of, monkeypatch, d, cell):
    """Cells in one task, and cells cut into blocks; fewer dimensions than the lattice blocks have."""
    monkeypatch.setattr(lattice, "CELL", cell)
    rows = some_vectors(d)
    assert told(lattice.near_duplicates(vectors_of(rows).repartition(4)).collect()) == plain_links(rows)


def test_near_duplicates_of_nothing(vectors_of):
    assert lattice.near_duplicates(vectors_of([])).count() == 0
    assert told(lattice.near_duplicates(vectors_of(BAD)).collect()) == plain_links(BAD)


def test_decode_finds_the_nearest_lattice_point():
    r = np.random.default_rng(6)
    y = r.normal(size=(3000, 8)) * 3
    x = lattice.decode(y)
    doubled = np.rint(2 * x).astype(int)
    assert (np.abs(2 * x - doubled) == 0).all() and np.isin(doubled.sum(axis=1) % 4, [0]).all()
    assert ((doubled % 2).min(axis=1) == (doubled % 2).max(axis=1)).all()
    # No lattice neighbour is nearer.
    own = ((y - x) ** 2).sum(axis=1)
    assert len(lattice.ROOTS) == 240 and ((lattice.ROOTS**2).sum(axis=1) == 2).all()
    assert all((((y - x - v) ** 2).sum(axis=1) >= own - 1e-9).all() for v in lattice.ROOTS)
    assert own.max() <= 1 + 1e-9


@pytest.mark.parametrize("cosine, recall", [(0.95, 0.985), (0.96, 0.995), (0.97, 0.999), (0.98, 0.9999)])
def test_recall_by_cosine(cosine, recall):
    """Of random pairs at just this cosine, how many share a cell."""
    r = np.random.default_rng(9)
    n, d = 10_000, 64
    u = r.normal(size=(n, d))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = r.normal(size=(n, d))
    w -= (w * u).sum(axis=1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    table = lattice.Tables(d)
    a, b = table.cells(u), table.cells(cosine * u + math.sqrt(1 - cosine**2) * w)
    step = lattice.PROBES
    met = np.zeros(n, bool)
    for t in range(0, a.shape[1], step):
        met |= (a[:, t : t + step, None] == b[:, None, t : t + step]).any(axis=(1, 2))
    assert met.mean() >= recall
    # Unrelated vectors rarely meet.
    _, often = np.unique(np.concatenate([a.ravel(), table.cells(w[::-1]).ravel()]), return_counts=True)
    assert (often * (often - 1) / 2).sum() < 3e-5 * n * n * 2


# ---- registered queries -----------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op12_ranked", "op13_lattice"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALLEST}/{t}.parquet')")
    got, want = queries.REGISTRY[name](spark, SMALLEST).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def test_whitening_query(spark):
    got = queries.op11_whitening(spark, SMALLEST)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = [r.embedding for r in spark.read.parquet(f"{SMALLEST}/embeddings.parquet").orderBy("vec_id").collect()]
    deviation, w, explained = plain_whitening(rows)
    table = got.toPandas().sort_values(["vec_id", "component"])
    assert len(table) == len(rows) * 32 and (table.deviation.to_numpy()[::32] == deviation).all()
    mine = table.whitened.to_numpy().reshape(-1, 32)
    assert np.allclose(mine * np.sign((mine * w).sum(axis=0)), w, atol=1e-8)
    assert np.allclose(table.explained.to_numpy()[:32], explained, rtol=1e-9) and table.identity_error.max() < 1e-9


def test_arrow_columns_with_nulls():
    column = pa.array([[1.0, 2.0], None, [None, 1.0], [3.0], [0.0, 0.0], [5.0, 6.0]]).slice(0, 6)
    right, values = whitening.matrix(column, 2)
    assert right.tolist() == [True, False, False, False, True, True] and values.tolist() == [[1, 2], [0, 0], [5, 6]]
    found = lattice.vectors(column.slice(1))
    assert [None if v is None else v.tolist() for v in found] == [None, None, [3.0], None, [5.0, 6.0]]
