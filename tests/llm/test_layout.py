"""Shards, packing and the pipeline."""

import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from pricetide.llm import jaccard, packing, shards


def test_heap_gives_what_one_by_one_gives():
    r = np.random.default_rng(1)
    sizes = sorted({int(x): int(n) for x, n in zip(r.integers(1, 500, 60), r.integers(1, 40, 60))}.items(), reverse=True)
    loads = [(0, s) for s in range(5)]
    for (size, count), (size2, given) in zip(sizes, shards.schedule(sizes, 5)):
        for _ in range(count):
            load, s = heapq.heappop(loads)
            heapq.heappush(loads, (load + size, s))
        assert size == size2 and sum(given) == count
    mine = defaultdict(int)
    for size, given in shards.schedule(sizes, 5):
        for s, n in enumerate(given):
            mine[s] += n * size
    assert sorted(mine.values()) == sorted(x for x, _ in loads)


def test_shards(docs_of):
    r = np.random.default_rng(2)
    rows = [(i, "x" * int(r.integers(0, 400)) + str(i % 70)) for i in range(300)] + [(None, None), (400, ""), (401, None), (402, "é" * 500), (402, "é" * 500), (403, "hot")] + [(500 + i, "hot") for i in range(200)]
    got = shards.shard(docs_of(rows).repartition(4)).collect()
    assert len(got) == len(rows)
    of = defaultdict(set)
    for x in got:
        of[(x.size, x.text_crc32)].add(x.shard)
    assert all(len(s) == 1 for s in of.values())
    want = Counter((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((str(x.doc_id), x.size, x.text_crc32) for x in got) == want
    for s in range(8):
        assert sorted(x.slot for x in got if x.shard == s) == list(range(sum(x.shard == s for x in got)))
    loads = [sum(x.size for x in got if x.shard == s) for s in range(8)]
    assert max(loads) - min(loads) <= max(x.size for x in got)
    assert shards.shard(docs_of(rows).where("false")).count() == 0


def test_packing_round_trip(docs_of):
    rows = [(i, f"Some text, number {i}! " * (i % 9)) for i in range(120)] + [(None, "no id"), (200, None), (201, ""), (202, "long word " * 9000), (203, "a<|endoftext|>b"), (203, "a<|endoftext|>b"), (204, "Ünï, ΑΣ.. don't é´ x's")]
    got = packing.pack(docs_of(rows).repartition(3), length=256).collect()
    encoder = packing.Encoder(packing.TOKENIZER)
    want = Counter((str(i), tuple(encoder.ids(t or "") + [2])) for i, t in rows)
    by_start = defaultdict(list)
    for p in got:
        by_start[(p.doc_id, p.sequence_id * 256 + p.offset - p.start)].append(p)
    found = Counter()
    for (doc_id, _), pieces in by_start.items():
        pieces.sort(key=lambda p: p.start)
        ids = np.frombuffer(b"".join(p.ids for p in pieces), "<u4")
        assert [p.start for p in pieces] == np.cumsum([0, *[p.length for p in pieces]]).tolist()[:-1] and len(ids) == pieces[0].doc_tokens
        found[(str(doc_id), tuple(ids.tolist()))] += 1
    assert found == want
    full = {}
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == full.get(p.sequence_id, 0) and p.length > 0
        full[p.sequence_id] = p.offset + p.length
    assert sorted(full) == list(range(len(full))) and [full[s] for s in sorted(full)][:-1] == [256] * (len(full) - 1)
    assert packing.pack(docs_of(rows).where("false")).count() == 0


def test_units_encode_like_whole_texts(docs_of):
    texts = ["Hello, WORLD!!", "ΑΣ, ab's, x'll. O'.. é. ÷. 3. a.b. ...", "a b ć ́d", "don't  \r\n y  z", "İI σ İ. ſ ŉ ﬁ.", "\x1c a\x0bb\x0cc", "¿qué? «été» …"]
    import pyarrow as pa

    encoder = packing.Encoder(packing.TOKENIZER)
    got = [x.tolist() for part in packing._ids_of(encoder, pa.array(texts)) for x in part]
    assert got == [encoder.ids(t) for t in texts]


def test_digests_and_sequences(docs_of):
    pieces = packing.pack(docs_of([(1, "a b c " * 200), (2, "d")]), length=64)
    assert {"ids_crc32"} <= set(packing.digests(pieces).columns)
    sequences = {r.sequence_id: bytes(r.ids) for r in packing.sequences(pieces).collect()}
    assert all(len(x) == 256 for k, x in sequences.items() if k < max(sequences))


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """What every stage gets and gives on the smallest table."""
    sf, folder = "/root/testdata/sf0.001", tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for k, (_, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs, sf).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def test_pipeline_stages(spark, staged):
    docs, known, lined, single, clean, packed = staged
    for stage in (known, lined, single, clean):
        assert stage.columns == docs.columns
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in staged]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] >= ids[4] == ids[5]
    assert ids[0] - ids[1] == set()
    left = jaccard.near_duplicates(lined).collect()
    assert ids[3] == {r.component_id for r in left}
    assert all(r.n_chars == len(r.text) for r in lined.collect())
    items = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    assert ids[3] - ids[4] == {r.doc_id for r in single.collect() if any(x in r.text for x in items)}


def test_pipeline_run(spark, staged):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    key = lambda df: sorted(map(tuple, packing.digests(df).groupBy("doc_id").sum("length").collect()))
    assert key(got) == key(staged[-1])
