"""The queries on the smallest tables, against SQL or brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from rillmark.llm.oracles import ORACLES
from rillmark.llm.queries import QUERIES


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(name, spark, sf_dir, same_as_sql):
    same_as_sql(QUERIES[name], ORACLES[name], sf_dir)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()


def components(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_op2(spark, sf_dir, docs):
    want = sorted((d.doc_id, len(d.text.encode()) + 1, zlib.crc32(d.text.encode())) for d in docs)
    total, upto, slots, expected = sum(x[1] for x in want), 0, defaultdict(int), []
    for doc_id, size, crc in want:
        shard = (2 * upto + size) * 8 // (2 * total)
        expected.append((doc_id, size, crc, "bytes", shard, slots[shard], None))
        slots[shard] += 1
        upto += size
    assert sorted(tuple(r) for r in QUERIES["op2_byte_shards"](spark, sf_dir).collect()) == expected


def test_op6(spark, sf_dir, docs):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    windows = defaultdict(set)
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(r.text)
        for k in range(max(len(w) - 13, 0) + 1 if w else 0):
            windows[tuple(w[k : k + 13])].add(str(r.item_id))
    want = {}
    for d in docs:
        w, hit, items = words(d.text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    items |= windows[tuple(w[k : k + n])]
        want[d.doc_id] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op6_decontaminate"](spark, sf_dir).collect()} == want


def test_op10(spark, sf_dir, docs):
    sets = {}
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(d.text))
        sets[d.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    part = components(links, ids)
    want = {i: (len(sets[i]), part[i], part[i] == i) for i in ids}
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op10_near_dedup"](spark, sf_dir).collect()} == want


def test_op7(spark, sf_dir):
    import numpy as np

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels, ids = np.array([r.label for r in rows]), [r.vec_id for r in rows]
    near = (x @ x.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    part = components([(ids[i], ids[j]) for i, j in zip(*np.nonzero(near))], ids)
    want = {i: (int(n), part[i], part[i] == i) for i, n in zip(ids, near.sum(axis=1))}
    assert {r.vec_id: tuple(r)[1:] for r in QUERIES["op7_near_vectors"](spark, sf_dir).collect()} == want


def test_op8(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op8_quality"](spark, sf_dir).collect()]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    own = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    pairs = [(a > b) + (a == b) / 2 for a, x in own for b, y in own if x == 1 and y == 0]
    assert sum(pairs) / len(pairs) > 0.97


def shingle_links(docs):
    sets = {}
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(d.text))
        sets[d.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    return components([(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])], ids)


def test_pipeline(spark, sf_dir):
    """Each stage's rows against brute force, or against the operator's own decisions where a model makes them."""
    from collections import Counter

    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        ids = Counter(r.doc_id for r in rows)
        if name == "quality":
            scored = {r.doc_id: r.predicted for r in QUERIES["op8_quality"](spark, sf_dir).collect()}
            want = Counter(r.doc_id for r in before if scored[r.doc_id])
            good = [r.doc_id for r in before if r.doc_id in labels and labels[r.doc_id].quality == 1]
            assert sum(k in ids for k in good) >= 0.95 * len(good)
        elif name == "near_dedup":
            want = Counter(k for k, c in shingle_links(before).items() if k == c)
        elif name == "decontamination":
            hit = {r.doc_id for r in QUERIES["op6_decontaminate"](spark, sf_dir).collect() if r.contaminated}
            want = Counter(r.doc_id for r in before if r.doc_id not in hit)
            assert hit & {r.doc_id for r in before}
        elif name == "mixing":
            words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
            sizes, of = Counter(), {r.doc_id: r for r in before}
            for r in before:
                sizes[r.source] += words(r)
            order = sorted(sizes, key=lambda x: (x is None, x or ""))
            weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(order)}
            left, target, open_to = 1.5 * sum(sizes.values()), {}, set(order)
            while True:
                level = left / sum(weight[x] for x in open_to)
                over = {x for x in open_to if weight[x] * level > 2 * sizes[x]}
                if not over:
                    break
                target |= {x: 2 * sizes[x] for x in over}
                left, open_to = left - sum(2 * sizes[x] for x in over), open_to - over
            target |= {x: weight[x] * level for x in open_to}
            taken, most = Counter(), Counter()
            for k, n in ids.items():
                taken[of[k].source] += n * words(of[k])
            for r in before:
                most[r.source] = max(most[r.source], words(r))
            assert max(ids.values()) <= 2 and all(abs(taken[x] - target[x]) <= most[x] for x in order)
            want = ids
        else:
            want, total, upto, place = Counter(r.doc_id for r in before), sum(len((r.text or "").encode()) + 1 for r in before), 0, Counter()
            for r in sorted(rows, key=lambda r: (r.shard, r.slot)):
                assert r.shard == (2 * upto + r["size"]) * 8 // (2 * total) and r.slot == place[r.shard]
                upto += r["size"]
                place[r.shard] += 1
        assert ids == want, name
        if name != "sharding":
            assert out.columns == columns
            by = {r.doc_id: r for r in before}
            assert all(r == by[r.doc_id] for r in rows)
            docs = corpus_pipeline.written(out, "test")
