"""Near-duplicate documents: MinHash, banding, signature check, full-set check, components by large-star and small-star.

A text's set is its distinct 5-word shingles (of fewer words, but not none, the whole sequence), as 64-bit hashes. Equal sets
first become one class, for which the row with the smallest doc_id stands. Each class gets 128 minima under random functions
a*x+b modulo 2^64, in 32 bands of 4; two sets of similarity 0.75 share no band with probability 5e-6.

Candidates. Classes that share a band are not all paired with each other. The buckets are dealt by ranges and sorted, each in
an order of its own, and every member is paired with the three before it. These pairs are estimated on the signatures (cut
at 0.58, over four standard deviations below 0.75); what hangs together by them is a family. Bucket mates of different
families are then estimated too, in tiles, and families between which a pair passes become one. So all pairs that share a
band and pass the estimate lie inside a family.

Links. The members of a family are dealt into blocks of at most BLOCK texts (or BLOCK_SHINGLES shingles, or one text), and a
block's task counts the common shingles of all its pairs exactly and returns what hangs together as a star, never the pairs.
Nearly all families are one block. The larger ones are dealt once more in another way, which joins the main parts of their
blocks; the members that then still lie outside a family's largest part are held against all others, in tiles of a block by
a block. So every pair of a family is counted or already joined, and texts are sent once, in large families twice, and again
only for strays.

Defined cases: null texts and texts without words have no shingles and are linked with nothing; rows with the same doc_id
are one node, each row is returned, and each of its texts links; a null doc_id is linked with nothing and kept; an empty
table gives an empty result; very long texts are read whole, in pieces; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm._shared import Scratch, apart, components, stars, written
from rillmark.llm._tokens import SPACES, Words, buffers, pieces, shingles

ROWS, BANDS = 4, 32
NEAR, BUCKET_TILE = 3, 1024
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
#: Shingles of up to so many texts on a side are counted by listing pairs, more frequent ones by a matrix product.
RARE = 8
ESTIMATE = 0.58
SEED = 20240229


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(SEED))
    a = rng.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)


def _sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    raw, offsets = buffers(texts)
    values, first = shingles(Words(raw, offsets, SPACES), n)
    for i in range(len(offsets) - 1):
        yield np.unique(values[first[i] : first[i + 1]])


def _minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minima of all functions over the set, some thousand shingles at a time."""
    least = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(values), 2048):
        part = values[None, k : k + 2048] * a[:, None]
        part += b[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def sketches(docs: DataFrame, n: int = 5) -> DataFrame:
    """For each row of docs: row (its number), doc_id, text_hash, n_shingles, set_key (equal for equal sets), signature (the 16 lowest bits of each of the 128 minima) and bands (32 longs); the last three are null for empty sets."""
    passed = ["row", "doc_id", "text_hash"]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _functions()
        for batch in (x for whole in batches for x in pieces(whole, ["text"])):
            counts, keys, signatures, bands = [], [], [], []
            for values in _sets(batch.column("text"), n):
                counts.append(len(values))
                if not len(values):
                    keys.append(None), signatures.append(None), bands.append(None)
                    continue
                least = _minima(values, a, b)
                keys.append(np.array([len(values), values.sum(), np.bitwise_xor.reduce(values * np.uint64(0x9E3779B97F4A7C15)), least[0]], dtype=np.uint64).tobytes())
                signatures.append(least.astype(np.uint16).tobytes())
                rows = least.reshape(BANDS, ROWS)
                key = np.arange(BANDS, dtype=np.uint64)
                for r in range(ROWS):
                    key = (key ^ rows[:, r]) * np.uint64(0xD6E8FEB86659FD93)
                    key ^= key >> np.uint64(32)
                bands.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in passed], pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=[*passed, "n_shingles", "set_key", "signature", "bands"],
            )

    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(sketch, "row long, doc_id long, text_hash long, n_shingles long, set_key binary, signature binary, bands array<long>")


def _estimated(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree in ESTIMATE of their places or more."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1) for c in ("left", "right"))
                yield batch.select(["a", "b"]).filter(pa.array((left == right).mean(axis=1) >= ESTIMATE))

    joined = pairs.join(signatures.select(F.col("node").alias("a"), F.col("signature").alias("left")), "a")
    joined = joined.join(signatures.select(F.col("node").alias("b"), F.col("signature").alias("right")), "b")
    return joined.select("a", "b", "left", "right").mapInArrow(agree, "a long, b long")


def _bucket_mates(percent: int):
    """For rows sorted by bucket: those that may share theirs with another row, each with the nodes of up to NEAR rows before it that are not too different in size."""

    def mates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            fresh = 0 if held is None else held.num_rows
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            band, key, node, size = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("band", "key", "node", "size"))
            found, with_mate = np.zeros((len(node), NEAR), dtype=bool), np.zeros(len(node), dtype=bool)
            for step in range(1, min(NEAR, len(node) - 1) + 1):
                same = (band[step:] == band[:-step]) & (key[step:] == key[:-step])
                low, high = np.minimum(size[step:], size[:-step]), np.maximum(size[step:], size[:-step])
                found[step:, step - 1] = same & (100 * low >= percent * high) & (node[step:] != node[:-step])
                with_mate[step:] |= same
                with_mate[:-step] |= same
            # Whether the rows at the ends of a batch have a mate outside it isn't known here.
            with_mate[fresh], with_mate[-1] = True, True
            back = np.arange(len(node))[:, None] - np.arange(1, NEAR + 1)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(found.sum(axis=1))]), pa.int32()), pa.array(node[back[found]]))
            out = pa.RecordBatch.from_arrays([*[rows.column(c) for c in ("band", "key", "node", "size")], lists], names=["band", "key", "node", "size", "mates"])
            yield out.slice(fresh).filter(pa.array(with_mate[fresh:]))
            held = rows.slice(max(rows.num_rows - NEAR, 0))

    return mates


def _runs(values: list[np.ndarray]) -> np.ndarray:
    """Where the runs of equal keys begin, and the end."""
    fresh = np.concatenate([[True], np.any([v[1:] != v[:-1] for v in values], axis=0)])
    return np.append(np.flatnonzero(fresh), len(fresh))


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by the keys, in batches that hold whole groups, with where each group begins, and the end."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if batch.num_rows:
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            runs = _runs([rows.column(c).to_numpy(zero_copy_only=False) for c in keys])
            if len(runs) > 2:  # the last group may go on in the next batch
                yield rows.slice(0, int(runs[-2])), runs[:-1]
            held = rows.slice(int(runs[-2]))
    if held is not None:
        yield held, np.array([0, held.num_rows])


def _with_sets(rows: pa.RecordBatch, runs: np.ndarray, n: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Each group's first and next row and its sets, which are made some texts at a time."""
    made = (x for part in pieces(rows, ["text"]) for x in _sets(part.column("text"), n))
    for low, high in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
        yield low, high, list(islice(made, high - low))


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set on the left has in common with each on the right."""
    a, b = np.concatenate(left), np.concatenate(right)
    of_a, of_b = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    by = np.argsort(b, kind="stable")
    b, of_b = b[by], of_b[by]
    first = np.searchsorted(b, a)
    times = np.searchsorted(b, a, side="right") - first
    rare = np.flatnonzero((times > 0) & (times <= RARE))
    k = times[rare]
    at = np.repeat(first[rare] - (np.cumsum(k) - k), k) + np.arange(k.sum())
    found = np.bincount(np.repeat(of_a[rare], k) * len(right) + of_b[at], minlength=len(left) * len(right)).reshape(len(left), len(right)).astype(np.float64)
    often = times > RARE
    values = np.unique(a[often])
    for at in range(0, len(values), 4096):
        some = values[at : at + 4096]
        mine = np.flatnonzero(often & (a >= some[0]) & (a <= some[-1]))
        other = slice(np.searchsorted(b, some[0]), np.searchsorted(b, some[-1], side="right"))
        place = np.minimum(np.searchsorted(some, b[other]), len(some) - 1)
        same = some[place] == b[other]
        x, y = np.zeros((len(left), len(some)), np.float32), np.zeros((len(right), len(some)), np.float32)
        x[of_a[mine], np.searchsorted(some, a[mine])] = 1
        y[of_b[other][same], place[same]] = 1
        found += x @ y.T
    return found


def _links_between(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets on the left have 100 * intersection >= percent * union with which on the right."""
    if len(left) * len(right) == 1:
        both = np.array([[len(np.intersect1d(left[0], right[0], assume_unique=True))]])
    else:
        both = _common(left, right)
    return 100 * both >= percent * (np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - both)


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(a, b)], names=["a", "b"])


def _in_blocks(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges (a, b) between doc_ids that join what is linked inside each block (family, block) of texts."""
    key = ["family", "block"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, runs in _whole_groups(batches, key):
            nodes, ids = rows.column("node").to_numpy(), rows.column("doc_id").to_numpy()
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for low, high, sets in _with_sets(rows, runs, n):
                own = np.unique(nodes[low:high], return_index=True)[1]  # repeated rows have one node
                sets = [sets[i] for i in own]
                x, y = np.nonzero(_links_between(sets[:1], sets[1:], percent)) if len(sets) == 2 else np.nonzero(_links_between(sets, sets, percent)) if len(sets) > 2 else ((), ())
                if len(x):
                    far = stars(ids[low + own[x]], ids[low + own[y + (len(sets) == 2)]])
                    a.append(far[0]), b.append(far[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], names=["a", "b"])

    dealt = texts.select(*key, "node", "doc_id", "text").repartition(*key).sortWithinPartitions(*key, "node")
    return dealt.mapInArrow(link, "a long, b long")


def _strays(texts: DataFrame, parts: DataFrame, kept: Scratch, n: int, percent: int) -> DataFrame:
    """Edges between the parts of each family: the members outside its largest part against all members, in tiles of a block by a block."""
    rows = texts.join(parts.withColumnRenamed("node", "doc_id").withColumnRenamed("component", "part"), "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
    rows = kept.keep(rows.select("family", "node", "doc_id", "part", "n_shingles", "text"))
    sizes = rows.groupBy("family", "part").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("total"))
    most = sizes.groupBy("family").agg(F.max(F.struct("members", "total", "part")).alias("main"), F.sum("members").alias("members"), F.sum("total").alias("total"), F.count("*").alias("parts")).where("parts > 1")
    most = most.select("family", F.col("main.part").alias("main"), _blocks("members", "total").alias("columns"), _blocks(F.col("members") - F.col("main.members"), F.col("total") - F.col("main.total")).alias("rows"))
    rows = rows.join(F.broadcast(kept.keep(most)), "family")  # a row for each family of over BLOCK texts that isn't joined yet
    hashed = F.xxhash64("node", F.lit(2))
    row, column = F.pmod(hashed, "rows").cast("int"), F.pmod(hashed, "columns").cast("int")
    every = rows.select("family", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), column.alias("column"), F.lit(False).alias("stray"), "doc_id", "part", "text")
    strays = rows.where("part <> main").select("family", row.alias("row"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"), F.lit(True).alias("stray"), "doc_id", "part", "text")
    key = ["family", "row", "column"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tiles, runs in _whole_groups(batches, key):
            stray, ids, part = (tiles.column(c).to_numpy(zero_copy_only=False) for c in ("stray", "doc_id", "part"))
            for low, high, sets in _with_sets(tiles, runs, n):
                few, many = low + np.flatnonzero(stray[low:high]), low + np.flatnonzero(~stray[low:high])
                if len(few) and len(many):
                    linked = _links_between([sets[i - low] for i in few], [sets[i - low] for i in many], percent)
                    a, b = np.nonzero(linked & (part[few][:, None] != part[many][None, :]))
                    yield _edges(ids[few[a]], ids[many[b]])

    return every.unionByName(strays).repartition(*key).sortWithinPartitions(*key).mapInArrow(link, "a long, b long")


def _blocks(members, total):
    """How many blocks so many texts with so many shingles together need."""
    count = lambda x, most: F.ceil((F.col(x) if isinstance(x, str) else x) / most)
    return F.greatest(F.lit(1), count(members, BLOCK), count(total, BLOCK_SHINGLES)).cast("int")


def _alike_in_tiles(percent: int):
    """For rows sorted by tile: pairs in a tile that differ in family, are near enough in size and estimated alike, one for each two families."""
    tile = ["band", "key", "row", "column"]

    def compare(rows: pa.RecordBatch, runs: np.ndarray) -> pa.RecordBatch:
        values = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in ("row", "column", "block", "size", "family")}
        signatures = np.frombuffer(b"".join(rows.column("signature").to_pylist()), dtype=np.uint16).reshape(rows.num_rows, -1)
        ends = np.repeat(runs[1:], np.diff(runs))
        places = np.arange(len(ends))
        found = [np.zeros((0, 2), np.int64)]
        for step in range(1, int(np.diff(runs).max())):
            i = np.flatnonzero(places + step < ends)
            j = i + step
            own = values["row"][i] == values["column"][i]
            keep = (own | (values["block"][i] != values["block"][j])) & (values["family"][i] != values["family"][j])
            keep &= 100 * np.minimum(values["size"][i], values["size"][j]) >= percent * np.maximum(values["size"][i], values["size"][j])
            i, j = i[keep], j[keep]
            near = (signatures[i] == signatures[j]).mean(axis=1) >= ESTIMATE
            found.append(np.unique(np.stack([values["family"][i[near]], values["family"][j[near]]], axis=1), axis=0))
        pairs = np.concatenate(found)
        return _edges(pairs[:, 0], pairs[:, 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, runs in _whole_groups(batches, tile):
            yield compare(rows, runs)

    return run


def _mixed_buckets(marked: DataFrame, signatures: DataFrame, kept: Scratch, percent: int) -> DataFrame:
    """Edges (a, b) between families of which a bucket has members that are estimated alike. Buckets of more than BUCKET_TILE rows are cut into tiles; a tile returns which families it joins, not its pairs."""
    mixed = marked.groupBy("band", "key").agg(F.min("family").alias("low"), F.max("family").alias("high"), F.count("*").alias("members")).where("low <> high")
    mixed = kept.keep(mixed.select("band", "key", F.ceil(F.col("members") / BUCKET_TILE).cast("int").alias("blocks")))
    rows = kept.keep(marked.join(mixed, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")))
    tile = ["band", "key", "row", "column"]
    rows = rows.join(signatures, "node").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("row", F.least("block", "_other")).withColumn("column", F.greatest("block", "_other")).select(*tile, "block", "size", "family", "signature")
    return rows.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(_alike_in_tiles(percent), "a long, b long")


def _families(heads: DataFrame, kept: Scratch, percent: int) -> DataFrame:
    """node and family of every class that has a candidate partner. Nodes and families are numbers of rows."""
    signatures = heads.select("node", "signature")
    banded = heads.select("node", "size", F.posexplode("bands").alias("band", "key"))
    order = ["band", "key", "_tie"]
    # No number of ranges is given, so that adaptive execution writes as few files as their bytes need.
    dealt = banded.withColumn("_tie", F.xxhash64("band", "node")).repartitionByRange(*order).sortWithinPartitions(*order)
    shared = kept.keep(dealt.select("band", "key", "node", "size").mapInArrow(_bucket_mates(percent), "band int, key long, node long, size long, mates array<long>"))
    near = shared.select("node", F.explode("mates").alias("mate"))
    pairs = _estimated(near.select(F.least("node", "mate").alias("a"), F.greatest("node", "mate").alias("b")).distinct(), signatures)
    families = components(pairs)
    own = families.withColumnRenamed("component", "family")
    marked = shared.select("band", "key", "node", "size").join(own, "node", "left").withColumn("family", F.coalesce("family", "node"))
    more = kept.keep(_mixed_buckets(marked, signatures, kept, percent))
    kept.drop(shared)
    if not more.isEmpty():
        families = components(more.unionByName(families.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    return families.withColumnRenamed("component", "family")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept (doc_id = component_id) of each row of docs (doc_id, text)."""
    kept = Scratch(docs.sparkSession, "near-duplicates")
    sketched = kept.keep(sketches(docs, n))
    full = sketched.where("set_key is not null and doc_id is not null")
    repeated = full.groupBy("set_key").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    repeated = kept.keep(repeated.select("set_key", F.col("first.row").alias("node"), F.col("first.doc_id").alias("name")))
    copies = kept.keep(full.select("row", "doc_id", "set_key").join(repeated, "set_key").where("row <> node").select("row", "doc_id", "name"))
    heads = full.join(copies.select("row"), "row", "left_anti")
    heads = kept.keep(heads.select(F.col("row").alias("node"), F.col("n_shingles").alias("size"), "doc_id", "text_hash", "signature", "bands"))
    rows = kept.keep(sketched.select("doc_id", "n_shingles"))
    kept.drop(sketched, repeated)
    families = _families(heads, kept, percent)
    members = kept.keep(heads.select("node", "doc_id", "text_hash", F.col("size").alias("n_shingles")).join(families, "node"))
    kept.drop(heads)
    large = members.groupBy("family").agg(_blocks(F.count("*"), F.sum("n_shingles")).alias("blocks")).where("blocks > 1")
    large = kept.keep(large)
    members = members.join(large, "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).where("text is not null")
    texts = kept.keep(texts.join(members, ["doc_id", "text_hash"]).select("node", "doc_id", "n_shingles", "family", "blocks", "text"))
    block = lambda seed: F.pmod(F.xxhash64("node", F.lit(seed)), "blocks").cast("int")
    links = kept.keep(_in_blocks(texts.withColumn("block", block(0)), n, percent))
    if not large.isEmpty():
        again = texts.where("blocks > 1")
        links = links.unionByName(kept.keep(_in_blocks(again.withColumn("block", block(1)), n, percent)))
        links = links.unionByName(kept.keep(_strays(again, components(links), kept, n, percent)))
    named = components(links.unionByName(copies.select(F.col("doc_id").alias("a"), F.col("name").alias("b"))))
    out = rows.join(named.withColumnRenamed("node", "doc_id").withColumnRenamed("component", "component_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one with the smallest doc_id."""
    inner, back = apart(docs, "doc_id", "text")
    found = written(near_duplicates(inner.select("doc_id", "text"), n, percent), "near-duplicates")
    kept = inner.join(found.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti")
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        # Repeated rows of a kept document: one stays.
        kept = kept.where("doc_id is null").unionByName(kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))
    return back(kept)
