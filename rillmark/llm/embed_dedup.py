"""Near-duplicate vectors by sorted projection passes and an exact comparison of what they leave apart.

Equal vectors of a label are linked to their first one, which alone goes on. A pass draws 64 random hyperplanes; the signs of a vector are its 64-bit key. The rows of all passes are dealt by ranges of
(pass, label, key) and sorted, and each vector is compared with its WINDOW next neighbours: two vectors at cosine 0.98 agree
on a sign with probability 0.936, so they share the leading bits, and stand close, in some of PASSES orders. Of the verified
pairs of a partition only a spanning forest is kept (at most an edge a row), the passes' forests are united, and components
follow by large-star and small-star. Equal keys are ordered by a hash that differs from pass to pass, so a partition's border
cuts other neighbours in each.

The passes miss pairs, the more the larger and denser a label is; what they found only spares the next step edges. Of each
label one vector of CELL is a pivot, and a vector lives in the cell of its nearest pivot. If u lives at p and v at q, then
v (p - q) <= 0, so u (p - q) <= |u - v| |p - q|: u visits those cells q where this allows a cosine that links. (Of two cells
one visits the other.) A cell's task holds who lives there, streams the visitors past, and keeps a spanning forest of the
pairs whose components differ. No pair is left out; a label without structure costs as many products as it has pairs.

The links inside a component are then counted exactly: its distinct vectors are dealt into blocks of about TILE, and each pair
of blocks is one matrix product that returns, for each of them, how many rows the linked ones stand for, never the pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link
with nothing; vectors of other length than their partner do not link; rows with the same vec_id are one node, each with its
own count, in which rows of the same vec_id with an equal vector don't count and those with another linked vector do; a null
vec_id links with nothing; double components stay double, others are read as float; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm._shared import components, cut, shuffle_partitions, written

PASSES, BITS, WINDOW, TILE, CELL, SEED = 24, 64, 16, 1024, 8192, 71


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = values.reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts whose vectors have one length."""
    lengths = np.diff(batch.column("embedding").offsets.to_numpy())
    for n in np.unique(lengths):
        yield batch.filter(pa.array(lengths == n))


def _projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    planes: dict[int, np.ndarray] = {}
    for batch in (part for whole in batches if whole.num_rows for at in range(0, whole.num_rows, 1024) for part in _by_length(pa.RecordBatch.from_arrays(whole.slice(at, 1024).columns, names=whole.schema.names))):
        rows = _matrix(batch.column("embedding"))
        n = rows.shape[1]
        if n not in planes:
            planes[n] = np.random.Generator(np.random.PCG64([SEED, n])).standard_normal((n, PASSES * BITS))
        signs = (rows @ planes[n] > 0).reshape(len(rows), PASSES, BITS)
        keys = np.packbits(signs, axis=2).view(">u8")[:, :, 0].astype(np.uint64) ^ np.uint64(1 << 63)  # sorts as a signed long
        for k in range(PASSES):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), k), pa.int32()), batch.column("label"), pa.array(keys[:, k].view(np.int64)), batch.column("vec_id"), batch.column("embedding")],
                names=["pass", "label", "key", "vec_id", "embedding"],
            )


def _root(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _windows(cosine: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                part = whole.slice(at, 2048)
                fresh = 0 if held is None else held.num_rows
                rows = part if held is None else pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
                lengths = np.diff(rows.column("embedding").offsets.to_numpy())
                width = int(lengths.max())
                flat = np.zeros((rows.num_rows, width))
                flat[np.arange(width)[None, :] < lengths[:, None]] = rows.column("embedding").flatten().to_numpy(zero_copy_only=False)
                flat /= np.linalg.norm(flat, axis=1, keepdims=True)
                ids, labels, passes = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "pass"))
                parent: dict[int, int] = {}
                edges = []
                for step in range(1, min(WINDOW, rows.num_rows - 1) + 1):
                    same = (labels[step:] == labels[:-step]) & (passes[step:] == passes[:-step]) & (lengths[step:] == lengths[:-step]) & (ids[step:] != ids[:-step])
                    same[: max(fresh - step, 0)] = False  # both rows were in the batch before
                    for i in np.flatnonzero(same & (np.einsum("ij,ij->i", flat[step:], flat[:-step]) >= cosine)).tolist():
                        a, b = _root(parent, int(ids[i])), _root(parent, int(ids[i + step]))
                        if a != b:
                            parent[max(a, b)] = min(a, b)
                            edges.append((int(ids[i]), int(ids[i + step])))
                if edges:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges, strict=True)], names=["a", "b"])
                held = rows.slice(max(rows.num_rows - WINDOW, 0))

    return compare


def _placed(cosine: float, pivots: dict[tuple, np.ndarray]):
    """Each vector in the cell where it lives (visits = 0) and in those that it visits; a label without pivots is one cell."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for at in range(0, whole.num_rows, 1024) for part in _by_length(whole.slice(at, 1024))):
            rows, labels = _matrix(batch.column("embedding")), np.array(batch.column("label").to_pylist(), dtype=object)
            for label in set(labels.tolist()):
                at = np.flatnonzero(labels == label)
                centres = pivots.get((label, rows.shape[1]), np.zeros((1, rows.shape[1])))
                near = rows[at] @ centres.T
                own = near.argmax(axis=1)
                other = np.arange(len(centres))[None, :]
                apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))[own]
                meets = near[np.arange(len(at)), own][:, None] - near <= apart * np.sqrt(2 - 2 * cosine) + 1e-6
                meets &= np.where((own[:, None] + other) % 2 == 0, own[:, None] > other, own[:, None] < other)
                who, cell = np.nonzero(meets)
                who, cell, visits = np.concatenate([np.arange(len(at)), who]), np.concatenate([own, cell]), np.repeat([0, 1], [len(at), len(who)])
                for k in range(0, len(who), 4096):
                    some = batch.take(pa.array(at[who[k : k + 4096]]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), rows.shape[1]), pa.int32()), pa.array(cell[k : k + 4096], pa.int32()), pa.array(visits[k : k + 4096], pa.int32()), *some.columns], names=["n", "cell", "visits", *some.schema.names])

    return place


def _cells(cosine: float):
    """Edges between components, from batches in the order of label, n, cell, visits."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, homes, parent = None, [], {}

        def roots(names: np.ndarray) -> np.ndarray:
            known, at = np.unique(names, return_inverse=True)
            return np.array([_root(parent, x) for x in known.tolist()], dtype=np.int64)[at]

        for whole in batches:
            keys = list(zip(*(whole.column(c).to_pylist() for c in ("label", "n", "cell", "visits")), strict=True))
            at = 0
            while at < len(keys):
                stop = next((k for k in range(at + 1, min(at + 1024, len(keys))) if keys[k] != keys[at]), min(at + 1024, len(keys)))
                part, key = whole.slice(at, stop - at), keys[at]
                at = stop
                if key[:3] != cell:
                    cell, homes, parent = key[:3], [], {}
                mine = [_matrix(part.column("embedding")), part.column("vec_id").to_numpy(), part.column("component").to_numpy()]
                if not key[3]:
                    homes.append(mine)
                edges = []
                for home in homes:
                    near = mine[0] @ home[0].T >= cosine
                    if not (near & (mine[2][:, None] != home[2][None, :])).any():
                        continue
                    mine[2], home[2] = roots(mine[2]), roots(home[2])
                    i, j = np.nonzero(near & (mine[2][:, None] != home[2][None, :]))
                    _, first = np.unique(np.stack([mine[2][i], home[2][j]]), axis=1, return_index=True)
                    for x, y in zip(i[first].tolist(), j[first].tolist(), strict=True):
                        a, b = _root(parent, int(mine[2][x])), _root(parent, int(home[2][y]))
                        if a != b:
                            parent[max(a, b)] = min(a, b)
                            edges.append((int(mine[1][x]), int(home[1][y])))
                if edges:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges, strict=True)], names=["a", "b"])

    return compare


#: Names a tile; the mark of the label is in it, as a component that repeated vec_ids join may reach into several labels.
TILE_KEY = ["mark", "component", "low", "high"]


def _tile(cosine: float):
    """For rows sorted by tile: for each class of equal vectors how many rows of linked classes its tile holds."""

    def matrix(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _matrix(rows.column("embedding")), rows.column("_class").to_numpy(), rows.column("copies").to_numpy()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None

        def counted(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            keys = np.stack([rows.column(c).to_numpy() for c in TILE_KEY])
            starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])).tolist()
            who, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at, stop in zip(starts, [*starts[1:], rows.num_rows], strict=True):
                for tile in _by_length(rows.slice(at, stop - at)):
                    block, low, high = (tile.column(c).to_numpy() for c in ("block", "low", "high"))
                    x, own_x, copies_x = matrix(tile.filter(pa.array(block == low)))
                    if low[0] == high[0]:
                        who.append(own_x), found.append((x @ x.T >= cosine) @ copies_x)
                    elif 0 < len(x) < tile.num_rows:
                        y, own_y, copies_y = matrix(tile.filter(pa.array(block == high)))
                        near = x @ y.T >= cosine
                        who += [own_x, own_y]
                        found += [near @ copies_y, copies_x @ near]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), pa.int64()) for v in (who, found)], names=["_class", "found"])

        for batch in batches:
            if batch.num_rows:
                rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                last = np.stack([rows.column(c).to_numpy() for c in TILE_KEY])
                cut_at = int(np.argmax((last == last[:, -1:]).all(axis=0)))  # the last tile may go on in the next batch
                if cut_at:
                    yield from counted(rows.slice(0, cut_at))
                held = rows.slice(cut_at)
        if held is not None:
            yield from counted(held)

    return count


def near_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding, label)."""
    array = "array<double>" if vectors.schema["embedding"].dataType.simpleString() == "array<double>" else "array<float>"
    rows = written(vectors.select("vec_id", F.col("embedding").cast(array), "label").withColumn("_row", F.monotonically_increasing_id()), "vectors")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.where("vec_id is not null and label is not null and embedding is not null and size(embedding) > 0").where(finite & F.exists("embedding", lambda x: x != 0))
    kind, parts = rows.schema["label"].dataType.simpleString(), 2 * shuffle_partitions(rows.sparkSession)
    classes = written(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.min("_row").alias("_class"), F.count("*").alias("copies")), "distinct-vectors")
    first = written(classes.where("copies > 1").select("label", "embedding", F.col("vec_id").alias("a"), F.col("_class").alias("_of")), "repeated-vectors")
    of_row = good.join(first, ["label", "embedding"], "left").select("vec_id", "_row", "a", F.coalesce("_of", "_row").alias("_class"))
    of_row = written(of_row, "classes-of-vectors")
    copies = of_row.where("a <> vec_id").select("a", F.col("vec_id").alias("b"))
    alone = classes.select("label", "embedding", "vec_id")
    passes = alone.select("label", "vec_id", "embedding").mapInArrow(_projected, f"pass int, label {kind}, key long, vec_id long, embedding {array}")
    order = ["pass", "label", "key", "_tie"]
    dealt = passes.withColumn("_tie", F.xxhash64("pass", "vec_id")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    links = cut(dealt.select("pass", "label", "vec_id", "embedding").mapInArrow(_windows(cosine), "a long, b long").unionByName(copies).distinct())
    named = cut(components(links))
    pivots: dict[tuple, list] = {}
    for r in alone.where(F.pmod(F.xxhash64("label", "embedding"), F.lit(CELL)) == 0).select("label", "embedding").collect():
        pivots.setdefault((r.label, len(r.embedding)), []).append(np.array(r.embedding) / np.linalg.norm(r.embedding))
    known = alone.join(named.withColumnRenamed("node", "vec_id"), "vec_id", "left").select("label", "vec_id", F.coalesce("component", "vec_id").alias("component"), "embedding")
    placed = known.mapInArrow(_placed(cosine, {k: np.stack(v) for k, v in pivots.items()}), f"n int, cell int, visits int, label {kind}, vec_id long, component long, embedding {array}")
    cell = ["label", "n", "cell"]
    more = cut(placed.repartition(parts, *cell).sortWithinPartitions(*cell, "visits").mapInArrow(_cells(cosine), "a long, b long").distinct())
    if not more.isEmpty():
        named = cut(components(more.unionByName(named.select(F.col("node").alias("a"), F.col("component").alias("b")))))
    # The links inside a component, counted over its distinct vectors of a label.
    members = written(classes.join(named.withColumnRenamed("node", "vec_id"), "vec_id"), "members")
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks")).where("blocks > 1")
    members = members.join(written(sizes, "large-components"), "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = members.withColumn("block", F.pmod(F.xxhash64("_class"), F.col("blocks")).cast("int"))
    tiles = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "_class", "copies", "embedding", F.xxhash64("label").alias("mark"))
    tiles = tiles.repartition(parts, *TILE_KEY).sortWithinPartitions(*TILE_KEY)
    counts = tiles.mapInArrow(_tile(cosine), "_class long, found long").groupBy("_class").agg(F.sum("found").alias("found"))
    own = of_row.where("a is not null").groupBy("_class", "vec_id").agg(F.count("*").alias("same"))  # rows with this vector and this vec_id
    counted = of_row.join(counts, "_class").join(own, ["_class", "vec_id"], "left").select("_row", (F.col("found") - F.coalesce("same", F.lit(1))).alias("n_links"))
    out = rows.select("vec_id", "_row").join(counted, "_row", "left").join(named.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
