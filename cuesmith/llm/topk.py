"""Exact top-k inner products: tiled matrix products and a tree of merges.

Vectors are floored to integers, so every score is exact. They are packed into
shards of ``SHARD`` rows and written once; queries are picked from the shards
and packed into tiles of ``TILE``. Shards fall into groups and tiles into slots;
both sides are dealt to every (slot, group) that they take part in and meet there
by an equi-join, one matrix product for each pair of blocks. A product keeps k results for each query, and lists are merged by group
and then by sixteens until one is left, so no task sees more than a fixed number
of lists for a query.

Products run as float64 where that is exact (below 2**53), else as 64-bit
integers, else as Python integers, cut to the range of a long.

Cases: vectors that are null or hold null, NaN or infinite components, and rows
without ``vec_id``, take no part; vectors of different dimension are not
compared; repeated rows are candidates and queries each on their own (a query
skips only itself); fewer candidates than k give fewer rows; other columns are
not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesmith.llm.common import clear_columns, staged

SHARD = 4096
TILE = 1024
FAN_IN = 16
BLOCK = "dim int, block long, n int, ids binary, keys binary, matrix binary"


def _pack(dim: int, block: int, ids: np.ndarray, keys: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
    wide = matrix.astype(np.int64)
    narrow = wide.astype(np.int32)
    data = narrow if (narrow == wide).all() else wide
    row = [dim, block, len(ids), ids.astype(np.int64).tobytes(), keys.astype(np.int64).tobytes(), data.tobytes()]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["dim", "block", "n", "ids", "keys", "matrix"])


def _unpack(dim: int, n: int, ids: bytes, keys: bytes, matrix: bytes):
    kind = np.int32 if len(matrix) == 4 * n * dim else np.int64
    return np.frombuffer(ids, np.int64), np.frombuffer(keys, np.int64), np.frombuffer(matrix, kind).reshape(n, dim).astype(np.int64)


class _Packer:
    """Gathers rows by dimension and gives a block whenever ``most`` are there."""

    def __init__(self, most: int):
        self.most, self.held, self.block = most, {}, TaskContext.get().partitionId() << 32

    def add(self, dim, ids, keys, matrix):
        held = self.held.setdefault(dim, [])
        held.append((ids, keys, matrix))
        while sum(len(h[0]) for h in self.held.get(dim, [])) >= self.most:
            yield self._cut(dim)

    def _cut(self, dim):
        ids, keys, matrix = (np.concatenate([h[i] for h in self.held[dim]]) for i in range(3))
        out = _pack(dim, self.block, ids[: self.most], keys[: self.most], matrix[: self.most])
        self.block += 1
        self.held[dim] = [(ids[self.most :], keys[self.most :], matrix[self.most :])]
        if not len(ids[self.most :]):
            del self.held[dim]
        return out

    def rest(self):
        for dim in list(self.held):
            while dim in self.held:
                yield self._cut(dim)


def integers(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = clear_columns(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    vectors = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable)
    return vectors.select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale)).alias("v"))


def _shards(batches):
    pack, row = _Packer(SHARD), TaskContext.get().partitionId() << 40
    for batch in batches:
        ids, lists = batch.column(0).to_numpy(), batch.column(1)
        size = np.diff(lists.offsets.to_numpy())
        flat = lists.values.to_numpy()[lists.offsets[0].as_py() :]
        at = np.concatenate([[0], np.cumsum(size)])
        keys = row + np.arange(len(ids))
        row += len(ids)
        for dim in np.unique(size).tolist():
            pick = np.flatnonzero(size == dim)
            matrix = flat[(at[pick][:, None] + np.arange(dim)).ravel()].reshape(len(pick), dim)
            yield from pack.add(dim, ids[pick], keys[pick], matrix)
    yield from pack.rest()


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    most = max(1, q.shape[1]) * int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0))
    if most < 1 << 53:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    if most < 1 << 63:
        return q @ c.T
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def select(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """Each row's k best: (row, place) index arrays, score descending, then id. ``own`` marks what a row skips."""
    n, m = scores.shape
    order = np.argsort(ids, kind="stable")
    scores, own = scores[:, order], own[:, order]
    rows, places = [], []
    if m > 4 * k:
        bar = -np.partition(-np.where(own, np.iinfo(np.int64).min + 1, scores), k - 1, axis=1)[:, k - 1 : k]
        keep = (scores >= bar) & ~own
    else:
        keep = ~own
    for i in range(n):
        at = np.flatnonzero(keep[i])
        at = at[np.argsort(~scores[i, at], kind="stable")[:k]]
        rows.append(np.full(len(at), i))
        places.append(order[at])
    return np.concatenate(rows), np.concatenate(places)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score for each row whose ``vec_id`` is divisible by ``every``."""

    def pick(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, keys, matrix = _unpack(r["dim"], r["n"], r["ids"], r["keys"], r["matrix"])
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    rows = [pa.array(np.full(len(at), r["dim"], np.int32)), pa.array(ids[at]), pa.array(keys[at]), pa.array([x.tobytes() for x in matrix[at]], pa.binary())]
                    yield pa.RecordBatch.from_arrays(rows, ["dim", "vec_id", "key", "v"])

    def pack_queries(batches):
        pack = _Packer(TILE)
        for batch in batches:
            dims, ids, keys = (batch.column(n).to_numpy() for n in ("dim", "vec_id", "key"))
            rows = batch.column("v").to_pylist()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                yield from pack.add(dim, ids[at], keys[at], np.frombuffer(b"".join(rows[i] for i in at), np.int64).reshape(len(at), dim))
        yield from pack.rest()

    def multiply(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                q_ids, q_keys, q = _unpack(r["dim"], r["q_n"], r["q_ids"], r["q_keys"], r["q_matrix"])
                ids, keys, c = _unpack(r["dim"], r["n"], r["ids"], r["keys"], r["matrix"])
                row, place = select(scores := _product(q, c), ids, q_keys[:, None] == keys[None, :], k)
                if len(row):
                    best = pa.StructArray.from_arrays([pa.array(~scores[row, place]), pa.array(ids[place])], ["down", "vec_id"])
                    cuts = np.searchsorted(row, np.arange(len(q_ids) + 1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q_ids), pa.array(q_keys), pa.array(np.full(len(q_ids), r["grp"])), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), best)],
                        ["query_id", "query_key", "grp", "best"],
                    )

    shards = staged(integers(vectors, scale).mapInArrow(_shards, BLOCK), "vector-shards")
    queries = staged(shards.mapInArrow(pick, "dim int, vec_id long, key long, v binary"), "query-rows")
    slots = max(1, -(-queries.count() // TILE))
    groups = max(1, -(-shards.count() // FAN_IN))
    tiles = queries.repartition(slots, F.xxhash64("key")).mapInArrow(pack_queries, BLOCK)
    tiles = tiles.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots)))
    tiles = tiles.select("dim", "slot", *[F.col(n).alias(f"q_{n}") for n in ("n", "ids", "keys", "matrix")])
    tiles = tiles.withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    shards = shards.withColumn("grp", F.pmod(F.xxhash64("block"), F.lit(groups)))
    shards = shards.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    met = shards.join(tiles, ["dim", "slot", "grp"])
    lists = met.mapInArrow(multiply, "query_id long, query_key long, grp long, best array<struct<down:long,vec_id:long>>")
    while True:
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
        lists = lists.groupBy("query_id", "query_key", "grp").agg(merged.alias("best"))
        if groups == 1:
            break
        groups = -(-groups // FAN_IN)
        lists = lists.withColumn("grp", F.floor(F.col("grp") / FAN_IN))
    out = lists.select("query_id", F.posexplode("best").alias("rank", "b"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), "b.vec_id", F.bitwise_not("b.down").alias("score"))
