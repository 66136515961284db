"""Best-fit packing by a configuration linear program.

Texts become token ids (plus an end id) and are cut only where longer than a
sequence. The histogram of piece lengths - at most ``capacity`` numbers, however
large the corpus - is what the driver solves for: a configuration is a multiset
of lengths that fits one sequence, and the covering program "fewest sequences
whose configurations use every piece" is solved by multiplicative weights: each
round prices the lengths, finds the best configuration with a knapsack dynamic
program and covers part of what it holds. Multiplicities are rounded, and what
rounding leaves is packed best fit, largest first, on the histogram.

Pieces then find their places by arithmetic: the k-th piece of a length belongs
to the configuration whose share of that length holds k. The only shuffle deals
narrow rows by (length, salt), so one very frequent length is split.

Cases: a null or empty text is one piece holding the end id; repeated rows are
packed once each; a null ``doc_id`` stays null; an empty table gives no row;
columns other than ``doc_id`` and ``text`` are not carried.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuesmith.llm import bpe
from cuesmith.llm.common import clear_columns, staged, text_chunks

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, ids array<int>"


def cut(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token counts -> per piece: owner, number, start, length. Only a count over
    ``capacity`` is cut; its first piece takes the remainder."""
    n = -(-sizes // capacity)
    owner = np.repeat(np.arange(len(sizes)), n)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    head = np.where(sizes % capacity == 0, capacity, sizes % capacity)[owner]
    start = np.where(number == 0, 0, head + (number - 1) * capacity)
    return owner, number, start, np.where(number == 0, head, capacity)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, keep_ids: bool = True) -> DataFrame:
    """One row for each piece; with ``keep_ids`` off, ``ids`` is null and only the digest stays."""

    def run(batches):
        enc = bpe.encoder(tokenizer)
        for batch in batches:
            doc_id = batch.column(0)
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                ids, at = bpe.with_end(*enc.encode(data, offsets), end_id)
                owner, number, start, length = cut(np.diff(at), capacity)
                begin = at[owner] + start
                view = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * b : 4 * e]) for b, e in zip(begin.tolist(), (begin + length).tolist())]
                if keep_ids:  # pieces follow each other without a gap
                    out = pa.ListArray.from_arrays(pa.array(np.append(begin, at[-1]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                else:
                    out = pa.nulls(len(owner), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [doc_id.slice(lo, hi - lo).take(pa.array(owner)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(crc, pa.int64()), out],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


# ------------------------------------------------------- the linear program


def knapsack(value: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths of largest total value that fits; ``value[l]`` is that of length ``l``."""
    best = np.zeros(capacity + 1)
    pick = np.zeros(capacity + 1, np.int64)
    back, prices = best[::-1], value[1:]
    for w in range(1, capacity + 1):
        got = prices[:w] + back[capacity + 1 - w :]
        k = got.argmax()
        if got[k] > best[w - 1]:
            best[w], pick[w] = got[k], k + 1
        else:
            best[w] = best[w - 1]
    config: dict[int, int] = {}
    w = capacity
    while w > 0:
        if pick[w]:
            config[int(pick[w])] = config.get(int(pick[w]), 0) + 1
            w -= int(pick[w])
        else:
            w -= 1
    return config


def fractional(count: np.ndarray, capacity: int, step: float = 0.5, rate: float = 0.02, favour: float = 0.05) -> dict[tuple, float]:
    """Multiplicative weights: configurations and how many of each, not yet whole numbers.

    A length weighs its share of the capacity to the power ``1 + favour``: with
    ``favour`` 0 that is the dual solution of the area bound, and the little more
    that large lengths weigh has them priced in first, while there are small ones
    left to fill their sequences. What a configuration covers loses weight by
    ``rate``, in proportion; covered lengths leave. Each round covers at least
    ``step`` of one of its lengths or a whole sequence, so rounds stay in the order
    of the number of lengths. Their total meets the area bound within a sequence or
    two where small pieces abound; the tests hold it against that bound.
    """
    full = count.astype(float)
    weight = (np.arange(capacity + 1) / capacity) ** (1 + favour) * (count > 0)
    covered = np.zeros(capacity + 1)
    x: dict[tuple, float] = {}
    while weight.any():
        config = knapsack(weight, capacity)
        lengths, copies = np.array(list(config)), np.array(list(config.values()))
        left = float((full[lengths] * (1 - covered[lengths]) / copies).min())
        amount = min(left, max(step * float((full[lengths] / copies).min()), 1.0))
        key = tuple(sorted(config.items(), reverse=True))
        x[key] = x.get(key, 0.0) + amount
        share = amount * copies / full[lengths]
        covered[lengths] += share
        weight[lengths] *= np.exp(-rate * share)
        weight[covered >= 1 - 1e-9] = 0
    return x


def rounded(x: dict[tuple, float], count: np.ndarray) -> tuple[list[tuple[tuple, int]], np.ndarray]:
    """Whole multiplicities that no length has too few pieces for, and the pieces left:
    whole parts first, then one more for the largest fractions, as many as their sum."""
    left, whole = count.copy(), []

    def take(config: tuple, many: int) -> int:
        many = min(many, *(int(left[n] // k) for n, k in config))
        if many > 0:
            whole.append((config, many))
            for n, k in config:
                left[n] -= many * k
        return many

    for config, amount in sorted(x.items(), key=lambda kv: -kv[1]):
        take(config, int(amount + 1e-6))
    more = sum(amount % 1 for amount in x.values() if amount % 1 < 1 - 1e-6)
    for config, amount in sorted(x.items(), key=lambda kv: (-(kv[1] % 1), kv[0])):
        if more >= 0.5 and 1e-6 < amount % 1 < 1 - 1e-6:
            more -= take(config, 1)
    return whole, left


def best_fit(left: np.ndarray, capacity: int) -> dict[tuple, int]:
    """Best fit, largest first, for whole groups of equal pieces and equal sequences."""
    open_: dict[int, dict[tuple, int]] = {}
    for length in range(capacity, 0, -1):
        n = int(left[length])
        for free in sorted(f for f in open_ if f >= length):
            if not n:
                break
            fits = free // length
            for content, bins in list(open_[free].items()):
                if not n:
                    break
                full, rest = divmod(n, fits)
                used = min(bins, full)
                for bins_used, copies in ((used, fits), (1 if used < bins and used == full and rest else 0, rest)):
                    if bins_used and copies:
                        to = open_.setdefault(free - copies * length, {})
                        new = content + ((length, copies),)
                        to[new] = to.get(new, 0) + bins_used
                        open_[free][content] -= bins_used
                        n -= bins_used * copies
                if not open_[free].get(content, 1):
                    del open_[free][content]
            if not open_[free]:
                del open_[free]
        if n:
            fits = capacity // length
            full, rest = divmod(n, fits)
            for bins_used, copies in ((full, fits), (1 if rest else 0, rest)):
                if bins_used:
                    to = open_.setdefault(capacity - copies * length, {})
                    new = ((length, copies),)
                    to[new] = to.get(new, 0) + bins_used
    out: dict[tuple, int] = {}
    for group in open_.values():
        for content, bins in group.items():
            out[content] = out.get(content, 0) + bins
    return out


def plan(count: np.ndarray, capacity: int, **knobs) -> dict[str, np.ndarray]:
    """Histogram -> one entry for each (configuration, length): ``length``,
    ``base`` (first rank of that length it takes), ``copies``, ``many``
    (sequences of the configuration), ``offset`` and ``sequence`` (their first).
    """
    count = count.astype(np.int64).copy()
    whole, left = rounded(fractional(count, capacity, **knobs), count)
    whole += best_fit(left, capacity).items()
    rows, next_rank, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for config, many in whole:
        offset = 0
        for n, k in config:
            rows.append((n, next_rank[n], k, many, offset, sequence))
            next_rank[n] += k * many
            offset += n * k
        sequence += many
    if not (next_rank == count).all():
        raise AssertionError("the packing plan does not use every piece once")
    columns = np.array(sorted(rows), np.int64).reshape(-1, 6).T
    return dict(zip(("length", "base", "copies", "many", "offset", "sequence"), columns)) | {"sequences": np.int64(sequence)}


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, end_id: int = 2, keep_ids: bool = True) -> DataFrame:
    """Pieces of all texts with ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    cut_up = staged(pieces(clear_columns(docs, "doc_id", "text"), tokenizer or bpe.default_path(), capacity, end_id, keep_ids), "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in cut_up.groupBy("length").count().collect():  # at most ``capacity`` rows
        histogram[length] = n
    steps = plan(histogram, capacity)
    salts = int(max(64, -(-histogram.sum() // 250_000)))
    salted = cut_up.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("k", F.row_number().over(inside) - 1).join(groups, ["length", "salt"]).withColumn("k", F.col("k") + F.col("before"))
    big = np.int64(1) << np.int64(48)
    keys = steps["length"] * big + steps["base"]

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            k = batch.column("k").to_numpy()
            row = np.searchsorted(keys, length * big + k, "right") - 1
            inner = k - steps["base"][row]
            sequence = steps["sequence"][row] + inner // steps["copies"][row]
            offset = steps["offset"][row] + inner % steps["copies"][row] * length
            keep = [batch.column(n) for n in ("doc_id", "piece", "start")] + [pa.array(length), batch.column("ids_crc32"), pa.array(sequence), pa.array(offset), batch.column("ids")]
            yield pa.RecordBatch.from_arrays(keep, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"])

    out = ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids array<int>")
    return out if keep_ids else out.drop("ids")
