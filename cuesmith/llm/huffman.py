"""Token-id files: canonical length-limited Huffman coding in independent blocks.

Texts are tokenized once and their ids staged. One pass over the ids counts them
(each task sends one count for each id of the vocabulary at most); the driver
turns the counts into code lengths of at most ``limit`` bits with the
package-merge algorithm. Another deals the documents to ranges of ascending
``doc_id`` - as many as the number of ids asks for, ``RANGE_IDS`` each - and
writes blocks. Lengths alone define the canonical code, so the codebook holds
nothing else.

The format is a folder of Parquet tables, written by Spark's committer, so a
lost executor leaves no partial file:

* ``codebook``: one row, ``bits`` (one byte for each id: its code length),
  ``end_id``, ``limit``;
* ``blocks``: ``shard`` (ascending ranges of ``doc_id``), ``block``, ``first``
  (ids of the shard before it), ``doc_ids`` and ``sizes`` (documents of the
  block in order and their ids), ``checkpoints`` (bit offset of every
  ``every``-th id, little-endian 64 bit), ``payload`` (the bits, most
  significant first).

A block holds whole documents and decodes alone; its checkpoints decode side by
side, each step looking up one code of every checkpoint in a table of
``2**limit`` entries.

Cases: a null or empty text is the end id alone; repeated rows are written once
each (many equal ones over several ranges), equal ``doc_id`` in order of their
text's hash; null ``doc_id`` first; an
empty table gives a codebook of one code and no block; other columns are not
carried.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuesmith.llm import bpe
from cuesmith.llm.common import clear_columns, new_path, staged, text_chunks

BLOCK_IDS = 1 << 16
EVERY = 128
RANGE_IDS = 4_000_000
LIMIT = 18


def code_lengths(count: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids never seen."""
    used = np.flatnonzero(count)
    out = np.zeros(len(count), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    order = used[np.argsort(count[used], kind="stable")]
    weight = count[order].astype(np.float64)
    n = len(order)
    # Each level: the leaves merged with pairs of the level below. A list's
    # first k entries hold known numbers of leaves and of packages.
    levels = []
    packages = np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([weight, packages])
        sort = np.argsort(both, kind="stable")
        levels.append(sort < n)
        both = both[sort]
        m = len(both) // 2
        packages = both[0 : 2 * m : 2] + both[1 : 2 * m : 2]
    lengths = np.zeros(n, np.int64)
    take = 2 * (n - 1)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical(bits: np.ndarray) -> np.ndarray:
    """The code of each id: by length, then id, counting up."""
    codes = np.zeros(len(bits), np.uint64)
    used = np.flatnonzero(bits)
    order = used[np.argsort(bits[used], kind="stable")]
    size = bits[order].astype(np.int64)
    if len(order):
        top = int(size.max())
        span = np.int64(1) << (top - size)
        codes[order] = ((np.cumsum(span) - span) >> (top - size)).astype(np.uint64)
    return codes


def lookup(bits: np.ndarray, limit: int) -> np.ndarray:
    """Entry for each ``limit`` leading bits: id * 32 + code length."""
    used = np.flatnonzero(bits)
    order = used[np.argsort(bits[used], kind="stable")]
    size = bits[order].astype(np.int64)
    entry = np.repeat(order * 32 + size, np.int64(1) << (limit - size))
    return np.concatenate([entry, np.zeros((1 << limit) - len(entry), np.int64)])


def encode_bits(ids: np.ndarray, codes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the bits as big-endian 64-bit words with one spare, bit offset of each id and the end)."""
    size = bits[ids].astype(np.int64)
    at = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    word, shift = at[:-1] >> 6, at[:-1] & 63
    left = codes[ids] << (64 - size).astype(np.uint64)
    out = np.zeros((int(at[-1]) >> 6) + 2, np.uint64)
    if len(ids):
        group = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out[word[group]] = np.add.reduceat(left >> shift.astype(np.uint64), group)
        over = np.flatnonzero(shift + size > 64)
        out[word[over] + 1] += left[over] << (64 - shift[over]).astype(np.uint64)
    return out, at


def decode_lanes(words: np.ndarray, at: np.ndarray, n: np.ndarray, table: np.ndarray, limit: int) -> np.ndarray:
    """Ids of many lanes one after the other: lane ``i`` has ``n[i]`` ids from bit ``at[i]``."""
    out = np.zeros(int(n.sum()), np.uint32)
    to = np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    at, to = at[order].copy(), to[order].copy()
    alive = np.searchsorted(-n[order], -np.arange(int(n.max(initial=0))), "left")  # lanes longer than each step
    down, one = np.uint64(64 - limit), np.uint64(1)
    for k in alive.tolist():
        p = at[:k]
        w, s = p >> 6, (p & 63).astype(np.uint64)
        window = (words[w] << s) | ((words[w + 1] >> one) >> (np.uint64(63) - s))
        entry = table[(window >> down).astype(np.int64)]
        out[to[:k]] = entry >> 5
        p += entry & 31
        to[:k] += 1
    return out


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, text_hash, n, ids (with the end id; two bytes each where the vocabulary allows, else four)."""

    def run(batches):
        enc = bpe.encoder(tokenizer)
        kind = _width(max(enc.size, end_id + 1))
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(2)):
                ids, at = bpe.with_end(*enc.encode(data, offsets), end_id)
                raw = ids.astype(kind).tobytes()
                size = np.dtype(kind).itemsize
                packed = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer((at * size).astype(np.int64).tobytes()), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(at)), packed], ["doc_id", "text_hash", "n", "ids"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, n long, ids binary")


def _width(ids: int) -> str:
    return "<u2" if ids <= 1 << 16 else "<u4"


def count_ids(texts: DataFrame, size: int) -> np.ndarray:
    """How often each id below ``size`` occurs; the vocabulary bounds what tasks and driver hold."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            column = batch.column(0).cast(pa.large_binary())
            _, at, data = column.buffers()
            at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
            if len(column) and at[-1] > at[0]:
                raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
                for lo in range(0, len(raw), 1 << 21):
                    total += np.bincount(raw[lo : lo + (1 << 21)].view(_width(size)), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])

    rows = texts.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, limit: int = LIMIT) -> str:
    """Encode all texts into the folder ``path`` in ascending ``doc_id`` order."""
    spark = docs.sparkSession
    tokenizer = tokenizer or bpe.default_path()
    docs = clear_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = max(bpe.encoder(tokenizer).size, end_id + 1)
    texts = staged(tokenized(docs, tokenizer, end_id), "token-ids")
    count = count_ids(texts, size)
    bits = code_lengths(count, limit)
    spark.createDataFrame([(bytearray(bits.tobytes()), end_id, limit)], "bits binary, end_id int, limit int").coalesce(1).write.parquet(f"{path}/codebook")
    book = spark.sparkContext.broadcast(bits.tobytes())  # one byte for each id of the vocabulary

    def run(batches):
        bits = np.frombuffer(book.value, np.uint8)
        codes = canonical(bits)
        shard, block, first = TaskContext.get().partitionId(), 0, 0

        def flush(doc_ids, parts, sizes):
            nonlocal block, first
            ids = np.concatenate(parts)
            words, at = encode_bits(ids, codes, bits)
            payload = words.astype(">u8").tobytes()[: (int(at[-1]) + 7) // 8]
            row = [shard, block, first, doc_ids, sizes, at[:-1:EVERY].astype("<i8").tobytes(), payload]
            block, first = block + 1, first + len(ids)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["shard", "block", "first", "doc_ids", "sizes", "checkpoints", "payload"])

        doc_ids, parts, sizes, held = [], [], [], 0
        for batch in batches:
            for name, n, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if held and held + n > BLOCK_IDS:
                    yield flush(doc_ids, parts, sizes)
                    doc_ids, parts, sizes, held = [], [], [], 0
                doc_ids.append(name)
                parts.append(np.frombuffer(raw, _width(size)))
                sizes.append(n)
                held += n
        if held:
            yield flush(doc_ids, parts, sizes)

    schema = "shard int, block long, first long, doc_ids array<long>, sizes array<long>, checkpoints binary, payload binary"
    ranges = max(1, -(-int(count.sum()) // RANGE_IDS))
    order = ["doc_id", "text_hash", "place"]  # the place among staged rows splits equal ones
    ranged = texts.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "n", "ids")
    ranged.mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files: ``doc_id``, ``start`` (ids before it in the whole
    corpus), ``ids``, one row for each document."""
    return _decoded(spark, path, digest=False)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read`, with the number of ids and their crc32 for the ids themselves."""
    return _decoded(spark, path, digest=True)


def _decoded(spark: SparkSession, path: str, digest: bool) -> DataFrame:
    (head,) = spark.read.parquet(f"{path}/codebook").collect()
    limit = head.limit
    book = spark.sparkContext.broadcast(bytes(head.bits))
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.select("shard", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # one row for each shard

    def run(batches):
        bits = np.frombuffer(book.value, np.uint8)
        table = lookup(bits, limit)
        for batch in batches:
            payloads = batch.column("payload").to_pylist()
            sizes = [np.array(x, np.int64) for x in batch.column("sizes").to_pylist()]
            held: list[int] = []
            for i in range(batch.num_rows):
                held.append(i)
                if sum(len(payloads[j]) for j in held) > 4 << 20 or i == batch.num_rows - 1:
                    words, at, n, base = [], [], [], 0
                    for j in held:
                        raw = payloads[j] + bytes(16 + -len(payloads[j]) % 8)
                        words.append(np.frombuffer(raw, ">u8").astype(np.uint64))
                        marks = np.frombuffer(batch.column("checkpoints")[j].as_py(), "<i8")
                        total = int(sizes[j].sum())
                        at.append(marks + 64 * base)
                        n.append(np.minimum(EVERY, total - EVERY * np.arange(len(marks))))
                        base += len(words[-1])
                    ids = decode_lanes(np.concatenate(words), np.concatenate(at), np.concatenate(n), table, limit)
                    size = np.concatenate([sizes[j] for j in held])
                    end = np.cumsum(size)
                    doc_ids = pa.array([d for j in held for d in batch.column("doc_ids")[j].as_py()], pa.int64())
                    first = np.concatenate([batch.column("first")[j].as_py() + np.cumsum(sizes[j]) - sizes[j] for j in held])
                    shard = np.repeat([batch.column("shard")[j].as_py() for j in held], [len(sizes[j]) for j in held]).astype(np.int32)
                    out = [pa.array(shard), doc_ids, pa.array(first), pa.array(size)]
                    if digest:
                        view = memoryview(ids.astype("<u4").tobytes())
                        out.append(pa.array([zlib.crc32(view[4 * b : 4 * e]) for b, e in zip((end - size).tolist(), end.tolist())], pa.int64()))
                    else:
                        out.append(pa.ListArray.from_arrays(pa.array(np.append(0, end).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(out, ["shard", "doc_id", "first", "n_tokens", "last"])
                    held = []

    rows = blocks.mapInArrow(run, f"shard int, doc_id long, first long, n_tokens long, last {'long' if digest else 'array<int>'}")
    named = "ids_crc32" if digest else "ids"
    return rows.join(totals, "shard").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", F.col("last").alias(named))


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write the corpus and read its digests back from the files."""
    spark = docs.sparkSession
    return read_digests(spark, write(docs, new_path(spark, "token-files"), **options))
