"""Benchmark decontamination with an FM-index for each training shard.

Benchmark items are cut into windows of ``window`` words (a shorter item is one
window). A shard of the corpus - a few megabytes of whole texts - becomes a
sequence of symbols: one for each word of the benchmark, and a separator. Words
that no item holds cannot be part of an occurrence, so runs of benchmark words
are all that is indexed, and only those as long as the shortest window. The
index is the Burrows-Wheeler transform of that sequence in a wavelet matrix:
backward search finds together all windows whose words the shard holds, positions
come from sampled suffix positions by walking back, and overlapping occurrences
merge into removal spans.

Nothing is shuffled: shards are independent. The benchmark travels to every task
in parts of about ``PART_BYTES`` of text (an item is never split; its size is
checked before anything is collected). With several parts the corpus is passed
over once for each; what one has found goes along, as spans of word positions,
through a staged table, and the next merges its own into it.

Cases: null and empty texts have no words and are clean; items without words
have no window; repeated rows are judged each on their own; a null ``item_id``
counts as the empty string; an empty benchmark leaves all clean, as does one
without any word of the corpus; shards of any size, shorter than a window too, are
searched; columns with clashing names do not matter, ``remove`` keeps them as
they are. ``remove`` cuts what occurs in a text as it stands: words that a cut
brings together are not searched again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesmith.llm.common import ALNUM_WORDS, Words, clear_columns, ragged_arange, staged, text_chunks

PART_BYTES = 8 << 20
SAMPLE = 16
END, GAP, WORD = 0, 1, 2  # symbols: the end, the separator, the first word
SHARD_BYTES = (2 << 20) - 1


class WaveletMatrix:
    """Rank queries over symbols below ``2**levels``, many at once."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.ones, self.zeros = levels, [], []
        for level in reversed(range(levels)):
            bit = (symbols >> level) & 1
            ones = np.zeros(len(symbols) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        lo = np.zeros_like(i)
        for k, level in enumerate(reversed(range(self.levels))):
            ones, one = self.ones[k], ((symbol >> level) & 1).astype(bool)
            a, b = ones[lo], ones[i]
            lo, i = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, i - b)
        return i - lo

    def at(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for k in range(self.levels):
            ones = self.ones[k]
            one = ones[i + 1] - ones[i]
            out = out * 2 + one
            i = np.where(one == 1, self.zeros[k] + ones[i], i - ones[i])
        return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Sorted suffixes by prefix doubling; the last symbol has to be the only 0."""
    n = len(symbols)
    width = max(1, int(symbols.max()).bit_length())
    h = max(1, 62 // width)
    key = np.zeros(n, np.int64)
    for k in range(min(h, n)):
        key = key << width
        key[: n - k] |= symbols[k:]
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]))
        if rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: n - h] = rank[h:] + 1
        key = rank * (n + 1) + after
        h *= 2


class FMIndex:
    def __init__(self, symbols: np.ndarray, sigma: int):
        order = suffix_array(symbols)
        last = symbols[order - 1]
        self.tree = WaveletMatrix(last, max(1, int(sigma - 1).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        sampled = order % SAMPLE == 0
        self.sampled = np.concatenate([[0], np.cumsum(sampled)])
        self.positions = order[sampled]
        self.n = len(symbols)

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the range of sorted suffixes that start with each row."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        for k in reversed(range(patterns.shape[1])):
            c = patterns[:, k]
            lo = self.before[c] + self.tree.rank(c, lo)
            hi = self.before[c] + self.tree.rank(c, hi)
        return lo, np.maximum(lo, hi)

    def locate(self, i: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk back to a sampled one."""
        out = np.zeros(len(i), np.int64)
        open_, i, steps = np.arange(len(i)), i.copy(), 0
        while len(open_):
            done = self.sampled[i + 1] > self.sampled[i]
            out[open_[done]] = self.positions[self.sampled[i[done]]] + steps
            open_, i = open_[~done], i[~done]
            c = self.tree.at(i)
            i = self.before[c] + self.tree.rank(c, i)
            steps += 1
        return out


class Phrases:
    """A part of the benchmark: its words, and its windows by length with the items that hold them."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = np.array(sorted({name for name, _ in items}), object)
        number = np.searchsorted(self.names, np.array([name for name, _ in items], object))
        chunks = [(lo, Words(d, o, ALNUM_WORDS)) for lo, _, d, o in text_chunks(pa.array([text for _, text in items], pa.string()), PART_BYTES)]
        hashes = np.concatenate([np.zeros(0, np.uint64), *[w.hash for _, w in chunks]])
        owner = np.concatenate([np.zeros(0, np.int64), *[w.owner() + lo for lo, w in chunks]])
        self.hashes, ids = np.unique(hashes, return_inverse=True)
        ids = ids + WORD
        self.sigma = len(self.hashes) + WORD
        first = np.searchsorted(owner, np.arange(len(items) + 1))
        size = np.diff(first)
        self.groups = []  # (length, patterns, offsets of each pattern's items, items)
        for m in np.unique(np.minimum(size, window)):
            mine = np.flatnonzero(np.minimum(size, window) == m)
            if m:
                many = size[mine] - m + 1
                start = np.repeat(first[mine], many) + ragged_arange(many)
                rows = np.ascontiguousarray(ids[start[:, None] + np.arange(m)].astype(np.int32))
                patterns, kind = np.unique(rows, axis=0, return_inverse=True)
                pairs = np.unique(kind.ravel().astype(np.int64) * len(self.names) + np.repeat(number[mine], many))
                held = np.searchsorted(pairs // len(self.names), np.arange(len(patterns) + 1))
                self.groups.append((int(m), patterns, held, pairs % len(self.names)))

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(whether each word is hit, sorted distinct text * number of items + item)."""
        hit = np.zeros(len(words.starts) + 1, np.int64)
        if not self.groups or not len(words.hash):
            return hit[:-1] > 0, np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, words.hash), len(self.hashes) - 1)
        known = self.hashes[at] == words.hash
        first = np.zeros(len(known), bool)
        first[words.first[:-1][words.first[:-1] < len(known)]] = True
        begin = known & (first | ~np.append(False, known[:-1]))
        start = np.flatnonzero(begin)
        stop = np.flatnonzero(known & (np.append(first[1:], True) | ~np.append(known[1:], False))) + 1
        long = stop - start >= self.groups[0][0]
        start, size = start[long], (stop - start)[long]
        if not len(start):
            return hit[:-1] > 0, np.zeros(0, np.int64)
        place = np.repeat(start, size + 1) + ragged_arange(size + 1)  # each run and the gap after it
        symbols = np.append(at[np.minimum(place, len(at) - 1)] + WORD, END)
        symbols[np.cumsum(size + 1) - 1] = GAP
        index = FMIndex(symbols, self.sigma)
        here = np.zeros(self.sigma, bool)
        here[symbols] = True
        owner, pairs = words.owner(), [np.zeros(0, np.int64)]
        for m, patterns, offsets, items in self.groups:
            look = np.flatnonzero(here[patterns].all(1))
            lo, hi = index.find(patterns[look].astype(np.int64))
            n = hi - lo
            which = np.repeat(np.arange(len(n)), n)
            word = place[index.locate(lo[which] + ragged_arange(n))]
            np.add.at(hit, word, 1)
            np.add.at(hit, word + m, -1)
            which = look[which]
            many = np.diff(offsets)[which]
            pairs.append(np.unique(np.repeat(owner[word], many) * len(self.names) + items[np.repeat(offsets[which], many) + ragged_arange(many)]))
        return np.cumsum(hit[:-1]) > 0, np.unique(np.concatenate(pairs))


def _spans(words: Words, hit: np.ndarray, i: int) -> list[tuple[int, int]]:
    """Byte spans of the merged hits of text ``i``, counted from its start."""
    lo, hi = words.first[i], words.first[i + 1]
    inside = np.flatnonzero(hit[lo:hi]) + lo
    if not len(inside):
        return []
    new = np.flatnonzero(np.append(True, np.diff(inside) > 1))
    starts, ends = words.starts[inside[new]], words.ends[inside[np.append(new[1:], len(inside)) - 1]]
    return list(zip(starts.tolist(), ends.tolist()))


def parts_of(benchmark: DataFrame, window: int) -> Iterator[Phrases]:
    """The benchmark in parts of about ``PART_BYTES``, one in the driver at a time."""
    items = clear_columns(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    many = max(1, -(-size // PART_BYTES))
    for k in range(many):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == k)
        yield Phrases([(r.item_id, r.text) for r in part.collect()], window)


def _found(batch: pa.RecordBatch, phrases: Phrases):
    """For each shard of a batch: first and last row, words, whether each is hit, items of each text;
    all with what earlier parts have found."""
    for lo, hi, data, offsets in text_chunks(batch.column("_text"), SHARD_BYTES):
        words = Words(data, offsets, ALNUM_WORDS)
        hit, pairs = phrases.hits(words)
        items = [set(x or ()) for x in batch.column("_items").slice(lo, hi - lo).to_pylist()]
        for x in pairs.tolist():
            items[x // len(phrases.names)].add(phrases.names[x % len(phrases.names)])
        for i, spans in enumerate(batch.column("_hit").slice(lo, hi - lo).to_pylist()):
            for a, b in zip((spans or ())[::2], (spans or ())[1::2]):
                hit[words.first[i] + a : words.first[i] + b] = True
        yield lo, hi, words, hit, [sorted(x) for x in items]


def _passes(rows: DataFrame, benchmark: DataFrame, window: int):
    """``rows`` (row, text) after all parts of the benchmark but the last, and the last part, broadcast."""
    spark = rows.sparkSession
    carried = rows.withColumn("_hit", F.lit(None).cast("array<int>")).withColumn("_items", F.lit(None).cast("array<string>"))
    schema, last = carried.schema, None
    for phrases in parts_of(benchmark, window):
        if last is not None:
            carried = staged(carried.mapInArrow(_marker(last), schema), "decontamination")
        last = spark.sparkContext.broadcast(phrases)
    return carried, last


def _marker(phrases):
    def run(batches):
        for batch in batches:
            for lo, hi, words, hit, items in _found(batch, phrases.value):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                owner = np.append(words.owner(), hi - lo)
                spans = [[] for _ in range(hi - lo)]
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    for i in range(owner[a], owner[b - 1] + 1):  # a run may go over from one text to the next
                        spans[i] += [max(a, words.first[i]) - words.first[i], min(b, words.first[i + 1]) - words.first[i]]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(lo, hi - lo) for k in ("_row", "_text")], pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["_row", "_text", "_hit", "_items"])

    return run


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings), spans (UTF-8 byte offsets to remove)."""
    rows = clear_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("_row"), F.col("text").cast("string").alias("_text"))
    carried, phrases = _passes(rows, benchmark, window)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        for batch in batches:
            for lo, hi, words, hit, items in _found(batch, phrases.value):
                n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[words.first])
                spans = [[{"start": a - words.offsets[i], "end": b - words.offsets[i]} for a, b in _spans(words, hit, i)] if n_hit[i] else [] for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row").slice(lo, hi - lo), pa.array(np.diff(words.first)), pa.array(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(span))],
                    ["doc_id", "n_words", "n_hit", "item_ids", "spans"],
                )

    return carried.mapInArrow(run, "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,end:int>>")


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` with every hit passage cut out of ``text``; all columns and rows stay."""
    others = F.struct(*[F.col(f"`{n}`") for n in docs.columns if n != "text"], F.lit(0).alias("_nothing"))
    carried, phrases = _passes(docs.select(others.alias("_row"), F.col("text").alias("_text")), benchmark, window)
    schema = carried.select("_row", "_text").schema

    def run(batches):
        for batch in batches:
            for lo, hi, words, hit, _ in _found(batch, phrases.value):
                out = batch.column("_text").slice(lo, hi - lo)
                touched = np.unique(words.owner()[hit])
                if len(touched):
                    new = out.to_pylist()
                    for i in touched.tolist():
                        rest, end = [], words.offsets[i]
                        for a, b in _spans(words, hit, i):
                            rest.append(words.raw[end:a].tobytes())
                            end = b
                        new[i] = b"".join([*rest, words.raw[end : words.offsets[i + 1]].tobytes()]).decode()
                    out = pa.array(new, out.type)
                yield pa.RecordBatch.from_arrays([batch.column("_row").slice(lo, hi - lo), out], ["_row", "_text"])

    cut = carried.mapInArrow(run, schema)
    return cut.select(*[F.col("_text").alias(n) if n == "text" else F.col("_row").getField(n).alias(n) for n in docs.columns])
