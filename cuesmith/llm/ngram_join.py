"""N-gram Jaccard self-join of whole texts, exact, giving link components.

A text is the set of its distinct shingles of ``n`` words (64-bit hashes). Equal
sets are one class from the start, so copies cost one row each. Classes that
link (Jaccard >= ``percent`` / 100) are found without comparing all pairs:

1. **Blocks.** Under one order of all shingles, linked sets share a shingle
   among their first ``size - ceil(t * size) + 1``. The order puts shingles that
   many texts hold last (they are counted over the whole corpus, and the ``HEAVY``
   most frequent are ranked; any order is exact, this one keeps blocks small), then
   goes by hash.
2. **Stars.** In each block every class is paired with the smallest class only.
   Confirmed links of all blocks join classes into first components.
3. **Count-vector R-tree.** What a star cannot show is a link between two
   classes of a block that are still in different components. For those,
   shingles are hashed into ``GROUPS`` groups and group counts are points: two
   points overlap by at most the sum of coordinate minima, two nodes of the tree
   by that of their maxima. Both trees are descended together from their roots;
   node pairs and points that cannot reach the threshold, whose sizes differ too
   much, or that lie in one component, are skipped. Blocks with the same
   smallest class are taken as one, so a pair is seen once for all of them, and
   dealt to tasks in tiles of ``TILE`` points, so no task holds a large one whole.
   It gives pairs in waves: first the likeliest few of each class, whose links
   join components; then more, and at last all pairs still between components.
   Texts of a large group so meet few others, and no pair is left out.
4. **Verification.** Surviving pairs of steps 2 and 3 are compared by their true
   intersection, and components are contracted until no link leaves one.

A tree over the points of the whole corpus alone prunes next to nothing (in that
many dimensions its boxes overlap), which is why blocks come first.

Classes carry ids of 16 bytes. Copies need not be expanded: membership is the class.

Cases: null and empty texts have no shingle and link with nothing, each is its
own component; fewer than ``n`` words are one shingle; repeated rows and texts
share a component; a null ``doc_id`` never names a component unless all its ids
are null; an empty table gives no row; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesmith.llm.common import SPACE_WORDS, Words, clear_columns, mix64, staged, text_chunks

GROUPS = 256
LEAF = 32
TILE = 1024
SMALL_BLOCK = 12
#: Pairs that a class may give in a tile, wave after wave; the last has no limit.
WAVES = (8, 64, None)
#: Most shingles that are ranked by frequency (the most frequent ones), and slots of
#: the table that tells most others apart from them; neither grows with the corpus.
HEAVY, SLOTS = 1 << 20, 1 << 22
#: Shingles held by a task before it reports those it saw more than once.
CHUNK = 4_000_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(data, offsets, SPACE_WORDS)
    h, first = words.hash, words.first
    count = len(h)
    gram = np.full(count, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            part = h[k:] if k else h
            gram[: len(part)] = mix64(gram[: len(part)] * np.uint64(0x9E3779B97F4A7C15) + part)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(gram[a : b - n + 1]))
        elif b > a:  # one shingle of all its words, of another kind than those of n
            one = np.array([b - a], np.uint64)
            for k in range(a, b):
                one = mix64(one * np.uint64(0x9E3779B97F4A7C15) + h[k] + np.uint64(7))
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_id(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def prefix_size(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def count_vector(shingles: np.ndarray) -> bytes:
    counts = np.bincount((shingles % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)
    most = int(counts.max(initial=0))
    return counts.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def vectors(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    out, wide = np.zeros((len(rows), GROUPS), np.int32), np.array([len(r) // GROUPS for r in rows], np.int64)
    for width, kind in ((1, np.uint8), (2, np.uint16), (4, np.uint32)):
        mine = np.flatnonzero(wide == width)
        if len(mine):
            out[mine] = np.frombuffer(b"".join(rows[i] for i in mine.tolist()), kind).reshape(-1, GROUPS)
    return out


def may_link(bound: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Whether an overlap of ``bound`` of sets with ``size`` elements in all can reach the threshold."""
    return (100 + percent) * bound >= percent * size


# ------------------------------------------------------------ corpus passes


def _texts(docs: DataFrame) -> DataFrame:
    return clear_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def profile(docs: DataFrame, n: int) -> DataFrame:
    """One row for each document (class, size, count vector where the class is
    new to the task), and one for each shingle that a task saw more than once."""
    names = ["doc_id", "class", "size", "vector", "shingle", "seen"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def rows(*columns):
        some = max(len(c) for c in columns if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(some, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def run(batches):
        held, held_size, known = [], 0, set()

        def frequent():
            shingles = np.sort(np.concatenate(held))
            start = np.flatnonzero(np.append(True, shingles[1:] != shingles[:-1]))
            seen = np.diff(np.append(start, len(shingles)))
            return rows(None, None, None, None, shingles[start[seen > 1]].view(np.int64), seen[seen > 1])

        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                classes, sizes, points = [], [], []
                for s in shingle_sets(data, offsets, n):
                    c = class_id(s)
                    classes.append(c)
                    sizes.append(len(s))
                    new = len(s) and c not in known
                    points.append(count_vector(s) if new else None)
                    if new:
                        known.add(c)
                        held.append(s)
                        held_size += len(s)
                yield rows(batch.column(0).slice(lo, hi - lo), classes, sizes, points, None, None)
            if held_size > CHUNK:
                yield frequent()
                held, held_size, known = [], 0, set()
        if held:
            yield frequent()

    schema = "doc_id long, class binary, size long, vector binary, shingle long, seen long"
    return docs.mapInArrow(run, schema)


class Ranks:
    """How often (by powers of four) the most frequent shingles occur; 0 for all others."""

    def __init__(self, shingles: np.ndarray, level: np.ndarray):
        order = np.argsort(shingles)
        self.shingles, self.level = shingles[order], np.minimum(level[order], 7).astype(np.uint8)
        self.maybe = np.zeros(SLOTS, bool)
        self.maybe[shingles % np.uint64(SLOTS)] = True

    def of(self, shingles: np.ndarray) -> np.ndarray:
        out = np.zeros(len(shingles), np.uint8)
        look = np.flatnonzero(self.maybe[shingles % np.uint64(SLOTS)])
        if len(look):
            at = np.minimum(np.searchsorted(self.shingles, shingles[look]), len(self.shingles) - 1)
            out[look] = np.where(self.shingles[at] == shingles[look], self.level[at], 0)
        return out


def ranks(table: DataFrame) -> Ranks:
    """The ``HEAVY`` most frequent shingles at most: all above the least frequency that leaves so few."""
    seen = table.where("shingle is not null").groupBy("shingle").agg(F.sum("seen").alias("seen")).where("seen >= 16")
    seen = staged(seen.select("shingle", F.floor(F.log2("seen") / 2).cast("int").alias("level")), "frequent")
    least, total = 2, 0
    for level, n in sorted(((r.level, r["count"]) for r in seen.groupBy("level").count().collect()), reverse=True):  # a row a level
        total += n
        if total > HEAVY:
            least = level + 1
            break
    got = seen.where(F.col("level") >= least).toArrow()  # at most HEAVY rows
    return Ranks(got.column("shingle").to_numpy().view(np.uint64), got.column("level").to_numpy())


def prefixes(docs: DataFrame, n: int, percent: int, rank: Ranks) -> DataFrame:
    """(shingle, class) for the first shingles of each class."""
    shared = docs.sparkSession.sparkContext.broadcast(rank)  # SLOTS + 9 * HEAVY bytes at most

    def run(batches):
        known = set()
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(1)):
                classes, firsts = [], []
                sets = shingle_sets(data, offsets, n)
                edges = np.cumsum([0, *[len(s) for s in sets]])
                level = shared.value.of(np.concatenate(sets)).astype(np.uint64) << np.uint64(61)
                for i, s in enumerate(sets):
                    c = class_id(s)
                    if len(s) and c not in known:
                        known.add(c)
                        order = level[edges[i] : edges[i + 1]] | (s >> np.uint64(3))
                        firsts.append(s[np.argsort(order, kind="stable")[: prefix_size(len(s), percent)]])
                        classes.append(c)
                if classes:
                    names = pa.DictionaryArray.from_arrays(np.repeat(np.arange(len(classes), dtype=np.int32), [len(f) for f in firsts]), pa.array(classes, pa.binary()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts).view(np.int64)), names.dictionary_decode()], ["shingle", "class"])
            if len(known) > 100_000:
                known = set()

    return docs.mapInArrow(run, "shingle long, class binary")


def packed_texts(docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """(class, packed) for the classes that ``wanted`` names, a text for each.

    A fixed table of bits, set for what is wanted, spares most other texts the
    shuffle; the join that follows is exact.
    """
    bits = 1 << 26
    slots = wanted.select(F.expr(f"cast(conv(hex(substring(class, 1, 4)), 16, 10) as long) % {bits}").alias("slot")).distinct()
    table = np.zeros(bits // 8, np.uint8)
    where = slots.select(F.floor(F.col("slot") / 8).cast("int").alias("byte"), F.expr("shiftleft(1, cast(slot % 8 as int))").alias("bit"))
    got = where.groupBy("byte").agg(F.bit_or("bit").alias("bit")).toArrow()  # at most bits / 8 rows
    table[got.column("byte").to_numpy()] = got.column("bit").to_numpy().astype(np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        table, known = shared.value, set()
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(1)):
                classes, packed = [], []
                for i, s in enumerate(shingle_sets(data, offsets, n)):
                    c = class_id(s)
                    slot = int.from_bytes(c[:4], "big") % bits
                    if c not in known and table[slot >> 3] >> (slot & 7) & 1:
                        known.add(c)
                        classes.append(c)
                        packed.append(zlib.compress(data[offsets[i] : offsets[i + 1]].tobytes(), 6))
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.binary()), pa.array(packed, pa.binary())], ["class", "packed"])
            if len(known) > 100_000:
                known = set()

    return docs.mapInArrow(run, "class binary, packed binary").dropDuplicates(["class"])


# ----------------------------------------------------------- pairs and trees


def bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs whose summed coordinate minima reach the threshold."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                bound = np.minimum(vectors(batch.column("v")), vectors(batch.column("w"))).sum(1)
                size = batch.column("m").to_numpy() + batch.column("n").to_numpy()
                yield batch.select(["a", "b"]).filter(pa.array(may_link(bound, size, percent)))

    left = points.select(F.col("class").alias("a"), F.col("vector").alias("v"), F.col("size").alias("m"))
    right = points.select(F.col("class").alias("b"), F.col("vector").alias("w"), F.col("size").alias("n"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "v", "w", "m", "n").mapInArrow(run, "a binary, b binary")


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs that link, by the sizes of intersection and union."""

    def run(batches):
        last: dict[bytes, np.ndarray] = {}

        def get(c, packed):
            if c not in last:
                if len(last) > 64:
                    last.clear()
                data = np.frombuffer(zlib.decompress(packed), np.uint8)
                last[c] = shingle_sets(data, np.array([0, len(data)]), n)[0]
            return last[c]

        for batch in batches:
            keep = []
            for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "x", "y"))):
                s, t = get(a, x), get(b, y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("class").alias("a"), F.col("packed").alias("x"))
    right = texts.select(F.col("class").alias("b"), F.col("packed").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


class RTree:
    """Bulk-loaded R-tree over count vectors: nodes are halved along the coordinate of
    largest spread down to ``LEAF`` points. A node keeps its coordinate maxima, its
    least and largest set size, and the component of its points if they share one."""

    def __init__(self, points: np.ndarray, size: np.ndarray, part: np.ndarray):
        self.points, self.size, self.part = points, size, part
        self.members, self.left, self.right = [np.arange(len(points))], [-1], [-1]
        k = 0
        while k < len(self.members):
            mine = self.members[k]
            if len(mine) > LEAF:
                spread = points[mine].max(0) - points[mine].min(0)
                mine = mine[np.argsort(points[mine, int(spread.argmax())], kind="stable")]
                self.left[k], self.right[k] = len(self.members), len(self.members) + 1
                self.members += [mine[: len(mine) // 2], mine[len(mine) // 2 :]]
                self.left += [-1, -1]
                self.right += [-1, -1]
            k += 1
        self.left, self.right = np.array(self.left), np.array(self.right)
        self.top = np.stack([points[m].max(0) for m in self.members])
        self.least, self.most = np.array([(size[m].min(), size[m].max()) for m in self.members]).T
        self.one = np.array([part[m[0]] if (part[m] == part[m[0]]).all() else -1 for m in self.members])

    def children(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``k``, node): both children of each node, or the node itself if a leaf."""
        leaf = self.left[k] < 0
        here = np.arange(len(k))
        return np.concatenate([here, here[~leaf]]), np.concatenate([np.where(leaf, k, self.left[k]), self.right[k][~leaf]])


def tree_join(left: RTree, right: RTree, percent: int):
    """Index pairs (of ``left``, of ``right``) in different components whose bound reaches
    the threshold, and the bound as a share of both sizes. One tree with itself gives
    each pair once."""
    same = left is right
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    ends = []
    while len(i):
        ok = np.zeros(len(i), bool)
        for lo in range(0, len(i), 4096):
            x, y = i[lo : lo + 4096], j[lo : lo + 4096]
            bound = np.minimum(np.minimum(left.top[x], right.top[y]).sum(1), np.minimum(left.most[x], right.most[y]))
            near = (100 * left.most[x] >= percent * right.least[y]) & (100 * right.most[y] >= percent * left.least[x])
            apart = (left.one[x] < 0) | (left.one[x] != right.one[y])
            ok[lo : lo + 4096] = may_link(bound, left.least[x] + right.least[y], percent) & near & apart
        i, j = i[ok], j[ok]
        done = (left.left[i] < 0) & (right.left[j] < 0)
        ends.append((i[done], j[done]))
        i, j = i[~done], j[~done]
        at, x = left.children(i)
        back, y = right.children(j[at])
        twice = same & (i[at[back]] == j[at[back]]) & (x[back] > y)  # the mirrored half of a node with itself
        i, j = x[back][~twice], y[~twice]
    a, b, share = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for x, y in zip(*(np.concatenate(e).tolist() for e in zip(*ends))):
        m, o = left.members[x], right.members[y]
        bound = np.minimum(left.points[m][:, None, :], right.points[o][None, :, :]).sum(2)
        both = left.size[m][:, None] + right.size[o][None, :]
        ok = may_link(bound, both, percent) & (left.part[m][:, None] != right.part[o][None, :])
        if same and x == y:
            ok = np.triu(ok, 1)
        p, q = np.nonzero(ok)
        a.append(m[p])
        b.append(o[q])
        share.append(bound[p, q] / both[p, q])
    return np.concatenate(a), np.concatenate(b), np.concatenate(share)


def likeliest(a: np.ndarray, b: np.ndarray, share: np.ndarray, most: int) -> np.ndarray:
    """Marks the pairs that are among the ``most`` of largest share of either end."""
    keep = np.zeros(len(a), bool)
    ends, pair = np.concatenate([a, b]), np.tile(np.arange(len(a)), 2)
    order = np.lexsort((pair, -share[pair], ends))
    start = np.flatnonzero(np.append(True, ends[order][1:] != ends[order][:-1])) if len(a) else np.zeros(0, np.int64)
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    keep[pair[order[place < most]]] = True
    return keep


def hub_rows(members: DataFrame) -> DataFrame:
    """(hub, class, k, shingles): the blocks of one hub as one, so that a pair of
    theirs is looked at once; ``k`` classes, each with the sorted shingles it has
    in those blocks (at most its own first ones)."""
    rows = staged(members.groupBy("hub", "class").agg(F.sort_array(F.collect_set("shingle")).alias("shingles")), "hubs")
    sizes = rows.groupBy("hub").agg(F.count("*").alias("k")).where("k >= 3")
    return rows.join(sizes, "hub")


def open_rows(hubs: DataFrame, parts: DataFrame, points: DataFrame) -> DataFrame:
    """The rows of hubs with several components, with part, size and vector."""
    rows = staged(hubs.join(parts, "class", "left").withColumn("part", F.coalesce("part", "class")), "hub-rows")
    mixed = rows.groupBy("hub").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("hub")
    return staged(rows.join(mixed, "hub").join(points, "class"), "open-hubs")


def open_pairs(rows: DataFrame, points: DataFrame, percent: int, most: int | None) -> DataFrame:
    """Pairs (a, b) of a block in different components that the bound does not
    exclude. With ``most``, a tile of a large hub gives only the likeliest pairs
    of each class; a row with ``cut`` names each hub where that left some out."""
    small = rows.where(F.col("k") <= SMALL_BLOCK)  # so at most SMALL_BLOCK ** 2 / 2 pairs each
    other = small.select("hub", F.col("class").alias("b"), F.col("part").alias("other"), F.col("size").alias("n"), F.col("shingles").alias("theirs"))
    ratio = (F.col("size") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("size") * percent)
    apart = (F.col("class") < F.col("b")) & (F.col("part") != F.col("other")) & ratio
    pairs = small.join(other, "hub").where(apart & F.arrays_overlap("shingles", "theirs"))
    pairs = bounded(pairs.select(F.col("class").alias("a"), "b").distinct(), points, percent)

    def join_tiles(table: pa.Table) -> pa.Table:
        v, size = vectors(table.column("vector")), table.column("size").to_numpy()
        names = np.array(table.column("class").to_pylist(), object)
        part = table.column("part").combine_chunks().dictionary_encode().indices.to_numpy()
        c = np.argsort(np.argsort(names, kind="stable"), kind="stable")  # a hub holds a class once
        tile, i, j = table.column("tile").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        x, y = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        left = RTree(v[x], size[x], part[x])
        a, b, share = tree_join(left, left if i == j else RTree(v[y], size[y], part[y]), percent)
        a, b = x[a], y[b]
        start, shingles = np.append(0, np.cumsum(pc.list_value_length(table.column("shingles")).to_numpy())), pc.list_flatten(table.column("shingles")).to_numpy()
        shared = np.array([len(np.intersect1d(shingles[start[m] : start[m + 1]], shingles[start[o] : start[o + 1]], True)) > 0 for m, o in zip(a.tolist(), b.tolist())], bool)
        a, b, share = a[shared], b[shared], share[shared]
        a, b = np.where(c[a] < c[b], a, b), np.where(c[a] < c[b], b, a)
        whole = len(a)
        if most is not None:
            keep = likeliest(a, b, share, most)
            a, b = a[keep], b[keep]
        out = pa.table({"a": pa.array(names[a], pa.binary()), "b": pa.array(names[b], pa.binary()), "cut": pa.nulls(len(a), pa.binary())})
        if len(a) < whole:
            mark = pa.table({"a": pa.nulls(1, pa.binary()), "b": pa.nulls(1, pa.binary()), "cut": table.column("hub").slice(0, 1).cast(pa.binary())})
            out = pa.concat_tables([out, mark])
        return out

    tiles = F.ceil(F.col("k") / TILE).cast("int")
    large = rows.where(F.col("k") > SMALL_BLOCK).withColumn("tile", F.pmod(F.xxhash64("class"), tiles).cast("int"))
    large = large.withColumn("with", F.explode(F.sequence(F.lit(0), tiles - 1)))
    large = large.withColumn("i", F.least("tile", "with")).withColumn("j", F.greatest("tile", "with"))
    pairs = pairs.withColumn("cut", F.lit(None).cast("binary"))
    return pairs.unionByName(large.groupBy("hub", "i", "j").applyInArrow(join_tiles, "a binary, b binary, cut binary")).distinct()


# --------------------------------------------------------------- components


def components(links: DataFrame) -> DataFrame:
    """(class, part) for every linked class: ``part`` is the smallest class it reaches.

    Each round hooks every class to its smallest neighbour, follows the hooks to
    their ends and replaces links by links between ends.
    """
    links = staged(links.select("a", "b"), "links")
    found = None
    while links.head(1):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("up")), "hooks")
        while True:
            above = hook.select(F.col("a").alias("up"), F.col("up").alias("top"))
            jumped = staged(hook.join(above, "up").select("a", "top", (F.col("top") != F.col("up")).alias("moved")), "hooks")
            hook = jumped.select("a", F.col("top").alias("up"))
            if not jumped.where("moved").head(1):
                break
        if found is None:
            found = hook.select(F.col("a").alias("class"), F.col("up").alias("part"))
        else:
            later = hook.select(F.col("a").alias("part"), "up")
            found = staged(found.join(later, "part", "left").select("class", F.coalesce("up", "part").alias("part")), "parts")
        x, y = hook.select("a", F.col("up").alias("x")), hook.select(F.col("a").alias("b"), F.col("up").alias("y"))
        ends = links.join(x, "a").join(y, "b").where("x != y")
        links = staged(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return found if found is not None else links.select(F.col("a").alias("class"), F.col("b").alias("part"))


def similar(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, class: documents with their link component."""
    docs = _texts(docs)
    table = staged(profile(docs, n), "profile")
    rows = table.where("shingle is null").select("doc_id", "class", "size", "vector")
    points = staged(rows.where("vector is not null").select("class", "size", "vector").dropDuplicates(["class"]), "points")

    firsts = staged(prefixes(docs, n, percent, ranks(table)), "prefixes")
    blocks = firsts.groupBy("shingle").agg(F.min("class").alias("hub"), F.max("class").alias("other")).where("hub < other")
    members = staged(firsts.join(blocks.select("shingle", "hub"), "shingle"), "members")
    stars = staged(members.where("class != hub").select(F.col("hub").alias("a"), F.col("class").alias("b")).distinct(), "stars")
    near = staged(bounded(stars, points, percent), "near")
    texts = staged(packed_texts(docs, n, members.select("class")), "texts")
    links = staged(verified(near, texts, n, percent), "links")
    parts = components(links)

    left, tested = staged(hub_rows(members), "hub-sizes"), stars
    for most in WAVES:
        found = staged(open_pairs(open_rows(left, parts, points), points, percent, most), "open")
        more = found.where("cut is null").select("a", "b").join(tested, ["a", "b"], "left_anti")
        new = staged(verified(more, texts, n, percent), "links")
        if new.head(1):
            links = links.unionByName(new)
            parts = components(links)
        cut = found.where("cut is not null").select(F.col("cut").alias("hub"))
        if not cut.head(1):
            break
        left, tested = left.join(cut, "hub", "left_semi"), tested.unionByName(more)

    named = rows.where("size > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    named = named.join(parts, "class", "left").select("class", F.coalesce("part", "class").alias("part"), "least")
    whole = named.groupBy("part").agg(F.min("least").alias("component_id"))
    named = named.join(whole, "part").select("class", "component_id")
    full = rows.where("size > 0").join(named, "class").select("doc_id", F.col("size").alias("n_shingles"), "component_id", "class")
    return full.unionByName(rows.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("class")))
