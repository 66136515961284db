"""Toxicity: a convolutional text classifier, trained and run in numpy.

Words are hashed; those that occur in two learning texts have an embedding, all
others the zero vector. Where these words are more than ``ROWS``, every word has
the embedding of its hash modulo ``ROWS``, so a model has a bounded size and no
word is left out. Filters of several widths run over the words of a text, each
keeps its largest response (max pooling), and a logistic layer gives the raw
score. Embeddings start from how far a word's share of toxic texts lies above
chance and are trained on with everything else.

Raw scores are calibrated by language: the language is guessed from the text
alone (word counts of the learning texts), and each guess has its own
threshold, chosen on the texts kept apart. A score is shifted so that its
language's threshold becomes ``THRESHOLD``. Languages without ``LEAST`` toxic and
as many other texts among those kept apart count as one.

Every labelled text outside the held-out third is used whole. A fifth of them, by
a hash of the id, is kept apart for the thresholds; from it neither words nor
weights nor the guess of language are learned. Word counts and counts of raw
scores (in steps of 1 / ``STEPS``) are sums over all texts. The weights are
trained in ``EPOCHS`` passes over all learning texts: these are dealt by a hash
of the id into units of at most ``UNIT_TEXTS`` texts and about ``UNIT_WORDS``
words, each pass runs gradient descent over every unit from the same weights, and
the mean of what the units changed, weighted by their texts, is added (for an
embedding that of the units that changed it). A unit is one row of a staged table,
so the result does not depend on how the rows lie. Scoring shuffles nothing.

Cases: null and empty texts get the score of a text without known words; with no
usable label every score is 0, with one class only its rate; repeated rows are
scored each on their own; documents with several labels take the largest; other
columns are not carried by :func:`score` and kept as they are by :func:`reject`.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesmith.llm.common import ALNUM_WORDS, Words, clear_columns, give_back, held_out, release, staged, staged_paths, text_chunks

THRESHOLD = 0.7
ROWS = 1 << 18
UNIT_TEXTS, UNIT_WORDS = 1 << 12, 1 << 21
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
EPOCHS, BATCH = 5, 64
#: Embeddings are summed up in so many slices.
SLICES = 128
#: Words of which the responses are held at a time.
PART = 1 << 16
LEAST, STEPS, FARTHEST = 5, 1024, 40


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logit(p):
    return np.log(p) - np.log1p(-p)


class Net:
    """Embeddings, filters and the logistic layer, with what their training keeps."""

    def _begin(self, n: np.ndarray, t: np.ndarray, rate: float, rng):
        """Embeddings of rows that ``n`` texts have, ``t`` of them toxic; filters by chance."""
        z = (t - n * rate) / np.sqrt(n * rate * (1 - rate) + 1)
        self.e = rng.normal(0, 0.02, (len(n) + 1, DIM)).astype(np.float32)
        self.e[1:, 0] = np.clip(z / 4, -1, 3)
        self.e[0] = 0
        scale = 0.3
        self.w = {k: rng.normal(0, scale, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS}
        for k in WIDTHS:
            self.w[k][:, 0, : FILTERS // 2] = np.abs(self.w[k][:, 0, : FILTERS // 2]) + 0.5  # half of them heed the first coordinate from the start
        self.b = {k: np.full(FILTERS, -0.3, np.float32) for k in WIDTHS}
        self.u = np.full(len(WIDTHS) * FILTERS, 0.3, np.float32)
        self.c = np.float32(_logit(np.clip(self.base, 0.01, 0.99)))
        self.first, self.second = [np.zeros_like(p) for p in self._params()], [np.zeros_like(p) for p in self._params()]
        self.squares, self.c_sq, self.step = np.zeros(len(self.e), np.float32), 0.0, 0.0

    def _params(self) -> list[np.ndarray]:
        return [*self.w.values(), *self.b.values(), self.u]

    def net(self) -> Net:
        """A copy of this part alone."""
        out = Net()
        for name in ("e", "w", "b", "u", "c", "first", "second", "squares", "c_sq", "step"):
            setattr(out, name, copy.deepcopy(getattr(self, name)))
        return out

    def dense(self) -> np.ndarray:
        """All but the embeddings, one after the other."""
        return np.concatenate([*(p.ravel() for p in (*self._params(), *self.first, *self.second)), [self.c, self.c_sq, self.step]]).astype(float)

    def set_dense(self, flat: np.ndarray) -> None:
        at = 0
        for p in (*self._params(), *self.first, *self.second):
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        self.c, self.c_sq, self.step = np.float32(flat[at]), float(flat[at + 1]), float(flat[at + 2])

    def tops(self, ids: np.ndarray) -> list:
        """For each width the place of each filter's largest response, and the response; None for texts with fewer words."""
        found: list = [None] * len(WIDTHS)
        for lo in range(0, len(ids), PART):
            x = self.e[ids[lo : lo + PART + WIDTHS[-1] - 1]]
            for m, k in enumerate(WIDTHS):
                n = min(PART, len(x) - k + 1)
                if n < 1:
                    continue
                r = sum(x[j : n + j] @ self.w[k][j] for j in range(k))
                top = r.argmax(0)
                most = r[top, np.arange(FILTERS)]
                if found[m]:
                    more = most > found[m][1]
                    top, most = np.where(more, top + lo, found[m][0]), np.where(more, most, found[m][1])
                found[m] = (top, most)
        return found

    def descend(self, docs: list[np.ndarray], labels: np.ndarray, rng) -> np.ndarray:
        """One pass over ``docs`` in a random order; returns the rows whose embeddings it changed."""
        changed = np.zeros(len(self.e), bool)
        params = self._params()
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            grads = [np.zeros_like(p) for p in params]
            g_c, touched = 0.0, []
            for i in pick.tolist():
                ids = docs[i]
                tops = self.tops(ids)
                pooled = np.concatenate([np.maximum(t[1] + self.b[k], 0) if t else np.zeros(FILTERS, np.float32) for t, k in zip(tops, WIDTHS)])
                d = float(_sigmoid(pooled @ self.u + self.c)) - float(labels[i])
                grads[-1] += d * pooled
                g_c += d
                back = d * self.u * (pooled > 0)
                for n, k in enumerate(WIDTHS):
                    if not tops[n]:
                        continue
                    g = back[n * FILTERS : (n + 1) * FILTERS]
                    grads[len(WIDTHS) + n] += g
                    for j in range(k):
                        at = ids[tops[n][0] + j]
                        grads[n][j] += self.e[at].T * g
                        touched.append((at, (self.w[k][j] * g).T))
            self.step += 1
            for p, g, m, v in zip(params, grads, self.first, self.second):
                g = g / len(pick) + 1e-4 * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.02 * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-7)
            g_c /= len(pick)
            self.c_sq += g_c * g_c
            self.c -= np.float32(0.1 * g_c / np.sqrt(self.c_sq + 1e-7))
            if touched:
                at = np.concatenate([t[0] for t in touched])
                g = np.concatenate([t[1] for t in touched]) / len(pick)
                np.add.at(self.squares, at, (g * g).sum(1))
                np.add.at(self.e, at, -0.05 * g / np.sqrt(self.squares[at] + 1e-6)[:, None])
                self.e[0] = 0
                changed[at] = True
        changed[0] = False
        return np.flatnonzero(changed)


class Model(Net):
    """Everything that scoring needs; some megabytes, bounded by ``ROWS`` and the languages.
    Made of a few texts at hand here, of a table by :func:`fit`."""

    def __init__(self, texts: list[str] | pa.Array = (), labels: np.ndarray = np.zeros(0), languages: list[str] = (), seed: int = 7):
        self.base = float(labels.mean()) if len(labels) else 0.0
        self.trained = bool(len(labels)) and 0 < labels.sum() < len(labels)
        if not self.trained:
            return
        rng = np.random.default_rng(seed)
        hashes = []
        for _, _, data, offsets in text_chunks(pa.array(texts, pa.string()) if isinstance(texts, list) else texts):
            words = Words(data, offsets, ALNUM_WORDS)
            hashes += [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        del texts, words
        apart = np.arange(len(hashes)) % 5 == 4
        if not enough(len(labels), labels.sum(), (~apart).sum(), labels[~apart].sum()):
            apart[:] = False
        learn, pick = np.flatnonzero(~apart), np.flatnonzero(apart if apart.any() else ~apart)
        self.names = sorted({x or "" for x in languages})
        number = np.array([self.names.index(x or "") for x in languages])
        own, word, n, t, times = counted([hashes[i] for i in learn], labels[learn], number[learn])
        words, at = np.unique(word, return_inverse=True)
        keep = np.bincount(at, weights=n) >= 2
        self._rows(words[keep], keep.sum())
        known = keep[at]
        self._learned(own[known], self.index(word[known]) - 1, n[known], t[known], times[known], float(labels[learn].mean()), rng)
        docs = [self.index(h) for h in hashes]
        for _ in range(EPOCHS):
            self.descend([docs[i] for i in learn], labels[learn], rng)
        first = np.concatenate([[0], np.cumsum([len(docs[i]) for i in pick])])
        self.calibrate(*self.counts(np.concatenate([*[docs[i] for i in pick], np.zeros(0, np.int64)]), first, labels[pick]))

    def _rows(self, words: np.ndarray | None, many: int) -> None:
        """Words with a row of their own in ascending order; None: a row is a hash modulo ``ROWS``."""
        self.words, self.many = words, int(many)

    def index(self, h: np.ndarray) -> np.ndarray:
        if self.words is None:
            return h.view(np.int64) % self.many + 1
        if not len(self.words):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at + 1, 0)

    def _learned(self, own, row, n, t, times, rate: float, rng) -> None:
        """What a pass starts from, and log counts of known words by language, smoothed:
        of rows in a language the texts, toxic texts and occurrences."""
        self._begin(np.bincount(row, weights=n, minlength=self.many), np.bincount(row, weights=t, minlength=self.many), rate, rng)
        counts = np.full((len(self.names), self.many + 1), 0.5, np.float32)
        np.add.at(counts, (own, row + 1), times.astype(np.float32))
        counts[:, 0] = 1
        self.speech = np.log(counts / counts[:, 1:].sum(1, keepdims=True)).astype(np.float32).T.copy()
        self.speech[0] = 0

    def project(self):
        """The response of each word at each place of each filter, for scoring."""
        if self.trained and not hasattr(self, "parts"):
            self.parts = {k: [np.ascontiguousarray(self.e @ self.w[k][j]) for j in range(k)] for k in WIDTHS}

    def raw(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Logits of texts whose words are ``ids[first[i]:first[i+1]]``."""
        self.project()
        n = len(first) - 1
        pooled = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        size = np.diff(first)
        for m, k in enumerate(WIDTHS):
            full = np.flatnonzero(size >= k)
            if not len(full):
                continue
            r = self.parts[k][0][ids[: len(ids) - k + 1]]
            for j in range(1, k):
                r = r + self.parts[k][j][ids[j : len(ids) - k + 1 + j]]
            edges = np.stack([first[full], first[full + 1] - k + 1], 1).ravel()
            edges = edges[:-1] if edges[-1] >= len(r) else edges
            pooled[full, m * FILTERS : (m + 1) * FILTERS] = np.maximum.reduceat(r, edges, axis=0)[::2] + self.b[k]
        return np.maximum(pooled, 0) @ self.u + self.c

    def guess(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.zeros((len(ids) + 1, len(self.names)))
        np.cumsum(self.speech[ids], axis=0, out=total[1:])
        return (total[first[1:]] - total[first[:-1]]).argmax(1)

    def counts(self, ids: np.ndarray, first: np.ndarray, toxic: np.ndarray):
        """Of texts: guessed language, raw score in whole steps, texts, toxic texts."""
        steps = np.floor(np.clip(self.raw(ids, first), -FARTHEST, FARTHEST) * STEPS).astype(np.int64)
        keys, at = np.unique(np.stack([self.guess(ids, first), steps], 1), axis=0, return_inverse=True)
        return keys[:, 0], keys[:, 1], np.bincount(at.ravel(), minlength=len(keys)), np.bincount(at.ravel(), weights=toxic, minlength=len(keys))

    def calibrate(self, guess, steps, n, t) -> None:
        shared = _best_threshold(steps, n, t, None)
        self.cut = np.full(len(self.names), shared)
        for k in range(len(self.names)):
            own = guess == k
            if t[own].sum() >= LEAST and (n - t)[own].sum() >= LEAST:
                self.cut[k] = _best_threshold(steps[own], n[own], t[own], shared)
        for name in ("first", "second", "squares"):  # training is over
            delattr(self, name)

    def scores(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(first) - 1, self.base)
        ids = self.index(h)
        return _sigmoid(self.raw(ids, first) - self.cut[self.guess(ids, first)] + _logit(THRESHOLD))


def enough(n: int, toxic: int, learn: int, learn_toxic: int) -> bool:
    """Whether texts can be kept apart: both kinds on either side, and fifty in all."""
    return 0 < learn_toxic < learn and 0 < toxic - learn_toxic < n - learn and n >= 50


def counted(hashes: list[np.ndarray], toxic: np.ndarray, language: np.ndarray):
    """Language, word, texts with it, toxic texts with it, occurrences: one entry for
    each word of each language."""
    out = []
    for k in np.unique(language).tolist():
        own = np.flatnonzero(language == k)
        found = [np.unique(hashes[i], return_counts=True) for i in own.tolist()]
        words, at = np.unique(np.concatenate([*(w for w, _ in found), np.zeros(0, np.uint64)]), return_inverse=True)
        sums = (np.bincount(at, weights=x, minlength=len(words)) for x in (None, np.repeat(toxic[own], [len(w) for w, _ in found]), np.concatenate([*(n for _, n in found), np.zeros(0)])))
        out.append((np.full(len(words), k), words, *sums))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, int), np.zeros(0, np.uint64), *np.zeros((3, 0))]


def _best_threshold(steps: np.ndarray, n: np.ndarray, t: np.ndarray, prior) -> float:
    """The cut with the largest F1 over ``n`` texts, ``t`` toxic, in each step of the raw score;
    of equal ones the middle, nearest to ``prior`` if given."""
    s, at = np.unique(-steps, return_inverse=True)
    s, n, t = -s, np.bincount(at, weights=n), np.bincount(at, weights=t)
    f1 = 2 * np.cumsum(t) / (np.cumsum(n) + t.sum())
    k = int(f1.argmax())
    top = s[k] / STEPS
    low = (s[k + 1] + 1) / STEPS if k + 1 < len(s) else top - 1
    return float(top + low) / 2 if prior is None else float(np.clip(prior, low, top))


# ------------------------------------------------------- learning from tables


def _slices(batches, column: str, most: int = 1 << 23):
    """Parts of batches with about ``most`` bytes in ``column`` (one longer row is a part
    of its own): an executor's workers share its memory with its JVM."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy().astype(np.int64))
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
        give_back()


def _arrays(column: pa.Array, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _hash(batches):
    for batch in batches:
        for lo, hi, data, offsets in text_chunks(batch.column("text")):
            words = Words(data, offsets, ALNUM_WORDS)
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(x) for x in ("doc_id", "lang", "toxic", "apart")), pa.array([words.hash[a:b].tobytes() for a, b in zip(words.first[:-1], words.first[1:])], pa.binary())],
                ["doc_id", "lang", "toxic", "apart", "words"],
            )


def _languages(names: list[str], column: pa.Array) -> np.ndarray:
    """Numbers of languages; those without a name of their own are the empty one."""
    number = {x: i for i, x in enumerate(names)}
    return np.array([number.get(x, number[""]) for x in column.to_pylist()], int)


def _count_words(names: list[str]):
    def run(batches):
        for batch in _slices(batches, "words"):
            own, word, n, t, times = counted(_arrays(batch.column("words"), np.uint64), batch.column("toxic").to_numpy(), _languages(names, batch.column("lang")))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(word.view(np.int64)), *(pa.array(x.astype(np.int64)) for x in (n, t, times))], ["lang", "word", "n", "t", "times"])

    return run


def _encode(shared):
    def run(batches):
        for batch in _slices(batches, "words"):
            ids = [shared.value.index(h).astype("<i4").tobytes() for h in _arrays(batch.column("words"), np.uint64)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("shard", "apart", "doc_id", "toxic")), pa.array(ids, pa.binary())], ["shard", "apart", "doc_id", "toxic", "ids"])

    return run


UNIT = "shard int, unit int, apart boolean, texts long, sizes binary, toxic binary, ids binary"


def _unit(key: list, number: int, ids: list[bytes], toxic: list[float]) -> pa.RecordBatch:
    sizes = np.array([len(x) // 4 for x in ids], "<i8")
    values = [[key[0]], [number], [key[1]], [len(ids)], [sizes.tobytes()], [np.array(toxic, "<f8").tobytes()], [pa.compress(b"".join(ids), "zstd", asbytes=True)]]
    kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], [x.split()[0] for x in UNIT.split(", ")])


def _units(batches):
    """Rows that follow each other as units: none has texts of two shards or of both sides."""
    key, number, ids, toxic, size = None, 0, [], [], 0
    for batch in _slices(batches, "ids"):
        for *to, label, words in zip(*(batch.column(x).to_pylist() for x in ("shard", "apart", "toxic", "ids"))):
            if ids and (to != key or len(ids) >= 2 * UNIT_TEXTS or size + len(words) > 8 * UNIT_WORDS):
                yield _unit(key, number, ids, toxic)
                number, ids, toxic, size = number + 1 if to == key else 0, [], [], 0
            key = to
            ids.append(words)
            toxic.append(label)
            size += len(words)
    if ids:
        yield _unit(key, number, ids, toxic)


def _texts(row: dict) -> tuple[list[np.ndarray], np.ndarray]:
    edges = np.cumsum(np.frombuffer(row["sizes"], "<i8"))
    ids = pa.decompress(row["ids"], 4 * int(edges[-1]), "zstd")
    return np.split(np.frombuffer(ids, "<i4"), edges[:-1]), np.frombuffer(row["toxic"], "<f8")


def _rows_of(batches):
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


CHANGES = "slice int, shard int, unit int, texts long, rows binary, change binary"


def _pass(shared, number: int, seed: int):
    """Gradient descent over each unit: what it changes, embeddings (and their sums of squares) by slice."""

    def run(batches):
        for row in _rows_of(batches):
            docs, toxic = _texts(row)
            net, before = shared.value.net(), shared.value
            changed = net.descend(docs, toxic, np.random.default_rng([seed, number, row["shard"], row["unit"]]))
            change = np.concatenate([net.e[changed] - before.e[changed], (net.squares - before.squares)[changed, None]], 1)
            edges = np.searchsorted(changed * SLICES // len(net.e), np.arange(SLICES + 1))
            out = [(-1, b"", (net.dense() - before.dense()).tobytes())]
            out += [(k, changed[a:b].astype("<i4").tobytes(), change[a:b].astype("<f4").tobytes()) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b]
            kept = [pa.array([row[x]] * len(out), k) for x, k in (("shard", pa.int32()), ("unit", pa.int32()), ("texts", pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *kept, pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], [x.split()[0] for x in CHANGES.split(", ")])
            del net, docs
            give_back()

    return run


class _Mean:
    """The weighted mean of changes to one slice of ``size`` embeddings; slice -1 is all else."""

    def __init__(self, key: int, size: int):
        self.key, self.low = key, max(0, -(-key * size // SLICES))
        wide = -(-(key + 1) * size // SLICES) - self.low
        self.sums, self.weight = (0.0, 0.0) if key < 0 else (np.zeros((wide, DIM + 1)), np.zeros(wide))

    def add(self, row: dict) -> None:
        if self.key < 0:
            self.sums, self.weight = self.sums + row["texts"] * np.frombuffer(row["change"], "<f8"), self.weight + row["texts"]
            return
        at = np.frombuffer(row["rows"], "<i4") - self.low
        self.sums[at] += row["texts"] * np.frombuffer(row["change"], "<f4").reshape(-1, DIM + 1).astype(float)
        self.weight[at] += row["texts"]

    def batch(self) -> pa.RecordBatch:
        rows, change = b"", self.sums / self.weight if self.key < 0 else None
        if change is None:
            rows = np.flatnonzero(self.weight)
            change = (self.sums[rows] / self.weight[rows, None]).astype("<f4")
            rows = (rows + self.low).astype("<i4").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([self.key], pa.int32()), pa.array([rows], pa.binary()), pa.array([change.tobytes()], pa.binary())], ["slice", "rows", "change"])


def _means(size: int):
    """The mean of each slice; its changes follow each other."""

    def run(batches):
        mean = None
        for row in _rows_of(batches):
            if mean and mean.key != row["slice"]:
                yield mean.batch()
                mean = None
            mean = mean or _Mean(row["slice"], size)
            mean.add(row)
        if mean:
            yield mean.batch()

    return run


def _count_scores(shared):
    def run(batches):
        for row in _rows_of(batches):
            docs, toxic = _texts(row)
            first = np.concatenate([[0], np.cumsum([len(x) for x in docs])])
            lo = 0
            while lo < len(docs):
                hi = max(lo + 1, int(np.searchsorted(first, first[lo] + PART, "right")) - 1)
                found = shared.value.counts(np.concatenate(docs[lo:hi]), first[lo : hi + 1] - first[lo], toxic[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], ["guess", "steps", "n", "t"])
                lo = hi
            give_back()

    return run


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, seed: int = 7) -> Model:
    """Train on all labelled documents outside the held-out third, with at most ``rows`` embeddings."""
    spark = docs.sparkSession
    before = staged_paths(spark)
    known = clear_columns(labels, "doc_id", "toxic").where("toxic in (0, 1) and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"))
    texts = clear_columns(docs, "doc_id", "text", "lang").where(~held_out()).join(known.hint("merge"), "doc_id")  # labels grow with the corpus: never sent to every executor
    texts = texts.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "toxic", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 4).alias("apart"))
    words = staged(texts.mapInArrow(_hash, "doc_id long, lang string, toxic double, apart boolean, words binary"), "toxicity_words")
    model = _learn(words, rows, seed)
    release(spark, before)
    give_back()
    return model


def _learn(words: DataFrame, rows: int, seed: int) -> Model:
    sc = words.sparkSession.sparkContext
    model, rng = Model(), np.random.default_rng(seed)
    learning = (~F.col("apart")).cast("long")
    total = words.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.sum(learning).alias("learn"), F.sum(F.col("toxic") * learning).alias("learn_toxic"), F.sum(F.octet_length("words") / 8).alias("words")).first()
    if not total.n:
        return model
    model.base = total.toxic / total.n
    model.trained = 0 < total.toxic < total.n
    if not model.trained:
        return model
    apart = enough(total.n, total.toxic, total.learn, total.learn_toxic)
    if not apart:
        words = words.withColumn("apart", F.lit(False))
    aside = words.where("apart") if apart else words
    many = aside.groupBy("lang").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).where((F.col("t") >= LEAST) & (F.col("n") - F.col("t") >= LEAST))
    model.names = sorted({"", *(r.lang for r in many.collect())})

    counts = words.where("not apart").select("lang", "toxic", "words").mapInArrow(_count_words(model.names), "lang int, word long, n long, t long, times long")
    sums = ("n", "t", "times")
    counts = staged(counts.groupBy("word", "lang").agg(*[F.sum(x).alias(x) for x in sums]).groupBy("word").agg(F.sum("n").alias("texts"), F.collect_list(F.struct("lang", "n", "t", "times")).alias("by")), "toxicity_counts")
    twice = counts.where("texts >= 2")
    size = twice.count()
    if size <= rows:
        found = twice.select("word").toArrow().column("word").to_numpy()
        model._rows(np.sort(found.view(np.uint64)), size)
        got = twice.select("word", F.inline("by")).select("word", "lang", *[F.col(x).cast("float") for x in sums]).toArrow()
        row = model.index(got.column("word").to_numpy().view(np.uint64)) - 1
    else:
        model._rows(None, rows)
        got = counts.select(F.pmod("word", F.lit(rows)).alias("row"), F.inline("by")).groupBy(F.col("row").cast("int").alias("row"), "lang").agg(*[F.sum(x).cast("float").alias(x) for x in sums]).toArrow()
        row = got.column("row").to_numpy()
    rate = (total.learn_toxic / total.learn) if apart else model.base
    model._learned(got.column("lang").to_numpy(), row, *(got.column(x).to_numpy().astype(float) for x in sums), rate, rng)
    del got, row

    shards = int(max(-(-total.n // UNIT_TEXTS), -(-total.words // UNIT_WORDS)))
    finder = Model()
    finder._rows(model.words, model.many)
    shared = sc.broadcast(finder)
    dealt = words.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(shards)).cast("int")).select("shard", "apart", "doc_id", "toxic", "words")
    dealt = dealt.mapInArrow(_encode(shared), "shard int, apart boolean, doc_id long, toxic double, ids binary").repartition(shards, "shard").sortWithinPartitions("shard", "apart", "doc_id", "ids")
    units = staged(dealt.mapInArrow(_units, UNIT), "toxicity_units")
    shared.destroy()

    for number in range(EPOCHS):
        shared = sc.broadcast(model.net())
        changes = units.where("not apart").mapInArrow(_pass(shared, number, seed), CHANGES).repartition("slice").sortWithinPartitions("slice", "shard", "unit")
        got = changes.mapInArrow(_means(len(model.e)), "slice int, rows binary, change binary").toArrow()
        shared.destroy()
        for key, at, change in zip(*(got.column(x).to_pylist() for x in ("slice", "rows", "change"))):
            if key < 0:
                model.set_dense(model.dense() + np.frombuffer(change, "<f8"))
            else:
                at, change = np.frombuffer(at, "<i4"), np.frombuffer(change, "<f4").reshape(-1, DIM + 1)
                model.e[at] += change[:, :DIM]
                model.squares[at] += change[:, DIM]

    shared = sc.broadcast(model)
    found = (units.where("apart") if apart else units).mapInArrow(_count_scores(shared), "guess long, steps long, n long, t long").groupBy("guess", "steps").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toArrow()
    shared.destroy()
    model.calibrate(*(found.column(x).to_numpy() for x in ("guess", "steps", "n", "t")))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                words = Words(data, offsets, ALNUM_WORDS)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(shared.value.scores(words.hash, words.first).astype(float))], ["doc_id", "score"])

    return clear_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text scores at least ``threshold``."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(at)):
                words = Words(data, offsets, ALNUM_WORDS)
                keep = shared.value.scores(words.hash, words.first) < threshold
                yield batch.slice(lo, hi - lo).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
