"""Language identification: a linear-chain conditional random field over words.

Every word of a text gets a language. A word's features are its prefixes and
suffixes, its byte n-grams, itself, and the lexicons (words that the training
sample shows in one language nearly always); transitions between the languages of
neighbouring words are learned with the feature weights by gradient ascent on the
log-likelihood, expectations coming from forward-backward. Training sequences are
stretches of labelled texts, half of them joined from two texts, so that changes
of language within a text are seen as well.

Labelling runs forward-backward over each whole text, exactly: texts are cut into
blocks of ``BLOCK`` words, the transfer matrices of all blocks are multiplied side
by side, the messages pass from block to block, and the blocks are then finished
side by side. The language of a text is the one with the largest mean posterior,
words weighing as much as they have bytes; that mean is its score.

The sample is the only thing that is bounded: ``most`` labelled documents of at
most ``longest`` bytes, picked by a hash of id and text. Labelling takes every whole text and shuffles nothing.

Cases: null texts and texts without letters are ``und`` with score 0, as is every
text if there is no label to learn from; with one language all others get it with
score 1; null labels are not learned; repeated rows are labelled each on their
own; an empty table gives no row; other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesmith.llm.common import Words, bounded_sample, byte_set, bytes_hash, clear_columns, held_out, mix64, ragged_arange, text_chunks

SAMPLE, LONGEST = 3000, 1 << 16
BUCKETS = 1 << 17
AFFIX, GRAMS = 4, (2, 3)
STRETCH, MOST_STRETCHES = 40, 12_000
ROUNDS = 25
BLOCK = 32
UNKNOWN = "und"
#: Bytes of words: ASCII letters and all of other characters.
LETTERS = byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def features(words: Words, pick: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the picked words, one after the other, and where each word's begin."""
    starts, ends = words.starts[pick], words.ends[pick]
    size, n = ends - starts, len(pick)
    kinds: list[tuple[np.ndarray, np.ndarray]] = [(np.arange(n), words.hash[pick])]  # (word, hash)

    def add(kind: int, owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        kinds.append((owner, bytes_hash(words.data, a, b) ^ mix64(np.array([kind], np.uint64))))

    for k in range(1, AFFIX + 1):
        long = np.flatnonzero(size > k)
        add(k, long, starts[long], starts[long] + k)
        add(k + 100, long, ends[long] - k, ends[long])
    for k in GRAMS:
        many = np.maximum(size - k + 1, 0)
        owner, at = np.repeat(np.arange(n), many), np.repeat(starts, many) + ragged_arange(many)
        add(k + 200, owner, at, at + k)
    known, language = lexicon
    if len(known):
        at = np.minimum(np.searchsorted(known, words.hash[pick]), len(known) - 1)
        found = np.flatnonzero(known[at] == words.hash[pick])
        kinds.append((found, mix64(language[at[found]].astype(np.uint64) + np.uint64(1000))))
    owner = np.concatenate([k[0] for k in kinds])
    order = np.argsort(owner, kind="stable")
    ids = (np.concatenate([k[1] for k in kinds])[order] % np.uint64(BUCKETS)).astype(np.int64)
    return ids, np.searchsorted(owner[order], np.arange(n + 1))


def posteriors(emission: np.ndarray, first: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Forward-backward: for each word the distribution of its language. The words
    of text ``i`` are ``first[i]:first[i+1]``; both arguments hold logarithms."""
    n, width = emission.shape
    if not n:
        return emission
    e = np.exp(emission - emission.max(1, keepdims=True)) + 1e-30
    t = np.exp(transition - transition.max())
    size = np.diff(first)
    blocks = -(-size // BLOCK)
    total = int(blocks.sum())
    text, rank = np.repeat(np.arange(len(size)), blocks), ragged_arange(blocks)
    at = first[text] + rank * BLOCK
    length = np.minimum(BLOCK, first[text + 1] - at)
    place = np.minimum(at[:, None] + np.arange(BLOCK), n - 1)
    real = np.arange(BLOCK) < length[:, None]
    x = np.where(real[:, :, None], e[place], 1.0)

    transfer = np.broadcast_to(np.eye(width), (total, width, width)).copy()
    for j in range(BLOCK):
        step = (transfer @ t) * x[:, j, None, :]
        step /= step.sum((1, 2), keepdims=True)
        transfer = np.where(real[:, j, None, None], step, transfer)
    # messages: ``into`` holds those that reach a block's first transition, ``back`` what lies behind its end
    into, back = np.empty((total, width)), np.ones((total, width))
    start = np.cumsum(blocks) - blocks
    by_size = np.argsort(-blocks, kind="stable")
    longest = blocks[by_size]
    into[start[blocks > 0]] = 1 / width
    for k in range(1, int(blocks.max())):
        live = start[by_size[: np.searchsorted(-longest, -k)]] + k
        m = np.einsum("na,nab->nb", into[live - 1], transfer[live - 1])
        into[live] = m / m.sum(1, keepdims=True)
    for k in range(int(blocks.max()) - 2, -1, -1):
        live = start[by_size[: np.searchsorted(-longest, -(k + 1))]] + k
        m = np.einsum("nab,nb->na", transfer[live + 1], back[live + 1])
        back[live] = m / m.sum(1, keepdims=True)

    ahead = np.empty((total, BLOCK, width))
    a = into
    for j in range(BLOCK):
        a = (a @ t) * x[:, j]
        a /= a.sum(1, keepdims=True)
        ahead[:, j] = a
    b = back
    for j in reversed(range(BLOCK)):
        ahead[:, j] *= b
        b = np.where(real[:, j, None], (x[:, j] * b) @ t.T, b)
        b = b / b.sum(1, keepdims=True)
    out = ahead[real]
    return out / out.sum(1, keepdims=True)


def expectations(emission: np.ndarray, first: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For short sequences: what :func:`posteriors` gives, and the expected number of
    each transition, from the exact distributions of neighbours (the first word of a
    sequence follows a silent state that is equally likely to be any language)."""
    size, width = np.diff(first), emission.shape[1]
    longest = int(size.max(initial=0))
    real = np.arange(longest) < size[:, None]
    place = np.minimum(first[:-1, None] + np.arange(longest), len(emission) - 1)
    x = np.where(real[:, :, None], np.exp(emission - emission.max(1, keepdims=True))[place] + 1e-30, 1.0)
    t = np.exp(transition - transition.max())
    ahead, a = np.empty((longest + 1, len(size), width)), np.full((len(size), width), 1 / width)
    ahead[0] = a
    for j in range(longest):
        a = (a @ t) * x[:, j]
        a /= a.sum(1, keepdims=True)
        ahead[j + 1] = a
    pairs, p, b = np.zeros((width, width)), np.empty((longest, len(size), width)), np.ones((len(size), width))
    for j in reversed(range(longest)):
        p[j] = ahead[j + 1] * b
        both = ahead[j][:, :, None] * t * (x[:, j] * b)[:, None, :]
        both /= both.sum((1, 2), keepdims=True)
        pairs += both[real[:, j]].sum(0)
        b = np.where(real[:, j, None], (x[:, j] * b) @ t.T, b)
        b /= b.sum(1, keepdims=True)
    p = p.transpose(1, 0, 2)[real]
    return p / p.sum(1, keepdims=True), pairs


class Tagger:
    """The trained field: weights by hashed feature and language, and transitions."""

    def __init__(self, texts: list[str], languages: list[str], seed: int = 11):
        self.names = sorted(set(languages))
        self.lexicon = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        if len(self.names) < 2:
            return
        rng = np.random.default_rng(seed)
        label = np.array([self.names.index(x) for x in languages])
        chunks = [(lo, Words(d, o, LETTERS)) for lo, _, d, o in text_chunks(pa.array(texts, pa.string()))]
        hashes = np.concatenate([w.hash for _, w in chunks])
        owner = np.concatenate([w.owner() + lo for lo, w in chunks])
        types, where, kind = np.unique(hashes, return_index=True, return_inverse=True)
        self._lexicon(types, kind, owner, label)
        ids, begin = self._type_features(chunks, where)
        self._train(ids, begin, kind, *self._sequences(owner, label, rng))

    def _lexicon(self, types, kind, owner, label):
        """Words in at least three texts, nine tenths of them of one language."""
        pairs = np.unique(kind.astype(np.int64) * len(label) + owner)
        count = np.zeros((len(types), len(self.names)))
        np.add.at(count, (pairs // len(label), label[pairs % len(label)]), 1)
        n = count.sum(1)
        keep = (n >= 3) & (count.max(1) >= 0.9 * n)
        self.lexicon = (types[keep], count[keep].argmax(1))

    def _type_features(self, chunks, where):
        parts, begin, base, total = [], [np.zeros(1, np.int64)], 0, 0
        order = np.argsort(where, kind="stable")
        edges = np.cumsum([0, *[len(w.hash) for _, w in chunks]])
        for (_, w), lo, hi in zip(chunks, edges[:-1], edges[1:]):
            mine = where[order][(where[order] >= lo) & (where[order] < hi)] - lo
            ids, first = features(w, mine, self.lexicon)
            parts.append(ids)
            begin.append(first[1:] + total)
            total += len(ids)
        ids, begin = np.concatenate(parts), np.concatenate(begin)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))  # features stand in the order of first sight; types are sorted by hash
        size = np.diff(begin)[rank]
        return ids[np.repeat(begin[rank], size) + ragged_arange(size)], np.concatenate([[0], np.cumsum(size)])

    def _sequences(self, owner, label, rng):
        """Stretches of words (padded with -1) with the languages of their words."""
        first = np.searchsorted(owner, np.arange(len(label) + 1))
        blocks = -(-np.diff(first) // STRETCH)
        text, rank = np.repeat(np.arange(len(label)), blocks), ragged_arange(blocks)
        if len(text) > MOST_STRETCHES:
            pick = np.sort(rng.choice(len(text), MOST_STRETCHES, replace=False))
            text, rank = text[pick], rank[pick]
        at = first[text] + rank * STRETCH
        place = at[:, None] + np.arange(STRETCH)
        place = np.where(place < first[text + 1][:, None], place, -1)
        gold = np.where(place >= 0, label[text][:, None], -1)
        mixed = rng.permutation(len(text))[: len(text) // 2]  # their second halves change places
        half, other = STRETCH // 2, np.roll(mixed, 1)
        for grid in (place, gold):
            grid[mixed, half:] = grid[other, half:].copy()
        return place, gold

    def _train(self, ids, begin, kind, place, gold):
        width = len(self.names)
        self.w, self.t = np.zeros((BUCKETS, width), np.float32), np.zeros((width, width))
        flat, labels = place[place >= 0], gold[gold >= 0]
        first = np.concatenate([[0], np.cumsum((place >= 0).sum(1))])
        words, inverse = np.unique(kind[flat], return_inverse=True)
        size = np.diff(begin)[words]
        feats = ids[np.repeat(begin[words], size) + ragged_arange(size)]
        edge = np.concatenate([[0], np.cumsum(size)])[:-1]
        feature_word = np.repeat(np.arange(len(words)), size)
        first = np.unique(first)  # without empty stretches
        opens = np.zeros(len(flat), bool)
        opens[first[:-1]] = True
        later = np.flatnonzero(~opens)
        seen, starts = np.zeros((width, width)), np.bincount(labels[opens], minlength=width)
        np.add.at(seen, (labels[later - 1], labels[later]), 1)
        squares, t_squares = np.full((BUCKETS, width), 1e-6, np.float32), np.full((width, width), 1e-6)
        scale = 1 / max(1, len(flat))
        for _ in range(ROUNDS):
            score = np.add.reduceat(self.w[feats], edge, axis=0)
            emission = score[inverse].astype(float)
            p, pairs = expectations(emission, first, self.t)
            g = -p
            g[np.arange(len(flat)), labels] += 1
            by_word = np.stack([np.bincount(inverse, g[:, k], len(words)) for k in range(width)], 1)
            grad = np.stack([np.bincount(feats, by_word[feature_word, k], BUCKETS) for k in range(width)], 1) * scale - 1e-7 * self.w
            squares += grad * grad
            self.w += (0.15 * grad / np.sqrt(squares)).astype(np.float32)
            silent = np.exp(self.t) / np.exp(self.t).sum(0) * starts  # what precedes the first words, given their languages
            t_grad = (seen + silent - pairs) * scale
            t_squares += t_grad * t_grad
            self.t += 0.3 * t_grad / np.sqrt(t_squares)

    def emissions(self, words: Words) -> np.ndarray:
        _, where, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        ids, begin = features(words, where, self.lexicon)
        return np.add.reduceat(self.w[ids], begin[:-1], axis=0)[inverse].astype(float) if len(where) else np.zeros((0, len(self.names)))

    def tag(self, words: Words) -> np.ndarray:
        """The posterior of each word's language."""
        if len(self.names) < 2:
            return np.ones((len(words.hash), max(1, len(self.names))))
        return posteriors(self.emissions(words), words.first, self.t)

    def judge(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Language number (-1: none) and score of each text."""
        p = self.tag(words)
        weight = (words.ends - words.starts).astype(float)
        total = np.zeros((len(p) + 1, p.shape[1] + 1))
        np.cumsum(np.concatenate([p * weight[:, None], weight[:, None]], 1), axis=0, out=total[1:])
        mean = total[words.first[1:]] - total[words.first[:-1]]
        empty = (mean[:, -1] == 0) | (not self.names)
        share = mean[:, :-1] / np.maximum(mean[:, -1:], 1)
        return np.where(empty, -1, share.argmax(1)), np.where(empty, 0.0, np.clip(share.max(1), 0, 1))


def fit(docs: DataFrame, most: int = SAMPLE, longest: int = LONGEST) -> Tagger:
    """Train on at most ``most`` documents of at most ``longest`` bytes outside the held-out third that have a language."""
    known = clear_columns(docs, "doc_id", "text", "lang").where(~held_out()).where("lang is not null and text is not null")
    got = bounded_sample(known, most, longest).orderBy("doc_id", "text", "lang").toArrow()
    return Tagger(got.column("text").to_pylist(), got.column("lang").to_pylist())


def label(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, lang_pred, score: every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches):
        names = np.array([*shared.value.names, UNKNOWN], object)
        for batch in batches:
            texts = batch.column(1)
            for lo, hi, data, offsets in text_chunks(texts):
                pick, score = shared.value.judge(Words(data, offsets, LETTERS))
                for i in np.flatnonzero(np.diff(offsets) > 0).tolist():
                    # bytes from 0x80 may belong to other signs than letters
                    part = data[offsets[i] : offsets[i + 1]]
                    if pick[i] >= 0 and not ((part | 32) - 97 < 26).any() and not any(map(str.isalpha, part.tobytes().decode())):
                        pick[i], score[i] = -1, 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names[pick], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return clear_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
