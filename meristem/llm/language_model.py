"""Language-model scores from an Elias-Fano n-gram trie.

Words are 64-bit hashes, and their ids the places of these among all. A level of the trie has the words
of its n-grams, those with one context together and in order: an Elias-Fano sequence of word ids on
which each context's range starts from where the range before has ended, so that it rises throughout,
and a second one of pointers to where the ranges start. An n-gram is looked up by its context's node:
two pointers give the range, and the successor of the word id is searched in it alone. Beside them lie
the discounted probabilities and the weights that contexts leave to shorter ones, as 16-bit quantised
logarithms. Tasks map the levels from the shared folder into memory.

The trie is cut into shards by the first word's hash. A word with more than a shard's share of all
tokens has shards of its own, by the second word, so that no shard grows with one word. There are
about twice as many as the input has partitions.

The first level has every word with its count, so the add-one base is exact. Longer n-grams are kept
from a number of occurrences on (least; 1 keeps all, as op7 does), counted over all training texts; since
a frequent n-gram's parts are frequent too, each pass counts only n-grams whose parts were kept, and
loses none. Probabilities are interpolated with absolute discounting, and what a context's kept
successors leave goes to the shorter context, so each context's probabilities sum to 1.
"""

from __future__ import annotations

import collections
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._session import extended, shared_dir
from .elias_fano import EliasFano, is_mapped, map_arrays, write_arrays

ORDER, LEAST, DISCOUNT = 3, 2, 0.75
MOST_SHARD_BITS = 24  # of what the driver holds a few numbers for each
HELD_BYTES, HELD_LEVELS = 256 << 20, 1 << 14  # of shards that a worker has read into memory, and shards that it has mapped
HELD_KEYS = 4_000_000  # that a task holds before it passes them on
STEPS = 4096  # quantisation steps per unit of log10
BLOCK = 2 << 20
_U = np.uint64
END = T.mix(np.array([0x454E44], _U))[0]


def pack_keys(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising keys and their counts as compressed byte planes of the differences."""
    delta = np.diff(keys, prepend=_U(0)).astype("<u8")
    planes = np.concatenate([delta.view(np.uint8).reshape(-1, 8).T.ravel(), counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel()])
    return len(keys).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack_keys(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], decompressed_size=12 * n, codec="zstd", asbytes=True), np.uint8)
    delta = np.ascontiguousarray(planes[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(delta, dtype=_U), np.ascontiguousarray(planes[8 * n :].reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def sum_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[new], np.add.reduceat(counts, new)


_POWERS = 10.0 ** (-np.arange(65536) / STEPS)


def quantise(p: np.ndarray) -> np.ndarray:
    """log10 of probabilities in 65536 steps, down to 1e-16."""
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-16)) * STEPS), 0, 65535).astype(np.uint16)


@dataclass(frozen=True)
class Shape:
    """What tasks need to find their way: folder, shard bits, sums over the training texts, and where shards start.

    first: the first word id of each of level 1's shards; nodes: by level (from 2), the first node of each
    shard; hot: ids of the words with shards of their own, their first such shard, number of shards,
    count, and the weight that they leave to the shorter context.
    """

    folder: str
    bits: int
    first: np.ndarray
    tokens: int
    hot: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    nodes: tuple[np.ndarray, ...] = ()
    least: int = LEAST

    @property
    def words(self) -> int:
        return int(self.first[-1])

    @property
    def levels(self) -> int:
        return len(self.nodes) + 1

    @property
    def shards(self) -> int:
        """Of levels from 2 on."""
        return (1 << self.bits) + int(self.hot[2].sum())

    def contexts(self, level: int) -> np.ndarray:
        """The first context of each shard of a level. Level 2's are the words, and after them one for each shard of a hot word."""
        if level == 2:
            return np.concatenate([self.first, self.words + 1 + np.arange(self.shards - (1 << self.bits))])
        return self.nodes[level - 3]

    def is_hot(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which word ids are hot, and their places in hot."""
        at = np.searchsorted(self.hot[0], ids)
        at = np.minimum(at, max(0, len(self.hot[0]) - 1))
        return (self.hot[0][at] == ids if len(self.hot[0]) else np.zeros(len(ids), bool)), at

    def bigram_contexts(self, ids: np.ndarray, following: np.ndarray) -> np.ndarray:
        hot, at = self.is_hot(ids)
        out = ids.copy()
        out[hot] = self.words + self.hot[1][at[hot]] - (1 << self.bits) + np.maximum(following[hot], 0) % self.hot[2][at[hot]]
        return out


_levels: collections.OrderedDict = collections.OrderedDict()  # by (folder, level, shard): the arrays, and the bytes that they take in memory


def _level(folder: str, level: int, shard: int) -> dict:
    """A shard's arrays. Those used last are kept: of mapped ones HELD_LEVELS, of those that had to be read HELD_BYTES."""
    key = folder, level, shard
    if key in _levels:
        _levels.move_to_end(key)
        return _levels[key][0]
    arrays = map_arrays(folder, f"level{level}-{shard:05d}")
    size = 0 if is_mapped(arrays) else sum(a.nbytes for a in arrays.values())
    arrays |= {"ids": EliasFano.of(arrays)} if level == 1 else {"pointers": EliasFano.of(arrays, "pointer_"), "words": EliasFano.of(arrays, "word_")}
    _levels[key] = arrays, size
    held = sum(s for _, s in _levels.values()) if size else 0
    while len(_levels) > 1 and (held > HELD_BYTES or len(_levels) > HELD_LEVELS):
        held -= _levels.popitem(last=False)[1][1]
    return arrays


def _ids(shape: Shape, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Global ids (-1: not in training) and counts of rising hashes, over the shards they fall in."""
    ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
    cuts = np.searchsorted(hashes, np.arange(1, 1 << shape.bits, dtype=_U) << _U(64 - shape.bits))
    bounds = np.concatenate(([0], cuts, [len(hashes)]))
    for s in np.flatnonzero((bounds[1:] > bounds[:-1]) & (shape.first[1:] > shape.first[:-1])).tolist():
        a, b = bounds[s], bounds[s + 1]
        level = _level(shape.folder, 1, s)
        at = level["ids"].find((hashes[a:b] << _U(shape.bits)) >> _U(shape.bits))
        hit = at >= 0
        ids[a:b][hit] = at[hit] + shape.first[s]
        counts[a:b][hit] = _count_at(level, at[hit])
    return ids, counts


def _counts(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes; those over 254 in a short list by index."""
    big = np.flatnonzero(counts >= 255)
    return {"count": np.minimum(counts, 255).astype(np.uint8), "big_at": big, "big_count": counts[big]}


def _count_at(arrays: dict, at: np.ndarray) -> np.ndarray:
    c = arrays["count"][at].astype(np.int64)
    big = np.flatnonzero(c == 255)
    c[big] = arrays["big_count"][np.searchsorted(arrays["big_at"], at[big])]
    return c


def _successors(level: dict, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words after rising contexts of one shard (-1: not kept), each searched in its context's range alone; and what the contexts leave to shorter ones."""
    new = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    of = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(context))))
    own = context[new]
    ends = level["pointers"].access(np.concatenate([own, own + 1])).astype(np.int64)
    start, end = ends[: len(own)], ends[len(own) :]
    base = np.zeros(len(own), _U)
    base[start > 0] = level["words"].access(start[start > 0] - 1)
    return level["words"].find(base[of] + word.astype(_U) + _U(1), start[of], end[of]), _POWERS[level["rest"][own]][of]


def _sorted_grams(context: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of n-grams by context and word (from 0 to words), and where in it each distinct one starts. Both go into one 64-bit key if they fit."""
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if (int(context.max()) + 1) * (words + 1) < 1 << 64:
        keys = context.astype(_U) * _U(words + 1) + word.astype(_U)
        order = np.argsort(keys)
        keys = keys[order]
        return order, np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    order = np.lexsort((word, context))
    c, w = context[order], word[order]
    return order, np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (w[1:] != w[:-1]))))


def _lookup(shape: Shape, level: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of a level (-1: not kept), discounted probabilities (0) and contexts' weights (1) by context and word; a word of -1 is unknown. Each distinct n-gram is searched once, in order."""
    word = np.where(word < 0, shape.words, word)
    order, new = _sorted_grams(context, word, shape.words)
    size = np.diff(np.append(new, len(order)))
    context, word = context[order[new]], word[order[new]]
    node, share, rest = np.full(len(new), -1, np.int64), np.zeros(len(new)), np.ones(len(new))
    first, nodes = shape.contexts(level), shape.nodes[level - 2]
    bounds = np.searchsorted(context, first)
    for s in np.flatnonzero((bounds[1:] > bounds[:-1]) & (nodes[1:] > nodes[:-1])):
        a, b = bounds[s], bounds[s + 1]
        arrays = _level(shape.folder, level, int(s))
        at, rest[a:b] = _successors(arrays, context[a:b] - first[s], word[a:b])
        hit = np.flatnonzero(at >= 0)
        node[a + hit], share[a + hit] = at[hit] + nodes[s], _POWERS[arrays["share"][at[hit]]]
    back = np.empty(len(order), np.int64)
    back[order] = np.repeat(np.arange(len(new)), size)
    return node[back], share[back], rest[back]


@dataclass
class Tokens:
    """A block's token sequence, each text as an end (context only), its words and an end; by token: text, id, count."""

    owner: np.ndarray
    lead: np.ndarray
    ids: np.ndarray
    counts: np.ndarray


def _sequence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, first = T.word_hashes(data, offsets)
    n = len(offsets) - 1
    size = np.diff(first) + 2
    start = np.concatenate(([0], np.cumsum(size)))
    owner = np.repeat(np.arange(n), size)
    hashes = np.full(start[-1], END, _U)
    lead = np.zeros(start[-1], bool)
    lead[start[:-1]] = True
    inner = np.ones(start[-1], bool)
    inner[start[:-1]] = False
    inner[start[1:] - 1] = False
    hashes[inner] = words
    return hashes, owner, lead


def _tokens(shape: Shape, data: np.ndarray, offsets: np.ndarray) -> Tokens:
    hashes, owner, lead = _sequence(data, offsets)
    unique, inverse = np.unique(hashes, return_inverse=True)
    ids, counts = _ids(shape, unique)
    return Tokens(owner, lead, ids[inverse], counts[inverse])


def _climb(shape: Shape, t: Tokens, top: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token the node of the n-gram of order top that ends there (-1 where it was not kept), and its probability by levels up to top: each level's discounted one, and what its context leaves to the shorter one's."""
    node, p = t.ids, _base(shape, t.counts)
    for level in range(2, top + 1):
        context = np.concatenate(([-1], node[:-1]))
        i = np.flatnonzero((context >= 0) & _within(t, level))
        node = np.full(len(t.ids), -1, np.int64)
        if len(i):
            before = context[i]
            node[i], share, rest = _lookup(shape, level, shape.bigram_contexts(before, t.ids[i]) if level == 2 else before, t.ids[i])
            if level == 2:
                hot, at = shape.is_hot(before)
                rest[hot] = shape.hot[4][at[hot]]
            p[i] = share + rest * p[i]
    return node, p


def _grams(shape: Shape, t: Tokens, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and words of the n-grams of a level whose parts were all kept."""
    if level == 2:
        frequent = t.counts >= shape.least
        i = np.flatnonzero(frequent & np.concatenate(([False], frequent[:-1])) & _within(t, level))
        return shape.bigram_contexts(t.ids[i - 1], t.ids[i]), t.ids[i]
    node, _ = _climb(shape, t, level - 1)
    i = np.flatnonzero((node >= 0) & np.concatenate(([False], node[:-1] >= 0)) & _within(t, level))
    return node[i - 1], t.ids[i]


def _within(t: Tokens, level: int) -> np.ndarray:
    """Tokens with level - 1 others of their text before them."""
    lead = t.lead.copy()
    for k in range(1, level - 1):
        lead[k:] |= t.lead[:-k]
    return ~lead


def _training(docs: DataFrame, train: Column) -> DataFrame:
    return docs.where(train).select(F.col("text").cast("string").alias("text"))


def _counted(texts: DataFrame, bits: int, level: int, shape: Shape | None) -> DataFrame:
    """(shard, blob) of the n-grams that end in each text, counted by task."""
    shards = shape.shards if shape else 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            shard, keys = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            counts = np.concatenate([h[2] for h in held])
            order = np.argsort(shard, kind="stable")
            shard, keys, counts = shard[order], keys[order], counts[order]
            bounds = np.searchsorted(shard, np.arange(shards + 1))
            some = np.flatnonzero(bounds[1:] > bounds[:-1])
            blobs = [pack_keys(*sum_counts(keys[bounds[s] : bounds[s + 1]], counts[bounds[s] : bounds[s + 1]])) for s in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "blob"])

        for batch in batches:
            for _, _, data, offsets in T.text_blocks(batch.column(0), BLOCK):
                if level == 1:
                    hashes, _, lead = _sequence(data, offsets)
                    keys, counts = np.unique(hashes[~lead], return_counts=True)
                    shard = (keys >> _U(64 - bits)).astype(np.int64)
                    keys = (keys << _U(bits)) >> _U(bits)
                else:
                    t = _tokens(shape, data, offsets)
                    context, word = _grams(shape, t, level)
                    first = shape.contexts(level)
                    shard = np.searchsorted(first, context, side="right") - 1
                    keys, counts = (context - first[shard]).astype(_U) * _U(shape.words) + word.astype(_U), np.ones(len(word), np.int64)
                held.append((shard, keys, counts))
                size += len(keys)
                if size >= HELD_KEYS:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return texts.mapInArrow(run, "shard int, blob binary")


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.zeros(0, _U), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for blob in table.column("blob"):
        held.append(unpack_keys(blob.as_py()))
        if sum(len(k) for k, _ in held) > 2 * len(keys) + 1_000_000:
            keys, counts = sum_counts(np.concatenate([keys, *[k for k, _ in held]]), np.concatenate([counts, *[c for _, c in held]]))
            held = []
    return sum_counts(np.concatenate([keys, *[k for k, _ in held]]), np.concatenate([counts, *[c for _, c in held]]))


def _write_level(folder: str, bits: int, level: int, shape: Shape | None):
    """Writes a shard's level from its blobs; (shard, its n-grams, its tokens, the share that its last context's successors take)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        keys, counts = _merged(table)
        tokens, taken = int(counts.sum()), np.zeros(1)
        if level == 1:
            arrays = EliasFano.build(keys, 1 << (64 - bits)).arrays() | _counts(counts)
        else:
            often = counts >= shape.least
            keys, counts = keys[often], counts[often]
            parent, word = (keys // _U(shape.words)).astype(np.int64), keys % _U(shape.words)
            first = shape.contexts(level)
            parents = int(first[shard + 1] - first[shard])
            share = (counts - DISCOUNT) / _context_counts(shape, level, shard, parent)
            taken = np.bincount(parent, share, parents)
            size = np.bincount(parent, minlength=parents)
            upto = np.concatenate(([0], np.cumsum(size)))
            last = np.zeros(parents, _U)
            last[size > 0] = word[upto[1:][size > 0] - 1] + _U(1)
            base = np.cumsum(last) - last
            total = int(last.sum())
            arrays = EliasFano.build(upto, len(keys) + 1).arrays("pointer_") | EliasFano.build(base[parent] + word + _U(1), total + 1).arrays("word_")
            arrays |= {"share": quantise(share), "rest": quantise(1 - taken)}
            if level < ORDER:
                arrays |= _counts(counts)
        write_arrays(folder, f"level{level}-{shard:05d}", arrays)
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "tokens": pa.array([tokens], pa.int64()), "taken": pa.array([float(taken[-1])])})

    return run


def _context_counts(shape: Shape, level: int, shard: int, parent: np.ndarray) -> np.ndarray:
    if level == 2 and shard >= 1 << shape.bits:
        return shape.hot[3][np.searchsorted(shape.hot[1], shard, side="right") - 1]
    return _count_at(_level(shape.folder, level - 1, shard), parent)


def _base(shape: Shape, counts: np.ndarray) -> np.ndarray:
    return (counts + 1) / (shape.tokens + shape.words + 1)


def _starts(sizes: dict[int, int], shards: int) -> np.ndarray:
    return np.concatenate(([0], np.cumsum([sizes.get(s, 0) for s in range(shards)]))).astype(np.int64)


def _hot_words(shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words with more than a shard's share of the tokens: at most as many as there are shards, with twice as many shards of their own at most."""
    share = max(1, shape.tokens >> shape.bits)
    ids, counts = [], []
    for s in range(1 << shape.bits):
        if shape.first[s] < shape.first[s + 1]:
            level = _level(shape.folder, 1, s)
            over = level["big_count"] > share
            ids.append(level["big_at"][over] + shape.first[s]), counts.append(level["big_count"][over])
    ids, counts = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (ids, counts))
    shards = -(-counts // share)
    return ids, (1 << shape.bits) + np.cumsum(shards) - shards, shards, counts, np.ones(len(ids))


def train_model(docs: DataFrame, train: Column, least: int = LEAST) -> Shape:
    """Builds the trie over docs(text) where train holds; null texts are empty. Only sums by shard and the hot words reach the driver."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = folder.replace("file:", "", 1)
    texts = _training(docs, train)
    bits = min(MOST_SHARD_BITS, max(2, 1 + math.ceil(math.log2(max(1, texts.rdd.getNumPartitions())))))
    shape = None
    for level in range(1, ORDER + 1):
        built = _counted(texts, bits, level, shape).groupBy("shard").applyInArrow(_write_level(folder, bits, level, shape), "shard int, n long, tokens long, taken double")
        found = {r["shard"]: r for r in built.collect()}  # one row for each shard
        sizes = {s: r["n"] for s, r in found.items()}
        if level == 1:
            none = tuple(np.zeros(0, np.int64) for _ in range(5))
            shape = Shape(folder, bits, _starts(sizes, 1 << bits), sum(r["tokens"] for r in found.values()), none, (), least)
            shape = replace(shape, hot=_hot_words(shape))
        else:
            if level == 2:
                ids, shard, n, counts, _ = shape.hot
                rest = np.array([1 - sum(found[s]["taken"] for s in range(a, a + k) if s in found) for a, k in zip(shard.tolist(), n.tolist(), strict=True)])
                shape = replace(shape, hot=(ids, shard, n, counts, rest))
            shape = replace(shape, nodes=(*shape.nodes, _starts(sizes, shape.shards)))
    return shape


def score_tokens(shape: Shape, t: Tokens) -> np.ndarray:
    """log10 probability of each token given those before it in its text."""
    return np.log10(np.maximum(_climb(shape, t, shape.levels)[1], 1e-300))


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score) for every row.

    A null or empty text is its end alone. Repeated rows each get a row and count each in training.
    Bigrams and trigrams seen fewer than least times in training are dropped; 1 keeps all.
    Null ids are kept as they are; whether such a row trains is for train to say (a null condition: no).
    A worker holds HELD_BYTES of shards at most where they can't be mapped; mapped ones take the node's
    page cache, as much of the model as there is room for.
    Without training texts every token is unknown and both scores are 0. Other columns are not read. An
    empty table gives no rows. A text is held whole by its task, at some 200 bytes a byte, however long.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    shape = train_model(docs.select(F.col(id_col), F.col(text_col).alias("text")), train, least)
    schema = extended(rows.drop("text").schema, "n_tokens long, n_known long, train_tokens long, base_score double, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in T.text_blocks(batch.column(1), BLOCK):
                t = _tokens(shape, data, offsets)
                p, base, n = score_tokens(shape, t), np.log10(_base(shape, t.counts)), end - row
                real = ~t.lead
                owner = t.owner[real]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, n),
                        pa.array(np.bincount(owner, minlength=n)),
                        pa.array(np.bincount(owner[t.counts[real] > 0], minlength=n)),
                        pa.array(np.full(n, shape.tokens, np.int64)),
                        pa.array(np.bincount(owner, base[real], n)),
                        pa.array(np.bincount(owner, p[real], n)),
                    ],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)
