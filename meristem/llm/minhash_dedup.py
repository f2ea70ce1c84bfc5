"""Near-duplicate groups by b-bit MinHash: bands for candidates, bit counts for estimates, full sets to confirm.

1. One pass over the texts gives each document its distinct word shingles' count, a 128-bit digest of
   the set, the low bits of its minima packed into one binary value, and a key for each band.
2. Documents with one and the same set form a class by a partial aggregate; only the class's smallest
   id goes on, so exact copies never meet in a task.
3. Classes that share a band key are candidates. In a bucket the collision-corrected similarity is
   estimated from bit counts, and each class is linked to the first class that it is likely to be
   similar to. In buckets over BUCKET rows, which no task should hold, each class is linked to the
   smallest one.
4. These links, a few for each class however many copies there are, are confirmed on full sets: a
   class's text goes to the groups of its links, of GROUP members at most, and their components found.
5. What is left are likely pairs between different components of one bucket. Where there are any, all
   of a cluster's members meet those that are not in its largest component, in blocks of those, so the
   texts' copies follow the number of strays and not that of the copies. Both kinds of confirmed links
   give the components.

With 32 bands of 4 minima a pair at similarity 0.8 shares no band with probability 5e-8, and the
estimate is cut 5 standard deviations below the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._session import cut
from ..operators.components import connected_components

BANDS, ROWS, BITS = 32, 4, 4
BUCKET, GROUP, BLOCK = 1024, 256, 256
BROADCAST_ROWS = 500_000  # places of candidates; more meet their texts by a shuffle
_U = np.uint64


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = T.mix(np.arange(1, n + 1, dtype=_U)) | _U(1)
    return (a >> _U(32)).astype(np.uint32) | np.uint32(1), T.mix(a).astype(np.uint32)


_A, _B = _coefficients(BANDS * ROWS)


def minima(distinct: np.ndarray) -> np.ndarray:
    """The BANDS * ROWS minima of a set of 64-bit shingle hashes, in slices of bounded size."""
    x = (distinct ^ (distinct >> _U(32))).astype(np.uint32)
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(low, (_A[:, None] * x[None, i : i + 4096] + _B[:, None]).min(axis=1), out=low)
    return low


def pack_bits(low: np.ndarray) -> np.ndarray:
    """The BITS low bits of each (mixed) minimum, 64 / BITS of them in a word."""
    nibbles = (T.mix(low.astype(_U)) & _U((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(nibbles << (np.arange(64 // BITS, dtype=_U) * _U(BITS)), axis=1)


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(BANDS, ROWS).astype(_U)
    key = T.mix(np.arange(BANDS, dtype=_U) + _U(977))
    for j in range(ROWS):
        key = T.mix(key + rows[:, j])
    return key.view(np.int64)


_PLACES = _U(sum(1 << (i * BITS) for i in range(64 // BITS)))


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (rows of words), corrected for chance collisions of BITS bits."""
    d = x ^ y
    d = d | (d >> _U(1))
    d = d | (d >> _U(2))
    missed = np.bitwise_count(d & _PLACES).sum(axis=-1, dtype=np.int64)
    chance = 2.0**-BITS
    return (1 - missed / (BANDS * ROWS) - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    """Five standard deviations below the threshold."""
    chance = 2.0**-BITS
    p = threshold + (1 - threshold) * chance
    return threshold - 5 * math.sqrt(p * (1 - p) / (BANDS * ROWS)) / (1 - chance)


def _signatures(shingle: int):
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in T.text_blocks(batch.column(1)):
                words, first = T.word_hashes(data, offsets)
                counts, digests, sigs, keys = [], [], [], []
                for i in range(end - row):
                    distinct = np.unique(T.shingle_hashes(words[first[i] : first[i + 1]], shingle))
                    counts.append(len(distinct))
                    if not len(distinct):
                        digests.append((0, 0)), sigs.append(None), keys.append(None)
                        continue
                    low = minima(distinct)
                    digests.append((int(T.mix(distinct).sum().view(np.int64)), int(T.mix(distinct ^ _U(0x5851F42D4C957F2D)).sum().view(np.int64))))
                    sigs.append(pack_bits(low).tobytes())
                    keys.append(np.unique(band_keys(low)))
                a, b = np.array(digests, np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), pa.array(counts, pa.int64()), pa.array(a), pa.array(b), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=schema
                )

    return run


def sorted_runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Tables cut only between runs of equal values in the first n_keys columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []

    def keys(b: pa.RecordBatch) -> np.ndarray:
        return np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)], axis=1)

    for batch in batches:
        if not batch.num_rows:
            continue
        k = keys(batch)
        change = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if held and (keys(held[-1].slice(held[-1].num_rows - 1))[0] != k[0]).any():
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if len(change):
            held.append(batch.slice(0, int(change[-1])))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = [batch.slice(int(change[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def run_starts(batch: pa.RecordBatch, n_keys: int) -> np.ndarray:
    k = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)], axis=1)
    return np.concatenate(([0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, [len(k)]))


def spread(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes can reach over the edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _words_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), _U).reshape(len(column), -1)


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _alike(sig: np.ndarray) -> np.ndarray:
    """Estimates of all pairs within each of m buckets of n signatures (m, n, words), in slices of bounded size."""
    m, n, _ = sig.shape
    step = max(1, (1 << 16) // (m * n))
    return np.concatenate([estimate(sig[:, k : k + step, None], sig[:, None]) for k in range(0, n, step)], axis=1)


def first_likely(near: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """For each of a bucket's n classes the first before it that it is surely near to, else the first that it is near to, else itself; near and sure (m, n, n) hold below the diagonal."""
    own = np.arange(near.shape[-1])
    return np.where(sure.any(axis=-1), sure.argmax(axis=-1), np.where(near.any(axis=-1), near.argmax(axis=-1), own))


def _candidate_edges(least: float, threshold: float, labelled: bool):
    """Rows (key, id, sig) sorted by key to a link of each class with its first likely partner in the bucket.

    With labels, rows (key, id, sig, label): a star over each cluster of likely pairs of different labels,
    less the links that the rows without labels have given.
    """

    def links(ids: np.ndarray, sig: np.ndarray, label: np.ndarray | None, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        own = at[:, None] + np.arange(n)
        own = np.take_along_axis(own, np.argsort(ids[own], axis=1, kind="stable"), axis=1)
        alike = _alike(sig[own])
        below = np.tri(n, k=-1, dtype=bool)
        near = (alike >= least) & below
        to = first_likely(near, near & (alike >= threshold))
        if label is None:
            k, i = np.nonzero(to != np.arange(n))
            return own[k, to[k, i]], own[k, i]
        np.put_along_axis(near, to[..., None], False, axis=2)
        k, x, y = np.nonzero(near & (label[own][:, :, None] != label[own][:, None]))
        nodes, inverse = np.unique(np.concatenate([own[k, x], own[k, y]]), return_inverse=True)
        root = nodes[spread(len(nodes), inverse[: len(k)], inverse[len(k) :])]
        return root[root != nodes], nodes[root != nodes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sorted_runs(batches, 1):
            starts = run_starts(batch, 1)
            ids, sig = batch.column(1).to_numpy(), _words_of(batch.column(2))
            label = batch.column(3).to_numpy() if labelled else None
            size = np.diff(starts)
            for n in np.unique(size[size > 1]):
                at = starts[:-1][size == n]
                step = max(1, (1 << 16) // int(n * n))
                for k in range(0, len(at), step):
                    a, b = links(ids, sig, label, at[k : k + step], int(n))
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], schema=_EDGES)

    return run


def _set_of(column: pa.Array, i: int, shingle: int) -> np.ndarray:
    data, offsets = T.text_buffers(column.slice(i, 1))
    words, _ = T.word_hashes(data[offsets[0] : offsets[1]], offsets - offsets[0])
    return np.unique(T.shingle_hashes(words, shingle))


def _confirmed_links(shingle: int, percent: int):
    """Rows (hub, part, id, text) sorted by the first two, the hub itself among them, to its links that hold on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sorted_runs(batches, 2):
            starts = run_starts(batch, 2)
            hub, ids = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            out_a, out_b = [], []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                centre = np.flatnonzero(ids[s:e] == hub[s])
                if not len(centre):
                    continue
                base = _set_of(batch.column(3), int(s + centre[0]), shingle)
                for i in range(s, e):
                    if ids[i] != hub[s]:
                        other = _set_of(batch.column(3), i, shingle)
                        both = len(np.intersect1d(base, other, assume_unique=True))
                        if both and 100 * both >= percent * (len(base) + len(other) - both):
                            out_a.append(hub[s]), out_b.append(ids[i])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], schema=_EDGES)

    return run


def shared_sizes(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left] with sets[right] (all pairs), in slices of the vocabulary."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate(([True], values[1:] != values[:-1]))
    column = np.cumsum(new) - 1
    several = np.bincount(column)[column] > 1  # what one set alone has meets nothing
    column, owner = column[several], owner[several]
    total = np.zeros((len(left), len(right)), np.int64)
    if not len(column):
        return total
    column = np.cumsum(np.concatenate(([True], column[1:] != column[:-1]))) - 1
    row_l, row_r = np.full(len(sets), -1), np.full(len(sets), -1)
    row_l[left], row_r[right] = np.arange(len(left)), np.arange(len(right))
    width = 4096
    for c in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(column, [c, c + width])
        m, n = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        o, k = owner[a:b], column[a:b] - c
        keep = row_l[o] >= 0
        m[row_l[o][keep], k[keep]] = 1
        keep = row_r[o] >= 0
        n[row_r[o][keep], k[keep]] = 1
        total += (m @ n.T).astype(np.int64)
    return total


def _confirmed_strays(shingle: int, percent: int, least: float):
    """Rows (cluster, part, block, id, label, sig, text) sorted by the first two, to links that hold on full sets between those whose block is part and all others of another label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sorted_runs(batches, 2):
            starts = run_starts(batch, 2)
            part, block, ids, label = (batch.column(i).to_numpy() for i in (1, 2, 3, 4))
            sig = _words_of(batch.column(5))
            out_a, out_b = [], []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                left = np.arange(s, e)[block[s:e] == part[s]]
                for r in range(s, e, 4 * BLOCK):
                    right = np.arange(r, min(e, r + 4 * BLOCK))
                    likely = np.stack([estimate(sig[i][None], sig[right]) >= least for i in left]) if len(left) else np.zeros((0, len(right)), bool)
                    likely &= label[left][:, None] != label[right][None]
                    some, others, likely = left[likely.any(1)], right[likely.any(0)], likely[likely.any(1)][:, likely.any(0)]
                    if not len(some):
                        continue
                    nodes, inverse = np.unique(np.concatenate([some, others]), return_inverse=True)
                    sets = [_set_of(batch.column(6), int(i), shingle) for i in nodes]
                    size = np.array([len(x) for x in sets], np.int64)
                    li, ri = inverse[: len(some)], inverse[len(some) :]
                    both = shared_sizes(sets, li, ri)
                    linked = likely & (100 * both >= percent * (size[li][:, None] + size[ri][None, :] - both)) & (both > 0)
                    x, y = np.nonzero(linked)
                    root = spread(len(nodes), li[x], ri[y])
                    out_a.append(ids[nodes[root[root != np.arange(len(nodes))]]]), out_b.append(ids[nodes[root != np.arange(len(nodes))]])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], schema=_EDGES)

    return run


def _with_texts(source: DataFrame, places: DataFrame) -> DataFrame:
    """places(id, ...) and each one's text; few places go to the texts, more meet them by a shuffle."""
    few = places.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return source.join(F.broadcast(places) if few else places, "id")


def _in_buckets(rows: DataFrame, run) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _stray_links(source: DataFrame, met: DataFrame, sigs: DataFrame, found: DataFrame, shingle: int, percent: int, least: float) -> DataFrame | None:
    """Confirmed links between different components of what met in a bucket; None if there are no likely ones."""
    labelled = met.join(found.withColumnRenamed("component", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    open_ = labelled.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("key")
    live = cut(labelled.join(open_, "key", "left_semi"))
    rest = _in_buckets(live.where(F.col("n") <= BUCKET).join(sigs, "id").select("key", "id", "sig", "label"), _candidate_edges(least, percent / 100, True))
    hot = live.where(F.col("n") > BUCKET).select(F.col("to").alias("a"), F.col("id").alias("b"))
    rest = cut(rest.unionByName(hot))
    if rest.isEmpty():
        return None
    clusters = connected_components(rest).select(F.col("component").alias("cluster"), "id")
    clusters = cut(clusters.join(found.withColumnRenamed("component", "label"), "id", "left").withColumn("label", F.coalesce("label", "id")))
    sizes = clusters.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("cluster").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.sum("n").alias("n"), F.max("n").alias("n_main"))
    dealt = (
        clusters.join(largest, "cluster")
        .where("n > n_main")
        .withColumn("blocks", F.ceil((F.col("n") - F.col("n_main")) / BLOCK))
        .withColumn("block", F.when(F.col("label") == F.col("main"), F.lit(None)).otherwise(F.expr("pmod(xxhash64(id), blocks)")))
        .select("cluster", F.explode(F.expr("sequence(0L, coalesce(block, blocks - 1))")).alias("part"), F.coalesce("block", F.lit(-1).cast("long")).alias("block"), "id", "label")
    )
    rows = _with_texts(source, cut(dealt)).join(sigs, "id").select("cluster", "part", "block", "id", "label", "sig", "text")
    return cut(rows.repartition("cluster", "part").sortWithinPartitions("cluster", "part").mapInArrow(_confirmed_strays(shingle, percent, least), "a long, b long"))


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row.

    Two documents are linked if 100 * shared >= percent * union of their distinct shingles of
    lower-cased (A-Z) words. A text without words (null, empty) has no shingle and no link; a null id
    is linked with nothing, has a null component and is kept; rows that repeat an id are one document
    for linking and each gets a row, so such rows also join what each of their texts is linked with. Of
    a group the smallest id is the component, so there are no ties. A text is held whole by its task,
    however long, as one shingle set. Other columns are not read, whatever their names. An empty table
    gives no rows.
    """
    least = least_estimate(percent / 100)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(source.mapInArrow(_signatures(shingle), "id long, n_shingles long, set_a long, set_b long, sig binary, keys array<long>"))
    full = signed.where("id is not null and n_shingles > 0")
    classes = cut(full.groupBy("set_a", "set_b").agg(F.min("id").alias("id")))
    chosen = cut(full.join(classes, ["set_a", "set_b", "id"], "left_semi").select("id", "sig", "keys"))

    keyed = chosen.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("to")).where("n > 1")
    met = cut(keyed.join(shared, "key").select("key", "id", "n", "to"))
    sigs = chosen.select("id", "sig")
    likely = _in_buckets(met.where(F.col("n") <= BUCKET).join(sigs, "id").select("key", "id", "sig"), _candidate_edges(least, percent / 100, False))
    edges = cut(likely.unionByName(met.where((F.col("n") > BUCKET) & (F.col("id") != F.col("to"))).select(F.col("to").alias("a"), F.col("id").alias("b"))).distinct())

    # each hub's members in parts of GROUP at most, and the hub in every part
    parts = edges.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    members = edges.join(parts, "a").select(F.col("a").alias("hub"), F.expr("pmod(xxhash64(b), parts)").alias("part"), F.col("b").alias("id"))
    hubs = parts.select(F.col("a").alias("hub"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.col("a").alias("id"))
    groups = _with_texts(source, cut(members.unionByName(hubs))).select("hub", "part", "id", "text")
    links = cut(groups.repartition("hub", "part").sortWithinPartitions("hub", "part").mapInArrow(_confirmed_links(shingle, percent), "a long, b long"))
    found = connected_components(links)

    strays = _stray_links(source, met, sigs, found, shingle, percent, least)
    if strays is not None:
        found = connected_components(links.unionByName(strays))

    reach = classes.join(found, "id", "left").select("set_a", "set_b", F.coalesce("component", "id").alias("component"))
    return (
        signed.select("id", "n_shingles", "set_a", "set_b")
        .join(reach, ["set_a", "set_b"], "left")
        .select(
            F.col("id").alias(id_col),
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"),
        )
        .withColumn("component_id", F.when(F.col(id_col).isNotNull(), F.col("component_id")))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )
