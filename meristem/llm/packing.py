"""Vector best-fit packing of documents into sequences.

A sequence is a bin with three capacities: tokens, documents, and attention cost (the sum of squared
piece lengths, which is what block-diagonal attention computes). Pieces go by decreasing length into
the open bin that fits under every constraint and has the smallest weighted norm of what is left
("norm"), or the largest weighted dot product of demand and what is left ("dot").

Pieces are dealt by their row numbers into groups of about GROUP pieces, whatever their ids; each is packed by one task and leaves a
few partly filled sequences, a share that shrinks with the group's size and not with the table's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import cut, extended
from .tokens import text_ids

GROUP = 1 << 15


@dataclass(frozen=True)
class Capacity:
    """Limits of a sequence, and the weights of its three residuals in the choice of a bin.

    With the defaults only the tokens can run out: pieces have a token at least, and their squares' sum
    is at most their sum's square. All three residuals weigh in the choice.
    """

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    choice: str = "norm"


def pieces(docs: DataFrame, path: str, capacity: Capacity = Capacity(), end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Only documents over the token capacity are cut; the first piece takes the remainder."""
    most = capacity.tokens
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(text_ids(path, text.as_py()), np.array([end_id], "<u4")).astype("<u4")
                start, piece = 0, 0
                while start < len(ids):
                    length = min(most, len(ids)) if piece else (len(ids) - 1) % most + 1
                    for column, value in zip(out, (doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        column.append(value)
                    start, piece = start + length, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. A piece that no empty bin could take (over a capacity) gets a bin of its own."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    pick = _by_norm if capacity.choice == "norm" else _by_dot
    for i, (b, at) in zip(order, pick(lengths[order].tolist(), capacity), strict=True):
        bins[i], offsets[i] = b, at
    return bins, offsets


def _by_norm(lengths: list[int], capacity: Capacity) -> Iterator[tuple[int, int]]:
    """Open bins lie in buckets by residual tokens. Buckets are searched from the tightest up, until the token term alone exceeds the best norm."""
    cap_t, cap_d, cap_a = capacity.tokens, capacity.documents, capacity.attention
    w_t, w_d, w_a = capacity.weights
    buckets: list[list[int]] = [[] for _ in range(cap_t + 1)]
    filled = 0  # bit r: bucket r has bins
    docs, attention = [], []  # residuals by bin
    for n in lengths:
        cost, best, best_norm = n * n, -1, float("inf")
        left = filled >> n if n <= cap_t else 0
        r = n
        while left:
            r += (skip := (left & -left).bit_length() - 1)
            left >>= skip
            base = w_t * ((r - n) / cap_t) ** 2
            if base >= best_norm:
                break
            for b in buckets[r]:
                if docs[b] >= 1 and attention[b] >= cost:
                    norm = base + w_d * ((docs[b] - 1) / cap_d) ** 2 + w_a * ((attention[b] - cost) / cap_a) ** 2
                    if norm < best_norm:
                        best, best_norm, best_r = b, norm, r
            left >>= 1
            r += 1
        if best < 0:
            best, best_r = len(docs), max(cap_t, n)
            docs.append(cap_d)
            attention.append(max(cap_a, cost))
        else:
            buckets[best_r].remove(best)
            if not buckets[best_r]:
                filled &= ~(1 << best_r)
        yield best, max(cap_t, n) - best_r if best_r > cap_t else cap_t - best_r
        docs[best] -= 1
        attention[best] -= cost
        if (rest := best_r - n) > 0 and docs[best] > 0 and attention[best] > 0:
            buckets[rest].append(best)
            filled |= 1 << rest


def _by_dot(lengths: list[int], capacity: Capacity) -> Iterator[tuple[int, int]]:
    caps = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    weights = np.array(capacity.weights)
    room = np.zeros((1024, 3))
    count = 0
    for n in lengths:
        need = np.array([n, 1, n * n], float)
        open_ = room[:count]
        fits = np.flatnonzero((open_ >= need).all(axis=1))
        if len(fits):
            b = int(fits[np.argmax((open_[fits] / caps) @ (weights * need / caps))])
        else:
            if count == len(room):
                room = np.concatenate([room, np.zeros_like(room)])
            b, count = count, count + 1
            room[b] = np.maximum(caps, need)
        yield b, int(max(capacity.tokens, n) - room[b, 0]) if room[b, 0] > capacity.tokens else int(capacity.tokens - room[b, 0])
        room[b] -= need


def pack(parts: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """Adds sequence_id long and offset long to pieces (doc_id, piece, length and any other columns).

    Repeated rows are separate pieces, and null or equal ids are packed like any others: pieces are dealt
    by the number of their row in the written table. Of equal lengths the smaller id and piece goes first.
    Sequence ids are unique, with gaps. An empty table stays empty. Pieces are numbers only, so a very
    long text is as many rows as it has pieces.
    """
    parts = cut(parts)
    groups = max(1, -(-parts.count() // GROUP))
    schema = extended(parts.schema, "sequence_id long, offset long")
    group = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
    names = schema.names

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece"], kind="stable", ignore_index=True)
        bins, offsets = best_fit(rows["length"].to_numpy(np.int64), capacity)
        return rows.assign(sequence_id=bins * groups + int(key[0]), offset=offsets)[names]

    name = "_group" + "_" * max(map(len, parts.columns))  # longer than any column's
    return parts.withColumn(name, group).groupBy(name).applyInPandas(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: Capacity = Capacity()) -> DataFrame:
    """Cuts and packs whole documents (doc_id, text); a null or empty text is its end token alone. Other columns are not read.

    Repeated rows are documents of their own, and so are those with equal or null ids. A very long text is
    encoded whole by its task and cut into pieces. An empty table gives no rows.
    """
    return pack(pieces(docs, path, capacity), capacity)
