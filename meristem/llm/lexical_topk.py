"""Ranked lexical search: the best documents of every item, by a join that stored thresholds seed.

Postings are written once, a row for each document: its length, its terms that any item has, and how
often it has them. From these each term's number of documents, its largest and its k-th largest impact
are stored. An item's k-th best score is at least the k-th largest contribution of any one of its terms
(that is its threshold), and at most the sum of its terms' largest contributions is what any document
gets. With an item's terms in order of their largest contribution, the suffix sum after a term bounds
what a document can still get from the terms behind it. A posting makes its document a candidate of an
item only if its contribution and the suffix sum after its term reach the threshold: a document's first
term in that order does, or the document can't be among the best. Candidates are scored exactly.

Tasks handle documents in blocks, and raise an item's threshold to the k-th best score that they have
found so far. Items are handled in blocks of a bounded number of terms, each of which is sent to the
postings; there is no shuffle by term, so a term that every document has is no hot key.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._session import cut

ITEM_TERMS = 1 << 19  # entries (item, term) of a block of items
PAIRS = 1 << 21  # (posting, item) pairs that are looked at together, or those of one document
SLICE = 1 << 20  # bytes of a text whose terms are found at a time

#: The bytes of terms in UTF-8, once A-Z are lower-cased: 0-9, a-z and all bytes of other characters than ASCII's.
_TERM, _BETWEEN = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def term_counts(text: str | None) -> tuple[Counter, int]:
    """How often a whole text has each term (in bytes), and how many terms it has; long texts go slice by slice, cut between terms."""
    data = (text or "").encode()
    found: Counter = Counter()
    at = n = 0
    while at < len(data):
        gap = _BETWEEN.search(data, at + SLICE)
        end = gap.start() if gap else len(data)
        terms = _TERM.findall(data[at:end].lower())  # of bytes, lower() changes A-Z only
        n += len(terms)
        found.update(terms)
        at = end
    return found, n


def item_entries(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(row, item_id, term binary, q): a row for each item and term; row tells items apart that share an id."""
    rows = cut(items.select(F.monotonically_increasing_id().alias("row"), F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text")))
    kind = rows.schema["item_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [term_counts(t.as_py())[0] for t in batch.column(2)]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            terms = pa.array([t for f in found for t in f], pa.binary())
            q = pa.array([n for f in found for n in f.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), terms, q], names=["row", "item_id", "term", "q"])

    return cut(rows.mapInArrow(run, f"row long, item_id {kind.simpleString()}, term binary, q long"))


def postings(docs: DataFrame, vocabulary: dict[bytes, int], doc_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, counts) of documents with a term at least, written: n counts all their terms, and the arrays have those of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            keep, sizes, terms, counts, lengths = [], [0], [], [], []
            for i, text in enumerate(batch.column(1)):
                found, n = term_counts(text.as_py())
                if n:
                    known = [(number[t], c) for t, c in found.items() if t in number]
                    terms += [t for t, _ in known]
                    counts += [c for _, c in known]
                    keep.append(i), lengths.append(n), sizes.append(len(terms))
            offsets = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return cut(rows.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>"))


def _flat(batch: pa.RecordBatch, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all postings of a batch: document's place in it, term, and impact."""
    sizes = np.diff(batch.column(2).offsets.to_numpy())
    doc = np.repeat(np.arange(batch.num_rows), sizes)
    m = 100 - 75 + (75 * batch.column(1).to_numpy() * n_docs) // n_terms
    terms, counts = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
    return doc, terms, (1_000_000_000 * counts) // (1000 * counts + 8 * m[doc])


def term_stats(posted: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(term int, df, most, kth): each term's documents, its largest impact, and its k-th largest (0 if it has fewer). Tasks send k impacts a term at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, impact, df = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            _, new_terms, new_impacts = _flat(batch, n_docs, n_terms)
            counts = np.bincount(new_terms)
            df = counts + np.pad(df, (0, len(counts) - len(df))) if len(counts) >= len(df) else df + np.pad(counts, (0, len(df) - len(counts)))
            term, impact = np.concatenate([term, new_terms]), np.concatenate([impact, new_impacts])
            order = np.lexsort((-impact, term))
            best = order[places_in_runs(term[order]) < k]
            term, impact = term[best], impact[best]
        first = places_in_runs(term) == 0
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(impact), pa.array(np.where(first, df[term], 0))], names=["term", "impact", "df"])

    found = posted.where(F.size("terms") > 0).mapInArrow(run, "term int, impact long, df long")
    placed = found.withColumn("_place", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"))))
    kth = F.max(F.when(F.col("_place") == k, F.col("impact")))
    return placed.groupBy("term").agg(F.sum("df").alias("df"), F.max("impact").alias("most"), F.coalesce(kth, F.lit(0)).alias("kth"))


def places_in_runs(x: np.ndarray) -> np.ndarray:
    """Of each element of a sorted array, its place among equal ones."""
    if not len(x):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))


class Plan:
    """A block of items, each with its terms in order of their largest contribution: suffix sums after each term, and the seeded threshold."""

    def __init__(self, item: np.ndarray, term: np.ndarray, q: np.ndarray, weight: np.ndarray, most: np.ndarray, kth: np.ndarray):
        """Entries (item number from 0, term number, q), and by term its weight and its largest and k-th largest impact."""
        factor = q * weight[term]
        upper = factor * most[term]
        order = np.lexsort((term, -upper, item))
        self.item, self.term, self.factor, upper = item[order], term[order], factor[order], upper[order]
        count = int(item.max()) + 1
        self.starts = np.searchsorted(self.item, np.arange(count + 1))
        total = np.concatenate(([0], np.cumsum(upper)))
        self.after = total[self.starts[self.item + 1]] - total[1:]
        self.reach = upper + self.after
        #: A score is above 0, so a threshold is 1 at least.
        self.threshold = np.maximum(1, np.maximum.reduceat(self.factor * kth[self.term], self.starts[:-1]))
        #: The entries by term.
        self.by_term = np.argsort(self.term, kind="stable")
        self.term_starts = np.searchsorted(self.term[self.by_term], np.arange(len(weight) + 1))


def _repeated(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one after another, and which range each is from."""
    counts = ends - starts
    upto = np.cumsum(counts)
    which = np.repeat(np.arange(len(starts)), counts)
    return np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - counts, counts) + starts[which], which


def scored(plan: Plan, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, score) of the candidates among a block's postings whose score reaches the item's threshold."""
    essential = plan.reach >= threshold[plan.item]
    listed = plan.by_term[essential[plan.by_term]]
    starts = np.searchsorted(plan.term[listed], np.arange(len(plan.term_starts)))
    at, which = _repeated(starts[term], starts[term + 1])
    entry = listed[at]
    reached = plan.factor[entry] * impact[which] + plan.after[entry] >= threshold[plan.item[entry]]
    entry, which = entry[reached], which[reached]
    width = len(plan.starts)
    pair = np.unique(doc[which] * width + plan.item[entry])
    d, i = pair // width, pair % width
    score = np.zeros(len(pair), np.int64)
    if len(pair):
        # exact scores: every posting of the candidate's document among the item's terms
        order = np.lexsort((term, doc))
        key, value = doc[order] * len(plan.term_starts) + term[order], impact[order]
        for a, b in slices(plan.starts[i + 1] - plan.starts[i], PAIRS):
            at, which = _repeated(plan.starts[i[a:b]], plan.starts[i[a:b] + 1])
            wanted = d[a:b][which] * len(plan.term_starts) + plan.term[at]
            place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            gained = np.where(key[place] == wanted, value[place] * plan.factor[at], 0)
            score[a:b] = np.add.reduceat(gained, np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1]))))
    good = score >= threshold[i]
    return i[good], d[good], score[good]


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of elements whose sizes come to most together, or of one."""
    upto = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        yield at, end
        at = end


def best_of(item: np.ndarray, doc: np.ndarray, null: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each item's k best (score, then smaller id, a null id last)."""
    order = np.lexsort((doc, null, -score, item))
    return order[places_in_runs(item[order]) < k]


def _search(posted: DataFrame, plan: Plan, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item int, doc_id, score): k documents at most of each item from each task."""
    shared = posted.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        threshold = plan.threshold.copy()
        item, doc, null, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        for batch in batches:
            ids = batch.column(0)
            missing, known = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            flat = _flat(batch, n_docs, n_terms)
            upto = np.searchsorted(flat[0], np.arange(batch.num_rows + 1))
            total = np.concatenate(([0], np.cumsum(np.diff(plan.term_starts)[flat[1]])))[upto]
            for a, b in slices(np.diff(total), PAIRS):
                i, d, s = scored(plan, *(x[upto[a] : upto[b]] for x in flat), threshold)
                item, doc, null, score = (np.concatenate(x) for x in ((item, i), (doc, known[d]), (null, missing[d]), (score, s)))
                best = best_of(item, doc, null, score, k)
                item, doc, null, score = item[best], doc[best], null[best], score[best]
                full = places_in_runs(item) == k - 1
                threshold[item[full]] = np.maximum(threshold[item[full]], score[full])
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, mask=null), pa.array(score)], names=["item", "doc_id", "score"])

    return posted.where(F.size("terms") > 0).mapInArrow(run, "item int, doc_id long, score long")


def lexical_topk(docs: DataFrame, items: DataFrame, k: int = 10, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0 (all, if fewer), equal scores by smaller doc_id, null ids last.

    Terms, weights and scores are those of the contract of op12. Whole texts are read, long ones in
    slices. A document without a term, as a null or empty text, counts for nothing; an item without one
    has no rows. Rows that repeat a doc_id are documents of their own. Rows that repeat an item_id, or
    have none, are items of their own, each with its rows. Empty tables give no rows. Other columns are
    not read. Items are taken in blocks of about ITEM_TERMS terms, each of which costs a pass over the texts.
    """
    spark = docs.sparkSession
    entries = item_entries(items, item_col, text_col)
    blocks = max(1, -(-entries.count() // ITEM_TERMS))
    of_block = F.pmod(F.xxhash64("row", F.lit(5)), F.lit(blocks))
    ids = entries.select("row", "item_id").distinct()
    found = None
    for b in range(blocks):
        block = entries.where(of_block == b).select("row", "term", "q").toArrow()  # about ITEM_TERMS rows
        if not block.num_rows:
            continue
        row, item = np.unique(block.column("row").to_numpy(), return_inverse=True)
        names = block.column("term").combine_chunks().dictionary_encode()
        posted = postings(docs, {t: i for i, t in enumerate(names.dictionary.to_pylist())}, doc_col, text_col)
        whole = posted.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not whole["docs"]:
            break
        size = len(names.dictionary)
        df, most, kth = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        stats = term_stats(posted, whole["docs"], whole["terms"], k).toArrow()  # a row for each term of the block
        at = stats.column("term").to_numpy()
        df[at], most[at], kth[at] = (stats.column(c).to_numpy() for c in ("df", "most", "kth"))
        weight = np.array([math.floor(1000 * math.log((2 * whole["docs"] + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        plan = Plan(item, names.indices.to_numpy().astype(np.int64), block.column("q").to_numpy(), weight, most, kth)
        rows = spark.createDataFrame([(i, int(r)) for i, r in enumerate(row.tolist())], "item int, row long")
        hits = _search(posted, plan, whole["docs"], whole["terms"], k)
        ordered = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = hits.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k).join(F.broadcast(rows), "item").select("row", "rank", "doc_id", "score")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return ids.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return found.join(ids, "row").select("item_id", F.col("rank").cast("int"), "doc_id", "score")
