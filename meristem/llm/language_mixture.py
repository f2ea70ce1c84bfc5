"""Language identification by inference of a mixture of languages.

Each language is a smoothed distribution over hashed character n-grams. A document's proportions are
estimated by expectation-maximisation over its n-gram counts; a smaller set of languages is taken as
long as the penalised likelihood (a cost of half the log of the number of n-grams per language) gets
no worse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._session import extended

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
MOST_NUMBERS = 1 << 23  # in the table of probabilities
MOST_LANGUAGES = 1 << 16
_U = np.uint64
_LOWER = np.arange(0x250, dtype=np.uint32)
for _c in range(0x250):
    if len(chr(_c).lower()) == 1:
        _LOWER[_c] = ord(chr(_c).lower())
_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])


def buckets_for(languages: int) -> int:
    """BUCKETS, halved until a table of so many languages has no more than MOST_NUMBERS."""
    n = BUCKETS
    while n * languages > MOST_NUMBERS:
        n //= 2
    return n


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram buckets of a block, the text that each belongs to, and whether each text has a letter.

    Runs of characters other than letters count as one space; an n-gram lies within one text.
    """
    points, at = T.code_points(data, offsets)
    n = len(at) - 1
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, bool)
    owner = np.repeat(np.arange(n), np.diff(at))
    letter = _LETTER[points]
    points = np.where(points < 0x250, _LOWER[np.minimum(points, 0x24F)], points)
    points[~letter] = 32
    keep = letter | np.concatenate(([True], letter[:-1] | (owner[1:] != owner[:-1])))
    points, owner, letter = points[keep].astype(_U), owner[keep], letter[keep]
    has = np.zeros(n, bool)
    has[owner[letter]] = True
    codes, owners = [], []
    for k in ORDERS:
        m = len(points) - k + 1
        if m <= 0:
            continue
        code = np.full(m, _U(k))
        for j in range(k):
            code = code * _U(0x9E3779B97F4A7C15) + points[j : m + j]
        code ^= code >> _U(31)
        code *= _U(0xBF58476D1CE4E5B9)
        inside = owner[:m] == owner[k - 1 :]
        if k == 1:
            inside = inside & letter[:m]
        codes.append((code[inside] >> _U(49)).astype(np.int64))
        owners.append(owner[:m][inside])
    return np.concatenate(codes), np.concatenate(owners), has


def mixture(likelihood: np.ndarray, counts: np.ndarray, rounds: int = 40, penalty: float = 0.5) -> np.ndarray:
    """Proportions of languages (those left out are 0) for one text: likelihood (n-grams, languages), counts of its n-grams."""
    total = counts.sum()
    chosen = np.arange(likelihood.shape[1])
    best = None
    while True:
        own = likelihood[:, chosen]
        share = np.full(len(chosen), 1 / len(chosen))
        for _ in range(rounds):
            joint = own * share
            new = (counts / joint.sum(axis=1)) @ joint / total
            done = np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
        value = counts @ np.log(own @ share) - penalty * len(chosen) * np.log(total)
        if best is not None and value < best[0]:
            break
        best = (value, chosen, share)
        if len(chosen) == 1:
            break
        weak = share < 0.02
        chosen = chosen[~weak] if weak.any() and not weak.all() else np.delete(chosen, share.argmin())
    out = np.zeros(likelihood.shape[1])
    out[best[1]] = best[2]
    return out


def learn(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their n-gram probabilities (buckets, languages), over all texts where train holds and the language is not null.

    Tasks keep one vector of counts per language that they meet; MOST_NUMBERS counts at most reach the
    driver, as the buckets are folded for many languages. More than MOST_LANGUAGES names are no set of
    languages and raise an error.
    """
    rows = docs.where(train & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    langs = sorted(r[0] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not langs:
        return langs, np.full((BUCKETS, 0), 0.5)
    buckets = buckets_for(len(langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            for row, end, data, offsets in T.text_blocks(batch.column(1)):
                code, owner, _ = grams(data, offsets)
                for lang in set(names[row:end]):
                    mine = (names[row:end] == lang)[owner] if len(owner) else np.zeros(0, bool)
                    total[lang] = total.get(lang, 0) + np.bincount(code[mine] % buckets, minlength=buckets)
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))], names=["lang", "bucket", "n"])

    found = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = found.column("lang").combine_chunks().dictionary_encode()
    column = np.array([langs.index(x) for x in names.dictionary.to_pylist()], np.int64)
    table = np.full((buckets, len(langs)), 0.5)
    if found.num_rows:
        table[found.column("bucket").to_numpy(), column[names.indices.to_numpy()]] += found.column("n").to_numpy()
    return langs, table / table.sum(axis=0, keepdims=True)


def identify_languages(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, lang_pred, score, languages) for every row: the main language, its proportion, and the set with proportions.

    A text that is null or has no letter gives 'und' with score 0 and an empty set, as does any text
    where nothing was learned. Of languages with equal proportions the first by name is the main one.
    Repeated rows each get a row, null ids too. Other columns are not read. An empty table gives no
    rows. A text is held whole by its task, at some 100 bytes a byte, however long it is.
    """
    langs, table = learn(docs, train, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(table.astype(np.float32))  # MOST_NUMBERS at most
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    schema = extended(rows.drop("_text").schema, "lang_pred string, score double, languages map<string,double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probability = shared.value
        buckets = len(probability)
        for batch in batches:
            for row, end, data, offsets in T.text_blocks(batch.column(1)):
                code, owner, has = grams(data, offsets)
                order = np.argsort(owner, kind="stable")
                code, bounds = code[order], np.searchsorted(owner[order], np.arange(end - row + 1))
                pred, score, sets = [], [], []
                for i in range(end - row):
                    own = code[bounds[i] : bounds[i + 1]] % buckets
                    if not has[i] or not len(own) or not langs:
                        pred.append("und"), score.append(0.0), sets.append([])
                        continue
                    if len(own) < buckets // 4:
                        own.sort()
                        cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                        bucket, counts = own[cut], np.diff(np.append(cut, len(own)))
                    else:
                        counts = np.bincount(own, minlength=buckets)
                        bucket = np.flatnonzero(counts)
                        counts = counts[bucket]
                    share = mixture(probability[bucket].astype(float), counts.astype(float))
                    top = int(share.argmax())
                    pred.append(langs[top]), score.append(float(min(1.0, share[top])))
                    sets.append([(langs[k], float(share[k])) for k in np.flatnonzero(share > 0)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))],
                    names=[id_col, "lang_pred", "score", "languages"],
                )

    return rows.mapInArrow(run, schema)
