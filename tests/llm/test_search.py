"""Hard negatives, lexical search and BPE encoding against brute-force versions, and their edge cases."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from meristem.llm import bpe_prefixes as B
from meristem.llm import hard_negatives as H
from meristem.llm import lexical_topk as L
from meristem.llm import queries as Q
from meristem.llm.tokens import vocabulary_path

SF = "/root/testdata/sf0.001"
PATH = vocabulary_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return B.Encoder(B.vocabulary(PATH))


# --- hard negatives


def plain_negatives(rows, positives=5, negatives=10, scale=256):
    """rows: (vec_id, label, vector, is anchor)."""
    valid = [(i, y, [math.floor(scale * float(x)) for x in v], a) for i, y, v, a in rows if None not in (i, y, v) and v and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, y, v, a in valid:
        if a and (i not in anchors or (str(y), v) < anchors[i]):
            anchors[i] = (str(y), v)
    out = []
    for anchor, (name, q) in anchors.items():
        others = [(sum(x * z for x, z in zip(q, v, strict=True)), i, str(y)) for i, y, v, _ in valid if i != anchor and len(v) == len(q)]
        near = sorted((-s, i) for s, i, y in others if y == name)[:positives]
        for p, positive in near:
            fits = sorted((-s, i) for s, i, y in others if y != name and 30 * -p <= 100 * s <= 90 * -p)[:negatives]
            out += [(anchor, positive, k, i, -p, -s) for k, (s, i) in enumerate(fits, 1)]
    return sorted(out)


def found_negatives(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def test_hard_negatives_with_ties_repeats_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "ANCHORS", 7)
    monkeypatch.setattr(H, "ROWS", 32)
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.integers(-3, 4, 6) / 2], i % 10 == 0) for i in range(150)]
    rows += [(20, 1, rows[20][2], True), (31, 2, rows[31][2], False), (None, 1, [1.0] * 6, True), (501, None, [1.0] * 6, False), (502, 1, None, True), (503, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0], False)]
    rows += [(504, 1, [math.nan] + [0.0] * 5, False), (505, 1, [math.inf] + [0.0] * 5, False), (510, 0, [1.0, 2.0], True), (511, 0, [1.0, 1.0], False), (512, 1, [1.0, 0.5], False), (520, 1, [], True), (530, 7, [0.5] * 6, True)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, ask boolean, v string, score int").repartition(3)
    got = H.hard_negatives(df, F.col("ask"), F.col("label"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert found_negatives(got) == plain_negatives(rows)
    assert len(plain_negatives(rows)) > 200


def test_hard_negatives_of_nothing_and_of_very_large_components(spark):
    ddl = "vec_id long, label string, embedding array<double>"
    assert H.hard_negatives(spark.createDataFrame([], ddl), F.lit(True), F.col("label")).count() == 0
    rng = np.random.default_rng(4)
    rows = [(i, "ab"[i % 2], [float(x) for x in rng.integers(-2000000, 2000000, 8)], True) for i in range(40)]
    df = spark.createDataFrame([r[:3] for r in rows], ddl)
    assert found_negatives(H.hard_negatives(df, F.lit(True), F.col("label"))) == plain_negatives(rows)


def test_intervals_always_hold_the_product_and_drop_pairs_before_the_last_plane():
    rng = np.random.default_rng(5)
    rows, anchors = rng.integers(-40, 41, (200, 16)), rng.integers(-40, 41, (30, 16))
    rows[:, 0] = 300
    exact, progress = rows @ anchors.T, H.Progress()
    seen = []

    def drop(r, a, low, high):
        seen.append(int((high - low).max()))
        assert (low <= exact[r, a]).all() and (exact[r, a] <= high).all()
        return high < 4000

    r, a, score = H.products(rows, anchors, np.ones(exact.shape, bool), drop, progress)
    assert (score == exact[r, a]).all() and seen == sorted(seen, reverse=True) and seen[-1] == 0
    kept = set(zip(r.tolist(), a.tolist(), strict=True))
    assert kept == set(zip(*(x.tolist() for x in np.nonzero(exact >= 4000)), strict=True))
    assert progress.pairs == exact.size and progress.alive[-3] < exact.size / 2


# --- lexical search


def plain_search(docs, items, k=10):
    def terms(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)

    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        q = Counter(terms(text))
        scores = []
        for i, c in counted:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, n in q.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=str)


def found_search(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def odd_texts():
    rng = np.random.default_rng(6)
    words = ["der", "Der", "um", "é", "ÉTÉ", "日本", "a1", "x_y", "1.5", "rare", "the", "THE", "of", "\U0001f600"]
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(0, 12))))) for i in range(300)]
    docs += [(None, "rare words"), (None, None), (7, docs[7][1]), (301, ""), (302, " .,\n\x00"), (303, "the " * 5000), (304, "A" * 300), (305, "rare\x00rare-rare")]
    items = [(1, "The rare DER words"), (1, "of of of"), (2, None), (None, "日本 é é"), (3, "nothing that isthere"), (4, ""), (5, " ".join(words) * 3), (6, "the")]
    return docs, items


@pytest.mark.parametrize("block", [1 << 19, 6])
def test_lexical_search_on_odd_texts(spark, monkeypatch, block):
    monkeypatch.setattr(L, "ITEM_TERMS", block)
    monkeypatch.setattr(L, "PAIRS", 50 if block == 6 else 1 << 21)
    monkeypatch.setattr(L, "SLICE", 64 if block == 6 else 1 << 20)
    docs, items = odd_texts()
    d = spark.createDataFrame([(*r, "t", 1) for r in docs], "doc_id long, text string, term string, row int").repartition(3)
    i = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, score int")
    got = L.lexical_topk(d, i)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert found_search(got) == plain_search(docs, items)


def test_lexical_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    items = spark.createDataFrame([("a", "one")], "item_id string, text string")
    assert L.lexical_topk(docs.limit(0), items).count() == 0
    assert L.lexical_topk(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in L.lexical_topk(docs, items).collect()] == plain_search([(1, "one two")], [("a", "one")])


def test_stored_thresholds_are_safe_and_prune():
    """The seeded threshold is at most the k-th best score, and leaves out postings without losing any of the best."""
    rng = np.random.default_rng(7)
    doc, term = np.nonzero(rng.random((400, 12)) < np.linspace(0.9, 0.05, 12))
    impact = rng.integers(1, 900, len(doc))
    weight = np.array([1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 400, 900])
    most, kth = np.zeros(12, np.int64), np.zeros(12, np.int64)
    for t in range(12):
        best = np.sort(impact[term == t])[::-1]
        most[t], kth[t] = best[0], best[9] if len(best) >= 10 else 0
    plan = L.Plan(np.repeat(np.arange(2), 12), np.tile(np.arange(12), 2), np.repeat([1, 3], 12), weight, most, kth)
    dense = np.zeros((400, 12), np.int64)
    dense[doc, term] = impact
    for i, q in enumerate((1, 3)):
        exact = q * dense @ weight
        assert 1 < plan.threshold[i] <= np.sort(exact)[-10]
    found = L.scored(plan, doc, term, impact, plan.threshold)
    exact = dense @ weight
    assert sorted(found[2][found[0] == 0].tolist())[-10:] == np.sort(exact)[-10:].tolist()
    assert (plan.reach < plan.threshold[plan.item]).any() and (found[0] == 0).sum() < 400


# --- BPE


def test_every_document_is_encoded_as_the_library_does(spark, library):
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = Q.op13_bpe(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(rows[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


ODD = [
    "Hello  wörld's ΟΔΟΣ ΑΣ. <|endoftext|>don't İ 12 ½² ﬁ é é", "<|startoftext|><|endoftext|>x", "<|ENDOFTEXT|> <|endof text|>", "'sample!'s o'clock 'LL", "a" * 3000 + "!" * 700, "日本語" * 400,
    "x" * 513 + "Y" * 512, "Ᲊ Ɤ ՠ հայ", "̀a <|endoftext|>́b", " \n\t", "\x1c a\x1db \x00", "é Ẹ́ Å", "한국어 각 ", "  x　y\x85z", "🙂🙃👩‍👩‍👧 ❤️", "𝔘𝔫𝔦 ⅷ ①", "Σ ΣΣ́ aΣ",
]


def test_odd_texts_are_encoded_as_the_library_does(encoder, library):
    want = [library.encode(t, add_special_tokens=False).ids for t in ODD]
    assert [x.tolist() for x in encoder.encode_block(ODD)] == want
    assert [x.tolist() for x in encoder.encode_block([None, "", *ODD])] == [[], [], *want]


def test_settled_characters_are_treated_alike(encoder, library):
    """Every code point that doesn't go through the library: normalised, split and encoded as it does."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and B._OTHER.search(chr(c)) is None]
    assert len(points) > 30000
    texts = ["".join(points[k : k + 500]) for k in range(0, len(points), 500)] + [" ".join("a" + c + "1" for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    want = library.encode_batch(texts, add_special_tokens=False)
    assert all(a.tolist() == b.ids for a, b in zip(encoder.encode_block(texts), want, strict=True))


def test_each_prefix_has_one_last_token(encoder, library):
    """Words side by side, long words by themselves, and the pair test by itself agree with the library."""
    v, rng = B.vocabulary(PATH), np.random.default_rng(8)
    words = ["".join(rng.choice(list("aeinrstlo"), int(rng.integers(1, 40)))) for _ in range(500)]
    ids, counts = v.encode_words([w.encode() for w in words])
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(w, add_special_tokens=False).ids for w in words]
    for w in words[:50]:
        atoms = list(w.encode())
        atoms[-1] += B.FINAL
        last, at, out = v._prefixes(atoms), len(atoms), []
        while at:
            out.append(last[at - 1])
            at -= int(v.length[last[at - 1]])
        assert out[::-1] == library.encode(w, add_special_tokens=False).ids


def test_automaton_finds_every_token_that_ends_at_a_place():
    strings = [b"a", b"b", b"ab", b"bab", b"abab", b"ba", b"c"]
    link, longest, moves, whole = B.suffix_automaton(strings)
    text, state, read = b"ababcbab", 0, 0
    for i, c in enumerate(text):
        while c not in moves[state]:
            state = link[state]
            read = longest[state]
        state, read = moves[state][c], read + 1
        found, s = set(), state
        while s > 0:
            if s in whole and longest[s] <= read:
                found.add(strings[whole.index(s)])
            s = link[s]
        assert found == {x for x in strings if text[: i + 1].endswith(x)}


def test_encoding_keeps_rows_and_columns(spark, monkeypatch, library):
    monkeypatch.setattr(B, "SLICE", 40)
    rows = [(1, None, "k"), (1, None, "k"), (None, "", "k"), (2, "Some  text\n" * 30, None), (3, "x" * 5000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `ids` string").repartition(2)
    got = B.decode_ids(B.encode_texts(df, PATH), PATH).collect()
    want = [library.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows]
    key = lambda r: (str(r[0]), str(r[1]), r[2])
    assert sorted(((r["doc_id"], r["text"], r["ids"], r["decoded"]) for r in got), key=key) == sorted(((r[0], r[1], w, library.decode(w, skip_special_tokens=False)) for r, w in zip(rows, want, strict=True)), key=key)
    assert sorted(map(str, B.encode_texts(df, PATH, decoded_col="decoded").collect())) == sorted(map(str, got))
    assert B.decode_ids(B.encode_texts(df.limit(0), PATH), PATH).count() == 0
    some = B.decode_ids(spark.createDataFrame([(1, [320, None, -1, 10**6, 49407])], "a int, ids array<int>"), PATH).first()
    assert some["decoded"] == library.decode([320, 49407], skip_special_tokens=False)


def test_a_worker_forgets_beyond_its_bound(monkeypatch, library):
    monkeypatch.setattr(B, "KEPT", 20)
    e = B.Encoder(B.vocabulary(PATH))
    for t in ODD * 2:
        assert e.encode_block([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids
    assert len(e.chunks.places) <= 60
