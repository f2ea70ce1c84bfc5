"""The learned scores against plain versions that count words, characters and n-grams one by one."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meristem.llm._labels import drawn_labels
from meristem.llm.quality_qda import NAMES, WINDOW, learn_quality, quality_scores, score_quality, statistics
from meristem.llm import toxicity_nb
from meristem.llm.language_mixture import BUCKETS, grams, identify_languages
from meristem.llm.toxicity_nb import ORDERS, toxicity_scores

BETWEEN = "\t\n\x0b\x0c\r "
TEXTS = [
    "The  cat sat.\nOn the mat!", "", "a b a b a b a b", "ÀÉ ünï 日本語 \U0001f600", "1,234 <b>[x]</b> #tag @me", "\n\n one\r\nTwo\x0bthree ", "word", "   ",
    "don't (stop) now; \"go\" on: x-y?", "AbC dEf " * 40,
]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for s in BETWEEN:
        low = low.replace(s, " ")
    return [w for w in low.split(" ") if w]


def plain_statistics(text):
    if not text:
        return [0.0] * len(NAMES)
    data, w = text.encode(), words(text)
    share = lambda own: math.sqrt(sum(b in own for b in data) / len(text))
    blank, lines = sum(b in b" \t\x0b\x0c\r" for b in data), text.count("\n")
    windows = [tuple(w[i : i + WINDOW]) for i in range(max(1, len(w) - WINDOW + 1))] if w else []
    own = [
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".,;:?'\"()-", b"!", b"|<>{}[]=\\/", b"#$%&*@^~_+", bytes(range(0xC0, 0x100)),
    ]
    return [
        *map(share, own), math.log1p(len(text)), math.log1p(len(w)), math.log1p((len(text) - blank - lines) / max(len(w), 1)),
        len(set(w)) / len(w) if w else 0.0, math.sqrt(1 - len(set(windows)) / len(windows)) if w else 0.0, math.log1p(len(w) / (lines + 1)),
    ]


def test_quality_statistics_are_those_counted_by_hand():
    data = np.frombuffer("".join(TEXTS).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in TEXTS])))
    assert np.allclose(statistics(data, offsets), [plain_statistics(t) for t in TEXTS])


def test_quality_is_the_plain_discriminant(spark):
    """All of it by hand: labels 0 and 1, the held-out third, classes' moments, shrinkage, and the posterior."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "x1", "!!", "#"], rng.integers(1, 40)))) for i in range(90)] + [(90, None), (90, "twice"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = [(i, int(len(rows[i][1]) % 2)) for i in range(90)] + [(3, 0), (4, None), (5, 7), (None, 1)]
    got = {(r["doc_id"], i): r for i, r in enumerate(quality_scores(docs, spark.createDataFrame(marks, "doc_id long, quality int"), F.col("doc_id") % 3 != 2).collect())}
    text_of = {}
    for i, t in rows:
        text_of.setdefault(i, []).append(t)
    x = {0: [], 1: []}
    for i, y in marks:
        if i is not None and y in (0, 1) and i % 3 != 2:
            x[y] += [plain_statistics(t) for t in text_of[i]]
    x = {k: np.array(v) for k, v in x.items()}
    covs = {k: np.cov(v.T, bias=True) for k, v in x.items()}
    n = len(x[0]) + len(x[1])
    within = sum(len(x[k]) * covs[k] for k in x) / n

    def log_density(k, z):
        s = 0.7 * covs[k] + 0.3 * within
        s = 0.99 * s + 0.01 * np.trace(s) / len(NAMES) * np.eye(len(NAMES))
        d = z - x[k].mean(0)
        return math.log((len(x[k]) + 1) / (n + 2)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * d @ np.linalg.solve(s, d)

    want = sorted((str(i), 1 / (1 + math.exp(min(500, max(-500, log_density(0, z) - log_density(1, z)))))) for i, t in rows for z in [np.array(plain_statistics(t))])
    have = sorted((str(i), r["score"]) for (i, _), r in got.items())
    assert [i for i, _ in have] == [i for i, _ in want]
    assert np.allclose([s for _, s in have], [s for _, s in want], atol=1e-6)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_quality_scores_whole_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "y"), (None, None, "z")], "doc_id long, text string, score string")
    model = learn_quality(docs, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    out = score_quality(docs.select(F.struct("*").alias("row"), F.col("text").alias("t")), model, "row", "t").select("row.*", F.col("score").alias("s"))
    assert {(r[2], r["s"]) for r in out.collect()} == {("x", 0.5), ("y", 0.5), ("z", 0.5)}


def test_drawn_labels_are_bounded(spark):
    """An id that holds most rows is one row; what is drawn has about the size asked for."""
    labels = spark.range(20_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality").unionByName(spark.range(20_000).selectExpr("7L as doc_id", "1 as quality"))
    drawn = drawn_labels(labels, "quality", 1000).collect()
    assert 300 < len(drawn) < 1000
    whole = {r["_id"]: (r["_n0"], r["_n1"]) for r in drawn_labels(labels, "quality", 100_000).collect()}
    assert len(whole) == 20_000 and whole[7] == (0, 20_001) and whole[8] == (1, 0)


def plain_grams(text):
    out = set()
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in BETWEEN else c for c in text or "")
    s = " " + low + " "
    for k in ORDERS:
        for i in range(len(s) - k + 1):
            g = s[i : i + k]
            if " " not in g[1:-1] and not (g[0] == " " and g[-1] == " "):
                out.add(g)
    return out


@pytest.mark.parametrize("most", [4000, 20])
def test_toxicity_is_the_plain_classifier(spark, monkeypatch, most):
    """Log-count ratios of n-grams as strings over all labelled rows, and the same descent on dense rows over the sample; the logistic loss's minimum by Newton's steps is near."""
    monkeypatch.setattr(toxicity_nb, "SAMPLE_ROWS", most)
    rng = np.random.default_rng(5)
    nice, vile = ["garden", "river", "letters", "morning"], ["grumble", "stinker", "rotten", "garden"]
    rows = [(i, " ".join(rng.choice(vile if i % 3 == 0 else nice, rng.integers(1, 7)))) for i in range(60)] + [(60, None), (61, "Unseen wording"), (62, "STINKER\tgarden")]
    marks = [(i, int(i % 3 == 0)) for i in range(50)] + [(2, 1), (8, None), (9, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r["score"] for r in toxicity_scores(docs, spark.createDataFrame(marks, "doc_id long, toxic int"), F.col("doc_id") % 5 != 0).collect()}
    text = dict(rows)
    known = [(i, plain_grams(text[i]), y) for i, y in marks if y in (0, 1) and i % 5]
    n = Counter(y for _, _, y in known)
    df = {y: Counter(g for _, grams, z in known if z == y for g in grams) for y in (0, 1)}
    ratio = {g: math.log((df[1][g] + 0.1) / (n[1] + 0.2)) - math.log((df[0][g] + 0.1) / (n[0] + 0.2)) for g in df[0] | df[1] if df[0][g] + df[1][g] >= 2}
    strong = sorted(ratio)

    def row(t):
        v = np.array([ratio[g] if g in have else 0.0 for g in strong]) if (have := plain_grams(t)) else np.zeros(len(strong))
        return v / max(np.sqrt(v @ v), 1e-9)

    # the sample: the labelled rows with the smallest hashes, of those under a bound that lets through half as many again
    draw = {r["i"]: r["h"] for r in spark.createDataFrame([(i,) for i in {i for i, _, _ in known}], "i long").select("i", F.pmod(F.xxhash64("i", F.lit(11)), F.lit(1 << 30)).alias("h")).collect()}
    under = int(min(1.0, 1.5 * most / len(known)) * (1 << 30))
    sample = sorted((i for i in draw if draw[i] < under), key=lambda i: draw[i])[:most]
    counts = np.array([[sum(j == i and z == y for j, _, z in known) for y in (0, 1)] for i in sample], float)
    assert len(sample) <= most and (most > 50) == (len(sample) == len(draw)) and counts.sum(0).all()
    x = np.array([row(text[i]) for i in sample])
    weight = counts * (0.5 / counts.sum(0))
    w, b, v, vb = np.zeros(len(strong)), 0.0, np.zeros(len(strong)), 0.0
    for k in range(150):
        g = weight.sum(1) / (1 + np.exp(-(x @ v + vb))) - weight[:, 1]
        new, new_b = v - 4.0 * (x.T @ g + 1e-3 * v), vb - 4.0 * g.sum()
        v, vb = new + k / (k + 3) * (new - w), new_b + k / (k + 3) * (new_b - b)
        w, b = new, new_b
    full = np.column_stack([x, np.ones(len(x))])
    l2, best = np.append(np.full(len(strong), 1e-3), 0.0), np.zeros(len(strong) + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-full @ best))
        best -= np.linalg.solve((full.T * (weight.sum(1) * p * (1 - p))) @ full + np.diag(l2) + 1e-9 * np.eye(len(best)), full.T @ (weight.sum(1) * p - weight[:, 1]) + l2 * best)
    for i, t in rows:
        assert abs(got[i] - 1 / (1 + math.exp(-(row(t) @ w + b)))) < 1e-5
        assert abs(got[i] - 1 / (1 + math.exp(-(row(t) @ best[:-1] + best[-1])))) < 0.05


def plain_letters(text):
    """n-grams of one to three characters, runs of others than letters as one space."""
    out, last = [], True
    for c in text or "":
        if c.isalpha():
            out.append(c.lower() if ord(c) < 0x250 and len(c.lower()) == 1 else c)
        elif not out or out[-1] != " ":
            out.append(" ")
    s = "".join(out)
    return [s[i : i + k] for k in (1, 2, 3) for i in range(len(s) - k + 1) if k > 1 or s[i] != " "]


def plain_mixture(counts, probability, langs):
    """Expectation-maximisation over languages, the weakest leaving as long as the penalised likelihood gets no worse."""
    total, chosen, best = sum(counts.values()), list(langs), None
    while True:
        share = {x: 1 / len(chosen) for x in chosen}
        for _ in range(40):
            new = dict.fromkeys(chosen, 0.0)
            for g, n in counts.items():
                joint = {x: share[x] * probability[x, g] for x in chosen}
                for x in chosen:
                    new[x] += n * joint[x] / sum(joint.values()) / total
            done = max(abs(new[x] - share[x]) for x in chosen) < 1e-4
            share = new
            if done:
                break
        value = sum(n * math.log(sum(share[x] * probability[x, g] for x in chosen)) for g, n in counts.items()) - 0.5 * len(chosen) * math.log(total)
        if best is not None and value < best[0]:
            return best[1]
        best = value, share
        if len(chosen) == 1:
            return share
        weak = [x for x in chosen if share[x] < 0.02]
        gone = weak if weak and len(weak) < len(chosen) else [min(chosen, key=lambda x: (share[x], x))]
        chosen = [x for x in chosen if x not in gone]


def test_languages_are_those_of_the_plain_mixture(spark):
    rng = np.random.default_rng(6)
    own = {"aa": ["kasi", "Malo", "tuna"], "bb": ["Gröt", "strumf", "blik"], "cc": ["ñoze", "xilo", "quede"]}
    texts = [(i, " ".join(rng.choice(own["abc"[i % 3] * 2], 30)), "abc"[i % 3] * 2) for i in range(30)]
    texts += [(100, " ".join([*rng.choice(own["aa"], 25), *rng.choice(own["bb"], 25)]), None), (101, "123 !!", "aa"), (102, None, "bb"), (103, "tuna, GRÖT? \U0001f600 quede", None), (104, "zzz", "cc")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r for r in identify_languages(docs, F.col("doc_id") % 5 != 1).collect()}
    langs = ["aa", "bb", "cc"]
    known = {x: Counter(g for i, t, y in texts if y == x and i % 5 != 1 for g in plain_letters(t)) for x in langs}
    names = {g for _, t, _ in texts for g in plain_letters(t)}
    data = np.frombuffer("".join(sorted(names)).encode(), np.uint8)
    buckets = {g: grams(np.frombuffer(g.encode(), np.uint8), np.array([0, len(g.encode())]))[0][-1] for g in names if len(g) < 3 or " " not in g}
    assert len(data) and len(set(buckets.values())) == len(buckets)  # no two n-grams share a bucket
    probability = {(x, g): (0.5 + known[x][g]) / (0.5 * BUCKETS + sum(known[x].values())) for x in langs for g in names}
    for i, t, _ in texts:
        counts = Counter(plain_letters(t))
        if not any(c.isalpha() for c in t or ""):
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["languages"]) == ("und", 0.0, {})
            continue
        share = plain_mixture(counts, probability, langs)
        assert set(got[i]["languages"]) == {x for x in share if share[x] > 0}
        assert all(abs(got[i]["languages"][x] - v) < 1e-4 for x, v in share.items() if v > 0)
        assert got[i]["lang_pred"] == max(share, key=lambda x: (share[x], -langs.index(x))) and abs(got[i]["score"] - max(share.values())) < 1e-4
    assert set(got[100]["languages"]) == {"aa", "bb"}
