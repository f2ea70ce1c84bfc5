"""The pipeline's stages on the smallest table, each against a plain version, and on odd rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from test_classifiers import plain_statistics, words

import corpus_pipeline as P
from meristem.llm import queries as Q
from meristem.llm.tokens import library, vocabulary_path

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema, counts = docs.schema, [docs.count()]
    for i, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        read = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(P.STAGES) - 1:
            assert read.schema == schema
            assert read.exceptAll(docs).count() == 0
            counts.append(read.count())
        docs = read if i < len(P.STAGES) - 1 else docs
    assert counts[-1] > 0 and all(a >= b for a, b in zip(counts, counts[1:], strict=False)) and counts[-1] < counts[0]
    last = spark.read.parquet(str(tmp_path / "4"))
    assert {r[0] for r in last.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}
    assert sorted(P.run(spark, SF).collect()) == sorted(last.collect())


def test_stages_on_odd_and_empty_tables(spark):
    rows = [(1, None, None, None, None), (None, "a b c d e f g h i j k l m n", "en", "s", 5), (2, "a b c d e f g h i j k l m n", "en", "s", 5), (3, "", "fr", None, 0), (2, "a b c d e f g h i j k l m n", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() >= 0
        assert stage(spark, docs.where("false"), SF).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as e

    assert set(Q.queries()) <= set(e.queries()) and set(Q.oracle_sql()) <= set(e.oracle_sql())


def test_rules_stage_judges_each_row_by_itself(spark):
    """Rows that share an id, or have none, keep their own verdicts; columns named like the measures stay as they are."""
    clean, poor = "one two three four five six seven eight nine ten eleven", "too few words"
    rows = [(1, clean, "x", 7), (1, poor, "y", 8), (None, clean, "x", 9), (None, None, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    out = P.quality_rules(spark, docs, SF)
    assert out.columns == docs.columns
    assert {(r["doc_id"], r["n_words"], r["kept"]) for r in out.collect()} == {(1, 7, "x"), (None, 9, "x")}


def plain_classifier(docs, labels):
    """Ids whose posterior of class 1 is 0.7 or more, by Gaussians with the operator's shrinkage."""
    x = {i: np.array(plain_statistics(t)) for i, t in docs.items()}
    own = {k: np.array([x[i] for i, y in labels if y == k and i in x]) for k in (0, 1)}
    n, d = sum(map(len, own.values())), len(next(iter(x.values())))
    within = sum(len(v) * np.cov(v.T, bias=True) for v in own.values()) / n

    def log_density(k, z):
        own_cov = np.cov(own[k].T, bias=True) if len(own[k]) > d else within
        s = 0.7 * own_cov + 0.3 * within
        s = 0.99 * s + 0.01 * max(np.trace(s) / d, 1e-6) * np.eye(d)
        g = z - own[k].mean(0)
        return math.log((len(own[k]) + 1) / (n + 2)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * g @ np.linalg.solve(s, g)

    return {i for i, z in x.items() if log_density(1, z) - log_density(0, z) >= math.log(0.7 / 0.3)}


def passes_rules(text):
    w = [x for x in _split(text) if x]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(windows)
    repeated = {i + k for i, g in enumerate(windows) if times[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
    chars, symbols, again = sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines))
    bad = len(w) < 10 or 100 * len(repeated) > 20 * len(w) or chars < 2 * len(w) or chars > 15 * len(w) or 2 * symbols > len(w) or (again >= 3 and 10 * again > len(w))
    bare = [x.strip(" \t\x0b\x0c\r") for x in lines]
    return not bad and 10 * sum(x.endswith(("...", "\u2026")) for x in bare) <= 3 * len(lines) and 10 * sum(x[0] in "-*\u2022" for x in bare) <= 9 * len(lines)


def _split(text):
    for s in "\t\n\x0b\x0c\r":
        text = (text or "").replace(s, " ")
    return text.split(" ")


def plain_near_duplicates(docs):
    sets = {}
    for i, t in docs.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while True:
        new = dict(label)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return {i for i in ids if label[i] == i}
        label = new


def plain_fill(weights, caps, total):
    given, live, left = dict.fromkeys(weights, 0.0), {k for k in weights if caps[k] > 0}, total
    while live and left > 1e-9:
        w = sum(weights[k] for k in live)
        step = min(left / w, min((caps[k] - given[k]) / weights[k] for k in live))
        for k in live:
            given[k] += step * weights[k]
        left -= step * w
        live = {k for k in live if given[k] < caps[k] - 1e-9}
    return given


def plain_mixing(docs):
    """docs: id to (text, lang, source); ids of which nine tenths of all words take something."""
    n = {i: len([w for w in _split(t) if w]) for i, (t, _, _) in docs.items()}
    path = {i: (f"domain{zlib.crc32(s.encode()) % 4}" if s is not None else None, lang, s) for i, (_, lang, s) in docs.items()}
    caps = defaultdict(int)
    for i, p in path.items():
        for k in range(4):
            caps[p[:k]] += n[i]
    budget = {(): float(int(sum(n.values()) * 0.9))}
    weight = lambda p: {"domain0": 4.0, "domain1": 3.0, "domain2": 2.0, "domain3": 1.0}.get(p[0], 1.0) if len(p) == 1 else 2.0 if len(p) == 2 and p[1] == "en" else 1.0
    for k in range(3):
        for parent in [p for p in budget if len(p) == k]:
            nodes = {p for p in caps if len(p) == k + 1 and p[:k] == parent}
            budget |= plain_fill({p: weight(p) for p in nodes}, caps, budget[parent])
    kept = set()
    for leaf in [p for p in caps if len(p) == 3]:
        amount = math.floor(budget[leaf] + 1e-6)
        full, left = divmod(amount, caps[leaf]) if caps[leaf] else (0, 0)
        for i in sorted((i for i in path if path[i] == leaf), key=lambda i: hashlib.md5(f"42|{full}|{i}".encode()).hexdigest()):
            if full * n[i] + min(n[i], left) > 0:
                kept.add(i)
            left = max(0, left - n[i])
    return kept


def test_run_equals_a_plain_pipeline(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    docs = {r["doc_id"]: r["text"] for r in rows}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    docs = {i: docs[i] for i in plain_classifier(docs, labels)}
    docs = {i: t for i, t in docs.items() if passes_rules(t)}
    docs = {i: docs[i] for i in plain_near_duplicates(docs)}
    whole = {r["doc_id"]: (r["text"], r["lang"], r["source"]) for r in rows}
    want = plain_mixing({i: whole[i] for i in docs})
    got = P.run(spark, SF).toPandas()
    assert set(got["doc_id"]) == want and len(want) > 50
    encode = library(vocabulary_path()).encode
    for doc_id, part in got.sort_values("piece").groupby("doc_id"):
        ids = np.array([*encode(docs[doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert part["length"].sum() == len(ids) and part["start"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]]
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(part["start"], part["length"], strict=True)] == part["ids_crc32"].tolist()
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]] and part["length"].sum() <= 1024


def test_rows_with_one_id_or_none_have_their_own_verdicts(spark):
    """Extra columns with the names that stages use inside stay as they are; a good row does not go because another of its id does."""
    good = " ".join(f"term{i}" for i in range(80))
    junk = "### $$$ |||"
    other = " ".join(f"word{i}" for i in range(60))
    rows = [(7, good, "en", "s", "a"), (7, junk, "en", "s", "b"), (None, good + " more", "en", "s", "c"), (None, junk, None, None, "d"), (3, other, "en", "t", "e"), (3, other, "en", "t", "f"), (9, other, "en", "t", "g"), (5, None, "en", "t", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _rejected string").withColumns({c: F.col("_rejected") for c in ("_row", "_key", "kept", "score", "carried", "taken", "domain", "_whole", "component_id", "id")})
    out = {}
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.exceptAll(docs).count() == 0
        out[name] = {r["kept"] for r in got.select("kept").collect()}
        assert stage(spark, docs.where("false"), SF).count() == 0
    assert "b" not in out["quality rules"] and {"a", "c", "e", "f", "g"} <= out["quality rules"] and "h" not in out["quality rules"]
    assert out["minhash near-dedup"] == {"a", "b", "h"} | (out["minhash near-dedup"] & {"e", "f"}) and len(out["minhash near-dedup"] & {"e", "f"}) == 1
    assert len(out["mixing sources"]) >= 6
    assert P.best_fit_packing(spark, docs, SF).count() >= len(rows)
