"""Quality rules as a short-circuit cascade, in DataFrame operations only.

A rule is a condition on a text under which its document is rejected. Every rule's cost (seconds over
a drawn sample, beyond those of a job that only reads it) and selectivity (share of the sample that it
rejects) are estimated; the rules then run in order of rejection per cost inside one CASE expression,
which stops at the first that rejects, so what only later rules need is never computed for that row.
The order changes the work and never the verdict.

Where the measures are asked for as columns, the rules that they decide are comparisons on them; the
others still read the text, and only that of rows which are alive when their turn comes.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import cut

SAMPLE_ROWS = 1000
WINDOW = 5

#: Between words; characters that count as symbols.
BETWEEN_WORDS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """of_text: the condition on a raw text and its words; of_measures: the same on the columns of with_measures, where they decide it."""

    name: str
    of_text: Callable[[Column, Column], Column]
    of_measures: Column | None = None


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN_WORDS), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside WINDOW-word windows that occur twice or more in one text.

    Windows are compared by 64-bit hashes of their words' hashes. Only where some window repeats are
    they sorted, so that equal ones are neighbours; the places of those, sorted, then give the words
    that they cover: WINDOW each, less what the window before has covered.
    """

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda s: s["n"])

    def places(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def pick(p: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(p, j)["h"] == x["h"], F.lit(False))
            marked = F.transform(p, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
            return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

        return _let(pairs, pick)

    def of_windows(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(_let(places(windows), covered))

    def of_hashes(h: Column) -> Column:
        ends = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return _let(F.transform(ends, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])), of_windows)

    enough = F.size(words) >= WINDOW
    return F.when(enough, _let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)).otherwise(F.lit(0).cast("long"))


def lines_of(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.ltrim(x, F.lit(BLANK)) != "")


def duplicate_lines(text: Column) -> Column:
    return _let(lines_of(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def symbols(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """Whole-text measures by name; a null text has none of anything."""
    measured = _let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    return {
        "_of_words": measured,
        "n_symbols": symbols(text),
        "n_dup_lines": duplicate_lines(text),
    }


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    found = docs.withColumns(measures(F.col(text_col).cast("string")))
    parts = ["n_words", "word_chars", "n_repeat_words"]
    return found.withColumns({p: F.col("_of_words")[p] for p in parts}).drop("_of_words")


def _ends_in_ellipsis(line: Column) -> Column:
    bare = F.rtrim(line, F.lit(BLANK))
    return F.endswith(bare, F.lit("...")) | F.endswith(bare, F.lit("\u2026"))


def _starts_with_bullet(line: Column) -> Column:
    return F.substring(F.ltrim(line, F.lit(BLANK)), 1, 1).isin("-", "*", "\u2022")


def _marked_lines(text: Column, words: Column) -> Column:
    """More than 3 of 10 lines end in an ellipsis, or more than 9 of 10 start with a bullet."""

    def condition(x: Column) -> Column:
        return (10 * F.size(F.filter(x, _ends_in_ellipsis)) > 3 * F.size(x)) | (10 * F.size(F.filter(x, _starts_with_bullet)) > 9 * F.size(x))

    return _let(lines_of(text), condition)


def base_rules() -> list[Rule]:
    return [
        Rule("few_words", lambda text, w: F.size(w) < 10, F.col("n_words") < 10),
        Rule("repetition", lambda text, w: 100 * repeated_words(w) > 20 * F.size(w), 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    ]


def _word_length(text: Column, words: Column) -> Column:
    chars = F.length(F.array_join(words, ""))
    return (chars < 2 * F.size(words)) | (chars > 15 * F.size(words))


def method_rules() -> list[Rule]:
    """Rules beyond the base: words too short or long on average, many symbols, many repeated lines, and lines that mostly end in an ellipsis or start with a bullet."""
    return [
        Rule("word_length", _word_length, (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
        Rule("symbols", lambda text, w: 2 * symbols(text) > F.size(w), 2 * F.col("n_symbols") > F.col("n_words")),
        Rule(
            "line_repetition",
            lambda text, w: _let(duplicate_lines(text), lambda n: (n >= 3) & (10 * n > F.size(w))),
            (F.col("n_dup_lines") >= 3) & (10 * F.col("n_dup_lines") > F.col("n_words")),
        ),
        Rule("marked_lines", _marked_lines),
    ]


def drawn_sample(docs: DataFrame, sample_rows: int, seed: int = 42) -> DataFrame:
    """About sample_rows rows drawn from all of the table, written once."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    return cut(docs.sample(share, seed).repartition(4))


def order_rules(sample: DataFrame, conditions: list[tuple[str, Column]]) -> list[tuple[str, float, float]]:
    """(name, rejected share, seconds) in the order of share per second; of those that reject nothing the cheaper first. An empty sample keeps the given order.

    The seconds are the shorter of two runs, less those of a job that reads the rows and no more.
    Rules that measure alike may change places from run to run, which no verdict depends on.
    """
    n = sample.count()
    if not n:
        return [(name, 0.0, 0.0) for name, _ in conditions]

    def run(condition: Column) -> tuple[int, float]:
        began = time.perf_counter()
        return sample.where(condition).count(), time.perf_counter() - began

    reading = min(run(F.length("_text") < 0)[1] for _ in range(2))
    found = []
    for name, condition in conditions:
        (hits, first), (_, second) = run(condition), run(condition)
        found.append((name, hits / n, max(min(first, second) - reading, 1e-3)))
    return sorted(found, key=lambda x: (-x[1] / x[2], x[2]))


def cascade(conditions: list[tuple[str, Column]]) -> Column:
    """The name of the first rule, in this order, that rejects a row; null if none does. Later conditions are not evaluated."""
    verdict = F.lit(None).cast("string")
    for name, rejects in reversed(conditions):
        verdict = F.when(rejects, F.lit(name)).otherwise(verdict)
    return verdict


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, measured: bool = True) -> DataFrame:
    """(id_col, measures, base_failed, kept) for every row, with the verdict of the base and the given rules.

    Without measured it is (id_col, kept), and the base rules are part of the cascade: nothing is
    computed that the verdict does not need. Null and empty texts have no words and fail. Repeated rows
    each get a row, null ids too. Other columns are not read, so none can clash. A text is handled as
    one value, however long.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    rules = method_rules() if rules is None else rules
    if not measured:
        rules = [*base_rules(), *rules]
        sample = cut(drawn_sample(rows.select("_text"), sample_rows).withColumn("_words", words_of(F.col("_text"))))
        by_name = {r.name: r for r in rules}
        ordered = [by_name[name] for name, _, _ in order_rules(sample, [(r.name, r.of_text(F.col("_text"), F.col("_words"))) for r in rules])]
        verdict = _let(words_of(F.col("_text")), lambda w: cascade([(r.name, r.of_text(F.col("_text"), w)) for r in ordered]))
        return rows.select(F.col(id_col), verdict.isNull().alias("kept"))
    conditions = {r.name: r.of_text(F.col("_text"), words_of(F.col("_text"))) if r.of_measures is None else r.of_measures for r in rules}
    sample = cut(with_measures(drawn_sample(rows.select("_text"), sample_rows), "_text"))
    few_words, repetition = (r.of_measures for r in base_rules())
    ordered = order_rules(sample.where(~(few_words | repetition)), list(conditions.items()))
    return (
        with_measures(rows, "_text")
        .withColumn("base_failed", few_words | repetition)
        .withColumn("kept", ~F.col("base_failed") & cascade([(name, conditions[name]) for name, _, _ in ordered]).isNull())
        .select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    )
