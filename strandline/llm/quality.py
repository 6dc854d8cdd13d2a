"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression over the row's own text, so the table is
one narrow projection over the scan: no shuffle, no user function.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import SPACE

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is it that for with as was on be by this are from at or an which "
    "der die das und ist nicht ein eine mit den von zu auf dem sich im als "
    "le la les de des et un une du que qui en dans pour pas sur par est "
    "el los las y por con para una del se no su al como más"
).split()

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``measure`` has to lie in [low, high] for texts of at least ``min_words`` words."""

    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The threshold table of the registered query.
DEFAULT_RULES = (
    Rule("mean_word_length", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.5),
    Rule("stop_word_ratio", 0.01, None, min_words=50),
    Rule("dup_line_ratio", None, 0.5),
    Rule("upper_ratio", None, 0.7),
)


def _measures(text: Column, own: Callable[[str], str]) -> list[dict[str, Column]]:
    """Columns in the order they build on each other; ``own`` names those that the result drops."""
    all_words, all_lines = own("words"), own("lines")
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    first = {all_words: words, all_lines: F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))}
    second = {
        "n_words": F.size(all_words).cast("long"),
        own("hashes"): F.transform(all_words, lambda w: F.xxhash64(w)),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(all_lines).cast("long"),
        "n_dup_lines": (F.size(all_lines) - F.size(F.array_distinct(all_lines))).cast("long"),
        own("stops"): F.size(F.filter(all_words, lambda w: F.lower(w).isin(STOP_WORDS))),
        own("uppers"): F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")),
        own("letters"): F.length(F.regexp_replace(text, r"[^\p{L}]+", "")),
    }
    return [first, second]


def _repeated(n: Column, own: Callable[[str], str]) -> list[dict[str, Column]]:
    """Words in five-word windows that stand in the text twice or more.

    Most texts have no such window, which a count of distinct ones shows.  In
    the others windows are sorted with their places; equal neighbours are
    repeats; the union of their words follows from the repeats' sorted places.
    """
    h, of_windows, in_order, of_repeats = F.col(own("hashes")), own("windows"), own("sorted"), own("places")
    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(0), n.cast("int") - 5), lambda i: F.xxhash64(*[h[i + k] for k in range(5)])))
    repeats = F.size(F.array_distinct(of_windows)) < F.size(of_windows)
    ordered = F.when(repeats, F.array_sort(F.transform(of_windows, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    s = F.col(in_order)
    place = lambda x, j: F.when(
        F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)), x["i"]
    )
    places = F.array_sort(F.filter(F.transform(s, place), lambda i: i.isNotNull()))
    begin = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("total"))
    step = lambda acc, i: F.struct(i.alias("last"), (acc["total"] + F.least(F.lit(5), i - acc["last"])).alias("total"))
    return [{of_windows: windows}, {in_order: ordered}, {of_repeats: places}, {"n_repeat_words": F.coalesce(F.aggregate(of_repeats, begin, step, lambda acc: acc["total"]), F.lit(0).cast("long"))}]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def score(docs: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``failed_rules`` (names) and ``kept``.

    A null or empty text has no words and fails the base rule.  Columns of the
    input stay; one of the same name as a result is replaced.  Rows are judged
    alone, so repeated rows and ties get the same verdict each.
    """
    known = {"mean_word_length", "symbol_ratio", "stop_word_ratio", "dup_line_ratio", "upper_ratio"}
    if unknown := {r.measure for r in rules} - known:
        raise ValueError(f"unknown measures: {sorted(unknown)}")
    # Helper columns begin as no column of the input does.
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    own = lambda name: f"{prefix}{name}"
    out = docs.withColumn(own("text"), F.coalesce(F.col(text_col), F.lit("")))
    for columns in [*_measures(F.col(own("text")), own), *_repeated(F.col("n_words"), own)]:
        out = out.withColumns(columns)
    out = out.withColumns(
        {
            "mean_word_length": _ratio(F.col("word_chars"), F.col("n_words")),
            "symbol_ratio": _ratio(F.col("n_symbols"), F.col("n_words")),
            "stop_word_ratio": _ratio(F.col(own("stops")), F.col("n_words")),
            "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
            "upper_ratio": _ratio(F.col(own("uppers")), F.col(own("letters"))),
            "base_failed": (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words")),
        }
    )
    broken = []
    for i, r in enumerate(rules):
        outside = F.lit(False)
        if r.low is not None:
            outside = outside | (F.col(r.measure) < r.low)
        if r.high is not None:
            outside = outside | (F.col(r.measure) > r.high)
        broken.append(F.when((F.col("n_words") >= r.min_words) & outside, F.lit(f"{i}:{r.measure}")))
    failed = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    out = out.withColumn("failed_rules", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop(*(c for c in out.columns if c.startswith(prefix)))
