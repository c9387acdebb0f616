"""Quality rules: a threshold table compiled into one projection of built-in functions.

Records are texts that accompany the project's images (captions, annotation notes, reports), keyed by ``source_id``.
The project has no text table of its own, so the operator stays general: any table with ``source_id`` and ``text``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the",
    "this", "to", "was", "with",
    "avec", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pour", "que", "qui", "sur", "un",
    "une",
    "auf", "das", "dem", "den", "der", "die", "ein", "eine", "im", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "al", "con", "del", "el", "las", "los", "no", "por", "se", "su", "y",
)


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie in [low, high] once a text has ``min_words`` words; None leaves a side open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


# The threshold table.  A change of policy is a change of these rows.
RULES = (
    Rule("mean_word_length", "mean_word_length", 1.5, 25.0),
    Rule("symbols_per_word", "symbols_per_word", None, 0.3),
    Rule("stop_words", "stop_word_ratio", 0.01, None, 80),
    Rule("duplicate_lines", "duplicate_line_ratio", None, 0.5),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.9, 50),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.5, 50),
    Rule("line_length", "words_per_line", 1.2, None, 80),
)


def base_columns(df: DataFrame) -> DataFrame:
    """``source_id`` and counts per text; one narrow projection after the other, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = df.select("source_id", text.alias("text")).withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n = F.size("words")
    # the places of windows as an array of small numbers: no words are copied
    places = F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0)))
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    counted = words.select(
        "source_id", "text", "words", n.cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(n >= WINDOW, hashes).otherwise(F.array().cast("array<long>")).alias("windows"),
    )
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    bullets = r"^[ \t]*([-*]|\x{2022}|[0-9]+[.)]) "
    return counted.select(
        "source_id", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeats, _covered(F.col("windows"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: F.array_contains(stops, F.lower(w)))).cast("long").alias("n_stop_words"),
        F.size(F.filter("lines", lambda x: x.rlike(bullets))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|\x{2026})[ \t\r]*$"))).cast("long").alias("n_ellipsis_lines"),
    )


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs again: sort (hash, start), keep equal neighbours, add up the union."""
    keyed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    # neighbours by zipping the sorted array with itself moved by one on either side
    around = F.zip_with(
        F.zip_with(F.concat(none, keyed), keyed, lambda before, here: F.struct(before.alias("before"), here.alias("here"))),
        F.concat(F.slice(keyed, F.lit(2), F.size(windows)), none),
        lambda pair, after: F.struct(pair.getField("before").alias("b"), pair.getField("here").alias("x"), after.alias("a")),
    )
    again = F.filter(
        around,
        lambda t: F.coalesce(t.getField("x").getField("h") == t.getField("b").getField("h"), F.lit(False))
        | F.coalesce(t.getField("x").getField("h") == t.getField("a").getField("h"), F.lit(False)),
    )
    starts = F.array_sort(F.transform(again, lambda t: t.getField("x").getField("i")))
    # one pass in start order: (covered so far, first word not yet covered)
    total = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda acc, s: F.struct(
            (acc.getField("n") + s + F.lit(WINDOW) - F.greatest(acc.getField("to"), s)).alias("n"), (s + F.lit(WINDOW)).alias("to")
        ),
    )
    return total.getField("n")


def metric_columns() -> dict[str, Column]:
    """Ratios by name, each null where its divisor is 0."""

    def ratio(a: str, b: str) -> Column:
        return F.col(a) / F.when(F.col(b) > 0, F.col(b))

    return {
        "mean_word_length": ratio("word_chars", "n_words"),
        "symbols_per_word": ratio("n_symbols", "n_words"),
        "stop_word_ratio": ratio("n_stop_words", "n_words"),
        "duplicate_line_ratio": ratio("n_dup_lines", "n_lines"),
        "bullet_line_ratio": ratio("n_bullet_lines", "n_lines"),
        "ellipsis_line_ratio": ratio("n_ellipsis_lines", "n_lines"),
        "words_per_line": ratio("n_words", "n_lines"),
    }


def compile_rules(rules: Sequence[Rule]) -> Column:
    """array<string> of the names of violated rules."""
    metrics = metric_columns()
    broken = []
    for rule in rules:
        if rule.metric not in metrics:
            raise ValueError(f"unknown metric {rule.metric}; known: {sorted(metrics)}")
        value, bad = metrics[rule.metric], F.lit(False)
        if rule.low is not None:
            bad = bad | (value < rule.low)
        if rule.high is not None:
            bad = bad | (value > rule.high)
        bad = bad & (F.col("n_words") >= rule.min_words)
        broken.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(rule.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def quality_rules(records: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per record of (source_id, text): counts, ``base_failed``, ``failed_rules`` and ``kept``.

    Method: the threshold table ``rules`` becomes one Spark projection; no user function runs and nothing is shuffled.
    A repeated window is found by its 64-bit hash inside one text, so memory per row is a few numbers per word.

    Null text counts as empty: all counts 0, ``base_failed``.  Null ids are kept as they are; repeated rows give repeated
    results; an empty table gives an empty result; other columns are ignored.
    """
    counts = base_columns(records)
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = counts.withColumn("base_failed", base_failed).withColumn("failed_rules", compile_rules(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
