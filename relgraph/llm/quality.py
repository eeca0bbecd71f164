"""Quality rules: a table of thresholds compiled into one projection.

Measures are Spark expressions over a text's words and lines; a rule is (measure, least,
most) and a document is kept if every rule holds. No user functions are called.

Defined cases: a null text is an empty text (no words: base_failed); rows are neither
dropped nor merged, whatever their ids; other columns pass through, and measures, failed
rules and verdicts replace columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgraph.llm.common import SPACE, apart, together

#: Frequent function words of the four languages of the corpus (English, French, German, Spanish).
STOP_WORDS = (
    "the be to of and that have with a in is it for on as was by are this from "
    "le la les de des et un une que est en du dans pour "
    "der die das und den von zu mit ist ein eine nicht auf im "
    "el los las y del por con una se lo su al"
).split()
WINDOW = 8
#: measure, least, most (None: no bound). Ratios are of all words, characters or lines.
RULES = (
    ("n_words", 20, None),
    ("mean_word_chars", 1.5, 20.0),
    ("symbol_per_word", None, 0.3),
    ("upper_ratio", None, 0.5),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
    ("longest_word_chars", None, 2000),
)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the measures of the text. Two projections: words, lines and window
    hashes are arrays that several measures read, so they are columns first."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    has_word = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\r\x0b\x0c"))) > 0)
    d = docs.withColumn("_words", words).withColumn("_lines", has_word).withColumn("_text", text)
    n = F.size("_words")
    # The hash of the window that starts at each word.
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("_windows", windows)
    # Windows that occur twice stand next to each other when sorted with their places.
    again = F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    d = d.withColumn("_sorted", again)
    m = F.size("_sorted")
    shifted = F.arrays_zip(
        F.col("_sorted").alias("x"),
        F.concat(F.slice("_sorted", F.lit(2), F.greatest(m - 1, F.lit(0))), F.array(F.lit(None).cast("struct<h:bigint,i:int>"))).alias("next"),
        F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice("_sorted", F.lit(1), F.greatest(m - 1, F.lit(0)))).alias("prev"),
    )
    twice = F.filter(shifted, lambda t: t["x"]["h"].eqNullSafe(t["next"]["h"]) | t["x"]["h"].eqNullSafe(t["prev"]["h"]))
    d = d.withColumn("_places", F.when(F.col("_sorted").isNotNull(), F.array_sort(F.transform(twice, lambda t: t["x"]["i"]))))
    # Words from each place on that the next place does not cover again.
    p = F.size("_places")
    covered = F.aggregate(
        F.zip_with("_places", F.slice("_places", F.lit(2), F.greatest(p, F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0).cast("long"),
        lambda s, x: s + x,
    )
    joined = F.array_join("_words", "")
    return d.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(joined).cast("long"),
            "n_symbols": F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
            "n_lines": F.size("_lines").cast("long"),
            "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
            "n_upper": F.regexp_count("_text", F.lit("[A-Z]")).cast("long"),
            "longest_word_chars": F.coalesce(F.array_max(F.transform("_words", F.length)), F.lit(0)).cast("long"),
        }
    ).drop("_words", "_lines", "_text", "_windows", "_sorted", "_places")


def ratios() -> dict[str, Column]:
    def part(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return {
        "mean_word_chars": part("word_chars", "n_words"),
        "symbol_per_word": part("n_symbols", "n_words"),
        "upper_ratio": part("n_upper", "word_chars"),
        "stop_word_ratio": part("n_stop_words", "n_words"),
        "dup_line_ratio": part("n_dup_lines", "n_lines"),
    }


def quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with measures, base_failed, failed (names of the rules that do not hold) and kept."""
    d = measured(apart(docs, "text")).withColumns(ratios())
    broken = [F.when((F.col(m) < lo if lo is not None else F.lit(False)) | (F.col(m) > hi if hi is not None else F.lit(False)), F.lit(m)) for m, lo, hi in rules]
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    d = d.withColumn("base_failed", base).withColumn("failed", F.array_compact(F.array(*broken)))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    return together(d, docs, ("text",), [c for c in d.columns if c not in ("text", "_row")])
