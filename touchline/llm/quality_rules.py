"""Quality rules: a threshold table compiled into one projection of built-in expressions.

A rule is (name, metric, low, high): a document passes it when low <= metric <= high. Metrics are
length, symbol, stop-word and line ratios of the whole text; no user function runs.

Repeated three-word windows are found inside the row by sorting their 64-bit hashes, which is
O(n log n) for a text of n words and needs no shuffle.

Defined cases: a null, empty or blank text has zero words, fails the base rule and is not kept;
repeated rows are judged alike, and rows of one id each by its own text; a very long text is one row of
arrays; a ratio on the edge of its range passes; an empty table gives an empty table; other columns are
dropped by `judge` and kept by `annotate`, but for those named like a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it of on or that the this to was were which with "
    "au avec ce dans de des du elle en est et il la le les ne pas par pour que qui sur un une "
    "als auf das dem den der die ein eine für im ist mit nicht sich und von zu "
    "al como con del el ella es esta las lo los más no para por se su una y"
).split()

#: (name, metric, lowest, highest): the method's verdict is that every metric lies within its range.
RULES: tuple[tuple[str, str, float, float], ...] = (
    ("mean_word_length", "word_chars_per_word", 2.0, 15.0),
    ("symbols", "symbols_per_word", 0.0, 0.25),
    ("stop_words", "stop_words_per_word", 0.02, 1.0),
    ("duplicate_lines", "dup_lines_per_line", 0.0, 0.5),
    ("exclaimed_words", "exclamations_per_word", 0.0, 0.25),
)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base counts; columns named like a count are replaced.

    A repeated window is a pair of equal neighbours among the sorted keys of the text's windows. A key
    is the window's whole hash and its position; texts without an equal pair (most) are told by the
    number of distinct hashes and never sorted.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    first = docs.withColumns(
        {
            "__words": F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), ""),
            "__lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "__marks": F.regexp_replace(t, r"[^#*$%&|<>!]++", ""),
        }
    )
    second = first.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_symbols": F.length(F.replace(F.col("__marks"), F.lit("!"), F.lit(""))).cast("long"),
            "n_exclaimed": F.length(F.regexp_replace("__marks", "[^!]+", "")).cast("long"),
            "__hash": F.transform("__words", lambda w: F.xxhash64(w)),
        }
    )
    h = F.col("__hash")
    stop = [F.xxhash64(F.lit(form)) for w in STOP_WORDS for form in dict.fromkeys((w, w.capitalize()))]
    third = second.withColumns(
        {
            "n_stop_words": F.size(F.filter(h, lambda x: x.isin(stop))).cast("long"),
            "__windows": F.transform(
                F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))),
                lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)),
            ),
        }
    )
    win = F.col("__windows")
    nothing = F.array().cast("array<struct<h:bigint,i:int>>")
    fourth = third.withColumn(
        "__keys",
        F.when(
            F.size(F.array_distinct(win)) < F.size(win),
            F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ).otherwise(nothing),
    )
    k = F.col("__keys")
    fifth = fourth.withColumn(
        "__repeated",
        F.sort_array(
            F.transform(
                F.filter(k, lambda x, j: F.coalesce(x["h"] == F.get(k, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(k, j + 1)["h"], F.lit(False))),
                lambda x: x["i"].cast("long"),
            )
        ),
    )
    covered = F.aggregate(
        "__repeated",
        F.struct(F.lit(-3).cast("long").alias("at"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(3).cast("long"), i - acc["at"])).alias("n")),
        lambda acc: acc["n"],
    )
    return fifth.withColumn("n_repeat_words", covered).drop("__words", "__lines", "__marks", "__hash", "__windows", "__keys", "__repeated")


def metrics() -> dict[str, Column]:
    """Ratios of the counts, by metric name; 0 where there is nothing to divide by."""

    def ratio(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    return {
        "word_chars_per_word": ratio("word_chars", "n_words"),
        "symbols_per_word": ratio("n_symbols", "n_words"),
        "stop_words_per_word": ratio("n_stop_words", "n_words"),
        "dup_lines_per_line": ratio("n_dup_lines", "n_lines"),
        "exclamations_per_word": ratio("n_exclaimed", "n_words"),
    }


def verdict(rules=RULES) -> Column:
    """One boolean from the table: every metric within its range."""
    known = metrics()
    out = F.lit(True)
    for _, metric, low, high in rules:
        out = out & known[metric].between(low, high)
    return out


def annotate(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """docs with counts, base_failed and kept."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measures(docs, text).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: the base counts, base_failed and kept."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return annotate(plain).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
