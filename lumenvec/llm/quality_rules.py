"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Nulls and empty texts have no words and zero counts; they fail the base rule and are not kept.
Repeated rows are judged alike. Texts are read whole, however long. A table without rows gives none.
Extra columns pass through, whatever their names; one named like a result is replaced by it, but for
``filter_documents``, which returns the columns that came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenvec.llm.common import words_of

#: Words of function in the corpus' languages (fixed values).
STOP_WORDS = (
    "the of and to a in is that for it as was with be by on not he his but at are this have from or had an they which one you were all "
    "there been has when who will no if out so what up into than them can only other "
    "le la les de des du un une et que qui dans pour pas est sur au avec ce il par plus ne se sont ou mais nous vous leur "
    "der die das und ist von zu mit den ein eine nicht sich auch es im auf für dem wie bei "
    "el los las y en un una por con no para su al lo como más o pero sus se del"
).split()

#: (ratio, lowest, highest); a document outside one of the closed ranges is not kept.
RULES = (
    ("mean_word_chars", 2.0, 12.0),
    ("symbols_per_word", 0.0, 0.1),
    ("distinct_stop_words", 2.0, float("inf")),
    ("stop_word_share", 0.02, 1.0),
    ("upper_case_share", 0.0, 0.5),
    ("digit_share", 0.0, 0.3),
    ("dup_line_ratio", 0.0, 0.5),
    ("short_line_share", 0.0, 0.9),
)
#: A line of fewer words is short.
SHORT_LINE = 4
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_short_lines", "n_stop_words", "n_stop_word_places", "n_upper", "n_digits",
)

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8


def _repeated_places() -> tuple[Column, Column]:
    """Window hashes ``_h`` with their places, in the hash's order; and from these, as ``_o``, the
    sorted places of windows found twice or more.

    The hash has 64 bits and is compared within one document only.
    """
    ordered = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    places = F.sort_array(
        F.transform(
            F.filter(
                F.transform(F.col("_o"), lambda x, k: F.struct(
                    x["i"].alias("i"),
                    ((k > 0) & (F.get(F.col("_o"), k - 1)["h"] == x["h"])
                     | F.coalesce(F.get(F.col("_o"), k + 1)["h"] == x["h"], F.lit(False))).alias("twice"),
                )),
                lambda x: x["twice"],
            ),
            lambda x: x["i"],
        )
    )
    return ordered, places


def measures(rows: DataFrame) -> DataFrame:
    """``_row`` and the counts (``COUNTS``) of ``rows (_row, text)``: ``n_stop_words`` counts distinct ones,
    ``n_stop_word_places`` all. Only built-in functions; no shuffle.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    ordered, places = _repeated_places()
    windows = F.when(
        F.col("n_words") >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), F.col("n_words").cast("int") - (WINDOW - 1)),
            lambda i: F.xxhash64(*[F.element_at(F.col("_w"), i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    covered = F.aggregate(
        "_p", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("at")),
        lambda a, p: F.struct(
            (a["n"] + F.least(F.lit(WINDOW), p - a["at"])).cast("bigint").alias("n"), p.alias("at")
        ),
        lambda a: a["n"],
    )
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stop = sorted(set(STOP_WORDS))
    few_words = rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++(?:[\x20\x09-\x0D]++|$)){{1,{SHORT_LINE - 1}}}$"
    return (
        rows.withColumn("_w", words_of(F.col("text")))
        .withColumn("n_words", F.size("_w").cast("long"))
        .withColumn("_h", windows)
        .withColumn("_s", F.sort_array("_h"))
        .withColumn("_twice", F.size("_s") > F.size(F.array_distinct("_s")))
        .withColumn("_o", F.when(F.col("_twice"), ordered))
        .withColumn("_p", F.when(F.col("_twice"), places))
        .withColumn("_l", lines)
        .withColumn("_st", F.filter(words_of(F.lower(body)), lambda w: w.isin(stop)))
        .select(
            "_row", "n_words",
            F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(body, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            F.when(F.col("_twice"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size("_l").cast("long").alias("n_lines"),
            F.size(F.filter("_l", lambda x: x.rlike(few_words))).cast("long").alias("n_short_lines"),
            F.size(F.array_distinct("_st")).cast("long").alias("n_stop_words"),
            F.size("_st").cast("long").alias("n_stop_word_places"),
            F.length(F.regexp_replace(body, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
            F.length(F.regexp_replace(body, "[^0-9]+", "")).cast("long").alias("n_digits"),
        )
    )


def ratios() -> dict[str, Column]:
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return {
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "distinct_stop_words": F.col("n_stop_words").cast("double"),
        "stop_word_share": F.col("n_stop_word_places") / words,
        "upper_case_share": F.col("n_upper") / chars,
        "digit_share": F.col("n_digits") / chars,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
        "short_line_share": F.col("n_short_lines") / lines,
    }


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").cast("string").alias("text"))


def _judged(docs: DataFrame, rules: tuple) -> DataFrame:
    """``_row``, the counts, the ratios of ``rules``, ``base_failed`` and ``kept``."""
    value = ratios()
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    passed = ~failed
    for name, low, high in rules:
        passed = passed & value[name].between(low, high)
    return measures(_rows(docs)).select(
        "_row", *COUNTS, *[value[name].alias(name) for name, _, _ in rules],
        failed.alias("base_failed"), passed.alias("kept"),
    )


def judge(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``docs (text)`` with the counts, the ratios of ``rules``, ``base_failed`` and ``kept``."""
    out = (*COUNTS, *[name for name, _, _ in rules], "base_failed", "kept")
    return _judged(docs, rules).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c not in out], *out)


def filter_documents(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns that it came with."""
    # The row number keeps the optimizer from copying the measures into a filter below them, where
    # each would be computed anew for every word.
    judged = _judged(docs, rules).withColumn("_hold", F.monotonically_increasing_id())
    return judged.filter("kept AND _hold >= 0").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
