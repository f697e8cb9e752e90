"""Recurring lines by a log-template tree of fixed depth.

A line's tokens with a digit become ``<*>``. Its leaf in the tree is given by its number of tokens
and its leading tokens. Within a leaf a token's support is the number of lines that have it at that
place. A line's template is made of the leading tokens and those whose support is not below what
FIXED_SHARE of its other tokens reach; the rest are variable fields. So a field is told from the
wording by comparison within the line, and the outcome doesn't depend on how large the table is. A
template holds if a good share (CONCENTRATION) of the lines with its rarest token are its own, which
tells it from prose that happens to share words. All lines count, those that recur exactly too.

A template in enough documents is dropped everywhere but in the document with the smallest id that
has it. Lines without such a template (and short ones) are their own template.

Only hashes of lines are shuffled, after counting on the map side; tokens are counted only in leaves
that recur. A line found in a third of all documents is one row after counting, and the join back to
its occurrences is a sort-merge join that adaptive execution splits.

Null texts stay null, empty ones empty. Rows without id lose no line. Repeated rows count as
documents, but a line must be in documents with different ids. Lines without a word stay. Other
columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenvec.llm.common import checkpointed

ANY = "<*>"
#: Leading tokens that, with the number of tokens, make up a leaf.
DEPTH = 4
#: Documents that a template must be found in: short lines, and lines of LONG tokens or more.
MIN_DOCS, MIN_DOCS_LONG, LONG = 3, 2, 20
#: After the leading ones, a generalised template has at least so many tokens, and this share of them.
MIN_FIXED, FIXED_SHARE = 3, 0.7
#: Share of the lines with a template's rarest token that must be of the template.
CONCENTRATION = 0.25


def masked(line: Column) -> Column:
    """Tokens joined by single spaces, those with a digit as ``<*>``."""
    spaced = F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))
    # Most lines have neither a digit nor odd spaces, which one search tells.
    plain = F.trim(line)
    return F.when(line.rlike(r"[\x09-\x0D0-9]") | line.contains("  "), F.regexp_replace(spaced, r"[^ 0-9]*+[0-9][^ ]*+", ANY)).otherwise(plain)


def has_word(text: Column) -> Column:
    return text.rlike(r"[^\x20\x09-\x0D]")


def _needed(tokens: Column) -> Column:
    return F.when(tokens >= LONG, MIN_DOCS_LONG).otherwise(MIN_DOCS)


def _leaf(lines: DataFrame) -> DataFrame:
    n = F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1
    return lines.withColumn("n", n).withColumn("leaf", F.xxhash64("n", F.substring_index("line", " ", DEPTH)))


def _masked_lines(docs: DataFrame) -> DataFrame:
    """Each masked line with a word once for each row of ``docs (doc_id, text)``."""
    return docs.withColumn("line", F.explode(F.array_distinct(F.transform(F.split(F.col("text"), "\n"), masked)))).filter("line <> ''")


def _k1(line: Column) -> Column:
    return F.xxhash64(line)


def _keyed(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"k1": _k1(F.col("line")), "k2": F.xxhash64(F.lit(1), "line")})


#: Words of 64 bits of the filter below, which is broadcast: 4 MB with their places, at any size. Where it is full, it
#: only saves nothing.
FILTER_WORDS = 1 << 18


def _place(leaf: Column) -> tuple[Column, Column]:
    return F.pmod(F.shiftright(leaf, 6), F.lit(FILTER_WORDS)).cast("int"), F.pmod(leaf, F.lit(64)).cast("int")


def _maybe_in(lines: DataFrame, leaves: DataFrame) -> DataFrame:
    """The lines whose leaf may be one of ``leaves``, by a bitmap of fixed size; none is missed."""
    word, bit = _place(F.col("_leaf"))
    bits = leaves.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    word, bit = _place(F.col("leaf"))
    return (
        lines.withColumn("_at", word).join(F.broadcast(bits), F.col("_at") == F.col("_word"))
        .filter(F.call_function("shiftrightunsigned", F.col("_bits"), bit).bitwiseAND(F.lit(1)) == 1)
        .drop("_at", "_word", "_bits")
    )


def _occurrences(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, k1, k2, leaf, n`` of each masked line of each row of ``docs (doc_id, text)``."""
    rows = docs.filter("doc_id is not null").withColumn("text_hash", F.xxhash64("text"))
    return _keyed(_leaf(_masked_lines(rows))).select("doc_id", "text_hash", "k1", "k2", "leaf", "n")


def recurring(docs: DataFrame, occurrences: DataFrame) -> DataFrame:
    """``k1, k2, keeper`` of the masked lines whose template recurs, hashed twice.

    ``keeper`` is the id of the document that keeps the template.
    """
    counted = checkpointed(
        occurrences.groupBy("k1", "k2", "leaf", "n")
        .agg(F.count("*").alias("rows"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    )
    # Leaves in which some template may recur and differ from a line.
    leaves = checkpointed(
        counted.filter(F.col("n") >= DEPTH + MIN_FIXED).groupBy(F.col("leaf").alias("_leaf"), F.col("n").alias("_n"))
        .agg(F.count("*").alias("lines"), F.sum("rows").alias("total"), F.min("first").alias("low"), F.max("last").alias("high"))
        .filter("lines > 1 AND low <> high").filter(F.col("total") >= _needed(F.col("_n"))).select("_leaf")
    )
    open_lines = counted.filter(F.col("n") >= DEPTH + MIN_FIXED).join(leaves, F.col("leaf") == F.col("_leaf"), "left_semi")
    text = _keyed(_maybe_in(_leaf(_masked_lines(docs.filter("doc_id is not null"))), leaves)).select(
        F.col("doc_id").alias("_doc"), "line", F.col("k1").alias("_k1"), F.col("k2").alias("_k2")
    )
    # Each line is read once more, where its first document has it.
    whole = checkpointed(
        open_lines.join(text, (F.col("first") == F.col("_doc")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")))
        .dropDuplicates(["k1", "k2"])
        .select("k1", "k2", "leaf", "n", "rows", "first", "last", "line")
    )
    # A token at its place in a leaf goes by one hash, of which the template's own is made.
    places = F.slice(F.split("line", " "), DEPTH + 1, F.col("n"))
    token = F.explode(F.filter(F.transform(places, lambda t, k: F.when(t != ANY, F.xxhash64("leaf", k, t))), lambda t: t.isNotNull()))
    support = (
        whole.select("n", "rows", token.alias("_token"))
        .groupBy("_token").agg(F.sum("rows").alias("support"), F.min("n").alias("_n"))
        .filter(F.col("support") >= _needed(F.col("_n"))).select("_token", "support")
    )
    # The support that enough of a line's tokens reach; tokens below it are fields.
    enough = F.greatest(F.lit(MIN_FIXED), F.ceil(F.lit(FIXED_SHARE) * (F.col("n") - DEPTH)).cast("int"))
    reached = F.get(F.col("_supports"), enough - 1)
    fixed = F.filter("_tokens", lambda t: t["support"] >= F.col("least"))
    templates = checkpointed(
        whole.select("k1", "k2", "leaf", "n", "rows", "first", "last", token.alias("token")).join(support, F.col("token") == F.col("_token"))
        .groupBy("k1", "k2", "leaf", "n", "rows", "first", "last").agg(F.collect_list(F.struct("support", "token")).alias("_tokens"))
        .withColumn("_supports", F.reverse(F.array_sort(F.transform("_tokens", lambda t: t["support"]))))
        .withColumn("least", reached).filter("least is not null")
        .withColumn("template", F.aggregate(fixed, F.col("leaf"), lambda a, t: a.bitwiseXOR(t["token"])))
        .select("k1", "k2", "leaf", "template", "n", "rows", "first", "last", "least")
    )
    # A line in three documents or more has some between its first and last; others are in these alone.
    sums = templates.groupBy("leaf", "template", "n").agg(
        F.sum("rows").alias("_rows"), F.max(F.when(F.col("first") != F.col("last"), F.col("rows"))).alias("_most"), F.max("least").alias("_least"), F.min("first").alias("_keeper"),
    )
    docs_of = (
        templates.select("leaf", "template", F.explode(F.array_distinct(F.array("first", "last"))).alias("doc")).distinct()
        .groupBy("leaf", "template").agg(F.count("*").alias("_docs"))
    )
    wide = (
        sums.join(docs_of, ["leaf", "template"])
        .filter(F.greatest("_docs", F.when(F.col("_docs") > 1, F.coalesce("_most", F.lit(0)))) >= _needed(F.col("n")))
        .filter(F.col("_rows") >= F.lit(CONCENTRATION) * F.col("_least"))
        .select("leaf", "template", "_keeper")
    )
    general = checkpointed(templates.join(wide, ["leaf", "template"]).select("k1", "k2", F.col("_keeper").alias("keeper")))
    often = counted.filter((F.col("first") != F.col("last")) & (F.col("rows") >= _needed(F.col("n"))))
    exact = often.join(general, ["k1", "k2"], "left_anti").select("k1", "k2", F.col("first").alias("keeper"))
    return exact.unionByName(general)


def _cut(docs: DataFrame) -> DataFrame:
    """``_row`` (the row of ``docs``), ``_kept`` (its text without recurring lines) and ``_dropped`` (their number)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    occurrences = checkpointed(_occurrences(slim))
    drop = checkpointed(recurring(slim, occurrences))
    hits = (
        occurrences.join(drop, ["k1", "k2"]).filter("doc_id <> keeper")
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")).agg(F.collect_set("k1").alias("_drop"))
    )
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text.alias("_whole"), F.col("doc_id").cast("long").alias("_key"), F.xxhash64(text).alias("_hash"))
    lines = F.split(F.col("_whole"), "\n")
    kept = F.when(
        F.col("_drop").isNotNull(),
        F.filter(lines, lambda line: ~F.array_contains("_drop", _k1(masked(line)))),
    )
    return (
        rows.join(hits, (F.col("_key") == F.col("_id")) & (F.col("_hash") == F.col("_text")), "left")
        .select("_row", "_whole", "_drop", kept.alias("_lines"))
        .select(
            "_row", F.when(F.col("_drop").isNull(), F.col("_whole")).otherwise(F.array_join("_lines", "\n")).alias("_kept"),
            F.when(F.col("_drop").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("_lines")).cast("long").alias("_dropped"),
        )
    )


def _columns(docs: DataFrame, without: tuple[str, ...] = ()) -> list[Column]:
    return [F.col("_kept").alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns if c not in without]


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` freed of recurring lines, and ``n_dropped_lines``, in place of a column of that name."""
    return _cut(docs).select(*_columns(docs, ("n_dropped_lines",)), F.col("_dropped").alias("n_dropped_lines"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without recurring lines, less the documents of which no word is left; its columns as they came."""
    return _cut(docs).filter((F.col("_dropped") == 0) | has_word(F.col("_kept"))).select(*_columns(docs))
