"""Quality rules by the frequency of lines across the documents of a host.

Every line is normalised (A-Z lower-cased, digits as 0, white space as one
space) and hashed. A hash found in more distinct documents of one host than the
limits allow marks a line of boilerplate there. It is removed from all documents
but the one with the smallest id, so that no content leaves the corpus
altogether, and a document that loses too large a share of its words is rejected.
Exact copies count as one document: they are the business of deduplication.

Only DataFrame functions are used. Lines are hashed once and stored, without text,
in the shared folder. Rows that are shuffled hold ids, hashes and counts, and
counts are summed before each shuffle; text is moved only by `clean`, which has to change it. A host with a third of all documents is no
special case, since the keys are (host, line).

Defined cases: null text is empty and has no words; a null host is a host of its
own; repeated rows with equal id and text count once and each gets the same
verdict; extra columns are ignored by `verdicts` and kept by `clean`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import SPACES, ascii_lower, stored, text_or_empty, words

SYMBOLS = "#*$%&|<>"


def normalised_line(line: Column) -> Column:
    """A-Z lower-cased, runs of white space as one space, none at the ends, digits as 0."""
    plain = F.octet_length(line) == F.length(line)  # lower() changes more than A-Z only outside of ASCII
    low = F.when(plain, F.lower(line)).otherwise(ascii_lower(line))
    odd = F.contains(line, F.lit("  "))
    for c in SPACES[1:]:
        odd |= F.contains(line, F.lit(c))
    squeezed = F.trim(F.when(odd, F.regexp_replace(low, r"[\x20\x09-\x0D]+", " ")).otherwise(low))
    return F.regexp_replace(squeezed, "[0-9]", "0")


def hashed_lines(docs: DataFrame) -> DataFrame:
    """One row per line with a word: _id, _host, _copy (hash of the text), _line (hash) and _n, its words. No text."""
    text = text_or_empty()
    each = docs.select(F.col("doc_id").alias("_id"), F.col("source").alias("_host"), F.xxhash64(text).alias("_copy"), F.explode(F.split(text, "\n")).alias("_raw"))
    each = each.select("_id", "_host", "_copy", normalised_line(F.col("_raw")).alias("_norm")).where("_norm != ''")
    words_ = F.length("_norm") - F.length(F.replace(F.col("_norm"), F.lit(" "), F.lit(""))) + 1
    return each.select("_id", "_host", "_copy", F.xxhash64("_norm").alias("_line"), words_.cast("long").alias("_n"))


def frequent_lines(docs: DataFrame, lines: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """_host, _line and _first (smallest document id) of lines in more distinct documents of their host than both limits. lines: docs' hashed lines."""
    hosts = (
        docs.groupBy(F.col("source").alias("_host"), F.xxhash64(text_or_empty()).alias("_copy")).agg(F.lit(1).alias("_one"))
        .groupBy("_host").agg(F.count("_one").alias("_docs"))
    )
    counted = (
        lines.groupBy("_host", "_line", "_copy").agg(F.min("_id").alias("_first"))
        .groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_in"), F.min("_first").alias("_first"))
        .where(F.col("_in") > min_docs)
    )
    return (
        counted.alias("c").join(hosts.alias("h"), F.col("c._host").eqNullSafe(F.col("h._host")))
        .where(F.col("_in") > min_share * F.col("_docs"))
        .select(F.col("c._host").alias("_host"), "_line", "_first")
    )


#: A place in a packed window has so many bits; longer documents sort pairs.
_PLACE_BITS = 16


def _repeated_places(windows: Column, hashes: str) -> Column:
    """Places, ascending, of the windows whose hash others have too. windows: an expression of the column named hashes."""
    mask = (1 << _PLACE_BITS) - 1

    def twice(ordered: Column, at) -> Column:
        """Of entries in the order of their hashes, the places of those equal to a neighbour; at: the place of an entry."""
        hash_ = lambda x: F.get(F.col(hashes), at(x))
        same = lambda x, other: F.coalesce(hash_(other) == hash_(x), F.lit(False))
        found = F.transform(F.array(ordered), lambda o: F.filter(o, lambda x, j: same(x, F.get(o, j - 1)) | same(x, F.get(o, j + 1))))
        return F.sort_array(F.transform(F.get(found, F.lit(0)), at))

    # the upper bits of a hash and its place sort as one number; neighbours are then compared by whole hashes
    packed = F.sort_array(F.transform(windows, lambda x, i: x.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))
    pairs = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    small = F.size(windows) <= mask + 1
    return F.when(small, twice(packed, lambda x: x.bitwiseAND(F.lit(mask)).cast("int"))).otherwise(twice(pairs, lambda x: x["p"]))


def base_counts(docs: DataFrame) -> DataFrame:
    """_id, _copy, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every row."""
    text = text_or_empty()
    step = docs.select(
        F.col("doc_id").alias("_id"),
        F.xxhash64(text).alias("_copy"),
        words(text).alias("_words"),
        (F.length(text) - F.length(F.regexp_replace(text, "[" + SYMBOLS + "]", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("_full"),
    )
    step = step.select(
        "_id", "_copy", "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        # each window of three words
        F.transform(
            F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get("_words", i + 1), F.get("_words", i + 2)),
        ).alias("_windows"),
    )
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    step = step.withColumn("_places", F.when(repeats, _repeated_places(F.col("_windows"), "_windows")))
    covered = F.transform("_places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_places", i + 1) - p, F.lit(3))))
    step = step.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
    return step.drop("_places", "_windows")


def verdicts(docs: DataFrame, min_docs: int = 10, min_share: float = 0.01, min_left: float = 0.5, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Per row of docs: doc_id, the base counts, base_failed, n_removed_words and kept.

    A line counts as frequent in more than min_docs distinct documents of its
    host and more than min_share of them; a document is depleted if less than
    min_left of its words are left. known: docs' hashed lines, stored, and what
    frequent_lines gave for these limits, if they are at hand.
    """
    lines = known[0] if known else stored(hashed_lines(docs), "lines")
    frequent = known[1] if known else frequent_lines(docs, lines, min_docs, min_share)
    removed = (
        lines.alias("d")
        .join(frequent.alias("f"), F.col("d._host").eqNullSafe(F.col("f._host")) & (F.col("d._line") == F.col("f._line")) & (F.col("d._id") != F.col("f._first")))
        .select(F.col("d._id").alias("_rid"), F.col("d._host").alias("_rhost"), F.col("d._copy").alias("_rcopy"), F.col("d._line").alias("_line"), "_n")
    )
    # repeated rows double the sum of words and the count of rows alike
    removed = removed.groupBy("_rid", "_rcopy").agg(F.sum("_n").alias("_gone"))
    stats = base_counts(docs)
    rows = stats.groupBy("_id", "_copy", "word_chars", "n_symbols", "n_words", "n_dup_lines", "n_repeat_words").agg(F.count(F.lit(1)).alias("_rows"))
    out = rows.join(removed, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_copy") == F.col("_rcopy")), "left")
    gone = F.coalesce(F.col("_gone"), F.lit(0)) / F.col("_rows")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.select(
        F.col("_id").alias("doc_id"), "_copy", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), gone.cast("long").alias("n_removed_words"),
        (~failed & (F.col("n_words") - gone >= min_left * F.col("n_words"))).alias("kept"),
        F.explode(F.array_repeat(F.lit(0), F.col("_rows").cast("int"))).alias("_row"),
    )
    return out.drop("_row")


def clean(docs: DataFrame, min_docs: int = 10, min_share: float = 0.01, min_left: float = 0.5) -> DataFrame:
    """docs without the rejected rows and, in the others, without the frequent lines; columns as in docs."""
    lines = stored(hashed_lines(docs), "lines")
    frequent = stored(frequent_lines(docs, lines, min_docs, min_share), "frequent")
    each = lines.alias("d").join(
        frequent.alias("f"), F.col("d._host").eqNullSafe(F.col("f._host")) & (F.col("d._line") == F.col("f._line")) & (F.col("d._id") != F.col("f._first"))
    )
    gone = each.groupBy(F.col("d._id").alias("_gid"), F.col("d._copy").alias("_gcopy")).agg(F.collect_set("d._line").alias("_gone"))
    rejected = verdicts(docs, min_docs, min_share, min_left, (lines, frequent)).where("not kept").select(F.col("doc_id").alias("_rid"), F.col("_copy").alias("_rcopy")).distinct()
    marks = gone.join(rejected, F.col("_gid").eqNullSafe(F.col("_rid")) & (F.col("_gcopy") == F.col("_rcopy")), "full_outer").select(
        F.coalesce("_gid", "_rid").alias("_mid"), F.coalesce("_gcopy", "_rcopy").alias("_mcopy"), "_gone", F.col("_rcopy").isNotNull().alias("_out")
    )
    # a struct holds the row: its columns may have any names
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64(text_or_empty()).alias("_here"))
    marked = own.join(marks, F.col("_id").eqNullSafe(F.col("_mid")) & (F.col("_here") == F.col("_mcopy")), "left")
    marked = marked.where(~F.coalesce("_out", F.lit(False)))
    text = F.col("_row")["text"]
    left = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("_gone", F.xxhash64(normalised_line(x))))
    text = F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(left, "\n"))
    return marked.select(*[text.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
