"""Benchmark decontamination by a positional inverted index, in DataFrame functions only.

The index holds a posting (document, term, place) for every word of a document that some
benchmark item uses.  A window of consecutive item words is looked up from its rarest term on:
that term's postings, moved back by its offset, are possible starts; the next rarest term's
postings thin them out; the other terms confirm what is left.  Proximity matches are found the same
way, with each term allowed some words beside its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.tables import columns, small, stored_small
from shelfline.session import hand_over

# The class of separators, and the letters that are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 10
SLOP = 2  # words that a term of a proximity match may be off its place

# A row by hashes of key and text and of the text alone: never NULL, and equal for equal rows.
ROW = ["row_key", "copy"]


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, and no other letter."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def split_words(text: Column) -> Column:
    """Words, with an empty entry before leading and after trailing separators."""
    return F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS)


def row_hashes(text: Column) -> list[Column]:
    return [F.xxhash64("doc_id", text).alias("row_key"), F.xxhash64(text).alias("copy")]


def item_windows(items: DataFrame, length: int = WINDOW) -> DataFrame:
    """(window, item_id, words): every run of `length` words of an item; the whole of a shorter
    one; none of an item without words.  Equal runs share a window, numbered by their hash."""
    words = F.filter(split_words(F.col("text")), lambda w: w != "")
    listed = columns(items, ["item_id", "text"]).select("item_id", words.alias("all"))
    size = F.size("all")
    last = F.greatest(size - length, F.lit(0))
    runs = F.transform(
        F.sequence(F.lit(1), last + 1), lambda at: F.slice(F.col("all"), at, length)
    )
    return (
        listed.where(size > 0)
        .select("item_id", F.explode(runs).alias("words"))
        .select(F.xxhash64("words").alias("window"), "item_id", "words")
        .distinct()
    )


def window_terms(windows: DataFrame) -> DataFrame:
    """(window, size, offset, word) of the distinct windows."""
    once = windows.dropDuplicates(["window"])
    return once.select("window", F.size("words").alias("size"), F.posexplode("words")).toDF(
        "window", "size", "offset", "word"
    )


def build_index(documents: DataFrame, vocabulary: DataFrame, words: int) -> DataFrame:
    """Store the postings: row, place, term; and doc_id and n_words on each row's first one.

    `vocabulary` has (word, term), `words` of them.  The first word's posting is kept for every
    row, its term NULL where no item uses it.
    """
    text = F.coalesce("text", F.lit(""))
    split = columns(documents, ["doc_id", "text"]).select(
        "doc_id", *row_hashes(text), split_words(F.col("text")).alias("words")
    )
    before = (F.col("words")[0] == "").cast("int")
    after = ((F.size("words") > 1) & (F.element_at("words", -1) == "")).cast("int")
    placed = split.select(
        "doc_id",
        *ROW,
        before.alias("_before"),
        (F.size("words") - before - after).cast("bigint").alias("_words"),
        F.posexplode("words").alias("_at", "word"),
    )
    found = placed.join(small(vocabulary, words), "word", "left")
    kept = found.where((F.col("_at") == 0) | F.col("term").isNotNull())
    return hand_over(
        kept.select(
            *ROW,
            (F.col("_at") - F.col("_before")).alias("place"),
            "term",
            F.when(F.col("_at") == 0, F.col("doc_id")).alias("doc_id"),
            F.when(F.col("_at") == 0, F.col("_words")).alias("n_words"),
        ),
        "postings",
    )


def rank_terms(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """Add `rank`, 1 for a window's rarest place, the first of equal ones; windows with a term that
    no document has are left out."""
    # Broadcast if small: a common term's windows would meet in one task.
    counts = stored_small(
        postings.where(F.col("term").isNotNull())
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("occurrences")),
        "occurrences",
    )
    whole = Window.partitionBy("window")
    return (
        terms.join(counts, "term")
        .withColumn("_found", F.count(F.lit(1)).over(whole))
        .where(F.col("_found") == F.col("size"))
        .withColumn(
            "rank", F.row_number().over(whole.orderBy("occurrences", "offset"))
        )
        .select("window", "size", "offset", "term", "rank")
    )


def _needed(candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings that each candidate still needs, one row each."""
    return candidates.join(terms, "window").withColumn("place", F.col("start") + F.col("offset"))


def find_phrases(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, window, start) of every exact occurrence of every window.

    `terms` comes from `rank_terms`; store it, its rows are counted and read several times."""
    rows = terms.count()
    terms = terms.select("window", "offset", "term", "rank")
    listed = postings.select(*ROW, "term", "place").where(F.col("term").isNotNull())
    rarest = terms.where("rank = 1").select("window", "offset", "term")
    candidates = (
        listed.join(small(rarest, rows), "term")
        .withColumn("start", F.col("place") - F.col("offset"))
        .where("start >= 0")
        .select(*ROW, "window", "start")
        .distinct()
    )
    second = terms.where("rank = 2").select("window", "offset", "term")
    used = second.select("term").distinct()
    confirmed = (
        _needed(candidates, small(second, rows))
        .join(listed.join(small(used, rows), "term", "left_semi"), [*ROW, "term", "place"])
        .select(*ROW, "window", "start")
    )
    # Windows of one word are complete after the first step.
    single = terms.groupBy("window").agg(F.max("rank").alias("_ranks")).where("_ranks = 1")
    done = candidates.join(small(single, rows), "window", "left_semi")
    left = hand_over(confirmed.unionByName(done).distinct(), "candidates")
    rest = terms.where("rank > 2")
    # Only documents that hold a candidate are read on.
    owners = stored_small(left.select(*ROW).distinct(), "owners")
    there = listed.join(owners, ROW, "left_semi").distinct()
    wanted = terms.groupBy("window").agg(F.greatest(F.max("rank") - 2, F.lit(0)).alias("wanted"))
    complete = (
        _needed(left, small(rest, rows))
        .join(there, [*ROW, "term", "place"])
        .groupBy(*ROW, "window", "start")
        .agg(F.count(F.lit(1)).alias("found"))
        .join(small(wanted, rows), "window")
        .where("found = wanted")
        .select(*ROW, "window", "start")
    )
    short = left.join(small(wanted.where("wanted = 0"), rows), "window", "left_semi")
    return complete.unionByName(short.select(*ROW, "window", "start"))


def find_near(postings: DataFrame, terms: DataFrame, slop: int) -> DataFrame:
    """(row, window, start) where every term of a window stands within `slop` words of
    its place, counted from the rarest term: the proximity form of `find_phrases`.

    Candidates come from the rarest term and are thinned out by the next rarest one; only what is
    left is looked up in full.
    """
    rows = terms.count()
    listed = postings.select(*ROW, "term", "place").where(F.col("term").isNotNull())
    # One row per place that would do, so the joins stay equalities.
    at = F.col("start") + F.col("offset")
    spots = F.explode(F.sequence(at - slop, at + slop))

    def met(candidates: DataFrame, needed: DataFrame, places: DataFrame) -> DataFrame:
        """The candidates with each of their needed terms that stands near its place."""
        return (
            candidates.join(small(needed, rows), "window")
            .withColumn("place", spots)
            .join(places, [*ROW, "term", "place"], "left_semi")
            .select(*ROW, "window", "start", "rank")
            .distinct()
        )

    terms = terms.select("window", "offset", "term", "rank")
    rarest = terms.where("rank = 1").drop("rank")
    candidates = (
        listed.join(small(rarest, rows), "term")
        .withColumn("start", F.col("place") - F.col("offset"))
        .select(*ROW, "window", "start")
        .distinct()
    )
    sizes = terms.groupBy("window").agg(F.max("rank").alias("wanted"))
    single = candidates.join(small(sizes.where("wanted = 1"), rows), "window", "left_semi")
    second = terms.where("rank = 2")
    used = second.select("term").distinct()
    thinned = met(candidates, second, listed.join(small(used, rows), "term", "left_semi"))
    left = hand_over(thinned.drop("rank"), "near-candidates")
    owners = stored_small(left.select(*ROW).distinct(), "near-owners")
    there = listed.join(owners, ROW, "left_semi")
    complete = (
        met(left, terms.where("rank > 2"), there)
        .groupBy(*ROW, "window", "start")
        .agg((F.count(F.lit(1)) + 2).alias("found"))
        .join(small(sizes, rows), "window")
        .where("found = wanted")
        .select(*ROW, "window", "start")
    )
    pairs = left.join(small(sizes.where("wanted = 2"), rows), "window", "left_semi")
    names = [*ROW, "window", "start"]
    return complete.unionByName(pairs.select(*names)).unionByName(single.select(*names))


def covered_words(matches: DataFrame) -> DataFrame:
    """(row, n_hit): the words inside the matches (start, size) of each row."""
    order = Window.partitionBy(*ROW).orderBy("start", "size")
    past = F.max(F.col("start") + F.col("size")).over(
        order.rowsBetween(Window.unboundedPreceding, -1)
    )
    end = F.col("start") + F.col("size")
    fresh = F.greatest(end - F.greatest(F.col("start"), F.coalesce(past, F.lit(0))), F.lit(0))
    return (
        matches.withColumn("_fresh", fresh)
        .groupBy(*ROW)
        .agg(F.sum("_fresh").cast("bigint").alias("n_hit"))
    )


def find_contamination(
    documents: DataFrame, benchmark: DataFrame, length: int = WINDOW, slop: int | None = SLOP
) -> DataFrame:
    """doc_id, its hashes, n_words, n_hit, n_items, items_sha256, contaminated and, unless `slop` is
    None, n_near of every row: the distinct windows whose terms all stand within `slop` words of
    their places, counted from the rarest, exact occurrences included.

    A NULL or empty text has no words, no hits and the digest of the empty list.  Repeated rows
    each give a row; items that repeat count once; an empty benchmark hits nothing; other columns
    are dropped.
    """
    windows = hand_over(item_windows(benchmark, length), "windows")
    terms = window_terms(windows).withColumn("term", F.xxhash64("word"))
    vocabulary = terms.select("word", "term").distinct()
    postings = build_index(documents, vocabulary, vocabulary.count())
    ranked = hand_over(rank_terms(terms.drop("word"), postings), "ranked")
    matches = hand_over(find_phrases(postings, ranked), "matches")
    sizes = windows.select("window", "item_id", F.size("words").alias("size"))
    listed = matches.join(sizes, "window")
    items = (
        listed.select(*ROW, "item_id")
        .distinct()
        .groupBy(*ROW)
        .agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    )
    hits = covered_words(listed.select(*ROW, "window", "start", "size").distinct())
    rows = postings.where(F.col("n_words").isNotNull()).select("doc_id", *ROW, "n_words")
    near = []
    if slop is not None:
        windows_near = find_near(postings, ranked, slop).select(*ROW, "window").distinct()
        counted = windows_near.groupBy(*ROW).agg(F.count(F.lit(1)).alias("near"))
        rows = rows.join(counted, ROW, "left")
        near = [F.coalesce("near", F.lit(0)).alias("n_near")]
    return rows.join(items.join(hits, ROW), ROW, "left").select(
        "doc_id",
        *ROW,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias(
            "items_sha256"
        ),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        *near,
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark window occurs, with their own columns."""
    found = find_contamination(documents, benchmark, slop=None).where("contaminated")
    hashed = documents.withColumns(
        dict(zip(("_row_key", "_copy"), row_hashes(F.coalesce("text", F.lit("")))))
    )
    marked = found.select(F.col("row_key").alias("_row_key"), F.col("copy").alias("_copy"))
    marked = stored_small(marked.distinct(), "contaminated")
    left = hashed.join(marked, ["_row_key", "_copy"], "left_anti")
    return left.select(*(F.col(f"`{c}`") for c in documents.columns))
