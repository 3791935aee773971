"""Deleting later copies of repeated line runs, in DataFrame operations alone.

The lines of all documents form one sequence of line ids. Prefix doubling names the run of
2^k lines at every position: two positions bear one name where their runs are equal. A
name is the first position of its group, so it is at once the place of the first copy, and
a group is an interval of the suffix array. Runs that occur once drop out, and doubling goes
on until nothing is left. Descending again, steps of 2^j lines cut the groups into the
intervals of longest common prefixes, of any length. Each position then has one interval in
which it is a later copy of what it shares with anything before it; such runs that no run
from the line before contains are maximal, and go if they hold enough words. Equal neighbours
in the array are all that counts, so the order of different runs is not computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pagerisk.llm.common import WORD, row_key
from pagerisk.session import gathered, materialise

_BLANKS = " \t\n\x0b\x0c\r"
_PLACE = ["d", "h", "n"]


def line_table(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines with a word: document key, place among them, index in the text, id, words.

    The id is 96 bits of hashes of the line without white space at its ends.
    """
    key = row_key(id_col, text_col)
    split = F.transform(
        F.split(F.col(text_col), "\n"),
        lambda line, at: F.struct(at.alias("i"), F.btrim(line, F.lit(_BLANKS)).alias("line")),
    )
    kept = F.filter(split, lambda x: x["line"] != "")
    rows = documents.select(key["d"].alias("d"), key["h"].alias("h"), kept.alias("lines"))
    rows = rows.select("d", "h", F.posexplode("lines").alias("n", "at"))
    return rows.select(
        "d", "h", "n", "at.i",
        F.xxhash64("at.line").alias("x"),
        F.hash("at.line").alias("y"),
        F.regexp_count("at.line", F.lit(WORD)).alias("words"),
    )


def _named(rows: DataFrame, name: list[str]) -> DataFrame:
    """Replace the columns ``name`` by ``name``: the first place of the rows equal in them.

    ``members`` tells how many they are. Rows that are alone are left out. Keys may be very frequent: the least place is combined
    before the shuffle, and the join that hands it back may split a key.
    """
    place = F.struct(*_PLACE)
    first = (
        rows.groupBy(*name)
        .agg(F.min(place).alias("name"), F.count("*").alias("members"))
        .filter("members > 1")
    )
    return rows.join(first, name).drop(*name)


def _levels(repeated: DataFrame) -> list[DataFrame]:
    """Names (place, name, members) of the runs of 2^k lines that come again, until none does."""
    levels = [materialise(repeated.select(*_PLACE, "name", "members"), "line-names")]
    while True:
        size = 1 << (len(levels) - 1)
        follow = levels[-1].select(
            "d", "h", (F.col("n") - size).alias("n"), F.col("name").alias("next")
        )
        own = levels[-1].select(*_PLACE, F.col("name").alias("own"))
        pairs = own.join(follow, _PLACE)
        level = materialise(gathered(_named(pairs, ["own", "next"])), "line-names")
        if level.isEmpty():
            return levels
        levels.append(level)


def _entering(level: DataFrame, longer: DataFrame | None, size: int) -> DataFrame:
    """The groups of one level that branch, as intervals: first, length, members, branches.

    A branch is what agrees in twice as many lines. Its first place stands for it, with its
    number of members as ``weight``; a branch of all members is none.
    """
    rows = level.withColumnRenamed("name", "first").withColumn("length", F.lit(size))
    if longer is None:
        return rows.withColumn("weight", F.lit(1).cast("long"))
    longer = longer.withColumnRenamed("members", "more")
    rows = rows.join(longer, _PLACE, "left").filter(
        "name IS NULL OR (name = struct(d, h, n) AND more < members)"
    )
    return rows.withColumn("weight", F.coalesce("more", F.lit(1))).drop("name", "more")


def _refined(intervals: DataFrame, level: DataFrame, size: int) -> DataFrame:
    """Make intervals of the branches that agree in ``size`` lines more, and branch from them.

    They become one branch, under their first place, of the interval that they were found
    in; if they are all of it, it does not branch and goes.
    """
    follow = level.select("d", "h", F.col("n").alias("at"), F.col("name").alias("next"))
    at = F.col("n") + F.col("length")
    rows = intervals.withColumn("at", at).join(follow, ["d", "h", "at"], "left").drop("at")
    place = F.struct(*_PLACE)
    key = ["first", "length", "next"]
    alike = (
        rows.filter("next IS NOT NULL")
        .groupBy(*key)
        .agg(
            F.min(place).alias("head"), F.count("*").alias("branches"),
            F.sum("weight").alias("all"),
        )
        .filter("branches > 1")
        .drop("branches")
    )
    rows = rows.join(alike, key, "left")
    head, both = F.col("head"), F.col("all")
    stays = F.struct("first", "length", "members", F.coalesce(both, "weight").alias("weight"))
    deeper = F.struct(
        head.alias("first"), (F.col("length") + size).alias("length"),
        both.alias("members"), F.col("weight"),
    )
    parts = F.array(
        F.when(head.isNull() | ((head == place) & (both < F.col("members"))), stays),
        F.when(head.isNotNull(), deeper),
    )
    return rows.select(*_PLACE, F.inline(F.array_compact(parts)))


def _intervals(levels: list[DataFrame]) -> DataFrame:
    """The intervals of longest common prefixes: first, length, and a place for each branch.

    Every group of 2^k lines that branches before 2^(k+1) is an interval of at least that
    length. Steps of 2^j lines, from the longest to one line, find where it branches.
    """
    found = None
    for k in reversed(range(len(levels))):
        longer = levels[k + 1] if k + 1 < len(levels) else None
        rows = _entering(levels[k], longer, 1 << k)
        if found is not None:
            rows = rows.unionByName(_refined(found, levels[k], 1 << k))
        found = materialise(gathered(rows), "line-intervals") if k else rows
    return found


def repeated_runs(repeated: DataFrame) -> DataFrame:
    """The longest run from each place that an earlier one begins too: place, length, first.

    ``repeated`` holds the lines that come again with the first place of each (``name``).
    A branch of an interval that is not the interval's first place starts a later copy of
    its common prefix, and agrees with nothing earlier for longer. So every place comes
    once at most.
    """
    found = _intervals(_levels(repeated))
    return found.filter("first != struct(d, h, n)").select(*_PLACE, "length", "first")


def later_copies(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10
) -> tuple[DataFrame, DataFrame]:
    """Per document key (d, h): the number of lines with a word, and the indexes to delete."""
    lines = materialise(gathered(line_table(documents, id_col, text_col).distinct()), "lines")
    repeated = materialise(gathered(_named(lines, ["x", "y"])), "lines-repeated")
    runs = materialise(gathered(repeated_runs(repeated).drop("first")), "line-runs")
    order = Window.partitionBy("d", "h").orderBy("n")
    rows = repeated.drop("name").join(runs, _PLACE, "left").select(
        "d", "h", "n", "i", "length",
        F.lag(F.struct("n", "length")).over(order).alias("before"),
        # A line has a word at least, so these lines hold enough if the run has them all.
        F.collect_list("words").over(order.rowsBetween(0, max(min_words, 1) - 1)).alias("words"),
    )
    inside = (F.col("before.n") == F.col("n") - 1) & (F.col("before.length") > F.col("length"))
    maximal = F.col("length").isNotNull() & ~F.coalesce(inside, F.lit(False))
    words = F.aggregate(F.slice("words", 1, F.col("length")), F.lit(0), lambda a, b: a + b)
    ends = F.when(maximal & (words >= min_words), F.col("n") + F.col("length"))
    rows = rows.select("d", "h", "n", "i", ends.alias("ends"))
    rows = rows.withColumn("ends", F.max("ends").over(order))
    deleted = (
        rows.filter("n < ends").groupBy("d", "h").agg(F.collect_list("i").alias("deleted"))
    )
    return lines.groupBy("d", "h").agg(F.count("*").alias("n_lines")), deleted


def dedup_lines(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10
) -> DataFrame:
    """The documents without later copies of line runs, with n_lines and n_deleted added.

    A run is a number of consecutive lines of one text with ``min_words`` words or more;
    lines without a word do not count and stay. Lines are compared without white space at
    their ends. Every run that starts earlier elsewhere, in the order of id and then of line,
    is deleted where it comes again, also in the same text and where copies overlap.

    NULL ids come first; texts of one id are told apart by a hash, which also orders them;
    rows equal in id and text count as one document and get the same text. A NULL text
    stays NULL, an empty one empty; input columns n_lines and n_deleted are replaced; an
    empty table gives an empty one. A text's own list of lines must fit in memory.
    """
    counts, deleted = later_copies(
        documents, id_col=id_col, text_col=text_col, min_words=min_words
    )
    facts = counts.join(deleted, ["d", "h"], "left").select(
        F.col("d").alias("_llm_d"), F.col("h").alias("_llm_h"),
        F.col("n_lines").alias("_llm_lines"), F.col("deleted").alias("_llm_deleted"),
    )
    key = row_key(id_col, text_col)
    names = [c for c in documents.columns if c not in ("n_lines", "n_deleted")]
    rows = documents.select(
        *[F.col(f"`{c}`") if c != text_col else F.split(F.col(c), "\n").alias(c) for c in names],
        key["d"].alias("_llm_d"), key["h"].alias("_llm_h"),
    )
    rows = rows.join(facts, ["_llm_d", "_llm_h"], "left")
    lines = F.col(f"`{text_col}`")
    gone = F.coalesce("_llm_deleted", F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.when(F.col("_llm_deleted").isNull(), F.array_join(lines, "\n")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    )
    return rows.select(
        *[F.col(f"`{c}`") if c != text_col else text.alias(c) for c in names],
        F.coalesce("_llm_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_deleted"),
    )
