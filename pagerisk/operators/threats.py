"""URL checks against phishing feeds and threat lists, and the combined verdict."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pagerisk.functions.fuzzy import (
    LONGEST, MOST_INDEXED, NEAR_PAIRS, PIECE, PIECE_BUCKETS, PieceMatcher, Sketches, UrlSearch,
    indexable, rare_pieces_each, reach_around, url_similarity,
)
from pagerisk.operators.blocks import (
    BLOCK_BYTES, BROADCAST_BYTES, CELL_ROWS, compare_in_bands, compare_in_cells,
)
from pagerisk.operators.urls import clean_url
from pagerisk.session import materialise, spread

# Threat types of the public threat-list interface. Fixed values.
UNSPECIFIED = "THREAT_TYPE_UNSPECIFIED"
HARMFUL_TYPES = (
    "SOCIAL_ENGINEERING",
    "MALWARE",
    "UNWANTED_SOFTWARE",
    "POTENTIALLY_HARMFUL_APPLICATION",
)
THREAT_TYPES = (UNSPECIFIED, *HARMFUL_TYPES)

THREAT_THRESHOLD = 2
PHISH_RATIO = 90
# Per feed URL in a task: its text, its character counts, object overhead.
_FEED_ROW_BYTES = 512


def compare_urls(a: Column, b: Column, min_ratio: int) -> Column:
    """Whether two URL columns are at least ``min_ratio`` alike."""
    return url_similarity(a, b) >= min_ratio


def exact_feed_matches(urls: DataFrame, feed: DataFrame, url: str = "clean_url") -> DataFrame:
    """The rows whose cleaned URL stands in the feed as it is."""
    return urls.join(feed.select(F.col("url").alias(url)), url, "left_semi")


def similar_urls(
    urls: DataFrame,
    feed: DataFrame,
    min_ratio: int = PHISH_RATIO,
    url: str = "clean_url",
    out: str = "phishing_trace",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Whether each URL is at least ``min_ratio`` alike to any feed URL; distinct feed expected.

    The feed's bytes are measured. Within the bound it is broadcast and each task searches
    it. Beyond, distinct URLs that do not stand in the feed as they are first try the feed URLs
    next to them in order (see ``reached_in_order``), which settles most that have a partner. Those
    still open meet the feed URLs with which they share a rare piece (see ``compare_by_pieces``).
    Feed URLs without room for such pieces, being very short, very long, or sought at a low ratio,
    meet all open URLs of comparable length instead, block by block. No pair leaves a task.
    """
    spark = urls.sparkSession
    feed = materialise(feed.select("url").filter(F.col("url").isNotNull()), "feed")
    length = F.length("url")
    indexed = _indexable(length, min_ratio)
    measured = feed.agg(
        F.sum(_FEED_ROW_BYTES + 4 * length).alias("bytes"),
        F.count_if(indexed).alias("indexed"),
        F.count_if(~indexed).alias("others"),
    ).first()
    if (measured.bytes or 0) <= broadcast_bytes:
        listed = feed.toArrow().column("url").to_pylist()
        shared = spark.sparkContext.broadcast(UrlSearch(listed, min_ratio))

        @F.arrow_udf("boolean")
        def search(batch: pa.Array) -> pa.Array:
            return pa.array(shared.value.matches_each(batch.to_pylist()), type=pa.bool_())

        return urls.withColumn(out, search(F.col(url)))

    if 201 - 2 * min_ratio >= 200:
        raise ValueError("a ratio that any two strings reach needs no search")
    distinct = urls.select(url).filter(F.col(url).isNotNull()).distinct()
    in_feed = feed.select(F.col("url").alias(url), F.lit(True).alias("__exact"))
    checked = materialise(distinct.join(in_feed, url, "left"), "distinct-urls")
    hits = checked.filter("__exact").select(url)
    rest = checked.filter("__exact IS NULL").select(url)
    reached = materialise(reached_in_order(rest, feed, min_ratio, url), "reached-urls")
    hits = hits.union(reached)
    rest = materialise(rest.join(reached, url, "left_anti"), "open-urls")
    if measured.indexed:
        found = compare_by_pieces(rest, feed, min_ratio, url)
        hits = hits.union(found.filter("hit").select(url))
    if measured.others:
        hits = hits.union(
            _compare_by_length(rest, feed.filter(~indexed), min_ratio, url, broadcast_bytes)
        )
    marked = urls.join(hits.distinct().withColumn(out, F.lit(True)), url, "left")
    known = F.when(F.col(url).isNotNull(), F.coalesce(F.col(out), F.lit(False)))
    return marked.select(*urls.columns, known.alias(out))


def _indexable(length: Column, min_ratio: int) -> Column:
    """``fuzzy.indexable`` of a column of lengths."""
    able = [n for n in range(1, MOST_INDEXED + 1) if indexable(n, min_ratio)]
    return length.isin(able) if able else F.lit(False)


def reached_in_order(urls: DataFrame, feed: DataFrame, min_ratio: int, url: str) -> DataFrame:
    """Those of distinct URLs that reach a feed URL next to them in the order of all, or of the reverses.

    A URL that is not among them may still have a partner elsewhere. An Arrow batch of ordered
    rows is looked at alone.
    """
    asked = urls.select(F.col(url).alias("text"), F.lit(True).alias("asked"))
    both = asked.union(feed.select("url", F.lit(False))).filter(F.length("text") <= LONGEST)
    sides = [F.struct(F.lit(i).alias("side"), t.alias("text")) for i, t in enumerate((F.col("text"), F.reverse("text")))]
    placed = both.select("asked", F.explode(F.array(*sides)).alias("key")).select("asked", "key.*")
    ordered = placed.repartitionByRange("side", "text").sortWithinPartitions("side", "text")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sides = batch.column("text").to_pylist(), batch.column("side").to_pylist()
            texts = [text[::-1] if side else text for text, side in zip(texts, sides)]
            is_asked = batch.column("asked").to_numpy(zero_copy_only=False)
            mine, others = np.flatnonzero(is_asked), np.flatnonzero(~is_asked)
            own, listed = ([texts[i] for i in numbers.tolist()] for numbers in (mine, others))
            order, places = np.arange(len(listed)), np.searchsorted(others, mine)
            hit = reach_around(own, listed, order, places, min_ratio, Sketches(listed))
            found = pa.array(own, type=pa.string()).filter(pa.array(hit))
            yield pa.record_batch([found], names=[url])

    return ordered.mapInArrow(reach, f"{url} string").distinct()


def _compare_by_length(
    rest: DataFrame, feed: DataFrame, min_ratio: int, url: str, broadcast_bytes: int
) -> DataFrame:
    """The URLs that any of the feed URLs matches, by comparing all of comparable length."""

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = left.column(url)
        found = UrlSearch(right.column("url").to_pylist(), min_ratio).matches_each(texts.to_pylist())
        return pa.table({url: texts.filter(pa.array(found, type=pa.bool_()))})

    # Lengths a and b allow the ratio only if |a - b| <= indels * (a + b).
    indels = (201 - 2 * min_ratio) / 200
    ratio = (1 + indels) / (1 - indels) * (1 + 1e-9)
    block_bytes = min(BLOCK_BYTES, broadcast_bytes)
    return compare_in_bands(
        rest, url, feed, "url", ratio, _FEED_ROW_BYTES, block_bytes, compare, f"{url} string"
    )


def compare_by_pieces(
    urls: DataFrame,
    feed: DataFrame,
    min_ratio: int = PHISH_RATIO,
    url: str = "clean_url",
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Rows (url, hit, compared) of distinct URLs that share a rare piece with a feed URL.

    Every feed URL gives as many pieces as a partner may have insertions and deletions, and one
    more, so any partner holds one of them unchanged and near its place. Of all such sets the
    one whose pieces are rarest among the URLs is taken, so what all URLs share, like scheme and
    popular hosts, leads to nothing. Pieces are counted in a fixed number of buckets. URLs
    whose piece, length and character counts agree are compared in full, until one matches;
    ``compared`` says how often.
    """
    spark = urls.sparkSession
    change = 201 - 2 * min_ratio
    # A longer URL has no indexed partner.
    longest = MOST_INDEXED * (200 + change) // (200 - change)
    able = urls.filter(F.length(url).between(PIECE, longest))
    places = F.sequence(F.lit(0), F.length(url) - PIECE)
    pieces = F.transform(places, lambda i: F.struct(_bucket(url, i).alias("bucket"), i.alias("at")))
    lefts = able.select(F.col(url).alias("text"), F.explode(pieces).alias("p"))
    lefts = lefts.select("p.bucket", "p.at", "text")
    left_counts = _bucket_counts(lefts)
    schema = f"{url} string, hit boolean, compared long"
    if not left_counts.any():
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(left_counts)
    fields = [("bucket", pa.int64()), ("at", pa.int32()), ("before", pa.list_(pa.int32()))]

    @F.arrow_udf("array<struct<bucket:bigint,at:int,before:array<int>>>")
    def rarest(batch: pa.Array) -> pa.Array:
        chosen = []
        for pieces in rare_pieces_each(batch.to_pylist(), shared.value, min_ratio):
            places = [at for _, at in pieces]
            chosen.append(
                [{"bucket": b, "at": i, "before": places[:n]} for n, (b, i) in enumerate(pieces)]
            )
        return pa.array(chosen, type=pa.list_(pa.struct(fields)))

    feed = feed.filter(_indexable(F.length("url"), min_ratio))
    # The feed is a small file, but its pieces take long.
    rights = spread(feed).select(F.col("url").alias("text"), F.explode(rarest(F.col("url"))).alias("p"))
    rights = materialise(rights.select("p.*", "text"), "feed-pieces")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        sides = [_numbered(table) for table in (left, right)]
        matcher = PieceMatcher(sides[0][0], sides[1][0], min_ratio)
        both = np.intersect1d(sides[0][1], sides[1][1])
        lows, ends = (
            np.stack([np.searchsorted(buckets, both, side) for _, buckets, *_ in sides])
            for side in ("left", "right")
        )
        crowd = np.argsort(ends[1] - lows[1], kind="stable")
        lows, sizes = lows[:, crowd], (ends - lows)[:, crowd]
        before = right.column("before").combine_chunks()
        # Pieces with few pairs are met many at a time.
        pairs = sizes[0] * sizes[1]
        few = pairs < NEAR_PAIRS // 16
        for group in np.split(np.flatnonzero(few), _portions(pairs[few], NEAR_PAIRS)):
            own = np.repeat(group, pairs[group])
            place = np.arange(len(own)) - np.repeat(np.cumsum(pairs[group]) - pairs[group], pairs[group])
            mine, others = lows[0][own] + place // sizes[1][own], lows[1][own] + place % sizes[1][own]
            parts = [part[rows] for side, rows in zip(sides, (mine, others)) for part in side[2:4]]
            numbers = sides[1][4][others]
            matcher.meet_each(*parts, lambda i: before[int(numbers[i])].as_py())
        for piece in np.flatnonzero(~few).tolist():
            spans = [slice(low, low + size) for low, size in zip(lows[:, piece], sizes[:, piece])]
            parts = [part[span] for side, span in zip(sides, spans) for part in side[2:4]]
            matcher.meet(*parts, before.take(pa.array(sides[1][4][spans[1]])).to_pylist())
        some = np.flatnonzero(matcher.compared)
        texts = pa.array(sides[0][0], type=pa.string()).take(pa.array(some))
        found = [texts, pa.array(matcher.hit[some]), pa.array(matcher.compared[some])]
        return pa.table(found, names=[url, "hit", "compared"])

    return compare_in_cells(
        lefts, left_counts, rights, _bucket_counts(rights), "bucket", compare, schema, cell_rows
    )


def _bucket(url: str, place: Column) -> Column:
    piece = F.substring(F.col(url), place + 1, F.lit(PIECE))
    return F.crc32(piece.cast("binary")) % PIECE_BUCKETS


def _bucket_counts(rows: DataFrame) -> np.ndarray:
    """Rows of each bucket; their number is fixed."""
    counts = np.zeros(PIECE_BUCKETS, np.int64)
    for row in rows.groupBy("bucket").count().collect():
        counts[row["bucket"]] = row["count"]
    return counts


def _portions(sizes: np.ndarray, most: int) -> np.ndarray:
    """Where to cut a list so that the sizes of a portion come to about ``most``."""
    return np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1


def _numbered(rows: pa.Table) -> tuple:
    """Distinct texts; then bucket, number of the text, place and number of each row, by bucket."""
    texts = rows.column("text").combine_chunks().dictionary_encode()
    buckets = rows.column("bucket").to_numpy()
    order = np.argsort(buckets, kind="stable")
    numbers = texts.indices.to_numpy()[order]
    places = rows.column("at").to_numpy()[order]
    return texts.dictionary.to_pylist(), buckets[order], numbers, places, order


def phishing_trace(
    urls: DataFrame,
    feed: DataFrame,
    min_ratio: int = PHISH_RATIO,
    url: str = "url",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Clean the URLs and flag those close to any (cleaned) feed URL."""
    cleaned = clean_url(urls, url, "clean_url")
    return similar_urls(cleaned, feed, min_ratio, broadcast_bytes=broadcast_bytes)


def threat_counts(matches: DataFrame, url: str = "url") -> DataFrame:
    """Matches per URL and known threat type; other types are not counted.

    One partial aggregation, so a URL with very many matches costs no more than others.
    """
    return matches.groupBy(url).agg(
        *(F.count_if(F.col("threat_type") == t).alias(t.lower()) for t in THREAT_TYPES)
    )


def threat_verdict(
    urls: DataFrame, matches: DataFrame, threshold: int = THREAT_THRESHOLD, url: str = "url"
) -> DataFrame:
    """Per URL: is_clickbait, is_payfraud, is_harmful; NULL where the check failed."""
    failed = (
        F.max(F.col("error").isNotNull()) if "error" in matches.columns else F.lit(False)
    ).alias("__failed")
    counts = matches.groupBy(url).agg(
        *(F.count_if(F.col("threat_type") == t).alias(f"__{t}") for t in THREAT_TYPES), failed
    )
    joined = urls.join(counts, url, "left")

    def flag(hit: Column) -> Column:
        checked = ~F.coalesce(F.col("__failed"), F.lit(False))
        return F.when(checked, F.coalesce(hit, F.lit(False)))

    unspecified = flag(F.col(f"__{UNSPECIFIED}") >= threshold)
    harmful = flag(F.greatest(*(F.col(f"__{t}") for t in HARMFUL_TYPES)) >= threshold)
    return joined.select(
        *urls.columns,
        unspecified.alias("is_clickbait"),
        unspecified.alias("is_payfraud"),
        harmful.alias("is_harmful"),
    )


def multi_label_verdict(
    urls: DataFrame,
    labels: DataFrame,
    phishing: DataFrame,
    threats: DataFrame,
    url: str = "url",
) -> DataFrame:
    """Combine page labels, phishing traces and threat flags into one verdict per URL.

    clickbait = page label or threat flag; payfraud = threat flag or phishing trace;
    harmful = threat flag. Repeated rows of a URL are combined first, on every side: a flag
    is true if it is in any of them. A URL that a side does not hold counts as false there.
    A NULL threat flag is a failed check and stays unknown: it gives true with a true
    partner and NULL otherwise, and the verdict names what is known to be true.
    """

    def combined(rows: DataFrame, **flags: Column) -> DataFrame:
        """One row per URL: true if any flag is, else NULL if any is NULL, else false."""
        flagged = rows.select(url, *(flag.alias(name) for name, flag in flags.items()))
        unknown = lambda name: F.count_if(F.col(name).isNull()) > 0
        return flagged.groupBy(url).agg(
            *(
                F.when(F.max(name), True)
                .when(unknown(name), F.lit(None))
                .otherwise(False)
                .alias(name)
                for name in flags
            ),
            F.lit(True).alias(f"__{next(iter(flags))}"),
        )

    def yes(column: Column) -> Column:
        return F.coalesce(column, F.lit(False))

    checks = ("is_clickbait", "is_payfraud", "is_harmful")
    joined = (
        urls.dropDuplicates([url])
        .join(combined(labels, labelled=yes(F.col("label") == 1)), url, "left")
        .join(combined(phishing, traced=yes(F.col("phishing_trace"))), url, "left")
        .join(combined(threats, **{name: F.col(name) for name in checks}), url, "left")
    )

    def checked(name: str) -> Column:
        return F.when(F.col("__is_clickbait"), F.col(name)).otherwise(F.lit(False))

    flags = joined.select(
        *urls.columns,
        (yes(F.col("labelled")) | checked("is_clickbait")).alias("clickbait"),
        (checked("is_payfraud") | yes(F.col("traced"))).alias("payfraud"),
        checked("is_harmful").alias("harmful"),
    )
    named = [F.when(F.col(n), n) for n in ("clickbait", "payfraud", "harmful")]
    return flags.withColumn("verdict", F.array_compact(F.array(*named)))
