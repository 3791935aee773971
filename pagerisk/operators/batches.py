"""Batch store semantics: keys, upsert, lookup, dense batch numbering."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagerisk.schemas import PAGE_FIELDS, PAGE_LISTS

BATCH_SIZE = 100
NUMBERING_BLOCK = 65536
FILE_GROUP = 1024
BATCHES_PER_GROUP = 1000


class BatchState(NamedTuple):
    """Where the next new page goes: the last batch and how full it is."""

    last_batch_id: int = 0
    last_item_index: int = 0


def usable(field: str, prefix: str = "") -> Column:
    """Whether a value replaces an older one: present and, for lists, not empty."""
    value = F.col(prefix + field)
    return (F.size(value) > 0) if field in PAGE_LISTS else value.isNotNull()


def document_json(df: DataFrame, fields, out: str = "document") -> DataFrame:
    """The page as a JSON document without its NULL fields."""
    return df.withColumn(out, F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}))


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The whole row with the greatest ``order`` per key; map-side combined, so hot keys are cheap."""
    rest = [name for name in df.columns if name not in keys]
    newest = F.max_by(F.struct(*rest), F.col(order)).alias("__row")
    return df.groupBy(*keys).agg(newest).select(*keys, "__row.*").select(*df.columns)


def fold_updates(df: DataFrame, order: list[str], key: str = "url_key", carry=()) -> DataFrame:
    """Merge many versions of a page into one, field by field, the latest usable value first.

    ``order`` names non-negative integer columns. ``carry`` columns are constant per key.
    Equals applying the versions one by one: the first is stored whole, a later NULL or
    empty list never replaces anything.
    """

    def latest(field: str) -> Column:
        ok = F.coalesce(usable(field), F.lit(False))
        rank = F.struct(ok, *(F.when(ok, F.col(c)).otherwise(-F.col(c)) for c in order))
        return F.max_by(F.col(field), rank).alias(field)

    return df.groupBy(key).agg(
        F.min("url").alias("url"),
        *(latest(field) for field in PAGE_FIELDS if field in df.columns),
        *(F.max(name).alias(name) for name in carry),
    )


def merge_pages(store: DataFrame, updates: DataFrame, key: str = "url_key") -> DataFrame:
    """Upsert one row per key into the store: insert whole rows, merge existing ones by field."""
    fields = [f for f in PAGE_FIELDS if f in store.columns]
    other = [c for c in store.columns if c not in (key, "url", *fields)]
    old, new = store.alias("old"), updates.alias("new")
    inserted = F.col(f"old.{key}").isNull()

    def merged(field: str) -> Column:
        replace = inserted | F.coalesce(usable(field, "new."), F.lit(False))
        return F.when(replace, F.col(f"new.{field}")).otherwise(F.col(f"old.{field}")).alias(field)

    return old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer").select(
        F.coalesce(f"old.{key}", f"new.{key}").alias(key),
        F.coalesce("old.url", "new.url").alias("url"),
        *(merged(field) for field in fields),
        *(
            F.coalesce(f"old.{c}", f"new.{c}").alias(c) if c in updates.columns else F.col(f"old.{c}")
            for c in other
        ),
    )


def classify_new_existing(updates: DataFrame, lookup: DataFrame, key: str = "url_key") -> DataFrame:
    """Every update with the batch it already sits in, NULL for a new page."""
    known = lookup.select(key, F.col("batch_id").alias("existing_batch_id"))
    joined = updates.join(known, key, "left")
    return joined.withColumn("is_new", F.col("existing_batch_id").isNull())


def new_pages(updates: DataFrame, lookup: DataFrame, key: str = "url_key") -> DataFrame:
    return updates.join(lookup.select(key), key, "left_anti")


def existing_pages(updates: DataFrame, lookup: DataFrame, key: str = "url_key") -> DataFrame:
    return updates.join(lookup.select(key, "batch_id"), key, "inner")


def dense_index(
    df: DataFrame, file_no: str, record_no: str, out: str = "item_no", ties: tuple[str, ...] = ()
) -> DataFrame:
    """Number the rows 0, 1, 2, ... in (file, record) order without one global sort.

    Records are cut into blocks of a fixed span, so the window over the rows never sees more
    of them than a block holds however large a file is. Block offsets come from the small
    count table: running sums within a group of files, and over the totals of the groups.
    (file, record) must be unique, or together with the columns ``ties``.
    """
    blocked = df.withColumn("__block", F.expr(f"{record_no} div {NUMBERING_BLOCK}"))
    counts = (
        blocked.groupBy(file_no, "__block")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__group", F.expr(f"{file_no} div {FILE_GROUP}"))
    )

    def before(window) -> Column:
        rows = window.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("__n").over(rows), F.lit(0))

    in_group = counts.withColumn(
        "__b", before(Window.partitionBy("__group").orderBy(file_no, "__block"))
    )
    groups = counts.groupBy("__group").agg(F.sum("__n").alias("__n"))
    offsets = in_group.join(
        groups.select("__group", before(Window.orderBy("__group")).alias("__g")), "__group"
    ).select(file_no, "__block", (F.col("__b") + F.col("__g")).alias("__offset"))
    in_block = F.row_number().over(Window.partitionBy(file_no, "__block").orderBy(record_no, *ties))
    return (
        blocked.withColumn("__rn", in_block)
        .join(offsets, [file_no, "__block"])
        .withColumn(out, F.col("__offset") + F.col("__rn") - 1)
        .select(*df.columns, out)
    )


def assign_batches(
    new_rows: DataFrame,
    state: BatchState = BatchState(),
    file_no: str = "file_idx",
    record_no: str = "record_no",
    batch_size: int = BATCH_SIZE,
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """Fill the open batch first, then open new ones, in arrival order."""
    base = state.last_batch_id if state.last_item_index > 0 else state.last_batch_id + 1
    numbered = dense_index(new_rows, file_no, record_no, "__item", ties)
    slot = F.floor((F.col("__item") + state.last_item_index) / batch_size)
    return numbered.withColumn("batch_id", (slot + base).cast("int")).drop("__item")


def next_state(
    counted: DataFrame,
    state: BatchState = BatchState(),
    n_new: str = "n_new",
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """The progress row after ``n_new`` inserted pages, from a one-row count table."""
    b, i = state
    base = b if i > 0 else b + 1
    n = F.col(n_new)
    total = n + i
    full = F.floor(total / batch_size)
    rest = total % batch_size
    last_id = F.when(n == 0, F.lit(b)).when(rest == 0, full + base - 1).otherwise(full + base)
    index = F.when(n == 0, F.lit(i)).otherwise(rest)
    return counted.select(
        last_id.cast("int").alias("last_batch_id"),
        index.cast("int").alias("last_item_index"),
        F.current_timestamp().alias("updated_at"),
    )


def upsert_lookup(lookup: DataFrame, updates: DataFrame, seq: str = "seq") -> DataFrame:
    """Set the batch per key; the later operation wins. ``seq`` of updates is positive."""
    tagged = lookup.select("url_key", "batch_id", F.lit(0).cast("long").alias(seq)).unionByName(
        updates.select("url_key", "batch_id", F.col(seq).cast("long"))
    )
    return tagged.groupBy("url_key").agg(F.max_by("batch_id", seq).alias("batch_id"))


def lookup_batches(keys: DataFrame, lookup: DataFrame) -> DataFrame:
    """key -> batch for the keys that are known."""
    wanted = keys.select("url_key").distinct()
    return wanted.join(lookup.select("url_key", "batch_id"), "url_key", "inner")


def batch_contents(store: DataFrame, batch_ids) -> DataFrame:
    """Pages of the requested batches; a missing batch gives one row of NULLs."""
    ids = [int(i) for i in dict.fromkeys(batch_ids)]
    wanted = store.filter(F.col("batch_id").isin(ids))
    if "batch_group" in store.columns:
        wanted = wanted.filter(
            F.col("batch_group").isin(sorted({i // BATCHES_PER_GROUP for i in ids}))
        )
    requested = store.sparkSession.createDataFrame([(i,) for i in ids], "batch_id int")
    return requested.join(wanted, "batch_id", "left")


def last_batch_id(store: DataFrame) -> DataFrame:
    return store.agg(F.coalesce(F.max("batch_id"), F.lit(0)).alias("last_batch_id"))


def count_batches(store: DataFrame) -> DataFrame:
    return store.agg(F.count_distinct("batch_id").alias("batches"))
