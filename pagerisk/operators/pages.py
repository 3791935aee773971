"""HTML extraction as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagerisk.functions.html import HEADING_LEVELS, page_elements
from pagerisk.operators.batches import batch_contents


def extract(df: DataFrame, fields, html: str = "html", out: str = "page") -> DataFrame:
    """Parse ``html`` once, keep the named fields in a struct and let go of the HTML."""
    return df.withColumn(out, page_elements(F.col(html), fields)).drop(html)


def flat_headings(page: str = "page") -> Column:
    """Title, then headings by level and document order."""
    return F.concat(F.array(f"{page}.title"), F.col(f"{page}.headings.text"))


def headings_of_level(level: str, page: str = "page") -> Column:
    number = HEADING_LEVELS.index(level) + 1
    wanted = F.filter(F.col(f"{page}.headings"), lambda h: h["level"] == number)
    return F.transform(wanted, lambda h: h["text"])


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by white space; empty pieces dropped."""
    return F.array_remove(F.split(text, r"(?<=[.!?])\s+"), "")


def title_table(df: DataFrame, *ids: str, html: str = "html") -> DataFrame:
    return extract(df.select(*ids, html), ["title"], html).select(*ids, "page.title")


def heading_table(df: DataFrame, *ids: str, html: str = "html") -> DataFrame:
    """One row per heading: ids, level, pos, text."""
    parsed = extract(df.select(*ids, html), ["headings"], html)
    return parsed.select(*ids, F.inline("page.headings"))


def link_table(df: DataFrame, *ids: str, html: str = "html") -> DataFrame:
    """One row per anchor: ids, pos, text, href."""
    parsed = extract(df.select(*ids, html), ["links"], html)
    exploded = parsed.select(*ids, F.posexplode("page.links").alias("pos", "link"))
    return exploded.select(*ids, "pos", "link.text", "link.href")


def meta_table(df: DataFrame, *ids: str, html: str = "html") -> DataFrame:
    """One row per meta tag: ids, name, content."""
    parsed = extract(df.select(*ids, html), ["meta"], html)
    return parsed.select(*ids, F.explode("page.meta").alias("name", "content"))


def image_table(df: DataFrame, *ids: str, html: str = "html") -> DataFrame:
    """One row per image: ids, pos, src, alt."""
    parsed = extract(df.select(*ids, html), ["images"], html)
    exploded = parsed.select(*ids, F.posexplode("page.images").alias("pos", "image"))
    return exploded.select(*ids, "pos", "image.src", "image.alt")


def clean_text(df: DataFrame, *ids: str, html: str = "html") -> DataFrame:
    """Visible text and its sentences."""
    parsed = extract(df.select(*ids, html), ["text"], html)
    return parsed.select(*ids, "page.text").withColumn("sentences", sentences(F.col("text")))


def scripts(df: DataFrame, *ids: str, html: str = "html", limit: int | None = None) -> DataFrame:
    """Inline script bodies and script sources, all or the first ``limit`` of each."""
    def some(name):
        values = F.col(f"page.{name}")
        return (values if limit is None else F.slice(values, 1, limit)).alias(name)

    parsed = extract(df.select(*ids, html), ["embedded_scripts", "external_scripts"], html)
    return parsed.select(
        *ids, some("embedded_scripts"), some("external_scripts")
    )


def page_content(df: DataFrame, *ids: str, html: str = "html") -> DataFrame:
    """ids and the content list of title and headings."""
    parsed = extract(df.select(*ids, html), ["title", "headings"], html)
    return parsed.select(*ids, flat_headings().alias("content"))


def content_of_batches(store: DataFrame, batch_ids) -> DataFrame:
    """(url, content) of every page in the given batches."""
    wanted = batch_contents(store, batch_ids)
    return page_content(wanted.filter(F.col("html").isNotNull()), "url")
