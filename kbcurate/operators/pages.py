"""Operators over fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kbcurate.functions import text as X


def page_texts(pages: DataFrame, bare: bool = True) -> DataFrame:
    """(page_id, url, text, error): readable text, INVALID_CONTENT where there is none. References
    without a semicolon are decoded where HTML does, unless ``bare`` is off."""
    return pages.select("page_id", "url", X.page_text(F.col("html"), bare).alias("text")).withColumn(
        "error", F.when(F.coalesce("text", F.lit("")) == "", "INVALID_CONTENT")
    )


def permanent_urls(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", X.permanent_url(F.col("html")).alias("permanent_url"))


def source_outcomes(fetches: DataFrame) -> DataFrame:
    """Final state of sources ``(source_id, fetch_error, http_status_code, html, failed)``: a fetch
    error keeps its kind (and code), no readable text is invalid content, a failure afterwards is
    a fault of our own. All are done."""
    blank = F.coalesce(X.page_text(F.col("html")), F.lit("")) == ""
    error = (
        F.when(F.col("fetch_error").isNotNull(), F.col("fetch_error"))
        .when(blank, "INVALID_CONTENT")
        .when(F.coalesce("failed", F.lit(False)), "PIPELINE_ERROR")
    )
    return fetches.select(
        "source_id", F.lit("DONE").alias("status"), error.alias("error"),
        F.when(F.col("fetch_error").isNotNull(), F.col("http_status_code")).alias("http_status_code"),
    )


#: Needles searched in a page at once, about.
NEEDLES = 64


def verify_quotes(references: DataFrame, pages: DataFrame) -> DataFrame:
    """Occurrences of each quote in its source's page ``(source_id, html)``: number of
    non-overlapping hits and place of the first (1-based, 0 without).

    Only pages that are quoted are read for their text, each once. Copies of a quote are
    searched once per page, and the quotes of a page together, in groups of about ``NEEDLES``, so a page
    with very many quotes is a few dozen rows a thousand quotes and no hot key.
    """
    quoted = references.select("property_id", "source_id", F.explode("supporting_quotes").alias("quote"))
    wanted = quoted.select("source_id", "quote").distinct().withColumn("needle", X.needle(F.col("quote")))
    wanted = wanted.where(F.col("needle") != "")
    counts = wanted.groupBy("source_id").agg(F.ceil(F.count(F.lit(1)) / NEEDLES).alias("groups"))
    asked = (
        wanted.join(counts, "source_id")
        .groupBy("source_id", F.pmod(F.xxhash64("quote"), "groups").alias("part"))
        .agg(F.collect_list(F.struct("quote", "needle")).alias("asks"))
    )
    streams = pages.join(counts.select("source_id"), "source_id", "left_semi").select(
        "source_id", X.quote_stream(F.col("html")).alias("stream")
    )
    search = X.quote_hits()
    found = (
        asked.join(streams, "source_id")
        .select("source_id", F.col("asks.quote").alias("quote"), search("stream", F.col("asks.needle")).alias("found"))
        .select("source_id", F.inline(F.arrays_zip("quote", "found")))
        .select("source_id", "quote", "found.hits", "found.first_at").where("hits > 0")
    )
    return quoted.join(found, ["source_id", "quote"], "left").select(
        "property_id", "source_id", "quote", F.coalesce("hits", F.lit(0)).alias("hits"),
        F.coalesce("first_at", F.lit(0)).alias("first_at"),
    )


def infobox_births(pages: DataFrame) -> DataFrame:
    """Birth fields of the first infobox of wikitext pages ``(page_id, wikitext)``.

    The fields go through a generator, past which no filter is pushed, so a page is split once.
    """
    return (
        pages.select("page_id", F.inline(F.array(X.births(F.col("wikitext")))))
        .where("found").drop("found")
        .withColumn("birth_date_parsed", X.birth_date_parsed(F.col("birth_date")))
    )


def page_urls(titles: DataFrame) -> DataFrame:
    """Addresses of pages ``(site, title)`` in active editions."""
    return titles.select("site", "title", X.page_url(F.col("site"), F.col("title")).alias("url")).where(
        F.col("url").isNotNull()
    )
