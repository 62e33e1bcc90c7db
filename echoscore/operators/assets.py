"""Quoted asset paths in pages: which exist, and pages with their links rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from echoscore.functions import text as T


def _pattern(attribute: str) -> str:
    return rf'{attribute}="([^"]*)"'


def asset_links(pages: DataFrame, page_id: str = "page_id", html: str = "html", attribute: str = "src") -> DataFrame:
    """(page_id, pos, encoded, path): every quoted attribute value in page order."""
    found = F.regexp_extract_all(F.col(html), F.lit(_pattern(attribute)), F.lit(1))
    links = pages.select(page_id, F.posexplode(found).alias("pos", "encoded"))
    return links.withColumn("path", T.url_unquote(F.col("encoded")))


def _new_link(folder: str) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), T.url_quote(T.basename(F.col("path"))))


def asset_manifest(pages: DataFrame, assets: DataFrame, folder: str = "audio", **where: str) -> DataFrame:
    """Files to copy: (path, new_link, n_links) for every linked path that exists.

    Links are counted per path before they meet the asset table, so a path linked from very many
    pages is one row in the join.
    """
    links = asset_links(pages, **where).where(F.col("encoded") != "")
    counted = links.groupBy("path").agg(F.count(F.lit(1)).alias("n_links"))
    return counted.join(assets.select("path").distinct(), "path", "left_semi").withColumn("new_link", _new_link(folder))


def rewrite_pages(
    pages: DataFrame, assets: DataFrame, folder: str = "audio", page_id: str = "page_id", html: str = "html",
    attribute: str = "src",
) -> DataFrame:
    """Pages with links to known assets pointing into ``folder``; other links stay.

    Distinct paths meet the asset table first. The known ones (path, new link) go back to the links
    and only (page, position, new link) is regrouped per page; html text is not exploded.
    """
    links = asset_links(pages, page_id, html, attribute).where(F.col("encoded") != "")
    known = links.select("path").distinct().join(assets.select("path").distinct(), "path", "left_semi")
    known = known.withColumn("new_link", _new_link(folder))
    changes = (
        links.join(known, "path")
        .groupBy(page_id)
        .agg(F.map_from_entries(F.collect_list(F.struct("pos", "new_link"))).alias("_changes"))
    )
    joined = pages.join(changes, page_id, "left")
    pattern = _pattern(attribute)
    # n links cut the page into n + 1 pieces; a piece is followed by its link, old or new
    pieces = F.split(F.col(html), pattern)
    values = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))
    links_out = F.transform(
        values,
        lambda old, i: F.concat(
            F.lit(f'{attribute}="'), F.coalesce(F.try_element_at(F.col("_changes"), i), old), F.lit('"')
        ),
    )
    woven = F.array_join(
        F.transform(pieces, lambda piece, i: F.concat(piece, F.coalesce(F.get(F.col("_links"), i), F.lit("")))), ""
    )
    rewritten = F.when(F.col("_changes").isNull(), F.col(html)).otherwise(woven)
    return joined.withColumn("_links", links_out).withColumn(html, rewritten).drop("_changes", "_links")
