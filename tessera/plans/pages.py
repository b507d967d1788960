"""Queries over pages of markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import pages as P
from tessera.operators import segments as S
from tessera.plans.common import query


@query()
def page_segments(spark, read):
    rows = P.page_segments(read("pages"))
    return S.numbered(rows.withColumn("text", F.col("content")), "page_id").select("page_id", "oid", "md5", "name", "ignored")


@query("SELECT page_id, len(regexp_extract_all(html, '<ul><li><a href=')) AS n FROM pages WHERE contains(html, '<ul><li><a href=')")
def page_navigation(spark, read):
    rows = P.page_segments(read("pages"))  # list items are no blocks, so a list of links is one segment
    return rows.filter(F.col("raw").startswith("<ul><li><a href=")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def page_masked(spark, read):
    rows = P.page_segments(read("pages"), ignore=["nav", ".ad"], noise=["script"])
    return rows.filter("not ignored").select("page_id", "seq", F.md5("content").alias("h"), F.size("reserved").alias("n_reserved"))


def _rewrite(position):
    def run(spark, read):
        pages = read("pages")
        done = P.page_segments(pages).filter("not ignored").select("page_id", "seq", F.lower("content").alias("translation"))
        return P.rewrite_pages(pages, done, position=position, lang="xx").select("page_id", F.md5("html").alias("h"), F.length("html").alias("n"))

    run.__name__ = f"page_rewrite_{position}"
    query()(run)


for _p in ("below", "above", "left", "right", "only"):
    _rewrite(_p)
