"""Line dedup by site-relative frequency.

Pages are grouped by host; the pages that hold a line, divided by the pages of its host, are the line's ratio there.
Lines over the boilerplate ratio are dropped from the pages of that host. All of it is DataFrame code: lines move as
128-bit hashes, counts are summed in each task before the shuffle, and the texts move once, to meet the few lines that
they lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import split_join

#: A line of one page alone is that page's; from two pages on the ratio decides.
RATIO, MIN_PAGES = 0.05, 2
_BLANK = r"^[\x20\x09-\x0D]*$"


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2"))


def drop_site_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, max_loss: float | None = None, per_text: bool = False, names: tuple[str, str] = ("_n_lines", "_n_dropped")) -> DataFrame:
    """All columns of pages, their text without boilerplate lines, and two columns called `names`: the lines that a page
    has, and those that it lost.

    A line (between \\n; compared byte by byte) is boilerplate on a host if more than `ratio` of the host's pages and at
    least `min_pages` of them hold it, however often each does. Lines of white space alone are never dropped. With
    max_loss, a page that would lose more than that share of its other lines is left as it is: it is a copy of other
    pages and not a page with boilerplate. A null text is empty and stays null unless lines go (none can); a null
    host is the host ''. Rows that repeat count as pages each; with per_text, rows of a host with equal texts count as one
    page, so copies of a text don't make its lines boilerplate. Columns of any name are carried along but those of
    `names`, which are replaced.
    """
    n_lines, n_dropped = names
    carried = [c for c in pages.columns if c not in names]
    body, site = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(host).cast("string"), F.lit(""))
    keys = [F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(7), body).alias("k2"), site.alias("host")]
    lines = pages.select(*keys, F.filter(F.split(body, "\n"), lambda x: ~x.rlike(_BLANK)).alias("lines"))
    lines = lines.select("host", "k1", "k2", F.array_distinct(F.transform("lines", _hash)).alias("hs"))
    counted = pages.select(site.alias("host"))
    if per_text:
        lines = lines.groupBy("host", "k1", "k2").agg(F.first("hs").alias("hs"))
        counted = pages.select(*keys).distinct()
    lines = lines.select("host", "k1", "k2", F.explode("hs").alias("h")).select("host", "k1", "k2", "h.h1", "h.h2")
    totals = counted.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = lines.groupBy("host", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    common = split_join(counts, totals, ["host"]).filter(F.col("n") > F.lit(float(ratio)) * F.col("pages")).select("host", "h1", "h2")
    # what each distinct text of a host loses: no more entries than the text has lines
    losses = split_join(lines, common, ["host", "h1", "h2"]).groupBy("host", "k1", "k2").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    page = pages.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("page"), *keys)
    both = split_join(page, losses, ["host", "k1", "k2"], "left")
    body = F.coalesce(F.col("page").getField(text), F.lit(""))
    both = both.select("page", "gone", F.split(body, "\n").alias("lines"))
    both = both.select("page", "lines", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: x.rlike(_BLANK) | ~F.array_contains(F.col("gone"), _hash(x)))).alias("kept"))
    gone = F.size("lines") - F.size("kept")
    if max_loss is not None:
        solid = F.size(F.filter("lines", lambda x: ~x.rlike(_BLANK)))
        both = both.select("page", "lines", F.when(gone > max_loss * solid, F.col("lines")).otherwise(F.col("kept")).alias("kept"))
    new_text = F.when(gone > 0, F.array_join("kept", "\n")).otherwise(F.col("page").getField(text))
    return both.select(*[(new_text if c == text else F.col("page").getField(c)).alias(c) for c in carried], F.size("lines").cast("long").alias(n_lines), gone.cast("long").alias(n_dropped))
