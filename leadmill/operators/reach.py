"""The bounded walk of each site over stored pages, hop by hop for all sites at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadmill.operators.pages import host, own_links
from leadmill.operators.robots import allowed
from leadmill.sources.staging import written


def stored(pages: DataFrame, rules: DataFrame | None, agent: str) -> DataFrame:
    """One row an address (url without fragment; of repeated ones the least page_id, then the least html): site, page_id, html where it may
    be fetched, has_form."""
    rows = pages.withColumn("url", F.regexp_replace("url", r"#.*$", "")).where(host(F.col("url")).isNotNull())
    rows = rows.groupBy("url").agg(F.min(F.struct("page_id", "html")).alias("r")).select("url", "r.*")
    if rules is not None:
        may = allowed(rows, rules, agent)
        rows = rows.join(may.hint("merge"), "page_id").withColumn("html", F.when(F.col("allowed"), F.col("html")))
    has_form = F.coalesce(F.contains(F.lower("html"), F.lit("<form")), F.lit(False))
    return rows.select(host(F.col("url")).alias("site"), "url", "page_id", "html", has_form.alias("has_form"))


def reached(pages: DataFrame, roots: DataFrame | None = None, most: int = 15, others: int = 5, rules: DataFrame | None = None, agent: str = "*") -> DataFrame:
    """What a walk from each site's root visits, in its order: site, url, page_id (null where the page isn't stored), place (from 1), hop,
    has_form. roots(site, url); without them a site begins at its stored page of the least page_id.

    The walk takes addresses in the order of their finding. Of a page it finds the links to its own host that it has not visited by
    then: those that tell of contact, then the first others of the rest. It ends at 2 * most visited addresses or most pages with a form;
    pages that aren't stored, are empty or that the rules forbid count as visited and lead nowhere.

    All addresses of one hop are found from those of the hop before, so a hop is one join of the frontier with the links, one least place an
    address, and numbers on from the site's last place. Only 2 * most rows a site outlive a task, so no site meets whole in one. Each hop
    is a written table; there are at most 2 * most hops, and the loop ends with the first that finds nothing."""
    budget = 2 * most
    base = written(stored(pages, rules, agent), "reach-pages")
    links = written(own_links(base.where("html is not null")).drop("page_id"), "reach-links")
    known = base.select("site", "url", "page_id", "has_form")
    if roots is None:
        roots = known.groupBy("site").agg(F.min_by("url", F.struct("page_id", "url")).alias("url"))
    # the frontier: visited in this hop; n_places, n_forms: the site's counts before it
    begin = roots.select("site", F.regexp_replace("url", r"#.*$", "").alias("url"), F.lit(1).alias("place"), F.lit(0).alias("n_places"), F.lit(0).alias("n_forms"))

    def visits(found: DataFrame, hop: int) -> DataFrame:
        """The addresses that are visited: those before which the site has fewer forms than most."""
        rows = found.hint("merge").join(known, ["site", "url"], "left").withColumn("has_form", F.coalesce("has_form", F.lit(False)))
        before = Window.partitionBy("site").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # at most budget rows a site
        earlier = F.col("n_forms") + F.coalesce(F.sum(F.col("has_form").cast("int")).over(before), F.lit(0))
        return rows.withColumn("earlier", earlier).where(F.col("earlier") < most).select("site", "url", "page_id", "place", F.lit(hop).alias("hop"), "has_form", "earlier")

    visited = frontier = written(visits(begin, 0), "reach")
    for hop in range(1, budget):
        spreads = frontier.where(F.col("earlier") + F.col("has_form").cast("int") < most).select("site", "url", F.col("place").alias("from_place"))
        met = spreads.hint("merge").join(links, "url")
        seen = visited.select("site", F.col("url").alias("target"), F.col("place").alias("seen"))
        new = met.hint("merge").join(seen, ["site", "target"], "left").where(F.col("seen").isNull() | (F.col("seen") > F.col("from_place")))
        rank = F.row_number().over(Window.partitionBy("site", "from_place", "is_priority").orderBy("pos"))
        new = new.withColumn("rank", rank).where(F.col("is_priority") | (F.col("rank") <= others)).where("seen is null")
        first = new.groupBy("site", F.col("target").alias("url")).agg(F.min(F.struct("from_place", ~F.col("is_priority"), "pos")).alias("order"))
        counts = visited.groupBy("site").agg(F.max("place").alias("n_places"), F.count_if("has_form").cast("int").alias("n_forms"))
        number = F.row_number().over(Window.partitionBy("site").orderBy("order"))
        next_ = first.withColumn("number", number).where(F.col("number") <= budget).hint("merge").join(counts, "site")
        next_ = next_.withColumn("place", F.col("n_places") + F.col("number")).where((F.col("place") <= budget) & (F.col("n_forms") < most))
        frontier = written(visits(next_, hop), "reach")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited.select("site", "url", "page_id", F.col("place").cast("long").alias("place"), F.col("hop").cast("long").alias("hop"), "has_form")
