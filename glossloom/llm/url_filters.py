"""URL filters: list entries dated by when they came and went, and captures judged as of when they were fetched.

A list's history has a row for each change: the list, the kind of entry (`url`,
`prefix`, `host` or `domain`), its value, the action (`add` or `remove`) and
since when. Changes of one entry become validity intervals [since, until). A
capture asks for the keys that could hold it: its URL, each prefix of its path
that ends at a slash, its host, and the domains above the host; an equality
join on kind and value and a comparison of times find all entries active at
fetch time. Only as many steps and characters of a path, and labels of a host,
are looked at as some entry has; so a URL's keys are bounded by the list, not
by the URL. Where the list is too long to broadcast, a key that very many
captures have is split by adaptive execution, as the list's side has one row
for an entry and interval.

Results: values and hosts are compared in lower case, without port or user; a
host in brackets is a host like others and has no domains above it. A prefix is
host and path. A capture without URL, without host in it, or without
fetch time matches nothing and stays. A change without list, kind, value or
time is ignored. Of several changes of one entry at one moment a removal wins;
adding twice, or removing what is not there, changes nothing. Each row of
captures gives one row. Empty tables give what follows from that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

KINDS = ("url", "prefix", "host", "domain")
#: A list of at most this many intervals is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 100_000
_REST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?"


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, _REST + r"(\[[^\]/?#]*\]|[^/?#:@\[\]]+)", 1))
    return F.when(found != "", found)


def path_of(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_extract(url, _REST + r"[^/?#]*([^?#]*)", 1)


def intervals(changes: DataFrame) -> DataFrame:
    """list, kind, value, since, until (null: still active) of each time that an entry was active."""
    rows = changes.select("list", "kind", F.lower("value").alias("value"), "action", "since").dropna(subset=["list", "kind", "value", "since"])
    entry = ["list", "kind", "value"]
    # a removal wins at one moment
    rows = rows.groupBy(*entry, "since").agg(F.min(F.when(F.col("action") == "add", 1).otherwise(0)).alias("on"))
    by = Window.partitionBy(*entry).orderBy("since")
    rows = rows.withColumn("was", F.coalesce(F.lag("on").over(by), F.lit(0))).where("on <> was")
    return rows.withColumn("until", F.lead("since").over(by)).where("on = 1").select(*entry, "since", "until")


def sizes_of(active: DataFrame) -> Row:
    """What bounds a URL's keys: least and most labels of a domain entry, most slashes and characters of a prefix."""
    labels, slashes = F.size(F.split("value", r"\.")), F.size(F.split("value", "/")) - 1
    domain, prefix = F.col("kind") == "domain", F.col("kind") == "prefix"
    return active.agg(F.min(F.when(domain, labels)).alias("least"), F.max(F.when(domain, labels)).alias("most"), F.max(F.when(prefix, slashes)).alias("deepest"), F.max(F.when(prefix, F.length("value"))).alias("longest")).first()


def keys_of(url: Column, sizes: Row) -> Column:
    """All (kind, value) under which an entry of a list of such sizes could hold the URL."""
    host = host_of(url)
    parts = [F.array(F.struct(F.lit("url").alias("kind"), F.lower(url).alias("value")), F.struct(F.lit("host").alias("kind"), host.alias("value")))]
    if sizes.most is not None:
        labels = F.when(host.startswith("["), F.array(host)).otherwise(F.split(host, r"\."))
        counts = F.sequence(F.lit(sizes.least), F.least(F.size(labels), F.lit(sizes.most)))
        domains = F.transform(counts, lambda n: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".").alias("value")))
        parts.append(F.when(F.size(labels) >= sizes.least, domains).otherwise(F.array_remove(domains, domains[0])))
    if sizes.deepest is not None:
        # a page is also under its own path with a slash behind it
        place = F.lower(F.concat(host, F.substring(path_of(url), 1, sizes.longest), F.lit("/")))
        steps = F.split(place, "/", sizes.deepest + 1)
        upto = F.sequence(F.lit(1), F.least(F.size(steps) - 1, F.lit(sizes.deepest)))
        parts.append(F.transform(upto, lambda n: F.struct(F.lit("prefix").alias("kind"), F.concat(F.array_join(F.slice(steps, 1, n), "/"), F.lit("/")).alias("value"))))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(*parts)))


def judged(captures: DataFrame, changes: DataFrame, *, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """For each row: page_id, url, fetched, n_entries (active ones that hold it), lists (sorted), blocked."""
    active = intervals(changes)
    sizes = sizes_of(active)
    if active.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        active = F.broadcast(active)
    rows = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched"))
    # hosts repeat endlessly, so the join sees each URL and moment once
    asked = rows.select("url", "fetched").distinct().where("url IS NOT NULL AND fetched IS NOT NULL")
    keys = asked.select("url", "fetched", F.explode(keys_of(F.col("url"), sizes)).alias("k")).select("url", "fetched", "k.kind", "k.value")
    hits = keys.join(active, ["kind", "value"]).where("since <= fetched AND (until IS NULL OR fetched < until)")
    found = hits.groupBy("url", "fetched").agg(F.count("*").alias("n_entries"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    return rows.join(found, ["url", "fetched"], "left").select("page_id", "url", "fetched", F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.coalesce("lists", F.lit("")).alias("lists"), F.col("n_entries").isNotNull().alias("blocked"))
