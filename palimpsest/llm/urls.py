"""URL lists in force when a page was fetched: dated list entries become intervals, joined to captures as of their time.

A list is a log of dated changes: (list, kind, value, change, at). ``kind`` is ``host`` (a host and all below it) or
``prefix`` (a host and the start of a path); ``change`` adds or removes the entry. Each entry's changes are ordered in
time, and each addition is in force until the entry's next change: [from, until). A capture asks for every suffix of
its host and every prefix of its path, which makes the as-of join an equi-join with a time condition. Lists up to
``SMALL`` intervals are broadcast, after they were counted; longer ones are joined by shuffle, where captures are
spread over ``SALTS`` salts (a host may have a third of all captures) and intervals repeated for each.

All of it is DataFrame operations.

Defined results
    Captures whose url is null, empty or has no host, and those whose time is null, match nothing and are kept with the
    verdict of no match. Hosts are compared in lower case without port, user or a last dot. Changes that lack a value
    or a time are void; of equal changes at one time one counts, and of contrary ones at one time removal holds.
    Repeated captures are answered once and repeated again. The entry named is the one added last, then the least by
    list and key. Long urls are read whole, in linear time: what a
    capture asks for is bounded by the parts of the longest entry.
    Give only the columns that are needed: texts beside the url would be shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL, SALTS = 100_000, 64
NONE, ALLOWED, BLOCKED = "none", "allow", "block"


def host(url: Column) -> Column:
    authority = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#@:]*)", 1)
    return F.lower(F.regexp_replace(authority, r"\.+$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys(url: Column, labels: int | None = None, parts: int | None = None) -> Column:
    """What a url is looked up by: the suffixes of its host, and the host with the prefixes of its path.

    Given how many labels the longest listed host has and how many parts the longest listed path, longer keys, which no
    entry can have, are not made.
    """
    names, steps = F.split(host(url), r"\."), F.split(F.regexp_replace(path(url), "^/|/$", ""), "/")
    first = F.lit(1) if labels is None else F.greatest(F.lit(1), F.size(names) - labels + 1)
    last = F.size(steps) if parts is None else F.least(F.size(steps), F.lit(parts))
    none = F.array().cast("array<string>")
    suffixes = F.transform(F.sequence(first, F.size(names)), lambda i: F.concat(F.lit("host "), F.array_join(F.slice(names, i, F.size(names)), ".")))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.concat(F.lit("prefix "), host(url), F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")))
    some = F.when((F.length(path(url)) > 1) & (last > 0), prefixes).otherwise(none)
    return F.when(F.length(host(url)) > 0, F.array_distinct(F.concat(none if labels == 0 else suffixes, some))).otherwise(none)


def intervals(changes: DataFrame) -> DataFrame:
    """(key, list, since, until): when each entry was in force; until is null if it still is."""
    value = F.lower(F.regexp_replace(F.trim("value"), r"^\.+|[./]+$", ""))
    clean = changes.where("value is not null and at is not null and list is not null and change in ('add', 'remove') and kind in ('host', 'prefix')")
    keyed = clean.select("list", F.concat_ws(" ", "kind", F.when(F.col("kind") == "host", value).otherwise(F.regexp_replace(F.trim("value"), "/$", ""))).alias("key"), "change", "at")
    # Changes are few for each entry (its history), however many entries there are.
    single = keyed.groupBy("list", "key", "at").agg(F.max("change").alias("change"))  # remove sorts after add
    entry = Window.partitionBy("list", "key").orderBy("at")
    return single.withColumn("until", F.lead("at").over(entry)).where("change = 'add'").select("key", "list", F.col("at").alias("since"), "until")


def match(captures: DataFrame, changes: DataFrame, url: str = "url", at: str = "fetched") -> DataFrame:
    """The rows of ``captures`` with n_active, verdict and entry: what the list entries in force say of each.

    Lists whose name starts with ``allow`` override all others.
    """
    found, columns = intervals(changes), captures.columns
    # Only as many labels and parts are looked up as an entry has; so a url of any length has few keys.
    kind, entry = F.startswith("key", F.lit("host ")), F.regexp_replace("key", "^[^/]*/", "")
    many, labels, parts = found.agg(
        F.count("*"),
        F.coalesce(F.max(F.when(kind, F.size(F.split("key", r"\.")))), F.lit(0)),
        F.coalesce(F.max(F.when(~kind, F.size(F.split(entry, "/")))), F.lit(0)),
    ).first()
    each = captures.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count("*").alias("__copies"))
    row = F.struct(*[F.col(f"`{c}`") for c in columns], "__copies")
    asked = each.select(row.alias("row"), F.col(f"`{at}`").alias("time"), F.explode_outer(keys(F.col(f"`{url}`"), labels, parts)).alias("key"))
    if many <= SMALL:
        met = asked.join(F.broadcast(found), _in_force(asked, found), "left")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        met = asked.join(salted, _in_force(asked, salted) & (asked.salt == salted.salt), "left")
        found = salted
    allow = F.startswith("list", F.lit("allow"))
    # The entry added last, then the least by name: the names are compared only among those of one time.
    named = F.struct("since", F.struct("list", found["key"]).alias("name"))
    per = met.groupBy("row").agg(
        F.count("list").alias("n_active"),
        F.bool_or(allow).alias("allowed"),
        F.collect_set(F.when(F.col("list").isNotNull(), named)).alias("entries"),
    )
    last = F.array_max(F.transform("entries", lambda e: e["since"]))
    name = F.array_min(F.transform(F.filter("entries", lambda e: e["since"] == last), lambda e: e["name"]))
    copies = F.explode(F.array_repeat(F.lit(1), F.col("row.__copies").cast("int")))
    return per.select("*", copies).select(
        *[F.col(f"row.`{c}`") for c in columns],
        "n_active",
        F.when(F.col("allowed"), ALLOWED).when(F.col("n_active") > 0, BLOCKED).otherwise(NONE).alias("verdict"),
        F.coalesce(F.concat_ws(" ", name["list"], name["key"]), F.lit("")).alias("entry"),
    )


def _in_force(asked: DataFrame, found: DataFrame) -> Column:
    return (asked.key == found.key) & (asked.time >= found.since) & (found.until.isNull() | (asked.time < found.until))
