"""URL filter lists with a history.

Dated additions and removals become validity intervals, first day to first day after. A capture is
judged by the entries that were active on the day it was fetched, for its host and every parent
domain; the most specific active entry decides, and where the same name is on both lists, allow wins.

Days are what is compared, so a name's history is at most one row per day and is aggregated to that
before it is ordered, however often the list repeats it. Captures are reduced to their distinct hosts
and days before the join and take the verdict back by an equi-join, so a host that holds a third of
all captures costs the join no more than one that has a capture a day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
FOREVER = "9999-12-31"


def intervals(entries: DataFrame, name: str = "name", listed: str = "list", action: str = "action",
              day: str = "day") -> DataFrame:
    """name, list, valid_from, valid_to (exclusive) from dated add and remove entries.

    A name on a day has one state: removed if any entry of that day removes it, else added. Repeated
    additions lengthen nothing, a removal without an addition is void, and an addition that is never
    removed is valid for good. Entries without a name, list, day or known action are void.
    """
    daily = (entries.where(F.col(action).isin("add", "remove") & F.col(name).isNotNull()
                           & F.col(listed).isNotNull() & F.col(day).isNotNull())
             .groupBy(F.lower(F.col(name)).alias("name"), F.col(listed).alias("list"),
                      F.col(day).cast("date").alias("valid_from"))
             .agg(F.min(F.col(action) == "add").alias("added")))
    history = Window.partitionBy("name", "list").orderBy("valid_from")
    changes = (daily.withColumn("_before", F.lag("added", 1, False).over(history))
               .where("added != _before"))
    return (changes.withColumn("valid_to", F.coalesce(
        F.lead("valid_from").over(history), F.lit(FOREVER).cast("date")))
        .where("added").select("name", "list", "valid_from", "valid_to"))


def judge(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url",
          day: str = "fetched") -> DataFrame:
    """One row per capture: key, host, fetched, verdict, name, valid_from, valid_to.

    ``verdict`` is block, allow or, without an active entry, none; name and days are of the entry that
    decided. A url without a host, or a capture without a day, has the verdict none. Repeated captures
    are judged one by one, an absent key is carried. Empty captures give no rows, an empty list the
    verdict none throughout. Other columns are not carried.
    """
    host = F.nullif(F.lower(F.regexp_extract(F.col(url), HOST, 1)), F.lit(""))
    rows = captures.select(F.col(key).alias("_key"), host.alias("host"),
                           F.col(day).cast("date").alias("fetched"))
    labels = F.split("host", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(labels)),
                        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = (rows.where("host is not null and fetched is not null").select("host", "fetched").distinct()
             .select("host", "fetched", F.explode(names).alias("name")))
    active = (F.col("fetched") >= F.col("valid_from")) & (F.col("fetched") < F.col("valid_to"))
    rank = F.struct(F.length("name").alias("specific"), (F.col("list") == "allow").alias("allow"),
                    "list", "name", "valid_from", "valid_to")
    decided = (asked.join(intervals(entries), "name").where(active)
               .groupBy("host", "fetched").agg(F.max(rank).alias("_best")))
    return rows.join(decided, ["host", "fetched"], "left").select(
        F.col("_key").alias(key), "host", "fetched",
        F.coalesce("_best.list", F.lit("none")).alias("verdict"), "_best.name", "_best.valid_from",
        "_best.valid_to")


def derived_history(pages: DataFrame) -> DataFrame:
    """Dated list entries about the hosts of ``pages``, a deterministic third of the pages each one."""
    draw = F.conv(F.substring(F.md5(F.col("url")), 1, 7), 16, 10).cast("long")
    host = F.lower(F.regexp_extract("url", HOST, 1))
    parent = F.regexp_replace(host, r"^[^.]+\.", "")
    return pages.where((draw % 3 == 0) & (host != "")).select(
        F.when(F.floor(draw / 3) % 4 == 0, parent).otherwise(host).alias("name"),
        F.when(F.floor(draw / 12) % 3 == 0, "allow").otherwise("block").alias("list"),
        F.when(F.floor(draw / 36) % 2 == 0, "add").otherwise("remove").alias("action"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int"))
        .alias("day"))


def derived_captures(pages: DataFrame) -> DataFrame:
    """``pages`` with a day of the year 2024 on which each was fetched."""
    return pages.select("page_id", "url", F.date_add(
        F.lit("2024-01-01").cast("date"), (F.col("page_id") * 101 % 366).cast("int")).alias("fetched"))
