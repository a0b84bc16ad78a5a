"""URL filters as a temporal list join, in DataFrame functions only.

Dated list entries become validity intervals: an entry holds from the time it was listed until the next dated row of the same
entry. Every capture is evaluated against the entries that were active when it was fetched (an as-of join).

Plan: list entries meet the *distinct* hosts and first path segments of the captures, never the captures themselves; the matched
hosts with their few intervals are then joined to the captures, by broadcast when their counted size is small, else by a shuffle
join whose hot hosts adaptive execution can split. A host with a third of all captures costs one row on the list side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflux.llm.shared import keep

#: Above so many matched intervals in all, the matched hosts are joined by a shuffle instead of a broadcast.
MAX_BROADCAST_INTERVALS = 200_000

ACTIONS = "remove", "allow", "block"
KINDS = "domain", "host", "prefix"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower case; without user, port and final dot; null if there is none) and path with query (without fragment; / if empty)."""
    rest = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^\s#]*)", 1)
    authority = F.regexp_extract(rest, r"^([^/?]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""), r"\.$", ""))
    path = F.regexp_extract(rest, r"^[^/?]*(.*)$", 1)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(F.length(host) > 0, host), path


def list_intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals of dated list rows (list_name, kind, entry, action, listed_at).

    kind: `domain` (the host and all below it), `host` (that host) or `prefix` (host and beginning of the path). action: `block`,
    `allow`, or `remove`, which ends what held. Rows with a null or an unknown kind or action are left out. Of rows for one entry
    and time the last of remove, allow, block holds; repeated rows count once. Columns: those, valid_from, valid_to (null: still).
    """
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    clean = entries.select("list_name", "kind", F.lower(F.trim("entry")).alias("entry"), "action", "listed_at").where(F.col("kind").isin(*KINDS) & F.col("action").isin(*ACTIONS)).dropna()
    once = clean.groupBy("list_name", "kind", "entry", "listed_at").agg(F.max_by("action", rank).alias("action"))
    by_time = Window.partitionBy("list_name", "kind", "entry").orderBy("listed_at")
    dated = once.withColumn("valid_to", F.lead("listed_at").over(by_time)).withColumnRenamed("listed_at", "valid_from")
    return dated.where(F.col("action") != "remove")


def filter_urls(captures: DataFrame, entries: DataFrame, *, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """The captures, in as many rows, with what the lists said when each was fetched.

    Adds `url_filter`: struct of host, n_active (entries that were active and match), decision (`block`, `allow` or `pass`: no entry)
    and of the entry that decides list_name, kind, entry, valid_from. Of several the most specific decides: prefix before host
    before domain, then the longer entry, then block before allow, then the smaller list_name. A null or relative URL has a null host
    and passes; a null fetch time matches nothing. Repeated captures are each evaluated; other columns stay as they are, except that
    one named `url_filter` is replaced. No captures or no entries give no rows or only `pass`.
    """
    host, path = url_parts(F.col(url))
    at = "__ff_host", "__ff_dir", "__ff_path"
    first = F.regexp_extract(path, r"^(/[^/?]*/)", 1)
    keyed = captures.withColumns({at[0]: host, at[1]: F.when(F.length(first) > 0, F.concat(host, first)), at[2]: F.concat(host, path)})
    valid = list_intervals(entries)
    valid = valid.withColumn("dir", F.when(F.col("kind") == "prefix", F.regexp_extract("entry", r"^([^/]+/[^/?]+/)", 1)))
    valid = valid.withColumns({"dir": F.when(F.length("dir") > 0, F.col("dir")), "of_host": F.regexp_extract("entry", r"^([^/]+)", 1)})
    rule = F.struct(
        F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("rank"), F.length("entry").alias("length"), F.when(F.col("action") == "block", 1).otherwise(0).alias("blocks"),
        "list_name", "kind", "entry", "action", "valid_from", "valid_to",
    )
    hosts = keyed.select(at[0]).where(F.col(at[0]).isNotNull()).distinct()
    labels = F.split(at[0], r"\.")
    suffixes = hosts.select(at[0], F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("suffix"))
    of_domain = suffixes.join(valid.where(F.col("kind") == "domain").withColumnRenamed("entry", "suffix"), "suffix").withColumn("entry", F.col("suffix")).select(at[0], rule.alias("rule"))
    of_host = hosts.join(valid.where((F.col("kind") != "domain") & F.col("dir").isNull()), F.col(at[0]) == F.col("of_host")).select(at[0], rule.alias("rule"))
    dirs = keyed.select(at[1]).where(F.col(at[1]).isNotNull()).distinct()
    of_dir = dirs.join(valid.where(F.col("dir").isNotNull()), F.col(at[1]) == F.col("dir")).select(at[1], rule.alias("rule"))

    def matched(rules: DataFrame, key: str, name: str) -> DataFrame:
        found = keep(rules.groupBy(key).agg(F.collect_list("rule").alias(name)), name.strip("_"))
        total = found.agg(F.coalesce(F.sum(F.size(name)), F.lit(0))).first()[0]
        return F.broadcast(found) if total <= MAX_BROADCAST_INTERVALS else found

    joined = keyed.join(matched(of_domain.unionByName(of_host), at[0], "__ff_by_host"), at[0], "left").join(matched(of_dir, at[1], "__ff_by_dir"), at[1], "left")
    when = F.col(fetched_at)
    empty = F.expr("filter(__ff_by_host, x -> false)")
    all_rules = F.coalesce(F.concat(F.col("__ff_by_host"), F.col("__ff_by_dir")), F.col("__ff_by_host"), F.col("__ff_by_dir"), empty)
    active = F.filter(all_rules, lambda r: (when >= r["valid_from"]) & (r["valid_to"].isNull() | (when < r["valid_to"])) & ((r["kind"] != "prefix") | F.col(at[2]).startswith(r["entry"])))
    # the smaller list_name wins ties: it is compared last, in an order of its own
    top = F.array_max(F.transform(F.col("__ff_active"), lambda r: F.struct(r["rank"], r["length"], r["blocks"])))
    winners = F.filter(F.col("__ff_active"), lambda r: F.struct(r["rank"], r["length"], r["blocks"]) == top)
    best = F.array_min(F.transform(winners, lambda r: F.struct(r["list_name"].alias("list_name"), r["entry"].alias("entry"), r["kind"].alias("kind"), r["action"].alias("action"), r["valid_from"].alias("valid_from"))))
    out = joined.withColumn("__ff_active", F.coalesce(active, F.array())).withColumn("__ff_best", best)
    result = F.struct(
        F.col(at[0]).alias("host"), F.size("__ff_active").alias("n_active"), F.coalesce("__ff_best.action", F.lit("pass")).alias("decision"),
        F.col("__ff_best.list_name").alias("list_name"), F.col("__ff_best.kind").alias("kind"), F.col("__ff_best.entry").alias("entry"), F.col("__ff_best.valid_from").alias("valid_from"),
    )
    return out.select(*[F.col(f"`{c}`") for c in captures.columns if c != "url_filter"], result.alias("url_filter"))
