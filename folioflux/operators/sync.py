"""Change logs of synchronised rows: the last write wins, deletion wins over plain writes, pages by key, and what others may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PAGE = 1000


def latest(log: DataFrame, key: list[str], *, at: str = "updated_at", arrival: str = "arrival") -> DataFrame:
    """Of each key the row with the latest time, of equal times the one that arrived last. For logs without deletions."""
    values = [c for c in log.columns if c not in key]
    best = log.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(at, arrival)).alias("__row"))
    return best.select(*key, "__row.*")


def replay(log: DataFrame, key: list[str], values: list[str], *, at: str = "updated_at", arrival: str = "arrival", op: str = "op") -> DataFrame:
    """The state after all writes in order of arrival: op is `upsert`, `delete` or `undelete`; others leave it as it is.

    A write applies if its time isn't before the row's. A deleted row stays so until an `undelete` applies. Columns: key, values, at,
    deleted, n_applied, n_conflicts. One key's writes come together: they are a fold. Of writes that can't matter - upserts that are
    followed by nothing of the key but later or equal upserts - all but the last applied are cheap to keep, so none are dropped.
    """
    state = T.StructType([T.StructField("at", log.schema[at].dataType), T.StructField("deleted", T.BooleanType()), T.StructField("n_applied", T.LongType()), T.StructField("n_conflicts", T.LongType()), *[T.StructField(v, log.schema[v].dataType) for v in values]])
    writes = F.array_sort(F.collect_list(F.struct(F.col(arrival).alias("arrival"), F.col(at).alias("at"), F.col(op).alias("op"), *values)))

    def step(s: Column, w: Column) -> Column:
        applies = (s["at"].isNull() | (w["at"] >= s["at"])) & w["op"].isin("upsert", "delete", "undelete") & ~(F.coalesce(s["deleted"], F.lit(False)) & (w["op"] == "upsert"))
        pick = lambda a, b: F.when(applies, a).otherwise(b)
        return F.struct(
            pick(w["at"], s["at"]).alias("at"), pick(w["op"] == "delete", s["deleted"]).alias("deleted"), (s["n_applied"] + applies.cast("long")).alias("n_applied"),
            (s["n_conflicts"] + (~applies).cast("long")).alias("n_conflicts"), *[pick(w[v], s[v]).alias(v) for v in values],
        ).cast(state)

    start = F.struct(F.lit(None).alias("at"), F.lit(False).alias("deleted"), F.lit(0).alias("n_applied"), F.lit(0).alias("n_conflicts"), *[F.lit(None).alias(v) for v in values]).cast(state)
    folded = log.groupBy(*key).agg(writes.alias("w")).select(*key, F.aggregate("w", start, step).alias("s"))
    return folded.select(*key, *[F.col(f"s.{v}").alias(v) for v in values], F.col("s.at").alias(at), "s.deleted", "s.n_applied", "s.n_conflicts")


def conflicts(incoming: DataFrame, current: DataFrame, key: list[str], *, at: str = "updated_at") -> DataFrame:
    """Incoming rows with status `applied`, or `conflict` and the time of the newer row there is."""
    now = current.select(*key, F.col(at).alias("current_at"))
    joined = incoming.join(now, key, "left")
    newer = F.coalesce(F.col("current_at") > F.col(at), F.lit(False))
    return joined.withColumn("status", F.when(newer, "conflict").otherwise("applied")).withColumn("current_at", F.when(newer, F.col("current_at")))


def page(rows: DataFrame, order: list[str], cursor: tuple | None, limit: int, *, descending: bool = False) -> DataFrame:
    """Up to `limit` rows after the cursor (values of the order columns), and one more if there is: `more` marks it."""
    if not 0 < limit <= MAX_PAGE:
        raise ValueError(f"limit must be from 1 to {MAX_PAGE}, not {limit}")
    here = F.struct(*order)
    if cursor is not None:
        there = F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, cursor, strict=True)])
        rows = rows.where(here < there if descending else here > there)
    sort = [F.desc(c) if descending else F.asc(c) for c in order]
    top = rows.orderBy(*sort).limit(limit + 1)
    return top.withColumn("more", F.row_number().over(Window.orderBy(*sort)) > limit)


def encode_cursor(columns: list[str]) -> Column:
    return F.base64(F.to_json(F.struct(*columns)).cast("binary"))


def drain(rows: DataFrame, order: list[str], limit: int) -> list[tuple]:
    """The cursors after each page, until a page has no more: what a client goes through, one bounded page at a time."""
    cursors: list[tuple] = []
    cursor = None
    while True:
        got = page(rows, order, cursor, limit).collect()
        own = [r for r in got if not r["more"]]
        if own:
            cursor = tuple(own[-1][c] for c in order)
            cursors.append(cursor)
        if len(own) == len(got):
            return cursors


def visible(rows: DataFrame, owner: str, profiles: DataFrame, profile_key: str, is_public: Column) -> DataFrame:
    """Rows that are public, of owners with a public profile."""
    return rows.where(is_public).join(profiles.where("is_public").select(F.col(profile_key).alias(owner)), owner, "left_semi")


def owned(rows: DataFrame, owner: str, user: object) -> DataFrame:
    return rows.where(F.col(owner) == F.lit(user))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose reference leads nowhere; a null reference leads nowhere too."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def violations(rows: DataFrame, key: list[str], checks: dict[str, Column]) -> DataFrame:
    """(key, check) for each check that doesn't hold; a null passes, as in SQL."""
    found = F.filter(F.array(*[F.when(~c, F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull())
    return rows.select(*key, F.explode(found).alias("check"))


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
