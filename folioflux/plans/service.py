"""Push and pull of synchronised entities, and what a public reader shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.operators import sync

#: fixed values: entities in the order in which a push applies them, and the reference that each must resolve
ORDER = ("books_metadata", "shelves", "highlights", "vocabulary", "progress", "ratings", "shelf_items", "shared_passages")
PARENTS = {"shelf_items": ("shelf_id", "shelves", "id"), "shared_passages": ("highlight_id", "highlights", "id"), "highlights": ("book_hash", "books_metadata", "content_hash")}
UPSERT_ONLY = ("progress",)


def push(batches: dict[str, DataFrame], current: dict[str, DataFrame], keys: dict[str, list[str]], checks: dict[str, dict[str, Column]] | None = None) -> dict[str, DataFrame]:
    """For each entity its incoming rows with status: `applied`, `conflict`, `error` (a reference that leads nowhere, a constraint, or a
    deletion of what can only be written). Parents come first, so that rows of one push may refer to each other."""
    out: dict[str, DataFrame] = {}
    known = dict(current)
    for entity in [e for e in ORDER if e in batches]:
        rows = batches[entity]
        reason = F.lit(None).cast("string")
        if entity in UPSERT_ONLY and "op" in rows.columns:
            reason = F.when(F.col("op") == "delete", "upsert_only")
        for name, holds in (checks or {}).get(entity, {}).items():
            reason = F.coalesce(reason, F.when(~holds, F.lit(name)))
        rows = rows.withColumn("error", reason)
        if entity in PARENTS and PARENTS[entity][1] in known:
            reference, parent, parent_key = PARENTS[entity]
            there = known[parent].select(F.col(parent_key).alias(reference)).distinct().withColumn("__there", F.lit(True))
            rows = rows.join(there, reference, "left").withColumn("error", F.coalesce("error", F.when(F.col("__there").isNull(), "missing_parent"))).drop("__there")
        if entity in known:
            rows = sync.conflicts(rows, known[entity], keys[entity])
        else:
            rows = rows.withColumns({"status": F.lit("applied"), "current_at": F.lit(None).cast("timestamp")})
        rows = rows.withColumn("status", F.when(F.col("error").isNotNull(), "error").otherwise(F.col("status")))
        out[entity] = rows
        fresh = rows.where("status = 'applied'")
        known[entity] = fresh if entity not in known else known[entity].unionByName(fresh, allowMissingColumns=True)
    return out


def pull(rows: DataFrame, user: object, order: list[str], cursor: tuple | None, limit: int, *, owner: str = "user_id") -> DataFrame:
    """One page of a user's rows, deleted ones too, with the cursor to go on from."""
    return sync.page(sync.owned(rows, owner, user), order, cursor, limit).withColumn("cursor", sync.encode_cursor(order))


def public_reader(profiles: DataFrame, shelves: DataFrame, items: DataFrame, ratings: DataFrame, passages: DataFrame, handle: str) -> DataFrame:
    """One row of a public profile with nested public shelves (and their items), ratings and passages; without content hashes.

    A handle that isn't there or isn't public gives no row.
    """
    who = profiles.where((F.col("handle") == handle) & F.col("is_public")).select("user_id", "handle", "display_name")
    alive = lambda df: df.where(F.col("deleted_at").isNull())
    shown = alive(shelves).where("is_public").join(who.select("user_id"), "user_id", "left_semi")
    of_shelf = alive(items).join(shown.select(F.col("id").alias("shelf_id")), "shelf_id", "left_semi").groupBy("shelf_id").agg(F.array_sort(F.collect_list(F.struct("title", "authors"))).alias("items"))
    listed = shown.join(of_shelf, F.col("id") == F.col("shelf_id"), "left").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("name", "kind", F.coalesce("items", F.expr("filter(items, x -> false)")).alias("items")))).alias("shelves"))
    rated = alive(ratings).where("is_public").join(who.select("user_id"), "user_id", "left_semi").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("title", "stars", "review"))).alias("ratings"))
    newest = F.reverse(F.array_sort(F.collect_list(F.struct("created_at", "id", "title", "excerpt"))))
    shared = alive(passages).where("is_public").join(who.select("user_id"), "user_id", "left_semi").groupBy("user_id").agg(newest.alias("passages"))
    return who.join(listed, "user_id", "left").join(rated, "user_id", "left").join(shared, "user_id", "left").drop("user_id")
