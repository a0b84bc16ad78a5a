"""Stratified, floored, seeded selection of paragraphs, its manifest, and the check for drift."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.functions.text import BANDS, STRATA
from folioflux.operators.kept import keep

# ---- fixed values: sample sizes and floors by tier ------------------------------------------------------------------------------------
TIERS = {"smoke": 40, "standard": 150}
STRATUM_FLOORS = {"smoke": 2, "standard": 6}
BOOK_FLOORS = {"smoke": 4, "standard": 12}
SEED = 42


def allot(counts: dict[str, int], size: int, floor: int) -> dict[str, int]:
    """`size` places for keys in proportion to their counts, at least `floor` each; what is over or missing goes round the largest."""
    total = sum(counts.values())
    places = {k: max(floor, round(size * n / total)) for k, n in counts.items() if n}
    largest = sorted(places, key=lambda k: -counts[k])
    step = -1 if sum(places.values()) > size else 1
    while sum(places.values()) != size:
        movable = [k for k in largest if (places[k] > floor if step < 0 else places[k] < counts[k])]
        if not movable:
            break
        for k in movable[: abs(sum(places.values()) - size)]:
            places[k] += step
    return places


def book_quotas(candidates: DataFrame, tier: str) -> dict[str, int]:
    """Places by book: a row for each book comes to the driver."""
    counts = {r[0]: r[1] for r in candidates.groupBy("book_slug").count().orderBy("book_slug").collect()}
    return allot(counts, TIERS[tier], BOOK_FLOORS[tier])


def band_quotas(candidates: DataFrame, quotas: DataFrame, default: int = 0) -> DataFrame:
    """(book_slug, band, n, quota): each book's quota (book_slug, quota; `default` if it has none) over its bands, at least one each.

    Books are allotted each by itself: a row for each of a book's few bands comes together.
    """
    counts = candidates.groupBy("book_slug", "band").agg(F.count("*").alias("n")).join(quotas, "book_slug", "left").withColumn("quota", F.coalesce("quota", F.lit(default)).cast("int"))
    order = [b[0] for b in BANDS]

    def of_book(rows: pd.DataFrame) -> pd.DataFrame:
        counts = {band: int(n) for _, band, n in sorted(zip(rows["band"].map(order.index), rows["band"], rows["n"], strict=True))}
        places = allot(counts, int(rows["quota"].iloc[0]), 1)
        return rows.assign(quota=rows["band"].map(places))

    return counts.groupBy("book_slug").applyInPandas(of_book, "book_slug string, band string, n long, quota int")


def _quota_rows(spark: SparkSession, quotas: dict[str, int]) -> DataFrame:
    return spark.createDataFrame(list(quotas.items()), "book_slug string, quota int")


def quota_table(spark: SparkSession, candidates: DataFrame, tier: str) -> DataFrame:
    return band_quotas(candidates, _quota_rows(spark, book_quotas(candidates, tier))).select("book_slug", "band", "quota")


def select(candidates: DataFrame, tier: str, seed: int = SEED) -> DataFrame:
    """The sample of a tier, of candidates (book_slug, chapter_index, position, band, strata): the rarest features first, up to their
    floor, books in order, each in a seeded shuffle and only while its book and band have places; then what places are left.

    Every choice depends on those before, so the greedy part is one fold. It is fed with what could be chosen at most: of each book,
    feature (or none) and band only as many candidates, in shuffled order, as the tier has places. Candidates are computed once, to a
    table without their texts, which all steps read; the chosen rows find theirs in the end.
    """
    size = TIERS[tier]
    mark = F.sha1(F.concat_ws(":", F.lit(f"{seed}:{tier}"), "book_slug", F.col("chapter_index").cast("string"), F.col("position").cast("string")).cast("binary"))
    marked = keep(candidates.select("book_slug", "chapter_index", "position", "band", "strata", mark.alias("__mark")), "candidates")
    quotas = book_quotas(marked, tier)
    bands = {(r["book_slug"], r["band"]): r["quota"] for r in band_quotas(marked, _quota_rows(candidates.sparkSession, quotas)).collect()}  # a row for each book and band
    rarity = {r[0]: r[1] for r in marked.select(F.explode("strata").alias("s")).groupBy("s").count().collect()}
    order = sorted(STRATA, key=lambda s: rarity.get(s, 0))
    from pyspark.sql import Window

    features = F.concat(F.col("strata"), F.array(F.lit("")))
    nth = F.row_number().over(Window.partitionBy("book_slug", "band", "__feature").orderBy("__mark"))
    useful = marked.withColumn("__feature", F.explode(features)).withColumn("__nth", nth).where(F.col("__nth") <= size)
    pool = marked.join(useful.select("book_slug", "chapter_index", "position").distinct(), ["book_slug", "chapter_index", "position"], "left_semi")
    schema = "book_slug string, chapter_index int, position long"

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["book_slug", "__mark"])
        room = dict(bands)
        taken = dict.fromkeys(quotas, 0)
        met = dict.fromkeys(order, 0)
        chosen: dict[tuple, None] = {}

        def offer(row) -> None:  # noqa: ANN001
            key = (row.book_slug, row.chapter_index, row.position)
            if key in chosen or taken.get(row.book_slug, 0) >= quotas.get(row.book_slug, 0) or room.get((row.book_slug, row.band), 0) < 1:
                return
            chosen[key] = None
            taken[row.book_slug] += 1
            room[row.book_slug, row.band] -= 1
            for s in row.strata:
                met[s] += 1

        listed = list(rows.itertuples())
        for stratum in order:
            for row in listed:
                if met[stratum] >= STRATUM_FLOORS[tier]:
                    break
                if stratum in row.strata:
                    offer(row)
        for row in listed:
            offer(row)
        return pd.DataFrame(list(chosen), columns=["book_slug", "chapter_index", "position"])

    found = pool.select("book_slug", "chapter_index", "position", "band", "strata", "__mark", F.lit(0).alias("__all")).groupBy("__all").applyInPandas(choose, schema)
    found = keep(found, "chosen")  # at most as many rows as the tier has places
    return candidates.join(F.broadcast(found), ["book_slug", "chapter_index", "position"], "left_semi")


def coverage(selected: DataFrame, floor: int) -> DataFrame:
    """(kind, name, n, met) of the selection's bands, features and books; features that miss the floor, also absent ones, aren't met."""
    names = selected.sparkSession.createDataFrame([("stratum", s) for s in STRATA], "kind string, name string")
    strata = selected.select(F.explode("strata").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    features = names.join(strata, "name", "left").select("kind", "name", F.coalesce("n", F.lit(0)).alias("n"))
    bands = selected.groupBy(F.col("band").alias("name")).agg(F.count("*").alias("n")).select(F.lit("band").alias("kind"), "name", "n")
    books = selected.groupBy(F.col("book_slug").alias("name")).agg(F.count("*").alias("n")).select(F.lit("book").alias("kind"), "name", "n")
    return features.unionByName(bands).unionByName(books).withColumn("met", (F.col("kind") != "stratum") | (F.col("n") >= floor))


def verify(manifest: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows of a manifest (book_slug, chapter_index, position, segment_hash) that no longer hold: problem `missing` or `changed`."""
    now = candidates.select("book_slug", "chapter_index", "position", F.col("segment_hash").alias("now"))
    found = manifest.join(now, ["book_slug", "chapter_index", "position"], "left")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("segment_hash"), "changed")
    return found.withColumn("problem", problem).where("problem is not null").select("book_slug", "chapter_index", "position", "problem")


def shuffled(items: list, seed: int, tier: str) -> list:
    """The standard generator's shuffle for a seed and tier: for results that must repeat a sequential program's."""
    out = list(items)
    random.Random(f"{seed}:{tier}").shuffle(out)
    return out


def sample_book(selected: DataFrame) -> DataFrame:
    """The selection as a book: a chapter for each slug, its heading at position 0, then its paragraphs; positions begin anew in each."""
    from pyspark.sql import Window

    in_book = Window.partitionBy("book_slug").orderBy("chapter_index", "position")
    slugs = selected.select("book_slug").distinct().withColumn("chapter", F.dense_rank().over(Window.orderBy("book_slug")) - 1)
    rows = selected.withColumn("n", F.row_number().over(in_book)).select("book_slug", "n", F.lit("paragraph").alias("type"), "text")
    heads = slugs.select("book_slug", F.lit(0).alias("n"), F.lit("heading").alias("type"), F.col("book_slug").alias("text"))
    return rows.unionByName(heads).join(slugs, "book_slug").select(F.col("chapter").alias("chapter_index"), F.col("book_slug").alias("chapter_title"), F.col("n").cast("long").alias("position"), "type", "text")
