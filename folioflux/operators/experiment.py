"""Paired experiments over runs of neighbouring segments: tiling, lead-ins, deltas with cluster intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflux.functions import identity, text
from folioflux.operators import sampling

LOW_POWER_CLUSTERS = 5


def eligible_blocks(segments: DataFrame, controls: DataFrame) -> DataFrame:
    """Paragraphs with a control translation, with block (the position where their unbroken run in the chapter begins) and nth in it.

    controls: (book_key, id, control). A heading, a blank or an untranslated segment, and a chapter's end, break a run.
    """
    known = controls.select("book_key", "id", "control")
    rows = segments.join(known, ["book_key", "id"], "left")
    fit = (F.col("type") == "paragraph") & ~text.is_blank(F.col("text")) & F.col("control").isNotNull()
    chapter = Window.partitionBy("book_key", "chapter_index").orderBy("position")
    opens = fit & ~F.coalesce(F.lag(fit).over(chapter), F.lit(False))
    blocks = rows.withColumn("block", F.max(F.when(opens, F.col("position"))).over(chapter)).where(fit)
    in_block = Window.partitionBy("book_key", "chapter_index", "block").orderBy("position")
    return blocks.withColumn("nth", F.row_number().over(in_block) - 1)


def candidate_runs(blocks: DataFrame, *, run_length: int, context_pairs: int) -> DataFrame:
    """The blocks' rows in runs: run (position of its first row) and slot. Runs are of full length, with room for the context between."""
    if run_length <= 0:
        raise ValueError(f"run_length must be positive, not {run_length}")
    stride = run_length + max(context_pairs, 0)
    block = ["book_key", "chapter_index", "block"]
    rows = blocks.withColumns({"slot": F.col("nth") % stride, "tile": F.floor(F.col("nth") / stride)}).where(F.col("slot") < run_length)
    tile = Window.partitionBy(*block, "tile")
    whole = rows.withColumns({"__n": F.count("*").over(tile), "run": F.min("position").over(tile)}).where(F.col("__n") == run_length)
    return whole.drop("__n", "tile")


def lead_ins(runs: DataFrame, segments: DataFrame, controls: DataFrame, *, context_pairs: int) -> DataFrame:
    """(book_key, run, back, id): the up to `context_pairs` segments just before each run that may be its context.

    Going back, the first that is in another chapter, blank, without control, or equal in text to any judged segment of the pool ends
    it: such a text would be served from the cache.
    """
    judged = runs.select(identity.segment_hash(F.col("text")).alias("hash")).distinct().withColumn("__judged", F.lit(True))
    firsts = runs.where("slot = 0").select("book_key", "run", F.col("chapter_index").alias("chapter"))
    wanted = firsts.select("book_key", "run", "chapter", F.explode(F.sequence(F.lit(1), F.lit(max(context_pairs, 1)))).alias("back")).where(F.col("back") <= context_pairs)
    wanted = wanted.withColumn("position", F.col("run") - F.col("back"))
    known = controls.select("book_key", "id", F.lit(True).alias("__known"))
    rows = segments.select("book_key", "position", "chapter_index", "id", "text", identity.segment_hash(F.col("text")).alias("hash"))
    found = wanted.join(rows, ["book_key", "position"]).join(known, ["book_key", "id"], "left").join(judged, "hash", "left")
    good = (F.col("chapter_index") == F.col("chapter")) & ~text.is_blank(F.col("text")) & F.col("__known").isNotNull() & F.col("__judged").isNull()
    so_far = Window.partitionBy("book_key", "run").orderBy("back")
    return found.withColumn("__good", F.min(good.cast("int")).over(so_far)).where("__good = 1").select("book_key", "run", "back", "id")


def paired_delta(judged: DataFrame, by: list[str], cluster: str, control: str, variant: str, *, seed: int, resamples: int = sampling.RESAMPLES) -> DataFrame:
    """(by, n, n_clusters, control_mean, variant_mean, delta, ci_low, ci_high, verdict, low_power): clusters are drawn, not items."""
    delta = F.col(variant) - F.col(control)
    of_cluster = judged.groupBy(*by, cluster).agg(F.sum(delta).alias("total"), F.count(delta).alias("n")).where("n > 0")
    indexed = of_cluster.withColumn("index", (F.row_number().over(Window.partitionBy(*by).orderBy(cluster)) - 1).cast("long"))
    stats = sampling.cluster_means(indexed.select(*by, "index", "total", "n"), by, seed=seed, resamples=resamples)
    ci = sampling.interval(stats, "mean", by)
    means = judged.groupBy(*by).agg(F.count("*").alias("n"), F.avg(control).alias("control_mean"), F.avg(variant).alias("variant_mean"), F.avg(delta).alias("delta"))
    sizes = of_cluster.groupBy(*by).agg(F.count("*").alias("n_clusters"))
    rows = means.join(sizes, by).join(ci, by)
    return rows.withColumns({"verdict": verdict(F.col("ci_low"), F.col("ci_high")), "low_power": F.col("n_clusters") < LOW_POWER_CLUSTERS})


def verdict(low: Column, high: Column) -> Column:
    return F.when(low > 0, "win").when(high < 0, "regression").otherwise("inconclusive")


def points(delta: Column, weight: int) -> Column:
    return delta / 5 * weight


def seed_rows(runs: DataFrame, leads: DataFrame, control_version: str, variant_version: str) -> DataFrame:
    """What an experiment's own cache begins with: judged segments under the control version only, lead-ins under both."""
    judged = runs.select("book_key", "id", F.lit(control_version).alias("prompt_version"))
    both = leads.select("book_key", "id", F.explode(F.array(F.lit(control_version), F.lit(variant_version))).alias("prompt_version"))
    return judged.unionByName(both).distinct()
