"""Evaluation of a translated book and paired experiments, composed from the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.functions import text
from folioflux.operators import experiment, sampling, scoring, segments
from folioflux.operators.running import row_index
from folioflux.plans.connectors import Judge


#: Translated body paragraphs of a PDF book that are screened for marks of bad extraction.
SCREENED = 20


class ExperimentError(ValueError):
    pass


def judged(sample: DataFrame, make_judge: Callable[[], Judge], *, repeats: int = 1) -> DataFrame:
    """The sample (with text and target_text) with arrays `meaning` and `fluency`, a verdict for each repeat."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sample.schema) + ", meaning array<int>, fluency array<int>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = make_judge()
        for frame in frames:
            yield frame.assign(
                meaning=[[judge.meaning(s, t) for _ in range(repeats)] for s, t in zip(frame["text"], frame["target_text"], strict=True)],
                fluency=[[judge.fluency(t) for _ in range(repeats)] for t in frame["target_text"]],
            )

    return sample.mapInPandas(run, schema)


def screened(source: DataFrame, target: DataFrame, formats: DataFrame, make_judge: Callable[[], Judge], *, seed: int, repeats: int = 1) -> DataFrame:
    """(book_key, index, T6): the judge's mean verdict on each of up to SCREENED translated paragraphs of the body of each PDF book."""
    pdf = formats.where(F.lower("source_format") == "pdf").select("book_key").distinct()
    prose = target.where((F.col("type") == "paragraph") & ~text.is_blank(F.col("text"))).select("book_key", "chapter_index", "id", "text").join(pdf, "book_key", "left_semi")
    pool = segments.restrict_to_body(prose, segments.flagged_chapters(source), SCREENED)
    sample = sampling.hash_sample(pool, F.col("id"), SCREENED, seed, ["book_key"]).select("book_key", "id", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = make_judge()
        for frame in frames:
            verdicts = [sum(judge.screen(t) for _ in range(repeats)) / repeats for t in frame["text"]]
            yield frame[["book_key", "id"]].assign(T6=verdicts)

    return row_index(sample.mapInPandas(run, "book_key string, id string, T6 double").persist(), ["book_key"], ["id"], "index").select("book_key", "index", "T6")


def total_intervals(dimensions: DataFrame, means: DataFrame, screens: DataFrame, resamples: int) -> DataFrame:
    """(book_key, ci_low, ci_high) of the total: meaning and fluency drawn together, the screen by itself, all else as it is.

    dimensions: (book_key, key, fraction). means: (book_key, resample, T2, T3); screens: (book_key, resample, T6), of screened books only.
    """
    weight = F.create_map(*[x for k, w in scoring.WEIGHTS.items() for x in (F.lit(k), F.lit(w))])[F.col("key")]
    drawn = screens.select("book_key").distinct().withColumn("key", F.lit("T6")).unionByName(means.select("book_key").distinct().select("book_key", F.explode(F.array(F.lit("T2"), F.lit("T3"))).alias("key")))
    marked = dimensions.where("fraction is not null").join(drawn.withColumn("__drawn", F.lit(True)), ["book_key", "key"], "left").withColumn("w", weight)
    fixed = marked.groupBy("book_key").agg(
        F.coalesce(F.sum(F.when(F.col("__drawn").isNull(), F.col("fraction") * F.col("w"))), F.lit(0.0)).alias("points"), F.sum("w").alias("weights"),
        F.max(F.when((F.col("key") == "T1") & (F.col("fraction") < 1), 1)).alias("incomplete"),
    )
    rows = fixed.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).join(means, ["book_key", "resample"], "left").join(screens, ["book_key", "resample"], "left")
    judge = sum((F.coalesce(F.col(k) / scoring.JUDGE_MAX, F.lit(0.0)) * scoring.WEIGHTS[k] for k in ("T2", "T3")), F.coalesce("T6", F.lit(0.0)) * scoring.WEIGHTS["T6"])
    total = (F.col("points") + judge) / F.col("weights") * 100
    capped = rows.withColumn("total", F.when(F.col("incomplete") == 1, F.least(total, F.lit(scoring.INCOMPLETE_CAP))).otherwise(total))
    return sampling.interval(capped, "total", ["book_key"])


def score_books(source: DataFrame, target: DataFrame, make_judge: Callable[[], Judge], *, sample_size: int = 40, seed: int = 42, glossary: DataFrame | None = None, costs: DataFrame | None = None, repeats: int = 1, resamples: int = sampling.RESAMPLES, formats: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(dimensions, totals) of each book: rows (book_key, key, name, weight, fraction, ci_low, ci_high) and (book_key, total, noise,
    ci_low, ci_high).

    costs: (book_key, cost_eur). formats: (book_key, source_format); the translated paragraphs of `pdf` books, as those of positioned
    lines are, are screened for T6, other books and those without a format have it in full. Judged are paragraphs of the body, of books with too few of them all paragraphs.
    """
    pairs = scoring.align(source, target).persist()
    t1 = scoring.completeness(pairs).select("book_key", F.lit("T1").alias("key"), "fraction")
    prose = pairs.where("target_text is not null").join(source.select("book_key", "position", "type", "chapter_index"), ["book_key", "position"]).where((F.col("type") == "paragraph") & ~text.is_blank(F.col("target_text")) & ~text.is_blank(F.col("text")))
    pool = segments.restrict_to_body(prose, segments.flagged_chapters(source), sample_size)
    sample = sampling.hash_sample(pool, F.col("id"), sample_size, seed, ["book_key"])
    verdicts = judged(sample.select("book_key", "id", "text", "target_text"), make_judge, repeats=repeats).persist()
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    items = row_index(verdicts.select("book_key", "id", mean(F.col("meaning")).alias("T2"), mean(F.col("fluency")).alias("T3")), ["book_key"], ["id"], "index")
    means = sampling.resampled_means(items.select("book_key", "index", "T2", "T3"), ["book_key"], ["T2", "T3"], seed=seed, resamples=resamples)
    parts = [t1]
    intervals = []
    for key in ("T2", "T3"):
        parts.append(items.groupBy("book_key").agg((F.avg(key) / scoring.JUDGE_MAX).alias("fraction")).select("book_key", F.lit(key).alias("key"), "fraction"))
        intervals.append(sampling.interval(means, key, ["book_key"]).select("book_key", F.lit(key).alias("key"), (F.col("ci_low") / 5 * scoring.WEIGHTS[key]).alias("ci_low"), (F.col("ci_high") / 5 * scoring.WEIGHTS[key]).alias("ci_high")))
    if glossary is not None:
        parts.append(source.select("book_key").distinct().crossJoin(F.broadcast(scoring.terminology(pairs, glossary).select("fraction"))).select("book_key", F.lit("T4").alias("key"), "fraction"))
    parts.append(scoring.structure(source, target).select("book_key", F.lit("T5").alias("key"), "fraction"))
    if formats is None:
        formats = source.sparkSession.createDataFrame([], "book_key string, source_format string")
    clean = screened(source, target, formats, make_judge, seed=seed + 1, repeats=repeats)
    screens = sampling.resampled_means(clean, ["book_key"], ["T6"], seed=seed + 1, resamples=resamples)
    found = clean.groupBy("book_key").agg(F.avg("T6").alias("found"))
    parts.append(source.select("book_key").distinct().join(found, "book_key", "left").select("book_key", F.lit("T6").alias("key"), F.coalesce("found", F.lit(1.0)).alias("fraction")))
    intervals.append(sampling.interval(screens, "T6", ["book_key"]).select("book_key", F.lit("T6").alias("key"), *[(F.col(c) * scoring.WEIGHTS["T6"]).alias(c) for c in ("ci_low", "ci_high")]))
    if costs is not None:
        n_words = source.groupBy("book_key").agg(F.sum(text.word_count(F.col("text"))).alias("n"))
        parts.append(n_words.join(costs, "book_key", "left").select("book_key", F.lit("T7").alias("key"), scoring.cost_score(F.col("cost_eur"), F.col("n")).alias("fraction")))
    dimensions = parts[0]
    for p in parts[1:]:
        dimensions = dimensions.unionByName(p)
    names = F.create_map(*[x for k, v in scoring.NAMES.items() for x in (F.lit(k), F.lit(v))])
    weights = F.create_map(*[x for k, v in scoring.WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    rows = dimensions.join(intervals[0].unionByName(intervals[1]).unionByName(intervals[2]), ["book_key", "key"], "left").withColumns({"name": names[F.col("key")], "weight": weights[F.col("key")]})
    repeated = verdicts.select("book_key", "id", F.explode("meaning").alias("v"))
    totals = scoring.weighted_total(dimensions).join(sampling.noise(repeated, ["book_key"], "id", "v"), "book_key", "left")
    return rows, totals.join(total_intervals(dimensions, means, screens, resamples), "book_key", "left")


def plan_experiment(source: DataFrame, controls: DataFrame, *, variant: str, control_version: str, runs: int = 20, run_length: int = 3, context_pairs: int = 2, seed: int = 42) -> DataFrame:
    """The chosen runs' rows: whole runs of the body by hash order, without any call."""
    if variant == control_version:
        raise ExperimentError(f"the variant has the control's version {variant!r}: its cache would serve the control")
    pool = experiment.candidate_runs(experiment.eligible_blocks(source, controls), run_length=run_length, context_pairs=context_pairs)
    body = segments.restrict_to_body(pool, segments.flagged_chapters(source), runs * run_length)
    heads = body.where("slot = 0").select("book_key", "run")
    chosen = sampling.hash_sample(heads, F.concat_ws(":", "book_key", F.col("run").cast("string")), runs, seed, ["book_key"])
    return body.join(chosen, ["book_key", "run"], "left_semi")


def run_experiment(runs: DataFrame, variants: DataFrame, make_judge: Callable[[], Judge], *, seed: int = 42, resamples: int = sampling.RESAMPLES) -> DataFrame:
    """Deltas of the variant's texts (book_key, id, target_text) against the controls, runs as clusters: rows (book_key, key, ...)."""
    both = runs.select("book_key", "run", "id", "text", F.col("control").alias("control_text")).join(variants.select("book_key", "id", "target_text"), ["book_key", "id"], "left")
    if both.where("target_text is null").limit(1).count():
        raise ExperimentError("the variant lacks translations of judged segments")
    columns = "book_key string, run long, id string, control_meaning double, variant_meaning double, control_fluency double, variant_fluency double"

    def judge_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = make_judge()
        for f in frames:
            rows = [(r.book_key, r.run, r.id, judge.meaning(r.text, r.control_text), judge.meaning(r.text, r.target_text), judge.fluency(r.control_text), judge.fluency(r.target_text)) for r in f.itertuples()]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")])

    scored = both.mapInPandas(judge_rows, columns).persist()
    of = lambda name, key: experiment.paired_delta(scored, ["book_key"], "run", f"control_{name}", f"variant_{name}", seed=seed, resamples=resamples).withColumn("key", F.lit(key))
    return of("meaning", "T2").unionByName(of("fluency", "T3"))
