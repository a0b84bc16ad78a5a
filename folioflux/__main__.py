"""Command line: `python -m folioflux inspect|estimate|translate|catalog PATH`, `eval PATH --source PATH`, `doctor`."""

from __future__ import annotations

import argparse
import importlib.util
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _show(rows: DataFrame, as_json: bool) -> None:
    """A table, or a line of JSON for each row."""
    if not as_json:
        rows.show(1000, truncate=False)
        return
    for line in rows.toJSON().toLocalIterator():
        print(json.dumps(json.loads(line), ensure_ascii=False, sort_keys=True))


def diagnose(spark: SparkSession, model: str, cache: str) -> list[tuple[str, bool, str]]:
    """(what, whether it is well, detail) of what a run needs."""
    from folioflux.functions import money
    from folioflux.operators import store

    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    rows = [("model", model in money.PRICES, f"{model}: {'priced' if model in money.PRICES else 'no price'}"), ("shared folder", bool(folder) or spark.sparkContext.master.startswith("local"), folder or "none set")]
    for name in ("pyarrow", "pandas", "numpy"):
        rows.append((f"package {name}", importlib.util.find_spec(name) is not None, "needed by Arrow batches"))
    for name in ("ahocorasick", "tiktoken", "tokenizers", "xxhash", "zstandard"):
        there = importlib.util.find_spec(name) is not None
        rows.append((f"package {name}", True, "there" if there else "absent: the llm operators are left out"))
    kept = store.Store(spark, cache)
    rows.append(("cache", True, ", ".join(f"{t}: {kept.read(t).count()}" for t in store.SCHEMAS)))
    return rows


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="folioflux")
    parser.add_argument("verb", choices=("inspect", "estimate", "translate", "catalog", "eval", "doctor"))
    parser.add_argument("path", nargs="?")
    parser.add_argument("--source", help="eval: the book that PATH is a translation of")
    parser.add_argument("--sample", type=int, default=40, help="eval: paragraphs that are judged")
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--json", action="store_true", help="a line of JSON for each row")
    parser.add_argument("--skip-back-matter", action="store_true", help="leave notes, index and the like untranslated")
    parser.add_argument("--no-glossary", action="store_true")
    parser.add_argument("--to", default="sl")
    parser.add_argument("--model", default="gpt-5-mini")
    parser.add_argument("--batch-size", type=int, default=20)
    parser.add_argument("--concurrency", type=int, default=4)
    parser.add_argument("--cache", default="cache")
    parser.add_argument("--output")
    parser.add_argument("--dry-run", action="store_true")
    given = parser.parse_args(arguments)
    if given.path is None and given.verb != "doctor":
        parser.error(f"{given.verb} needs a path")
    if given.verb == "eval" and not given.source:
        parser.error("eval needs --source")

    from folioflux.functions import identity, text
    from folioflux.operators import catalog, planning, segments, store
    from folioflux.plans import connectors, evaluate, execute, memos
    from folioflux.sources import books, epub

    spark = SparkSession.builder.appName("folioflux").getOrCreate()
    if given.verb == "doctor":
        found = diagnose(spark, given.model, given.cache)
        for what, well, detail in found:
            print(json.dumps({"what": what, "well": well, "detail": detail}) if given.json else f"{'ok  ' if well else 'FAIL'} {what}: {detail}")
        return 0 if all(well for _, well, _ in found) else 1
    if given.verb == "catalog":
        files = epub.read(spark, given.path).withColumn("size_bytes", F.length("content").cast("long"))
        listed = epub.books(files).join(files.select("book_key", "path", "size_bytes"), "book_key")
        _show(catalog.listing(listed.withColumn("language", F.coalesce("language", F.lit("")))).select("title", "author_line", "size", "download_name").orderBy(F.lower("title")), given.json)
        return 0
    about, rows, images = books.normalize(spark, given.path)
    if given.verb == "inspect":
        _show(segments.inventory(rows), given.json)
        return 0
    if given.verb == "eval":
        _, source, _ = books.normalize(spark, given.source)
        one = lambda df: df.withColumn("book_key", F.lit("book"))  # noqa: E731  one book under two names
        model = given.model
        dimensions, totals = evaluate.score_books(one(source), one(rows), lambda: connectors.Judge(connectors.create_client(model)), sample_size=given.sample, seed=given.seed)
        _show(dimensions.orderBy("key"), given.json)
        _show(totals, given.json)
        return 0
    skipped = rows.where(text.is_skippable_title(F.col("chapter_title")) if given.skip_back_matter else F.lit(False)).select("book_key", "id")
    estimate = planning.estimate_total(planning.estimate_by_chapter(rows, skipped, batch_size=given.batch_size, model=given.model), model=given.model, glossary=not given.no_glossary)
    if given.verb == "estimate" or given.dry_run:
        _show(estimate, given.json)
        return 0
    connectors.create_client(given.model)  # an unpriced model fails before any work
    cache = store.Store(spark, given.cache)
    for book_key, book_hash, _ in identity.book_hashes(rows).collect():
        own = rows.where(F.col("book_key") == book_key)
        model = given.model
        terms = None if given.no_glossary else memos.build_glossary(own, connectors.create_client(model), cache, book_hash=book_hash, lang=given.to)
        done = execute.translate(own, cache, lambda model=model: connectors.create_client(model), book_hash=book_hash, model=model, lang=given.to, glossary=terms, skipped=skipped, batch_size=given.batch_size, lanes=given.concurrency)
        book = about.where(F.col("book_key") == book_key).withColumn("language", F.lit(given.to))
        out = epub.build_books(book, done.withColumn("text", F.col("target_text")), images.where(F.col("book_key") == book_key)).first()["epub"]
        target = given.output or books.output_path(f"{book_key}.epub", given.to)
        with open(target, "wb") as f:
            f.write(bytes(out))
        print(target)
    return 0


if __name__ == "__main__":
    sys.exit(main())
