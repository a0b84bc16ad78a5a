"""What is asked once for a book and kept: its glossary and its style memo; and the screening of extracted paragraphs."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.functions import money
from folioflux.operators import store
from folioflux.plans import excerpts
from folioflux.plans.connectors import JUDGE_ATTEMPTS, Client

# ---- fixed values: sizes --------------------------------------------------------------------------------------------------------------
SAMPLE_CHAPTERS, SAMPLE_CHARS, MAX_TERMS, MEMO_CHARS = 6, 12_000, 80, 6_000
GLOSSARY_PROMPT = "List the recurring names and terms of this text with their renderings as one JSON object."
MEMO_PROMPT = "Describe the style of this text in at most 90 words."


class ScreenError(RuntimeError):
    pass


def parse_glossary(reply: str) -> dict[str, str]:
    """The pairs of the JSON object in a reply, in its order, blanks left out, at most MAX_TERMS. Nothing readable gives none."""
    m = re.search(r"\{.*\}", reply, re.DOTALL)
    try:
        found = json.loads(m[0]) if m else {}
    except ValueError:
        return {}
    pairs = [(str(k).strip(), v.strip()) for k, v in found.items() if isinstance(v, str) and str(k).strip() and v.strip()]
    return dict(pairs[:MAX_TERMS])


def glossary_version(*, sample_chapters: int = SAMPLE_CHAPTERS, max_chars: int = SAMPLE_CHARS, max_terms: int = MAX_TERMS) -> str:
    """Changes with the prompt and with what is sampled."""
    return "glossary_" + hashlib.sha1(f"{GLOSSARY_PROMPT}\0{sample_chapters}\0{max_chars}\0{max_terms}".encode()).hexdigest()[:12]


def _remembered(cache: store.Store, table: str, key: dict[str, str], column: str) -> str | None:
    rows = cache.read(table)
    for name, value in key.items():
        rows = rows.where(F.col(name) == value)
    found = rows.agg(F.max_by(column, "created_at")).first()
    return found[0]


def _ask_once(cache: store.Store, table: str, key: dict[str, str], column: str, ask: Callable[[], tuple[str, object]]) -> str:
    """What is kept under the key, or the answer to one call, kept together with the call's price."""
    known = _remembered(cache, table, key, column)
    if known is not None:
        return known
    value, billed = ask()
    spark = cache.spark
    cache.replace(table, spark.createDataFrame([(*key.values(), value, 0.0)], store.SCHEMAS[table]).withColumn("created_at", F.unix_timestamp().cast("double")))
    call = (hashlib.sha1(f"{table}\0{key}".encode()).hexdigest(), key["book_hash"], key["model"], key["lang"], column, billed.input_tokens, billed.output_tokens, billed.cost_eur, 0.0)
    cache.append("calls", spark.createDataFrame([call], store.SCHEMAS["calls"]), "call_id")
    return value


def build_glossary(segments: DataFrame, client: Client, cache: store.Store, *, book_hash: str, lang: str) -> dict[str, str]:
    """Terms of one book from one call over evenly spaced chapters, remembered under the sampling's version."""
    key = {"book_hash": book_hash, "model": client.model, "lang": lang, "prompt_version": glossary_version()}

    def ask() -> tuple[str, object]:
        sample = excerpts.opening(excerpts.spaced_chapters(segments, SAMPLE_CHAPTERS), SAMPLE_CHARS).first()
        got = client.complete(f"{GLOSSARY_PROMPT}\n\n{sample['excerpt'] if sample else ''}")
        return json.dumps(parse_glossary(got.text), ensure_ascii=False), got

    return json.loads(_ask_once(cache, "glossaries", key, "terms_json", ask))


def build_memo(segments: DataFrame, client: Client, cache: store.Store, *, book_hash: str, lang: str, prompt_version: str) -> str:
    """One book's style memo from its opening; an empty memo is remembered too."""
    key = {"book_hash": book_hash, "model": client.model, "lang": lang, "prompt_version": prompt_version}

    def ask() -> tuple[str, object]:
        sample = excerpts.opening(segments, MEMO_CHARS).first()
        got = client.complete(f"{MEMO_PROMPT}\n\n{sample['excerpt'] if sample else ''}")
        return got.text.strip(), got

    return _ask_once(cache, "book_contexts", key, "memo", ask)


def screen(sample: DataFrame, make_client: Callable[[], Client]) -> DataFrame:
    """The sample with clean and cost_eur: whether a paragraph has no marks of bad extraction. Unreadable replies raise."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sample.schema) + ", clean boolean, cost_eur double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for frame in frames:
            clean, cost = [], []
            for text in frame["text"]:
                spent = 0.0
                for _ in range(JUDGE_ATTEMPTS):
                    got = client.complete(f"Is this paragraph clean? Answer YES or NO.\n\n{text}")
                    spent += got.cost_eur
                    word = got.text.strip().lower()
                    if word.startswith(("yes", "no")):
                        break
                else:
                    raise ScreenError(f"neither yes nor no: {got.text[:60]!r}")
                clean.append(word.startswith("yes"))
                cost.append(spent)
            yield frame.assign(clean=clean, cost_eur=cost)

    return sample.mapInPandas(run, schema)


def screen_report(screened: DataFrame, by: list[str]) -> DataFrame:
    """(by, total, n_clean, fraction, cost_eur): the fraction is 0 without any."""
    n = F.count_if("clean")
    return screened.groupBy(*by).agg(F.count("*").alias("total"), n.alias("n_clean"), F.coalesce(n / F.count("*"), F.lit(0.0)).alias("fraction"), F.sum("cost_eur").alias("cost_eur"))


def judge_cost(runs: DataFrame, model: str) -> DataFrame:
    """(book_key, calls, cost_eur) of judging: four calls a segment, their texts and a short reply each, and what reasoning adds."""
    money.require_priced(model)
    extra = money.REASONING_PER_CALL if money.is_reasoning_model(model) else 0
    sums = runs.groupBy("book_key").agg((F.count("*") * 4).alias("calls"), F.sum(F.floor(F.length("text") / money.CHARS_PER_TOKEN) * 6).alias("i"))
    return sums.select("book_key", "calls", money.model_cost(model, F.col("i") + F.col("calls") * 100, F.col("calls") * (10 + extra)).alias("cost_eur"))


def eur_per_words(cost: Column, words: Column, unit: int = 1000) -> Column:
    return cost / (words / unit)
