"""Translation styles as a small table, and their resolution for a language and tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.functions.text import normalize_lang

#: fixed values: (tier, primary language or null for any, style)
STYLES = [("quality", "sl", "revise_sl"), ("quality", None, "revise"), ("economy", "sl", "baseline_sl"), ("economy", None, "baseline")]
LANGUAGES = {"revise_sl": ("sl",), "baseline_sl": ("sl",), "revise": None, "baseline": None}
TIERS = {"workstation": "quality", "device": "economy"}


class StyleLanguageError(ValueError):
    pass


def style_names() -> list[str]:
    return sorted(LANGUAGES)


def supports(style: str, lang: str) -> bool:
    if style not in LANGUAGES:
        raise KeyError(f"no style {style!r}; there are {', '.join(style_names())}")
    own = LANGUAGES[style]
    return own is None or lang.strip().lower().replace("_", "-").split("-")[0] in own


def ensure_supports(style: str, lang: str) -> str:
    if not supports(style, lang):
        raise StyleLanguageError(f"style {style} is for {', '.join(LANGUAGES[style])}, not {lang!r}; try {resolve_one(lang)}")
    return style


def resolve_one(lang: str, *, requested: str | None = None, context: str = "workstation", tier: str | None = None) -> str:
    if requested is not None:
        return ensure_supports(requested, lang)
    primary = lang.strip().lower().replace("_", "-").split("-")[0]
    rows = {(t, p): s for t, p, s in STYLES}
    tier = tier or TIERS[context]
    return rows.get((tier, primary), rows[tier, None])


def resolve(requests: DataFrame, spark: SparkSession) -> DataFrame:
    """requests (lang, tier, ...) with primary and style: the row of tier and language, else the tier's row for any."""
    styles = F.broadcast(spark.createDataFrame(STYLES, "tier string, primary string, style string"))
    keyed = requests.withColumn("primary", normalize_lang(F.col("lang")))
    bound = styles.where("primary is not null").withColumnRenamed("style", "bound")
    other = styles.where("primary is null").select("tier", F.col("style").alias("other"))
    return keyed.join(bound, ["tier", "primary"], "left").join(other, "tier").withColumn("style", F.coalesce("bound", "other")).drop("bound", "other")
