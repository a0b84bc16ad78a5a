"""Unicode normal forms and case folding, which have no built-in function; vectorised over Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioflux.functions.text import clean_title


@F.pandas_udf(StringType())
def casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else v.casefold())


@F.pandas_udf(StringType())
def nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


@F.pandas_udf(StringType())
def _ascii(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else re.sub(r"[^a-z0-9]+", " ", unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode().lower()).strip())


def outline_key(title: Column) -> Column:
    """For comparing titles: white space collapsed, case folded."""
    from folioflux.functions.text import collapse

    return casefold(collapse(title))


def slugify(title: Column) -> Column:
    """At most eight words of [a-z0-9] with hyphens between; `untitled` if none is left."""
    words = F.slice(F.split(_ascii(clean_title(title)), " "), 1, 8)
    slug = F.array_join(words, "-")
    return F.when(F.length(slug) > 0, slug).otherwise("untitled")
