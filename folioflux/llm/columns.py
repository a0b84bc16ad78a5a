"""Columns that are computed from a text column by Arrow functions; the other columns never leave the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from folioflux.llm import bytewords as bw
from folioflux.llm.shared import bound_batches, release, released


def with_text_column(documents: DataFrame, name: str, kind: DataType, text: str, make: Callable[[], Callable[[pa.Array], pa.Array]], *, most: int = bw.SLICE_BYTES) -> DataFrame:
    """The documents with column `name`: make() is called once in a task and gives a function of text arrays of about `most` bytes.

    Called once for each row, whatever reads the column: it counts as non-deterministic, so no filter is evaluated by calling it again.
    """
    bound_batches(documents.sparkSession)
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = make()
        for texts in released(batches):
            parts = [of(part.column(0)) for part in bw.slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", most)]
            yield pa.concat_arrays([p.cast(arrow) for p in parts]) if parts else pa.array([], arrow)
            del texts, parts
        del of
        release()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return documents.withColumn(name, arrow_udf(run, kind).asNondeterministic()(documents[text]))
