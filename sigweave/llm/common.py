"""What the operators of this folder share: reading tables, fixing intermediates, Arrow maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import reuse as settle  # noqa: F401  compute once into the shared checkpoint folder

#: Rows per Arrow batch while whole texts travel to Python: bounds a worker's memory.
TEXT_BATCH_ROWS = 512
#: The characters that separate words in the contracts.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, limit: int = 50_000) -> DataFrame:
    """A settled table, hinted for broadcast only if counting shows at most ``limit`` rows.

    Above the limit the join stays a shuffled one, which adaptive execution splits on skew.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def whole_text(text: Column | str = "text") -> Column:
    """The text, with null as the empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def text_last(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The columns ``keep`` and, last, the whole text under a name that none of them has."""
    name = "_text"
    while name.lower() in {c.lower() for c in keep}:
        name = "_" + name
    return docs.select(*[F.col(f"`{c}`") for c in keep], whole_text(text).alias(name))


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str,
              rows: int = TEXT_BATCH_ROWS) -> DataFrame:
    """mapInArrow over batches of at most ``rows`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield work(batch.slice(start, rows))

    return df.mapInArrow(run, schema)
