"""Streams: the masks that need a row's own values only, windows with watermarks, and keys from a static parent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MaskError
from ..operators import relations
from ..plans.compile import Plan, streamable


def mask_stream(plan: Plan, table: str, stream: DataFrame) -> DataFrame:
    """The same expressions as for a batch, `when` included; refused if a column needs more than its row.

    A stream can't be asked beforehand whether its texts need normalising, so those of keyed strategies are looked at one by one.
    """
    from ..plans.run import KEYED_TEXTS, value_mask

    if not streamable(plan, table):
        raise MaskError("stream_unsupported", table)
    masked = {c.name: value_mask(plan, table, c, stream, c.strategy in KEYED_TEXTS) for c in plan.config.tables[table].columns}
    return stream.select(*[masked[x].alias(x) if x in masked else F.col(x) for x in stream.columns])


def resolve_stream(stream: DataFrame, columns: tuple[str, ...], parents: list[DataFrame], policy: str = "preserve") -> DataFrame:
    """Foreign keys of a stream against static key maps."""
    return relations.resolve(stream, columns, parents, policy)


def tumbling(stream: DataFrame, time: str, width: str, by: list[str], value: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(window start, keys, n, total) of tumbling or sliding windows; rows later than `late` are dropped on a stream."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = stream.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(stream: DataFrame, time: str, gap: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")


def first_seen(stream: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
