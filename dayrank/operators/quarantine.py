"""Rows that cannot be read go to a table of their own, with the reason, and are counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The line of a row that could not be parsed, null for others.
MALFORMED = "_malformed"
#: A row has other columns than the schema, or a value that is not of its column's type.
UNPARSABLE = "unparsable"
#: The time is missing, not written as day and hour, or no day or hour that exists.
BAD_TIME = "bad_time"


def bad_time(time: Column) -> Column:
    """Whether a time is not a ``YYYY-MM-DD HH`` that exists."""
    shaped = time.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{1,2}$")
    day = F.substring_index(time, " ", 1).try_cast("date")
    hour = F.substring_index(time, " ", -1).try_cast("int")
    return ~F.coalesce(shaped & day.isNotNull() & hour.between(0, 23), F.lit(False))


def reason(columns: Sequence[str]) -> Column:
    """Why a row is not taken, null for rows that are."""
    found = F.when(F.col(MALFORMED).isNotNull(), UNPARSABLE)
    return found.when(bad_time(F.col("time")), BAD_TIME) if "time" in columns else found


def accepted(rows: DataFrame) -> DataFrame:
    """The rows that can be read. A missing id, category or behaviour is no fault: such rows count for
    what they do have."""
    return rows.filter(reason(rows.columns).isNull()).drop(MALFORMED)


def quarantined(rows: DataFrame) -> DataFrame:
    """The other rows, as their line and the reason."""
    columns = [c for c in rows.columns if c != MALFORMED]
    line = F.coalesce(F.col(MALFORMED), F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))
    return rows.select(line.alias("line"), reason(rows.columns).alias("reason")).filter("reason IS NOT NULL")


def counts(quarantine: DataFrame) -> DataFrame:
    """Quarantined rows by reason."""
    return quarantine.groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))
