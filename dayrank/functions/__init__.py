"""Column expressions shared by the operators. All are built-in Spark expressions.

The wide families (96 profile cells, ratios, averages) are given as SQL text for
``selectExpr``: one call for a whole column list instead of several per column.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayrank.schema import BEHAVIOURS, HOURS, PURCHASE, RATIOS, profile_columns

N_CELLS = len(HOURS) * len(BEHAVIOURS)
#: Number of the hour-by-behaviour cell, 0 to 95, in the order of the profile columns; null for
#: rows with an hour or a behaviour outside the domain or missing, which are in no cell.
CELL = (
    f"CASE WHEN hour BETWEEN {HOURS[0]} AND {HOURS[-1]}"
    f" AND behavior_type BETWEEN {BEHAVIOURS[0]} AND {BEHAVIOURS[-1]}"
    f" THEN CAST(hour * {len(BEHAVIOURS)} + behavior_type - {BEHAVIOURS[0]} AS INT) END"
)


def day_of(time: Column) -> Column:
    """Day of a ``YYYY-MM-DD HH`` string."""
    return F.substring_index(time, " ", 1).cast("date")


def hour_of(time: Column) -> Column:
    """Hour of a ``YYYY-MM-DD HH`` string as an integer."""
    return F.substring_index(time, " ", -1).cast("int")


def ratio(actions: str, purchases: str) -> str:
    """Actions per purchase; 0 where there was no purchase."""
    return f"coalesce(try_divide(CAST({actions} AS DOUBLE), CAST({purchases} AS DOUBLE)), 0D)"


def ratios(counts_stem: str, out_stem: str) -> dict[str, str]:
    """The click, skim and collect ratios of a family of behaviour counts, by column name."""
    return {
        f"{out_stem}_{name}": ratio(f"{counts_stem}_b{b}", f"{counts_stem}_b{PURCHASE}")
        for name, b in RATIOS.items()
    }


def averages(counts_stem: str, out_stem: str, slot: int) -> dict[str, str]:
    """Counts per day of the slot, whatever number of days holds data, by column name."""
    return {
        f"{out_stem}_b{b}": f"CAST({counts_stem}_b{b} AS DOUBLE) / {slot}D" for b in BEHAVIOURS
    }


def profile(cells: str, stem: str) -> dict[str, str]:
    """The 96 hour-by-behaviour counts out of a cell -> count map, by column name."""
    return {
        name: f"coalesce({cells}[{i}], 0L)" for i, name in enumerate(profile_columns(stem))
    }


def aliased(expressions: dict[str, str]) -> list[str]:
    return [f"{text} AS {name}" for name, text in expressions.items()]


def add_purchase_flag(df: DataFrame) -> DataFrame:
    """Set ``build_label`` to the purchase flag, added to the column if it is there already."""
    flag = F.coalesce((F.col("behavior_type") == PURCHASE).cast("int"), F.lit(0))
    if "build_label" in df.columns:
        flag = F.coalesce(F.col("build_label"), F.lit(0)) + flag
    return df.withColumn("build_label", flag)


def literal_table(
    spark: SparkSession, columns: Sequence[str], rows: Sequence[Sequence[date | bool | int | str]]
) -> DataFrame:
    """A small table written into the plan. Strings are taken as SQL text."""

    def text(value: date | bool | int | str) -> str:
        return f"DATE '{value.isoformat()}'" if isinstance(value, date) else str(value)

    body = ", ".join("(" + ", ".join(map(text, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")
