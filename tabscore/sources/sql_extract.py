"""Parameterised SQL extracts.

Values are always bound with ``spark.sql(text, args=...)``; table and column
names go through ``IDENTIFIER(:name)``.  Lists of names (features, sample key)
cannot be a single parameter, so they are checked against the table's schema
on the driver and back-quoted before being placed in the text.  No value is
ever formatted into SQL.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from importlib import resources

from pyspark.sql import DataFrame, SparkSession

from tabscore.functions.hashing import sql_key_text

DATE_TYPES = ("date", "timestamp", "timestamp_ntz")


def load_template(name: str) -> str:
    return resources.files("tabscore").joinpath("sql", name).read_text()


def quote_identifier(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _columns(spark: SparkSession, table: str) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in spark.table(table).schema.fields}


def _checked(cols: dict[str, str], names: Sequence[str], what: str) -> list[str]:
    missing = [n for n in names if n not in cols]
    if missing:
        raise ValueError(f"{what} not in table: {missing}")
    return [quote_identifier(n) for n in names]


def _date_type(cols: dict[str, str], date_column: str) -> str:
    if date_column not in cols:
        raise ValueError(f"date column {date_column!r} not in table")
    t = cols[date_column]
    if t not in DATE_TYPES:
        raise ValueError(f"date column {date_column!r} has type {t}, expected one of {DATE_TYPES}")
    return t


def _day(d) -> _dt.date:
    from tabscore.functions.dates import as_day
    return as_day(d)


def render(template: str, **identifier_lists: str) -> str:
    text = template
    for key, value in identifier_lists.items():
        text = text.replace("{" + key + "}", value)
    return text


def training_extract(spark: SparkSession, table: str, features: Sequence[str], target_column: str,
                     date_column: str, start_date, end_date, sample_fraction: float = 1.0,
                     sample_key: Sequence[str] | str | None = None, sample_seed: str | None = None,
                     template: str | None = None) -> DataFrame:
    """Features + ``target`` for rows with start_date <= day(date_column) <= end_date.

    Labels that are NULL or, in a floating column, NaN are left out.  The
    sample keeps rows whose key hash (``functions.hashing``) falls below the
    fraction; a fraction below 1 needs a ``sample_key``, since equal feature
    rows would otherwise all be kept or all be dropped.
    """
    cols = _columns(spark, table)
    feats = _checked(cols, features, "features")
    _checked(cols, [target_column], "target column")
    present = "IDENTIFIER(:target_column) IS NOT NULL"
    if cols[target_column] in ("float", "double"):
        present += " AND NOT isnan(IDENTIFIER(:target_column))"
    if sample_fraction >= 1:
        key_text = "'all'"     # every row
    elif not sample_key:
        raise ValueError("a sample fraction below 1 needs a sample_key")
    else:
        qkeys = _checked(cols, [sample_key] if isinstance(sample_key, str) else list(sample_key), "sample key")
        key_text = sql_key_text(qkeys, sample_seed, seed_text=":sample_seed")
    text = render(template or load_template("training_extract.sql"),
                  features=", ".join(feats), date_type=_date_type(cols, date_column),
                  sample_key=key_text, label_present=present)
    start, end = _day(start_date), _day(end_date)
    args = {"table_name": table, "target_column": target_column, "date_column": date_column,
            "window_start": start.isoformat(), "window_end": (end + _dt.timedelta(days=1)).isoformat(),
            "sample_fraction": float(sample_fraction)}
    if sample_seed is not None and sample_fraction < 1:
        args["sample_seed"] = str(sample_seed)
    return spark.sql(text, args=args)


def scoring_extract(spark: SparkSession, table: str, id_column: str, features: Sequence[str],
                    date_column: str, scoring_date, template: str | None = None) -> DataFrame:
    """Id + features for the rows of one day."""
    cols = _columns(spark, table)
    text = render(template or load_template("scoring_extract.sql"),
                  id_column=_checked(cols, [id_column], "id column")[0],
                  features=", ".join(_checked(cols, features, "features")),
                  date_type=_date_type(cols, date_column))
    day = _day(scoring_date)
    args = {"table_name": table, "date_column": date_column, "day_start": day.isoformat(),
            "day_end": (day + _dt.timedelta(days=1)).isoformat()}
    return spark.sql(text, args=args)


def run_sql(spark: SparkSession, text: str, args: dict | None = None) -> DataFrame:
    """Any user template with bound parameters."""
    return spark.sql(text, args=args or {})
