"""The catalogue of named queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans.model_sql import with_model

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *, text: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that gives the same rows.

    The result is reported with dates and timestamps as ISO text and integers as
    BIGINT. ``text`` names the SQL columns to turn into text.
    """

    def register(build: Query) -> Query:
        name = build.__name__.removeprefix("_")
        QUERIES[name] = lambda spark, sf_dir: reported(build(spark, sf_dir))
        if sql is not None:
            body = sql
            if text:
                casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in text)
                body = f"SELECT * REPLACE ({casts}) FROM (\n{sql}\n) AS result"
            ORACLES[name] = with_model(body)
        return build

    return register


def reported(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text, integers as BIGINT; order is kept."""

    kinds = {"date": "STRING", "timestamp_ntz": "STRING", "int": "BIGINT"}
    return df.selectExpr(
        *[
            f"CAST(`{name}` AS {kinds[kind]}) AS `{name}`" if kind in kinds else f"`{name}`"
            for name, kind in df.dtypes
        ]
    )


def scratch(spark: SparkSession) -> str:
    """A new folder for written tables, below the shared folder the cluster names.

    Where the session names none, it lies in the warehouse of a local master; on a cluster that might be a
    folder of each machine, so it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to scratch and read back: computed once, and of known size."""
    path = f"{scratch(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
