"""Typed landing of the raw CSV logs (three facts, three dimensions)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.functions.parsing import as_date, as_timestamp, blank_to_null
from adloom.schemas import CSV_SCHEMAS


# Where a line that does not fit the schema is kept as it stands.
MALFORMED = "malformed_line"


def read_csv(spark: SparkSession, path: str, schema: str, malformed: bool = False) -> DataFrame:
    """CSV with a header and a declared schema. A missing path is an error; nothing is inferred.

    A line with too few or too many fields, or a field that its column cannot hold, is read as far as it goes; with
    ``malformed`` the whole line is kept in the column of that name.
    """
    reader = spark.read.option("header", True)
    if malformed:
        schema = f"{schema}, {MALFORMED} string"
        # Without its unused columns a line would not be seen to have too many.
        reader = reader.option("columnNameOfCorruptRecord", MALFORMED).option("columnPruning", False)
    try:
        return reader.schema(schema).csv(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no raw CSV at {path}") from error
        raise


def type_events(raw: DataFrame) -> DataFrame:
    return raw.withColumn("event_time", as_timestamp(raw, "event_time"))


def type_conversions(raw: DataFrame) -> DataFrame:
    return raw.withColumns(
        {"conv_time": as_timestamp(raw, "conv_time"), "gmv_amount": F.col("gmv_amount").try_cast("double")}
    )


def type_cost(raw: DataFrame) -> DataFrame:
    return raw.withColumn("cost", F.col("cost").try_cast("double"))


def type_user_profile(raw: DataFrame) -> DataFrame:
    return raw.withColumns({"age": F.col("age").try_cast("int"), "register_dt": as_date(raw, "register_dt")})


def type_ad_meta(raw: DataFrame) -> DataFrame:
    """Typed dates; a blank product is an ad without product."""
    return raw.withColumns(
        {
            "product_id": blank_to_null(F.col("product_id")),
            "start_dt": as_date(raw, "start_dt"),
            "end_dt": as_date(raw, "end_dt"),
        }
    )


def type_ad_slot(raw: DataFrame) -> DataFrame:
    return raw.withColumn("price_factor", F.col("price_factor").try_cast("double"))


TYPERS = {
    "ad_event_log": type_events,
    "conversion_log": type_conversions,
    "ad_cost": type_cost,
    "user_profile": type_user_profile,
    "ad_meta": type_ad_meta,
    "ad_slot": type_ad_slot,
}


def land(spark: SparkSession, source: str, path: str) -> DataFrame:
    """Read raw source ``source`` (a key of ``CSV_SCHEMAS``) and give its columns their types."""
    return TYPERS[source](read_csv(spark, path, CSV_SCHEMAS[source]))


def with_losses(source: str, raw: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """The typed rows of ``raw`` and, by name, the condition for every way in which a row lost something by that.

    A value is lost where text was present and the typed column is NULL. Raw text is carried in extra columns until the
    conditions have been counted (see ``sinks.store_days``).
    """
    landed = TYPERS[source](raw)
    typed = [f.name for f in raw.schema if landed.schema[f.name].dataType != f.dataType]
    kept = TYPERS[source](raw.withColumns({f"raw_{c}": F.col(c) for c in typed}))
    present = {c: F.nullif(F.trim(F.col(f"raw_{c}").cast("string")), F.lit("")).isNotNull() for c in typed}
    losses = {f"{c} lost": present[c] & F.col(c).isNull() for c in typed}
    if MALFORMED in raw.columns:
        losses["malformed line"] = F.col(MALFORMED).isNotNull()
    return kept, losses


def land_counted(spark: SparkSession, source: str, path: str) -> tuple[DataFrame, dict[str, Column]]:
    """``land`` with what was lost on the way."""
    return with_losses(source, read_csv(spark, path, CSV_SCHEMAS[source], malformed=True))
