"""Raw readings: CSV scan, rename projection, and the adapter for the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gaugeflow.config import ANALOG, ASSET, CSV_COLUMNS, DIGITAL, READING_TIME

DOUBLE = T.DoubleType()


def csv_schema() -> T.StructType:
    """Declared schema of the CSV export, so that no inference pass is needed."""
    def kind(name: str) -> T.DataType:
        if name == READING_TIME:
            return T.TimestampNTZType()
        return T.IntegerType() if name in DIGITAL else DOUBLE

    return T.StructType([T.StructField(header, kind(name))
                         for header, name in CSV_COLUMNS.items()])


def rename_readings(raw: DataFrame) -> DataFrame:
    return raw.select(*[F.col(f"`{header}`").alias(name)
                        for header, name in CSV_COLUMNS.items() if header in raw.columns],
                      *[c for c in raw.columns if c not in CSV_COLUMNS])


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             sampling_ratio: float | None = None) -> DataFrame:
    """Scan a CSV export with declared types, matched to its header by name.

    Only the header line is read for that; columns without a declared type come
    as strings, and a file with another header is an error.  ``sampling_ratio``
    switches to type inference over that share of rows; it is for profiling an
    unknown file, not for pipelines.
    """
    reader = spark.read.option("header", True)
    if sampling_ratio is not None:
        return (reader.option("inferSchema", True).option("samplingRatio", sampling_ratio)
                .option("preferDate", True).csv(path))
    declared = {f.name: f.dataType for f in (schema or csv_schema())}
    header = reader.csv(path).columns
    in_order = T.StructType([T.StructField(c, declared.get(c, T.StringType())) for c in header])
    return reader.schema(in_order).option("enforceSchema", False).csv(path)


REJECTED = "_rejected_line"


def scan_csv_checked(spark: SparkSession, path: str, schema: T.StructType | None = None
                     ) -> tuple[DataFrame, DataFrame]:
    """The rows of a CSV export that fit their declared types, and the lines that do not.

    ``scan_csv`` turns a value it cannot read into NULL. Here a line with such a value, or with
    more or fewer fields than the header, goes as a whole to the second table (source file, line),
    which can be counted, kept and read again after repair. Empty fields are NULLs, no faults.
    """
    declared = {f.name: f.dataType for f in (schema or csv_schema())}
    header = spark.read.option("header", True).csv(path).columns
    in_order = T.StructType([T.StructField(c, declared.get(c, T.StringType())) for c in header])
    parsed = (spark.read.option("header", True).option("enforceSchema", False)
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", REJECTED)
              .schema(in_order.add(REJECTED, T.StringType()))
              .csv(path).withColumn("_file", F.input_file_name()))
    # a line is judged by the fields that are read; true for every row, this asks for all of them
    whole = (F.xxhash64(*[f"`{c}`" for c in header]) % 2).between(-1, 1)
    good = parsed.filter(F.col(REJECTED).isNull() & whole).select(*[f"`{c}`" for c in header])
    bad = parsed.filter(F.col(REJECTED).isNotNull() & whole).select(
        F.col("_file").alias("source_file"), F.col(REJECTED).alias("line"))
    return good, bad


def load_readings(spark: SparkSession, path: str, asset: int = 0) -> DataFrame:
    """Readings of one machine from its CSV export, keyed by ``asset``."""
    return rename_readings(scan_csv(spark, path)).withColumn(ASSET, F.lit(asset))


def readings_from_events(events: DataFrame) -> DataFrame:
    """Read an application event log as sensor telemetry of four machines."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    value, user, kind = F.col("value"), F.col("user_id"), F.col("event_type")

    def on(condition):
        return F.when(condition, 1).otherwise(0)

    e = events.withColumn("k", k)
    k = F.col("k")
    return e.select(
        F.col("ts").alias(READING_TIME),
        (user % 4).cast("int").alias(ASSET),
        (value / 10.0).alias("tp2"),
        (F.lit(8.0) + k / 100.0).alias("tp3"),
        (value / 20.0).alias("h1"),
        (k / 50.0).alias("dv_pressure"),
        (F.lit(8.0) + (user % 100) / 100.0).alias("reservoirs"),
        value.alias("oil_temperature"),
        F.when(kind.isin("view", "click"), value / 100.0).alias("flowmeter"),
        (k / 10.0).alias("motor_current"),
        on(kind == "click").alias("comp"),
        on(kind == "signup").alias("dv_electric"),
        on(k % 2 == 0).alias("towers"),
        on(k % 3 == 0).alias("mpg"),
        on(kind == "purchase").alias("lps"),
        on(kind == "error").alias("pressure_switch"),
        on(kind == "view").alias("oil_level"),
        on(k % 5 == 0).alias("caudal_impulses"),
        (k * F.lit(1.0)).alias("gps_speed"),
        on(k > 10).alias("gps_quality"),
    )


def fleet_schema() -> T.StructType:
    """Declared types of the readings above, for reading them back from CSV."""
    fields = [T.StructField(READING_TIME, T.TimestampNTZType()),
              T.StructField(ASSET, T.IntegerType())]
    fields += [T.StructField(name, DOUBLE) for name in ANALOG]
    fields += [T.StructField(name, T.IntegerType()) for name in DIGITAL]
    fields += [T.StructField("gps_speed", DOUBLE), T.StructField("gps_quality", T.IntegerType())]
    return T.StructType(fields)
