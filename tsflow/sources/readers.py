"""Readers with declared schemas (no inference pass) and the result sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Declared schemas of the driver tables used by the time-series fixtures.
SCHEMAS = {
    "lineitem": T.StructType([
        T.StructField("l_orderkey", T.LongType()), T.StructField("l_partkey", T.LongType()),
        T.StructField("l_suppkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_quantity", T.DoubleType()), T.StructField("l_extendedprice", T.DoubleType()),
        T.StructField("l_discount", T.DoubleType()), T.StructField("l_tax", T.DoubleType()),
        T.StructField("l_returnflag", T.StringType()), T.StructField("l_linestatus", T.StringType()),
        T.StructField("l_shipdate", T.TimestampType())]),
    "orders": T.StructType([
        T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.TimestampType()), T.StructField("o_orderpriority", T.StringType())]),
    "customer": T.StructType([
        T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
        T.StructField("c_nationkey", T.IntegerType()), T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType())]),
    "events": T.StructType([
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
        T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())]),
}


CSV_TS_FORMAT = "yyyy-MM-dd HH:mm:ss"  # fixed value: the wide-table CSV date format


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet read of a driver table with its declared schema when we have one."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = SCHEMAS.get(name)
    r = spark.read.schema(schema) if schema is not None else spark.read
    return r.parquet(path)


def read_points(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv",
                header: bool = True) -> DataFrame:
    """Wide time table (``date`` + numeric channels) with an explicit schema."""
    r = spark.read.schema(schema)
    if fmt == "csv":
        return r.option("header", str(header).lower()).option("timestampFormat", CSV_TS_FORMAT).csv(path)
    return r.format(fmt).load(path)


def read_cycles(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv",
                header: bool = True) -> DataFrame:
    """Two-key sensor table (battery_id, cycle_index, ...) with an explicit schema."""
    return read_points(spark, path, schema, fmt=fmt, header=header)


def read_forecasts(spark: SparkSession, path: str, steps: int, id_type: T.DataType | None = None,
                   fmt: str = "csv") -> DataFrame:
    """Forecast file: one row per series, an id and then one column per step, with a NaN or empty
    tail where a series has fewer steps -> long ``(id, step, yhat)`` without the tail."""
    from pyspark.sql import functions as F
    schema = T.StructType([T.StructField("id", id_type or T.LongType()),
                           *(T.StructField(f"V{i + 1}", T.DoubleType()) for i in range(steps))])
    wide = read_points(spark, path, schema, fmt=fmt)
    long = wide.select("id", F.posexplode(F.array(*(f"V{i + 1}" for i in range(steps)))).alias("step", "yhat"))
    return long.where(F.col("yhat").isNotNull() & ~F.isnan("yhat")).select("id", F.col("step").cast("bigint").alias("step"), "yhat")


def write_forecasts(fc: DataFrame, path: str, steps: int, id_col: str = "id", step: str = "step", value: str = "yhat") -> None:
    """The file that ``read_forecasts`` reads, from long rows; missing steps are left empty."""
    from pyspark.sql import functions as F
    cols = [F.max(F.when(F.col(step) == i, F.col(value))).alias(f"V{i + 1}") for i in range(steps)]
    write_result(fc.groupBy(F.col(id_col).alias("id")).agg(*cols), path, fmt="csv")


def write_result(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet",
                 mode: str = "overwrite") -> None:
    """Result sink: partitioned parquet (or csv) -- the notebook's ``to_csv`` re-aimed."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        # same timestamp text the CSV readers declare, so sink and reader round-trip
        w.option("header", "true").option("timestampFormat", CSV_TS_FORMAT).csv(path)
    else:
        w.format(fmt).save(path)


def read_rejecting(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """CSV lines that fit the declared schema, and the others as ``(line, reason)``.

    A line is rejected if it has too few or too many fields or a field is no value of its column's type; an empty field is a
    null.  Nothing is stored between the two: each reads the file.  One record a line (no line breaks in quotes); a quote
    inside quotes is doubled."""
    from pyspark.sql import functions as F
    names = schema.fieldNames()
    lines = spark.read.text(path).withColumnRenamed("value", "line").where(F.trim("line") != "")
    if header:
        lines = lines.where(F.col("line") != ",".join(names))
    raw = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names) + 1)])  # one more than allowed
    parsed = lines.select("line", F.from_csv("line", raw.simpleString()[7:-1].replace(":", " "), {"escape": '"'}).alias("raw"))
    # a field that is missing and one that is empty are both null in the raw row: fields are counted outside quotes
    n_fields = F.size(F.split(F.regexp_replace("line", '"[^"]*"', ""), ",", -1))
    kept, bad = [], []
    for k, f in enumerate(schema.fields):
        given = F.col(f"raw.c{k}")
        value = (F.try_to_timestamp(given, F.lit(CSV_TS_FORMAT)) if isinstance(f.dataType, T.TimestampType)
                 else given.try_cast(f.dataType))
        kept.append(value.alias(f.name))
        bad.append(F.when(given.isNotNull() & value.isNull(), F.lit(f.name)))
    reason = F.when(n_fields != len(names), F.lit("fields")).otherwise(F.coalesce(*bad))
    parsed = parsed.withColumn("reason", reason)
    return parsed.where(F.col("reason").isNull()).select(*kept), parsed.where(F.col("reason").isNotNull()).select("line", "reason")


def write_prompt_bank(df: DataFrame, path: str, name: str = "name", content: str = "content") -> None:
    """``(name, content)`` as text files, a folder per name, as ``read_prompt_bank`` reads them."""
    from pyspark.sql import functions as F
    df.select(F.col(name).alias("name"), F.col(content).alias("value")).write.partitionBy("name").text(path)


def read_prompt_bank(spark: SparkSession, folder: str, partitioned: bool = False) -> DataFrame:
    """Prompt bank -> ``(name, content)`` of whole files: ``<name>.txt`` each, or the folders of ``write_prompt_bank``."""
    from pyspark.sql import functions as F
    if partitioned:
        d = spark.read.schema("value string, name string").text(folder, wholetext=True)
        return d.select("name", F.regexp_replace("value", r"\n\z", "").alias("content"))
    d = spark.read.text(f"{folder.rstrip('/')}/*.txt", wholetext=True).withColumn("_f", F.input_file_name())
    name = F.regexp_extract(F.col("_f"), r"([^/]+)\.txt$", 1)
    return d.select(name.alias("name"), F.col("value").alias("content"))


def with_content(df: DataFrame, bank: DataFrame, name_col: str) -> DataFrame:
    """Attach the bank text for each row's dataset name; every ``ETT*`` name shares ``ETT``.

    The bank has one row per dataset; Spark broadcasts it where it is small.
    """
    from pyspark.sql import functions as F
    key = F.when(F.col(name_col).contains("ETT"), F.lit("ETT")).otherwise(F.col(name_col))
    return df.withColumn("_bank", key).join(bank.withColumnRenamed("name", "_bank"), on="_bank", how="left").drop("_bank")
