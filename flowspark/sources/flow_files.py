"""Flow records as JSON lines."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowspark.schema import FLOW_RECORD


def write_flow_lines(records: DataFrame, path: str):
    """Append one JSON object per record; null ports are written as null."""
    records.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_flow_lines(spark: SparkSession, path: str) -> DataFrame:
    """All well-formed lines; a record without a label is `normal`.

    The malformed-record column keeps the parse of every line in force however few
    columns a query needs, so bad lines are left out of counts as well.
    """
    schema = T.StructType([*FLOW_RECORD.fields, T.StructField("_bad", T.StringType())])
    rows = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .json(path)
    )
    return (
        rows.where(F.col("_bad").isNull() & F.col("flow_id").isNotNull())
        .drop("_bad")
        .withColumn("label", F.coalesce("label", F.lit("normal")))
    )
