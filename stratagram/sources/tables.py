"""Tables in, models and results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_FORMATS = {"csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "orc": "orc", "txt": "text"}


def read_table(spark: SparkSession, path: str, format: str | None = None, schema=None, **options) -> DataFrame:
    """A table in any store that Spark reads; the format follows from the name unless given."""
    name = path.rstrip("/").removesuffix(".gz").rsplit(".", 1)
    kind = format or _FORMATS.get(name[1].lower() if len(name) > 1 else "", "parquet")
    reader = spark.read.format(kind)
    if kind == "csv":
        options = {"header": "true", "sep": "\t" if path.endswith("tsv") else ","} | options
        if schema is None:
            options.setdefault("inferSchema", "true")
    return (reader.schema(schema) if schema is not None else reader).options(**options).load(path)


def from_frame(spark: SparkSession, data) -> DataFrame:
    """A pandas or pyarrow table (or anything with ``to_arrow``, as polars has) as a Spark table."""
    import pyarrow as pa

    if isinstance(data, DataFrame):
        return data
    if hasattr(data, "to_arrow"):
        data = data.to_arrow()
    return spark.createDataFrame(data.to_pandas() if isinstance(data, pa.Table) else data)


def save_model(model, path: str, spark: SparkSession) -> None:
    """A fitted model as one line of JSON text, in any store that Spark writes."""
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(path: str, spark: SparkSession):
    from ..operators.model import FittedModel

    return FittedModel.from_json(spark.read.text(path, wholetext=True).first()["value"].strip())
