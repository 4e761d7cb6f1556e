"""Table and text scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T


def scan_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table in a folder of tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _reader(spark: SparkSession):
    """Header line; blank cells and the token ``NA`` are NULL."""
    return spark.read.option("header", True).option("nullValue", "NA").option("emptyValue", None)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header. Inference reads the whole file once more; a cell that does not fit a given schema fails."""
    if schema is not None:
        return _reader(spark).option("mode", "FAILFAST").schema(schema).csv(path)
    return _reader(spark).option("inferSchema", True).csv(path)


def scan_csv_override(spark: SparkSession, path: str, overrides: dict[str, T.DataType]) -> DataFrame:
    """Infer the types from all rows, replace those of some columns, then read with that schema."""
    inferred = scan_csv(spark, path).schema
    unknown = set(overrides) - set(inferred.names)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    fields = [T.StructField(f.name, overrides.get(f.name, f.dataType), True) for f in inferred.fields]
    return scan_csv(spark, path, T.StructType(fields))
