"""Decoding of records, and their canonical schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SearchError

SPARSE = "array<struct<dim:bigint,val:float>>"
RECORD = f"id string, document_id string, dense array<float>, sparse {SPARSE}, text string, metadata map<string,string>"
CHANGE = f"{RECORD}, op string, seq bigint"
#: Fields of a record as JSON; others make it corrupt in strict reading.
WIRE = "id string, document_id string, dense_values array<float>, metadata map<string,string>, sparse_indices array<bigint>, sparse_values array<float>, text string"


def _sparse(indices: Column, values: Column) -> Column:
    pairs = F.transform(F.arrays_zip(indices.alias("dim"), values.alias("val")), lambda e: F.struct(e["dim"].cast("bigint").alias("dim"), e["val"].cast("float").alias("val")))
    return F.when(indices.isNotNull(), pairs)


def decode(raw: DataFrame, found: Column | None = None) -> DataFrame:
    """Records from wire columns, with the column problem: null, or why the row isn't a record. found comes first."""
    both = F.col("sparse_indices").isNotNull() | F.col("sparse_values").isNotNull()
    problem = (
        F.when(F.col("id").isNull(), "no id")
        .when(both & ~F.coalesce(F.size("sparse_indices") == F.size("sparse_values"), F.lit(False)), "sparse indices and values differ in number")
        .when(F.coalesce(F.exists("dense_values", lambda x: x.isNull()), F.lit(False)), "dense_values holds a null")
    )
    if found is not None:
        problem = F.coalesce(found, problem)
    sparse = F.when(problem.isNull(), _sparse(F.col("sparse_indices"), F.col("sparse_values")))
    return raw.select("id", "document_id", F.col("dense_values").alias("dense"), sparse.alias("sparse"), "text", "metadata", problem.alias("problem"))


def read_json(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Records from JSON lines, with the column problem. strict finds unknown fields too."""
    schema = T.StructType.fromDDL(f"{WIRE}, _corrupt string")
    lines = spark.read.text(path)
    parsed = lines.select("value", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("value", "r.*")
    keys = F.json_object_keys("value")
    found = F.when(F.col("_corrupt").isNotNull() | keys.isNull(), "not a JSON object of these types")
    if strict:
        extra = F.array_except(keys, F.array(*[F.lit(f.name) for f in T.StructType.fromDDL(WIRE)]))
        found = found.when(F.size(extra) > 0, F.concat(F.lit("unknown fields: "), F.array_join(extra, ", ")))
    return decode(parsed, found)


def checked(records: DataFrame) -> DataFrame:
    """Records without the column problem; a row that has one fails the job."""
    guard = F.when(F.col("problem").isNull(), F.col("id")).otherwise(F.raise_error(F.col("problem")).cast("string"))
    return records.withColumn("id", guard).drop("problem")


def metadata_struct(records: DataFrame, schema: T.StructType, metadata_col: str = "metadata") -> DataFrame:
    """records with a typed column for each declared field."""
    clash = {f.name for f in schema} & set(records.columns)
    if clash:
        raise SearchError(f"fields are named like columns: {sorted(clash)}")
    return records.select("*", *[F.col(metadata_col)[f.name].cast(f.dataType).alias(f.name) for f in schema])
