"""Files: JSON arrays in and out, the missing-input guard (OP-05, OP-06, OP-09)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Schemas of the flat relations.
CATALOGUE = "sku string, marca string, titulo string, precio_clp double, url string"
CATALOGUE_B = CATALOGUE + ", especificaciones map<string,string>"
ENRICHED_A = CATALOGUE + ", descripcion string, especificaciones map<string,string>"
ENRICHED_B = CATALOGUE_B + ", descripcion_completa string"
STANDARD = "sku string, titulo string, precio_clp double, url string, medida_extraida string, texto_embedding string"


class MissingInput(FileNotFoundError):
    """The input path does not exist."""


def read_json(spark: SparkSession, path: str, schema: str | StructType, lines: bool = False) -> DataFrame:
    """A JSON array file (or JSON lines) with a given schema, so nothing is read to infer it."""
    try:
        return spark.read.schema(schema).json(path, multiLine=not lines)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise MissingInput(path) from None
        raise


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines in part files; nulls are written too, so keys stay present."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
