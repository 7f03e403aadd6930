"""The two path functions under their SQL names, for queries written as text."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "file_name_from_path": "substring_index(rtrim('/', p), '/', -1)",
    "file_ext_from_path": """
        CASE WHEN substring_index(rtrim('/', p), '/', -1) <> '.'
              AND contains(substr(substring_index(rtrim('/', p), '/', -1),
                                  if(startswith(substring_index(rtrim('/', p), '/', -1), '.'), 2, 1)), '.')
             THEN lower(substring_index(substring_index(rtrim('/', p), '/', -1), '.', -1)) END""",
}


def register_functions(spark: SparkSession) -> None:
    """Temporary SQL functions; Spark inlines them, null in gives null out."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(p STRING) RETURNS STRING RETURN {body}")
