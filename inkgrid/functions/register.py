"""SQL names for some of the expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register_functions(spark: SparkSession) -> None:
    """is_cjk(text), strip_text(text), is_blank_text(text), padding_rows(h, w): temporary SQL functions without Python at run time."""
    from .text import CJK, SPACE

    quoted = lambda x: x.replace("\\", "\\\\")
    spark.sql(f"create or replace temporary function is_cjk(t string) returns boolean return t rlike '{quoted(CJK)}'")
    spark.sql(f"create or replace temporary function strip_text(t string) returns string return regexp_replace(t, '(?U)^{quoted(SPACE)}+|{quoted(SPACE)}+$', '')")
    spark.sql("create or replace temporary function is_blank_text(t string) returns boolean return strip_text(t) = ''")
    spark.sql("create or replace temporary function padding_rows(h int, w int) returns int return case when h <= 30 or w / h > 8 then cast(abs(greatest(int(w / 8D), 30) * 2 - h) / 2D as int) else 0 end")
