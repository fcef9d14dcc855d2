"""The scalar helpers as SQL functions (``tl_*``), for ``spark.sql`` users.

Each function body is the Catalyst expression of the Column helper, rendered to SQL and
registered as a temporary SQL function, so SQL callers get the very same built-in
expression (inlined by the analyzer; no Python at run time).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from threadlake import functions as tf
from threadlake.functions.text import ENTITY, referenced_character, text_nodes

# name -> (helper, ((arg, type), ...), return type)
SQL_FUNCTIONS = {
    "tl_size_bucket": (tf.size_bucket, (("size_bytes", "BIGINT"),), "DECIMAL(12,2)"),
    "tl_size_text_mb": (tf.size_text_mb, (("size_text", "STRING"),), "DECIMAL(12,2)"),
    "tl_format_size_text": (tf.format_size_text, (("size_bytes", "BIGINT"),), "STRING"),
    "tl_b64_to_hex": (tf.b64_to_hex, (("b64", "STRING"),), "STRING"),
    "tl_hex_to_b64": (tf.hex_to_b64, (("hex_digest", "STRING"),), "STRING"),
    "tl_sanitize_name": (tf.sanitize_name, (("name", "STRING"),), "STRING"),
    "tl_strip_ext": (tf.strip_ext, (("name", "STRING"),), "STRING"),
    "tl_basename": (tf.basename, (("path", "STRING"),), "STRING"),
    "tl_dirname": (tf.dirname, (("path", "STRING"),), "STRING"),
    "tl_normalize_rel_path": (tf.normalize_rel_path, (("path", "STRING"),), "STRING"),
    "tl_html_text": (tf.html_text, (("html", "STRING"),), "STRING"),
    "tl_no_message": (tf.no_message, (("msg", "STRING"),), "STRING"),
    "tl_indent_line": (tf.indent_line, (("line", "STRING"), ("lvl", "INT")), "STRING"),
    "tl_rule_line": (tf.rule_line, (("lvl", "INT"),), "STRING"),
    "tl_is_thread_url": (tf.is_thread_url, (("url", "STRING"),), "BOOLEAN"),
    "tl_is_file_url": (tf.is_file_url, (("url", "STRING"),), "BOOLEAN"),
    "tl_file_key": (tf.file_key, (("url", "STRING"),), "STRING"),
    "tl_canonical_url": (tf.canonical_url, (("url", "STRING"),), "STRING"),
    "tl_valid_folder": (tf.valid_folder, (("name", "STRING"),), "BOOLEAN"),
    "tl_report_date": (tf.report_date, (("ts", "TIMESTAMP"),), "STRING"),
}


def _expression_sql(spark: SparkSession, col, args) -> str:
    """SQL text of a Column's (unresolved) Catalyst expression."""
    schema = ", ".join(f"{a} {t}" for a, t in args)
    plan = spark.createDataFrame([], schema).select(col.alias("_out"))._jdf.queryExecution().logical()
    return plan.projectList().apply(0).child().sql()


def _html_text_sql(spark: SparkSession) -> str:
    """``html_text`` maps over a text's character references, and a lambda does not render to
    SQL: it is written here around the rendered parts."""
    text = _expression_sql(spark, text_nodes(F.col("html")), (("html", "STRING"),))
    char = _expression_sql(spark, referenced_character(F.col("ref")), (("ref", "STRING"),))
    chars = f"concat(transform(regexp_extract_all({text}, '{ENTITY}', 0), ref -> {char}), array(''))"
    pairs = f"zip_with(split({text}, '{ENTITY}', -1), {chars}, (a, b) -> array(a, b))"
    return f"CASE WHEN contains({text}, '&') THEN array_join(flatten({pairs}), '') ELSE {text} END"


def function_sql(spark: SparkSession, name: str) -> str:
    helper, args, ret = SQL_FUNCTIONS[name]
    body = _html_text_sql(spark) if helper is tf.html_text else _expression_sql(spark, helper(*[F.col(a) for a, _ in args]), args)
    params = ", ".join(f"{a} {t}" for a, t in args)
    return f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {ret} RETURN {body}"


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create every ``tl_*`` function in the session; returns their names."""
    for name in SQL_FUNCTIONS:
        spark.sql(function_sql(spark, name))
    return list(SQL_FUNCTIONS)
