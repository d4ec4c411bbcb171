"""Queries over the driver's tables for the core operators, and SQL to check them by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scrollmill.operators import drift, nested
from scrollmill.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten(table(spark, sf_dir, "raw_records")).select("record_id", "node_path", "parent_path")


def p1_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.schema_tables(nested.flatten(table(spark, sf_dir, "raw_records")))


def p1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all flat tables with their fields as JSON."""
    return nested.flat_rows(table(spark, sf_dir, "raw_records"))


def p1_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each kind every record has in the flat tables: nothing of a record is without a row."""
    rows = nested.flat_rows(table(spark, sf_dir, "raw_records"))
    count = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)).alias(f"n_{kind}")
    return rows.groupBy("record_id").agg(count("record"), count("object"), count("value"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drift.changes(table(spark, sf_dir, "raw_records"), table(spark, sf_dir, "field_catalog"))
    return found.select("file_id", "change", "field_name").distinct()


def p5_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.union_schema(table(spark, sf_dir, "raw_records"), table(spark, sf_dir, "field_catalog"))


def p5_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.unify(table(spark, sf_dir, "raw_records"), table(spark, sf_dir, "field_catalog"))


def p5_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences in the order of files: what each adds to the types before it, and how it deviates."""
    return drift.log(table(spark, sf_dir, "raw_records"), table(spark, sf_dir, "field_catalog"))


QUERIES = {f.__name__: f for f in (p1_found, p1_tables, p1_rows, p1_kinds, p5_found, p5_schema, p5_log, p5_unified)}

# This reader of JSON lets a comma pass before a closing brace, so such lines are left out first.
_NODES = r"""
with good as (
    select record_id, line from raw_records
    where json_valid(line) and not regexp_matches(line, ',\s*\}\s*$') and not regexp_matches(line, ',\s*\]\s*\}+\s*$')
), node as (
    select g.record_id, substr(t.fullkey, 3) as node_path
    from good g, json_tree(case when json_type(g.line) = 'OBJECT' then g.line end) t
    where t.type = 'OBJECT' and regexp_matches(t.fullkey, '\]$') and regexp_matches(t.fullkey, '^\$\.(message|content|payload)[.\[]')
)
"""

ORACLE = {
    "p1_found": _NODES
    + r"select record_id, node_path, regexp_extract(regexp_replace(node_path, '(\[\d+\])+$', ''), '^(.*\])\.[^\]]*$', 1) as parent_path from node",
    "p1_kinds": r"""
        with good as (
            select record_id, line from raw_records
            where json_valid(line) and not regexp_matches(line, ',\s*\}\s*$') and not regexp_matches(line, ',\s*\]\s*\}+\s*$') and json_type(line) = 'OBJECT'
        ), element as (
            select g.record_id, t.type, t.value from good g, json_tree(g.line) t
            where regexp_matches(t.fullkey, '\]$') and regexp_matches(t.fullkey, '^\$\.(message|content|payload)[.\[]')
        )
        select good.record_id, 1 as n_record, sum(case when type = 'OBJECT' then 1 else 0 end) as n_object,
            sum(case when type <> 'OBJECT' and (type <> 'ARRAY' or json_array_length(value) = 0) then 1 else 0 end) as n_value
        from good left join element on good.record_id = element.record_id group by good.record_id""",
    "p1_tables": _NODES
    + r"""select regexp_replace(node_path, '\[\d+\]', '[]', 'g') as schema_path, count(*) as n_rows, count(distinct record_id) as n_records,
            sum(case when regexp_extract(regexp_replace(node_path, '(\[\d+\])+$', ''), '^(.*\])\.[^\]]*$', 1) = '' then 1 else 0 end) as n_top
        from node group by 1""",
}
