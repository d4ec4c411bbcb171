"""Deeply nested records into flat tables with parent links (Dewey labelling).

Every node of a record gets a Dewey label: the path of keys and ordinals from the record's top
to the node. An object that is an array element becomes a row; the label of the object that
encloses it is a prefix of its own label, so the parent link is a truncation, never a join.
Rows of one schema path (the label without its ordinals) form one table. A row's fields reach
through the objects nested in it, by dotted names; arrays of plain values give rows of their own,
and what stands outside all arrays is in the record's own row, so `flat_rows` loses nothing.

Labelling is one pass over the records without any shuffle: a record's rows come out in the
task that holds the record, so a file or session with a third of all rows changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scrollmill.functions.strict_json import clean, loads_object
from scrollmill.session import spread

NESTED_FIELDS = ("message", "content", "payload")
_SCHEMA = "record_id bigint, node_path string, parent_len int, element_no int, body string"
_FLAT_SCHEMA = "record_id bigint, node_path string, parent_len int, element_no int, kind string, body string"
_BATCH = 4096


def label(record: dict, roots: Sequence[str], plain: bool = False) -> Iterator[tuple[str, int, int, object]]:
    """(label, length of the parent's label, ordinal, object) of each array-element object.

    With `plain` also of the elements that are no objects: plain values, nulls and empty arrays.
    """
    stack: list = [(record[k], k, 0) for k in reversed(roots) if isinstance(record.get(k), (dict, list))]
    while stack:
        value, path, parent = stack.pop()
        if isinstance(value, dict):
            stack.extend((v, f"{path}.{k}", parent) for k, v in value.items() if isinstance(v, (dict, list)))
        else:
            for i, v in enumerate(value):
                if isinstance(v, dict):
                    at = f"{path}[{i}]"
                    yield at, parent, i, v
                    stack.extend((x, f"{at}.{k}", len(at)) for k, x in v.items() if isinstance(x, (dict, list)))
                elif isinstance(v, list) and (v or not plain):
                    stack.append((v, f"{path}[{i}]", parent))
                elif plain:
                    yield f"{path}[{i}]", parent, i, v


def fields(node: dict, whole: Sequence[str] | None = None) -> str:
    """The node's own fields as JSON, those of objects nested in it by dotted names.

    A dot or backslash in a key is written after a backslash. Arrays are left out, as their
    elements are rows, but for empty ones. For a record's top, `whole` names the keys whose arrays
    are rows; arrays under any other key are fields as they are.
    """
    out = {}
    stack: list = [(None, node, True)]
    while stack:
        name, value, rows = stack.pop()
        if isinstance(value, dict) and (value or name is None):
            prefix = "" if name is None else f"{name}."
            stack.extend(
                (prefix + k.replace("\\", "\\\\").replace(".", "\\."), v, k in whole if whole is not None and value is node else rows)
                for k, v in reversed(value.items())
            )
        elif not isinstance(value, list) or not value or not rows:
            out[name] = value
    return json.dumps(out, ensure_ascii=False)


def flatten(
    records: DataFrame,
    id_col: str = "record_id",
    text_col: str = "line",
    roots: Sequence[str] = NESTED_FIELDS,
    with_body: bool = False,
) -> DataFrame:
    """One row per array-element object under `roots`, at any depth.

    Columns: `record_id`, `node_path`, `parent_path` (empty for the outermost), `schema_path`
    (label without ordinals), `element_no`, and with `with_body` the object's own fields as a
    JSON `body` (see `fields`). Lines that are null, empty, malformed, or no object give no row; a
    repeated line counts under each id; a null id is kept; of a key written twice in one object
    the last counts. Other columns of `records` are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "node_path", "parent_len", "element_no", "body"]
        types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        out: list[list] = [[] for _ in names]

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            for rid, line in zip(batch.column(0).to_pylist(), batch.column(1)):
                line = line.as_py()
                # an element of an array needs a bracket: without one there is no row to find
                if not line or "[" not in line or (record := loads_object(line)) is None:
                    continue
                for path, parent, i, node in label(record, roots):
                    fixed = clean(path)
                    if fixed is not path:
                        parent = len(clean(path[:parent]))
                    out[0].append(rid)
                    out[1].append(fixed)
                    out[2].append(parent)
                    out[3].append(i)
                    out[4].append(clean(fields(node)) if with_body else None)
                    if len(out[0]) >= _BATCH:
                        yield flush()
        if out[0]:
            yield flush()

    source = spread(records.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(text_col).alias("line")))
    rows = source.mapInArrow(run, _SCHEMA)
    return rows.select(
        "record_id",
        "node_path",
        F.expr("substring(node_path, 1, parent_len)").alias("parent_path"),
        F.regexp_replace("node_path", r"\[\d+\]", "[]").alias("schema_path"),
        "element_no",
        *(["body"] if with_body else []),
    )


def flat_rows(records: DataFrame, id_col: str = "record_id", text_col: str = "line", roots: Sequence[str] = NESTED_FIELDS) -> DataFrame:
    """The rows of all flat tables with their fields: nothing of a record is left out.

    Columns as of `flatten`, `kind` and `body`. `record` is the row of a record itself (empty
    label, no parent), with its fields outside the arrays under `roots`; `object` the rows of
    `flatten`; `value` an array element that is no object, its body holding `value`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "node_path", "parent_len", "element_no", "kind", "body"]
        types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out.clear()
            return batch

        for batch in batches:
            for rid, line in zip(batch.column(0).to_pylist(), batch.column(1)):
                line = line.as_py()
                if not line or (record := loads_object(line)) is None:
                    continue
                out.append((rid, "", None, None, "record", clean(fields(record, roots))))
                for path, parent, i, node in label(record, roots, plain=True):
                    fixed = clean(path)
                    if fixed is not path:
                        parent = len(clean(path[:parent]))
                    is_object = isinstance(node, dict)
                    body = fields(node) if is_object else json.dumps({"value": node}, ensure_ascii=False)
                    out.append((rid, fixed, parent, i, "object" if is_object else "value", clean(body)))
                    if len(out) >= _BATCH:
                        yield flush()
        if out:
            yield flush()

    source = spread(records.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(text_col).alias("line")))
    return source.mapInArrow(run, _FLAT_SCHEMA).select(
        "record_id",
        "node_path",
        F.expr("substring(node_path, 1, parent_len)").alias("parent_path"),
        F.regexp_replace("node_path", r"\[\d+\]", "[]").alias("schema_path"),
        "element_no",
        "kind",
        "body",
    )


def schema_tables(nodes: DataFrame) -> DataFrame:
    """Rows and records of each schema path: the flat tables that `flatten` gives rise to."""
    return nodes.groupBy("schema_path").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("record_id").alias("n_records"),
        F.sum(F.when(F.col("parent_path") == "", 1).otherwise(0)).alias("n_top"),
    )


def flat_table(nodes: DataFrame, schema_path: str, fields: Sequence[str]) -> DataFrame:
    """The table of one schema path (nodes made `with_body`, or by `flat_rows`), a column per wanted field.

    A field that a node lacks is null; one of a nested object goes by its dotted name. Columns: `record_id`, `node_path`, `parent_path`, fields.
    """
    parsed = F.from_json("body", "map<string,string>")
    return nodes.filter(F.col("schema_path") == schema_path).select(
        "record_id", "node_path", "parent_path", *(parsed[f].alias(f) for f in fields)
    )
