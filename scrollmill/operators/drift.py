"""Schemas that drift between files: one consistent table and a report of each change.

Each task reads the top-level fields of its records and folds them per file into a header: a
set of JSON types per field. Sets of types under union are the type-promotion lattice (null at
the bottom, one type above it, whole numbers below fractions, a mix of types at the top, held as
JSON text), so headers of one file from several tasks merge by a bit-or, in any order and however
the file is split. A file with a third of all rows is thus folded where its rows lie; only headers
are shuffled. The union over all files is the schema to which `unify` casts every record.

`log` tells the differences in the order of files: what each one adds to the types of the files
before it (a running bit-or, itself folded by parts), and where it deviates from the catalog.

A field outside the catalog is held to be another name of a catalog field if
 - both spell the same words (`session-id`, `sessionID`, `session_id`),
 - or its words are a known other way to say the field (`workdir` for `cwd`),
 - or it stands in for the field: records that carry it lack the field far more often than
   records in general, its types are allowed there and its values look like the field's.
Otherwise it is an added field.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from scrollmill.functions.strict_json import clean, loads_object
from scrollmill.session import cut, spread

#: The lattice's atoms. JSON knows one kind of number; `fraction` is a mark beside it, of a number
#: that is none of 64 bits without a fraction.
TYPE_BITS = {"string": 1, "number": 2, "boolean": 4, "array": 8, "object": 16, "null": 32}
FRACTION = 64
_BIT_OF = {str: 1, int: 2, float: 2 | FRACTION, bool: 4, list: 8, dict: 16, type(None): 32}

# Other ways to say a field of a transcript record, in lower case without separators.
OTHER_WORDS = {
    "sessionid": ["sid", "conversationid", "threadid", "chatid", "session"],
    "timestamp": ["ts", "at", "time", "datetime", "loggedat", "createdat", "recordedat", "eventtime"],
    "cwd": ["workdir", "workingdir", "workingdirectory", "currentdir", "currentdirectory", "dir"],
    "uuid": ["recorduuid", "recordid", "messageuuid", "guid"],
    "version": ["cliversion", "clientversion", "appversion", "toolversion"],
    "gitbranch": ["branch", "branchname", "gitref"],
    "ismeta": ["meta", "metaflag", "metarecord"],
    "issidechain": ["sidechain", "sidechainflag", "sidechainrecord"],
    "type": ["kind", "recordtype", "eventtype"],
    "payload": ["body", "data"],
    "parentuuid": ["parent", "parentid", "parentrecord"],
    "prrepository": ["pullrequestrepository", "repository"],
}

#: Least surplus of a stand-in: share of its records that lack the field, less the share of all.
LEAST_LIFT = 0.4
#: Least share of a stand-in's values that look like values of the field.
LEAST_LIKE = 0.9
#: Least lower bounds of both, so that few records don't prove a stand-in: at 95 % confidence.
SURE_LIFT, SURE_LIKE, Z = 0.2, 0.7, 1.96
#: Least share of a field's values for a look of theirs to be usual: a field has fifty such looks at most.
USUAL = 0.02


def words(name: Column) -> Column:
    """A field name in lower case without anything but letters and digits."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def _look_of_text(text: str) -> str:
    """Runs of hex digits, of digits and of letters each as one sign, all else as it is; prose is one look."""
    if " " in text:
        return "s prose"
    s = re.sub(r"[0-9a-f]{8,}", "h", text)
    return _narrow("s" + re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "0", s)))


_kept_look = lru_cache(maxsize=1 << 16)(_look_of_text)


def _narrow(look: str) -> str:
    """A long look by its hash, so that rows stay narrow and no two long looks are taken for one."""
    return look if len(look) <= 40 else "#" + xxhash.xxh3_128_hexdigest(look.encode("utf-8", "replace"))


def _words(name: str) -> str:
    return "".join(c for c in name if c.isalnum()).lower()


def _look(value) -> str:
    """A coarse look of a whole value: what a reader sees of its form before its meaning."""
    if isinstance(value, str):
        return _kept_look(value) if len(value) < 256 else _look_of_text(value)
    if isinstance(value, dict):
        return _narrow("o" + ",".join(sorted(value)))
    return type(value).__name__[:1]


def _bit(value) -> int:
    if type(value) is int and not -(1 << 63) <= value < 1 << 63:
        return _BIT_OF[float]
    return _BIT_OF[type(value)]


def headers(records: DataFrame, catalog: list[dict]) -> DataFrame:
    """Per-task folded headers and stand-in counts of `records` (file_id, agent, line).

    Rows: `what` = 'file' (a file's count of records), 'field' (types of a field of a file),
    'name' (records with a field, for its agent), 'lack' (records with a field outside the
    catalog that lack the catalog field `other`), 'look' (values of a field by their look).
    Columns `what, file_id, agent, field, other, mask, n`. Lines that are null or no complete
    JSON object are passed over.
    """
    fields: dict[int, list[str]] = {}
    for row in catalog:
        fields.setdefault(row["agent"], []).append(row["field_name"])
    known = {a: frozenset(f) for a, f in fields.items()}
    schema = pa.schema(
        [("what", pa.string()), ("file_id", pa.int64()), ("agent", pa.int32()), ("field", pa.string())]
        + [("other", pa.string()), ("mask", pa.int32()), ("n", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per_file: Counter = Counter()
            masks: dict = {}
            counts: Counter = Counter()
            for fid, agent, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (record := loads_object(line.as_py())) is None:
                    continue
                per_file[fid, agent] += 1
                own = known.get(agent, frozenset())
                lacking = None
                for name, value in record.items():
                    key = (fid, agent, name)
                    masks[key] = masks.get(key, 0) | _bit(value)
                    if value is not None:
                        counts["look", agent, name, _look(value)] += 1
                    if name not in own:
                        counts["name", agent, name, None] += 1
                        if lacking is None:
                            lacking = [f for f in own if f not in record]
                        for f in lacking:
                            counts["lack", agent, name, f] += 1
                for f in own:
                    if f not in record:
                        counts["lack", agent, None, f] += 1
            rows = [("file", f, a, None, None, 0, n) for (f, a), n in per_file.items()]
            rows += [("field", f, a, clean(c), None, m, 0) for (f, a, c), m in masks.items()]
            rows += [(w, None, a, None if c is None else clean(c), None if o is None else clean(o), 0, n) for (w, a, c, o), n in counts.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    ddl = "what string, file_id bigint, agent int, field string, other string, mask int, n bigint"
    source = records.select(F.col("file_id").cast("bigint"), F.col("agent").cast("int"), F.col("line"))
    parts = spread(source).mapInArrow(run, ddl)
    return parts.groupBy("what", "file_id", "agent", "field", "other").agg(
        F.bit_or("mask").alias("mask"), F.sum("n").alias("n")
    )


def type_mask(json_types: str | None) -> int:
    """The set of types that a catalog's `json_types` allows, as bits; unknown words count for none."""
    return sum(TYPE_BITS.get(t.strip(), 0) for t in set((json_types or "").split("|")))


def catalog_rows(catalog: DataFrame) -> list[dict]:
    """The catalog on the driver: fixed in size, a row for each expected field."""
    rows = catalog.select("agent", "field_name", "json_types", "is_required").dropna(subset=["agent", "field_name"]).collect()
    return [r.asDict() for r in rows]


def other_names(parts: DataFrame, catalog: list[dict]) -> DataFrame:
    """`agent, field, name`: fields outside the catalog and the catalog field each stands for.

    `parts` is the result of `headers`, `catalog` the rows of the catalog. A field has one catalog
    field at most: one of the same words before one said in other words, and that before the best
    stand-in. Only what is known of the catalog's own fields (a row each) comes to the driver.
    """
    spark = parts.sparkSession
    of = lambda what: F.col("what") == what
    own = {(r["agent"], r["field_name"]) for r in catalog}
    names = sorted({r["field_name"] for r in catalog})
    # records of an agent, and how many of them lack a field: a row each for the catalog's fields
    counted = parts.filter("field is null and what in ('file', 'lack')").groupBy("agent", "other").agg(F.sum("n").alias("n")).collect()
    records = {r["agent"]: r["n"] for r in counted if r["other"] is None}
    base = {(r["agent"], r["other"]): r["n"] / records[r["agent"]] for r in counted if r["other"] is not None}
    rows = [
        (r["agent"], r["field_name"], type_mask(r["json_types"]), base.get((r["agent"], r["field_name"]), 0.0), _words(r["field_name"]), OTHER_WORDS.get(_words(r["field_name"]), []))
        for r in catalog
    ]
    cat = F.broadcast(spark.createDataFrame(rows, "agent int, name string, allowed int, base double, same string, said array<string>"))
    is_own = F.struct("agent", "field").isin([F.struct(F.lit(a).cast("int").alias("agent"), F.lit(f).alias("field")) for a, f in own]) if own else F.lit(False)
    looks = parts.filter(of("look")).select("agent", "field", F.col("other").alias("look"), "n")
    valued = looks.groupBy("agent", "field").agg(F.sum("n").alias("n_values"))
    usual = looks.filter(is_own).join(valued, ["agent", "field"]).filter(F.col("n") >= USUAL * F.col("n_values")).select("agent", F.col("field").alias("name"), "look")
    alike = looks.filter(~is_own).join(F.broadcast(usual), ["agent", "look"]).groupBy("agent", "field", "name").agg(F.sum("n").alias("n_alike"))
    loose = parts.filter(F.col("field").isNotNull() & ~is_own).groupBy("agent", "field").agg(
        F.sum(F.when(of("name"), F.col("n"))).alias("seen"), F.bit_or("mask").alias("mask")
    )
    lacks = parts.filter(of("lack") & F.col("field").isNotNull()).select("agent", "field", F.col("other").alias("name"), F.col("n").alias("n_lack"))
    fits = F.col("mask").bitwiseAND(F.col("allowed")) > 0
    spelled = loose.withColumn("w", words(F.col("field"))).join(cat, "agent")
    by_name = F.when(F.col("w") == F.col("same"), 2).when(fits & F.array_contains("said", F.col("w")), 1).otherwise(0)
    scored = (
        spelled.join(lacks, ["agent", "field", "name"], "left")
        .join(alike, ["agent", "field", "name"], "left")
        .join(valued, ["agent", "field"], "left")
        .na.fill(0, ["n_lack", "n_alike", "n_values"])
        .select("agent", "field", "name", "base", fits.alias("fits"), by_name.alias("by_name"), "n_lack", "seen", "n_alike", "n_values")
    )
    share = lambda k, n: F.coalesce(F.try_divide(k, n), F.lit(0.0))
    lift, like = share("n_lack", "seen") - F.col("base"), share("n_alike", "n_values")
    sure = (_at_least(F.col("n_lack"), F.col("seen")) - F.col("base") >= SURE_LIFT) & (_at_least(F.col("n_alike"), F.col("n_values")) >= SURE_LIKE)
    stands_in = F.col("fits") & (lift >= LEAST_LIFT) & (like >= LEAST_LIKE) & sure
    best = F.max_by("name", F.struct("by_name", lift.alias("lift"), like.alias("like"), "name"))
    return scored.filter((F.col("by_name") > 0) | stands_in).groupBy("agent", "field").agg(best.alias("name"))


def _at_least(k: Column, n: Column) -> Column:
    """The lower bound of a share of which `k` of `n` are seen (Wilson's, at `Z`)."""
    p, z2 = k / F.greatest(n, F.lit(1)), Z * Z
    n = F.greatest(n, F.lit(1))
    return (p + z2 / (2 * n) - Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def changes(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every deviation of a file's records from the catalog: `file_id, agent, change, field_name`.

    `change` is `renamed`, `retyped`, `removed` or `added`; a file without a complete JSON object
    has none. A null value counts as present and as of any type. `catalog` is small and fixed
    (`agent, field_name, json_types, is_required`); an empty one makes every field an added one.
    A record whose agent is null or not in the catalog has only added fields. Other columns of
    both tables are not read.
    """
    rows = catalog_rows(catalog)
    return _changes(cut(headers(records, rows)), rows)


def _changes(parts: DataFrame, rows: list[dict]) -> DataFrame:
    spark = parts.sparkSession
    cat = F.broadcast(
        spark.createDataFrame(
            [(r["agent"], r["field_name"], type_mask(r["json_types"])) for r in rows], "agent int, name string, allowed int"
        )
    )
    needed = F.broadcast(
        spark.createDataFrame(
            [(a, [r["field_name"] for r in rows if r["agent"] == a and r["is_required"]]) for a in {r["agent"] for r in rows}],
            "agent int, needed array<string>",
        )
    )
    fields = parts.filter("what = 'field'").select("file_id", "agent", "field", "mask")
    proper = cat.select("agent", F.col("name").alias("field"), F.lit(True).alias("proper"))
    found = (
        fields.join(proper, ["agent", "field"], "left")
        .join(other_names(parts, rows), ["agent", "field"], "left")
        .withColumn("name", F.when(F.col("proper"), F.col("field")).otherwise(F.col("name")))
    )
    entry = lambda change, name: F.struct(F.lit(change).alias("change"), name.alias("field_name"))
    per_field = (
        found.groupBy("file_id", "agent", "name", F.when(F.col("name").isNull(), F.col("field")).alias("loose"))
        .agg(F.bit_or("mask").alias("mask"), F.max(F.when(F.col("proper"), 0).otherwise(1)).alias("renamed"))
        .join(cat, ["agent", "name"], "left")
    )
    bad = F.col("mask").bitwiseAND(F.lit(63 - TYPE_BITS["null"])).bitwiseAND(F.bitwise_not("allowed"))
    of_field = F.when(F.col("name").isNull(), F.array(entry("added", F.col("loose")))).otherwise(
        F.array_compact(
            F.array(
                F.when(F.col("renamed") == 1, entry("renamed", F.col("name"))),
                F.when(bad != 0, entry("retyped", F.col("name"))),
            )
        )
    )
    per_file = (
        per_field.withColumn("own", of_field)
        .groupBy("file_id", "agent")
        .agg(F.flatten(F.collect_list("own")).alias("own"), F.collect_set("name").alias("there"))
    )
    # an object may be empty: then its file has a count but no field
    bare = parts.filter("what = 'file'").select(
        "file_id", "agent", F.expr("cast(array() as array<struct<change:string,field_name:string>>)").alias("own"),
        F.expr("cast(array() as array<string>)").alias("there"),
    )
    whole = (
        per_file.unionByName(bare)
        .groupBy("file_id", "agent")
        .agg(F.flatten(F.collect_list("own")).alias("own"), F.flatten(F.collect_list("there")).alias("there"))
        .join(needed, "agent", "left")
    )
    gone = F.transform(
        F.array_except(F.coalesce("needed", F.expr("cast(array() as array<string>)")), "there"), lambda f: entry("removed", f)
    )
    return (
        whole.select("file_id", "agent", F.explode(F.concat("own", gone)).alias("x"))
        .select("file_id", "agent", "x.change", "x.field_name")
    )


def promoted(mask: Column) -> Column:
    """The type to which a set of types is promoted: itself if one, `json` for a mix, `null` for none."""
    some = mask.bitwiseAND(F.lit(31))
    out = F.when(some == 0, "null")
    for name, bit in TYPE_BITS.items():
        if name not in ("null", "number"):
            out = out.when(some == bit, name)
    return out.when(some == TYPE_BITS["number"], F.when(mask.bitwiseAND(F.lit(FRACTION)) > 0, "number").otherwise("integer")).otherwise("json")


#: The column type of each promoted type; what has no plain one is held as JSON text.
_CAST = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}


def _named(parts: DataFrame, rows: list[dict]) -> DataFrame:
    """Types of each file's fields under the catalog's names: `agent, field_name, file_id, mask`."""
    named = parts.filter("what = 'field'").join(other_names(parts, rows), ["agent", "field"], "left")
    return named.withColumn("field_name", F.coalesce("name", "field")).groupBy("agent", "field_name", "file_id").agg(F.bit_or("mask").alias("mask"))


def union_schema(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """The schema into which all files fit: `agent, field_name, json_type, n_files`.

    Headers of all files folded through the lattice, names of one field taken together. Numbers
    are `integer` if all are of 64 bits without a fraction.
    """
    rows = catalog_rows(catalog)
    folded = _named(cut(headers(records, rows)), rows).groupBy("agent", "field_name").agg(F.bit_or("mask").alias("mask"), F.count(F.lit(1)).alias("n_files"))
    return folded.select("agent", "field_name", promoted(F.col("mask")).alias("json_type"), "n_files")


def log(records: DataFrame, catalog: DataFrame, at: str = "read_at") -> DataFrame:
    """Every difference in order: `at, file_id, agent, change, field_name, type_before, type_after`.

    Files are ordered by their first `at` (null times first), then by id. `appeared` tells that a
    file is the first of its agent with the field, `promoted` that its types raise those of all
    files before it in the lattice; the other changes are those of `changes`, without types.
    """
    rows = catalog_rows(catalog)
    parts = cut(headers(records, rows))
    times = records.groupBy(F.col("file_id").cast("bigint").alias("file_id")).agg(F.min(at).alias("at"))
    order = [F.col("at"), F.col("file_id")]
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    timed = _named(parts, rows).join(times, "file_id", "left")
    # a field may be in all files: its running types are folded within ranges of files, then over these
    dealt = cut(timed.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    field = ["agent", "field_name"]
    sums = dealt.groupBy(*field, "part").agg(F.bit_or("mask").alias("m"))
    earlier = sums.withColumn("earlier", F.bit_or("m").over(Window.partitionBy(*field).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).drop("m")
    within = Window.partitionBy(*field, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = dealt.withColumn("own", F.bit_or("mask").over(within)).join(
        earlier.withColumnsRenamed({c: f"_{c}" for c in [*field, "part"]}), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*field, "part"]]
    )
    known = F.coalesce("own", F.lit(0)).bitwiseOR(F.coalesce("earlier", F.lit(0)))
    types = running.select("at", "file_id", *field, "mask", known.alias("known")).select(
        "at", "file_id", "agent", F.when(F.col("known") == 0, "appeared").otherwise("promoted").alias("change"), "field_name",
        F.when(F.col("known") != 0, promoted(F.col("known"))).alias("type_before"), promoted(F.col("known").bitwiseOR(F.col("mask"))).alias("type_after"),
    )
    raised = types.filter("change = 'appeared' or type_before != type_after")
    deviations = _changes(parts, rows).join(times, "file_id", "left")
    return raised.unionByName(deviations, allowMissingColumns=True)


def unify(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """All records in one table: ids, a column per catalog field cast to the union schema, and `extra` for the rest.

    A field that all files together hold as strings, whole numbers, numbers or booleans is of that
    type; arrays, objects and mixes are JSON text, which holds every value without loss. Of two
    names of one field the proper one counts. Records that are no complete JSON object are left
    out. The map of other names and the types are properties of schemas, not of rows (as many
    entries as there are odd names and catalog fields), and are sent to the tasks.
    """
    rows = catalog_rows(catalog)
    names = list(dict.fromkeys(r["field_name"] for r in rows))
    own = {(r["agent"], r["field_name"]) for r in rows}
    parts = cut(headers(records, rows))
    proper = {(r["agent"], r["field"]): r["name"] for r in other_names(parts, rows).collect()}
    folded = _named(parts, rows).filter(F.col("field_name").isin(names)).groupBy("field_name").agg(promoted(F.bit_or("mask")).alias("t"))
    kinds = {r["field_name"]: r["t"] for r in folded.collect()}
    kinds = {n: "string" if kinds.get(n, "null") == "null" else kinds[n] for n in names}
    columns = [f"f_{i}" for i in range(len(names))]

    def cell(kind: str, value):
        if value is None or kind in ("integer", "boolean"):
            return value
        if kind == "number":
            return float(value)
        return clean(value if kind == "string" else json.dumps(value, ensure_ascii=False))

    arrow = {"integer": pa.int64(), "number": pa.float64(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {n: i for i, n in enumerate(names)}
        for batch in batches:
            out: list[list] = [[] for _ in range(4 + len(names))]
            for rid, fid, agent, line in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (record := loads_object(line)) is None:
                    continue
                cells: list = [None] * len(names)
                rest = {}
                for name, value in record.items():
                    if (agent, name) in own:
                        cells[place[name]] = cell(kinds[name], value)
                for name, value in record.items():
                    if (agent, name) not in own:
                        if (at := proper.get((agent, name))) is None:
                            rest[name] = value
                        elif at not in record and cells[place[at]] is None:
                            cells[place[at]] = cell(kinds[at], value)
                for c, v in zip(out, [rid, fid, agent, *cells, cell("json", rest) if rest else None]):
                    c.append(v)
            types = [pa.int64(), pa.int64(), pa.int32(), *(arrow.get(kinds[n], pa.string()) for n in names), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)], ["record_id", "file_id", "agent", *columns, "extra"]
            )

    ddl = "record_id bigint, file_id bigint, agent int, " + "".join(f"{c} {_CAST.get(kinds[n], 'string')}, " for c, n in zip(columns, names)) + "extra string"
    source = records.select(
        F.col("record_id").cast("bigint"), F.col("file_id").cast("bigint"), F.col("agent").cast("int"), F.col("line")
    )
    wide = spread(source).mapInArrow(run, ddl)
    return wide.select("record_id", "file_id", "agent", *(F.col(c).alias(n) for c, n in zip(columns, names)), "extra")
