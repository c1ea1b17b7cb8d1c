"""Schemas of notes: field definitions, inference from use, validation and drift, as aggregates over observations.

A field's use is counted by note: two levels of partial aggregation, (note, field) then field. Samples are the first
distinct values in order of note and place; they are bounded by a rank, never gathered whole.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

REQUIRED, OPTIONAL, DROPPED = 0.95, 0.25, 0.10
SCALARS = frozenset("string integer number boolean any".split())


FIELD = "struct<pos: int, source: string, field: string, required: boolean, declared_array: boolean, allowed: array<string>>"
DEFINITION = f"struct<entity: string, mode: string, fields: array<{FIELD}>, error: string>"


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    required: bool = True
    is_array: bool = False
    values: tuple[str, ...] = ()
    description: str | None = None

    @property
    def is_enum(self) -> bool:
        return bool(self.values)

    @property
    def is_reference(self) -> bool:
        """A type that starts with a capital names another note type."""
        return self.type[:1].isupper() and self.type.lower() not in SCALARS


def parse_fields(schema: dict) -> list[Field]:
    """The fields of a schema mapping: name?, (array), (enum), (object), with a description after a comma."""
    out = []
    for key, value in schema.items():
        m = re.fullmatch(r"\s*([^()?]+?)(\?)?\s*(?:\((array|enum|object)(?:,\s*(.*))?\))?\s*", str(key))
        if not m:
            raise ValueError(f"malformed field {key!r}")
        name, kind, about = m[1], m[3], m[4]
        values: tuple[str, ...] = ()
        if kind == "enum":
            items = value if isinstance(value, list) else re.sub(r"^\[|\].*$", "", str(value)).split(",")
            values = tuple(str(v).strip() for v in items if str(v).strip())
            what = "enum"
        elif isinstance(value, dict):
            what = "object"
        else:
            what, _, said = str(value if value is not None else "any").partition(",")
            about = about or said.strip() or None
        out.append(Field(name, what.strip(), m[2] is None, kind == "array", values, about))
    return out


def parse_schema(frontmatter: dict) -> tuple[str, list[Field], str]:
    """(entity, fields, mode) of a schema note: mode is warn or strict (error means strict)."""
    entity, schema = frontmatter.get("entity"), frontmatter.get("schema")
    if not entity:
        raise ValueError("schema note has no entity")
    if not isinstance(schema, dict):
        raise ValueError("schema note has no schema mapping")
    settings = frontmatter.get("settings") or {}
    mode = settings.get("validation", frontmatter.get("validation", "warn"))
    if mode not in ("warn", "strict", "error"):
        raise ValueError(f"unknown validation mode {mode!r}")
    return str(entity), parse_fields(schema), "strict" if mode == "error" else mode


def frequencies(values: DataFrame, notes: DataFrame, samples: int = 5) -> DataFrame:
    """field, n_notes, total, percentage, is_array and samples of values (note, place, field, value) over all notes (note)."""
    per_note = values.groupBy("note", "field").agg(F.count(F.lit(1)).alias("n"))
    counted = per_note.groupBy("field").agg(F.count(F.lit(1)).alias("n_notes"), F.sum((F.col("n") > 1).cast("long")).alias("n_multi"))
    total = notes.agg(F.count_distinct("note").alias("total"))
    first = values.groupBy("field", "value").agg(F.min(F.struct("note", "place")).alias("at"))
    kept = first.withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy("at", "value"))).where(F.col("r") <= samples)
    lists = kept.groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda s: s["value"]).alias("samples"))
    out = counted.crossJoin(F.broadcast(total)).join(lists, "field", "left")
    return out.select("field", "n_notes", "total", (F.col("n_notes") / F.col("total")).alias("percentage"), (F.col("n_multi") > F.col("n_notes") / 2).alias("is_array"), "samples")


def infer(values: DataFrame, notes: DataFrame, required: float = REQUIRED, optional: float = OPTIONAL) -> DataFrame:
    """frequencies with the suggestion for each field: required, optional or excluded."""
    share = F.col("percentage")
    return frequencies(values, notes).withColumn("suggestion", F.when(share >= required, "required").when(share >= optional, "optional").otherwise("excluded"))


def most_common_target(values: DataFrame) -> DataFrame:
    """field and target: the commonest target of values (field, target, place), the first seen among equals."""
    n = values.groupBy("field", "target").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    return n.groupBy("field").agg(F.max_by("target", F.struct("n", -F.col("first"))).alias("target"))


def field_table(spark: SparkSession, fields: list[Field]) -> DataFrame:
    rows = [(k, f.name, f.required, f.is_array, f.is_reference, list(f.values)) for k, f in enumerate(fields)]
    return spark.createDataFrame(rows, "pos int, field string, required boolean, declared_array boolean, is_reference boolean, allowed array<string>")


def drift(fields: DataFrame, used: DataFrame, new: float = OPTIONAL, dropped: float = DROPPED) -> DataFrame:
    """field and change (new, dropped, became_array, became_single) of declared fields against frequencies."""
    both = used.select("field", "percentage", "is_array").join(fields.select("field", "declared_array"), "field", "full")
    declared, share = F.col("declared_array").isNotNull(), F.coalesce("percentage", F.lit(0.0))
    changes = F.array_compact(
        F.array(
            F.when(~declared & (share >= new), "new"),
            F.when(declared & (share < dropped), "dropped"),
            F.when(declared & ~F.col("declared_array") & F.col("is_array"), "became_array"),
            F.when(declared & F.col("declared_array") & ~F.col("is_array"), "became_single"),
        )
    )
    return both.select("field", F.explode(changes).alias("change"))


def validate(values: DataFrame, notes: DataFrame, fields: DataFrame) -> DataFrame:
    """note, field, status (present, missing, enum_mismatch) and wrong (values outside an enum) for every note and field."""
    have = values.groupBy("note", "field").agg(F.array_sort(F.collect_set("value")).alias("found"))
    asked = notes.select("note").distinct().crossJoin(F.broadcast(fields))
    joined = asked.join(have, ["note", "field"], "left")
    wrong = F.when((F.size("allowed") > 0) & F.col("found").isNotNull(), F.array_sort(F.array_except("found", "allowed"))).otherwise(F.array().cast("array<string>"))
    out = joined.withColumn("wrong", wrong)
    status: Column = F.when(F.col("found").isNull(), "missing").when(F.size("wrong") > 0, "enum_mismatch").otherwise("present")
    return out.select("note", "field", "required", status.alias("status"), "wrong")


def findings(values: DataFrame, notes: DataFrame, fields: DataFrame) -> DataFrame:
    """note, field and message of the issues that `report` counts. Wrong values stand in the message in order of place."""
    missing = F.when(F.col("is_reference"), F.format_string("Missing required field: %1$s (no '%1$s [[...]]' relation found)", "field")).otherwise(F.format_string("Missing required field: %1$s (expected [%1$s] observation)", "field"))
    known = fields.select("field", "is_reference", "allowed")
    absent = validate(values, notes, fields).where((F.col("status") == "missing") & F.col("required")).join(F.broadcast(known), "field")
    outside = values.join(F.broadcast(known.where(F.size("allowed") > 0)), "field").where(~F.array_contains("allowed", F.col("value")))
    outside = outside.join(notes.select("note").distinct(), "note", "left_semi").groupBy("note", "field", "allowed").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]).alias("wrong"))
    text = F.format_string("Field '%s' has invalid value(s): %s (allowed: %s)", "field", F.array_join("wrong", ", "), F.array_join("allowed", ", "))
    return absent.select("note", "field", missing.alias("message")).unionByName(outside.select("note", "field", text.alias("message")))


def unmatched(values: DataFrame, fields: DataFrame) -> DataFrame:
    """note, field and n of the fields in use that are not declared."""
    return values.join(F.broadcast(fields.select("field")), "field", "left_anti").groupBy("note", "field").agg(F.count(F.lit(1)).alias("n"))


def report(validated: DataFrame, mode: str = "warn") -> DataFrame:
    """note, n_warnings, n_errors and passed: missing required fields and enum mismatches are issues of the mode's kind."""
    issue = ((F.col("status") == "missing") & F.col("required")) | (F.col("status") == "enum_mismatch")
    n = F.sum(issue.cast("long"))
    zero = F.lit(0).cast("long")
    out = validated.groupBy("note").agg(n.alias("n"))
    strict = mode == "strict"
    return out.select("note", (zero if strict else F.col("n")).alias("n_warnings"), (F.col("n") if strict else zero).alias("n_errors"), (F.lit(True) if not strict else F.col("n") == 0).alias("passed"))


def totals(reports: DataFrame) -> DataFrame:
    """valid, warning and error notes per type and over all (type null), of reports with type."""
    return reports.rollup("type").agg(F.count(F.lit(1)).alias("n_notes"), F.sum(F.col("passed").cast("long")).alias("n_valid"), F.sum((F.col("n_warnings") > 0).cast("long")).alias("n_warned"), F.sum((F.col("n_errors") > 0).cast("long")).alias("n_failed"))


# -- every note by the schema that holds for it


def _defined(metadata: str, is_note: bool) -> dict:
    """A definition of a note's frontmatter: a schema note names its entity, an inline mapping is the note's own type's."""
    said = json.loads(metadata)
    try:
        entity, fields, mode = parse_schema(said if is_note else {"entity": str(said.get("type") or "unknown"), "schema": said["schema"], "settings": said.get("settings")})
        of = lambda f: "relation" if f.is_reference else "observation"
        rows = [(of(f), f) for f in fields]
        keys = (said.get("settings") or {}).get("frontmatter") if is_note else None
        rows += [("frontmatter", f) for f in parse_fields(keys)] if isinstance(keys, dict) else []
    except (ValueError, AttributeError) as e:
        return {"entity": str(said.get("entity")) if said.get("entity") else None, "mode": None, "fields": [], "error": str(e)}
    return {"entity": entity, "mode": mode, "error": None, "fields": [{"pos": k, "source": source, "field": f.name, "required": f.required, "declared_array": f.is_array, "allowed": list(f.values)} for k, (source, f) in enumerate(rows)]}


def _definitions(metadata: pa.Array, is_note: pa.Array) -> pa.Array:
    field = pa.struct({"pos": pa.int32(), "source": pa.string(), "field": pa.string(), "required": pa.bool_(), "declared_array": pa.bool_(), "allowed": pa.list_(pa.string())})
    kind = pa.struct({"entity": pa.string(), "mode": pa.string(), "fields": pa.list_(field), "error": pa.string()})
    return pa.array([_defined(m, n) for m, n in zip(metadata.to_pylist(), is_note.to_pylist(), strict=True)], kind)


def definitions(entities: DataFrame) -> DataFrame:
    """note, file_path, is_note and definition of every entity (id, file_path, note_type, entity_metadata) whose frontmatter has a schema mapping, and of schema notes without one (an error)."""
    is_note = F.lower("note_type") == "schema"
    mapped = F.get_json_object("entity_metadata", "$.schema").startswith("{")
    own = entities.where(is_note | mapped).select(F.col("id").alias("note"), "file_path", is_note.alias("is_note"), "entity_metadata")
    return own.select("note", "file_path", "is_note", F.arrow_udf(_definitions, DEFINITION)(F.col("entity_metadata"), F.col("is_note")).alias("definition"))


def lookup(defined: DataFrame) -> DataFrame:
    """key and definition: for each entity name, the first schema note by path."""
    keyed = defined.where("is_note and definition.entity is not null").select(T.note_type(F.col("definition.entity")).alias("key"), "file_path", "definition")
    return keyed.groupBy("key").agg(F.min_by("definition", "file_path").alias("definition"))


def resolve(entities: DataFrame, defined: DataFrame) -> DataFrame:
    """note, note_type, origin (inline, reference, type) and definition of each entity that has a schema.

    A schema mapping of its own comes first, then the schema note that its `schema` names, then that of its type: two
    look-ups by equi-join and one choice, for all notes at once. defined: `definitions`, best written before."""
    notes, said = lookup(defined), F.get_json_object("entity_metadata", "$.schema")
    rows = entities.where(F.lower("note_type") != "schema").select(F.col("id").alias("note"), "note_type", F.when(~said.startswith("{"), T.note_type(said)).alias("asked"), T.note_type(F.col("note_type")).alias("own"))
    rows = rows.join(defined.where("not is_note").select("note", F.col("definition").alias("d0")), "note", "left")
    for k, key in (("d1", "asked"), ("d2", "own")):
        rows = rows.join(notes.select(F.col("key").alias(key), F.col("definition").alias(k)), key, "left")
    origin = F.when(F.col("d0").isNotNull(), "inline").when(F.col("d1").isNotNull(), "reference").when(F.col("d2").isNotNull(), "type")
    return rows.select("note", "note_type", origin.alias("origin"), F.coalesce("d0", "d1", "d2").alias("definition")).where("origin is not null")


def frontmatter_values(entities: DataFrame) -> DataFrame:
    """note, source, place, field and value of every frontmatter key that has a value, whatever keys there are."""
    keys = entities.select(F.col("id").alias("note"), F.explode(F.from_json("entity_metadata", "map<string,string>")).alias("field", "value"))
    return keys.where("value is not null").select("note", F.lit("frontmatter").alias("source"), F.lit(0).alias("place"), "field", "value")


def check(resolved: DataFrame, values: DataFrame) -> DataFrame:
    """note, mode, source, field, required, status (present, missing, enum_mismatch) and wrong of every note and field of its schema.

    values: note, source (observation, relation, frontmatter), place, field, value."""
    asked = resolved.where("definition.error is null").select("note", F.col("definition.mode").alias("mode"), F.explode("definition.fields").alias("f"))
    asked = asked.select("note", "mode", "f.source", "f.field", "f.required", "f.allowed")
    have = values.groupBy("note", "source", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]).alias("found"))
    both = asked.join(have, ["note", "source", "field"], "left")
    wrong = F.when((F.size("allowed") > 0) & F.col("found").isNotNull(), F.filter("found", lambda v: ~F.array_contains("allowed", v))).otherwise(F.array().cast("array<string>"))
    both = both.withColumn("wrong", wrong)
    status = F.when(F.col("found").isNull(), "missing").when(F.size("wrong") > 0, "enum_mismatch").otherwise("present")
    return both.select("note", "mode", "source", "field", "required", status.alias("status"), "wrong", "allowed")


def messages(checked: DataFrame) -> DataFrame:
    """note, source, field and message of every missing required field and every value outside an enum."""
    issue = ((F.col("status") == "missing") & F.col("required")) | (F.col("status") == "enum_mismatch")
    missing = (
        F.when(F.col("source") == "relation", F.format_string("Missing required field: %1$s (no '%1$s [[...]]' relation found)", "field"))
        .when(F.col("source") == "frontmatter", F.format_string("Missing frontmatter key: %s", "field"))
        .otherwise(F.format_string("Missing required field: %1$s (expected [%1$s] observation)", "field"))
    )
    listed = F.array_join("wrong", ", "), F.array_join("allowed", ", ")
    outside = F.when(F.col("source") == "frontmatter", F.format_string("Frontmatter key '%s' has invalid value: %s (allowed: %s)", "field", *listed)).otherwise(F.format_string("Field '%s' has invalid value(s): %s (allowed: %s)", "field", *listed))
    return checked.where(issue).select("note", "source", "field", F.when(F.col("status") == "missing", missing).otherwise(outside).alias("message"))


def reports(checked: DataFrame) -> DataFrame:
    """note, n_warnings, n_errors and passed of every checked note, by the mode of its own schema."""
    issue = ((F.col("status") == "missing") & F.col("required")) | (F.col("status") == "enum_mismatch")
    strict = F.col("mode") == "strict"
    out = checked.groupBy("note").agg(F.count_if(issue & ~strict).alias("n_warnings"), F.count_if(issue & strict).alias("n_errors"))
    return out.withColumn("passed", F.col("n_errors") == 0)


def covered(entities: DataFrame, defined: DataFrame) -> DataFrame:
    """type, n_notes and has_schema: the note types in use, and those that a schema note names though no note has them."""
    used = entities.where(F.lower("note_type") != "schema").groupBy(T.note_type(F.col("note_type")).alias("type")).agg(F.count(F.lit(1)).alias("n_notes"))
    known = lookup(defined.where("definition.error is null")).select(F.col("key").alias("type"), F.lit(True).alias("has_schema"))
    return used.join(known, "type", "full").select("type", F.coalesce("n_notes", F.lit(0)).cast("long").alias("n_notes"), F.coalesce("has_schema", F.lit(False)).alias("has_schema"))


def unnamed(resolved: DataFrame, values: DataFrame) -> DataFrame:
    """note, source, field and n of the values in use that the note's own schema does not name; frontmatter keys don't count."""
    named = resolved.select("note", F.explode_outer("definition.fields").alias("f")).select("note", "f.source", "f.field")
    own = values.where("source <> 'frontmatter'").join(resolved.select("note"), "note", "left_semi")
    return own.join(named, ["note", "source", "field"], "left_anti").groupBy("note", "source", "field").agg(F.count(F.lit(1)).alias("n"))
