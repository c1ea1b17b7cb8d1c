"""Search filters: one options record, turned into column predicates and semi-joins, all of which must hold."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import fulltext


@dataclass(frozen=True)
class Filters:
    """What rows of a search index (type, id, entity_id, project_id, ...) must satisfy. Empty fields ask for nothing."""

    project_id: int | None = None
    types: tuple[str, ...] = ()
    note_types: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    status: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    title: str | None = None
    permalink: str | None = None
    permalink_match: str | None = None
    after: str | None = None  # an instant, 'YYYY-MM-DD HH:MM:SS' in UTC

    def row_types(self) -> tuple[str, ...]:
        return self.types or (("observation",) if self.categories else ("entity",))


def row_predicate(f: Filters) -> Column:
    """The filters that need the row alone."""
    c = F.col("type").isin(*f.row_types())
    if f.project_id is not None:
        c &= F.col("project_id") == f.project_id
    if f.note_types:
        c &= F.lower(F.get_json_object("metadata", "$.note_type")).isin(*[t.lower() for t in f.note_types])
    if f.categories:
        c &= F.col("category").isin(*f.categories)
    if f.title is not None and (expression := fulltext.prepare_title(f.title)):
        c &= token_match(F.col("title"), expression)
    if f.permalink is not None:
        c &= F.col("permalink") == f.permalink
    if f.permalink_match is not None:
        c &= permalink_matches(F.col("permalink"), f.permalink_match)
    if f.after is not None:
        c &= F.date_trunc("second", F.col("updated_at")) > F.lit(f.after).cast("timestamp_ntz")
    return c


def permalink_matches(permalink: Column, pattern: str) -> Column:
    """A lower-cased pattern: with a star a glob, with a slash the whole permalink, else whole tokens of it."""
    pattern = pattern.lower()
    if "*" in pattern:
        return permalink.rlike(T.glob_to_regex(pattern))
    if "/" in pattern:
        return permalink == pattern
    return token_match(permalink, fulltext.prepare_term(pattern, prefix=False))


def scopes(f: Filters) -> list[tuple[str, tuple[str, ...]]]:
    """The filters that are full-text expressions (title, permalink of one term), with their columns; they add to scores."""
    out = []
    if f.title is not None and (expression := fulltext.prepare_title(f.title)):
        out.append((expression, ("title",)))
    if f.permalink_match is not None and not {"*", "/"} & set(f.permalink_match):
        out.append((fulltext.prepare_term(f.permalink_match.lower(), prefix=False), ("permalink",)))
    return out


def asks_for_something(query: str | None, f: Filters) -> bool:
    """Is there a query or any filter beside the project? A request without one should be refused with guidance."""
    named = (f.types, f.note_types, f.categories, f.tags, f.metadata)
    return bool((query or "").strip() or any(named) or any(x is not None for x in (f.status, f.title, f.permalink, f.permalink_match, f.after)))


def token_match(column: Column, expression: str) -> Column:
    """Does the text of the column satisfy a full-text expression?"""
    tree = fulltext.parse(expression)
    asked = [p for p in fulltext.phrases(tree) if p.tokens]
    return fulltext.holds(tree, {p: fulltext.occurrences(T.tokens(column), p) for p in asked}) if asked else F.lit(False)


def json_strings(column: str, path: str) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(column, path), "array<string>"), F.array().cast("array<string>"))


def owner_predicate(f: Filters) -> Column | None:
    """The filters on the owning entity's metadata; metadata keys that are not plain words are ignored."""
    tests = []
    if f.status is not None:
        tests.append(F.get_json_object("entity_metadata", "$.status") == f.status)
    tests += [F.get_json_object("entity_metadata", f"$.{k}") == v for k, v in f.metadata.items() if re.fullmatch(r"[A-Za-z0-9_]+", k)]
    out = None
    for t in tests:
        out = t if out is None else out & t
    return out


def apply(rows: DataFrame, f: Filters, entities: DataFrame | None = None) -> DataFrame:
    """The rows that pass. entities (id, entity_metadata) is needed for owner filters; they are semi-joins on entity_id."""
    rows = rows.where(row_predicate(f))
    owner = owner_predicate(f)
    if owner is not None:
        rows = rows.join(entities.where(owner).select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    if f.tags:  # only the first tag counts
        tag = f.tags[0]
        tagged = entities.where(F.array_contains(json_strings("entity_metadata", "$.tags"), tag)).select(F.col("id").alias("entity_id"), F.lit(True).alias("__owner")).dropDuplicates(["entity_id"])
        rows = rows.join(tagged, "entity_id", "left").where(F.coalesce("__owner", F.lit(False)) | F.array_contains(json_strings("metadata", "$.tags"), tag)).drop("__owner")
    return rows
