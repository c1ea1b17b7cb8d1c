"""Pages of ordered results: exact totals, probes, and the merge of pages from several projects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Page:
    results: list[Row]
    total: int
    total_is_exact: bool
    has_more: bool
    current_page: int
    page_size: int


def clamp(page: int, size: int) -> tuple[int, int]:
    return max(1, page), max(1, size)


def window(rows: DataFrame, order: list[Column], page: int, size: int, extra: int = 0) -> DataFrame:
    """The rows of a 1-based page (and `extra` more): a top-k by the order, not a sort of everything."""
    page, size = clamp(page, size)
    return rows.orderBy(*order).offset((page - 1) * size).limit(size + extra)


def exact(rows: DataFrame, order: list[Column], page: int, size: int) -> Page:
    page, size = clamp(page, size)
    total = rows.count()
    got = window(rows, order, page, size).collect()
    return Page(got, total, True, (page - 1) * size + len(got) < total, page, size)


def probe(rows: DataFrame, order: list[Column], page: int, size: int) -> Page:
    """A page without a count: one more row tells whether others follow."""
    page, size = clamp(page, size)
    got = window(rows, order, page, size, 1).collect()
    return Page(got[:size], 0, False, len(got) > size, page, size)


def candidate_window(limit: int, offset: int) -> int:
    return max(100, 10 * (limit + offset))


def merge_projects(rows: DataFrame, project: str, score: str, order: list[Column], page: int, size: int) -> DataFrame:
    """One page over all projects: each gives its first page * size rows in its own order, then the scores descend.

    Scores are compared as they are, so a kind whose best scores are the lowest comes out worst first.
    """
    page, size = clamp(page, size)
    own = rows.withColumn("pos", F.row_number().over(Window.partitionBy(project).orderBy(*order))).where(F.col("pos") <= page * size)
    return window(own, [F.desc(score), F.col(project), F.col("pos")], page, size)


def project_totals(rows: DataFrame, project: str, page: int, size: int) -> DataFrame:
    """One row: n_projects with rows, total, total_is_exact, and has_more behind the merged page, by counts of each project."""
    page, size = clamp(page, size)
    own = rows.groupBy(project).agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(True).alias("exact"), (F.col("n") > page * size).alias("more"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    more = F.coalesce(F.bool_or("more"), F.lit(False)) | (total > page * size)
    return own.agg(F.count(F.lit(1)).alias("n_projects"), total.alias("total"), F.coalesce(F.bool_and("exact"), F.lit(True)).alias("total_is_exact"), more.alias("has_more"))


def with_total(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """The page's rows, each with the exact total; the total is one partial count joined as a single row."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return window(rows, order, page, size).crossJoin(F.broadcast(total))
