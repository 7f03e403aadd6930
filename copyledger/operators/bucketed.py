"""Catalogs stored by content group, so that group questions need no shuffle."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame


class BucketedCatalog(NamedTuple):
    """``spread`` is bucketed on (hash, mime_type) and holds whole groups, each in one
    bucket; ``crowded`` holds the rows of the groups that are too large for that.
    No group has rows in both."""

    spread: DataFrame
    crowded: DataFrame


Catalog = DataFrame | BucketedCatalog


def per_part(catalog: Catalog, question: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """Answers of a question about single groups, over all parts of a catalog.

    ``question`` gets rows and whether their groups lie in place: then joins on the
    group keys stay in the bucket, else hot groups have to be spread.
    """
    if isinstance(catalog, BucketedCatalog):
        return question(catalog.spread, True).unionByName(question(catalog.crowded, False))
    return question(catalog, False)


def all_rows(catalog: Catalog) -> DataFrame:
    return per_part(catalog, lambda rows, _: rows)
