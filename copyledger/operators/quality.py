"""Catalog health checks (count and samples) and manifest validation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copyledger.functions import paths, validity
from copyledger.session import existing_paths
from copyledger.sources.manifest_io import read_lines


def has_slash_issue() -> Column:
    return F.endswith("base_path", F.lit("/")) | F.startswith("file_path", F.lit("/"))


def has_bad_hash() -> Column:
    return ~validity.hash_valid("hash", lower_only=True)


def has_bad_size() -> Column:
    return F.col("file_size").isNull() | (F.col("file_size") < 0)


def has_path_mismatch() -> Column:
    return ~F.col("full_path").eqNullSafe(paths.expected_full_path("base_path", "file_path"))


def slash_issues(catalog: DataFrame, base_paths: DataFrame) -> DataFrame:
    return catalog.where(has_slash_issue()).select("id", "base_path", "file_path", "full_path")


def missing_base_paths(catalog: DataFrame, base_paths: DataFrame) -> DataFrame:
    return catalog.select("base_path").distinct().join(base_paths.select("base_path"), "base_path", "left_anti")


def invalid_hashes(catalog: DataFrame, base_paths: DataFrame) -> DataFrame:
    return catalog.where(has_bad_hash()).select("id", "hash")


def bad_sizes(catalog: DataFrame, base_paths: DataFrame) -> DataFrame:
    return catalog.where(has_bad_size()).select("id", "file_size")


def path_mismatches(catalog: DataFrame, base_paths: DataFrame) -> DataFrame:
    expected = paths.expected_full_path("base_path", "file_path").alias("expected_full_path")
    return catalog.where(has_path_mismatch()).select("id", "base_path", "file_path", "full_path", expected)


def duplicate_paths(catalog: DataFrame, base_paths: DataFrame) -> DataFrame:
    return catalog.groupBy("full_path").agg(F.count(F.lit(1)).alias("ct")).where("ct > 1")


def duplicate_priorities(catalog: DataFrame, base_paths: DataFrame) -> DataFrame:
    return base_paths.groupBy("priority").agg(F.count(F.lit(1)).alias("ct")).where("ct > 1")


def duplicate_priority_paths(base_paths: DataFrame) -> DataFrame:
    """Base paths that share a priority, one row each."""
    shared = duplicate_priorities(base_paths, base_paths)
    return base_paths.join(shared, "priority").select("priority", "base_path").orderBy("priority", "base_path")


def empty_vaults(catalog: DataFrame, base_paths: DataFrame) -> DataFrame:
    used = catalog.select("base_path").distinct()
    return base_paths.where("is_vault").select("base_path").join(used, "base_path", "left_anti")


def invisible_rows(catalog: DataFrame, base_paths: DataFrame) -> DataFrame:
    """Rows the ranked catalog drops: their base path is not registered."""
    lost = catalog.join(base_paths.select("base_path"), "base_path", "left_anti")
    return lost.select("id", "base_path", "file_path", "full_path")


class Check(NamedTuple):
    """Problem rows of a check and the order its samples are shown in."""

    rows: Callable[[DataFrame, DataFrame], DataFrame]
    order: list[str]
    ascending: list[bool]


CHECKS = {
    "base_or_file_path_slash_issues": Check(slash_issues, ["id"], [True]),
    "missing_base_paths": Check(missing_base_paths, ["base_path"], [True]),
    "invalid_hash_format": Check(invalid_hashes, ["id"], [True]),
    "negative_or_null_file_size": Check(bad_sizes, ["id"], [True]),
    "full_path_mismatch": Check(path_mismatches, ["id"], [True]),
    "duplicate_full_path": Check(duplicate_paths, ["ct", "full_path"], [False, True]),
    "duplicate_base_path_priority": Check(duplicate_priorities, ["priority"], [True]),
    "vault_base_paths_without_files": Check(empty_vaults, ["base_path"], [True]),
    "hashes_not_in_files_view": Check(invisible_rows, ["id"], [True]),
}

# Checks that only filter catalog rows.
ROW_TESTS = {
    "base_or_file_path_slash_issues": has_slash_issue,
    "invalid_hash_format": has_bad_hash,
    "negative_or_null_file_size": has_bad_size,
    "full_path_mismatch": has_path_mismatch,
}


def check(catalog: DataFrame, base_paths: DataFrame, name: str) -> DataFrame:
    """(check_name, problem_count) of one check."""
    return CHECKS[name].rows(catalog, base_paths).agg(F.count(F.lit(1)).alias("problem_count")).select(
        F.lit(name).alias("check_name"), "problem_count"
    )


def run_checks(catalog: DataFrame, base_paths: DataFrame) -> DataFrame:
    """(check_name, problem_count) of all checks.

    Row tests and base path tests share one pass: counts per base path, of
    which there are few, are then matched with the registered ones.
    """
    known = base_paths.select("base_path", F.lit(True).alias("_known"))
    per_base = catalog.groupBy("base_path").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(test()).alias(name) for name, test in ROW_TESTS.items()]
    )
    unknown = F.col("_known").isNull()
    counts = {
        **{name: F.sum(name) for name in ROW_TESTS},
        "missing_base_paths": F.count_if(unknown),
        "hashes_not_in_files_view": F.sum(F.when(unknown, F.col("_rows"))),
    }
    totals = per_base.join(known, "base_path", "left").agg(
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(name) for name, c in counts.items()]
    )
    parts = [totals.unpivot([], list(counts), "check_name", "problem_count")]
    parts += [check(catalog, base_paths, n) for n in CHECKS if n not in counts]
    return reduce(DataFrame.unionByName, parts)


def samples(catalog: DataFrame, base_paths: DataFrame, name: str, n: int = 50) -> DataFrame:
    """The first ``n`` offending rows of one check."""
    chosen = CHECKS[name]
    return chosen.rows(catalog, base_paths).orderBy(chosen.order, ascending=chosen.ascending).limit(n)


def id_high_water(catalog: DataFrame, next_id: int) -> DataFrame:
    """Whether the next id lies above every id in use."""
    top = F.coalesce(F.max("id"), F.lit(0))
    return catalog.agg(
        F.lit("id_high_water").alias("check_name"),
        top.alias("max_id"),
        F.lit(next_id).cast("bigint").alias("next_id"),
        F.when(F.lit(next_id) <= top, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("problem_count"),
    )


def validate_lines(lines: DataFrame) -> DataFrame:
    """Errors of manifest lines (``source``, ``line_no``, ``value``).

    A wrong column count is reported alone; otherwise a bad hash and a bad size
    each give one row, with the offending text. Times and MIME types are not
    checked. No rows means valid.
    """
    parts = F.split("value", "\t", -1)
    n = F.size(parts)
    h, s = F.get(parts, F.lit(0)), F.get(parts, F.lit(2))

    def problem(name: str, found: Column) -> Column:
        return F.struct(F.lit(name).alias("error"), found.alias("found"))

    errors = F.array_compact(
        F.array(
            F.when(n != 6, problem("column_count", n.cast("string"))),
            F.when((n == 6) & ~validity.hash_valid(h), problem("invalid_hash", h)),
            F.when((n == 6) & ~validity.size_valid(s), problem("invalid_size", s)),
        )
    )
    return lines.select("source", "line_no", F.explode(errors).alias("_e")).select("source", "line_no", "_e.*")


def validate_manifest(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """:func:`validate_lines` of manifest files; an absent file is one error."""
    present = existing_paths(spark, names)
    absent = [(n, None, "no_such_file", None) for n in names if n not in present]
    errors = spark.createDataFrame(absent, "source string, line_no bigint, error string, found string")
    if present:
        errors = validate_lines(read_lines(spark, list(present))).unionByName(errors)
    return errors
