"""Path expressions. All of them stay inside JVM code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from copyledger.functions import ColumnLike, as_col


def full_path(base: ColumnLike, file: ColumnLike) -> Column:
    """Absolute path; null when either part is null."""
    return F.concat(as_col(base), F.lit("/"), as_col(file))


def file_name(path: ColumnLike) -> Column:
    """Last segment after trailing slashes are removed."""
    return F.substring_index(F.rtrim(as_col(path), F.lit("/")), "/", -1)


def file_ext(path: ColumnLike, trailing_dot_null: bool = False) -> Column:
    """Lower-case text after the last dot of the file name.

    A single leading dot never starts an extension. With ``trailing_dot_null``
    (the report rule) a trailing dot means no extension; otherwise it gives ''.
    """
    name = file_name(path)
    body = F.when(name.startswith("."), F.substr(name, F.lit(2))).otherwise(name)
    usable = body.contains(".")
    if trailing_dot_null:
        usable = usable & ~body.endswith(".")
    else:
        usable = usable & (name != ".")
    return F.when(usable, F.lower(F.substring_index(name, ".", -1)))


def fallback_ext(name: ColumnLike) -> Column:
    """Extension used for MIME guessing: dotfiles have none, '' when absent."""
    last = F.substring_index(as_col(name), "/", -1)
    usable = last.contains(".") & ~last.startswith(".")
    return F.when(usable, F.lower(F.substring_index(last, ".", -1))).otherwise(F.lit(""))


def base_segment(base: ColumnLike) -> Column:
    """File-system-safe label of a base path; 'root' for null or empty."""
    b = as_col(base)
    last = F.substring_index(F.regexp_replace(b, r"/\z", ""), "/", -1)
    safe = F.regexp_replace(last, r"[^a-zA-Z0-9._-]", "_")
    return F.when(b.isNull() | (b == ""), F.lit("root")).otherwise(safe)


def normalize_path(path: ColumnLike) -> Column:
    """Collapse '//', '.' and '..'; '..' above an absolute root is dropped."""
    p = as_col(path)
    absolute = p.startswith("/")

    def step(kept: Column, part: Column) -> Column:
        top = F.try_element_at(kept, F.lit(-1))
        up = (
            F.when(top.isNotNull() & (top != ".."), F.slice(kept, F.lit(1), F.size(kept) - 1))
            .when(absolute, kept)
            .otherwise(F.concat(kept, F.array(part)))
        )
        return F.when(part.isin("", "."), kept).when(part == "..", up).otherwise(F.concat(kept, F.array(part)))

    parts = F.aggregate(F.split(p, "/"), F.lit([]).cast("array<string>"), step)
    folded = F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))
    # Most paths are clean already; only the others pay for the fold.
    return F.when(p.rlike(r"/\.{0,2}(?:/|\z)|\A\.{1,2}(?:/|\z)"), folded).otherwise(p)


def expected_full_path(base: ColumnLike, file: ColumnLike) -> Column:
    """Path with exactly one slash between base and file."""
    slash = F.lit("/")
    return F.concat(F.rtrim(as_col(base), slash), slash, F.ltrim(as_col(file), slash))


def copy_target(path: ColumnLike, dest: ColumnLike, strip: int = 3) -> Column:
    """Destination below ``dest``: the path without its first ``strip``
    segments, or only the file name when it has no more than that."""
    names = F.filter(F.split(as_col(path), "/"), lambda s: s != "")
    kept = F.when(
        F.size(names) > strip, F.array_join(F.slice(names, F.lit(strip + 1), F.size(names) - strip), "/")
    ).otherwise(F.coalesce(F.try_element_at(names, F.lit(-1)), F.lit("")))
    return F.concat(as_col(dest), F.lit("/"), kept)


def under(path: ColumnLike, root: ColumnLike) -> Column:
    """True for ``root`` itself and for everything below ``root/``."""
    p, r = as_col(path), as_col(root)
    return (p == r) | F.startswith(p, F.concat(r, F.lit("/")))


def tree_key(path: ColumnLike) -> Column:
    """Sort key by which a directory comes right before everything below it, and
    nothing else between: the slash sorts before all other characters."""
    key = F.rtrim(as_col(path), F.lit("/"))
    # Characters that would sort beside the slash are written as two.
    for raw, pair in (("\x02", "\x02c"), ("\x01", "\x02b"), ("\x00", "\x02a")):
        key = F.replace(key, F.lit(raw), F.lit(pair))
    return F.translate(key, "/", "\x01")


def tree_span(path: ColumnLike) -> tuple[Column, Column]:
    """The first tree key of ``path`` and what is below it, and the first key behind."""
    key = tree_key(path)
    return key, F.concat(key, F.lit("\x02"))
