"""MIME type expressions."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from copyledger.functions import ColumnLike, as_col, paths

# Extension -> MIME type fallback, its default, and the token pattern.
EXTENSION_MIME = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "webp": "image/webp",
    "heic": "image/heic",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "bmp": "image/bmp",
    "svg": "image/svg+xml",
    "pdf": "application/pdf",
    "mp4": "video/mp4",
    "m4v": "video/mp4",
    "mov": "video/quicktime",
    "mkv": "video/x-matroska",
    "avi": "video/x-msvideo",
    "mp3": "audio/mpeg",
    "wav": "audio/vnd.wave",
    "json": "application/json",
    "xml": "application/xml",
    "html": "text/html",
    "htm": "text/html",
    "txt": "text/plain",
    "log": "text/plain",
}
DEFAULT_MIME = "application/octet-stream"
MIME_PATTERN = r"\A[a-z0-9][a-z0-9!#$&^_.+-]*/[a-z0-9][a-z0-9!#$&^_.+-]*\z"


def major_type(mime: ColumnLike, report: bool = False) -> Column:
    """Part before the slash. The filter rule keeps '/x' whole and maps null or
    blank to ''; the report rule always cuts at the first slash."""
    m = as_col(mime)
    head = F.substring_index(m, "/", 1)
    if report:
        return head
    cut = F.when(F.instr(m, "/") > 1, head).otherwise(m)
    return F.when(m.isNull() | m.rlike(r"\A\s*\z"), F.lit("")).otherwise(cut)


def has_major(mime: ColumnLike, majors: Iterable[str]) -> Column:
    """Whether :func:`major_type` is one of ``majors``. Plain majors become
    equality and prefix tests, which file scans can evaluate on statistics."""
    m, wanted = as_col(mime), list(majors)
    plain = [x for x in wanted if x.strip() and "/" not in x]
    test = F.lit(False)
    for x in plain:
        test = test | (m == x) | F.startswith(m, F.lit(f"{x}/"))
    other = [x for x in wanted if x not in plain]
    if other:
        test = test | major_type(m).isin(other)
    return F.coalesce(test, F.lit(False)) if other else test


def is_image(mime: ColumnLike) -> Column:
    return F.coalesce(F.lower(as_col(mime)).startswith("image/"), F.lit(False))


def sanitize_mime(mime: ColumnLike) -> Column:
    """Replace each run of non-alphanumerics by one underscore."""
    return F.regexp_replace(as_col(mime), "[^a-zA-Z0-9]+", "_")


def mime_clean(mime: ColumnLike) -> Column:
    """Drop parameters after ';' and surrounding blanks; null gets the default."""
    return F.coalesce(F.trim(F.substring_index(as_col(mime), ";", 1)), F.lit(DEFAULT_MIME))


def mime_valid(mime: ColumnLike) -> Column:
    return F.coalesce(F.lower(as_col(mime)).rlike(MIME_PATTERN), F.lit(False))


def mime_from_ext(ext: ColumnLike) -> Column:
    """MIME type of an extension, any case, with the default for unknown ones."""
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(EXTENSION_MIME.items())])
    return F.coalesce(F.element_at(table, F.lower(as_col(ext))), F.lit(DEFAULT_MIME))


def mime_from_name(name: ColumnLike) -> Column:
    return mime_from_ext(paths.fallback_ext(name))
