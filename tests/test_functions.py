"""Edge rows of the column functions."""

import pytest
from pyspark.sql import functions as F

from copyledger.functions import mime, paths, sizes, times, validity
from copyledger.operators.keyed import hex_bucket


@pytest.fixture(scope="module")
def apply(spark):
    def run(fn, values, kind="string"):
        df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
        return [r[0] for r in df.select(fn(F.col("x"))).collect()]

    return run


def test_file_name(apply):
    cases = {"a/b.TXT": "b.TXT", "a/b/": "b", "b": "b", "": "", "/": "", "a//": "a", None: None}
    assert apply(paths.file_name, list(cases)) == list(cases.values())


def test_file_ext(apply):
    cases = {
        "a/b.TXT": "txt", "a/.bashrc": None, ".tar.gz": "gz", "foo.": "", "a/b/": None, ".": None, "..": "", "": None,
        "x.d/name": None, "a.b.C/": "c",
    }
    assert apply(paths.file_ext, list(cases)) == list(cases.values())
    report = {"foo.": None, "..": None, ".tar.gz": "gz", ".x.": None, "a.b": "b", ".bashrc": None}
    assert apply(lambda c: paths.file_ext(c, trailing_dot_null=True), list(report)) == list(report.values())


def test_fallback_ext(apply):
    cases = {"a/b.JPG": "jpg", ".x.jpg": "", "name": "", "a.b/name": ""}
    assert apply(paths.fallback_ext, list(cases)) == list(cases.values())


def test_base_segment(apply):
    cases = {"/a/b/": "b", "/a/b c": "b_c", "": "root", None: "root", "/a/b//": "", "x": "x"}
    assert apply(paths.base_segment, list(cases)) == list(cases.values())


def test_normalize_path(apply):
    cases = {
        "/a/./b/../c//d": "/a/c/d", "/../a": "/a", "/": "/", "/a/b": "/a/b", "/a/b/": "/a/b", "a/../../b": "../b",
        "./a": "a", "../a": "../a", "/a/..b/.c": "/a/..b/.c", "/a/..": "/", "/a/b/.": "/a/b", "/..a": "/..a",
    }
    assert apply(paths.normalize_path, list(cases)) == list(cases.values())


def test_expected_and_full_path(spark):
    df = spark.createDataFrame([("/b//", "//f"), ("/b", "f"), (None, "f")], "b string, f string")
    got = [tuple(r) for r in df.select(paths.expected_full_path("b", "f"), paths.full_path("b", "f")).collect()]
    assert got == [("/b/f", "/b/////f"), ("/b/f", "/b/f"), (None, None)]


def test_copy_target(apply):
    cases = {"/a/b/c/d/e": "/d/d/e", "/a/b/c": "/d/c", "/a/b/c/d": "/d/d", "/x": "/d/x"}
    assert apply(lambda c: paths.copy_target(c, F.lit("/d")), list(cases)) == list(cases.values())


def test_under(apply):
    cases = {"/vol/v0": True, "/vol/v0/f": True, "/vol/v0x/f": False, "/vol": False}
    assert apply(lambda c: paths.under(c, F.lit("/vol/v0")), list(cases)) == list(cases.values())


def test_major_type(apply):
    cases = {"image/png": "image", "foo": "foo", "/x": "/x", "": "", "  ": "", None: "", "a/b/c": "a"}
    assert apply(mime.major_type, list(cases)) == list(cases.values())
    assert apply(lambda c: mime.major_type(c, report=True), ["/x", "foo", "a/b"]) == ["", "foo", "a"]


def test_has_major_equals_major_type(apply):
    values = ["image/png", "image", "images/x", "/image", "Image/x", "", " ", None, "/x", "a/b", "text/plain"]
    for majors in (["image"], ["image", "text"], [""], ["/x", "a"], ["image", ""]):
        expected = [m in majors for m in apply(mime.major_type, values)]
        assert [bool(v) for v in apply(lambda c: mime.has_major(c, majors), values)] == expected


def test_mime_rules(apply):
    assert apply(mime.is_image, ["IMAGE/x", "images/x", None]) == [True, False, False]
    assert apply(mime.sanitize_mime, ["image/svg+xml", "a--b"]) == ["image_svg_xml", "a_b"]
    assert apply(mime.mime_clean, [" text/html ; charset=x", None]) == ["text/html", "application/octet-stream"]
    valid = {"text/plain": True, "TEXT/Plain": True, "text": False, "/x": False, "a/b c": False, None: False}
    assert apply(mime.mime_valid, list(valid)) == list(valid.values())
    assert apply(mime.mime_from_ext, ["JPG", "htm", "zzz", ""]) == [
        "image/jpeg", "text/html", "application/octet-stream", "application/octet-stream",
    ]


SIZES = [0, 999, 1000, 1023, 1024, 1088, 1023999, 1024000, 999999999, 10**9, 10**12, 10**15, -5]


@pytest.mark.parametrize("total", [False, True])
@pytest.mark.parametrize(
    "style, expected",
    [
        ("binary", ["0 B", "999 B", "1000 B", "1023 B", "1.000 KB", "1.063 KB", "999.999 KB", "1000.000 KB",
                    "953.674 MB", "953.674 MB", "931.323 GB", "909.495 TB", "-5 B"]),
        ("si2", ["0.00 B", "999.00 B", "1.00 KB", "1.02 KB", "1.02 KB", "1.09 KB", "1.02 MB", "1.02 MB",
                 "1000.00 MB", "1.00 GB", "1000.00 GB", "1000000.00 GB", "-5.00 B"]),
        ("iec1", ["0.0 B", "999.0 B", "1000.0 B", "1023.0 B", "1.0 KiB", "1.0 KiB", "999.9 KiB", "0.9 MiB",
                  "953.6 MiB", "953.6 MiB", "931.3 GiB", "909.4 TiB", "-5.0 B"]),
        ("si1", ["0.0 B", "999.0 B", "1.0 kB", "1.0 kB", "1.0 kB", "1.1 kB", "1.0 MB", "1.0 MB", "1000.0 MB",
                 "1.0 GB", "1.0 TB", "1.0 PB", "-5.0 B"]),
        ("si1_trunc", ["0 B", "999 B", "1.0 KB", "1.0 KB", "1.0 KB", "1.0 KB", "1.0 MB", "1.0 MB", "999.9 MB",
                       "1.0 GB", "1.0 TB", "1000.0 TB", "-5 B"]),
    ],
)
def test_size_text(apply, style, expected, total):
    assert apply(lambda c: sizes.size_text(c, style, total), SIZES, "bigint") == expected


def test_size_text_extremes(apply):
    top = [2**62, 2**63 - 1]
    assert apply(lambda c: sizes.size_text(c, "binary"), top, "bigint") == ["4.000 EB", "8.000 EB"]
    assert apply(lambda c: sizes.size_text(c, "si1"), top, "bigint") == ["4.6 EB", "9.2 EB"]
    assert apply(lambda c: sizes.size_text(c, "binary"), [None], "bigint") == [None]


def test_totals_beyond_64_bits(spark):
    df = spark.createDataFrame([(2**63 - 1,)] * 3, "n bigint")
    total = df.agg(sizes.exact_sum("n").alias("t")).select(sizes.size_text("t", "si1", total=True)).first()[0]
    assert total == "27.7 EB"


def test_size_bucket(apply):
    cases = {-1: "< 1KB", 999: "< 1KB", 1000: "KB", 10**6: "MB", 10**9: "GB", 10**12: "TB", None: None}
    assert apply(sizes.size_bucket, list(cases), "bigint") == list(cases.values())


def test_percent(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (0, 0), (5, 5)], "a bigint, b bigint")
    assert [r[0] for r in df.select(sizes.percent_text("a", "b", 2)).collect()] == ["33.33", "66.67", None, "100.00"]


def test_times(spark, apply):
    ok = ["2024-01-01T00:00", "2024-01-01T10:20:30", "2024-01-01T10:20:30.5"]
    bad = ["2024-13-01T00:00:00", "2024-01-01 00:00:00", "2024-02-30T00:00:00", "2024-01-01", "", "x"]
    assert all(v is not None for v in apply(times.parse_ts, ok))
    assert apply(times.parse_ts, bad) == [None] * len(bad)
    df = spark.sql("SELECT timestamp_ntz'2024-03-11 00:00:01' AS b, timestamp_ntz'2024-03-10 00:00:00' AS a")
    row = df.select(
        times.delta_days("b", "a").alias("d"), times.drift_seconds("b", "a").alias("s"), times.format_iso("b").alias("t")
    ).first()
    assert (str(row.d), row.s, row.t) == ("1.000012", 86401, "2024-03-11T00:00:01")


def test_times_ignore_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Chicago")
    try:
        # 02:30 does not exist there on that day
        df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00' AS b, timestamp_ntz'2024-03-10 01:30:00' AS a")
        assert df.select(times.drift_seconds("b", "a")).first()[0] == 3600
        assert df.select(times.format_ts("b")).first()[0] == "2024-03-10 02:30:00"
        assert str(df.select(times.whole_seconds("b")).first()[0]) == "2024-03-10 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_validity(apply):
    good = "0123456789abcdef0123456789abcdef01234567"
    values = [good, good.upper(), good[:39], good + "0", None]
    assert apply(validity.hash_valid, values) == [True, True, False, False, False]
    assert apply(lambda c: validity.hash_valid(c, lower_only=True), values) == [True, False, False, False, False]
    numbers = {"+5": True, "-5": True, " 5 ": False, "9223372036854775808": False, "": False, "5.0": False, None: False,
               "9223372036854775807": True}
    assert apply(validity.size_valid, list(numbers)) == list(numbers.values())


def test_hex_bucket_keeps_order(spark, apply):
    values = ["", "!", "0", "00", "000/", "0000", "0000a", "0000zz", "00A0", "00a0", "00g", "9", "9:", "A", "a", "ab",
              "ab!", "ab0", "abé", "f", "ffff", "fffff", "g", "zz", "é"]
    assert values == sorted(values, key=lambda v: v.encode())
    buckets = apply(hex_bucket, values)
    assert buckets == sorted(buckets, key=lambda v: v.encode())
