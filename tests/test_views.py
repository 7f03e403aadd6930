"""Reports written as SQL text over the registered views."""

from copyledger.plans import reports
from copyledger.registry import tables
from copyledger.views import register_views


def test_sql_reports(spark, sf):
    cat, bp, mc = tables.catalog(spark, sf), tables.base_paths(spark), tables.categories(spark)
    register_views(spark, cat, bp, mc)
    counts = spark.sql(
        """SELECT mime_type, count(*) FILTER (WHERE disposition = 'primary') AS p,
                  count(*) FILTER (WHERE disposition = 'redundant') AS r FROM files GROUP BY mime_type"""
    )
    direct = reports.mime_duplication_summary(cat, bp)
    assert {tuple(r) for r in counts.collect()} == {
        (r.mime_type, r.primary_count, r.redundant_count) for r in direct.collect()
    }
    total = spark.sql("SELECT sum(length) FROM images_primary").first()[0]
    assert total == spark.sql(
        "SELECT sum(file_size) FROM files WHERE category = 'image' AND disposition = 'primary'"
    ).first()[0]
    assert spark.sql("SELECT * FROM vault_timestamp_drift WHERE drift_seconds <= 0").count() == 0
    assert spark.sql("SELECT max(group_num) = count(*) FROM (SELECT DISTINCT hash, mime_type, group_num FROM files)").first()[0]


def test_sql_functions(spark):
    from copyledger.functions.sql_functions import register_functions

    register_functions(spark)
    cases = {"a/b.TXT": ("b.TXT", "txt"), "a/.bashrc": (".bashrc", None), ".tar.gz": (".tar.gz", "gz"), "foo.": ("foo.", ""),
             "a/b/": ("b", None), ".": (".", None), "..": ("..", ""), "": ("", None), None: (None, None)}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    df.createOrReplaceTempView("some_paths")
    rows = spark.sql("SELECT p, file_name_from_path(p) AS n, file_ext_from_path(p) AS e FROM some_paths").collect()
    assert {r.p: (r.n, r.e) for r in rows} == cases
