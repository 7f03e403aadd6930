"""Records whose quoted fields hold line breaks, read in splits."""

import random

import pytest

from copyledger.sources import manifest_io


@pytest.fixture
def small_splits(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    before = {n: spark.conf.get(n, None) for n in names}
    for name, value in zip(names, ["400", "1", "1"]):
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        if value is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, value)


def written(rng, n):
    """Records as text: plain, quoted, with line breaks, doubled quotes, long runs of lines."""
    out = []
    for i in range(n):
        kind = rng.randrange(6)
        breaks = {0: 0, 1: 0, 2: 0, 3: 1, 4: 3, 5: rng.choice([0, 60])}[kind]
        inner = "".join(rng.choice(["x", "y\t", '""']) + "\n" * (j < breaks) for j in range(breaks + 1))
        out.append(f"{i}\tplain" if kind < 2 else f'{i}\t"{inner}"\tend')
    return out


@pytest.mark.parametrize("seed", range(4))
def test_records_whatever_the_splits(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    expected = []
    for i in range(3):
        records = written(rng, 200)
        (tmp_path / f"{i}.meta").write_text("\n".join(records) + "\n" * (i % 2))
        expected += records
    read = manifest_io.read_records(spark, str(tmp_path))
    assert sorted(r.value for r in read.collect()) == sorted(expected)
    files = spark.read.text(str(tmp_path), lineSep="\n").select("_metadata.file_path", "_metadata.file_block_start")
    assert files.distinct().count() > 30


def test_broken_records_are_not_gathered(spark, tmp_path, small_splits):
    lines = [f"{i}\tplain" for i in range(300)]
    (tmp_path / "open.meta").write_text("\n".join([*lines[:100], 'open\t"never closed', *lines[100:]]))
    (tmp_path / "long.meta").write_text("\n".join(['a\t"', "x" * 900, '"', 'b\t"', '"\r', "c"]))
    (tmp_path / "empty.meta").write_text("")
    read = manifest_io.read_records(spark, str(tmp_path), 800).collect()
    of = lambda name: sorted((r.value for r in read if r.source.endswith(name)), key=str)
    assert of("open.meta") == sorted([*lines[:100], None], key=str)
    assert of("long.meta") == sorted([None, 'b\t"\n"', "c"], key=str)
    assert of("empty.meta") == []


