from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from scoremon.sources import extracts
from scoremon.sources import tables as tb


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def failing(spark, n=40):
    """A frame whose last partition fails, after others have written their files."""
    bad = F.when(F.col("id") == n - 1, F.raise_error(F.lit("killed"))).otherwise(F.col("id"))
    return spark.range(0, n, 1, 8).select(bad.cast("long").alias("id"))


# -- replacement -------------------------------------------------------------


def test_folder_is_replaced_by_rows_of_its_old_version(spark, tmp_path):
    path = f"{tmp_path}/t"
    tb.write_folder(spark.range(5), path)
    tb.write_folder(tb.read_folder(spark, path).withColumn("id", F.col("id") + 100), path)
    assert rows(tb.read_folder(spark, path)) == [(100 + i,) for i in range(5)]
    assert sorted(os.listdir(tmp_path)) == ["t"]


@pytest.mark.parametrize("write", [tb.write_folder, tb.write_extract, lambda df, p: tb.write_partitioned(df, p, "k")])
def test_a_write_that_dies_half_way_leaves_the_old_version(spark, tmp_path, write):
    path = f"{tmp_path}/t"
    df = spark.range(5).withColumn("k", F.lit(1))
    write(df, path)
    before = sorted(os.listdir(path))
    with pytest.raises(Exception, match="killed"):
        write(failing(spark).withColumn("k", F.lit(2)), path)
    assert sorted(os.listdir(path)) == before and sorted(os.listdir(tmp_path)) == ["t"]


def test_a_swap_that_fails_is_undone(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    tb.write_folder(spark.range(3), path)
    move, calls = tb._move, []

    def second_fails(fs, source, target):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("no rename")
        move(fs, source, target)

    monkeypatch.setattr(tb, "_move", second_fails)
    with pytest.raises(OSError, match="no rename"):
        tb.write_folder(spark.range(9), path)
    assert rows(tb.read_folder(spark, path)) == [(0,), (1,), (2,)] and len(calls) == 3


def test_a_driver_that_dies_between_the_renames_is_recovered_from(spark, tmp_path):
    path = f"{tmp_path}/t"
    tb.write_folder(spark.range(3), path)
    os.rename(path, tb._beside(path, "previous"))
    assert tb.read_folder(spark, path).count() == 3
    # The new version stands already: what is left of the old one goes.
    spark.range(7).write.parquet(tb._beside(path, "previous"))
    assert tb.read_folder(spark, path).count() == 3 and sorted(os.listdir(tmp_path)) == ["t"]


def test_a_folder_without_commit_marker_does_not_count(spark, tmp_path):
    path = f"{tmp_path}/t"
    tb.write_folder(spark.range(3), path)

    def unmarked(staged):
        spark.range(9).write.parquet(staged)
        os.remove(f"{staged}/_SUCCESS")

    with pytest.raises(OSError, match="commit marker"):
        tb.replace_folder(spark, path, unmarked)
    assert tb.read_folder(spark, path).count() == 3


def test_table_is_replaced_from_itself(spark, tmp_path):
    name = f"self_{os.path.basename(tmp_path)}".replace("-", "_")
    root = f"{tmp_path}/v"
    tb.save_table(spark.range(4), name, root)
    tb.save_table(spark.table(name).withColumn("id", F.col("id") * 10), name, root)
    assert rows(spark.table(name)) == [(0,), (10,), (20,), (30,)]
    # Other columns and partitions: names are swapped.
    tb.save_table(spark.table(name).withColumn("codmes", F.lit(202401)), name, root, by="codmes")
    tb.save_table(spark.table(name).withColumn("codmes", F.lit(202402)), name, root, by="codmes")
    assert rows(spark.table(name).select("codmes").distinct()) == [(202402,)]
    assert len(os.listdir(root)) == 1
    assert [t.name for t in spark.catalog.listTables() if "__" in t.name and t.name.startswith(name)] == []
    spark.sql(f"DROP TABLE {name}")


def test_table_survives_a_failed_write(spark, tmp_path):
    name = f"fails_{os.path.basename(tmp_path)}".replace("-", "_")
    tb.save_table(spark.range(4), name, f"{tmp_path}/v")
    with pytest.raises(Exception, match="killed"):
        tb.save_table(failing(spark), name, f"{tmp_path}/v")
    assert spark.table(name).count() == 4 and len(os.listdir(f"{tmp_path}/v")) == 1
    spark.sql(f"DROP TABLE {name}")


# -- inference ---------------------------------------------------------------

LINES = """a;b;c;d;e;f;g;h
1;2;1.5;2024-01-02;2024-01-02 10:00;true;x;
-7;3000000000;2;2024-1-3;2024-01-02T10:00:01;FALSE;;
;5;.5e3;;;;1d;
"""


def extract(spark, tmp_path, text, **more):
    path = tmp_path / "extract"
    path.mkdir()
    (path / "a.csv").write_text(text)
    return extracts.read_inferred(spark, str(path), **more)


def types(x):
    return {r.column: (r.type, r.filled, r.misfits) for r in x.types.collect()}


def test_narrowest_type_of_every_column(spark, tmp_path):
    x = extract(spark, tmp_path, LINES)
    assert types(x) == {
        "a": ("int", 2, 0), "b": ("bigint", 3, 0), "c": ("double", 3, 0), "d": ("date", 2, 0),
        "e": ("timestamp", 2, 0), "f": ("boolean", 2, 0), "g": ("string", 2, 0), "h": ("string", 0, 0),
    }
    assert [f.dataType.simpleString() for f in x.rows.schema] == [
        "int", "bigint", "double", "date", "timestamp", "boolean", "string", "string"
    ]
    assert x.rows.count() == 3 and x.quarantine.count() == 0


def test_odd_values_and_broken_lines_are_set_aside(spark, tmp_path):
    good = "\n".join(f"{i};{i}.5;t{i}" for i in range(60))
    x = extract(spark, tmp_path, f"k;v;s\n{good}\nx1;7.5;s\n8;n/a;s\n9;1.5\n10;1.5;s;more\n", tolerance=0.1)
    assert types(x) == {"k": ("int", 62, 1), "v": ("double", 62, 1), "s": ("string", 62, 0)}
    assert x.rows.count() == 60
    bad = sorted((r.reasons, r.line, r.row.k) for r in x.quarantine.collect())
    assert bad == [
        (["fields"], "10;1.5;s;more", "10"), (["fields"], "9;1.5", "9"), (["k"], None, "x1"), (["v"], None, "8"),
    ]


def test_without_tolerance_one_odd_value_makes_text(spark, tmp_path):
    x = extract(spark, tmp_path, "k;id\n1;007\n2;008\nn/a;009\n", declared={"id": "string"})
    assert types(x) == {"k": ("string", 3, 0), "id": ("string", 3, 0)}
    assert rows(x.rows) == [("1", "007"), ("2", "008"), ("n/a", "009")]


def test_declared_types_send_misfits_to_quarantine(spark, tmp_path):
    x = extract(spark, tmp_path, "k;v\n1;2\nx;3\ny;4\n", declared={"k": "int"})
    assert rows(x.rows) == [(1, 2)] and sorted(r.row.k for r in x.quarantine.collect()) == ["x", "y"]


def test_extract_with_a_header_only(spark, tmp_path):
    x = extract(spark, tmp_path, "k;v\n")
    assert x.rows.columns == ["k", "v"] and x.rows.count() == 0 and x.quarantine.count() == 0
