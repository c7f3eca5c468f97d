"""Sources and sinks."""
import pytest

from twinstage.operators.clean import require_columns, trim_column_names
from twinstage.sources import io


def test_read_folder_differing_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n1,a\n2,b\n")
    (tmp_path / "b.csv").write_text("x,id,extra\nc,3,zz\n")
    df = io.read_folder(spark, str(tmp_path))
    rows = sorted((int(r.id), r.x, r.extra) for r in df.collect())
    assert rows == [(1, "a", None), (2, "b", None), (3, "c", "zz")]
    with pytest.raises(FileNotFoundError):
        io.read_folder(spark, str(tmp_path / "none"))


def test_pair_and_required_columns(spark, tmp_path):
    (tmp_path / "tr.csv").write_text(" id, Label\n1,A\n")
    (tmp_path / "te.csv").write_text(" id, Label\n2,B\n")
    df = trim_column_names(io.read_pair(spark, str(tmp_path / "tr.csv"), str(tmp_path / "te.csv")))
    assert sorted((r.Label, r.split) for r in df.collect()) == [("A", "train"), ("B", "test")]
    with pytest.raises(ValueError):
        require_columns(df, "attack_cat")
    with pytest.raises(FileNotFoundError):
        io.read_pair(spark, str(tmp_path / "nope.csv"), str(tmp_path / "te.csv"))


def test_scores_roundtrip(spark, tmp_path):
    sc = spark.createDataFrame([("d", "m", 0, 1, 0.5)], io.SCORES_SCHEMA)
    io.write_scores(sc, str(tmp_path / "s"))
    assert io.read_scores(spark, str(tmp_path / "s")).collect() == sc.collect()
    io.write_table(sc, str(tmp_path / "csv"), fmt="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1


def test_folder_binds_by_name_for_any_path_and_schema(spark, tmp_path):
    from pyspark.sql import types as T
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text('b,a,"c,d"\n20,10,x\n')
    want = [(1, 2), (10, 20)]
    for folder in (str(tmp_path), f"file://{tmp_path}"):
        df = io.read_folder(spark, folder)
        assert sorted((int(r.a), int(r.b)) for r in df.collect()) == want and "c,d" in df.columns
        schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DoubleType()), T.StructField("z", T.StringType())])
        typed = io.read_folder(spark, folder, schema=schema)
        assert typed.schema == schema and sorted((r.a, int(r.b)) for r in typed.collect()) == want
    with pytest.raises(FileNotFoundError):
        io.read_folder(spark, str(tmp_path), "*.none")


def test_submitted_settings_win():
    """get_spark fills only what nobody set."""
    import os
    import subprocess
    import sys
    code = "from twinstage.session import get_spark; s = get_spark(); print(s.sparkContext.master, s.conf.get('spark.sql.shuffle.partitions'))"
    env = {**os.environ, "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=77 --conf spark.ui.enabled=false pyspark-shell"}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(__file__)), timeout=120)
    assert out.stdout.split()[-2:] == ["local[2]", "77"]
