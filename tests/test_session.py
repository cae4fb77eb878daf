import os

from lodestone.session import discard, materialise, scratch, scratch_path, shared_dir


def place(df):
    return df._scratch.removeprefix("file://").removeprefix("file:")


def test_materialised_tables_read_back_and_go(spark):
    with scratch(spark):
        df = materialise(spark.range(10).selectExpr("id", "cast(null as string) as x"), "t")
        assert df.count() == 10 and df.columns == ["id", "x"] and os.path.isdir(place(df))
        early = materialise(spark.range(3), "u")
        discard(early)
        assert not os.path.exists(place(early))
    assert not os.path.exists(place(df))


def test_scratch_paths_are_in_the_shared_folder(spark):
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(shared_dir(spark))
