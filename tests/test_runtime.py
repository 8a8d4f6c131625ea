"""Cuts of lineage in the shared folder."""

import os

from archivolt import runtime


def test_cuts_are_tables_in_the_checkpoint_folder(spark):
    df = spark.createDataFrame([(1, b"k", ["a"]), (2, None, None)], "i int, k binary, a array<string>").selectExpr("i + 1 as i", "k", "a")
    back = runtime.cut(df)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(back.collect()) == sorted(df.collect())
    folder = os.path.dirname(back.inputFiles()[0].removeprefix("file://").removeprefix("file:"))
    assert runtime.ensure_checkpoint_dir(spark).removeprefix("file:") in folder and runtime.CUTS in folder
    assert runtime.cut(df.where("false")).count() == 0
    runtime.release_cuts(spark)
    assert not os.path.exists(folder)
