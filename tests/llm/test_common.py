import os

from plenum.llm.common import scratch, shared_dir, written


def test_scratch_removes_its_tables_and_no_others(spark, tmp_path):
    before = written(spark.range(3), "before")
    with scratch(spark):
        within = written(spark.range(5), "within")
        with scratch(spark):
            inner = written(spark.range(2), "inner")
        lasting = f"{shared_dir(spark, lasting=True)}/kept"
        spark.range(1).write.parquet(lasting)
        within.write.parquet(str(tmp_path / "out"))
    gone = [df._jdf.inputFiles()[0] for df in (within, inner)]
    assert not any(os.path.exists(f.removeprefix("file://")) for f in gone)
    assert before.count() == 3 and os.path.exists(lasting)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_scratch_removes_its_tables_after_an_error(spark):
    made = []
    try:
        with scratch(spark):
            made.append(shared_dir(spark))
            spark.range(1).write.parquet(made[0])
            raise KeyError
    except KeyError:
        pass
    assert not os.path.exists(made[0])
