from roadpulse.llm.common import BATCH_ROWS, fresh, prepare
from roadpulse.session import configure


def test_settings_do_not_stay(spark):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"]
    configure(spark)
    before = [spark.conf.get(n) for n in names]
    prepare(prepare(spark))
    assert [spark.conf.get(n) for n in names] == [str(BATCH_ROWS), "true"]
    configure(spark)
    assert [spark.conf.get(n) for n in names] == before
    prepare(spark)


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "rate int, Rate_ int")
    assert fresh(df, "rate") == "rate__" and fresh(df, "other") == "other"
