from roadpulse.session import configure, override, restore


def test_overridden_settings_come_back(spark):
    own, other = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.roadpulse.test"
    before = spark.conf.get(own)
    override(spark, {own: 17, other: "x"})
    override(spark, {own: 18})
    assert spark.conf.get(own) == "18" and spark.conf.get(other) == "x"
    configure(spark)
    assert spark.conf.get(own) == before and spark.conf.get(other, None) is None
    restore(spark)
    assert spark.conf.get(own) == before
