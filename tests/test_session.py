from dueline.session import prepare


def test_tasks_get_few_bytes_unless_the_session_says_otherwise(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = [spark.conf.get(n) for n in names]
    try:
        for n in names:
            spark.conf.unset(n)
        assert [prepare(spark).conf.get(n) for n in names] == ["16m", "16m"]
        spark.conf.set(names[0], "4m")
        assert [prepare(spark).conf.get(n) for n in names] == ["4m", "16m"]
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
