from loomwright.session import sized_broadcast


def hinted(df):
    return "Broadcast" in df.sparkSession.range(3).join(df, "id")._jdf.queryExecution().optimizedPlan().toString() or "broadcast" in df._jdf.queryExecution().logical().toString().lower()


def test_broadcast_only_what_is_small(spark):
    df = spark.createDataFrame([(i, "x" * 100, None) for i in range(20)], "id bigint, s string, n int")
    assert hinted(sized_broadcast(df))
    assert not hinted(sized_broadcast(df, rows=19))
    assert not hinted(sized_broadcast(df, chars=1_000))
    assert hinted(sized_broadcast(df.limit(0)))
