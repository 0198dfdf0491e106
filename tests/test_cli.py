from eventlantern import cli


def test_long_results_are_printed_whole(spark):
    assert cli.plain(spark.range(1500)) == [{"id": k} for k in range(1500)]
