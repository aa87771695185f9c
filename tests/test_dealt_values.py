"""Values are parsed by as many tasks as a shuffle has, however few files hold them."""

from archgraph.operators import match


def test_values_of_one_file_are_parsed_by_many_tasks(spark, tmp_path):
    rows = [("r", i, "n", "PEER_HOST", f"svc-{i}:80", "p", 1) for i in range(100)]
    df = spark.createDataFrame(rows, "repo string, row_id long, from_node string, key string, value string, path string, line int")
    df.coalesce(1).write.parquet(f"{tmp_path}/env")
    hints = match.hints_from_values(spark.read.parquet(f"{tmp_path}/env"))
    assert hints.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) == 8
    assert sorted(r.hint_id for r in hints.collect()) == list(range(100))
