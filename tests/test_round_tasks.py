"""Star rounds take as many tasks as their edges ask for, not as many as the session deals rows to."""

from lintel.plans import components


def test_few_edges_stay_in_few_files(spark):
    settings = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200)]
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = components.connected_components(spark.createDataFrame(chain, "left_id long, right_id long"))
        assert found.rdd.getNumPartitions() <= 2 * components.LEAST_TASKS
        assert sorted(map(tuple, found.collect())) == [(i, 0) for i in range(41)] + [(100, 100), (101, 100)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_tasks_grow_with_the_edges():
    assert components._tasks(0) == components.LEAST_TASKS
    assert components._tasks(100 * components.TASK_EDGES) == 100
