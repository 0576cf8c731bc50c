"""Few edges go round in one task, with what many shuffled ones give."""

import random

from forecastlab.llm.components import components


def tasks_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    return found, sum(s.numCompletedTasks for s in stages if s)


def test_few_edges_are_not_shuffled_in_every_round(spark):
    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001 + i) for i in range(200)] + [(rng.randrange(5000, 6000), rng.randrange(5000, 6000)) for _ in range(600)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        few, tasks = tasks_of(spark, "few edges", lambda: sorted(map(tuple, components(df).collect())))
        many, more = tasks_of(spark, "many edges", lambda: sorted(map(tuple, components(df, one_task=0).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert few == many and len(few) == len({x for e in edges for x in e if e[0] != e[1]})
    assert tasks < 32 * 6 < more  # two tables by 32 tasks, then a few tasks a round
