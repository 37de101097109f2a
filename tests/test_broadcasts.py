"""What an explode makes is not broadcast, however small Spark sizes it."""

import random
import re

from landloom.llm import shared, simhash
from landloom.operators import search


def _plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_meet_by_shuffle(spark):
    rng = random.Random(1)
    nodes = shared.materialise(spark.createDataFrame([(rng.getrandbits(63),) for _ in range(500)], "fp long"), "fps")
    assert not re.search(r"BroadcastHashJoin \[tab#\d+, segment#\d+L, rest", _plan(simhash.links(nodes)))


def test_broadcasts_are_bounded_by_less_than_the_default(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    try:
        for given, then in (("10MB", str(shared.BROADCAST_BYTES)), ("-1", "-1"), ("1000", "1000")):
            spark.conf.set(name, given)
            shared.small_broadcasts(spark)
            assert spark.conf.get(name) == then
    finally:
        spark.conf.set(name, before)


def test_search_never_broadcasts_titles(spark):
    entities = shared.materialise(spark.createDataFrame([("record", i, f"quy hoach khu {i}", 1) for i in range(5000)], "kind string, id long, title string, place int"), "entities")
    asked = spark.createDataFrame([("khu 299",), ("hoach",)], "q string").join(spark.range(3).withColumnRenamed("id", "n"))
    found = search.search(asked.select("q"), entities, 3)
    plan = _plan(found)
    assert "BroadcastHashJoin [gram" in plan and "BuildLeft" not in plan
    assert sorted((r.q, r.id) for r in found.collect()) == [("hoach", 0), ("hoach", 1), ("hoach", 2), ("khu 299", 299), ("khu 299", 2990), ("khu 299", 2991)]
