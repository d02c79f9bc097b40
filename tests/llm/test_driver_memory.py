"""What the near-duplicate stage keeps on the driver: its plans."""

import corpus_pipeline
import pytest
from helpers import SF

from siftyard.llm import near_dedup


def plans(spark, work) -> list[int]:
    """Nodes in the plan of each query that work() runs."""
    store = spark._jsparkSession.sharedState().statusStore()

    def told():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.executionsList()
        return [found.apply(i).executionId() for i in range(found.size())]

    last = max(told(), default=-1)
    work()
    return [store.planGraph(x).allNodes().size() for x in told() if x > last]


def test_plans_of_the_near_duplicate_stage_are_short(spark, tmp_path):
    """Every step reads tables, not the plans of the steps before; a round of the components reads its edges four times."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = plans(spark, lambda: corpus_pipeline.near_duplicates(spark, docs, SF).write.parquet(f"file://{tmp_path}/out"))
    assert max(found) <= 150


EDGES = {
    "chain": [(i, i + 1) for i in range(40)],
    "ring, backwards": [(i + 1, i) for i in range(20)] + [(0, 20)],
    "star of the greatest": [(99, i) for i in range(10, 30)],
    "loops and repeats": [(1, 1), (2, 3), (3, 2), (2, 3), (5, 5)],
    "negative": [(-5, 3), (3, 8), (-7, 8), (100, 101)],
    "none": [],
}


@pytest.mark.parametrize("name", EDGES)
def test_components(spark, name):
    got = near_dedup.components(spark.createDataFrame(EDGES[name], "a long, b long")).collect()
    links: dict[int, set[int]] = {}
    for a, b in EDGES[name]:
        if a != b:
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set()).add(a)
    want = {}
    for x in links:
        seen, left = {x}, [x]
        while left:
            new = links[left.pop()] - seen
            seen |= new
            left += new
        want[x] = min(seen)
    assert sorted(tuple(r) for r in got) == sorted(want.items())
