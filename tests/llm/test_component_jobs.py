"""Connected components settle in few jobs, with and without nodes whose links are dealt out."""

import random

import pytest

from tallyforge.llm import common


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("gathered", [8192, 16])
def test_classes_of_paths_stars_and_random_links(spark, monkeypatch, gathered):
    monkeypatch.setattr(common, "GATHERED", gathered)
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(99, 100 + i) for i in range(200)] + [(700, 400 + i) for i in range(200)]
    edges += [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(190)] + [(450, 1001), (5, 5)]
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = brute([e for e in edges if e[0] != e[1]])
    assert got == want


def test_few_jobs(spark):
    """The driver keeps something of every job and plan: on a path of 40 nodes and a star of 200, the rounds before took 102 jobs."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(99, 100 + i) for i in range(200)], "a bigint, b bigint")
    sc = spark.sparkContext
    sc.setJobGroup("few-jobs", "components")
    try:
        common.components(edges)
        jobs = len(sc.statusTracker().getJobIdsForGroup("few-jobs"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    print("jobs", jobs)
    assert 0 < jobs <= 60
