"""Components of links against a plain search, and how many links they go by."""

import random

import pytest

from hubflow.llm.components import components, narrowed


def by_search(links):
    next_to = {}
    for a, b in links:
        if a != b:
            next_to.setdefault(a, set()).add(b)
            next_to.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(next_to):
        queue = [] if start in out else [start]
        while queue:
            x = queue.pop()
            if x not in out:
                out[x] = start
                queue += next_to[x]
    return out


@pytest.mark.parametrize("seed", range(2))
def test_narrowed_links_connect_the_same(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(7, 7), (500, 501), (501, 500)]
    df = spark.createDataFrame(links, "a long, b long")
    short = [(r.a, r.b) for r in narrowed(df).collect()]
    assert by_search(short) == by_search(links) and all(a < b for a, b in short) and len(short) == len(set(short))
    assert {r.node: r.component for r in components(df).collect()} == by_search(links)


def test_one_group_in_many_buckets_is_one_star(spark):
    """A group of 2,000 copies that 24 buckets connect, each from a first of its own: the links of one of them are enough."""
    links = [(k, y) for k in range(24) for y in range(k + 1, 2000)]
    short = narrowed(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(short) < 2 * 2000 and by_search([(r.a, r.b) for r in short]) == dict.fromkeys(range(2000), 0)
