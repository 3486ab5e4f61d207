"""The walk to the nearest linked ancestor against a plain walk, and how much of it is written."""

import random
from collections import Counter

import pytest

from recordloom.operators import arrays


def frames(spark, ids, parents, linked):
    return spark.createDataFrame([(x,) for x in ids], "id string"), spark.createDataFrame(parents, "child_id string, parent_id string"), spark.createDataFrame([(x,) for x in linked], "id string")


def walked(ids, parents, linked, depth):
    """Every way up, each as often as it is given."""
    links, out, ways = Counter(linked), Counter(), [(x, x) for x in ids]
    for _ in range(depth + 1):
        for child, at in ways:
            out[child, at] += links[at]
        ways = [(child, up) for child, at in ways if not links[at] for c, up in parents if c == at and at is not None]
    return +out


@pytest.mark.parametrize("depth", [0, 1, 3, 16])
def test_walk_equals_a_plain_walk(spark, depth):
    rng = random.Random(depth)
    tree = [(f"n{i}", f"n{rng.randrange(i)}") for i in range(1, 60)]
    parents = [*tree, ("n7", "n50"), ("n7", "n8"), ("x", "y"), ("y", "x"), ("s", "s"), ("z", None), (None, "n1"), ("far0", "n59"), *((f"far{i}", f"far{i - 1}") for i in range(1, 20))]
    linked = ["n3", "n3", "n10", "n20", "n41", "far2", "alone", None]
    ids = [*(f"n{i}" for i in range(60)), "n9", "n9", "x", "s", "z", None, "unknown", "alone", *(f"far{i}" for i in range(20))]
    got = Counter((r["child_id"], r["root_id"]) for r in arrays.walk_up(*frames(spark, ids, parents, linked), depth=depth).collect())
    assert got == walked(ids, parents, [x for x in linked if x is not None], depth)


def test_walk_of_nothing(spark):
    assert arrays.walk_up(*frames(spark, [], [], [])).count() == 0


def test_children_are_written_once_whatever_their_depth(spark, monkeypatch):
    """Before, each round wrote all children on their way, and read all parents and links anew."""
    rows = []
    write = arrays.materialise
    monkeypatch.setattr(arrays, "materialise", lambda df, tag: (out := write(df, tag), rows.append(out.count()))[0])
    parents = [*((f"leaf{i}", f"a{i % 5}") for i in range(200)), *((f"a{i}", "b0") for i in range(5)), *((f"b{i}", f"b{i + 1}") for i in range(5))]
    got = arrays.walk_up(*frames(spark, [f"leaf{i}" for i in range(200)], parents, ["b5"])).collect()
    assert {r["root_id"] for r in got} == {"b5"} and len(got) == 200
    assert rows[0] == 200 + 5 + 6 and sum(rows[1:]) <= 7 * 11
