"""Connected components against a plain search."""

import os
import random

import pytest

from tidemark.llm.common import shared_dir
from tidemark.llm.components import components


def plain(links):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for least in sorted(near):
        todo = [least] if least not in out else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = least
                todo += near[x]
    return out


CASES = {
    "none": [],
    "itself": [(5, 5)],
    "stars": [(3, 1), (4, 1), (9, 7)],
    "chain": [(i, i + 1) for i in range(40)],
    "hub above": [(i, 100) for i in range(30)] + [(100, 7), (7, 100)],
    "two lows": [(9, 1), (9, 2)],
    "below and above": [(9, 4), (4, 1)],
    "random": [(random.Random(i).randrange(60), random.Random(-i - 1).randrange(60)) for i in range(45)],
}


@pytest.mark.parametrize("case", CASES)
def test_components(spark, case):
    links = [(a, b) for a, b in CASES[case] if a != b]
    folder = f"{shared_dir(spark).removeprefix('file:')}/tidemark"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = components(spark.createDataFrame(CASES[case], "a long, b long"))
    assert sorted((r["id"], r["component"]) for r in got.collect()) == sorted(plain(links).items())
    assert len(set(os.listdir(folder)) - before) == 1  # the result alone is left of its tables
