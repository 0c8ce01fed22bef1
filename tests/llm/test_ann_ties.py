"""Ties of nearest neighbours go to the smaller ids however many rows are alike."""

import random

from ostraka.llm import ann


def test_many_copies(spark):
    rng = random.Random(3)
    order = list(range(3000))
    rng.shuffle(order)
    copies = [float(x) for x in range(1, 9)]
    data = [(i, copies if i % 2 == 0 else [rng.gauss(50, 1) for _ in range(8)]) for i in order]
    found = ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>").coalesce(1), every=1000, books=4, words=16).collect()
    own = {q: [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] for q in (0, 1000, 2000)}
    assert own[0] == list(range(2, 22, 2)) and own[1000] == own[2000] == list(range(0, 20, 2))
