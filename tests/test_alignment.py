"""Alignment scores against a plain dynamic programme, and differences of versions."""

import random

import pytest
from pyspark.sql import functions as F

from ostraka.functions import diffs
from ostraka.operators import alignment as al


#: Pairs of signs and their scores.
PAIRS = [
    ("ABZ001", "ABZ001", 16),
    ("ABZ001", "ABZ002", -5),
    ("ABZ545", "ABZ597", 7),
    ("#", "#", 6),
    ("#", "ABZ002", -10),
    ("X", "X", 3),
    ("ABZ001", "X", -3),
    ("ABZ001/ABZ545/ABZ002", "ABZ003/ABZ545/ABZ001", 16),
    ("ABZ545/ABZ002", "ABZ003/ABZ597", 7),
    ("ABZ001/ABZ002", "ABZ003/ABZ004", -5),
]


@pytest.mark.parametrize("a,b,score", PAIRS)
def test_two_signs(a, b, score):
    assert al.pair_score(a, b) == al.pair_score(b, a) == score


def plain(a, b):
    """Every path of pairs and gaps by states, ends free."""
    low = -(10**9)
    cost = lambda s: al.GAP_EXTENSION_BREAK if s == "#" else al.GAP_EXTENSION
    m = [[0 if not i or not j else low for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    down, across = [[low] * (len(b) + 1) for _ in m], [[low] * (len(b) + 1) for _ in m]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            m[i][j] = max(m[i - 1][j - 1], down[i - 1][j - 1], across[i - 1][j - 1]) + al.pair_score(a[i - 1], b[j - 1])
            down[i][j] = max(max(m[i - 1][j], across[i - 1][j]) + al.GAP_START, down[i - 1][j] + cost(a[i - 1]))
            across[i][j] = max(max(m[i][j - 1], down[i][j - 1]) + al.GAP_START, across[i][j - 1] + cost(b[j - 1]))
            if i == len(a) or j == len(b):
                best = max(best, m[i][j], down[i][j], across[i][j])
    return best


def test_scores_against_a_plain_programme():
    rng = random.Random(7)
    signs = ["KU", "BA", "#", "X", "ABZ545", "ABZ354", "KU/BA", "ŠU"]
    make = lambda n: [rng.choice(signs) for _ in range(n)]
    for _ in range(150):
        fragments, other = [make(rng.randint(1, 12)) for _ in range(4)], make(rng.randint(1, 14))
        assert list(al.align_all(al.Fragments(fragments), other)) == [plain(f, other) for f in fragments]
    assert list(al.align_all(al.Fragments([["KU"]]), ["KU"])) == [16] and list(al.align_all(al.Fragments([["KU"]]), ["BA"])) == [0]


def test_align(spark):
    fragments = spark.createDataFrame([(1, "KU BA X\nŠU KU"), (2, "X X\nX"), (3, None), (4, "\n" * 20 + "KU"), (5, "BA"), (5, "BA")], "id int, signs string")
    manuscripts = spark.createDataFrame([("a", 0, "KU BA\nŠU KU"), ("b", 0, None), ("c", 1, ""), (None, 2, "BA")], "score string, n int, signs string").withColumnRenamed("score", "m")
    found = sorted(map(tuple, al.align(fragments, manuscripts, "id", ["m", "n"], min_score=16).collect()), key=str)
    assert found == sorted([(1, "a", 0, 70), (1, None, 2, 16), (5, "a", 0, 16), (5, "a", 0, 16), (5, None, 2, 16), (5, None, 2, 16)], key=str)
    assert al.align(fragments.limit(0), manuscripts, "id", ["m"]).count() == 0
    for size in (1, 3, 10**6):
        again = al.align(fragments, manuscripts, "id", ["m", "n"], min_score=16, block=size, part=size)
        assert sorted(map(tuple, again.collect()), key=str) == found


def cost(a, b, pairs):
    """What an alignment is worth: each pair, each gap's first sign and its further ones."""
    total, last = 0, "pair"
    for i, j in pairs:
        if i >= 0 and j >= 0:
            total, last = total + al.pair_score(a[i], b[j]), "pair"
        else:
            sign, kind = (a[i], "down") if i >= 0 else (b[j], "side")
            extension = al.GAP_EXTENSION_BREAK if sign == "#" else al.GAP_EXTENSION
            total, last = total + (extension if last == kind else al.GAP_START), kind
    return total


def test_traces_are_worth_their_scores():
    rng = random.Random(5)
    signs = ["KU", "BA", "#", "X", "ABZ545", "ABZ354", "KU/BA", "ŠU"]
    for _ in range(300):
        a, b = ([rng.choice(signs) for _ in range(rng.randint(0, n))] for n in (25, 30))
        score, pairs = al.trace(a, b)
        assert score == (plain(a, b) if a and b else 0) and cost(a, b, pairs) == score
        left, right = [i for i, _ in pairs if i >= 0], [j for _, j in pairs if j >= 0]
        if pairs:
            # nothing is left out within, and only ends that cost nothing without
            assert left == list(range(left[0], left[-1] + 1)) and right == list(range(right[0], right[-1] + 1))
            assert (left[0] == 0 or right[0] == 0) and (left[-1] == len(a) - 1 or right[-1] == len(b) - 1)


def test_percentages_and_rows(spark):
    assert al.trace(["KU"], ["KU"]) == (16, [(0, 0)]) and al.trace(["KU"], ["BA"]) == (0, [])
    assert al.preserved(["KU", "ABZ545", "BA"], ["KU", "ABZ354", "ŠU"], [(0, 0), (1, 1), (2, 2), (-1, 1)]) == (33.33, 66.67) and al.preserved([], [], []) == (0.0, 0.0)
    fragments = spark.createDataFrame([(1, "KU BA X\nŠU KU", "a note")], "id int, signs string, notes string")
    manuscripts = spark.createDataFrame([("a", "TA KU BA\nŠU ŠU KU")], "m string, signs string")
    (r,) = al.align(fragments, manuscripts, "id", ["m"], min_score=10, traced=True, also=["notes"]).collect()
    assert (r.fragment, r.notes, r.m, r.score, r.identity, r.similarity) == (1, "a note", "a", 65, 100.0, 100.0)
    assert [(c.fragment_sign, c.manuscript_sign) for c in r.alignment] in ([("KU", "KU"), ("BA", "BA"), ("#", "#"), ("ŠU", "ŠU"), (None, "ŠU"), ("KU", "KU")], [("KU", "KU"), ("BA", "BA"), ("#", "#"), (None, "ŠU"), ("ŠU", "ŠU"), ("KU", "KU")])


def test_sequences_of_signs(spark):
    rows = [("X X ABZ001\nABZ002\nX X X\n", ["ABZ001", "#", "ABZ002", "#", "#"]), ("KU X BA\nŠU", ["KU", "BA", "#", "ŠU"]), ("X/KU", ["/KU"]), ("X X\nX", ["#"]), ("n", ["n"]), ("", []), (None, None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "s string")
    found = df.select("s", al.sequence(F.col("s")), al.has_clear_signs(F.col("s"))).collect()
    assert [(r[0], r[1]) for r in found] == rows and [r[2] for r in found] == [True, True, True, False, True, False, False]


def test_differences(spark):
    rows = [(["a", "b", "c"], ["a", "x", "c", "d"]), (["a", "b"], []), ([], ["a"]), (None, ["a"]), (["kur", "ra"], ["|", "kur"])]
    df = spark.createDataFrame(rows, "o array<string>, n array<string>")
    found = [r[0] for r in df.select(diffs.token_map(F.col("o"), F.col("n"), F.transform("n", lambda t: t != "|"))).collect()]
    assert found == [[0, 1, 2], [None, None], [], None, [1, None]]
    likeness = spark.createDataFrame([("abcd", "bcde"), ("a", "a"), ("", "a"), (None, "a"), ("a", "b")], "a string, b string")
    assert [r[0] for r in likeness.select(diffs.ratio(F.col("a"), F.col("b"))).collect()] == [0.75, 1.0, None, None, 0.0]


def test_merge_keeps_annotations(spark):
    kind = "array<struct<line:string,note:string>>"
    df = spark.createDataFrame([([("1. ku", "x"), ("2. ba", "y"), ("3. ra", "z")], [("1. ku", None), ("2. bu", None), ("3. ra", None), ("4. ši", None)]), (None, [])], f"o {kind}, n {kind}")
    key = lambda e: e["line"]
    found = [r[0] for r in df.select(diffs.merged(F.col("o"), F.col("n"), key)).collect()]
    assert [tuple(e) for e in found[0]] == [("1. ku", "x"), ("2. bu", None), ("3. ra", "z"), ("4. ši", None)] and found[1] is None
    kept = df.select(diffs.merged(F.col("o"), F.col("n"), key, lambda a, b: F.struct(b["line"].alias("line"), a["note"].alias("note")))).first()[0]
    assert [e["note"] for e in kept] == ["x", "y", "z", None]


def test_differences_hold_one_row_at_a_time(spark, monkeypatch):
    # a whole batch of rows as Python objects took gigabytes: only one may be alive when the next is compared
    import pyarrow as pa

    from ostraka.functions import diffs

    alive = []
    monkeypatch.setattr(diffs, "_changes", lambda a, b: alive.append(len(a)) or [(0, 0, " ")])
    column = pa.array([["a"], None, ["b"]])
    found = diffs._row_by_row(diffs._places, pa.list_(pa.int32()), column, column, pa.array([[True]] * 3))
    assert found.to_pylist() == [[0], None, [0]] and alive == [1, 1]


def test_fragments_that_cannot_reach_the_least_score_are_left_out():
    from ostraka.operators import alignment

    texts = [["a", "b", "c"], ["q", "r"], [], ["a", "#", "c"]]
    prepared, other = alignment.Fragments(texts), ["a", "b", "c", "#", "d"]
    whole = alignment.align_all(prepared, other).tolist()
    assert whole[0] == 48 and alignment.align_all(prepared, other, 40).tolist() == [48, 0, 0, 0]
    assert all(b >= s for b, s in zip(prepared.bounds(prepared.table(other)).tolist(), whole))


def test_report_tells_where_alignments_begin_and_end_and_leaves_no_passage_out(spark, tmp_path):
    from ostraka.plans import versions

    long = "\n".join(["a b"] * 12 + ["kur ra ši"])
    spark.createDataFrame([(1, "x y kur ra ši z"), (2, long)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(7, 0, "user", "kur ra ši")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.fragment: r for r in versions.align_report(spark, str(tmp_path)).collect()}
    assert {k: (r.score, r.begins, r.ends, r.columns) for k, r in found.items()} == {1: (48, 2, 4, 3), 2: (48, 36, 38, 3)}
    assert sorted((r.fragment, r.score) for r in versions.align_scores(spark, str(tmp_path)).collect()) == [(1, 48), (2, 48)]
    assert al.align(spark.createDataFrame([(2, long)], "i int, signs string"), spark.createDataFrame([(1, "kur ra ši")], "m int, signs string"), "i", ["m"], min_score=16).count() == 0


def test_short_and_long_sequences_score_the_same(monkeypatch):
    rng = random.Random(9)
    signs = ["KU", "BA", "#", "X", "ABZ545", "ABZ354", "KU/BA", "ŠU"]
    make = lambda n: [rng.choice(signs) for _ in range(n)]
    cases = [([make(rng.randint(0, 40)) for _ in range(6)], make(rng.randint(1, 60))) for _ in range(80)]
    cases += [([["KU"] * n, make(n), ["#"] * n], ["KU"] * m) for n, m in ((300, 700), (380, 380), (400, 900), (700, 640))]
    cases += [([["#"] * 600, make(500)], ["#"] * 1000)]
    short = [al.align_all(al.Fragments(f), o).tolist() for f, o in cases]
    monkeypatch.setattr(al, "_NEVER_SHORT", 0)  # all in 32 bits
    assert short == [al.align_all(al.Fragments(f), o).tolist() for f, o in cases]
    assert short[-5][0] == 300 * 16
