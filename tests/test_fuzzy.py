"""The gram index of fuzzy matching against all pairs."""

import random

import pytest

from stockloom.operators import similarity as S


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def relative(a, b):
    return edit(a, b) / max(len(a), len(b), 1)


@pytest.fixture(scope="module")
def names():
    r = random.Random(4)
    targets = {"".join(r.choice(["ca", "sa", "b", "rri", "ta", "é"]) for _ in range(r.randint(1, 8))) for _ in range(150)} | {"a", "aaaaaaaa", "ábc"}
    values = {"", "zzzzzz", "a", "aaaaaa", "aaaaaaaaaaaa", "b"}
    for t in sorted(targets):
        w = list(t)
        for _ in range(r.randint(0, 5)):
            i = r.randrange(len(w) + 1)
            w[i : i + r.randint(0, 1)] = r.choice(["", "x", "a", "c"])
        values.add("".join(w))
    return sorted(values), sorted(targets)


@pytest.mark.parametrize(("q", "most"), S.STEPS)
def test_the_index_finds_every_name_within_its_distance(spark, names, q, most):
    values, targets = names
    a, b = spark.createDataFrame([(v,) for v in values], "v string"), spark.createDataFrame([(t,) for t in targets], "t string")
    got = {r.v: tuple(r.b) for r in S.near_names(a, b, "v", "t", q, most).collect()}
    for v in values:
        best = min((relative(v, t), t) for t in targets)
        owes = -(-len(v) * (1 - q * most) // 1) - q + 1 > 0
        if best[0] <= most and owes and -(-len(best[1]) * (1 - q * most) // 1) - q + 1 > 0:
            assert got[v] == best, v
        elif v in got:
            assert got[v][0] <= most and got[v][0] == relative(v, got[v][1])


def test_the_best_target_is_that_of_all_pairs(spark, names):
    values, targets = names
    rows = [(v,) for v in values] + [(None,), (values[3],)]
    got = S.fuzzy_category_match(spark.createDataFrame(rows, "v string"), spark.createDataFrame([*((t,) for t in targets), (None,)], "t string"), "v", "t", chunk=40)
    out = {r.v: (r.suggested, r.score, r.use) for r in got.collect()}
    assert set(out) == set(values) - set(targets) and got.count() == len(out)
    for v, (suggested, score, use) in out.items():
        d, t = min((relative(v, t), t) for t in targets)
        assert (suggested, score) == (t, 1 - d) and use == ("SI" if 1 - d >= 0.75 else "REVISAR")
    none = spark.createDataFrame([], "t string")
    assert S.fuzzy_category_match(spark.createDataFrame(rows, "v string"), none, "v", "t").collect() == []
