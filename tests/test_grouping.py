"""Groups under constraints: nothing different meets, and nothing that may meet stays apart."""

import random

import pytest

from quire.operators.grouping import constrained_components


def check(links, labels, different, got):
    """The properties that constrained_components() promises; returns the groups."""
    root = dict(got)
    assert len(root) == len(got) and set(root) == {x for a, b, _ in links if a != b for x in (a, b)}
    members = {}
    for n, r in root.items():
        members.setdefault(r, set()).add(n)
    assert all(r == min(m) for r, m in members.items())
    least = {}
    for n, k, v in labels:
        least[n, k] = min(v, least.get((n, k), v))
    has = lambda m: {(k, v) for (n, k), v in least.items() if n in m}
    bad = lambda m: len({k for k, _ in has(m)}) < len(has(m)) or any(a != b and a in m and b in m for a, b in different)
    assert not any(map(bad, members.values()))
    # connected by links within the group
    for m in members.values():
        seen, todo = set(), [min(m)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [b if a == x else a for a, b, _ in links if x in (a, b) and {a, b} <= m]
        assert seen == m
    for a, b, _ in links:
        assert a == b or root[a] == root[b] or bad(members[root[a]] | members[root[b]])
    return members


def run(spark, links, labels=(), different=()):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema).repartition(3)
    args = frame(links, "a long, b long, level int"), frame(labels, "node long, kind string, value string"), frame(different, "a long, b long")
    return [tuple(r) for r in constrained_components(*args).collect()]


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    n = 60
    links = [(rnd.randrange(n), rnd.randrange(n), rnd.choice([1, 2])) for _ in range(70)]
    labels = [(rnd.randrange(n), rnd.choice("kl"), rnd.choice("xyz")) for _ in range(25)]
    different = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(25)]
    got = run(spark, links, labels, different)
    check(links, labels, different, got)
    if not seed:
        again = run(spark, links[::-1] + links[:9], labels[::-1], different[::-1] + different)
        assert sorted(again) == sorted(got)


def test_forms(spark):
    star = [(0, i, 1) for i in range(1, 301)]
    labels = [(i, "key", str(i % 3)) for i in range(1, 301)]
    groups = check(star, labels, [], run(spark, star, labels))
    assert sorted(map(len, groups.values()))[-1] == 101  # the hub with all leaves of one key, the others alone
    path = [(i, i + 1, 1) for i in range(100)]
    groups = check(path, [(0, "key", "a"), (100, "key", "b")], [], run(spark, path, [(0, "key", "a"), (100, "key", "b")]))
    assert len(groups) == 2
    # nothing different: plain components
    assert sorted(run(spark, path[:50] + path[60:])) == [(i, 0 if i <= 50 else 60) for i in [*range(51), *range(60, 101)]]
    assert run(spark, []) == []


def test_levels(spark):
    # 1 and 3 have different keys; 2 goes with the one that the stronger evidence names
    for strong, with_ in (((1, 2), 1), ((2, 3), 3)):
        links = [(*strong, 1), *((a, b, 2) for a, b in ((1, 2), (2, 3)) if (a, b) != strong)]
        root = dict(run(spark, links, [(1, "key", "x"), (3, "key", "y")]))
        assert root[2] == root[with_] and root[1] != root[3]
    links = [(1, 2, 1), (2, 3, 1), (3, 4, 2), (None, 4, 1), (4, 4, 1)]
    assert dict(run(spark, links, [], [(1, 3), (3, 1), (None, 2)])).keys() == {1, 2, 3, 4}
