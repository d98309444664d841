from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuskit.llm.components import connected_components
from corpuskit.llm.flow import MinCostFlow
from corpuskit.llm.splits import Bundle, allocate, grouped_splits, split_quotas

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    groups = defaultdict(set)
    for x in list(root):
        groups[find(x)].add(x)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("finish", [0, 40, 50_000])
def test_components_equal_union_find(spark, finish):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))]
    edges += [(i, i + 1) for i in range(1000, 1060)]  # a chain
    edges += [(5000, 6000 + i) for i in range(300)] + [(7, 7)]  # a star, a loop
    found = defaultdict(set)
    for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), finish_below=finish).collect():
        found[r["component"]].add(r["v"])
    want = {g for g in union_find(edges) if len(g) > 1}
    assert {frozenset(g) for g in found.values()} == want
    assert all(c in g for c, g in found.items())


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    assert connected_components(spark.createDataFrame([(1, 1)], "a bigint, b bigint")).count() == 0


def test_flow_is_optimal_on_a_small_network():
    net = MinCostFlow(4)
    arcs = [net.add(0, 1, 3, 1), net.add(0, 2, 2, 2), net.add(1, 3, 2, 1), net.add(2, 3, 3, 1), net.add(1, 2, 5, 0)]
    assert net.run(0, 3) == 12
    assert net.flow(arcs[0]) + net.flow(arcs[1]) == 5


def test_quotas_respect_pins():
    q = split_quotas({"a": 100, "b": 100}, {"a": 30}, SHARES, "test")
    total = defaultdict(int)
    for (_, s), n in q.items():
        total[s] += n
    assert sum(total.values()) == 200 and q["a", "test"] >= 30
    assert total["test"] == 30 and total["train"] + total["validation"] == 170


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.sampled_from("ab"), st.booleans(), st.integers(1, 40)), min_size=1, max_size=12, unique_by=lambda t: t[:3]))
def test_allocation_is_whole(rows):
    bundles = [Bundle(*r) for r in rows]
    got = defaultdict(int)
    for b, s, lo, hi in allocate(bundles, SHARES, "test"):
        assert 0 <= lo < hi <= b.count and (not b.pinned or s == "test")
        got[b] += hi - lo
    assert all(got[b] == b.count for b in bundles)


def clips(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, speaker_id string, recording_id string, source string, n_rows int, v int, group string")


def split(spark, rows, held):
    held = spark.createDataFrame([(h,) for h in held], "speaker_id string")
    df = grouped_splits(clips(spark, rows), "row_id", ["speaker_id", "recording_id"], SHARES, label="source", pinned=("speaker_id", held))
    return {r["row_id"]: r for r in df.collect()}


def test_links_deliveries_nulls_and_clashing_columns(spark):
    rows = [(1, "a", "r1", "x", 0, 0, "g"), (2, "b", "r1", "x", 0, 0, "g"), (3, "b", None, None, 0, 0, None), (4, None, "r2", "x", 0, 0, "g"), (5, "c", "r3", "x", 0, 0, "g")]
    rows += [(4, "c", None, "x", 0, 0, "g")]  # a second delivery ties r2 to c
    rows += [(6, None, None, None, None, None, None), (None, "a", "r9", "x", 0, 0, "g"), (7, "d", "r7", "x", 0, 0, "g"), (7, "d", "r7", "x", 0, 0, "g")]
    got = split(spark, rows, ["a", "a", None, "nobody"])
    assert set(got) == set(range(1, 8))
    assert got[1]["group"] == got[2]["group"] == got[3]["group"]
    assert got[4]["group"] == got[5]["group"]
    assert len({got[i]["group"] for i in (1, 4, 6, 7)}) == 4
    assert {i for i in got if got[i]["is_pinned"]} == {1, 2, 3} and got[1]["split"] == "test"
    assert got[7]["n_rows"] == 2 and got[4]["n_rows"] == 2


def test_empty_table(spark):
    assert split(spark, [], ["a"]) == {}


def test_shares_without_pins(spark):
    rows = [(i, f"s{i % 97 if i % 3 else 0}", None, "x" if i % 2 else "y", 0, 0, "") for i in range(3000)]
    df = grouped_splits(clips(spark, rows), "row_id", ["speaker_id", "recording_id"], SHARES, label="source")
    got = {r["split"]: r["n"] for r in df.groupBy("split").agg({"n_rows": "sum"}).withColumnRenamed("sum(n_rows)", "n").collect()}
    assert sum(got.values()) == 3000 and abs(got["train"] - 2400) <= 40 and abs(got["test"] - 300) <= 40
    per_group = df.groupBy("group").agg({"split": "approx_count_distinct"}).where("`approx_count_distinct(split)` > 1")
    assert per_group.count() == 0


def test_profiles_are_booked_by_label():
    """Groups over two labels and few of one: every label meets its shares within one large group."""
    bundles = [Bundle(10, (("a", 7), ("b", 3)), False, 90), Bundle(10, (("a", 2), ("b", 8)), False, 70), Bundle(30, (("a", 15), ("b", 15)), False, 4), Bundle(1, "a", False, 120), Bundle(1, "b", False, 150), Bundle(4, (("a", 2), ("b", 2)), True, 3)]
    cells, rows = defaultdict(float), defaultdict(float)
    for b, s, lo, hi in allocate(bundles, SHARES, "test"):
        for label, n in b.profile:
            cells[label, s] += n * (hi - lo)
            rows[label] += n * (hi - lo)
    assert all(abs(cells[label, s] - share * rows[label]) <= 3 for label in rows for s, share in SHARES.items())
    total = sum(rows.values())
    assert all(abs(sum(cells[label, s] for label in rows) - share * total) <= 1 for s, share in SHARES.items())


@pytest.mark.parametrize("profiles", [10_000, 3])
def test_label_shares_with_exact_and_coarse_bundles(spark, profiles):
    rng = np.random.default_rng(3)
    rows = [(i, f"s{rng.integers(0, 700)}", None, "xyz"[rng.integers(0, 3)], 0, 0, "") for i in range(4000)]
    df = grouped_splits(clips(spark, rows), "row_id", ["speaker_id", "recording_id"], SHARES, label="source", max_profiles=profiles)
    got = {r["row_id"]: r for r in df.collect()}
    assert len(got) == 4000 and len({(r["group"], r["split"]) for r in got.values()}) == len({r["group"] for r in got.values()})
    cells = defaultdict(int)
    for i, _, _, source, *_ in rows:
        cells[source, got[i]["split"]] += 1
    for source in "xyz":
        n = sum(cells[source, s] for s in SHARES)
        assert all(abs(cells[source, s] / n - share) < (0.01 if profiles > 3 else 0.04) for s, share in SHARES.items())


def test_component_names_do_not_depend_on_how_they_are_found(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(50)] + [(300, 301)], "a bigint, b bigint")
    one, other = ({(r["v"], r["component"]) for r in connected_components(edges, finish_below=n).collect()} for n in (0, 50_000))
    assert one == other and {c for _, c in one} == {0, 100, 300}
