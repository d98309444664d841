"""Train, validation and test splits that keep linked records together."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.components import connected_components
from corpuskit.llm.flow import MinCostFlow
from corpuskit.operators.ranking import hash_rank
from corpuskit.operators.skew import heavy_hitters, skew_join
from corpuskit.session import materialize


def _vertex(i: int, column: str) -> Column:
    return F.when(F.col(column).isNotNull(), F.xxhash64(F.lit(i), F.col(column).cast("string")))


def record_vertices(df: DataFrame, record: str, links: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Records with one vertex each, and the edges that tie the vertices together.

    Vertices are 64-bit hashes of (column, value). A record stands at the vertex of its last
    non-null link column, or at one of its own if it has no link or if its delivered rows
    disagree in a link; in the latter case every value of every row is tied to it. Returns
    ``record, n_rows, label, v`` and ``a, b``.
    """
    names = [f"_x{i}" for i in range(len(links))]
    keyed = df.where(F.col(record).isNotNull()).select(F.col(record), "label", *[_vertex(i, c).alias(x) for i, (c, x) in enumerate(zip(links, names))])
    own = F.xxhash64(F.lit(-1), F.col(record).cast("string"))
    merged = keyed.groupBy(record).agg(F.count("*").alias("n_rows"), F.max("label").alias("label"), *[f(x).alias(f"{x}_{k}") for x in names for k, f in (("lo", F.min), ("hi", F.max))])
    differs = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"{x}_lo") != F.col(f"{x}_hi"), F.lit(False)) for x in names])
    at = F.when(differs, own).otherwise(F.coalesce(*[F.col(f"{x}_hi") for x in reversed(names)], own))
    records = materialize(merged.select(record, "n_rows", "label", at.alias("v"), differs.alias("differs"), *[F.col(f"{x}_hi").alias(x) for x in names]))
    plain = records.where(~F.col("differs")).select(F.col("v").alias("a"), F.explode(F.array_compact(F.array(*names))).alias("b"))
    torn = keyed.join(records.where("differs").select(record), record, "left_semi").select(own.alias("a"), F.explode(F.array_compact(F.array(*names))).alias("b"))
    return records.select(record, "n_rows", "label", "v"), plain.where("a <> b").unionByName(torn)


@dataclass(frozen=True)
class Bundle:
    """Groups of equal size and label profile; ``label`` is one label, or (label, rows of it in a group) pairs."""

    size: float
    label: str | tuple[tuple[str, float], ...]
    pinned: bool
    count: int
    name: str = ""

    @property
    def profile(self) -> tuple[tuple[str, float], ...]:
        return ((self.label, self.size),) if isinstance(self.label, str) else self.label


def split_quotas(rows_by_label: Mapping[str, int], pinned_by_label: Mapping[str, int], shares: Mapping[str, float], pin_to: str, label_weight: int = 1, split_weight: int = 8) -> dict[tuple[str, str], int]:
    """Rows of each (label, split), from a minimum-cost flow.

    Source -> label -> (label, split) -> split -> sink. Up to its quota an arc is free;
    every row beyond the quota of a (label, split) costs ``label_weight``, beyond that of
    a split ``split_weight``. Pinned rows may flow to ``pin_to`` only. A bundle would be a
    node between the source and the labels of its profile; as costs depend on the totals of
    (label, split) alone and its rows may take any of the label's arcs, the bundles'
    nodes are contracted into the labels', which leaves the least cost as it is.
    """
    labels, splits = sorted(rows_by_label), list(shares)
    total = sum(rows_by_label.values())

    def quotas(n: int) -> dict[str, int]:
        raw = {s: int(n * shares[s]) for s in splits}
        for s in sorted(splits, key=lambda s: -(n * shares[s] - raw[s]))[: n - sum(raw.values())]:
            raw[s] += 1
        return raw

    index = {("source",): 0, ("sink",): 1}

    def node(*key: str) -> int:
        return index.setdefault(key, len(index))

    net = MinCostFlow(2 + len(splits) + len(labels) * (2 + len(splits)))
    arcs: dict[tuple[str, str], list[int]] = defaultdict(list)
    for s, quota in quotas(total).items():
        net.add(node("split", s), 1, quota, 0)
        net.add(node("split", s), 1, total, split_weight)
    for label in labels:
        n, pinned = rows_by_label[label], pinned_by_label.get(label, 0)
        net.add(0, node("free", label), n - pinned, 0)
        net.add(0, node("pinned", label), pinned, 0)
        for s, quota in quotas(n).items():
            cell = node("cell", label, s)
            net.add(cell, node("split", s), quota, 0)
            net.add(cell, node("split", s), n, label_weight)
            arcs[label, s].append(net.add(node("free", label), cell, n, 0))
            if s == pin_to:
                arcs[label, s].append(net.add(node("pinned", label), cell, n, 0))
    net.run(0, 1)
    return {key: sum(net.flow(a) for a in own) for key, own in arcs.items()}


def allocate(bundles: Sequence[Bundle], shares: Mapping[str, float], pin_to: str, split_weight: float = 64.0, sweeps: int = 3) -> list[tuple[Bundle, str, int, int]]:
    """``bundle, split, first rank, last rank + 1``: an integral version of the flow.

    Only whole groups are handed out, each with all labels of its profile. The bundles go
    from the largest groups to the smallest; each is spread in proportion to what the
    (label, split) quotas of its labels still lack, and groups left over go where they
    lower the deviation from the labels' quotas most (squares over quotas), so that small groups even out what large ones distort. Then groups are moved, from the
    smallest bundles to the largest, while that lowers the deviation, in which the splits'
    totals weigh ``split_weight`` times; ``sweeps`` bounds the passes. At the end of the last full pass no move of groups of one bundle between two
    splits lowers it, unless the passes ran out.
    """
    rows, pinned = defaultdict(float), defaultdict(float)
    for b in bundles:
        for label, n in b.profile:
            rows[label] += n * b.count
            pinned[label] += n * b.count * b.pinned
    rows = {label: round(n) for label, n in rows.items()}
    labels, splits = sorted(rows), list(shares)
    quota = split_quotas(rows, {label: min(round(n), rows[label]) for label, n in pinned.items()}, shares, pin_to)
    want = np.array([[quota[label, s] for s in splits] for label in labels], dtype=float).reshape(len(labels), len(splits))
    lack, scale = want.copy(), 1.0 / np.maximum(want, 1.0)
    all_lack, all_scale = lack.sum(0), 0.5 / np.maximum(want.sum(0), 1.0)
    place = {label: i for i, label in enumerate(labels)}
    at = [np.array([place[label] for label, _ in b.profile], dtype=int) for b in bundles]
    load = [np.array([n for _, n in b.profile], dtype=float) for b in bundles]
    counts = np.zeros((len(bundles), len(splits)), dtype=np.int64)

    def give(k: int, s: int, n: int) -> None:
        counts[k, s] += n
        lack[at[k], s] -= load[k] * n
        all_lack[s] -= load[k].sum() * n

    def slope(k: int) -> tuple[np.ndarray, np.ndarray]:
        """Derivative of the deviation by a group more in each split, and half the second derivative."""
        v, size = load[k][:, None], load[k].sum()
        return -2 * ((v * lack[at[k]] * scale[at[k]]).sum(0) + size * all_lack * all_scale), (v**2 * scale[at[k]]).sum(0) + size**2 * all_scale

    order = sorted(range(len(bundles)), key=lambda k: (not bundles[k].pinned, -bundles[k].size, bundles[k].label if isinstance(bundles[k].label, str) else str(bundles[k].label)))
    for k in order:
        b = bundles[k]
        if b.pinned:
            give(k, splits.index(pin_to), b.count)
            continue
        open_lack = np.maximum(lack[at[k]], 0.0)
        whole = open_lack.sum(1, keepdims=True)
        part = np.where(whole > 0, open_lack / np.maximum(whole, 1e-9), np.array([shares[s] for s in splits]))
        for s, n in enumerate(np.floor(b.count * (part * load[k][:, None]).sum(0) / max(load[k].sum(), 1e-9) + 1e-9).astype(np.int64)):
            give(k, s, int(n))
        for _ in range(b.count - int(counts[k].sum())):
            first, second = slope(k)
            give(k, int((first + second).argmin()), 1)
    all_scale *= 2 * split_weight
    for _ in range(sweeps):
        moved = 0
        for k in reversed(order):
            if bundles[k].pinned:
                continue
            while True:
                first, second = slope(k)
                # n groups from split a to split b change the deviation by n * gain + n ** 2 * curve
                gain, curve = first[None, :] - first[:, None], second[None, :] + second[:, None]
                n = np.minimum(np.maximum(np.round(-gain / (2 * curve)), 1), counts[k][:, None])
                change = np.where(np.eye(len(splits), dtype=bool) | (n < 1), 0.0, n * gain + n**2 * curve)
                a, b = np.unravel_index(change.argmin(), change.shape)
                if change[a, b] >= -1e-9:
                    break
                give(k, int(a), -int(n[a, b]))
                give(k, int(b), int(n[a, b]))
                moved += 1
        if not moved:
            break
    out = []
    for k in order:
        first = 0
        for s, n in zip(splits, counts[k].tolist()):
            if n:
                out.append((bundles[k], s, first, first + n))
                first += n
    return out


def _bundled(groups: DataFrame, max_profiles: int) -> DataFrame:
    """``group, size, labels, pinned`` with ``bundle``, the name of the group's size and label profile.

    Groups of one label have few different sizes (:func:`grouped_splits`). Groups of several
    labels can each have a profile of their own, so these are exact for the largest groups
    only, as far as ``max_profiles`` of them, and smaller ones share a bundle by size (in steps of a
    tenth), greatest label and its share in tenths; what such a bundle gives up is the
    difference of small groups from their mean.
    """
    exact = F.concat_ws("|", F.col("size"), F.concat_ws("|", F.transform("labels", lambda x: F.concat_ws("=", x["label"], x["n"]))))
    main = F.array_max(F.transform("labels", lambda x: F.struct(x["n"].alias("n"), x["label"].alias("label"))))
    coarse = F.concat_ws("~", F.floor(F.log("size") * 10), main["label"], F.floor(main["n"] / F.col("size") * 10))
    mixed = F.size("labels") > 1
    # number of profiles by size class, from the largest down; a class is a power of 1.1
    step = F.floor(F.log("size") / float(np.log(1.1)))
    known = sorted((-r["c"], r["n"]) for r in groups.where(mixed).groupBy(step.alias("c")).agg(F.count_distinct(exact).alias("n")).collect())
    least, total = 0, 0
    for c, n in known:
        total += n
        if total > max_profiles:
            least = -c + 1
            break
    return groups.withColumn("bundle", F.when(mixed & (step < least), coarse).otherwise(exact))


def grouped_splits(
    df: DataFrame,
    record: str,
    links: Sequence[str],
    shares: Mapping[str, float],
    label: str | None = None,
    pinned: tuple[str, DataFrame] | None = None,
    pin_to: str = "test",
    seed: int = 0,
    max_profiles: int = 10_000,
    finish_below: int = 50_000,
) -> DataFrame:
    """``record, group, split, is_pinned, n_rows``: every record exactly once, linked records in one split.

    ``shares`` are the wanted shares of rows. ``pinned`` is (link column, table with that
    column): groups holding one of its values go to ``pin_to``. ``label`` is a column whose
    mix should be alike in all splits; every row of a group is booked under its own label.
    Records without a link value are groups of their own; rows without a record id are out.
    Null labels count as the empty label. Other columns of ``df`` are ignored.

    Groups are bundled by (rows, rows of each label, pinned). Distinct sizes of the groups of
    one label add up to at most all rows, so these are at most ``sqrt(2 * rows)`` bundles per label;
    the profiles of mixed groups are bounded by ``max_profiles`` (:func:`_bundled`). So the
    bundles fit on the driver at any scale, where a minimum-cost flow gives the quotas and
    whole groups are handed out. Members of a bundle are told apart by a hash rank.
    """
    if abs(sum(shares.values()) - 1) > 1e-9 or pin_to not in shares:
        raise ValueError("shares must add up to 1 and name the split of pinned groups")
    base = df.select(record, *[F.col(c) for c in links], (F.coalesce(F.col(label).cast("string"), F.lit("")) if label else F.lit("")).alias("label"))
    records, edges = record_vertices(base, record, links)
    found = materialize(connected_components(edges, finish_below=finish_below))
    # one row per vertex that carries records; combined before the shuffle
    loads = records.groupBy("v", "label").agg(F.sum("n_rows").alias("n"))
    placed = materialize(loads.join(found, "v", "left").withColumn("group", F.coalesce("component", "v")).drop("component"))
    profiles = placed.groupBy("group", "label").agg(F.sum("n").alias("n"))
    groups = profiles.groupBy("group").agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("label", "n"))).alias("labels"))
    if pinned is not None:
        column, names = pinned
        pins = names.select(_vertex(list(links).index(column), column).alias("v")).where(F.col("v").isNotNull()).distinct()
        pins = pins.join(found, "v", "left").select(F.coalesce("component", "v").alias("group"), F.lit(True).alias("pinned")).distinct()
        groups = groups.join(pins, "group", "left")
    else:
        groups = groups.withColumn("pinned", F.lit(False))
    groups = _bundled(materialize(groups.select("group", "size", "labels", F.coalesce("pinned", F.lit(False)).alias("pinned"))), max_profiles)
    facts = defaultdict(dict)
    sums = groups.select("bundle", "pinned", F.explode("labels").alias("x")).groupBy("bundle", "pinned", "x.label").agg(F.sum("x.n").alias("n"))
    for r in sums.collect():
        facts[r["bundle"], r["pinned"]][r["label"]] = r["n"]
    many = {(r["bundle"], r["pinned"]): r["count"] for r in groups.groupBy("bundle", "pinned").count().collect()}
    bundles = {Bundle(sum(own.values()) / many[key], tuple(sorted((label, n / many[key]) for label, n in own.items())), key[1], many[key], key[0]): key for key, own in facts.items()}
    ranges = [(*bundles[b], s, lo, hi) for b, s, lo, hi in allocate(sorted(bundles, key=lambda b: (b.pinned, b.name)), shares, pin_to)]
    table = df.sparkSession.createDataFrame(ranges, "bundle string, pinned boolean, split string, _lo bigint, _hi bigint")
    ranked = hash_rank(groups.select("group", "bundle", "pinned"), ["bundle", "pinned"], ["group"], seed, out="_rank")
    chosen = ranked.join(F.broadcast(table), ["bundle", "pinned"]).where("_rank >= _lo AND _rank < _hi").select("group", "split", "pinned")
    heavy, _ = heavy_hitters(placed, "group")
    by_vertex = materialize(skew_join(placed.select("v", "group").distinct(), materialize(chosen), "group", heavy))
    heavy, _ = heavy_hitters(records, "v")
    return skew_join(records.select(record, "n_rows", "v"), by_vertex, "v", heavy).select(record, "group", "split", F.col("pinned").alias("is_pinned"), "n_rows")
