"""Readings of one ``seq`` stand in some order, the same for all, and the result is that of a fold in it."""

import itertools
import random

import pytest

from archgraph.operators import merge

READING = "repo string, id string, seq bigint, conf_pct int, kind string, image string, path string"


def readings_of(seed):
    rnd = random.Random(seed)
    return [("r", f"n{i}", rnd.randrange(3), rnd.choice([40, 80, 100]), rnd.choice(["service", "queue", "datastore"]), rnd.choice([None, "x"]),
             rnd.choice("ab")) for i in range(60) for _ in range(rnd.randint(2, 4))]


def orders(rows):
    """All orders of one component's readings by seq."""
    groups = [list(itertools.permutations(g)) for _, g in itertools.groupby(sorted(rows, key=lambda r: r[2]), key=lambda r: r[2])]
    return ([r for g in pick for r in g] for pick in itertools.product(*groups))


def conflicts(rows):
    was, seen, out = None, False, []
    for _, _, seq, _, kind, image, path in rows:
        wins = was is None or (image is not None if (image is not None) != seen else was == "service" and kind != "service")
        if was is not None and was != kind:
            out.append((seq, path, was, kind, kind if wins else was))
        was, seen = kind if wins else was, seen or image is not None
    return sorted(out)


def image_kept(rows):
    best, value = -1, None
    for _, _, _, conf, _, image, _ in rows:
        if image is not None and (conf > best or value is None):
            value = image
        best = max(best, conf)
    return value


@pytest.mark.parametrize("seed", [1, 2])
def test_conflicts_are_those_of_one_order(spark, seed):
    rows = readings_of(seed)
    got = [sorted((r["id"], r["seq"], r["path"], r["was"], r["also"], r["kept"]) for r in merge.kind_conflicts(
        spark.createDataFrame(rows, READING).repartition(parts)).collect()) for parts in (1, 7)]
    assert got[0] == got[1]
    for key in {r[1] for r in rows}:
        mine = [g[1:] for g in got[0] if g[0] == key]
        assert mine in [conflicts(o) for o in orders([r for r in rows if r[1] == key])], key


def test_merged_fields_do_not_depend_on_the_partitioning(spark):
    rows = [(*r[:5], r[5] and f"{r[5]}{i}", r[6]) for i, r in enumerate(readings_of(3))]
    got = []
    for parts in (1, 3, 7):
        random.Random(parts).shuffle(rows)
        df = spark.createDataFrame(rows, READING).repartition(parts)
        got.append({r["id"]: r["image"] for r in merge.merge_nodes(df, ["image"]).collect()})
    assert got[0] == got[1] == got[2]
    for key, image in got[0].items():
        assert image in {image_kept(o) for o in orders([r for r in rows if r[1] == key])}, key
