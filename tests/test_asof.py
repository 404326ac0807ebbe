"""As-of operators against plain loops, on random small tables."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest

from delaylake.operators import asof

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def moment(seconds):
    return START + timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(4)
    facts = [(rng.choice(["a", "b", None]), rng.randrange(0, 400_000), i, rng.choice([None, i])) for i in range(150)]
    probes = [(i, rng.choice(["a", "b", "c", None]), rng.randrange(0, 400_000)) for i in range(120)]
    f = spark.createDataFrame([(k, moment(t), i, v) for k, t, i, v in facts], "k string, ft timestamp, fid long, v long")
    p = spark.createDataFrame([(i, k, moment(t)) for i, k, t in probes], "pid long, k string, pt timestamp")
    return facts, probes, f, p


def test_as_of_keeps_null_values_of_the_newest(world):
    facts, probes, f, p = world
    got = {r.pid: (r.fid, r.v) for r in asof.as_of(p, f, ["k"], "pt", "ft", ["fid", "v"], ties=["fid"], slice_seconds=50_000).collect()}
    for i, k, t in probes:
        best = max(((ft, fid, v) for fk, ft, fid, v in facts if fk == k and ft <= t), key=lambda x: x[:2], default=None)
        assert got[i] == (best[1:] if best else (None, None))


def test_last_by_other(world, spark):
    facts, probes, f, p = world
    f2 = f.selectExpr("k", "ft", "cast(fid % 4 as string) as who", "fid")
    p2 = p.selectExpr("pid", "k", "pt", "cast(pid % 4 as string) as who")
    got = {r.pid: r.fid for r in asof.last_by_other(p2, f2, ["k"], "pt", "ft", "who", ["fid"], ["fid"], slice_seconds=50_000).collect()}
    for i, k, t in probes:
        best = max(((ft, fid) for fk, ft, fid, _ in facts if fk == k and ft <= t and fid % 4 != i % 4), default=None)
        assert got[i] == (best[1] if best else None)


@pytest.mark.parametrize("earliest", [False, True])
def test_nearest_within(world, earliest):
    facts, probes, f, p = world
    got = {r.pid: r.fid for r in asof.nearest_within(p, f, ["k"], "pt", "ft", 3000.0, ["fid"], earliest, slice_seconds=50_000).collect()}
    for i, k, t in probes:
        near = [(ft, fid) for fk, ft, fid, _ in facts if fk == k and abs(ft - t) <= 3000]
        if earliest:
            assert got[i] == (min(near)[1] if near else None)
        else:
            assert got[i] == (min(near, key=lambda x: (abs(x[0] - t), -x[0]))[1] if near else None)


def test_active_counts(world, spark):
    _, probes, _, p = world
    rng = random.Random(9)
    periods = [("a", rng.choice([None, rng.randrange(400_000)]), rng.choice([None, rng.randrange(400_000)])) for _ in range(60)]
    periods = [(k, s, e) for k, s, e in periods if s is None or e is None or s <= e]
    q = spark.createDataFrame([(k, s if s is None else moment(s), e if e is None else moment(e)) for k, s, e in periods], "k string, s timestamp, e timestamp")
    got = {r.pid: r.n for r in asof.active_counts(p.filter("k = 'a'"), q, ["k"], "pt", "s", "e", "n", slice_seconds=50_000).collect()}
    for i, k, t in probes:
        if k == "a":
            assert got[i] == sum((s is None or s <= t) and (e is None or e >= t) for _, s, e in periods)


def test_closed_means(spark):
    rng = random.Random(3)
    series = [("x", rng.randrange(30), rng.randrange(1, 4), float(rng.randrange(50))) for _ in range(40)]
    probes = [(i, "x", rng.randrange(35)) for i in range(35)]
    s = spark.createDataFrame(series, "k string, b long, n long, total double")
    p = spark.createDataFrame(probes, "pid long, k string, b long")
    for window, least in ((2, 1), (None, 3)):
        got = {r.pid: r.m for r in asof.closed_means(p, s, ["k"], "b", window, "m", least).collect()}
        for i, _, b in probes:
            part = [(n, t) for _, sb, n, t in series if sb < b and (window is None or sb >= b - window)]
            n = sum(x for x, _ in part)
            assert (got[i] is None) == (n < least)
            if n >= least:
                assert abs(got[i] - sum(t for _, t in part) / n) < 1e-9
