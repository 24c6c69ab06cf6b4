"""Interval sweeps and measured as-of blocks against brute force."""

from __future__ import annotations

import bisect
import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from seriesloom.checks import checks
from seriesloom.operators import aggregates, joins

DAY = dt.date(2020, 1, 1)
RECORDS = "metric_id string, company_id string, as_of date, direction string, comparable boolean, accepted_at timestamp, reviewed_at timestamp, seq int"


def _records(seed, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        hot = rng.random() < 0.35
        stamp = dt.datetime(2020, 1, 1) + dt.timedelta(hours=rng.randrange(20_000))
        out.append((
            rng.choice("mn"), "hot" if hot else rng.choice(["a", "b", "c", "d", None]), DAY + dt.timedelta(days=rng.randrange(500)),
            rng.choice(["UP", "UP", "UP", "DOWN", "UNKNOWN", None]) if rng.random() < 0.3 else "UP", rng.random() < 0.9,
            stamp, None if i % 9 == 0 else stamp + dt.timedelta(days=1), i,
        ))
    return out


def _latest(records):
    """Rows (metric, date) to the records that are latest on it, the slow way."""
    found = {}
    for metric in {r[0] for r in records}:
        mine = [r for r in records if r[0] == metric]
        for day in {r[2] for r in mine}:
            best = {}
            for r in mine:
                if 0 <= (day - r[2]).days <= 120 and (r[1] not in best or (r[2], r[7]) > (best[r[1]][2], best[r[1]][7])):
                    best[r[1]] = r
            found[metric, day] = list(best.values())
    return found


def test_latest_records_and_points_equal_brute_force(spark):
    records = _records(1)
    df = spark.createDataFrame(records, RECORDS)
    want = _latest(records)
    got = Counter((r["metric_id"], r["asof_date"], r["company_id"], r["seq"]) for r in joins.latest_per_entity_asof(df, tie=["seq"]).collect())
    assert got == Counter((m, d, r[1], r[7]) for (m, d), v in want.items() for r in v)

    points = {}
    for key, v in want.items():
        votes = [r[3] for r in v if r[4] and r[3] is not None]
        unknown = "UNKNOWN" in votes or not votes
        direction = "UNKNOWN" if unknown else votes[0] if len(set(votes)) == 1 else "MIXED"
        stamps = [max((r[i] for r in v if r[i] is not None), default=None) for i in (5, 6)]
        points[key] = (direction, len(v), sum(r[1] is not None for r in v), sum(r[4] for r in v), *stamps)
    found = aggregates.reviewed_observations(joins.entity_spans(df, tie=["seq"])).collect()
    assert {(r["metric_id"], r["asof_date"]): tuple(r)[2:] for r in found} == points and len(found) == len(points)


def test_a_sweep_moves_no_more_rows_than_it_has_records(spark):
    """Nothing is unrolled before a shuffle: the rows a record adds are its entry, its exit and its two runs."""
    spans = joins.entity_spans(spark.createDataFrame(_records(2), RECORDS), tie=["seq"])
    plan = aggregates.reviewed_observations(spans)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        assert "explode(sequence(" not in line or "_start" in line
    assert "Generate explode(sequence(" in plan


def test_the_age_limit_unrolls_only_days_beyond_it(spark):
    df = spark.createDataFrame(_records(3, 40), RECORDS)
    points = aggregates.reviewed_observations(joins.entity_spans(df, tie=["seq"]))
    wide = joins.entity_spans(df, tie=["seq"], max_age_days=150)
    rows = df.select(F.lit("k").alias("accession"), "metric_id", "company_id", F.array(F.lit(None).cast("string")).alias("violations")).limit(0)

    def found(spans):
        return checks.recheck_reviewed_records(points, spans, recomputed=points, validated=rows)

    old = joins.latest_per_entity_asof(df, tie=["seq"], max_age_days=150).where("datediff(asof_date, as_of) > 120").selectExpr(
        "concat_ws('/', metric_id, asof_date, company_id)")
    got = Counter(r["key"] for r in found(wide).collect())
    assert got == Counter(r[0] for r in old.collect()) and got
    assert found(joins.entity_spans(df, tie=["seq"])).count() == 0
    assert "collect_list" not in found(wide)._jdf.queryExecution().optimizedPlan().toString()


def test_measured_blocks_equal_the_plain_join(spark):
    rng = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)

    def side(n):
        # A hot group whose rows lie within one day, a null time, a group on one side only.
        rows = [("hot", t0 + dt.timedelta(seconds=rng.randrange(80_000))) for _ in range(n)]
        rows += [(rng.choice("abc"), t0 + dt.timedelta(hours=rng.randrange(2_000))) for _ in range(n // 2)]
        return rows + [("hot", None)]

    left = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate([*side(600), ("left", t0)])], "k string, t timestamp, id int")
    rights = {(k, t): float(i) for i, (k, t) in enumerate([*side(100), ("right", t0)])}
    right = spark.createDataFrame([(k, t, v) for (k, t), v in rights.items()], "k string, t timestamp, rate double")
    options = {"by": ["k"], "time": "t", "right_columns": ["rate"], "right_time": "rt"}
    measured = Counter(map(tuple, joins.asof_join_backward(left, right, parts=7, **options).where("t IS NOT NULL").collect()))
    want = Counter()
    for r in left.where("t IS NOT NULL").collect():
        times = sorted(t for k, t in rights if k == r["k"] and t is not None)
        at = bisect.bisect_right(times, r["t"])
        if at:
            want[(r["k"], r["t"], r["id"], times[at - 1], rights[r["k"], times[at - 1]])] += 1
    assert measured == want and len(want) > 500
    assert joins.asof_join_backward(left.limit(0), right.limit(0), parts=7, **options).count() == 0


def test_ten_times_the_rows_make_more_blocks_not_larger_ones(spark):
    def largest(n, parts):
        rows = spark.range(n).selectExpr("IF(id % 3 = 0, 'cold', 'hot') AS k", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id / 1000) AS t")
        bounds = joins.measured_bounds(rows, ["k"], "t", parts)
        sizes = rows.join(bounds, "k", "left").groupBy("k", joins.block_of(F.col("t"), F.col("_bounds")).alias("b")).count()
        return sizes.agg(F.max("count")).first()[0], sizes.count()

    small, blocks = largest(3_000, 10)
    large, more = largest(30_000, 100)
    assert large < 2 * small and more > 8 * blocks
