"""As-of, calendar, ordinal and agreement joins. No join here is a nested loop."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.clean import fold_duplicates
from seriesloom.session import new_table_path
from seriesloom.functions.scalars import (
    all_of, any_of, codes, basis_points, weekday_on_or_after, weekday_on_or_before,
)

# --- as-of -----------------------------------------------------------------


def asof_join_backward(
    left: DataFrame, right: DataFrame, *, by: Sequence[str], time: str = "obs_date",
    right_columns: Sequence[str], right_time: str = "right_obs_date",
    block: str | None = None, parts: int | None = None,
) -> DataFrame:
    """The latest right row on or before each left row; earlier left rows drop, as do rows without a time.

    Both sides go into one shuffle and one sort; on equal times the right row
    sorts first and the last one seen so far is the match.

    Without ``block`` one ``by`` group is one window partition, which suits
    (series, day) grain. With ``block`` (``"month"``, ``"day"``, ...) a group is
    cut along the time axis: each block is its own partition and starts from the
    last right row of the blocks before it, found on a table with one row per
    (group, block). A group that owns most of the rows then spreads over as many
    tasks as it has blocks, and the result is the same.

    With ``parts`` the blocks are measured instead: (group, time) is cut into
    about that many ranges of equal row counts, so ten times the rows at one day
    make more blocks with more ``parts``, not larger ones. Only equal times of
    one group can't be cut.
    """
    names = left.columns
    left, right = left.where(F.col(time).isNotNull()), right.where(F.col(time).isNotNull())
    match = F.struct(F.col(time).alias(right_time), *right_columns)
    none = F.lit(None).cast(right.select(match.alias("m")).schema["m"].dataType)
    left_row = F.struct(*left.columns)
    no_left = F.lit(None).cast(left.select(left_row.alias("l")).schema["l"].dataType)
    cut = F.date_trunc(block, F.col(time)) if block else F.lit(0)
    if parts is not None:
        bounds = measured_bounds(left.select(*by, time).unionByName(right.select(*by, time)), by, time, parts)
        left, right = (
            df.join(bounds, list(by), "left").withColumn("_block", block_of(F.col(time), F.col("_bounds"))) for df in (left, right)
        )
        cut = F.col("_block")
        left_row = F.struct(*[c for c in left.columns if c not in ("_block", "_bounds")])
    tagged = right.select(
        *by, time, cut.alias("_block"), F.lit(0).alias("_side"),
        match.alias("_match"), no_left.alias("_left"),
    ).unionByName(
        left.select(
            *by, time, cut.alias("_block"), F.lit(1).alias("_side"),
            none.alias("_match"), left_row.alias("_left"),
        )
    )
    within = (
        Window.partitionBy(*by, "_block").orderBy(time, "_side")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    found = F.last("_match", ignorenulls=True).over(within)
    if block is None and parts is None:
        joined = tagged.withColumn("_found", found)
    else:
        summary = tagged.groupBy(*by, "_block").agg(
            F.max_by("_match", F.when(F.col("_side") == 0, F.col(time))).alias("_tail")
        )
        before = Window.partitionBy(*by).orderBy("_block").rowsBetween(
            Window.unboundedPreceding, -1
        )
        carry = summary.select(
            *by, "_block", F.last("_tail", ignorenulls=True).over(before).alias("_carry")
        )
        joined = tagged.join(carry, [*by, "_block"]).withColumn(
            "_found", F.coalesce(found, F.col("_carry"))
        )
    return joined.where("_side = 1 AND _found IS NOT NULL").select(
        *[F.col(f"_left.`{c}`").alias(c) for c in names],
        *[F.col(f"_found.`{c}`").alias(c) for c in (right_time, *right_columns)],
    )


def measured_bounds(rows: DataFrame, by: Sequence[str], time: str, parts: int) -> DataFrame:
    """Per group the times at which its blocks begin: the first keys of ``parts`` ranges of about equal row counts.

    One narrow shuffle of the keys. The table has at most ``parts`` times in
    all and is written, so that joins know its size before they shuffle.
    """
    keyed = rows.where(F.col(time).isNotNull()).repartitionByRange(parts, *by, time)
    first = F.min(F.struct(*by, time)).alias("_first")
    firsts = keyed.groupBy(F.spark_partition_id().alias("_part")).agg(first).select("_first.*")
    bounds = firsts.groupBy(*by).agg(F.array_sort(F.collect_set(time)).alias("_bounds"))
    path = new_table_path(rows.sparkSession, "bounds")
    bounds.write.parquet(path)
    return rows.sparkSession.read.schema(bounds.schema).parquet(path)


def block_of(time: Column, bounds: Column) -> Column:
    """How many bounds are at or before a time, by binary search; 0 without bounds or time."""
    def step(low: Column, power: Column) -> Column:
        there = low + power
        return F.when((there <= F.size(bounds)) & (F.get(bounds, there - 1) <= time), there).otherwise(low)

    top = F.floor(F.log2(F.size(bounds))).cast("int")
    powers = F.transform(F.sequence(top, F.lit(0), F.lit(-1)), lambda e: F.pow(F.lit(2), e).cast("int"))
    found = F.aggregate(powers, F.lit(0), step)
    return F.when(bounds.isNull() | time.isNull(), 0).otherwise(found)


def effective_by_day(
    steps: DataFrame, *, by: Sequence[str], columns: Sequence[str], until,
    date: str = "obs_date",
) -> DataFrame:
    """One row per calendar day with the step in force on that day.

    The size is the number of calendar days covered, whatever the data volume.
    """
    w = Window.partitionBy(*by).orderBy(date)
    last_day = F.coalesce(
        F.date_sub(F.lead(date).over(w), 1), F.greatest(F.col(date), until)
    )
    spans = steps.select(*by, date, *columns, last_day.alias("_to"))
    days = F.explode(F.sequence(date, "_to", F.expr("interval 1 day")))
    return spans.select(
        *by, F.col(date).alias("right_obs_date"), *columns, days.alias(date)
    )


def spread_to_benchmark(
    obs: DataFrame, benchmark_id: str, *, ids: Sequence[str] | None = None,
    by: str = "series_id", date: str = "obs_date", value: str = "value",
) -> DataFrame:
    """(left − benchmark)·100 for every series, as of the left date.

    One benchmark serves all series, so it is not copied per series: it is
    unrolled to calendar days once and equi-joined on the day.
    """
    valid = obs.where(F.col(value).isNotNull())
    left = valid.where(F.col(by) != benchmark_id)
    if ids is not None:
        left = left.where(F.col(by).isin(*ids))
    until = left.agg(F.max(date)).scalar()
    bench = effective_by_day(
        valid.where(F.col(by) == benchmark_id).select(
            by, date, F.col(value).alias("benchmark")
        ),
        by=[by], columns=["benchmark"], until=until, date=date,
    ).drop(by)
    return left.join(bench, date).select(
        by, date, basis_points(F.col(value), F.col("benchmark")).alias("spread_bp"),
        F.col(value).alias("left_value"), "benchmark", "right_obs_date",
    )


# --- equi joins ------------------------------------------------------------


def inner_on(
    left: DataFrame, right: DataFrame, on: Sequence[str], *, value: str = "value"
) -> DataFrame:
    """Two valued sides on exact keys (a date, or a quarter ordinal)."""
    l = left.where(F.col(value).isNotNull()).withColumnRenamed(value, "left_value")
    r = right.where(F.col(value).isNotNull()).withColumnRenamed(value, "right_value")
    return l.join(r, list(on))


def pair_on_date(
    obs: DataFrame, pairs: Sequence[tuple[str, str, str]], *, by: str = "series_id",
    date: str = "obs_date", value: str = "value",
) -> DataFrame:
    """(pair, date, left_value, right_value) for many pairs of series at once.

    Each row is sent only to the pairs it belongs to, then one aggregate by
    (pair, date) puts the sides together: no self join.
    """
    sides: dict[str, list[tuple[str, str]]] = {}
    for name, left_id, right_id in pairs:
        sides.setdefault(left_id, []).append((name, "L"))
        sides.setdefault(right_id, []).append((name, "R"))
    member = F.create_map(
        *[
            x for sid, uses in sides.items() for x in (
                F.lit(sid),
                F.array(*[F.struct(F.lit(n).alias("pair"), F.lit(s).alias("side")) for n, s in uses]),
            )
        ]
    )
    rows = obs.where(F.col(value).isNotNull() & F.col(by).isin(*sides)).select(
        date, value, F.explode(F.try_element_at(member, F.col(by))).alias("_m")
    )
    grouped = rows.groupBy(F.col("_m.pair").alias("pair"), date).agg(
        F.max(F.when(F.col("_m.side") == "L", F.col(value))).alias("left_value"),
        F.max(F.when(F.col("_m.side") == "R", F.col(value))).alias("right_value"),
    )
    return grouped.where("left_value IS NOT NULL AND right_value IS NOT NULL")


def common_dates(
    obs: DataFrame, *, by: str = "series_id", date: str = "obs_date", entities: int | None = None
) -> DataFrame:
    """Dates on which every entity has a row, with the entity count."""
    wanted = F.lit(entities) if entities is not None else obs.agg(F.countDistinct(by)).scalar()
    return obs.groupBy(date).agg(F.countDistinct(by).alias("entities")).where(
        F.col("entities") == wanted
    )


def left_with_missing_flag(
    facts: DataFrame, filings: DataFrame, on: Sequence[str], *,
    agree: Mapping[str, str], provenance: Sequence[str],
) -> DataFrame:
    """Facts with their filing's provenance. An unmatched fact is flagged, a
    matched one whose ``agree`` columns differ is marked as a mismatch. Filings
    are folded to one row per key first, so a fact never multiplies; a key whose
    rows differ is marked as a conflict."""
    carried = list(dict.fromkeys([*agree.values(), *provenance]))
    right = fold_duplicates(filings, list(on), carried).select(
        *on, *[F.col(c).alias(f"_r_{c}") for c in agree.values()], *provenance,
        F.lit(True).alias("_hit"), F.col("is_conflict").alias("_conflict"),
    )
    joined = facts.join(right, list(on), "left")
    differs = any_of([~F.col(a).eqNullSafe(F.col(f"_r_{b}")) for a, b in agree.items()])
    return joined.select(
        *facts.columns, *provenance,
        F.col("_hit").isNull().alias("metadata_missing"),
        (F.col("_hit").isNotNull() & differs).alias("metadata_mismatch"),
        F.coalesce("_conflict", F.lit(False)).alias("metadata_conflict"),
    )


def reuse_known(
    index_rows: DataFrame, known: DataFrame, *, key: str = "accession",
    agree: Sequence[str] = ("form", "filed", "index_date"),
) -> DataFrame:
    """NEW, REUSED, MISMATCH or CONFLICT for every listed filing, one row each.

    Known rows are folded to one per key; a key whose rows differ is a conflict.
    """
    right = fold_duplicates(known, [key], list(agree)).select(
        key, *[F.col(c).alias(f"_k_{c}") for c in agree], F.lit(True).alias("_hit"),
        F.col("is_conflict").alias("_conflict"),
    )
    same = all_of([F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in agree])
    return index_rows.join(right, key, "left").select(
        *index_rows.columns,
        F.when(F.col("_hit").isNull(), "NEW").when(F.col("_conflict"), "CONFLICT")
        .when(same, "REUSED").otherwise("MISMATCH")
        .alias("reuse_status"),
    )


def attach_calendar_flags(
    obs: DataFrame, events: DataFrame, *, date: str = "obs_date", flags: str = "flags"
) -> DataFrame:
    """Flags of each date; those of repeated dates are put together first."""
    merged = events.select(date, F.explode(flags).alias("_flag")).distinct().groupBy(date).agg(
        F.array_sort(F.collect_list("_flag")).alias(flags)
    )
    return obs.join(merged, date, "left").withColumn(
        flags, F.coalesce(flags, F.array().cast("array<string>"))
    )


def link_amendments(
    filings: DataFrame, *, key: str = "accession", form: str = "form",
    base_form: str, amended_form: str, filed: str = "filed",
    original_date: str = "original_date", accepted: str = "accepted_at",
    identity: Sequence[str],
) -> DataFrame:
    """Link each amendment to its original and set the status of both.

    A link needs exactly one original with the same identity columns that was
    filed on the amendment's stated date. Originals are first folded to one row
    per such key with a count, so several candidates never fan out; amendments
    with an unusable key stay out of the join. Of the amendments linked to one
    original only the latest accepted is effective. Filings of any other form
    keep their row with the status ``OTHER_FORM``.
    """
    link_key = [f"_k{i}" for i in range(len(identity) + 1)]

    def keyed(df: DataFrame, day: str) -> DataFrame:
        for name, c in zip(link_key, [day, *identity]):
            df = df.withColumn(name, F.col(c))
        return df

    usable = all_of([F.col(k).isNotNull() for k in link_key])
    originals = keyed(filings.where(F.col(form) == base_form), filed)
    amendments = keyed(filings.where(F.col(form) == amended_form), original_date)
    candidates = originals.where(usable).groupBy(*link_key).agg(
        F.count(F.lit(1)).alias("_n"), F.min(key).alias("_original")
    ).where("_n = 1").drop("_n")
    linkable = amendments.where(usable).join(candidates, link_key, "left")
    linked = linkable.where("_original IS NOT NULL")
    winners = linked.groupBy("_original").agg(
        F.max(F.struct(accepted, key)).alias("_win")
    ).select("_original", F.col(f"_win.{key}").alias("_winner"))
    # Rows without a link have no key to join on and would meet in one task.
    review = linkable.where("_original IS NULL").select(*filings.columns).unionByName(
        amendments.where(~usable).select(*filings.columns)
    ).select(
        "*", F.lit("UNLINKED_REVIEW").alias("amendment_status"),
        F.lit(None).cast(filings.schema[key].dataType).alias("linked_original"),
    )
    amended = linked.join(winners, "_original").select(
        *filings.columns,
        F.when(F.col("_winner") == F.col(key), "AMENDMENT_EFFECTIVE")
        .otherwise("AMENDMENT_SUPERSEDED").alias("amendment_status"),
        F.col("_original").alias("linked_original"),
    )
    replaced = winners.select(F.col("_original").alias(key), F.lit(True).alias("_hit"))
    base = filings.where(F.col(form) == base_form).join(replaced, key, "left").select(
        *filings.columns,
        F.when(F.col("_hit"), "ORIGINAL_SUPERSEDED").otherwise("ORIGINAL_EFFECTIVE")
        .alias("amendment_status"),
        F.lit(None).cast(filings.schema[key].dataType).alias("linked_original"),
    )
    other = filings.where(~F.coalesce(F.col(form).isin(base_form, amended_form), F.lit(False))).select(
        "*", F.lit("OTHER_FORM").alias("amendment_status"),
        F.lit(None).cast(filings.schema[key].dataType).alias("linked_original"),
    )
    return base.unionByName(amended).unionByName(review).unionByName(other)


# --- calendar joins --------------------------------------------------------


def next_observation(
    obs: DataFrame, *, by: Sequence[str] = ("series_id",), date: str = "obs_date"
) -> DataFrame:
    """Each row with the next actual observation date (null for the last)."""
    w = Window.partitionBy(*by).orderBy(date)
    return obs.withColumn("next_date", F.lead(date).over(w))


def calendar_index(
    calendar: DataFrame, *, by: Sequence[str] = ("calendar_id",), date: str = "obs_date"
) -> DataFrame:
    """Dense positions of the distinct days of each calendar."""
    days = calendar.select(*by, date).distinct()
    w = Window.partitionBy(*by).orderBy(date)
    return days.withColumn("idx", F.row_number().over(w))


def calendar_neighbours(
    deadlines: DataFrame, calendar: DataFrame, *, adjacent: int = 1,
    by: Sequence[str] = ("calendar_id",), kind: str = "kind", original: str = "original",
    observed: str = "observed", source: str = "source", date: str = "obs_date",
) -> DataFrame:
    """Deadlines widened to ±k positions of a business calendar, one row per day.

    Positions make it an equi join; the sets per day hold kinds and sources, a
    small vocabulary.
    """
    idx = calendar_index(calendar, by=by, date=date)
    at = deadlines.join(
        idx.withColumnRenamed(date, observed), [*by, observed]
    ).withColumn(
        "idx", F.explode(F.sequence(F.col("idx") - adjacent, F.col("idx") + adjacent))
    )
    label = F.concat_ws(
        "->", F.col(original).cast("string"), F.col(observed).cast("string")
    )
    return at.join(idx, [*by, "idx"]).groupBy(*by, date).agg(
        F.array(F.lit("TAX_WINDOW")).alias("flags"),
        F.array_sort(F.collect_set(kind)).alias("kinds"),
        F.array_sort(F.collect_set(source)).alias("sources"),
        F.array_sort(F.collect_set(label)).alias("deadlines"),
    )


def nearest_calendar_date(
    deadlines: DataFrame, calendar: DataFrame, *, reach: int = 7,
    by: Sequence[str] = ("calendar_id",), deadline: str = "deadline", date: str = "obs_date",
) -> DataFrame:
    """The nearest observed day within ±7 days on each side, else the next weekday."""
    days = calendar.select(*by, date).distinct()
    keys = deadlines.select(*by, deadline).distinct()
    probes = keys.select(
        *by, deadline, F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("_off")
    ).where("_off <> 0").withColumn(date, F.date_add(deadline, F.col("_off")))
    found = probes.join(days, [*by, date], "left_semi").groupBy(*by, deadline).agg(
        F.max(F.when(F.col("_off") < 0, F.col("_off"))).alias("_before"),
        F.min(F.when(F.col("_off") > 0, F.col("_off"))).alias("_after"),
    )
    return keys.join(found, [*by, deadline], "left").select(
        *by, deadline,
        F.coalesce(
            F.date_add(deadline, F.col("_before")),
            weekday_on_or_before(F.date_sub(deadline, 1)),
        ).alias("previous_date"),
        F.coalesce(
            F.date_add(deadline, F.col("_after")),
            weekday_on_or_after(F.date_add(deadline, 1)),
        ).alias("next_date"),
    )


def next_scheduled_release(
    states: DataFrame, schedule: DataFrame, *, on: str = "schedule_id",
    obs_date: str = "obs_date", released: str = "released_at",
) -> DataFrame:
    """Earliest scheduled release after the last release and the last observation.

    ``schedule`` (schedule_id, release_date, report_date) is a reviewed calendar:
    it travels as one array per calendar, so states are not multiplied.
    """
    slots = schedule.groupBy(on).agg(
        F.array_sort(F.collect_set(F.struct("release_date", "report_date"))).alias("_slots")
    )
    anchor = F.coalesce(F.col(released).cast("date"), F.col(obs_date))
    joined = states.withColumn("_anchor", anchor).join(slots, on, "left")
    due = F.filter(
        "_slots",
        lambda s: (s["release_date"] > F.col("_anchor")) & (s["report_date"] > F.col(obs_date)),
    )
    first = F.try_element_at(due, F.lit(1))
    return joined.select(
        *states.columns,
        first["release_date"].alias("next_release"),
        first["report_date"].alias("next_report"),
        F.col("_slots").isNotNull().alias("has_schedule"),
    )


# --- ordinals --------------------------------------------------------------


def ordinal_offset(
    obs: DataFrame, offsets: Sequence[int], *, by: Sequence[str] = ("series_id",),
    ordinal: str = "ordinal", value: str = "value",
) -> DataFrame:
    """Value exactly k ordinals earlier; across a gap it is null, unlike ``lag``."""
    w = Window.partitionBy(*by).orderBy(ordinal)
    return obs.select(
        "*", *[F.first(value).over(w.rangeBetween(-k, -k)).alias(f"{value}_t{k}") for k in offsets]
    )


def align_outer(
    obs: DataFrame, ids: Sequence[str], *, by: str = "series_id", date: str = "obs_date",
    value: str = "value",
) -> DataFrame:
    """Union of dates × series, null where a series has no row."""
    return obs.where(F.col(by).isin(*ids)).groupBy(date).pivot(by, list(ids)).agg(F.first(value))


# --- reviewed records ------------------------------------------------------


def entity_spans(
    records: DataFrame, *, by: Sequence[str] = ("metric_id",), entity: str = "company_id",
    as_of: str = "as_of", tie: Sequence[str], max_age_days: int = 120,
) -> DataFrame:
    """One row per record that is some day the latest of its entity, with its last such day in ``until``.

    A record is current from its own date until the day before its entity's next
    one, at most 120 days. Records of one day are first folded to the one that
    wins the tie, so a busy entity reaches its window as one row per day.
    """
    payload = [c for c in records.columns if c not in (*by, entity, as_of)]
    per_day = records.groupBy(*by, entity, as_of).agg(
        F.max_by(F.struct(*payload), F.struct(*tie)).alias("_row")
    ).select(*by, entity, as_of, *[F.col(f"_row.`{c}`").alias(c) for c in payload])
    w = Window.partitionBy(*by, entity).orderBy(as_of)
    last = F.date_add(as_of, max_age_days)
    return per_day.withColumn("until", F.least(last, F.coalesce(F.date_sub(F.lead(as_of).over(w), 1), last)))


def latest_per_entity_asof(
    records: DataFrame, *, by: Sequence[str] = ("metric_id",), entity: str = "company_id",
    as_of: str = "as_of", tie: Sequence[str], max_age_days: int = 120,
) -> DataFrame:
    """For each as-of date, the latest record per entity not older than 120 days.

    Each record meets the list of as-of dates from its own on, at most 121 of
    them, and is repeated for those in its span after the last shuffle. Counts
    per date need no repetition: see `aggregates.reviewed_observations`.
    """
    spans = entity_spans(records, by=by, entity=entity, as_of=as_of, tie=tie, max_age_days=max_age_days)
    ahead = (
        Window.partitionBy(*by).orderBy(F.unix_date(as_of)).rangeBetween(0, max_age_days)
    )
    dates = records.select(*by, as_of).distinct().select(*by, as_of, F.collect_list(as_of).over(ahead).alias("_dates"))
    payload = [c for c in records.columns if c not in (*by, entity, as_of)]
    return spans.join(dates, [*by, as_of]).select(
        *by, F.explode(F.filter("_dates", lambda d: d <= F.col("until"))).alias("asof_date"), entity, as_of, *payload
    )


def reconcile_records(
    records: DataFrame, filings: DataFrame, *, now, lookback_days: int,
    entity: str = "company_id", filing: str = "accession", as_of: str = "as_of",
    agree: Mapping[str, str],
) -> DataFrame:
    """Reviewed rows that disagree with filing metadata, with the reasons."""
    right = filings.groupBy(entity, filing).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max(c).alias(f"_f_{c}") for c in agree.values()],
    )
    cutoff = F.date_sub(F.lit(now).cast("date"), lookback_days)
    absent = F.col("_n").isNull()
    reasons = codes(
        [
            (absent & (F.col(as_of) >= cutoff), "ABSENT"),
            (F.col("_n") > 1, "DUPLICATE_METADATA"),
            *[
                ((F.col("_n") == 1) & ~F.col(a).eqNullSafe(F.col(f"_f_{b}")), f"MISMATCH_{a.upper()}")
                for a, b in agree.items()
            ],
        ]
    )
    return records.join(right, [entity, filing], "left").select(
        *records.columns, reasons.alias("reasons")
    ).where(F.size("reasons") > 0)


def review_queue(
    entities: DataFrame, metrics: Sequence[str], records: DataFrame, filings: DataFrame, *,
    now, overdue_days: int, lookback_days: int, entity: str = "company_id",
    metric: str = "metric_id", filing: str = "accession", as_of: str = "as_of",
    tie: Sequence[str], accepted: str = "accepted_at", reviewed: str = "reviewed_at",
) -> DataFrame:
    """Open review work per (entity, metric), with reasons and candidate count.

    The grid comes from exploding the metric list on each entity. Candidates are
    counted here; :func:`review_candidates` lists them one per row.
    """
    grid = entities.select(
        entity, F.explode(F.array(*[F.lit(m) for m in metrics])).alias(metric)
    ).distinct()
    latest = records.groupBy(entity, metric).agg(
        F.max_by(
            F.struct(as_of, reviewed, filing), F.struct(*tie)
        ).alias("_latest")
    )
    newer = review_candidates(
        metrics, records, filings, now=now, lookback_days=lookback_days, entity=entity,
        metric=metric, filing=filing, accepted=accepted,
    ).groupBy(entity, metric).agg(
        F.count(F.lit(1)).alias("_newer"), F.max(accepted).alias("newest_candidate_at")
    )
    joined = grid.join(latest, [entity, metric], "left").join(newer, [entity, metric], "left")
    age = F.datediff(F.lit(now).cast("date"), F.col(f"_latest.{as_of}"))
    reasons = codes(
        [
            (F.col("_latest").isNull(), "NO_REVIEWED_ROW"),
            (age > overdue_days, "REVIEW_OVERDUE"),
            (F.col("_newer") > 0, "NEW_FILING"),
        ]
    )
    return joined.select(
        entity, metric, reasons.alias("reasons"),
        F.col(f"_latest.{reviewed}").alias("latest_reviewed_at"),
        F.col(f"_latest.{filing}").alias("latest_reviewed_filing"),
        F.coalesce("_newer", F.lit(0)).alias("candidate_count"), "newest_candidate_at",
    ).where(F.size("reasons") > 0)


def review_candidates(
    metrics: Sequence[str], records: DataFrame, filings: DataFrame, *, now,
    lookback_days: int, entity: str = "company_id", metric: str = "metric_id",
    filing: str = "accession", accepted: str = "accepted_at",
) -> DataFrame:
    """Recent filings not yet reviewed for a metric, one row per (metric, filing)."""
    since = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(lookback_days))
    recent = filings.where(F.col(accepted) > since).select(
        entity, filing, accepted,
        F.explode(F.array(*[F.lit(m) for m in metrics])).alias(metric),
    )
    return recent.join(
        records.select(entity, metric, filing), [entity, metric, filing], "left_anti"
    )


def same_date_difference(
    weekly: DataFrame, daily: DataFrame, *, by: Sequence[str] = ("check_id",),
    date: str = "obs_date", value: str = "value",
) -> DataFrame:
    """Absolute difference of two valued series on common dates."""
    return inner_on(weekly, daily, [*by, date], value=value).select(
        *by, date, F.abs(F.col("left_value") - F.col("right_value")).alias("difference")
    )


def keep(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(F.coalesce(condition, F.lit(False)))
