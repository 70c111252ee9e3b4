"""Point-in-time feature store over rolling round windows.

For every race date the store describes each active entrant by what happened
strictly before it, over the whole past and over the last N rounds. Joining
every date with every earlier result is quadratic in history. Instead:

* the calendar alone decides on which date a round enters and leaves a window,
  so those entries and exits are worked out on the calendar (one row per date);
* results are reduced to one row of partial sums per (entrant, round date);
* each partial gets the list of its entry (+) and exit (-) dates by an equi join
  with the calendar, what falls between two of the entrant's dates is added up, and
  one running sum per entrant gives all windows.

Work grows with results and output rows, not with their product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from pitwall.functions.metrics import METRICS, NAMES, SCORING, SEASONS
from pitwall.plans.lake import cut, small

# Window suffix -> rounds; None is the whole career.
WINDOWS: dict[str, int | None] = {"life": None, "last10": 10, "last20": 20, "last40": 40}
FEATURE_COLUMNS = [f"{m}_{k}" for k in WINDOWS for m in NAMES]  # of the store over all windows, in its order
ACTIVE_YEARS = 2
ROUND = ["year", "round_number", "event_date"]


def _before() -> Column:
    """A date before any race: a career carried along is there from the start."""
    return F.lit("0001-01-01").cast("date")


def scoring(results: DataFrame) -> DataFrame:
    return results.where(F.col("mode").isin(*SCORING))


def race_dates(results: DataFrame) -> DataFrame:
    """Reference dates: each date with a race or sprint."""
    return scoring(results).select(F.col("event_date").alias("dt_ref"),
                                   F.col("year").alias("ref_year")).distinct()


def calendar_slots(results: DataFrame) -> DataFrame:
    """Distinct (year, round, date) of any session, oldest first."""
    return results.select(*ROUND).distinct()


def numbered_days(results: DataFrame) -> DataFrame:
    """Every day of the calendar with the number of race dates up to it, and of all.

    A state that changes on some days holds for the race dates numbered from one
    change's number + 1 to the next one's. One row per date.
    """
    refs = race_dates(results).select(F.col("dt_ref").alias("event_date"), F.lit(1).alias("is_ref")).distinct()
    days = results.select("event_date").distinct().join(refs, "event_date", "left").fillna(0, ["is_ref"])
    upto = W.orderBy("event_date").rowsBetween(W.unboundedPreceding, 0)
    whole = W.orderBy("event_date").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return days.select("event_date", "is_ref", F.sum("is_ref").over(upto).cast("int").alias("n"),
                       F.sum("is_ref").over(whole).cast("int").alias("n_all"))


def spread(spans: DataFrame, first: Column, last: Column, refs: DataFrame, keys: list[str] = []) -> DataFrame:
    """Repeat each row for the reference dates numbered ``first`` to ``last``; adds dt_ref.

    ``refs`` holds the number ``i`` and ``dt_ref``, within ``keys`` if there are any.
    """
    spans = spans.withColumns({"__first": first, "__last": last}).where("__first <= __last")
    spans = spans.withColumn("i", F.explode(F.sequence("__first", "__last"))).drop("__first", "__last")
    return spans.join(refs, [*keys, "i"]).drop("i")


def _next_refs(slots: DataFrame, dates: DataFrame) -> DataFrame:
    """The first reference date after each day of the calendar."""
    refs = dates.select(F.col("dt_ref").alias("event_date"), F.col("dt_ref")).distinct()
    later = W.orderBy("event_date").rowsBetween(1, W.unboundedFollowing)
    return slots.select("event_date").distinct().join(refs, "event_date", "left").select(
        "event_date", F.min("dt_ref").over(later).alias("next_ref"))


def _schedule(slots: DataFrame, dates: DataFrame, windows: dict[str, int | None],
              weighting: str) -> DataFrame:
    """When each round date enters (+) and leaves (-) each window.

    A round counts once per slot it has in the window ("slot"), or once
    ("round"). Everything here has at most one row per calendar date, so the
    windows without a partition key stay calendar-sized.
    """
    order = W.orderBy("event_date", "year", "round_number")
    after = order.rowsBetween(1, W.unboundedFollowing)
    days = _next_refs(slots, dates)
    bounded = {s: n for s, n in windows.items() if n}
    s = slots.select(*ROUND, *[F.lead("event_date", n).over(order).alias(f"x_{k}")
                               for k, n in bounded.items()])
    for k in bounded:
        s = s.join(days.select(F.col("event_date").alias(f"x_{k}"),
                               F.col("next_ref").alias(f"out_{k}")), f"x_{k}", "left").drop(f"x_{k}")

    # A slot of the round makes every earlier-or-later date of it count, once past.
    pair = s.withColumnRenamed("event_date", "slot_date").join(slots, ["year", "round_number"])
    pair = pair.withColumn("from_date", F.greatest("slot_date", "event_date"))
    pair = pair.join(days.select(F.col("event_date").alias("from_date"),
                                 F.col("next_ref").alias("in_ref")), "from_date")
    pair = pair.where(F.col("in_ref").isNotNull())

    zero = [F.lit(0).alias(f"w_{k}") for k in windows]

    def marks(at: Column, weight: dict[str, Column]) -> DataFrame:
        return pair.select(*ROUND, at.alias("at"),
                           *[weight.get(k, F.lit(0)).alias(f"w_{k}") for k in windows])

    def stays(k):
        out = F.col(f"out_{k}")
        return out.isNull() | (F.col("in_ref") < out)

    enter = {k: F.when(stays(k), 1).otherwise(0) if k in bounded else F.lit(1) for k in windows}
    rows = marks(F.col("in_ref"), enter)
    for k in bounded:
        leave = marks(F.col(f"out_{k}"), {k: F.when(stays(k), -1).otherwise(0)})
        rows = rows.unionByName(leave.where(F.col("at").isNotNull()))
    weights = [f"w_{k}" for k in windows]
    rows = rows.groupBy(*ROUND, "at").agg(*[F.sum(w).cast("int").alias(w) for w in weights])
    if weighting == "round":
        w = W.partitionBy(*ROUND).orderBy("at")
        so_far = w.rowsBetween(W.unboundedPreceding, 0)
        rows = rows.withColumns({c: F.least(F.sum(c).over(so_far), F.lit(1)) for c in weights})
        rows = rows.withColumns({c: (F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))).cast("int")
                                 for c in weights})
    return rows.where(" OR ".join(f"{c} <> 0" for c in weights))


def _own_schedule(partials: DataFrame, slots: DataFrame, dates: DataFrame, entity: str,
                  windows: dict[str, int | None]) -> DataFrame:
    """The same entries and exits when "last N" counts the entrant's own rounds."""
    bounded = {s: n for s, n in windows.items() if n}
    own = W.partitionBy(entity).orderBy("event_date", "year", "round_number")
    p = partials.withColumns({f"x_{k}": F.lead("event_date", n).over(own) for k, n in bounded.items()})
    entry = F.struct(F.col("event_date").alias("d"),
                     *[F.lit(1).alias(f"w_{k}") for k in windows])
    exits = [F.struct(F.col(f"x_{k}").alias("d"),
                      *[F.lit(-1 if j == k else 0).alias(f"w_{j}") for j in windows]) for k in bounded]
    p = p.withColumn("m", F.explode(F.array(entry, *exits))).drop(*[f"x_{k}" for k in bounded])
    p = p.where(F.col("m.d").isNotNull())
    # Entries and exits fall on days of the calendar, each with its next reference date.
    days = _next_refs(slots, dates).select(F.col("event_date").alias("d"), F.col("next_ref").alias("dt_ref"))
    days = days.where(F.col("dt_ref").isNotNull())
    return (p.withColumn("d", F.col("m.d")).join(small(days), "d")
            .select(*[c for c in partials.columns], F.col("dt_ref").alias("at"),
                    *[F.col(f"m.w_{k}").alias(f"w_{k}") for k in windows]))


def active(results: DataFrame, entity: str = "driverid") -> DataFrame:
    """(entrant, race date) pairs with a past session of the last years."""
    first = results.groupBy(entity, "year").agg(F.min("event_date").alias("first_date"))
    later = F.explode(F.sequence(F.col("year"), F.col("year") + ACTIVE_YEARS)).alias("ref_year")
    first = first.select(entity, "first_date", later)
    first = first.groupBy(entity, "ref_year").agg(F.min("first_date").alias("first_date"))
    dates = small(race_dates(results))
    return (first.join(dates, "ref_year").where(F.col("first_date") < F.col("dt_ref"))
            .select(entity, "dt_ref"))


def _doubles(results: DataFrame) -> set[str]:
    return {f.name for f in results.schema.fields
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))}


def _partials(results: DataFrame, entity: str, only: set[str] | None = None) -> DataFrame:
    """One row per entrant and round date with the sums of every metric in ``p``, or of ``only`` these, kept together by entrant."""
    doubles = _doubles(results)
    cols = {n: e for m in METRICS for n, e in m.partials(doubles).items() if only is None or n in only}
    # sessions are moved before they become sums: there are few more of them, and they are much narrower
    return results.repartition(entity).groupBy(entity, *ROUND).agg(
        *[F.expr(f"coalesce({e}, 0L) AS {n}") for n, e in cols.items()])


def feature_store(results: DataFrame, windows: dict[str, int | None] = WINDOWS,
                  entity: str = "driverid", weighting: str = "slot",
                  scope: str = "calendar", career: DataFrame | None = None,
                  since: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Metrics of every window per (race date, active entrant).

    Rows need at least one session in each window, as an inner join of the
    single-window stores would keep. ``scope="entity"`` counts the entrant's own
    rounds; ``weighting="round"`` counts each session once.

    ``career`` holds the sums of all seasons before those in ``results`` (see
    ``career_sums``), which then only have to reach as far back as the bounded windows
    and activity do; ``since`` leaves out earlier race dates. With ``columns`` only these
    metrics are worked out, for the same rows.
    """
    dates = small(race_dates(results))
    doubles = _doubles(results)

    def wanted(name: str) -> bool:
        return columns is None or name in columns

    metrics = {k: [m for m in METRICS if wanted(f"{m.name}_{k}")] for k in windows}
    seasons = [k for k in windows if wanted(f"{SEASONS}_{k}")]
    sums = {k: list(dict.fromkeys(["c_qtd_sessions", *[n for m in metrics[k] for n in m.partials(doubles)]])) for k in windows}
    partials = _partials(results, entity, {n for k in windows for n in sums[k]})

    weights = [f"w_{k}" for k in windows]
    mark = F.struct("at", *weights)
    if scope == "entity":
        marked = _own_schedule(partials, calendar_slots(results), dates, entity, windows).withColumn("marks", F.array(mark))
    else:
        plan = _schedule(cut(calendar_slots(results)), dates, windows, weighting)
        marked = partials.join(small(plan.groupBy(*ROUND).agg(F.collect_list(mark).alias("marks"))), ROUND)
    grid = active(results, entity)
    if since:
        grid = grid.where(F.col("dt_ref") >= F.lit(since).cast("date"))

    # What changes up to a date, one row per entrant and date with the sums of all windows side by side.
    # Columns stand in the order in which the running sums read them: put in another order between shuffle and
    # sort, a row of some 80 columns goes through one generated method too long for the JIT.
    names = list(dict.fromkeys(n for k in windows for n in sums[k]))
    given = marked.select(entity, "year", "marks", *names).unionByName(
        grid.groupBy(entity).agg(F.collect_list("dt_ref").alias("dates")), allowMissingColumns=True)
    columns_out = [*[f"v_{k}_{n}" for k in windows for n in sums[k]], *[f"y_w_{k}" for k in seasons]]
    schema = T.StructType([T.StructField(entity, results.schema[entity].dataType), T.StructField("at", T.DateType()),
                           T.StructField("is_row", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in columns_out]])
    # Both sides of the union are kept by entrant already, in parts that need not be the same: dealt by a hash, they are always dealt anew.
    rows = given.repartition(F.xxhash64(entity)).sortWithinPartitions(entity).mapInArrow(_changes(entity, sums, seasons), schema)
    unbounded = [k for k, n in windows.items() if n is None] if career is not None else []
    if unbounded:
        rows = rows.unionByName(career.select(
            entity, _before().alias("at"), F.lit(0).alias("is_row"),
            *[F.col(n).alias(f"v_{k}_{n}") for k in unbounded for n in sums[k]],
            *[F.col("seasons").alias(f"y_w_{k}") for k in unbounded if k in seasons]), allowMissingColumns=True)
    # Branches of a union that are each kept by entrant are not put side by side in every plan: they are dealt together.
    upto = (f"OVER (PARTITION BY {entity} ORDER BY at, is_row "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    picked = rows.repartition(entity).selectExpr(
        entity, "at", "is_row",
        *[f"sum(v_{k}_{n}) {upto} AS v_{k}_{n}" for k in windows for n in sums[k]],
        *[f"bigint(sum(y_w_{k}) {upto}) AS {SEASONS}_{k}" for k in seasons],
    ).where("is_row > 0")
    for k in windows:
        picked = picked.where(f"v_{k}_c_qtd_sessions > 0")
    out = [f"at AS dt_ref", entity]
    for k in windows:
        out += [f"{SEASONS}_{k}"] if k in seasons else []
        out += [f"{m.total(lambda n: f'v_{k}_{n}', doubles)} AS {m.name}_{k}" for m in metrics[k]]
    return picked.selectExpr(*out)


def career_sums(results: DataFrame, entity: str = "driverid", weighting: str = "slot") -> DataFrame:
    """What each season adds to an entrant's career: the weighted sums of its rounds, and ``seasons``, 1 or 0.

    Every date of a round counts once for each slot of the round, as it does once the season is past.
    """
    partials = _partials(results, entity)
    names = [c for c in partials.columns if c not in (entity, *ROUND)]
    if weighting == "slot":
        slots = calendar_slots(results).groupBy("year", "round_number").agg(F.count(F.lit(1)).alias("w"))
        partials = partials.join(small(slots), ["year", "round_number"])
    else:
        partials = partials.withColumn("w", F.lit(1))
    return partials.groupBy(entity, "year").agg(
        (F.sum("c_qtd_sessions") > 0).cast("bigint").alias("seasons"), *[F.sum(F.col("w") * F.col(n)).alias(n) for n in names])


def _changes(entity: str, sums: dict[str, list[str]], seasons: list[str]) -> Callable:
    """Batches ordered by entrant to one row per entrant and reference date with what changed since its date before.

    A row has either ``marks``, the dates at which its sums enter (+) and leave (-) windows, or ``dates``, those asked
    for. A date asked for twice gives rows with is_row 1 and 2, the second without changes. ``seasons`` names the windows
    whose years are counted: +1 when a year first has a session in the window, -1 when it has none left.
    """
    def laid_out(t: pa.Table) -> pa.RecordBatch:
        key = t[entity].combine_chunks().dictionary_encode("encode")
        code = key.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        marks, dates = t["marks"].combine_chunks(), t["dates"].combine_chunks()
        row, found = pc.list_parent_indices(marks).to_numpy(), pc.list_flatten(marks)
        at = pc.struct_field(found, "at").cast(pa.int32()).to_numpy().astype(np.int64)
        asked, day = pc.list_parent_indices(dates).to_numpy(), pc.list_flatten(dates).cast(pa.int32()).to_numpy().astype(np.int64)
        low = min(at.min(initial=0), day.min(initial=0))
        span = max(at.max(initial=0), day.max(initial=0)) - low + 2
        grid = np.sort(code[asked] * span + day - low)
        first = np.r_[True, grid[1:] != grid[:-1]][:len(grid)]
        begin = np.flatnonzero(first)
        nth = np.arange(len(grid)) - begin[np.cumsum(first) - 1] + 1 if len(grid) else grid

        # each mark counts from the entrant's next date on; those after its last one change nothing
        when = code[row] * span + at - low
        spot = np.searchsorted(grid, when)
        kept = np.flatnonzero(spot < len(grid))
        kept = kept[grid[spot[kept]] // span == code[row[kept]]]
        kept = kept[np.argsort(spot[kept], kind="stable")]
        values = {n: pc.fill_null(t[n].combine_chunks(), 0).to_numpy() for n in dict.fromkeys(x for k in sums for x in sums[k])}
        weight = {k: pc.struct_field(found, f"w_{k}").to_numpy().astype(np.int64) for k in sums}
        out = {entity: key.dictionary.take(pa.array(grid // span)), "at": pa.array((grid % span + low).astype(np.int32)).cast(pa.date32()),
               "is_row": pa.array(nth.astype(np.int32))}
        for k in sums:
            some = kept[weight[k][kept] != 0]
            w, r, to = weight[k][some], row[some], spot[some]
            starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]][:len(to)])
            for n in sums[k]:
                v = np.zeros(len(grid), np.int64)
                if len(starts):
                    v[to[starts]] = np.add.reduceat(values[n][r] * w, starts)
                out[f"v_{k}_{n}"] = pa.array(v)

        if seasons:
            year = pc.fill_null(t["year"].combine_chunks().cast(pa.int64()), -1 << 40).to_numpy()
            order = np.lexsort((when, year[row]))  # the entrant's number is the upper part of ``when``
            order = order[np.argsort(code[row[order]], kind="stable")]
            own, y, when_y, r = code[row[order]], year[row[order]], when[order], row[order]
            fresh = np.r_[True, (own[1:] != own[:-1]) | (y[1:] != y[:-1])][:len(order)]
            last = np.r_[fresh[1:] | (when_y[1:] != when_y[:-1]), True][:len(order)]
            begin = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(order) else order
            place = np.searchsorted(grid, when_y[last])
        for k in seasons:
            upto = np.r_[0, np.cumsum(weight[k][order] * values["c_qtd_sessions"][r])]
            there = (upto[1:] - upto[begin] > 0)[last].astype(np.int64)
            start = np.r_[True, np.diff(begin[last]) != 0][:len(there)]
            turn = there - np.where(start, 0, np.r_[0, there[:-1]][:len(there)])
            ok = (turn != 0) & (place < len(grid))
            ok[ok] = grid[place[ok]] // span == own[last][ok]
            v = np.zeros(len(grid), np.int64)
            np.add.at(v, place[ok], turn[ok])
            out[f"y_w_{k}"] = pa.array(v)
        return pa.RecordBatch.from_pydict(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            # the last entrant of a batch may go on in the next one
            codes = batch[batch.schema.get_field_index(entity)].dictionary_encode("encode").indices
            cut_at = codes.index(codes[-1]).as_py()
            if held and cut_at == 0 and held[-1][entity][-1].as_py() == batch[entity][-1].as_py():
                held.append(batch)
                continue
            done = pa.Table.from_batches([*held, batch.slice(0, cut_at)])
            if len(done):
                yield laid_out(done)
            held = [batch.slice(cut_at)]
        if held:
            yield laid_out(pa.Table.from_batches(held))

    return run


def driver_window(results: DataFrame, rounds: int | None, suffix: str, **options) -> DataFrame:
    return feature_store(results, {suffix: rounds}, **options)


def join_windows(stores: list[DataFrame], keys: list[str]) -> DataFrame:
    """Inner join of single-window stores on their keys."""
    out = stores[0]
    for s in stores[1:]:
        out = out.join(s, keys)
    return out


def recent_slots(results: DataFrame, n: int) -> DataFrame:
    """The last ``n`` slots before each race date, newest first.

    Slots are numbered once; each date then names the numbers it wants, so the
    dates are never compared with all slots.
    """
    order = W.orderBy("event_date", "year", "round_number")
    slots = cut(calendar_slots(results)).withColumn("i", F.row_number().over(order))
    upto = slots.groupBy("event_date").agg(F.max("i").alias("i"))
    before = W.orderBy("event_date").rowsBetween(W.unboundedPreceding, -1)
    upto = upto.select(F.col("event_date").alias("dt_ref"), F.max("i").over(before).alias("m"))
    wanted = small(race_dates(results)).join(upto.where("m IS NOT NULL"), "dt_ref").select(
        "dt_ref", "m", F.explode(F.sequence(F.greatest(F.lit(1), F.col("m") - n + 1), F.col("m"))).alias("i"))
    return wanted.join(slots, "i").select(
        "dt_ref", *ROUND, (F.col("m") - F.col("i") + 1).alias("back"))


def slot_weights(results: DataFrame, n: int) -> DataFrame:
    """How often each round counts among the last ``n`` slots of each date."""
    return recent_slots(results, n).groupBy("dt_ref", "year", "round_number").agg(
        F.count(F.lit(1)).alias("weight"))
