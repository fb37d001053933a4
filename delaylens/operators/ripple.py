"""Follow-on delays: which surface events come within an hour of a subway incident."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delaylens.functions import scalars as S
from delaylens.operators.joins import band_pairs, band_totals, instant_totals, lookup
from delaylens.operators.ordered import quantiles, running, top_k
from delaylens.session import materialize

# Fixed value: station keys of the operator's own premises hold this text and are skipped.
OPERATOR_PREMISES = "TORONTO TRANSIT"
WINDOW_MINUTES = 60
# Sums that are subtracted again are kept in decimal: exact and independent of the order.
EXACT = "decimal(18,9)"
EXACT_HISTORY = "decimal(28,18)"


def eligible(subway: DataFrame, surface: DataFrame) -> DataFrame:
    """Incidents at stations that have any surface event at all."""
    stations = surface.select("station_key").distinct()
    return _outside(subway).join(stations, "station_key", "left_semi")


def _outside(subway: DataFrame) -> DataFrame:
    return subway.filter(~F.col("station_key").contains(OPERATOR_PREMISES))


def _minutes(col: str) -> Column:
    return F.coalesce(S.nan_to_null(col), F.lit(0.0))


def matched_pairs(
    subway: DataFrame, surface: DataFrame, minutes: int = WINDOW_MINUTES, form: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """One row per incident and surface event in its window.

    ``form`` gives columns their final types and is applied to both feeds, once per row instead of once
    per pair; offsets are then rounded to 6 digits.
    """
    left = _outside(subway).select(
        F.col("_id").alias("subway_id"),
        "station_key",
        F.col("timestamp").alias("subway_timestamp"),
        S.upper_code("code").alias("subway_code"),
        F.col("line").alias("subway_line"),
    )
    right = surface.select(
        "station_key",
        F.col("timestamp").alias("surface_timestamp"),
        "mode",
        _minutes("min_delay").alias("surface_delay"),
        _minutes("min_gap").alias("surface_gap"),
        F.col("line").alias("surface_line"),
        F.col("station_key").alias("surface_station_key"),
        S.upper_code("code").alias("surface_code"),
    )
    pairs = band_pairs(left, right, "station_key", "subway_timestamp", "surface_timestamp", minutes, form)
    gap = F.col("_right_us") - F.col("_left_us")
    # 60 microseconds are a millionth of a minute: rounded half up without a detour over decimals.
    offset = gap / F.lit(60e6) if form is None else (gap + 30 - F.pmod(gap + 30, F.lit(60))) / F.lit(60) / F.lit(1e6)
    return pairs.select(
        "subway_id", "station_key", "subway_timestamp", "subway_code", "subway_line",
        "surface_timestamp", "mode", "surface_delay", "surface_gap", "surface_line",
        "surface_station_key", "surface_code", offset.alias("offset_minutes"),
    )


def incidents(subway: DataFrame, surface: DataFrame, minutes: int = WINDOW_MINUTES) -> DataFrame:
    """Every eligible incident with count, delay, mode mix and last offset of its window.

    Totals depend on station and time alone, so they are computed once per distinct pair
    and joined back; two incidents with the same id stay two rows.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    events = instant_totals(
        surface,
        "station_key",
        "timestamp",
        {
            "matched_surface_events": one,
            "_delay": _minutes("min_delay").cast(EXACT),
            "bus_hits": F.when(F.col("mode") == "bus", one).otherwise(none),
            "streetcar_hits": F.when(F.col("mode") == "streetcar", one).otherwise(none),
        },
    )
    rows = materialize(
        eligible(subway, events).select(
            F.col("_id").alias("subway_id"),
            "station_key",
            F.col("timestamp").alias("subway_timestamp"),
            S.upper_code("code").alias("subway_code"),
            F.col("line").alias("subway_line"),
            _minutes("min_delay").alias("subway_delay"),
            S.nan_to_null("min_delay").alias("_raw_delay"),
        )
    )
    totals = band_totals(rows, events, "station_key", "subway_timestamp", "timestamp", 0, minutes)
    offset = S.minutes_between("last_ts", "subway_timestamp")
    return rows.join(totals, ["station_key", "subway_timestamp"], "left").select(
        *rows.columns,
        F.coalesce("matched_surface_events", F.lit(0)).alias("matched_surface_events"),
        F.coalesce(F.col("_delay").cast("double"), F.lit(0.0)).alias("matched_surface_delay"),
        F.coalesce(offset, F.lit(0.0)).alias("max_offset_minutes"),
        F.coalesce("bus_hits", F.lit(0)).alias("bus_hits"),
        F.coalesce("streetcar_hits", F.lit(0)).alias("streetcar_hits"),
    )


def station_impacts(found: DataFrame) -> DataFrame:
    """Per station: incidents, linked surface events and delay, ratios, mean subway delay."""
    n, events = F.col("subway_incidents"), F.col("surface_events_in_window")
    totals = found.groupBy("station_key").agg(
        F.count("*").alias("subway_incidents"),
        F.sum("matched_surface_events").alias("surface_events_in_window"),
        F.sum(F.col("matched_surface_delay").cast(EXACT)).cast("double").alias("surface_delay_minutes"),
        F.sum("bus_hits").alias("bus_hits"),
        F.sum("streetcar_hits").alias("streetcar_hits"),
        F.try_divide(
            F.sum(F.col("_raw_delay").cast(EXACT)).cast("double"), F.count("_raw_delay")
        ).alias("avg_subway_delay"),
    )
    return totals.filter(events > 0).withColumns(
        {
            "surface_events_per_subway": events / n,
            "avg_surface_delay_per_subway": F.col("surface_delay_minutes") / n,
        }
    )


def station_top_codes(found: DataFrame, codebook: DataFrame, k: int = 3) -> DataFrame:
    """The most frequent codes per station as one text, ties in code order."""
    counts = found.groupBy("station_key", "subway_code").agg(F.count("*").alias("n"))
    best = Window.partitionBy("station_key").orderBy(F.desc("n"), "subway_code")
    ranked = counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    named = lookup(ranked, codebook, "subway_code", "code", "description", "Unknown")
    text = S.clean_ascii(F.concat("subway_code", F.lit(": "), "description"))
    listed = named.groupBy("station_key").agg(
        F.sort_array(F.collect_list(F.struct("rank", text.alias("text")))).alias("codes")
    )
    return listed.select("station_key", F.array_join(F.col("codes.text"), "; ").alias("top_codes"))


def headline(subway: DataFrame, surface: DataFrame, impacts: DataFrame) -> DataFrame:
    """The figures of the ripple report in one row."""
    events = quantiles(impacts, "surface_events_per_subway", {"median_events": 0.5}).first()
    delay = quantiles(impacts, "avg_surface_delay_per_subway", {"median_delay": 0.5}).first()
    size = impacts.agg(
        F.count("*").alias("stations_linked"),
        F.coalesce(F.try_divide(F.sum("bus_hits"), F.sum("surface_events_in_window")), F.lit(0.0)).alias(
            "bus_share"
        ),
    )
    most = top_k(impacts, "surface_events_per_subway", 1, "station_key")
    peak = top_k(impacts, "avg_surface_delay_per_subway", 1, "station_key")
    tag = F.lit(1).alias("_row")
    parts = [
        subway.agg(F.count("*").alias("subway_incidents")),
        surface.agg(F.count("*").alias("surface_events")),
        size,
        most.select(
            F.col("station_key").alias("top_station"),
            F.col("surface_events_per_subway").alias("top_events_per_subway"),
            F.col("avg_surface_delay_per_subway").alias("top_delay_per_subway"),
        ),
        peak.select(
            F.col("station_key").alias("peak_delay_station"),
            F.col("avg_surface_delay_per_subway").alias("peak_delay_per_subway"),
        ),
    ]
    out = parts[0].withColumn("_row", tag)
    for part in parts[1:]:
        out = out.join(part.withColumn("_row", tag), "_row", "left")
    return out.drop("_row").withColumns(
        {
            "median_events_per_subway": F.lit(events["median_events"] if events else None).cast("double"),
            "median_delay_per_subway": F.lit(delay["median_delay"] if delay else None).cast("double"),
        }
    )


def focus_station(impacts: DataFrame) -> DataFrame:
    return top_k(impacts, "surface_events_in_window", 1, "station_key").select(
        "station_key", "surface_events_in_window"
    )


def busiest_day(found: DataFrame, station: DataFrame) -> DataFrame:
    """Day of the station's incidents with most linked events, the earliest on a tie."""
    days = (
        found.join(F.broadcast(station.select("station_key")), "station_key", "left_semi")
        .filter(F.col("matched_surface_events") > 0)
        .groupBy("station_key", F.col("subway_timestamp").cast("date").alias("day"))
        .agg(F.sum("matched_surface_events").alias("pairs"))
    )
    return top_k(days, "pairs", 1, "day")


def timeline(found: DataFrame, surface: DataFrame, day: DataFrame, minutes: int = WINDOW_MINUTES) -> DataFrame:
    """15-minute timeline of one station and day, quiet steps filled with zeros.

    A surface event counts once per incident that reaches it; the number of such
    incidents comes from the same sweep, run backwards.
    """
    chosen = F.broadcast(day.select("station_key", "day"))
    subway_day = found.withColumn("day", F.col("subway_timestamp").cast("date")).join(
        chosen, ["station_key", "day"], "left_semi"
    )
    at_station = surface.join(F.broadcast(day.select("station_key")), "station_key", "left_semi")
    starts_at = instant_totals(
        subway_day, "station_key", "subway_timestamp", {"times": F.lit(1).cast("bigint")}
    )
    reach = band_totals(
        at_station, starts_at, "station_key", "timestamp", "subway_timestamp", -minutes, 0
    ).filter(F.col("times") > 0)
    linked = at_station.join(reach.select("station_key", "timestamp", "times"), ["station_key", "timestamp"])

    starts = subway_day.groupBy("station_key", quarter_hour("subway_timestamp").alias("slot")).agg(
        F.count("*").alias("subway_incidents"),
        F.max("subway_timestamp").alias("_last_start"),
    )
    follows = linked.groupBy("station_key", quarter_hour("timestamp").alias("slot")).agg(
        F.sum("times").alias("surface_events"),
        F.sum(_minutes("min_delay") * F.col("times")).alias("surface_delay"),
        F.max("timestamp").alias("_last_follow"),
    )
    # One station and day: at most about a hundred slots from here on.
    both = starts.join(follows, ["station_key", "slot"], "full_outer")
    last = F.greatest(F.max("_last_start"), F.max("_last_follow"))
    quarter = F.make_dt_interval(mins=F.lit(15))
    bounds = both.groupBy("station_key").agg(F.min("slot").alias("lo"), last.alias("last"))
    hi = F.when(quarter_hour("last") == F.col("last"), F.col("last")).otherwise(quarter_hour("last") + quarter)
    grid = bounds.select("station_key", F.explode(F.sequence("lo", hi, quarter)).alias("slot"))
    filled = grid.join(both, ["station_key", "slot"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    so_far = Window.partitionBy("station_key").orderBy("slot")
    return filled.select(
        "station_key", "slot", zero("subway_incidents"), zero("surface_events"),
        F.coalesce("surface_delay", F.lit(0.0)).alias("surface_delay"),
    ).withColumn("cumulative_delay", F.sum("surface_delay").over(so_far))


def quarter_hour(ts: str | Column) -> Column:
    """Start of the 15-minute step a timestamp falls in."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return t - F.make_dt_interval(mins=F.minute(t) % 15, secs=F.extract(F.lit("SECOND"), t))


def by_code(found: DataFrame, codebook: DataFrame, min_incidents: int = 30, k: int = 12) -> DataFrame:
    """Ripple strength by subway code, the k strongest with their label."""
    stats = (
        found.groupBy("subway_code")
        .agg(
            F.count("subway_id").alias("total_incidents"),
            F.avg((F.col("matched_surface_events") > 0).cast("int")).alias("share_with_surface"),
            F.avg("matched_surface_events").alias("avg_surface_events"),
            F.avg("matched_surface_delay").alias("avg_surface_delay"),
        )
        .filter(F.col("total_incidents") >= min_incidents)
    )
    named = lookup(stats, codebook, "subway_code", "code", "description", "Unknown")
    label = F.concat("subway_code", F.lit(" - "), S.clean_ascii("description"))
    return top_k(named.withColumn("label", label).drop("description"), "avg_surface_events", k, "subway_code")


def weekday_hour_matrix(found: DataFrame) -> DataFrame:
    """Linked events by weekday (rows, Monday first) and hour (24 columns)."""
    linked = found.filter(F.col("matched_surface_events") > 0)
    wide = (
        linked.groupBy(F.weekday("subway_timestamp").alias("weekday_no"))
        .agg(
            F.max(S.day_name("subway_timestamp")).alias("day_name"),
            *[
                F.sum(
                    F.when(F.hour("subway_timestamp") == h, F.col("matched_surface_events")).otherwise(0)
                ).alias(f"h{h:02d}")
                for h in range(24)
            ],
        )
    )
    return wide


def peak_slot(found: DataFrame) -> DataFrame:
    """The weekday and hour with most linked events, first in weekday and hour order."""
    cells = (
        found.filter(F.col("matched_surface_events") > 0)
        .groupBy(
            F.weekday("subway_timestamp").alias("weekday_no"),
            S.day_name("subway_timestamp").alias("day_name"),
            F.hour("subway_timestamp").alias("hour"),
        )
        .agg(F.sum("matched_surface_events").alias("events"))
    )
    return top_k(cells, "events", 1, "weekday_no", "hour")


def recovery(found: DataFrame, k: int = 10) -> DataFrame:
    """Mean minutes until the last linked event, per station with a ripple."""
    means = (
        found.filter(F.col("matched_surface_events") > 0)
        .groupBy("station_key")
        .agg(F.avg("max_offset_minutes").alias("avg_recovery_minutes"))
    )
    return top_k(means, "avg_recovery_minutes", k, "station_key")


# --- history features -----------------------------------------------------------------------


def labelled(found: DataFrame, calendar_ts: str | Column = "subway_timestamp") -> DataFrame:
    """Incidents with calendar columns, targets and labels."""
    at = F.col(calendar_ts) if isinstance(calendar_ts, str) else calendar_ts
    named = found.select(
        F.col("subway_id").alias("incident_id"),
        F.coalesce("station_key", F.lit("UNKNOWN_STATION")).alias("station_key"),
        "subway_timestamp",
        F.coalesce("subway_code", F.lit("UNKNOWN_CODE")).alias("subway_code"),
        F.coalesce("subway_line", F.lit("UNKNOWN_LINE")).alias("subway_line"),
        F.coalesce("subway_delay", F.lit(0.0)).alias("subway_delay"),
        F.col("matched_surface_delay").alias("target_surface_delay"),
        F.col("matched_surface_events").cast("double").alias("target_surface_events"),
        F.col("max_offset_minutes").alias("target_linger_minutes"),
    )
    return named.withColumns(S.incident_calendar(at)).withColumns(
        {
            "ripple_label": S.ripple_label("target_surface_delay"),
            "severe_label": S.severe_label(
                "target_surface_delay", "target_surface_events", "target_linger_minutes"
            ),
        }
    )


HISTORY = {
    "station": ("station_key", {"delay": "target_surface_delay", "events": "target_surface_events",
                                "linger": "target_linger_minutes"}),
    "code": ("subway_code", {"delay": "target_surface_delay", "events": "target_surface_events"}),
    "line": ("subway_line", {"delay": "target_surface_delay"}),
}


ROW = "_row"
#: Target columns by their short names, and the history kind that takes in every earlier incident.
TARGET_OF = {"delay": "target_surface_delay", "events": "target_surface_events", "linger": "target_linger_minutes"}
OVERALL = "all"


def numbered(df: DataFrame) -> DataFrame:
    """Stored rows with a number each, by which what is worked out elsewhere finds its row."""
    return df if ROW in df.columns else materialize(df.withColumn(ROW, F.monotonically_increasing_id()))


def earlier_sums(
    df: DataFrame, kinds: Mapping[str, str | None], targets: Mapping[str, str] = TARGET_OF
) -> DataFrame:
    """Per row of a ``numbered`` table and kind: number and target sums of the *earlier* rows with its key.

    ``kinds`` names key columns (None: all rows have one key), ``targets`` the summed columns. Each row enters one range sweep once per
    kind, without its other columns, and all prefix sums come from that sweep: the number of passes
    doesn't grow with the kinds, and a key with a third of the rows is cut into slices. Order is (time,
    id, row). A null key is a key of its own; a null target adds nothing.
    """
    keyed = [
        F.struct(F.lit(kind).alias("_kind"), (F.lit(None) if key is None else F.col(key)).cast("string").alias("_key"))
        for kind, key in kinds.items()
    ]
    stacked = df.select(
        ROW, "subway_timestamp", "incident_id", F.lit(1).cast("bigint").alias("_one"),
        *[F.coalesce(F.col(c).cast(EXACT_HISTORY), F.lit(0)).cast(EXACT_HISTORY).alias(f"_{t}") for t, c in targets.items()],
        F.inline(F.array(*keyed)),
    )
    sums = ["_one", *[f"_{t}" for t in targets]]
    swept = running(stacked, ["subway_timestamp", "incident_id", ROW], sums=sums, keys=["_kind", "_key"])
    return swept.groupBy(ROW).agg(*[
        F.max(F.when(F.col("_kind") == kind, F.col(f"{c}_run") - F.col(c))).alias(f"_{kind}{c}") for kind in kinds for c in sums
    ])


def add_history(
    df: DataFrame, fallback: Mapping[str, float], kinds: Sequence[str] = ("station", "code", "line"), overall: bool = False
) -> DataFrame:
    """Means, totals and counts over the *earlier* incidents of the station, code and line.

    A key without history gets ``fallback`` (one value per target). ``overall`` adds the mean delay
    of all earlier incidents, the first one 0, from the same sweep.
    """
    rows = numbered(df)
    keys = {kind: HISTORY[kind][0] for kind in kinds} | ({OVERALL: None} if overall else {})
    made = {}
    for kind in kinds:
        seen = F.col(f"_{kind}_one")
        made[f"{kind}_prev_incidents"] = seen
        for t, column in HISTORY[kind][1].items():
            before = F.col(f"_{kind}_{t}").cast("double")
            made[f"{kind}_prev_{t}_mean"] = F.when(seen > 0, before / seen).otherwise(F.lit(fallback[column]))
        if kind == "station":
            made["station_prev_delay_total"] = F.col("_station_delay").cast("double")
    if overall:
        seen, before = F.col(f"_{OVERALL}_one"), F.col(f"_{OVERALL}_delay").cast("double")
        made["global_prev_delay"] = F.when(seen > 0, before / seen).otherwise(F.lit(0.0))
    kept = [c for c in df.columns if c != ROW and c not in made]
    return rows.join(earlier_sums(rows, keys), ROW).select(*kept, *[c.alias(n) for n, c in made.items()])


def add_recent(df: DataFrame, block: int = 10_000, rows: int = 3) -> DataFrame:
    """Mean of up to three earlier incidents of the station; without any, the station mean.

    ``station_prev_incidents`` numbers the rows of a station, so they can be cut into
    blocks; the last rows of a block are copied into the next one, where they only serve
    as history.
    """
    no = F.col("station_prev_incidents")
    own = F.floor(no / block)
    copies = F.when(no % block >= block - rows, F.array(own, own + 1)).otherwise(F.array(own))
    spread = df.withColumns({"_own": own}).withColumn("_block", F.explode(copies))
    w = Window.partitionBy("station_key", "_block").orderBy("station_prev_incidents").rowsBetween(-rows, -1)
    made = {
        f"recent_station_{t}_{rows}": F.coalesce(F.avg(c).over(w), F.col(f"station_prev_{t}_mean"))
        for t, c in (("delay", "target_surface_delay"), ("events", "target_surface_events"))
    }
    return spread.withColumns(made).filter(F.col("_own") == F.col("_block")).drop("_own", "_block")


def add_global_history(df: DataFrame) -> DataFrame:
    """Mean delay of all earlier incidents, the first one 0."""
    return add_history(df, {}, kinds=(), overall=True)


# The columns of the incident dataset, in file order.
DATASET_COLUMNS = (
    "incident_id", "station_key", "subway_timestamp", "subway_code", "subway_line", "subway_delay",
    "hour", "day_name", "is_weekend", "month", "quarter", "weekofyear", "minute_of_day",
    "station_prev_delay_mean", "station_prev_events_mean", "station_prev_linger_mean",
    "station_prev_delay_total", "station_prev_incidents", "recent_station_delay_3",
    "recent_station_events_3", "code_prev_delay_mean", "code_prev_events_mean", "code_prev_incidents",
    "line_prev_delay_mean", "line_prev_incidents", "global_prev_delay", "target_surface_delay",
    "target_surface_events", "target_linger_minutes", "ripple_label", "severe_label",
)
TARGETS = ("target_surface_delay", "target_surface_events", "target_linger_minutes")


def target_means(df: DataFrame) -> dict[str, float]:
    """Fallback values: the target means of the given rows."""
    row = df.agg(*[F.avg(t).alias(t) for t in TARGETS]).first()
    return {t: row[t] for t in TARGETS}


def incident_dataset(found: DataFrame, fallback_rows: DataFrame | None = None) -> DataFrame:
    """The modelling table. By default keys without history take the mean over all rows,
    which looks ahead; pass the training rows as ``fallback_rows`` to avoid that."""
    base = numbered(labelled(found))
    fallback = target_means(base if fallback_rows is None else fallback_rows)
    full = add_recent(add_history(base, fallback, overall=True))
    return full.select(*DATASET_COLUMNS)
