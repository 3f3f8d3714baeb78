"""Pipeline funnel, stage durations and sales velocity from the status history."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.ranking import neighbour, seconds_between
from ..functions.text import empty_to_null, value_map

DAY = 86_400_000_000  # microseconds


def _stage_index(status: Column) -> Column:
    return value_map(status, {s: i for i, s in enumerate(fixed.FUNNEL_STAGES)})


def _stage_table(df: DataFrame) -> DataFrame:
    rows = [(i, s) for i, s in enumerate(fixed.FUNNEL_STAGES)]
    return df.sparkSession.createDataFrame(rows, "pos int, stage string")


def orphan_history_filter(history: DataFrame, leads: DataFrame) -> DataFrame:
    """History of leads that still exist."""
    return history.join(leads.select(F.col("id").alias("lead_id")), "lead_id", "left_semi")


def pipeline_funnel(history: DataFrame, leads: DataFrame) -> DataFrame:
    """Per stage: leads that reached it, conversion to the next one, lost and hold events, leads in it.

    Reaching a stage credits all earlier ones, so a lead is described by its furthest stage and its
    exits per stage: one aggregate per lead, one join with the leads (which drops left-over
    history), one row of totals, turned into six rows. No exploding, no distinct.
    """
    stages = fixed.FUNNEL_STAGES
    left_from = F.coalesce(empty_to_null("from_status"), F.lit("new"))
    exits = lambda to, stage: F.count_if((F.col("to_status") == to) & (left_from == stage))
    per_lead = history.groupBy(F.col("lead_id").alias("id")).agg(
        F.max(_stage_index(F.col("to_status"))).alias("far"),
        *[exits(to, stage).alias(f"{to}_{i}") for to in ("lost", "hold") for i, stage in enumerate(stages)])
    joined = leads.select("id", "status").join(per_lead, "id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    totals = joined.agg(
        *[F.count_if(F.col("far") >= i).alias(f"reached_{i}") for i in range(len(stages))],
        *[F.count_if(F.col("status") == stage).alias(f"now_{i}") for i, stage in enumerate(stages)],
        *[total(f"{to}_{i}").alias(f"{to}_{i}") for to in ("lost", "hold") for i in range(len(stages))])

    def row(i: int) -> Column:
        here = F.col(f"reached_{i}")
        onward = F.col(f"reached_{i + 1}") if i + 1 < len(stages) else F.lit(None).cast("bigint")
        pct = F.when((here > 0) & onward.isNotNull(), F.bround(onward / here * 100)).cast("bigint")
        return F.struct(F.lit(i).alias("pos"), F.lit(stages[i]).alias("stage"), here.alias("reached"), pct.alias("conversion"),
                        F.col(f"lost_{i}").alias("lost"), F.col(f"hold_{i}").alias("hold"), F.col(f"now_{i}").alias("now"))

    return totals.select(F.inline(F.array(*[row(i) for i in range(len(stages))])))


def stage_intervals(history: DataFrame, as_of: Column) -> DataFrame:
    """History rows with the time of the next change of the same lead, else `as_of`."""
    moved = neighbour(history, "lead_id", ("at", "id"), "at", "next_at", step=1)
    return moved.withColumn("until", F.coalesce("next_at", as_of)).drop("next_at")


def stage_durations(history: DataFrame, leads: DataFrame, as_of: Column) -> DataFrame:
    """Mean days per visit of each open stage; a stage never visited gets null."""
    visits = stage_intervals(orphan_history_filter(history, leads), as_of)
    stats = (visits.where(F.col("to_status").isin(*fixed.OPEN_STATUSES))
             .groupBy(F.col("to_status").alias("stage"))
             .agg(F.sum(seconds_between("at", "until")).alias("us"), F.count(F.lit(1)).alias("visits")))
    mean = F.bround(F.col("us") / F.col("visits") / DAY, 1)
    return (_stage_table(leads).join(stats, "stage", "left")
            .select("pos", "stage", F.coalesce("visits", F.lit(0)).alias("visits"), mean.alias("avg_days"))
            .orderBy("pos"))


def sales_velocity(history: DataFrame, leads: DataFrame) -> DataFrame:
    """Mean days from creation to a won event (every won event counts) and the number of won leads."""
    won = history.where("to_status = 'won'").select("lead_id", "at")
    joined = won.join(leads.select(F.col("id").alias("lead_id"), "created_at"), "lead_id")
    per_lead = joined.groupBy("lead_id").agg(
        F.sum(seconds_between("created_at", "at")).alias("us"), F.count(F.lit(1)).alias("events"))
    return per_lead.agg(
        F.count(F.lit(1)).alias("won"), F.coalesce(F.sum("events"), F.lit(0)).alias("won_events"),
        F.bround(F.sum("us") / F.sum("events") / DAY, 1).alias("velocity_days"))


def lead_stage_since(leads: DataFrame, history: DataFrame, as_of: Column) -> DataFrame:
    """Leads with the time of their last status change and whole days since."""
    since = history.groupBy(F.col("lead_id").alias("id")).agg(F.max("at").alias("_at"))
    joined = leads.join(since, "id", "left").withColumn("stage_since", F.coalesce("_at", "created_at"))
    days = F.floor(seconds_between(F.col("stage_since"), as_of) / DAY)
    return joined.withColumn("days_in_stage", days.cast("bigint")).drop("_at")


def stale_stage(leads: DataFrame, days: int = fixed.STALE_DAYS) -> DataFrame:
    return leads.withColumn("stale", F.coalesce(
        (F.col("days_in_stage") >= days) & F.col("status").isin(*fixed.OPEN_STATUSES), F.lit(False)))


def seed_status_history(leads: DataFrame, history: DataFrame) -> DataFrame:
    """First history row (null to the current status, at creation) of leads that have none."""
    missing = leads.join(history.select(F.col("lead_id").alias("id")), "id", "left_anti")
    return missing.select(F.col("id").alias("lead_id"), F.lit(None).cast("string").alias("from_status"),
                          F.col("status").alias("to_status"), F.col("created_at").alias("at"))


def append_status_history(old_leads: DataFrame, new_leads: DataFrame, as_of: Column) -> DataFrame:
    """One row per status change between two states of the lead table; new leads start from null."""
    old = old_leads.select("id", F.col("status").alias("from_status"))
    joined = new_leads.select("id", F.col("status").alias("to_status")).join(old, "id", "left")
    changed = joined.where(~F.col("from_status").eqNullSafe(F.col("to_status")))
    return changed.select(F.col("id").alias("lead_id"), "from_status", "to_status", as_of.alias("at"))


def current_stage(history: DataFrame) -> DataFrame:
    """Latest status and the time it was entered, per lead."""
    last = F.max_by(F.struct("to_status", "at"), F.struct("at", "id")).alias("s")
    return history.groupBy("lead_id").agg(last).select(
        "lead_id", F.col("s.to_status").alias("status"), F.col("s.at").alias("entered_at"))
