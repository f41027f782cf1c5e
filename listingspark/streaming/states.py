"""Per-key state over event streams: rate-limit streak (K3), incidents (K4, G7), link strikes (K5).

A stream folds each micro-batch into a state table with one row per key.  The events of a batch are cut into pieces by
one range partitioning over key and time; what a piece does to a state is a few numbers (counts before and after its
resets), and the numbers of neighbouring pieces combine, so a key that owns a third of all events is never in one task.
No row passes through Python.

Version ``n + 1`` of a state is made from version ``n`` and micro-batch ``n``; a replayed batch reads and writes the same
versions.  The state knows the last event of each key; events that aren't after it are set aside in a table of late ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..skew import count_since, in_pieces

Folded = tuple[DataFrame, DataFrame]


@dataclass(frozen=True)
class Fold:
    """``events`` shapes a batch into ``key, id, at`` and more; ``step(fresh, state)`` gives output rows and the state of
    the keys that occur; ``state`` are the columns after ``key, at, id`` of the last event."""

    events: Callable[[DataFrame], DataFrame]
    step: Callable[[DataFrame], Folded]
    state: str

    @property
    def schema(self) -> str:
        return "key string, at timestamp, id long, " + self.state


def backoff(streak: int, base: int = 30, cap: int = 240) -> int:
    return min(cap, base * 2 ** (min(streak, 10) - 1)) if streak > 0 else 0


def fold_batch(fold: Fold, batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Output rows, the new state and the late events of one micro-batch."""
    known = state.select("key", F.struct("at", "id").alias("_newest"), F.struct(*state.columns[3:]).alias("_state"))
    rows = fold.events(batch).withColumn("id", F.col("id").cast("long")).join(known, "key", "left")
    late = F.coalesce(F.struct("at", "id") <= F.col("_newest"), F.lit(False))
    aside = rows.where(late).drop("_newest", "_state")
    fresh = in_pieces(rows.where(~late).drop("_newest"), ["key"], "at", "id")
    out, changed = fold.step(fresh)
    changed = changed.select("key", "at", "id", *state.columns[3:])
    return out, changed.unionByName(state.join(changed.select("key"), "key", "left_anti")), aside


def run_fold(events: DataFrame, fold: Fold, folder: str, checkpoint: str) -> StreamingQuery:
    """Fold a stream: ``out``, ``late`` and ``state`` below ``folder`` have one version per micro-batch."""
    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        state = spark.read.schema(fold.schema).parquet(f"{folder}/state/version={n}") if n else spark.createDataFrame([], fold.schema)
        for name, df in zip(("out", "state", "late"), fold_batch(fold, batch, state), strict=True):
            df.write.mode("overwrite").parquet(f"{folder}/{name}/version={n + 1}")

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _last(rows: DataFrame, **columns) -> DataFrame:
    """Per key its last event with some columns of it, and aggregates."""
    kept = {n: c for n, c in columns.items() if isinstance(c, str)}
    found = rows.groupBy("key").agg(F.max(F.struct("at", "id", *[F.col(c).alias(n) for n, c in kept.items()])).alias("_m"),
                                    *[c.alias(n) for n, c in columns.items() if n not in kept])
    return found.select("key", "_m.*", *[n for n in columns if n not in kept])


def _streak_step(fresh: DataFrame) -> Folded:
    rows = count_since(fresh, ["key"], "at", "id", F.col("flag"), ~F.col("flag"), "n", piece="_piece")
    rows = rows.withColumn("streak", (F.col("n") + F.when(F.col("n_any"), 0).otherwise(F.coalesce("_state.streak", F.lit(0)))).cast("int"))
    state = _last(rows, streak="streak")
    wait = F.least(F.lit(240), 30 * F.pow(F.lit(2), F.least("streak", F.lit(10)) - 1)).cast("int")
    return state.select("key", "at", "streak", F.when(F.col("streak") > 0, wait).otherwise(0).alias("backoff_minutes")), state


def _strikes_step(fresh: DataFrame) -> Folded:
    rows = count_since(fresh, ["key"], "at", "id", F.col("kind") == "dead", F.col("kind") == "reset", "n", piece="_piece")
    rows = rows.withColumn("strikes", (F.col("n") + F.when(F.col("n_any"), 0).otherwise(F.coalesce("_state.strikes", F.lit(0)))).cast("int"))
    reached = F.max((F.col("strikes") >= 3) | F.coalesce("_state.reached_threshold", F.lit(False)))
    state = _last(rows, strikes="strikes", reached_threshold=reached)
    return state.select("key", "at", "strikes", "reached_threshold"), state


def streak_fold() -> Fold:
    """K3: current refusal streak and cooldown per source; skipped attempts do not count."""
    return Fold(lambda events: events.where("not skipped and source_id is not null and ts is not null").select(
        F.col("source_id").alias("key"), "id", F.col("ts").alias("at"),
        F.coalesce(F.contains("error", F.lit("HTTP 429")), F.lit(False)).alias("flag")), _streak_step, "streak int")


def strikes_fold() -> Fold:
    """K5: strikes per company; an unreachable host changes nothing."""
    return Fold(lambda checks: checks.where("company_id is not null and ts is not null").select(
        F.col("company_id").cast("string").alias("key"), "id", F.col("ts").alias("at"),
        F.when(F.col("hard_dead"), "dead").when(F.col("link_status") == "unreachable", "none").otherwise("reset").alias("kind")), _strikes_step, "strikes int, reached_threshold boolean")


def incident_fold(threshold: int = 2) -> Fold:
    """K4: one action per signal and incident class; ``signals(incident_key, id, ts, signal)``.  The state is the number of
    healthy signals of an open incident, NULL when none is open."""
    threshold = max(1, threshold)

    def step(fresh: DataFrame) -> Folded:
        rows = _actions(fresh.withColumn("_prior", F.col("_state.healthy")), "key", "at", threshold, "_piece")
        n = F.col("_n")
        state = _last(rows.withColumn("healthy", F.when(n < threshold, n).cast("int")), healthy="healthy")
        return rows.select("key", "id", "at", "action", "healthy_streak"), state

    return Fold(lambda signals: signals.where("incident_key is not null and ts is not null").select(
        F.lower("incident_key").alias("key"), "id", F.col("ts").alias("at"), "signal"), step, "healthy int")


def _actions(df: DataFrame, key: str, at: str, threshold: int, piece: str | None = None) -> DataFrame:
    """Add ``action`` and ``healthy_streak``, and as ``_n`` the healthy signals since the failing one before; NULL when no
    incident was ever open.  ``_prior`` are those of an incident open before the first signal."""
    bad, good = F.col("signal") == "failing", F.col("signal") == "healthy"
    df = count_since(df, [key], at, "id", good, bad, "_since", before=True, piece=piece)
    df = df.withColumn("_n", F.when(F.col("_since_any"), F.col("_since")).otherwise(F.col("_since") + F.col("_prior")))
    n = F.col("_n")
    action = (
        F.when(bad & (n.isNull() | (n >= threshold)), "CREATE")
        .when(bad & (n > 0), "UPDATE")
        .when(good & (n < threshold), "UPDATE")
        .when(good & (n == threshold), "CLOSE")
        .otherwise("HOLD"))
    streak = F.when(~bad & (n < threshold), n).otherwise(0)
    df = df.withColumns({"action": action, "healthy_streak": streak.cast("int")})
    # A failing signal opens an incident anew.
    return df.withColumn("_n", F.when(bad, 0).otherwise(n)).drop("_since", "_since_any")


def incident_actions(signals: DataFrame, open_incidents: DataFrame | None = None, threshold: int = 2) -> DataFrame:
    """The same actions for a stored table of signals, by running counts instead of a loop.

    An unknown signal always holds.  Among the others, ``healthy`` counts since the last failing one
    decide: below the threshold an update, at it the close, beyond it nothing is open.
    ``open_incidents(incident_key, number, healthy_streak)`` are open before the first signal; the one
    with the lowest number is meant.
    """
    threshold = max(1, threshold)
    df = signals.where("incident_key is not null and ts is not null").withColumn("incident_key", F.lower("incident_key"))
    if open_incidents is None:
        df = df.withColumn("_prior", F.lit(None).cast("int"))
    else:
        prior = open_incidents.groupBy(F.lower("incident_key").alias("incident_key")).agg(
            F.min(F.struct("number", "healthy_streak"))["healthy_streak"].cast("int").alias("_prior"))
        df = df.join(prior, ["incident_key"], "left")
    return _actions(df, "incident_key", "ts", threshold).drop("_prior", "_n")
