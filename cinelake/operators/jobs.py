"""Operators on jobs, their stages, events and performance samples."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def next_queued(jobs: DataFrame, policy: str = "fifo", state: str = "queued") -> DataFrame:
    """The job to run next (O01-O03): the oldest, or the first by lower-case base name; ties go by id.

    A descending name order reverses the ties as well.
    """
    base = F.lower(F.element_at(F.split("source_path", "[/\\\\]"), -1))
    order = {
        "fifo": [F.col("created_at").asc(), F.col("id").asc()],
        "name_asc": [base.asc(), F.col("id").asc()],
        "name_desc": [base.desc(), F.col("id").desc()],
    }[policy]
    return jobs.where(F.col("state") == state).orderBy(*order).limit(1)


def state_counts(jobs: DataFrame, states: DataFrame) -> DataFrame:
    """Jobs in each state of the dimension ``states``, 0 where there are none."""
    counted = jobs.groupBy("state").agg(F.count("*").alias("n"))
    return states.join(counted, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


#: Fixed values: (state, action, next state).
TRANSITIONS = (
    ("queued", "start", "running"), ("queued", "cancel", "cancelled"), ("running", "pause", "paused"),
    ("running", "finish", "completed"), ("running", "fail", "failed"), ("running", "cancel", "cancelled"),
    ("paused", "resume", "running"), ("paused", "cancel", "cancelled"), ("failed", "retry", "queued"),
    ("cancelled", "retry", "queued"),
)


def moved(jobs: DataFrame, actions: DataFrame, transitions: DataFrame) -> DataFrame:
    """States after one action each; an action that a state does not allow changes nothing."""
    return (
        jobs.join(actions, "id", "left")
        .join(transitions, ["state", "action"], "left")
        .select("id", "state", "action", F.coalesce("next_state", "state").alias("new_state"))
    )


def orphans(jobs: DataFrame, active: DataFrame) -> DataFrame:
    """Running jobs that nobody works on."""
    return jobs.where(F.col("state") == "running").join(active.select("id"), "id", "left_anti")


def upserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with whole rows replaced or added by key (S11, S14, S24); write it to a new place."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def layered(layers: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union in which a later layer's row replaces those of earlier ones with its key."""
    every = None
    for k, layer in enumerate(layers):
        some = layer.withColumn("__layer", F.lit(k))
        every = some if every is None else every.unionByName(some)
    rest = [c for c in layers[0].columns if c not in keys]
    return (
        every.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "__layer").alias("__row"))
        .select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest))
    )


def merged_json(base: Column, overrides: Column) -> Column:
    """One level of nested settings: maps merge key by key, the override wins; lists count as values."""
    schema = "map<string,string>"
    a, b = F.from_json(base, schema), F.from_json(overrides, schema)
    keys = F.array_sort(F.array_union(F.map_keys(F.coalesce(a, F.create_map().cast(schema))), F.map_keys(F.coalesce(b, F.create_map().cast(schema)))))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.coalesce(F.try_element_at(b, k), F.try_element_at(a, k)))))


@F.pandas_udf(StringType())
def deep_merged(base: pd.Series, overrides: pd.Series) -> pd.Series:
    """Settings (JSON texts) with overrides merged at every depth, keys in order; lists and leaves are replaced.

    A text that is null or no map counts as no settings.
    """

    def loaded(text: str | None) -> dict:
        try:
            found = json.loads(text or "{}")
        except ValueError:
            return {}
        return found if isinstance(found, dict) else {}

    def merged(a: dict, b: dict) -> dict:
        both = {k: merged(a[k], b[k]) for k in a.keys() & b.keys() if isinstance(a[k], dict) and isinstance(b[k], dict)}
        return a | b | both

    return pd.Series([json.dumps(merged(loaded(a), loaded(b)), sort_keys=True) for a, b in zip(base, overrides)], dtype=object)


def deleted(jobs: DataFrame, cache: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs and their cached stages without the jobs of ``gone`` (id): the cascade is an anti join of its own."""
    return (
        jobs.join(gone.select("id"), "id", "left_anti"),
        cache.join(gone.select(F.col("id").alias("job_id")), "job_id", "left_anti"),
    )


def running_of(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The running ones of some jobs."""
    return jobs.where(F.col("state") == "running").join(wanted.select("id"), "id", "left_semi")


def event_text(message: Column, extra: Column) -> Column:
    """What an event says: its message, else the tool's line among its extras (a JSON text), trimmed; blank is null."""
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(said(message), said(F.get_json_object(extra, "$.ffmpeg_line")))


def performance(results: DataFrame) -> DataFrame:
    """Roll-up of stage results (A02, D17): sums of times and calls, the largest of cumulative counters.

    ``results``: (job_id, result_name, duration_s decimal, calls, scans_total).  A stage's whole-run row is
    left out where it has rows of batches, so nothing counts twice.
    """
    stage = F.regexp_replace("result_name", "__batch_[0-9]+$", "")
    named = results.withColumn("stage", stage).withColumn("batched", F.col("result_name") != stage)
    any_batch = F.max("batched").over(W.partitionBy("job_id", "stage"))
    return (
        named.withColumn("any_batch", any_batch)
        .where(F.col("batched") | ~F.col("any_batch"))
        .rollup("job_id", "stage")
        .agg(
            F.count("*").alias("runs"),
            F.sum("duration_s").cast("double").alias("duration_s"),
            F.sum("calls").alias("calls"),
            F.max("scans_total").alias("scans_total"),
        )
        .where(F.col("job_id").isNotNull())
    )


def active_seconds(jobs: DataFrame, pauses: DataFrame) -> DataFrame:
    """Time that jobs really ran (T08): end minus start, minus what pauses cover; an open pause lasts till the end.

    ``jobs``: (id, started, ended seconds); ``pauses``: (id, paused, resumed or null), which do not overlap.
    """
    over = F.greatest(
        F.least(F.coalesce("resumed", "ended"), F.col("ended")) - F.greatest("paused", "started"), F.lit(0.0)
    )
    lost = jobs.join(pauses, "id").groupBy("id").agg(F.sum(over).alias("lost"))
    return jobs.join(lost, "id", "left").select(
        "id", F.greatest(F.col("ended") - F.col("started") - F.coalesce("lost", F.lit(0.0)), F.lit(0.0)).alias("active_s")
    )


def progress_samples(lines: DataFrame) -> DataFrame:
    """Samples of key=value lines (T03): a ``progress`` line ends one; the last value of a key wins.

    ``lines``: (job_id, line_no, value).
    """
    parts = F.split("value", "=", 2)
    pairs = lines.select("job_id", "line_no", F.trim(F.get(parts, 0)).alias("key"), F.trim(F.get(parts, 1)).alias("v")).where("v is not null")
    w = W.partitionBy("job_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    sample = F.coalesce(F.sum(F.when(F.col("key") == "progress", 1).otherwise(0)).over(w), F.lit(0))
    last = lambda k: F.max_by(F.when(F.col("key") == k, F.col("v")), F.when(F.col("key") == k, F.col("line_no"))).alias(k)
    return (
        pairs.withColumn("sample", sample)
        .groupBy("job_id", "sample")
        .agg(*map(last, ("frame", "fps", "speed", "progress")))
        .where(F.col("progress").isNotNull())
    )


def job_progress(events: DataFrame, stages: int = 11) -> DataFrame:
    """Jobs folded from their events in order (T04): the stage begun last, and the progress.

    A progress event sets the value (it may fall), a finished stage only raises it.  ``events``: (job_id,
    seq, kind, stage_index, progress).
    """
    state = F.struct(F.lit(None).cast("bigint").alias("stage"), F.lit(0.0).alias("progress"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "kind", "stage_index", "progress")))
    i = lambda e: e["stage_index"].cast("double")
    fold = F.aggregate(
        "ordered",
        state,
        lambda s, e: F.struct(
            F.when(e["kind"] == "started", e["stage_index"].cast("bigint")).otherwise(s["stage"]).alias("stage"),
            F.when(e["kind"] == "progress", F.least(F.lit(0.999), (i(e) + e["progress"]) / stages))
            .when(e["kind"].isin("completed", "skipped"), F.greatest(s["progress"], (i(e) + 1) / stages))
            .otherwise(s["progress"])
            .alias("progress"),
        ),
    )
    return events.groupBy("job_id").agg(ordered.alias("ordered")).select("job_id", fold.alias("s")).select("job_id", "s.*")


def cache_hits(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Stages whose stored key equals the wanted one."""
    return requests.join(cache, ["job_id", "stage_name"]).where(F.col("wanted_key") == F.col("cache_key"))


def recent(rows: DataFrame, keys: list[str], order: list[Column], count: int = 5) -> DataFrame:
    """The newest ``count`` rows of each key."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= count)


def listed(jobs: DataFrame) -> DataFrame:
    """Jobs with their position from 0 in the order of their creation, then of their ids.

    Days are numbered each, and offset by the counts of the days before, so no task sorts all jobs; jobs without a time come
    first.  The counts are a row a day.
    """
    day = F.coalesce(F.to_date("created_at"), F.lit("0001-01-01").cast("date"))
    dated = jobs.withColumn("__day", day)
    own = F.row_number().over(W.partitionBy("__day").orderBy("created_at", "id")) - 1
    counts = dated.groupBy("__day").agg(F.count("*").alias("__c"))
    before = counts.select("__day", (F.sum("__c").over(W.orderBy("__day")) - F.col("__c")).alias("__before"))
    return dated.withColumn("__n", own).join(before, "__day").withColumn("position", F.col("__n") + F.col("__before")).drop("__day", "__n", "__before")


def usable_segments(found: DataFrame, known: DataFrame) -> DataFrame:
    """(job_id, path) of the segments that a resumed job goes on with.

    Those it knows of; a job that knows of none takes its non-empty files named ``segment_*.mkv`` from ``found`` (job_id, path,
    length).  A path counts once.
    """
    name = F.element_at(F.split("path", "/"), -1)
    whole = found.where((F.col("length") > 0) & name.startswith("segment_") & name.endswith(".mkv"))
    recovered = whole.join(known.select("job_id").distinct(), "job_id", "left_anti")
    return known.select("job_id", "path").union(recovered.select("job_id", "path")).distinct()
