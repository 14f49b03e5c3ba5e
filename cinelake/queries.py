"""Queries over the driver's tables, each with its SQL.

The tables stand in for the data sets of a media engine in shape only: ``events`` is a packet and score
stream (source: user, key frame: purchase, score: value), ``orders`` are jobs, ``lineitem`` are the streams
of a file and performance samples.  What an operator means is tested on small vectors of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinelake.functions import scalar as fn
from cinelake.operators import jobs, media, timeline
from cinelake.plans import batching, encoders

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def stream(spark: SparkSession, d: str) -> DataFrame:
    """Packets of each source: number from 0, seconds since the source's first, key flag and score."""
    e = table(spark, d, "events").select(
        F.col("user_id").alias("source_id"),
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        (F.col("event_type") == "purchase").alias("is_key"),
        F.col("value").alias("score"),
    )
    own = W.partitionBy("source_id")
    return e.select(
        "source_id",
        (F.row_number().over(own.orderBy("us", "event_id")) - 1).cast("long").alias("n"),
        ((F.col("us") - F.min("us").over(own)) / 1e6).alias("pts"),
        "is_key",
        "score",
    )


STREAM = """s AS (SELECT user_id AS source_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS pts, event_type = 'purchase' AS is_key,
  value AS score FROM events)"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    s = stream(spark, d)
    return s.groupBy("source_id").agg(
        F.max("pts").alias("duration"), F.array_sort(F.collect_list(F.when(F.col("is_key"), F.col("pts")))).alias("keyframes")
    )


DAY = 86_400


@query(f"WITH {STREAM} SELECT source_id, max(pts) AS last_pts, max(pts + 0.04) AS last_end, count(*) FILTER (is_key) AS n_keys FROM s GROUP BY source_id")
def a01_extents(spark: SparkSession, d: str) -> DataFrame:
    """Extents of each source."""
    return timeline.extents(stream(spark, d).withColumn("dur", F.lit(0.04)))


BATCHES = """e AS (SELECT source_id, max(pts) AS duration FROM s GROUP BY source_id),
x AS (SELECT source_id, 0.0::DOUBLE AS e FROM e WHERE duration > 0 UNION SELECT source_id, duration FROM e WHERE duration > 0
  UNION SELECT source_id, (k * 86400)::DOUBLE FROM e, range(1, 400) r(k) WHERE k * 86400 < duration),
b AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY e) - 1 AS index, round(e, 6) AS start_pts,
  round(lead(e) OVER (PARTITION BY source_id ORDER BY e), 6) AS end_pts FROM x)"""


@query(f"WITH {STREAM}, {BATCHES} SELECT source_id, index, start_pts, end_pts, round_even((end_pts - start_pts) * 24.0::DOUBLE, 0)::BIGINT AS frames FROM b WHERE end_pts IS NOT NULL")
def d01_batches_exact(spark: SparkSession, d: str) -> DataFrame:
    """D01 exact, U01, W01, F05, T09: batches of a day."""
    return timeline.plan_batches(requests(spark, d), DAY)


def day_batches(spark: SparkSession, d: str) -> DataFrame:
    """Key-frame batches of about a day."""
    s = stream(spark, d)
    ask = s.groupBy("source_id").agg(F.max("pts").alias("duration")).select("source_id", "duration", F.lit(24.0).alias("fps"), F.lit(DAY).alias("chunk_lo"), F.lit(DAY).alias("chunk_hi"))
    return batching.walked(ask, s.where("is_key").select("source_id", "pts"), False)


SNAPPED = """WITH RECURSIVE %s, e AS (SELECT source_id, max(pts) AS duration FROM s GROUP BY source_id),
r AS (SELECT source_id, duration, 0.0::DOUBLE AS picked, 86400.0::DOUBLE AS target FROM e WHERE duration > 0
  UNION ALL SELECT source_id, duration, p, p + 86400 FROM (SELECT r.source_id, r.duration,
    CASE WHEN (SELECT max(pts) FROM s WHERE s.source_id = r.source_id AND is_key AND pts <= r.target) > r.picked
      THEN (SELECT max(pts) FROM s WHERE s.source_id = r.source_id AND is_key AND pts <= r.target) ELSE r.target END AS p
    FROM r WHERE r.target < r.duration)),
x AS (SELECT source_id, round(picked, 6) AS e FROM r UNION SELECT source_id, round(duration, 6) FROM e WHERE duration > 0),
b AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY e) - 1 AS index, e AS start_pts,
  lead(e) OVER (PARTITION BY source_id ORDER BY e) AS end_pts FROM x)""" % STREAM


@query(f"{SNAPPED} SELECT source_id, index, start_pts, end_pts, round_even((end_pts - start_pts) * 24.0::DOUBLE, 0)::BIGINT AS frames FROM b WHERE end_pts IS NOT NULL")
def d01_batches_keyframe(spark: SparkSession, d: str) -> DataFrame:
    """D01 keyframe: batches of about a day that end at key frames."""
    return day_batches(spark, d)


@query(f"{SNAPPED} SELECT b.source_id, b.index, count(s.n) AS packets FROM b LEFT JOIN s ON s.source_id = b.source_id AND s.pts >= b.start_pts AND s.pts < b.end_pts WHERE b.end_pts IS NOT NULL GROUP BY b.source_id, b.index")
def flagship_batch_packets(spark: SparkSession, d: str) -> DataFrame:
    """Packets of each key-frame batch.

    Packets and starts of batches stand in one order, and a packet takes the last start up to it: one shuffle, no range
    join, and no list of bounds.
    """
    batches = day_batches(spark, d)
    starts = batches.select("source_id", F.col("start_pts").alias("pts"), "index", F.lit(0).alias("packet"))
    packets = stream(spark, d).select("source_id", "pts", F.lit(None).cast("long").alias("index"), F.lit(1).alias("packet"))
    order = W.partitionBy("source_id").orderBy("pts", "packet").rowsBetween(W.unboundedPreceding, 0)
    last = W.partitionBy("source_id")
    placed = starts.union(packets).select("source_id", "pts", "packet", F.last("index", ignorenulls=True).over(order).alias("index"), F.max("pts").over(last).alias("end"))
    # The last packet of a source stands at its end, which belongs to no batch.
    inside = F.when((F.col("packet") == 1) & (F.col("pts") < F.col("end")), 1).otherwise(0)
    return placed.where(F.col("index").isNotNull()).groupBy("source_id", "index").agg(F.sum(inside).cast("long").alias("packets"))


@query(f"WITH {STREAM} SELECT a.source_id, a.n, k.pts AS key_pts FROM s a ASOF LEFT JOIN (SELECT * FROM s WHERE is_key) k ON a.source_id = k.source_id AND a.pts >= k.pts")
def j01_as_of_keyframe(spark: SparkSession, d: str) -> DataFrame:
    """Last key frame up to each packet."""
    return timeline.as_of_back(stream(spark, d), F.col("is_key"), "pts", "key_pts").select("source_id", "n", "key_pts")


@query(f"WITH {STREAM} SELECT a.source_id, a.n, min(k.n) AS next_key FROM s a LEFT JOIN s k ON k.is_key AND k.source_id = a.source_id AND k.n >= a.n GROUP BY a.source_id, a.n")
def j04_as_of_next(spark: SparkSession, d: str) -> DataFrame:
    """First key frame from each packet on."""
    return timeline.as_of_next(stream(spark, d), F.col("is_key"), "n", "next_key").select("source_id", "n", "next_key")


@query(f"WITH {STREAM}, r AS (SELECT *, sum(is_key::INT) OVER (PARTITION BY source_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM s) SELECT source_id, run::BIGINT AS run, min(n) AS first_n, max(n) AS last_n FROM r GROUP BY source_id, run")
def w02_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs between key frames."""
    return timeline.islands(stream(spark, d), F.col("is_key"))


DUP = """k AS (SELECT source_id, n + 1 AS k, score, count(*) OVER (PARTITION BY source_id) AS full_n FROM s),
band AS (SELECT DISTINCT source_id, unnest([n, n + 1, n + 2]) AS k FROM s WHERE is_key),
low AS (SELECT source_id, k, full_n FROM k ANTI JOIN band USING (source_id, k) WHERE k >= 2 AND score < 20.0),
skip AS (SELECT source_id, k FROM (SELECT *, count(*) OVER (PARTITION BY source_id) AS c FROM low) WHERE NOT (full_n > 2 AND c >= full_n - 1))"""


def skipped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = stream(spark, d)
    cuts = s.where("is_key").select("source_id", (F.col("n") + 1).alias("n"))
    band = cuts.select("source_id", F.explode(F.array(F.col("n") - 1, F.col("n"), F.col("n") + 1)).alias("n"))
    return s.select("source_id", (F.col("n") + 1).alias("k")), timeline.duplicates(s, 20.0, band)


@query(f"WITH {STREAM}, {DUP} SELECT source_id, k FROM skip")
def p05_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Repeated frames beside none of the cuts."""
    return skipped(spark, d)[1]


COMPACT = """c AS (SELECT f.source_id, f.k, s2.k IS NULL AS kept, sum((s2.k IS NULL)::INT) OVER (PARTITION BY f.source_id ORDER BY f.k ROWS UNBOUNDED PRECEDING)::BIGINT AS shown_k
  FROM k f LEFT JOIN skip s2 ON f.source_id = s2.source_id AND f.k = s2.k)"""


@query(f"WITH {STREAM}, {DUP}, {COMPACT} SELECT source_id, k, kept, CASE WHEN kept THEN shown_k END AS new_k, shown_k FROM c")
def w04_compacted(spark: SparkSession, d: str) -> DataFrame:
    """Kept frames numbered anew."""
    return timeline.compacted(*skipped(spark, d))


@query(f"WITH {STREAM}, {DUP}, {COMPACT} SELECT source_id, (k - 1) * 3 + 1 + m AS out_n, (greatest(shown_k, 1) - 1) * 3 + 1 + m AS from_n FROM c, (VALUES (0), (1), (2)) v(m)")
def d09_expanded(spark: SparkSession, d: str) -> DataFrame:
    """Output frames shown again where frames were left out."""
    return timeline.expanded(timeline.compacted(*skipped(spark, d)), 3)


ACCOUNT = """g AS (SELECT source_id, index, floor(24000.0::DOUBLE / 1001 * start_pts + 0.5)::BIGINT AS o,
  floor(24000.0::DOUBLE / 1001 * end_pts + 0.5)::BIGINT AS t, (index > 0)::BIGINT AS v FROM b WHERE end_pts IS NOT NULL)"""


@query(f"WITH {STREAM}, {BATCHES}, {ACCOUNT} SELECT source_id, index, o AS \"offset\", least(t, 10000000) - o AS content, v AS overlap, o - v AS input_base, v + least(t, 10000000) - o AS input_count, v * 2 AS output_skip, (least(t, 10000000) - o) * 2 AS output_count FROM g")
def d04_frame_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Frames of each batch at 24000/1001."""
    b = timeline.plan_batches(requests(spark, d), DAY)
    return timeline.frame_accounting(b, F.lit(24000), F.lit(1001), F.lit(10_000_000).cast("long"), 2)


@query(f"""WITH {STREAM}, {BATCHES}, {ACCOUNT}, p AS (SELECT source_id, index, v, least(t, 10000000) - o AS content, v + least(t, 10000000) - o AS ic FROM g),
q AS (SELECT *, CASE WHEN index % 2 = 0 THEN ic - 7 ELSE ic + 3 END AS actual FROM p)
SELECT source_id, index, greatest(actual - ic, 0) AS trimmed, CASE WHEN actual < ic THEN greatest(actual - v, 0) ELSE content END AS content,
  2 * CASE WHEN actual < ic THEN greatest(actual - v, 0) ELSE content END AS output_count FROM q""")
def d05_reconciled(spark: SparkSession, d: str) -> DataFrame:
    """Plans against what was decoded."""
    plan = d04_frame_accounting(spark, d)
    change = F.when(F.col("index") % 2 == 0, F.col("input_count") - 7).otherwise(F.col("input_count") + 3)
    return timeline.reconciled(plan, plan.select("source_id", "index", change.alias("actual")), 2)


@query(f"WITH {STREAM}, {BATCHES}, {ACCOUNT}, c AS (SELECT source_id, n * 500 + 100 AS n FROM s WHERE is_key) SELECT c.source_id, index, c.n - (o - v) + 1 AS local_n FROM c JOIN g ON c.source_id = g.source_id WHERE c.n - (o - v) + 1 BETWEEN 2 AND v + t - o")
def j02_cuts_in_batches(spark: SparkSession, d: str) -> DataFrame:
    """Cuts by batch, numbered from the batch's first input frame."""
    cuts = stream(spark, d).where("is_key").select("source_id", (F.col("n") * 500 + 100).alias("n"))
    return timeline.cuts_in_batches(cuts, d04_frame_accounting(spark, d))


@query(f"WITH {STREAM} SELECT source_id, n AS index, unnest(range((n - 2) * 3 + 2, (n - 1) * 3 + 1)) AS out_n, (n - 2) * 3 + 1 AS from_n FROM s WHERE is_key AND n >= 2")
def d10_held_over_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Frames that repeat the one before a cut."""
    cuts = stream(spark, d).where("is_key").select("source_id", F.col("n").alias("index"), F.col("n").alias("local_n"))
    return timeline.held_over_cuts(cuts, 3)


@query(f"WITH {STREAM} SELECT source_id, n // 25 AS chunk, count(*) AS frames, max(pts) AS last_pts FROM s GROUP BY source_id, n // 25")
def w09_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Groups of 25 frames."""
    return timeline.chunks(stream(spark, d), 25).groupBy("source_id", "chunk").agg(F.count("*").alias("frames"), F.max("pts").alias("last_pts"))


@query("""WITH RECURSIVE i AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS item, n_chars AS x FROM documents),
r AS (SELECT source, item, 0::BIGINT AS pack, x AS used FROM i WHERE item = 0 UNION ALL
  SELECT i.source, i.item, pack + (used > 0 AND used + x > 8000)::BIGINT, CASE WHEN used > 0 AND used + x > 8000 THEN x ELSE used + x END
  FROM r JOIN i ON i.source = r.source AND i.item = r.item + 1)
SELECT source AS source_id, item::BIGINT AS item, pack FROM r""")
def w10_packed(spark: SparkSession, d: str) -> DataFrame:
    """Texts packed up to 8,000 characters, in order."""
    docs = table(spark, d, "documents")
    number = F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1
    return timeline.packed(docs.select(F.col("source").alias("source_id"), number.alias("item"), F.col("n_chars").alias("size")), 8000)


# Jobs: orders, with states O queued, P paused, F failed.
def job_table(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "paused").otherwise("failed")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        state.alias("state"),
        F.concat(F.lit("/media/"), F.col("o_orderpriority"), F.lit("/Ep"), (F.col("o_custkey") % 50).cast("string"), F.lit(".mkv")).alias("source_path"),
        F.col("o_orderdate").alias("created_at"),
        "o_totalprice",
    )


JOBS = """jobs AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'paused' ELSE 'failed' END AS state,
  'Ep' || (o_custkey % 50)::VARCHAR || '.mkv' AS base, o_orderdate AS created_at, o_totalprice FROM orders)"""


@query(f"WITH {JOBS} SELECT 'fifo' AS policy, id FROM (SELECT id FROM jobs WHERE state = 'queued' ORDER BY created_at, id LIMIT 1) UNION ALL SELECT 'name_asc', id FROM (SELECT id FROM jobs WHERE state = 'queued' ORDER BY lower(base), id LIMIT 1) UNION ALL SELECT 'name_desc', id FROM (SELECT id FROM jobs WHERE state = 'queued' ORDER BY lower(base) DESC, id DESC LIMIT 1)")
def o01_next_queued(spark: SparkSession, d: str) -> DataFrame:
    """The next job by each policy."""
    j = job_table(spark, d)
    one = [jobs.next_queued(j, p).select(F.lit(p).alias("policy"), "id") for p in ("fifo", "name_asc", "name_desc")]
    return one[0].union(one[1]).union(one[2])


STATES = ("queued", "running", "paused", "completed", "failed", "cancelled")


@query(f"WITH {JOBS}, st(state) AS (VALUES {', '.join(f"('{s}')" for s in STATES)}) SELECT st.state, count(jobs.id) AS n FROM st LEFT JOIN jobs ON st.state = jobs.state GROUP BY st.state")
def a03_state_counts(spark: SparkSession, d: str) -> DataFrame:
    """Jobs in every state."""
    return jobs.state_counts(job_table(spark, d), spark.createDataFrame([(s,) for s in STATES], "state string"))


@query(f"WITH {JOBS}, a AS (SELECT id, state, CASE id % 4 WHEN 0 THEN 'start' WHEN 1 THEN 'resume' WHEN 2 THEN 'retry' ELSE 'cancel' END AS action FROM jobs), t(state, action, next_state) AS (VALUES {', '.join(map(str, jobs.TRANSITIONS))}) SELECT a.id, a.state, a.action, coalesce(next_state, a.state) AS new_state FROM a LEFT JOIN t ON a.state = t.state AND a.action = t.action")
def d15_moved(spark: SparkSession, d: str) -> DataFrame:
    """States after an action."""
    j = job_table(spark, d).select("id", "state")
    k = F.col("id") % 4
    action = F.when(k == 0, "start").when(k == 1, "resume").when(k == 2, "retry").otherwise("cancel")
    moves = spark.createDataFrame(jobs.TRANSITIONS, "state string, action string, next_state string")
    return jobs.moved(j, j.select("id", action.alias("action")), F.broadcast(moves))


@query("SELECT o.o_orderkey AS id FROM orders o WHERE o_orderstatus = 'P' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag = 'N')")
def j14_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Running jobs without an active worker."""
    running = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.lit("running").alias("state"))
    active = table(spark, d, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("id"))
    return jobs.orphans(running, active).select("id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'user' ELSE 'builtin' END AS origin, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS name FROM customer")
def u02_layered(spark: SparkSession, d: str) -> DataFrame:
    """User rows over built-in ones."""
    c = table(spark, d, "customer")
    builtin = c.select("c_custkey", F.lit("builtin").alias("origin"), F.col("c_name").alias("name"))
    user = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("user").alias("origin"), F.upper("c_name").alias("name"))
    return jobs.layered([builtin, user], ["c_custkey"])


@query("SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 'new' ELSE 'old' END AS v FROM part UNION ALL SELECT p_partkey + 100000000, 'added' FROM part WHERE p_size = 1")
def s11_upserted(spark: SparkSession, d: str) -> DataFrame:
    """Rows replaced or added by key."""
    p = table(spark, d, "part")
    old = p.select(F.col("p_partkey").alias("id"), F.lit("old").alias("v"))
    new = p.where("p_size > 25").select(F.col("p_partkey").alias("id"), F.lit("new").alias("v"))
    added = p.where("p_size = 1").select((F.col("p_partkey") + 100_000_000).alias("id"), F.lit("added").alias("v"))
    return jobs.upserted(old, new.union(added), ["id"])


@query("""WITH r AS (SELECT l_suppkey AS job_id, CASE WHEN l_linenumber <= 3 THEN 'up__batch_' || l_linenumber::VARCHAR WHEN l_linenumber = 4 THEN 'up' ELSE 'mux' END AS result_name,
  l_quantity::DECIMAL(18,3) AS duration_s, l_linenumber::BIGINT AS calls, l_orderkey AS scans_total FROM lineitem),
n AS (SELECT *, regexp_replace(result_name, '__batch_[0-9]+$', '') AS stage FROM r),
k AS (SELECT *, bool_or(result_name <> stage) OVER (PARTITION BY job_id, stage) AS any_batch FROM n)
SELECT job_id, stage, count(*) AS runs, sum(duration_s)::DOUBLE AS duration_s, sum(calls)::BIGINT AS calls, max(scans_total) AS scans_total
FROM k WHERE result_name <> stage OR NOT any_batch GROUP BY GROUPING SETS ((job_id, stage), (job_id))""")
def a02_performance(spark: SparkSession, d: str) -> DataFrame:
    """Stage roll-up with job totals."""
    n = F.col("l_linenumber")
    name = F.when(n <= 3, F.concat(F.lit("up__batch_"), n.cast("string"))).when(n == 4, "up").otherwise("mux")
    r = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("job_id"), name.alias("result_name"), F.col("l_quantity").cast("decimal(18,3)").alias("duration_s"),
        n.cast("long").alias("calls"), F.col("l_orderkey").alias("scans_total"),
    )
    return jobs.performance(r)


@query("""WITH j AS (SELECT o_orderkey AS id, (o_orderkey % 1000)::DOUBLE AS started, (o_orderkey % 1000 + 500)::DOUBLE AS ended FROM orders),
p AS (SELECT l_orderkey AS id, (l_orderkey % 1000 + l_linenumber * 80)::DOUBLE AS paused, CASE WHEN l_linenumber < 7 THEN (l_orderkey % 1000 + l_linenumber * 80 + l_quantity)::DOUBLE END AS resumed FROM lineitem),
l AS (SELECT id, sum(greatest(least(coalesce(resumed, ended), ended) - greatest(paused, started), 0)) AS lost FROM j JOIN p USING (id) GROUP BY id)
SELECT j.id, greatest(ended - started - coalesce(lost, 0), 0) AS active_s FROM j LEFT JOIN l USING (id)""")
def t08_active_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Time that jobs really ran."""
    k = F.col("o_orderkey") % 1000
    j = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), k.cast("double").alias("started"), (k + 500).cast("double").alias("ended"))
    at = F.col("l_orderkey") % 1000 + F.col("l_linenumber") * 80
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), at.cast("double").alias("paused"), F.when(F.col("l_linenumber") < 7, (at + F.col("l_quantity")).cast("double")).alias("resumed"))
    return jobs.active_seconds(j, p)


@query("""WITH l AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no,
  CASE event_id % 4 WHEN 0 THEN 'frame=' || event_id::VARCHAR WHEN 1 THEN 'fps=' || (event_id % 60)::VARCHAR WHEN 2 THEN 'speed=1.' || (event_id % 9)::VARCHAR || 'x' ELSE 'progress=continue' END AS value FROM events),
p AS (SELECT *, split_part(value, '=', 1) AS k, split_part(value, '=', 2) AS v FROM l),
s AS (SELECT *, coalesce(sum((k = 'progress')::INT) OVER (PARTITION BY job_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sample FROM p)
SELECT job_id, sample, arg_max(v, line_no) FILTER (k = 'frame') AS frame, arg_max(v, line_no) FILTER (k = 'fps') AS fps,
  arg_max(v, line_no) FILTER (k = 'speed') AS speed, arg_max(v, line_no) FILTER (k = 'progress') AS progress
FROM s GROUP BY job_id, sample HAVING count(*) FILTER (k = 'progress') > 0""")
def t03_progress_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples of key=value lines."""
    e = F.col("event_id")
    value = (
        F.when(e % 4 == 0, F.concat(F.lit("frame="), e.cast("string")))
        .when(e % 4 == 1, F.concat(F.lit("fps="), (e % 60).cast("string")))
        .when(e % 4 == 2, F.concat(F.lit("speed=1."), (e % 9).cast("string"), F.lit("x")))
        .otherwise("progress=continue")
    )
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    lines = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.row_number().over(w).alias("line_no"), value.alias("value"))
    return jobs.progress_samples(lines)


@query("""WITH RECURSIVE e AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  CASE event_id % 3 WHEN 0 THEN 'started' WHEN 1 THEN 'progress' ELSE 'completed' END AS kind, event_id % 11 AS i, (event_id % 100) / 100.0::DOUBLE AS p FROM events),
r AS (SELECT job_id, 0::BIGINT AS seq, NULL::BIGINT AS stage, 0.0::DOUBLE AS progress FROM (SELECT DISTINCT job_id FROM e)
  UNION ALL SELECT r.job_id, e.seq, CASE WHEN kind = 'started' THEN i ELSE stage END,
    CASE WHEN kind = 'progress' THEN least(0.999::DOUBLE, (i::DOUBLE + p) / 11) WHEN kind = 'completed' THEN greatest(progress, (i::DOUBLE + 1) / 11) ELSE progress END
  FROM r JOIN e ON e.job_id = r.job_id AND e.seq = r.seq + 1)
SELECT job_id, arg_max(stage, seq) AS stage, arg_max(progress, seq) AS progress FROM r GROUP BY job_id""")
def t04_job_progress(spark: SparkSession, d: str) -> DataFrame:
    """Jobs folded from their events."""
    e = F.col("event_id")
    kind = F.when(e % 3 == 0, "started").when(e % 3 == 1, "progress").otherwise("completed")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, d, "events").select(
        F.col("user_id").alias("job_id"), F.row_number().over(w).alias("seq"), kind.alias("kind"), (e % 11).alias("stage_index"), ((e % 100) / 100.0).alias("progress")
    )
    return jobs.job_progress(events)


@query("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 5")
def w12_recent(spark: SparkSession, d: str) -> DataFrame:
    """The five newest events of each user (the limit is the feature)."""
    return jobs.recent(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


# Streams of files: lineitem; kind by return flag, codec by ship month.
def file_streams(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    kind = F.when(flag == "A", "audio").when(flag == "R", "subtitle").otherwise("video")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("index"), kind.alias("kind"), (F.col("l_linestatus") == "F").alias("is_default"),
        F.when(F.col("l_partkey") % 2 == 0, "mov_text").otherwise("ass").alias("codec_name"),
    )


STREAMS = """st AS (SELECT l_orderkey AS file_id, l_linenumber AS index, CASE l_returnflag WHEN 'A' THEN 'audio' WHEN 'R' THEN 'subtitle' ELSE 'video' END AS kind,
  l_linestatus = 'F' AS is_default, CASE WHEN l_partkey % 2 = 0 THEN 'mov_text' ELSE 'ass' END AS codec_name FROM lineitem)"""


@query(f"WITH {STREAMS} SELECT file_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}, count(*) FILTER (kind = '{k}' AND is_default) AS default_{k}" for k in ("video", "audio", "subtitle")) + " FROM st GROUP BY file_id")
def a04_stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Streams of each kind."""
    return media.stream_counts(file_streams(spark, d))


@query(f"WITH {STREAMS}, m AS (SELECT *, kind <> 'subtitle' OR codec_name = 'mov_text' AS kept FROM st) SELECT file_id, index, kind, CASE WHEN kept THEN row_number() OVER (PARTITION BY file_id, kind, kept ORDER BY index) - 1 END AS out_idx, CASE WHEN NOT kept THEN 'no ' || codec_name || ' in mp4' END AS reason FROM m")
def d11_mapped_streams(spark: SparkSession, d: str) -> DataFrame:
    """Streams mapped into MP4."""
    return media.mapped_streams(file_streams(spark, d), "mp4")


@query("SELECT o_orderkey AS file_id, CASE WHEN o_orderstatus = 'F' THEN 'ffmpeg' WHEN o_custkey % 3 = 0 THEN 'mkvmerge' WHEN o_custkey % 5 > 1 THEN 'mkvmerge' ELSE 'ffmpeg+propedit' END AS tool FROM orders")
def d11_muxer(spark: SparkSession, d: str) -> DataFrame:
    """The tool that writes each file."""
    o = table(spark, d, "orders")
    container = F.when(F.col("o_orderstatus") == "F", "mp4").otherwise("mkv")
    tool = media.muxer(container, (F.col("o_custkey") % 3 == 0).cast("int"), F.col("o_custkey") % 5)
    return o.select(F.col("o_orderkey").alias("file_id"), tool.alias("tool"))


@query("""WITH p AS (SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 13 > 0 THEN o_totalprice END AS ed, o_totalprice + (o_orderkey % 5) / 10.0::DOUBLE AS gd, 1 + (o_orderkey % 7 = 0)::INT AS gv,
  CASE WHEN o_custkey % 3 > 0 THEN 1920 END AS tw, 1080 AS th, 1920 - o_orderkey % 4 AS gw, CASE WHEN o_orderkey % 11 > 0 THEN 1080 END AS gh,
  o_orderkey % 3 AS ea, o_custkey % 3 AS ga, 2 AS es, 2 - (o_custkey % 9 = 0)::INT AS gs, o_custkey % 4 AS ec, o_orderkey % 2 AS gc, o_orderkey % 2 AS ead, o_custkey % 2 AS gad FROM orders)
SELECT file_id, 'duration_mismatch' AS code, 'failure' AS severity, printf('%.3fs', ed) AS expected, printf('%.3fs', gd) AS got FROM p WHERE abs(ed - gd) > 0.20
UNION ALL SELECT file_id, 'duration_unknown', 'note', NULL, gd::VARCHAR FROM p WHERE ed IS NULL
UNION ALL SELECT file_id, 'video_stream_count', 'failure', '1', gv::VARCHAR FROM p WHERE gv <> 1
UNION ALL SELECT file_id, 'video_resolution', 'failure', tw || 'x' || th, gw || 'x' || coalesce(gh::VARCHAR, '?') FROM p WHERE tw IS NOT NULL AND (abs(tw - gw) > 2 OR gh IS NULL OR abs(th - gh) > 2)
UNION ALL SELECT file_id, 'video_resolution_drift', 'failure', '1920', gw::VARCHAR FROM p WHERE tw IS NULL AND abs(1920 - gw) > 2
UNION ALL SELECT file_id, 'audio_stream_count', 'failure', ea::VARCHAR, ga::VARCHAR FROM p WHERE ea <> ga
UNION ALL SELECT file_id, 'subtitle_stream_count', 'failure', es::VARCHAR, gs::VARCHAR FROM p WHERE es <> gs
UNION ALL SELECT file_id, 'chapters_lost', 'failure', ec::VARCHAR, gc::VARCHAR FROM p WHERE ec > 0 AND gc <> ec
UNION ALL SELECT file_id, 'audio_streams_default_lost', 'failure', ead::VARCHAR, gad::VARCHAR FROM p WHERE gad < ead""")
def d12_validation(spark: SparkSession, d: str) -> DataFrame:
    """Rules that an output breaks, with their severity."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    pairs = table(spark, d, "orders").select(
        o.alias("file_id"), F.when(o % 13 > 0, F.col("o_totalprice")).alias("e_duration"), (F.col("o_totalprice") + (o % 5) / 10.0).alias("g_duration"),
        (1 + (o % 7 == 0).cast("int")).alias("g_video"), F.when(c % 3 > 0, 1920).alias("target_w"), F.lit(1080).alias("target_h"), F.lit(1920).alias("e_width"),
        (1920 - o % 4).alias("g_width"), F.when(o % 11 > 0, 1080).alias("g_height"), (o % 3).alias("e_audio"), (c % 3).alias("g_audio"),
        F.lit(2).alias("e_subtitle"), (2 - (c % 9 == 0).cast("int")).alias("g_subtitle"), (c % 4).alias("e_chapters"), (o % 2).alias("g_chapters"),
        F.lit(True).alias("copy_chapters"), (o % 2).alias("e_audio_default"), (c % 2).alias("g_audio_default"),
    )
    return media.validation_report(pairs)


@query("SELECT s_suppkey::VARCHAR AS tool_id, '7.' || (s_suppkey % 3)::VARCHAR AS expected, CASE WHEN s_suppkey % 4 <> 0 THEN ' 7.' || (s_suppkey % 2)::VARCHAR || '.1' END AS version, CASE WHEN s_suppkey % 4 = 0 THEN 'missing' ELSE 'mismatch' END AS status FROM supplier WHERE s_suppkey % 4 = 0 OR s_suppkey % 3 <> s_suppkey % 2")
def d20_missing_pins(spark: SparkSession, d: str) -> DataFrame:
    """Tools to fetch."""
    s = table(spark, d, "supplier")
    pins = s.select(F.col("s_suppkey").cast("string").alias("tool_id"), F.concat(F.lit("7."), (F.col("s_suppkey") % 3).cast("string")).alias("expected"))
    have = s.where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").cast("string").alias("tool_id"), F.concat(F.lit(" 7."), (F.col("s_suppkey") % 2).cast("string"), F.lit(".1")).alias("version"))
    return media.missing_pins(pins, have)


WANTED = "av1_nvenc", "hevc_nvenc", "hevc_qsv", "av1_d3d12"


@query(f"""WITH RECURSIVE f(encoder, rank, fallback) AS (VALUES {', '.join(map(str, encoders.FALLBACKS))}),
w AS (SELECT n_nationkey AS host, unnest({list(WANTED)}) AS wanted FROM nation),
c AS (SELECT DISTINCT n_nationkey AS host, e AS encoder FROM nation, (SELECT encoder AS e FROM f UNION SELECT fallback FROM f) WHERE (n_nationkey * 7 + length(e)) % 3 = 0 OR e = 'libx264'),
r AS (SELECT host, wanted, wanted AS encoder, [wanted] AS path, 0 AS depth, '' AS ranks FROM w UNION ALL
  SELECT host, wanted, fallback, list_append(path, fallback), depth + 1, ranks || rank::VARCHAR FROM r JOIN f ON f.encoder = r.encoder WHERE NOT list_contains(path, fallback) AND depth < 6),
b AS (SELECT r.*, row_number() OVER (PARTITION BY r.host, wanted ORDER BY depth, ranks, r.encoder) AS k FROM r JOIN c ON c.host = r.host AND c.encoder = r.encoder)
SELECT host, wanted, encoder, depth, array_to_string(path, '>') AS path FROM b WHERE k = 1""")
def d13_encoders(spark: SparkSession, d: str) -> DataFrame:
    """The encoder that each host falls back to."""
    edges = spark.createDataFrame(encoders.FALLBACKS, "encoder string, rank int, fallback string")
    host = table(spark, d, "nation").select(F.col("n_nationkey").alias("host"))
    names = spark.createDataFrame([(e,) for e in sorted({x for a, _, b in encoders.FALLBACKS for x in (a, b)})], "encoder string")
    can = host.join(F.broadcast(names), ((F.col("host") * 7 + F.length("encoder")) % 3 == 0) | (F.col("encoder") == "libx264"))
    wanted = host.select("host", F.explode(F.array(*map(F.lit, WANTED))).alias("wanted"))
    return encoders.resolved(wanted, can, F.broadcast(edges))


@query("""SELECT c_custkey AS id, floor(c_acctbal + 0.5)::BIGINT AS up, round_even(c_acctbal, 0)::BIGINT AS even, trunc(c_acctbal)::BIGINT AS cut,
  CASE WHEN c_custkey > 0 THEN (c_custkey * 1000 // gcd(c_custkey * 1000, 1001)) END AS num, CASE WHEN c_custkey > 0 THEN 1001 // gcd(c_custkey * 1000, 1001) END AS den,
  lpad(c_custkey::VARCHAR, 8, '0') || '.png' AS frame, least(greatest(c_acctbal, 0), 5000) AS clamped,
  CASE WHEN c_acctbal / 5000 <= 1 THEN least(greatest(c_acctbal / 5000, 0), 1) * 67.5 ELSE c_acctbal / 5000 END AS threshold,
  least(greatest(c_custkey - 5, 0), 100)::VARCHAR || '/100' AS progress, c_custkey // 360 * 360 AS tile,
  CASE WHEN c_custkey % 6 = 0 THEN 'default+forced' WHEN c_custkey % 2 = 0 THEN 'default' WHEN c_custkey % 3 = 0 THEN 'forced' ELSE '0' END AS flags,
  lpad((c_custkey // 3600)::VARCHAR, 2, '0') || ':' || lpad((c_custkey % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((c_custkey % 60)::VARCHAR, 2, '0') AS elapsed,
  CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 90 + 60.5 ELSE 3600 + c_custkey % 60 * 60 + 1.25 END::DOUBLE AS seconds, c_custkey::DOUBLE AS rate FROM customer""")
def f01_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Scalar rules."""
    k, x = F.col("c_custkey"), F.col("c_acctbal")
    r = fn.rational(F.concat((k * 1000).cast("string"), F.lit("/1001")))
    clock = F.when(k % 2 == 0, F.concat(F.lit("1:"), (k % 90).cast("string"), F.lit(".5"))).otherwise(F.concat(F.lit("1:"), (k % 60).cast("string"), F.lit(":1.25")))
    return table(spark, d, "customer").select(
        k.alias("id"), fn.half_up(x).alias("up"), fn.half_even(x).alias("even"), fn.truncated(x).alias("cut"), r["num"].alias("num"), r["den"].alias("den"),
        fn.frame_name(k).alias("frame"), fn.clamp(x, 0.0, 5000.0).alias("clamped"), fn.scene_threshold(x / 5000).alias("threshold"),
        fn.progress_text(F.least(k - 5, F.lit(100)), F.lit(100)).alias("progress"), fn.tile_bucket(k).alias("tile"),
        fn.flags_text(default=k % 2 == 0, forced=k % 3 == 0).alias("flags"), fn.elapsed_text(k).alias("elapsed"), fn.clock_seconds(clock).alias("seconds"),
        fn.number_without_unit(F.concat(k.cast("string"), F.lit("kbits/s"))).alias("rate"),
    )


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'nvidia' WHEN 1 THEN 'intel' WHEN 2 THEN 'amd' ELSE 'unknown' END AS vendor,
  CASE s_suppkey % 3 WHEN 0 THEN 'nvenc' WHEN 1 THEN 'software' ELSE 'qsv' END AS family, CASE s_suppkey % 2 WHEN 0 THEN 'Scene Detect' ELSE 'Mux' END AS label,
  CASE s_suppkey % 3 WHEN 0 THEN 1920 WHEN 1 THEN 1280 END AS width FROM supplier""")
def f15_names(spark: SparkSession, d: str) -> DataFrame:
    """names read into classes."""
    k = F.col("s_suppkey")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (k % n + 1).cast("int"))
    return table(spark, d, "supplier").select(
        k.alias("id"), fn.vendor(pick(4, "NVIDIA GeForce", "Intel UHD", "Radeon RX", "Basic Display")).alias("vendor"),
        fn.encoder_family(pick(3, "hevc_nvenc", "libx265", "h264_qsv")).alias("family"), fn.stage_label(pick(2, "03_scene_detect", "09_mux")).alias("label"),
        fn.resolution(pick(3, "1080p", "720P", "odd"))["width"].alias("width"),
    )


@query("""WITH m AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice / 100 END AS dec, o_totalprice / 90 AS st, CASE WHEN o_custkey % 2 = 0 THEN o_totalprice / 95 END AS nb, CASE WHEN o_custkey % 5 > 0 THEN o_totalprice / 97 ELSE 0 END AS co FROM orders),
t AS (SELECT *, least(st, nb) AS tr, greatest(st, nb) AS lo FROM m)
SELECT id, coalesce(dec, CASE WHEN nullif(co, 0) < tr - 0.05 THEN lo ELSE tr END, nullif(co, 0)) AS duration FROM t""")
def d02_planning_duration(spark: SparkSession, d: str) -> DataFrame:
    """The duration that a plan takes."""
    o, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    value = timeline.planning_duration(F.when(o % 4 == 0, p / 100), p / 90, F.when(c % 2 == 0, p / 95), F.when(c % 5 > 0, p / 97).otherwise(0.0))
    return table(spark, d, "orders").select(o.alias("id"), value.alias("duration"))


@query("""WITH b AS (SELECT o_custkey AS source_id, max(o_totalprice) / 100 AS duration FROM orders GROUP BY o_custkey),
k AS (SELECT source_id, duration, unnest(range(60, 601, 60)) AS chunk FROM b), f AS (SELECT *, least(chunk::DOUBLE, duration) * 24 * 1000 AS bytes FROM k)
SELECT source_id, max(chunk) FILTER (bytes <= 5000000) AS chunk, bool_and(bytes <= 5000000) AS all_fit FROM f GROUP BY source_id""")
def d08_largest_chunk(spark: SparkSession, d: str) -> DataFrame:
    """The longest chunk whose largest batch fits the free bytes."""
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("source_id")).agg((F.max("o_totalprice") / 100).alias("duration"))
    k = b.select("source_id", "duration", F.explode(F.sequence(F.lit(60).cast("long"), F.lit(600).cast("long"), F.lit(60).cast("long"))).alias("chunk"))
    fits = F.least(F.col("chunk").cast("double"), F.col("duration")) * 24 * 1000 <= 5_000_000
    return k.groupBy("source_id").agg(F.max(F.when(fits, F.col("chunk"))).alias("chunk"), F.bool_and(fits).alias("all_fit"))


@query("SELECT file_id, filename, coalesce(size, 0) AS size FROM (SELECT l_orderkey AS file_id, 'font' || l_linenumber::VARCHAR AS filename FROM lineitem) LEFT JOIN (SELECT o_orderkey AS file_id, 'font2' AS filename, o_custkey AS size FROM orders) USING (file_id, filename)")
def j06_attachment_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Attachments with reported sizes."""
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.concat(F.lit("font"), F.col("l_linenumber").cast("string")).alias("filename"))
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), F.lit("font2").alias("filename"), F.col("o_custkey").alias("size"))
    return media.attachment_sizes(a, s)


@query("SELECT DISTINCT l_orderkey AS job_id, l_linenumber AS stage_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey % 10 = o_custkey % 10")
def d16_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Stages whose stored key is the wanted one."""
    w = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("stage_name"), (F.col("l_suppkey") % 10).alias("wanted_key"))
    c = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("stage_name"), (F.col("o_custkey") % 10).alias("cache_key"))
    return jobs.cache_hits(w.distinct(), c.distinct()).select("job_id", "stage_name").distinct()


@query("SELECT n_nationkey AS id, 'fast' AS preset, (n_nationkey + 10)::VARCHAR AS crf, CASE WHEN n_nationkey % 2 = 0 THEN 'film' END AS tune FROM nation")
def u07_merged_settings(spark: SparkSession, d: str) -> DataFrame:
    """Overrides merged into settings."""
    n = F.col("n_nationkey")
    base = F.concat(F.lit('{"preset":"slow","crf":"'), (n + 10).cast("string"), F.lit('"}'))
    over = F.when(n % 2 == 0, '{"preset":"fast","tune":"film"}').otherwise('{"preset":"fast"}')
    m = jobs.merged_json(base, over)
    return table(spark, d, "nation").select(n.alias("id"), *(F.try_element_at(m, F.lit(k)).alias(k) for k in ("preset", "crf", "tune")))


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY ALL")
def t09_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of a day."""
    e = table(spark, d, "events")
    w = e.groupBy("event_type", F.window("ts", "1 day")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    return w.select("event_type", F.col("window.start").alias("day"), "n", "total")


# Relational surface that Spark gives; the reference has no such general operators.
@query("SELECT c_mktsegment, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (c_mktsegment, n_name)")
def rel_cube(spark: SparkSession, d: str) -> DataFrame:
    """Join and cube (Spark's own)."""
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).cube("c_mktsegment", "n_name").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sum_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def rel_pricing(spark: SparkSession, d: str) -> DataFrame:
    """Filter and aggregate (Spark's own)."""
    l = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"), F.count("*").alias("n"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def rel_set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Intersection and difference (Spark's own; U08)."""
    o = table(spark, d, "orders")
    of = lambda s: o.where(F.col("o_orderstatus") == s).select("o_custkey")
    return of("O").intersect(table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey")).subtract(of("F"))


@query("SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) FULL JOIN (SELECT * FROM orders WHERE o_orderkey % 3 = 0) ON c_custkey = o_custkey")
def rel_full_join(spark: SparkSession, d: str) -> DataFrame:
    """Full outer join (Spark's own; J15)."""
    c = table(spark, d, "customer").where("c_custkey % 2 = 0")
    return c.join(table(spark, d, "orders").where("o_orderkey % 3 = 0"), F.col("c_custkey") == F.col("o_custkey"), "full").select("c_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus)")
def rel_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Ranking windows (Spark's own; W14)."""
    w = W.partitionBy("o_custkey").orderBy("o_orderstatus")
    q = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("dr"), F.ntile(4).over(q).alias("q"))
