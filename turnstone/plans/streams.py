"""Queries over event streams, and ingestion."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query, table
from ..session import scratch
from ..sources.jsonl import ingested
from ..streaming import live, receipts
from ..streaming import sessions as s
from .tables import TURNS_SQL, micros, turns

_SESSIONS_SQL = """e AS (SELECT user_id, epoch_us(ts) AS us FROM events), f AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) < 21600000000 THEN 0 ELSE 1 END AS new FROM e),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us) AS session FROM f)"""


@query("inactivity_sessions", f"WITH {_SESSIONS_SQL} SELECT user_id, CAST(session AS BIGINT) AS session, min(us) AS start, max(us) AS \"end\", count(*) AS n FROM g GROUP BY 1, 2")
def inactivity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events, cut where six hours or more pass."""
    ev = table(spark, sf_dir, "events").select("user_id", micros("ts").alias("us"))
    return s.sessions(ev, "user_id", "us", gap=21_600_000_000)


def _run(df: DataFrame, mode: str = "append") -> DataFrame:
    """A stream over what there is, to its end; the table that it wrote."""
    spark, path = df.sparkSession, f"{scratch(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    q = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


@query("session_stream", f"""WITH {_SESSIONS_SQL}, k AS (SELECT user_id, session, min(us) AS start, max(us) AS "end", count(*) AS n FROM g GROUP BY 1, 2),
    m AS (SELECT max(us) - 3600000000 AS mark FROM e)
    SELECT user_id, start, "end", n FROM k, m WHERE "end" + 21599999000 <= mark""")
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream: sessions whose gap has passed at the last watermark."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a stream reads folders: the table's file or folder is picked by its name
    ev = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{sf_dir}/events*.parquet")
    out = _run(s.session_stream(ev.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", gap=21_600))
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _in_batches(df: DataFrame, n: int, seed: int = 5) -> DataFrame:
    """df as a stream of files of rows in no order, read in n batches at most; all cores write them."""
    path = f"{scratch(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    files = -(-df.sparkSession.sparkContext.defaultParallelism // n)  # of a batch
    df.repartition(n * files, F.xxhash64(*df.columns, F.lit(seed))).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _at() -> Column:
    return F.timestamp_seconds(F.lit(1_700_000_000))


@query("stream_assemble", """
    SELECT conv_id || ':' || turn AS message_id, CASE WHEN turn % 5 = 4 THEN 'cancel' ELSE 'complete' END AS state, text, 2 AS chunks,
           CASE WHEN role = 'user' THEN 'a' || turn || ',b' || conv_id ELSE '' END AS files FROM conversations WHERE turn % 7 <> 6""")
def stream_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns sent as a beginning, two chunks (one twice), the user's with two files, and an end, in three
    shuffled batches; some never end."""
    t = table(spark, sf_dir, "conversations")
    half = F.floor(F.char_length("text") / 2).cast("int")
    part = lambda n, kind, text: F.struct(n.alias("sequence"), kind.alias("kind"), text.alias("text"))
    text, none, user = F.lit("text"), F.lit(None).cast("string"), F.col("role") == "user"
    end = F.when(F.col("turn") % 5 == 4, "cancel").otherwise("complete")
    first = part(F.lit(1), text, F.substr("text", F.lit(1), half))
    files = F.when(user, F.array(part(F.lit(3), F.lit("attach"), F.concat(F.lit("a"), "turn")), part(F.lit(4), F.lit("attach"), F.concat(F.lit("b"), "conv_id"))))
    parts = F.concat(F.array(part(F.lit(0), F.lit("begin"), none), first, first, part(F.lit(2), text, F.substr("text", half + 1)), part(F.when(user, 5).otherwise(3), end, none)), F.coalesce(files, F.array().cast("array<struct<sequence:int,kind:string,text:string>>")))
    rows = t.select(F.concat_ws(":", "conv_id", "turn").alias("message_id"), "turn", F.explode(parts).alias("p")).where("turn % 7 <> 6 or p.sequence < 3").select("message_id", "p.*", _at().alias("at"))
    return _run(live.assembled(_in_batches(rows.withColumn("n", F.monotonically_increasing_id()), 3).drop("n")))


@query("live_sessions", """
    WITH t AS (SELECT conv_id AS session, turn, conv_id || ':' || turn AS id, text, turn % 5 = 4 AS dropped, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
    k AS (SELECT session, turn, id, text, lag(id) OVER (PARTITION BY session ORDER BY turn) AS parent FROM t WHERE NOT dropped)
    SELECT session, CAST(6 * turn + 5 AS BIGINT) AS sequence, 'turn' AS outcome, id AS message_id, parent, text, 'f' || turn AS files FROM k
    UNION ALL SELECT t.session, 6 * t.turn + 5, 'cancelled', t.id, (SELECT max_by(k.id, k.turn) FROM k WHERE k.session = t.session AND k.turn < t.turn), NULL, NULL FROM t WHERE dropped
    UNION ALL SELECT session, 6 * turn + 2, 'in progress', 'other', NULL, NULL, NULL FROM t
    UNION ALL SELECT session, 6 * turn + 6, 'nothing in progress', id, NULL, NULL, NULL FROM t
    UNION ALL SELECT session, 0, 'opened', NULL, NULL, NULL, NULL FROM t WHERE turn = 0
    UNION ALL SELECT t.session, 6 * n + 1, 'closed', (SELECT max_by(k.id, k.turn) FROM k WHERE k.session = t.session), NULL, NULL, NULL FROM t WHERE turn = 0
    UNION ALL SELECT session, 6 * n + 2, 'unknown session', 'last', NULL, NULL, NULL FROM t WHERE turn = 0""")
def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as live sessions in four shuffled batches, each event of an odd turn twice: a turn
    begins, another can't, a text, a file, its end, and a text too late; the session is closed at last."""
    t = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "text", F.count("*").over(Window.partitionBy("conv_id")).alias("n"))
    id_, none = F.concat_ws(":", "conv_id", "turn"), F.lit(None).cast("string")
    ev = lambda k, op, message, text=none: F.struct((k if not isinstance(k, int) else F.col("turn") * 6 + k).cast("long").alias("sequence"), F.lit(op).alias("op"), message.alias("message_id"), text.alias("text"))
    end = F.when(F.col("turn") % 5 == 4, F.struct((F.col("turn") * 6 + 5).alias("sequence"), F.lit("cancel").alias("op"), id_.alias("message_id"), none.alias("text"))).otherwise(ev(5, "complete", id_))
    own = F.array(ev(1, "begin", id_), ev(2, "begin", F.lit("other")), ev(3, "text", id_, F.col("text")), ev(4, "attach", id_, F.concat(F.lit("f"), "turn")), end, ev(6, "text", id_, F.lit("late")))
    ends = F.array(ev(F.lit(0), "open", none), ev(F.col("n") * 6 + 1, "close", none), ev(F.col("n") * 6 + 2, "begin", F.lit("last")))
    twice = F.when(F.col("turn") % 2 == 1, F.concat(own, own)).when(F.col("turn") == 0, F.concat(own, ends)).otherwise(own)
    rows = t.select(F.col("conv_id").alias("session"), F.explode(twice).alias("e")).select("session", "e.*", _at().alias("at"), F.monotonically_increasing_id().alias("k"))
    return _run(live.live_sessions(_in_batches(rows, 4)))


@query("receipt_stream", """
    WITH a AS (SELECT user_id AS episode_id, CAST(event_id % 5 AS BIGINT) AS attempt, event_type AS result FROM events)
    SELECT episode_id, max(attempt) AS attempt, max(result) FILTER (WHERE attempt = m) AS result FROM (SELECT *, max(attempt) OVER (PARTITION BY episode_id) AS m FROM a) GROUP BY 1""")
def receipt_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of a stream of three batches in a table, the last batch tried once more."""
    a = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id"), (F.col("event_id") % 5).alias("attempt"), F.col("event_type").alias("result"), F.col("event_id").alias("k"))
    path = f"{scratch(spark)}/receipts-{uuid.uuid4().hex}"
    receipts.receipt_stream(_in_batches(a, 3).drop("k"), path, buckets=8).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start().awaitTermination()
    receipts.apply_batch(path, a.limit(5).withColumn("attempt", F.lit(99).cast("long")), receipts.entries(spark, path)[-1])
    return receipts.current(spark, path, "episode_id long, attempt long, result string")


@query("queue_state", """
    WITH a AS (SELECT user_id AS episode_id, CAST(event_id % 5 AS BIGINT) AS attempt, event_type AS result FROM events)
    SELECT episode_id, max(attempt) AS attempt, max(result) FILTER (WHERE attempt = m) AS result FROM (SELECT *, max(attempt) OVER (PARTITION BY episode_id) AS m FROM a) GROUP BY 1""")
def queue_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts applied in two batches, the second of them twice: the largest attempt stays."""
    a = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id"), (F.col("event_id") % 5).alias("attempt"), F.col("event_type").alias("result"))
    first, second = a.where("attempt < 3"), a.where("attempt >= 2")
    return s.upsert(s.upsert(s.upsert(first.limit(0), first), second), second)


@query("turn_ingest", f"""WITH {TURNS_SQL}
    SELECT 'new' AS outcome, conversation_id, id, content FROM turns WHERE turn >= 5 UNION ALL SELECT 'conflict', conversation_id, id, content || '!' FROM turns WHERE turn = 3""")
def turn_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns again, twice, over those before 5, with another text for turn 3."""
    t = turns(spark, sf_dir).select("conversation_id", "id", "turn", "role", "content")
    again = t.withColumn("content", F.when(F.col("turn") == 3, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    new, clash = ingested(t.where("turn < 5"), again.union(again), ["conversation_id", "id"])
    rows = lambda df, name: df.select(F.lit(name).alias("outcome"), "conversation_id", "id", "content")
    return rows(new, "new").union(rows(clash, "conflict"))
