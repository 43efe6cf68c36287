"""Queries of the work queue and of streams that keep state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import queue as q
from ..operators.lifecycle import claim_order
from ..session import scratch
from ..streaming import live
from ..streaming import sessions as s
from .lifecycle import _work
from .streams import _run
from .tables import TURNS_SQL, micros, turns

_WORK_SQL = """w AS (SELECT event_id AS episode_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'terminal' ELSE 'complete' END AS state,
        CASE WHEN event_type = 'click' THEN 't' || event_id % 10 END AS token, CASE WHEN event_type = 'click' THEN event_id % 100 END AS lease_until,
        CASE WHEN event_type = 'error' THEN event_id % 70 END AS retry_after, CASE WHEN event_type = 'error' THEN 'old' END AS error FROM events)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, i, kind = table(spark, sf_dir, "events"), F.col("event_id"), F.col("event_type")
    state = F.when(kind == "view", "pending").when(kind == "click", "processing").when(kind == "error", "failed").when(kind == "signup", "terminal").otherwise("complete")
    held = lambda x, of: F.when(kind == of, x)
    return ev.select(i.alias("episode_id"), state.alias("state"), held(F.concat(F.lit("t"), (i % 10).cast("string")), "click").alias("token"), held(i % 100, "click").alias("lease_until"), held(i % 70, "error").alias("retry_after"), held(F.lit("old"), "error").alias("error"))


@query("due_promotion", f"""WITH {_WORK_SQL}, d AS (SELECT *, coalesce((state = 'failed' AND retry_after <= 50) OR (state = 'processing' AND lease_until <= 50), false) AS again FROM w)
    SELECT episode_id, CASE WHEN again THEN 'pending' ELSE state END AS state, CASE WHEN NOT again THEN token END AS token, CASE WHEN NOT again THEN lease_until END AS lease_until,
           CASE WHEN NOT again THEN retry_after END AS retry_after, error FROM d""")
def due_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work at second 50: lapsed leases and retries that have come are pending again."""
    return q.due(_items(spark, sf_dir), 50)


@query("queue_transitions", f"""WITH {_WORK_SQL}, c AS (SELECT event_id AS episode_id, ['renew', 'fail', 'terminal', 'complete', 'retry'][CAST(user_id % 5 + 1 AS INTEGER)] AS op, 't' || user_id % 10 AS t, 40 AS moment,
        CASE WHEN user_id % 3 = 0 THEN 30 ELSE 120 END AS until, CASE WHEN user_id % 4 = 0 THEN ' ' ELSE 'why' END AS reason FROM events WHERE event_id % 7 <> 0),
    j AS (SELECT w.*, c.op, c.moment, c.until, trim(c.reason) AS reason, coalesce(state = 'processing' AND token = t AND lease_until > moment, false) AS held FROM w LEFT JOIN c USING (episode_id)),
    o AS (SELECT *, CASE WHEN op IS NULL THEN '-' WHEN op = 'retry' AND state = 'terminal' THEN 'done' WHEN op = 'retry' THEN 'not terminal' WHEN NOT held THEN 'no live lease' WHEN op = 'renew' AND until <= lease_until THEN 'not later'
            WHEN op = 'fail' AND (reason = '' OR until <= moment) THEN 'invalid' WHEN op = 'terminal' AND reason = '' THEN 'invalid' ELSE 'done' END AS outcome FROM j)
    SELECT episode_id, outcome, CASE WHEN outcome <> 'done' OR op = 'renew' THEN state ELSE CASE op WHEN 'fail' THEN 'failed' WHEN 'terminal' THEN 'terminal' WHEN 'complete' THEN 'complete' ELSE 'pending' END END AS state,
        CASE WHEN outcome <> 'done' OR op = 'renew' THEN token END AS token, CASE WHEN outcome <> 'done' THEN lease_until WHEN op = 'renew' THEN until END AS lease_until,
        CASE WHEN outcome <> 'done' OR op = 'renew' THEN retry_after WHEN op = 'fail' THEN until END AS retry_after,
        CASE WHEN outcome <> 'done' THEN error WHEN op IN ('fail', 'terminal') THEN reason WHEN op = 'retry' THEN NULL ELSE error END AS error FROM o""")
def queue_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command for six of seven works: renewed, failed, given up, completed, tried again, or refused."""
    ev, u = table(spark, sf_dir, "events").where("event_id % 7 <> 0"), F.col("user_id")
    op = F.element_at(F.array(*map(F.lit, ("renew", "fail", "terminal", "complete", "retry"))), (u % 5 + 1).cast("int"))
    c = ev.select(F.col("event_id").alias("episode_id"), op.alias("op"), F.concat(F.lit("t"), (u % 10).cast("string")).alias("token"), F.lit(40).alias("at"), F.when(u % 3 == 0, 30).otherwise(120).alias("until"), F.when(u % 4 == 0, " ").otherwise("why").alias("reason"))
    return q.transitions(_items(spark, sf_dir), c)


@query("work_stream", f"""WITH {_WORK_SQL}, q AS (SELECT w.*, e.user_id FROM w JOIN events e ON event_id = episode_id WHERE event_id % 7 <> 0),
    c AS (SELECT *, ['renew', 'fail', 'terminal', 'complete', 'retry'][CAST(user_id % 5 + 1 AS INTEGER)] AS op, 't' || user_id % 10 AS t, CASE WHEN user_id % 3 = 0 THEN 30 ELSE 120 END AS until, CASE WHEN user_id % 4 = 0 THEN '' ELSE 'why' END AS reason FROM q),
    j AS (SELECT *, coalesce(state = 'processing' AND token = t AND lease_until > 40, false) AS held FROM c),
    o AS (SELECT *, CASE WHEN op = 'retry' AND state = 'terminal' THEN 'done' WHEN op = 'retry' THEN 'not terminal' WHEN NOT held THEN 'no live lease' WHEN op = 'renew' AND until <= lease_until THEN 'not later'
            WHEN op = 'fail' AND (reason = '' OR until <= 40) THEN 'invalid' WHEN op = 'terminal' AND reason = '' THEN 'invalid' ELSE 'done' END AS outcome FROM j),
    s AS (SELECT episode_id, op, outcome, CASE WHEN outcome <> 'done' OR op = 'renew' THEN state ELSE CASE op WHEN 'fail' THEN 'failed' WHEN 'terminal' THEN 'terminal' WHEN 'complete' THEN 'complete' ELSE 'pending' END END AS state,
        CASE WHEN outcome <> 'done' OR op = 'renew' THEN token END AS token, CASE WHEN outcome <> 'done' THEN lease_until WHEN op = 'renew' THEN until END AS lease_until,
        CASE WHEN outcome <> 'done' OR op = 'renew' THEN retry_after WHEN op = 'fail' THEN until END AS retry_after,
        CASE WHEN outcome <> 'done' THEN error WHEN op IN ('fail', 'terminal') THEN reason WHEN op = 'retry' THEN NULL ELSE error END AS error, coalesce(state = 'processing' AND lease_until <= 40 OR state = 'failed' AND retry_after <= 40, false) AS ripe FROM o)
    SELECT episode_id, op, outcome, state, token, CAST(1000 * lease_until AS BIGINT) AS lease_until, CAST(1000 * retry_after AS BIGINT) AS retry_after, error FROM s
    UNION ALL SELECT episode_id, 'claim', CASE WHEN state IN ('terminal', 'complete') THEN 'not ready' ELSE 'done' END, CASE WHEN state IN ('terminal', 'complete') THEN state ELSE 'processing' END,
        CASE WHEN state IN ('pending', 'failed', 'processing') THEN sha256(episode_id || ':1:w') END, CASE WHEN state IN ('pending', 'failed', 'processing') THEN 900000 END, NULL, CASE WHEN state IN ('terminal', 'complete') THEN error END FROM s""")
def work_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commands of `queue_transitions` at second 40 as a stream over the same work as its first state; at
    second 500, when every lease has lapsed and every retry has come, each work is claimed."""
    ev, u = table(spark, sf_dir, "events").where("event_id % 7 <> 0"), F.col("user_id")
    op = F.element_at(F.array(*map(F.lit, ("renew", "fail", "terminal", "complete", "retry"))), (u % 5 + 1).cast("int"))
    until = F.when(u % 3 == 0, 30).otherwise(120).cast("long") * 1000
    first = ev.select(F.col("event_id").alias("episode_id"), F.lit(0).cast("long").alias("sequence"), op.alias("op"), F.concat(F.lit("t"), (u % 10).cast("string")).alias("token"), F.timestamp_seconds(F.lit(40)).alias("at"), until.alias("until"), F.when(u % 4 == 0, " ").otherwise("why").alias("reason"))
    claims = first.select("episode_id", F.lit(1).cast("long").alias("sequence"), F.lit("claim").alias("op"), F.lit("w").alias("token"), F.timestamp_seconds(F.lit(500)).alias("at"), F.lit(900_000).cast("long").alias("until"), F.lit(None).cast("string").alias("reason"))
    held = _items(spark, sf_dir).withColumns({"attempt": F.lit(0).cast("long"), "lease_until": F.col("lease_until") * 1000, "retry_after": F.col("retry_after") * 1000})
    path = f"{scratch(spark)}/commands-{uuid.uuid4().hex}"
    first.coalesce(1).write.parquet(path)
    claims.coalesce(1).write.mode("append").parquet(path)
    # files come by their time: the commands of second 40 are the first batch
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return _run(live.work_stream(stream, held)).where("sequence >= 0").drop("sequence", "attempt")


@query("work_claim", """
    WITH w AS (SELECT event_id, user_id % 3 AS priority, epoch_us(ts) // 86400000000 AS source_time, event_type, event_id % 100 AS lease_until, event_id % 70 AS retry_after FROM events),
    p AS (SELECT event_id, row_number() OVER (ORDER BY priority, source_time, event_id) AS place FROM w WHERE event_type = 'view' OR (event_type = 'click' AND lease_until <= 50) OR (event_type = 'error' AND retry_after <= 50))
    SELECT event_id AS episode_id, event_id % 3 + 1 AS attempt, 80 AS lease_until, sha256(event_id || ':' || (event_id % 3 + 1) || ':w1') AS token FROM p WHERE place <= 10""")
def work_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten works at the head of the queue leased to a worker for 30 seconds from second 50."""
    ready = claim_order(_work(spark, sf_dir), ["event_id"], 50).select("place", F.col("event_id").alias("episode_id"), (F.col("event_id") % 3).alias("attempt"))
    return s.claim(ready, "w1", 50, 30, 10)


@query("backpressure", "SELECT event_id, greatest(coalesce(CASE WHEN event_id % 3 <> 0 THEN CAST(value AS BIGINT) END, 0), 60) AS delay FROM events")
def backpressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wait after a model asked for one, or for none."""
    return table(spark, sf_dir, "events").select("event_id", q.delay(F.when(F.col("event_id") % 3 != 0, F.rint("value").cast("long"))).alias("delay"))


@query("mention_queue", """
    WITH m AS (SELECT user_id AS owner, event_type AS mention, min(event_id) AS arrived, max(CASE WHEN event_id % 5 = 0 THEN event_id % 60 END) AS nb FROM events GROUP BY 1, 2),
    f AS (SELECT user_id AS owner, event_type AS mention FROM events GROUP BY 1, 2 HAVING count(*) % 4 = 0), r AS (SELECT * FROM m WHERE coalesce(nb, 50) <= 50 AND NOT EXISTS (SELECT 1 FROM f WHERE f.owner = m.owner AND f.mention = m.mention)),
    p AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY arrived, mention) AS place FROM r)
    SELECT p.owner, p.mention, place FROM p WHERE place + (SELECT count(*) FROM f WHERE f.owner = p.owner) <= 2""")
def mention_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's mentions (types) in the order they came, two at once, some deferred, some in flight."""
    ev, i = table(spark, sf_dir, "events"), F.col("event_id")
    queued = ev.select(F.col("user_id").alias("owner"), F.col("event_type").alias("mention"), i.alias("arrived"), F.when(i % 5 == 0, i % 60).alias("not_before"))
    flying = queued.groupBy("owner", "mention").count().where("count % 4 = 0").select("owner", "mention")
    return q.waiting_mentions(queued, flying, 50, 2)


@query("background_pass", """
    SELECT 'queue' AS lane, event_id AS id FROM events WHERE event_type = 'error' UNION ALL SELECT 'vectors', doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
    UNION ALL SELECT 'statements', doc_id FROM (SELECT doc_id FROM labels WHERE quality = 1 ORDER BY doc_id % 30, doc_id LIMIT 64)""")
def background_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one pass takes up: errors as the queue, documents without a vector, 64 good labels."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    lacking = d.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), "id", "left_anti")
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 30).alias("since"))
    return q.background_pass(table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("id")), lacking, good)


@query("explicit_cuts", """
    WITH e AS (SELECT user_id, epoch_us(ts) AS us, CASE event_type WHEN 'purchase' THEN 'create_memory' WHEN 'signup' THEN 'explicit' END AS c FROM events),
    f AS (SELECT *, CASE WHEN us - lag(us) OVER w < 21600000000 AND lag(c) OVER w IS NULL THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, c NULLS FIRST)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, c NULLS FIRST ROWS UNBOUNDED PRECEDING) AS session FROM f),
    k AS (SELECT user_id, CAST(session AS BIGINT) AS session, min(us) AS start, max(us) AS "end", count(*) AS n, max(c) AS c FROM g GROUP BY 1, 2)
    SELECT user_id, session, start, "end", n, coalesce(c, CASE WHEN session = max(session) OVER (PARTITION BY user_id) THEN 'open' ELSE 'inactivity' END) AS boundary FROM k""")
def explicit_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that a purchase (a statement is made) or a signup (explicitly) ends at once."""
    ev = table(spark, sf_dir, "events")
    c = F.when(F.col("event_type") == "purchase", "create_memory").when(F.col("event_type") == "signup", "explicit")
    return s.cut_sessions(ev.select("user_id", micros("ts").alias("us"), c.alias("control")), "user_id", "us", "control", 21_600_000_000)


@query("session_states", """
    WITH l AS (SELECT user_id AS session, event_id AS sequence, CASE event_type WHEN 'signup' THEN 'open' WHEN 'error' THEN 'close' ELSE 'move' END AS op, CASE WHEN event_type <> 'error' THEN event_id END AS leaf FROM events),
    b AS (SELECT *, coalesce(last_value(CASE WHEN op <> 'move' THEN op = 'open' END IGNORE NULLS) OVER (PARTITION BY session ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS was FROM l),
    c AS (SELECT *, (op = 'open' AND was) OR (op <> 'open' AND NOT was) AS bad FROM b)
    SELECT session, CASE WHEN coalesce(max_by(op, sequence) FILTER (WHERE op <> 'move'), 'close') = 'open' THEN 'open' ELSE 'closed' END AS state,
           max_by(leaf, sequence) FILTER (WHERE NOT bad AND leaf IS NOT NULL) AS leaf, count(*) FILTER (WHERE bad) AS problems FROM c GROUP BY session""")
def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' sessions: a signup opens, an error closes, all else moves the leaf."""
    ev, kind = table(spark, sf_dir, "events"), F.col("event_type")
    op = F.when(kind == "signup", "open").when(kind == "error", "close").otherwise("move")
    return s.open_sessions(ev.select(F.col("user_id").alias("session"), F.col("event_id").alias("sequence"), op.alias("op"), F.when(kind != "error", F.col("event_id")).alias("leaf")))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    half = F.floor(F.char_length("text") / 2).cast("int")
    part = lambda n, kind, text: F.struct(F.lit(n).alias("sequence"), kind.alias("kind"), text.alias("text"))
    text, none = F.lit("text"), F.lit(None).cast("string")
    end = F.when(F.col("turn") % 5 == 4, "cancel").otherwise("complete")
    parts = F.array(part(2, text, F.substr("text", half + 1)), part(0, F.lit("begin"), none), part(1, text, F.substr("text", F.lit(1), half)), part(1, text, F.substr("text", F.lit(1), half)), part(3, end, none))
    return t.select(F.concat_ws(":", "conv_id", "turn").alias("message_id"), "turn", F.explode(parts).alias("p")).where("turn % 7 <> 6 or p.sequence < 2").select("message_id", "p.*")


@query("stream_recovery", """
    SELECT conv_id || ':' || turn AS message_id, CASE WHEN turn % 7 = 6 THEN 'interrupt' WHEN turn % 5 = 4 THEN 'cancel' ELSE 'complete' END AS state,
           CASE WHEN turn % 7 = 6 THEN substr(text, 1, CAST(length(text) // 2 AS INTEGER)) ELSE text END AS text, CAST(CASE WHEN turn % 7 = 6 THEN 1 ELSE 2 END AS BIGINT) AS chunks FROM conversations""")
def stream_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a restart: messages that never ended are interrupted, with the text they had."""
    return s.checkpointed(_parts(spark, sf_dir))


def _streamed(df: DataFrame) -> DataFrame:
    """df as a stream of several files."""
    path = f"{scratch(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    df.repartition(3).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("window_stream", f"""WITH {TURNS_SQL}, n AS (SELECT conversation_id, count(*) AS length FROM turns GROUP BY 1), w AS (SELECT conversation_id, unnest(range(0, length - 3, 2)) AS start FROM n WHERE length >= 4)
    SELECT w.conversation_id, start, start + 4 AS "end", string_agg(role || ': ' || content, chr(10) ORDER BY turn) AS text FROM w JOIN turns t ON t.conversation_id = w.conversation_id AND turn >= start AND turn < start + 4 GROUP BY ALL""")
def window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of four turns, two apart, as turns come in three batches out of order."""
    return _run(s.window_stream(_streamed(turns(spark, sf_dir).select("conversation_id", F.col("turn").alias("position"), "role", "content")), 4, 2))


@query("episode_stream", f"""WITH RECURSIVE {TURNS_SQL}, c AS (SELECT conversation_id, turn AS cycle, octet_length(encode(content)) AS bytes, count(*) OVER (PARTITION BY conversation_id) AS n FROM turns),
    p(conversation_id, cycle, episode, start, bytes) AS (SELECT conversation_id, cycle, 0, 0, bytes FROM c WHERE cycle = 0
        UNION ALL SELECT c.conversation_id, c.cycle, p.episode + CAST(p.bytes + c.bytes > 600 AS INT), CASE WHEN p.bytes + c.bytes > 600 THEN c.cycle ELSE p.start END, CASE WHEN p.bytes + c.bytes > 600 THEN c.bytes ELSE p.bytes + c.bytes END
        FROM p JOIN c ON c.conversation_id = p.conversation_id AND c.cycle = p.cycle + 1)
    SELECT conversation_id, CAST(episode AS BIGINT) AS episode, CAST(start AS BIGINT) AS start, max(cycle) + 1 AS "end", CAST(max(bytes) AS BIGINT) AS bytes FROM p
    GROUP BY conversation_id, episode, start QUALIFY episode < max(episode) OVER (PARTITION BY conversation_id)""")
def episode_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns packed into episodes of 600 bytes as they come in three batches; each conversation's open tail stays in the state."""
    t = turns(spark, sf_dir).select("conversation_id", F.col("turn").alias("cycle"), F.col("turn").alias("start"), (F.col("turn") + 1).alias("end"), F.octet_length("content").cast("long").alias("bytes"))
    return _run(s.episode_stream(_streamed(t), 600))
