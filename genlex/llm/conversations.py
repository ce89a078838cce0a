"""Problem 2: ordered conversations from single message rows.

Method: keyed streaming state with event-time watermarks. Message rows name only their parent, so a relational step first
gives every message its thread, the key of the state (pointer doubling: the number of joins grows with the logarithm of the
longest thread). The stream buffers the rows of a thread in whatever order they arrive, puts them together, validates the
conversations and emits the sound ones when the watermark tells that the thread is closed, or drops what is still broken
when its timeout passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from genlex.operators.threads import thread_members
from genlex.session import delete_path, materialize, shared_path

from .lookalikes import BLANKS

DAY = 86_400_000
# Spellings of the three speakers (compared in lower case, without blanks at the ends).
ROLES = {
    "user": ("user", "prompter", "human", "utilisateur", "utilisatrice", "humain", "usuario", "benutzer", "nutzer", "customer", "client"),
    "assistant": ("assistant", "assistante", "bot", "chatbot", "gpt", "chatgpt", "ai", "ia", "model", "modèle", "asistente", "assistent", "agent"),
    "system": ("system", "système", "systeme", "sistema", "sys", "systemprompt", "system_prompt"),
}
STATE_SCHEMA = "threads string"
EVENT_SCHEMA = "bucket bigint, thread string, id string, parent string, who string, readable boolean, version bigint, event_time timestamp"
OUT_SCHEMA = "thread string, revision bigint, root_id string, last_id string, n_messages int, leaf string, path array<string>"
REPLIES = ("su", "ua", "au")  # who may answer whom


def clean_id(c: Column) -> Column:
    """An id without blanks around it; blank ids are null."""
    bare = F.regexp_replace(c.cast("string"), f"^{BLANKS}|{BLANKS}$", "")
    return F.when(bare != "", bare)


def speaker(c: Column) -> Column:
    """``user``, ``assistant`` or ``system`` for any known spelling, else null."""
    bare = F.lower(F.regexp_replace(c, f"^{BLANKS}|{BLANKS}$", ""))
    out = F.lit(None).cast("string")
    for role, spellings in ROLES.items():
        out = F.when(bare.isin(*spellings), role).otherwise(out)
    return out


def latest_messages(messages: DataFrame) -> DataFrame:
    """``(id, parent, speaker, readable, content, at)``: of the rows of one id the latest by ``ingested_at`` (null is the earliest).

    Rows without an id are left out: nothing can refer to them. Rows that tie are ordered by ``created_at`` and their other
    values, so the result does not depend on row order. One partially combined aggregate: a repeated id is no hot group.
    """
    own = messages.select(
        clean_id(F.col("message_id")).alias("id"),
        F.struct(
            F.coalesce(F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(-(2**62))).alias("at"), F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(2**62))).alias("made"),
            clean_id(F.col("parent_id")).alias("parent"), speaker(F.col("role")).alias("speaker"), F.col("content"),
        ).alias("v"),
    ).where("id is not null")
    last = own.groupBy("id").agg(F.max("v").alias("v"))
    return last.select("id", "v.parent", "v.speaker", F.coalesce(F.col("v.content").rlike(r"[\p{L}\p{N}]"), F.lit(False)).alias("readable"), "v.content", F.col("v.at").alias("at"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def follow(pointers: DataFrame) -> DataFrame:
    """Every row of ``pointers`` with ``up`` moved to the top of its chain and ``hops`` steps to it.

    ``pointers``: id (unique), up, hops, open and any other columns; ``open`` is false where ``up`` is a top already. Pointer
    doubling: the number of joins grows with the logarithm of the longest chain, only rows still open are joined, and every
    join has one side with unique ids, so an id that very many rows point to can be split. Chains that run into a loop or to
    an id that has no row are left out.
    """
    other = [c for c in pointers.columns if c not in ("id", "up", "hops", "open")]
    part = materialize(pointers, "open")
    done, moving = [part.where("not open")], part.where("open")
    n = moving.count()
    while n:
        ahead = _all([*done, moving]).select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("hops").alias("more"), F.col("open").alias("still"))
        part = materialize(moving.join(ahead, "up").select("id", F.col("next").alias("up"), (F.col("hops") + F.col("more")).alias("hops"), *other, F.col("still").alias("open")), "open")
        done.append(part.where("not open"))
        moving, before = part.where("open"), n
        n = moving.count()
        if n == before:  # chains have rows at every distance from their top: if none arrived, what is left runs in loops
            break
    return _all(done).drop("open")


def threads(messages: DataFrame) -> DataFrame:
    """``messages`` plus ``thread``, the id of the topmost message above each that exists, which is the key of the stream's state.

    ``messages``: (id, parent, who, readable, at), ids unique. Messages that hang on a loop have no top and are left out.
    """
    known = messages.select(F.col("id").alias("known"), F.col("parent").isNotNull().alias("goes_on"))
    p = messages.join(known, F.col("parent") == F.col("known"), "left")
    p = p.select(*messages.columns, F.coalesce("known", "id").alias("up"), F.lit(0).alias("hops"), F.coalesce("goes_on", F.lit(False)).alias("open"))
    return follow(p).withColumnRenamed("up", "thread").drop("hops")


def sound_conversations(messages: dict[str, tuple], with_path: bool = False) -> list[tuple]:
    """``(root, last, n, leaf, path)`` of every sound conversation among the messages of a thread: ``{id: (parent, who, readable, ...)}``.

    Whether a message may stand where it stands depends on itself and the message it answers only, so one walk down from the
    root judges all conversations of the thread, in time linear in its messages however they branch.
    """
    replies: dict[str, list[str]] = {}
    for id_, m in messages.items():
        if m[0] is not None:
            replies.setdefault(m[0], []).append(id_)
    found = []
    walk = [(id_, id_, 1) for id_, m in messages.items() if m[0] is None and m[1] in ("s", "u") and m[2]]
    while walk:
        id_, root, n = walk.pop()
        who, below = messages[id_][1], replies.get(id_, ())
        if who == "a":
            leaf = id_ if not below else min((r for r in below if messages[r][1] == "u" and r not in replies), default=None)  # a last message of the user's is cut off
            if leaf is not None:
                path, at = [], id_ if with_path else None
                while at is not None:
                    path.append(at)
                    at = messages[at][0]
                found.append((root, id_, n, leaf, path[::-1]))
        walk += [(r, root, n + 1) for r in below if messages[r][2] and who + messages[r][1] in REPLIES]
    return found


def answered(messages: dict[str, tuple]) -> bool:
    """Whether no message of the user's waits for a reply."""
    parents = {m[0] for m in messages.values()}
    return all(m[1] == "a" for id_, m in messages.items() if id_ not in parents)


def _assemble(quiet_ms: int, wait_ms: int, keep_ms: int | None, with_path: bool):
    import json

    def emit(held: dict[str, list], now: int) -> list[tuple]:
        rows = []
        for thread, here in list(held.items()):
            if here[1] is not None and here[1] <= now:
                sound = sound_conversations(here[3], with_path)
                rows += [(thread, here[0], *x) for x in sound]
                if here[2] and not sound:
                    rows.append((thread, here[0], None, None, None, None, []))  # takes back what was emitted before
                here[1], here[2] = None, here[2] or bool(sound)
            if here[1] is None and keep_ms is not None and here[0] + keep_ms <= now:
                del held[thread]
        return rows

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # thread: [time of its last row, when it is due or null once emitted, whether it was ever emitted, {id: [parent, who, readable, version]}]
        held: dict[str, list] = json.loads(state.get[0]) if state.exists else {}
        now, touched = state.getCurrentWatermarkMs(), set()
        rows = emit(held, now)
        for pdf in batches:
            for thread, id_, parent, who, readable, version, ms in zip(*(pdf[c].tolist() for c in ("thread", "id", "parent", "who", "readable", "version", "event_ms")), strict=True):
                if thread is None:
                    continue  # the mark that ends a replay
                here = held.setdefault(thread, [ms, None, False, {}])
                here[0] = max(here[0], ms)
                old = here[3].get(id_)
                if old is None or old[3] < version:
                    here[3][id_] = [parent, who, readable, version]
                touched.add(thread)
        for thread in touched:
            here = held[thread]
            here[1] = here[0] + (quiet_ms if answered(here[3]) else wait_ms)
        if touched:
            rows += emit(held, now)
        if held:
            state.update((json.dumps(held),))
            timers = [h[1] if h[1] is not None else h[0] + keep_ms for h in held.values() if h[1] is not None or keep_ms is not None]
            if timers:
                state.setTimeoutTimestamp(max(min(timers), now + 1))
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=["thread", "revision", "root_id", "last_id", "n_messages", "leaf", "path"]).astype({"n_messages": "Int32"})

    return step


def assemble(stream: DataFrame, delay: str = "1 day", quiet_ms: int = 3 * DAY, wait_ms: int = 30 * DAY, keep_ms: int | None = 60 * DAY, with_path: bool = False) -> DataFrame:
    """The stateful operator on a stream of message rows (``EVENT_SCHEMA``): buffers them by thread, orders them into conversations,
    validates these and emits the sound ones: ``(thread, revision, root_id, last_id, n_messages, leaf, path)``.

    Rows may come in any order; of the versions of a message the one with the highest ``version`` counts. A thread is emitted
    on closure, when every message of the user's has a reply and the watermark is ``quiet_ms`` past its last row, or on
    timeout, ``wait_ms`` past it; what is broken or incomplete by then is dropped. A row that comes later still, within
    ``keep_ms`` (None: always), opens the thread again and a new ``revision`` of all its conversations is emitted, which takes
    the place of the one before (root_id null: none is left). Rows behind the watermark, ``delay`` behind the newest, are
    dropped by Spark and counted in its progress. State has ids and flags, never contents; a key is a bucket of small threads,
    which spares the cost of a Python call and a state row for each.
    """
    keyed = stream.withColumn("event_ms", F.unix_millis("event_time")).withWatermark("event_time", delay).groupBy("bucket")
    return keyed.applyInPandasWithState(_assemble(quiet_ms, wait_ms, keep_ms, with_path), OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def _stream(spark: SparkSession, source: str, files_per_trigger: int | None, **how) -> tuple[DataFrame, bool]:
    """(what the stream emitted, whether rows fell behind the watermark) of all files of ``source``, oldest files first."""
    out, progress = shared_path(spark), shared_path(spark)
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    query = assemble(reader.parquet(source), **how).writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    seen = query.recentProgress
    late = sum(s.get("numRowsDroppedByWatermark", 0) for p in seen for s in p["stateOperators"])
    unseen = bool(seen) and seen[0]["batchId"] > 0  # only the last batches are kept
    delete_path(spark, progress)
    return spark.read.schema(OUT_SCHEMA).parquet(out), bool(late) or unseen


def replay(spark: SparkSession, source: str, files_per_trigger: int | None = None, delay: str = "1 day", quiet_ms: int = 3 * DAY, wait_ms: int = 30 * DAY, with_path: bool = False) -> DataFrame:
    """Run ``assemble`` over a folder of events to its end: the conversations of each thread's last revision.

    A closing mark is added to the folder: one row of no thread whose time lets every timer fire. Without
    ``files_per_trigger`` the folder is one micro-batch, so no row is late; the timers fire in the batch that follows. With it
    files are taken by age, and where that is not the order of time, rows may fall behind the watermark: Spark counts them,
    and the replay is done again with a delay that covers the folder's whole span, so nothing is lost.
    """
    events = spark.read.schema(EVENT_SCHEMA).parquet(source)
    span = events.agg(F.unix_seconds(F.max("event_time")).alias("last"), F.unix_seconds(F.min("event_time")).alias("first")).first()
    if span["last"] is None:
        return spark.createDataFrame([], OUT_SCHEMA)
    whole = f"{span['last'] - span['first'] + 1} seconds"
    how = {"quiet_ms": quiet_ms, "wait_ms": wait_ms, "keep_ms": None, "with_path": with_path}
    after = (quiet_ms + wait_ms) // 1000 + 2 * (span["last"] - span["first"]) + 400 * 86_400
    mark = spark.range(1).select(F.lit(-1).cast("bigint").alias("bucket"), *[F.lit(None).cast(t).alias(c) for c, t in (("thread", "string"), ("id", "string"), ("parent", "string"), ("who", "string"), ("readable", "boolean"), ("version", "bigint"))], F.timestamp_seconds(F.lit(span["last"] + after)).alias("event_time"))
    mark.write.mode("append").parquet(source)
    emitted, late = _stream(spark, source, files_per_trigger, delay=delay, **how)
    if late:
        emitted, _ = _stream(spark, source, files_per_trigger, delay=whole, **how)
    if files_per_trigger:  # threads may have been emitted more than once
        newest = emitted.groupBy("thread").agg(F.max("revision").alias("revision"))
        emitted = emitted.join(newest, ["thread", "revision"])
    return emitted.where("root_id is not null")


def chained_conversations(messages: DataFrame, with_path: bool = False) -> DataFrame:
    """The conversations of threads too large for one key of state: the same judgement of each message by the one it answers, chained by pointer doubling.

    ``messages``: (id, parent, who, readable, ...), ids unique. Gives ``(root_id, last_id, n_messages, leaf, path)``; ``path`` is
    filled on request only, else empty. No thread and no list of replies is gathered: replies are counted by a partially combined aggregate.
    """
    m = messages.select("id", "parent", "who", "readable")
    above = m.select(F.col("id").alias("parent"), F.col("who").alias("asks"))
    fits = F.col("readable") & F.when(F.col("parent").isNull(), F.col("who").isin("s", "u")).otherwise(F.concat("asks", "who").isin(*REPLIES))
    good = m.join(above, "parent", "left").where(F.coalesce(fits, F.lit(False)))
    chain = follow(good.select("id", F.coalesce("parent", "id").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("hops"), "who", F.col("parent").isNotNull().alias("open")))
    asked = m.select(F.col("parent").alias("id")).where("id is not null").distinct().withColumn("has_reply", F.lit(True))
    below = m.where("parent is not null").join(asked, "id", "left").groupBy("parent").agg(F.min(F.when(F.col("has_reply").isNull() & (F.col("who") == "u"), F.col("id"))).alias("cut"))
    ends = chain.where("who = 'a'").join(below.withColumnRenamed("parent", "id").withColumn("replied", F.lit(True)), "id", "left").where("replied is null or cut is not null")
    out = ends.select(F.col("up").alias("root_id"), F.col("id").alias("last_id"), (F.col("hops") + 1).alias("n_messages"), F.coalesce("cut", "id").alias("leaf"))
    if not with_path:
        return out.withColumn("path", F.array().cast("array<string>"))
    out = materialize(out)
    tips = out.select(F.concat(F.lit("end of "), "last_id").alias("id"), F.col("last_id").alias("parent"))
    members = thread_members(chain.join(m.select("id", "parent"), "id").select("id", "parent").unionByName(tips)).where("back > 0")
    paths = members.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("k"), "id"))).alias("l"))
    paths = paths.select(F.substring("leaf", 8, 2**31 - 1).alias("last_id"), F.transform("l", lambda x: x["id"]).alias("path"))
    return out.join(paths, "last_id").select("root_id", "last_id", "n_messages", "leaf", "path")


def conversations_of(latest: DataFrame, with_path: bool = False, per_bucket: int = 2_000, split_above: int = 10_000) -> DataFrame:
    """``(root_id, last_id, n_messages, leaf, path)`` of the sound conversations of ``latest`` (as ``latest_messages`` gives it; written data).

    Threads go through the stream (``replay``), in as many buckets as give each about ``per_bucket`` messages. A thread of more
    than ``split_above`` messages does not fit one key of state and goes through ``chained_conversations``, with equal results.
    """
    spark = latest.sparkSession
    who = F.coalesce(F.substring("speaker", 1, 1), F.lit("?"))
    rows = materialize(threads(latest.select("id", "parent", who.alias("who"), "readable", "at")))
    n = rows.count()
    sizes = rows.groupBy("thread").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split_above).select("thread")
    columns = ["root_id", "last_id", "n_messages", "leaf", "path"]
    huge = None if n <= split_above or sizes.isEmpty() else materialize(sizes)
    small = rows if huge is None else rows.join(huge, "thread", "left_anti")
    bucket = F.pmod(F.xxhash64("thread"), F.lit(max(1, -(-n // per_bucket))))
    source = shared_path(spark)
    events = small.select(bucket.alias("bucket"), "thread", "id", "parent", "who", "readable", F.col("at").alias("version"), F.timestamp_micros(F.greatest("at", F.lit(0))).alias("event_time"))
    events.write.parquet(source)
    out = replay(spark, source, with_path=with_path).select(*columns)
    if huge is not None:
        out = out.unionByName(chained_conversations(materialize(rows.join(huge, "thread", "left_semi")), with_path).select(*columns))
    return out


def conversations(messages: DataFrame, **how) -> DataFrame:
    """``(root_id, last_id, n_messages, leaf, path)`` of every sound conversation of a message table, each once; ``leaf`` is the message without replies.

    Null or unknown speakers, null or unreadable contents, missing parents and loops make a conversation unsound. Empty table:
    no rows. Only the columns message_id, parent_id, role, content, created_at and ingested_at are read. Repeated rows and
    older versions of a message are combined before anything is shuffled. ``how``: see ``conversations_of``.
    """
    return conversations_of(materialize(latest_messages(messages).drop("content")), **how)


def transcripts(messages: DataFrame, **how) -> DataFrame:
    """``(root_id, last_id, turn, message_id, role, content)``: the sound conversations in long form, turns from 0, once per (root, last)."""
    last = materialize(latest_messages(messages))
    sound = conversations_of(last.drop("content"), with_path=True, **how)
    placed = sound.select("root_id", "last_id", F.posexplode("path").alias("turn", "id"))
    return placed.join(last.select("id", "speaker", "content"), "id").select("root_id", "last_id", "turn", F.col("id").alias("message_id"), F.col("speaker").alias("role"), "content")
