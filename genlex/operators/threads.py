"""Message trees, dialogues and their wide form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genlex.functions import values as V
from genlex.session import materialize


def thread_paths(messages: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Every root-to-leaf path as ``(root_id, leaf_id, path)`` for roots with a null parent; a root without child gives none.

    ``messages``: (message_id, parent_id), ids unique. The members of each path come from pointer doubling, so threads may be of any
    length and a loop is left out. Raises where a ``max_depth`` is given and a path takes more steps.
    """
    members = thread_members(messages.select(F.col("message_id").alias("id"), F.col("parent_id").alias("parent")))
    roots = messages.where("parent_id is null").select(F.col("message_id").alias("root_id"))
    paths = members.groupBy("leaf").agg(F.max_by("id", "back").alias("root_id"), F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("k"), "id"))).alias("l"))
    out = paths.where(F.size("l") > 1).join(roots, "root_id").select("root_id", F.col("leaf").alias("leaf_id"), F.transform("l", lambda x: x["id"]).alias("path"))
    if max_depth is not None and not out.where(F.size("path") > max_depth + 1).isEmpty():
        raise ValueError(f"a path takes more than {max_depth} steps")
    return out


def thread_members(links: DataFrame) -> DataFrame:
    """``(leaf, id, back)``: each message of the thread that ends in ``leaf``, ``back`` steps before it.

    ``links``: (id, parent), ids unique. Threads whose top has no parent row are given up to the last row that exists; those
    that run into a loop are left out. Round k joins with the 2^k-th ancestors, so twenty rounds cover threads of a million
    messages. Every join has one side with unique keys, which lets a message with very many descendants be split.
    """
    known = links.select(F.col("id").alias("up"))
    jumps = [materialize(links.where("parent is not null").join(known, F.col("parent") == F.col("up"), "left_semi").select("id", F.col("parent").alias("up")))]
    count = jumps[0].count()
    while count:
        j = jumps[-1]
        nxt = materialize(j.alias("a").join(j.alias("b"), F.col("a.up") == F.col("b.id")).select(F.col("a.id").alias("id"), F.col("b.up").alias("up")))
        n = nxt.count()
        if n == count:  # no thread ends between 2^k and 2^(k+1) steps up: what is left runs in loops
            break
        jumps.append(nxt)
        count = n
    else:
        nxt = None
    leaves = links.select(F.col("id").alias("leaf")).join(links.select(F.col("parent").alias("leaf")), "leaf", "left_anti")
    if nxt is not None:
        leaves = leaves.join(nxt.select(F.col("id").alias("leaf")), "leaf", "left_anti")
    members = leaves.select("leaf", F.col("leaf").alias("id"), F.lit(0).cast("bigint").alias("back"))
    for k, j in enumerate(jumps[:-1] if nxt is None else jumps):
        farther = members.join(j, "id").select("leaf", F.col("up").alias("id"), (F.col("back") + 2**k).alias("back"))
        members = materialize(members.unionByName(farther))
    return members


def latest_turns(messages: DataFrame) -> DataFrame:
    """``(id, parent, role, text)``: of the rows of one message the latest by ``ingested_at`` (null is the earliest), ties by the other values.

    Ids compare without blanks around them, a blank parent is none, rows without id are left out. Roles are normal, missing text is ``""``.
    """
    own = messages.select(F.nullif(F.trim("message_id"), F.lit("")).alias("id"), F.struct("ingested_at", "created_at", F.coalesce(F.nullif(F.trim("parent_id"), F.lit("")), F.lit("")).alias("parent"), F.coalesce(speaker(F.col("role")), F.lit("")).alias("role"), F.coalesce("content", F.lit("")).alias("text")).alias("v"))
    last = own.where("id is not null").groupBy("id").agg(F.max("v").alias("v"))
    return last.select("id", F.nullif("v.parent", F.lit("")).alias("parent"), "v.role", "v.text")


def paths_in_turns(messages: DataFrame) -> DataFrame:
    """D1 in long form: ``(conv_id, root_id, turn, role, text)``, one row per message of every path from a root (null parent) to a message without
    replies, which is its conv_id; turns from 1. ``messages``: (id, parent, role, text), ids unique. A root without replies is no path.

    The place of a message comes from pointer doubling: no window, so a thread of any size is no hot task.
    """
    members = thread_members(messages.select("id", "parent"))
    ends = members.groupBy("leaf").agg(F.max_by("id", "back").alias("root_id"), F.max("back").alias("top")).where("top > 0")
    ends = ends.join(messages.where("parent is null").select(F.col("id").alias("root_id")), "root_id")
    out = members.join(ends, "leaf").join(messages.select("id", "role", "text"), "id")
    return out.select(F.col("leaf").alias("conv_id"), "root_id", (F.col("top") - F.col("back") + 1).alias("turn"), "role", "text")


def dialogue_turns(turns: DataFrame) -> DataFrame:
    """A18, D1-D4 in long form: ``(conv_id, root_id, role, n, text)``, one row per message of a speaker in every conversation, however many.

    ``turns``: (id, parent, role, text), ids unique. A conversation is a path from a root (null parent) to a message without replies,
    without its last message if that is the user's; conv_id is its last kept message, so paths that differ only in the message
    cut off are one. A root without replies is none. System and unknown speakers count for neither.
    """
    members = thread_members(turns.select("id", "parent"))
    ends = members.groupBy("leaf").agg(F.max_by("id", "back").alias("root_id"), F.max("back").alias("top"), F.max(F.when(F.col("back") == 1, F.col("id"))).alias("before"))
    roots = turns.where("parent is null").select(F.col("id").alias("root_id"))
    ends = ends.where("top > 0").join(roots, "root_id").join(turns.select(F.col("id").alias("leaf"), (F.col("role") == "user").alias("cut")), "leaf")
    ends = ends.withColumn("cut", F.coalesce("cut", F.lit(False))).withColumn("conv_id", F.when(F.col("cut"), F.col("before")).otherwise(F.col("leaf")))
    kept = ends.groupBy("conv_id").agg(F.min(F.struct("leaf", "root_id", "top", "cut")).alias("e")).select("conv_id", "e.*")
    out = members.join(kept, "leaf").where("not (cut and back = 0)").join(turns, "id").select("conv_id", "root_id", (F.col("top") - F.col("back")).alias("turn"), "role", "text")
    return role_ordinals(out).select("conv_id", "root_id", "role", "n", "text")


def cut_last_user(turns: DataFrame) -> DataFrame:
    """Without the last message of a conversation if it is the user's. ``turns``: (conv_id, turn, role, text)."""
    last = turns.groupBy("conv_id").agg(F.max(F.struct("turn", "role")).alias("m")).select("conv_id", F.col("m.turn").alias("last_turn"), F.col("m.role").alias("last_role"))
    return turns.join(last, "conv_id").where(~((F.col("turn") == F.col("last_turn")) & (F.col("last_role") == "user"))).select(*turns.columns)


def normal_role(turns: DataFrame) -> DataFrame:
    """D3: ``prompter`` is the user."""
    return turns.withColumn("role", F.when(F.col("role") == "prompter", "user").otherwise(F.col("role")))


def speaker(role: Column) -> Column:
    """D3 for tables that spell speakers in several ways: ``user`` or ``assistant`` for a spelling of it, without case and blanks; others as they are."""
    bare = F.lower(F.trim(role))
    return F.when(bare.isin(*V.USER_NAMES), "user").when(bare.isin(*V.ASSISTANT_NAMES), "assistant").otherwise(bare)


def role_ordinals(turns: DataFrame) -> DataFrame:
    """The number of a message among its speaker's in a conversation; system messages count for neither."""
    own = Window.partitionBy("conv_id", "role").orderBy("turn")
    return turns.where(F.col("role").isin("user", "assistant")).withColumn("n", F.row_number().over(own))


def wide_dialogues(turns: DataFrame) -> DataFrame:
    """One row per conversation, columns user_content1.. and assistant_content1.. as far as the longest dialogue goes, ``""`` where there is none.

    A conditional aggregate; only each speaker's largest number of turns comes to the driver. Every turn of every dialogue is
    kept, so few very long dialogues make a very wide table: ``dialogue_turns`` is the long form.
    """
    numbered = materialize(role_ordinals(turns))
    most = {r["role"]: r["n"] for r in numbered.groupBy("role").agg(F.max("n").alias("n")).collect()}  # two rows
    cells = [F.coalesce(F.max(F.when((F.col("role") == r) & (F.col("n") == k), F.col("text"))), F.lit("")).alias(f"{r}_content{k}") for k in range(1, max(most.values(), default=0) + 1) for r in ("user", "assistant") if k <= most.get(r, 0)]
    if not cells:
        return numbered.select("conv_id").distinct()
    return numbered.groupBy("conv_id").agg(*cells)


def first_of_role(turns: DataFrame, role: str) -> DataFrame:
    """The first message of a speaker in each conversation, ``""`` if there is none."""
    own = F.when(F.col("role") == role, F.struct("turn", "text"))
    return turns.groupBy("conv_id").agg(F.coalesce(F.min(own)["text"], F.lit("")).alias("text"))


def split_classes(rows: DataFrame, column: str) -> DataFrame:
    """One row per entry of a ``, ``-separated list, empty entries dropped."""
    return rows.withColumn(column, F.explode(F.split(column, ", "))).where(F.col(column) != "")
