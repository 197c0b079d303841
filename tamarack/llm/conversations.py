"""Rebuilding conversations from message rows.

Each conversation's rows form a reply graph: a bot row replies to the nearest user row before it, a row follows the nearest
earlier row of its own side, and where the data names the message replied to (reply_to) that edge is added, if both rows are in
the same conversation. Kahn's algorithm sorts the graph topologically, ties going to (created_at, rank of the role, id); nodes
left over lie on a cycle or behind one, and their conversation is broken. A named reply that stands longer than skew_seconds
before what it replies to, in one conversation, is no matter of clocks: that conversation is broken too.

No account is ever gathered in one task. A block is an account's rows within block_seconds (an hour), which is at least the
gap that parts conversations, so a block holds few conversations however many rows the account has. Edges that follow the order of
time are met by keeping the blocks in order; only an edge against it can reach over blocks and matter. The few of these are found
by one equi-join on (account, id), and the blocks between their ends become one (at most skew_seconds long). Blocks are cut into
segments at the gaps; a segment is reduced to a fixed-size summary (first and last turn, counts), and only the segments -
at most one per gap length and account, bounded by the calendar and not by the rows - are put in order per account to join
those that continue across blocks. Whether a conversation is dropped follows from its segments' summaries.

Order of equal times: user side, system or tool, no usable role, bot side, then id. Conversations part after a gap of more
than gap_seconds. Reasons to drop, first that holds: empty (no turn that isn't blank), broken (a turn that isn't blank has no
usable role, the first such turn is the bot's, or a reply cycle), missing_reply (the last such turn is the user's, or a bot
row is blank).

Defined results: rows with null account, time or id take no part; of rows with the same id the one loaded first counts, whatever
the times and accounts of the others, and its text; a reply to a row that isn't there, or to itself, has no edge; blank contents
are null, white space or zero-width characters only; roles are compared without case and blanks around them; an empty table gives
an empty result; extra columns are carried only by conversations().
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

USER, SYSTEM, NONE, BOT = 0, 1, 2, 3
ROLES = {"user": USER, "human": USER, "usr": USER, "assistant": BOT, "bot": BOT, "ai": BOT, "model": BOT, "system": SYSTEM, "tool": SYSTEM}

#: White space of Unicode, and characters of no width.
INVISIBLE = "\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u2064\\u3000\\ufeff\\u00ad\\u180e\\u034f\\u115f\\u1160\\u3164\\u2066-\\u206f\\ufe00-\\ufe0f"


def is_blank(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, f"[{INVISIBLE}]+", "") == "", F.lit(True))


def role_rank(role: Column) -> Column:
    name = F.lower(F.regexp_replace(F.coalesce(role, F.lit("")), f"^[{INVISIBLE}]+|[{INVISIBLE}]+$", ""))
    out = F.lit(NONE)
    for rank in (USER, SYSTEM, BOT):
        out = F.when(name.isin([k for k, v in ROLES.items() if v == rank]), F.lit(rank)).otherwise(out)
    return out


def kahn(keys: list[tuple], edges: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Nodes in topological order with ties to the smaller key, and the nodes left over: on a cycle or behind one."""
    after: list[list[int]] = [[] for _ in keys]
    need = [0] * len(keys)
    for a, b in edges:
        after[a].append(b)
        need[b] += 1
    ready = [(keys[i], i) for i in range(len(keys)) if not need[i]]
    heapq.heapify(ready)
    order = []
    while ready:
        i = heapq.heappop(ready)[1]
        order.append(i)
        for j in after[i]:
            need[j] -= 1
            if not need[j]:
                heapq.heappush(ready, (keys[j], j))
    done = set(order)
    return order, [i for i in range(len(keys)) if i not in done] if len(done) < len(keys) else []


def reply_edges(ranks: list[int], ids: list[str], reply_to: list[str | None] | None) -> list[tuple[int, int]]:
    """Edges of rows in order of time: what a row follows of its own side, what a bot row replies to, and what the data says."""
    edges, last = [], {}
    for i, r in enumerate(ranks):
        if r in last:
            edges.append((last[r], i))
        if r == BOT and USER in last:
            edges.append((last[USER], i))
        last[r] = i
    if reply_to is not None:
        at = {x: i for i, x in enumerate(ids)}
        edges += [(at[p], i) for i, p in enumerate(reply_to) if p in at and at[p] != i]
    return edges


_ORDERED = "account long, block long, id string, at long, rank int, blank boolean, pos long, seg int, cyclic boolean, until long"


def _ordered_blocks(batches: Iterator[pa.RecordBatch], gap: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (account, block) come in; each block leaves in Kahn's order, segment by segment."""

    def out(rows: list[tuple]) -> list[tuple]:
        rows.sort(key=lambda r: (r[3], r[4], r[2]))
        result, seg, start = [], 0, 0
        for end in range(1, len(rows) + 1):
            if end < len(rows) and rows[end][3] - rows[end - 1][3] <= gap:
                continue
            part = rows[start:end]
            edges = reply_edges([r[4] for r in part], [r[2] for r in part], [r[6] for r in part] if len(part[0]) > 6 else None)
            order, left = kahn(list(range(len(part))), edges)
            cyclic = set(left)
            for pos, i in enumerate(order + left, start):
                r = part[i]
                result.append((*r[:6], pos, seg, i in cyclic, r[7] if len(r) > 7 else None))
            seg, start = seg + 1, end
        return result

    names = ["account", "block", "id", "at", "rank", "blank", "pos", "seg", "cyclic", "until"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.bool_(), pa.int64()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*rows), types)], names=names)

    held: list[tuple] = []
    done: list[tuple] = []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if held and held[-1][:2] != r[:2]:
                done += out(held)
                held = []
                if len(done) >= 20_000:
                    yield batch(done)
                    done = []
            held.append(r)
    if held:
        done += out(held)
    if done:
        yield batch(done)


def first_loaded(messages: DataFrame, account: str, id_col: str, role: str, content: str, created: str, loaded: str | None, more: Column | None = None) -> DataFrame:
    """One narrow row per id: account, id, at, rank, blank and more, of the row loaded first."""
    rows = messages.select(
        F.col(account).cast("long").alias("account"),
        F.col(id_col).cast("string").alias("id"),
        F.unix_micros(F.col(created).cast("timestamp")).alias("at"),
        role_rank(F.col(role)).alias("rank"),
        is_blank(F.col(content)).alias("blank"),
        (F.unix_micros(F.col(loaded).cast("timestamp")) if loaded else F.lit(0)).alias("__loaded"),
        *([more] if more is not None else []),
    ).where("account is not null and at is not null and id is not null")
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.col("__loaded").asc_nulls_last(), "at", "account", "rank", "blank"))
    return rows.withColumn("__n", first).where("__n = 1").drop("__n", "__loaded")


def merged_blocks(rows: DataFrame, skew: int) -> DataFrame:
    """rows with block set to the first of those that a reply against time ties together, and until: the time of a target too far ahead."""
    target = rows.select("account", F.col("id").alias("reply_to"), F.col("at").alias("t_at"), F.col("block").alias("t_block"))
    against = rows.where("reply_to is not null and reply_to <> id").select("account", "id", "at", "block", "reply_to").join(target, ["account", "reply_to"]).where("t_block > block")
    near = F.col("t_at") - F.col("at") <= skew
    reach = against.where(near).groupBy("account", "block").agg(F.max("t_block").alias("reach"))
    by = Window.partitionBy("account").orderBy("block")
    before = F.max("reach").over(by.rowsBetween(Window.unboundedPreceding, -1))
    reach = reach.withColumn("new", F.when(F.col("block") <= before, 0).otherwise(1)).withColumn("tie", F.sum("new").over(by))
    ties = reach.groupBy("account", "tie").agg(F.min("block").alias("unit"), F.max("reach").alias("last"))
    ties = ties.select("account", "unit", F.explode(F.sequence("unit", "last")).alias("block"))
    far = against.where(~near).groupBy("id").agg(F.max("t_at").alias("until"))
    out = rows.join(ties, ["account", "block"], "left").join(far, "id", "left")
    return out.select("account", F.coalesce("unit", "block").alias("block"), "id", "at", "rank", "blank", "reply_to", "until")


def ordered_rows(
    messages: DataFrame,
    account: str = "tg_id",
    id_col: str = "id",
    role: str = "role",
    content: str = "content",
    created: str = "created_at",
    loaded: str | None = "loaded_at",
    reply_to: str | None = None,
    gap_seconds: int = 1800,
    block_seconds: int = 3600,
    skew_seconds: int = 86_400,
) -> DataFrame:
    """Every usable message in its place: block, segment and position within its account; no texts."""
    if block_seconds < gap_seconds:
        raise ValueError("block_seconds must be at least gap_seconds")
    rows = first_loaded(messages, account, id_col, role, content, created, loaded, F.col(reply_to).cast("string").alias("reply_to") if reply_to else None)
    rows = rows.select("account", F.floor(F.col("at") / F.lit(block_seconds * 1_000_000)).cast("long").alias("block"), "id", "at", "rank", "blank", *(["reply_to"] if reply_to else []))
    if reply_to:
        rows = merged_blocks(rows, skew_seconds * 1_000_000)
    rows = rows.repartition("account", "block").sortWithinPartitions("account", "block")
    gap = gap_seconds * 1_000_000
    return rows.mapInArrow(lambda it: _ordered_blocks(it, gap), _ORDERED)


def segments(ordered: DataFrame) -> DataFrame:
    """Fixed-size summary of each block's segments."""
    turn = ~F.col("blank") & (F.col("rank") != SYSTEM)
    return ordered.groupBy("account", "block", "seg").agg(
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
        F.min_by("id", "pos").alias("first_id"),
        F.count("*").alias("n_rows"),
        F.count_if(turn).alias("n_turns"),
        F.min_by("rank", F.when(turn, F.col("pos"))).alias("first_rank"),
        F.max_by("rank", F.when(turn, F.col("pos"))).alias("last_rank"),
        F.count_if(turn & (F.col("rank") == NONE)).alias("n_none"),
        F.count_if(F.col("blank") & (F.col("rank") == BOT)).alias("n_blank_bot"),
        F.count_if("cyclic").alias("n_cyclic"),
        F.max("until").alias("until"),
    )


def numbered_segments(ordered: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Segments with the number of their conversation within the account."""
    by_time = Window.partitionBy("account").orderBy("first_at", "block", "seg")
    new = F.when(F.col("first_at") - F.lag("last_at").over(by_time) <= gap_seconds * 1_000_000, 0).otherwise(1)
    return segments(ordered).withColumn("__new", new).withColumn("conversation", F.sum("__new").over(by_time)).drop("__new")


def verdicts(ordered: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """One row per conversation: (account, conversation, first_id, first_at, last_at, n_rows, n_turns, reason), reason null if it is kept."""
    order = F.struct("block", "seg")
    has = F.when(F.col("n_turns") > 0, order)
    c = numbered_segments(ordered, gap_seconds).groupBy("account", "conversation").agg(
        F.min_by("first_id", order).alias("first_id"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_turns").alias("n_turns"),
        F.min_by("first_rank", has).alias("first_rank"),
        F.max_by("last_rank", has).alias("last_rank"),
        F.sum("n_none").alias("n_none"),
        F.sum("n_blank_bot").alias("n_blank_bot"),
        F.sum("n_cyclic").alias("n_cyclic"),
        F.max("until").alias("until"),
    )
    reason = (
        F.when(F.col("n_turns") == 0, "empty")
        .when((F.col("n_none") > 0) | (F.col("first_rank") == BOT) | (F.col("n_cyclic") > 0) | F.coalesce(F.col("until") <= F.col("last_at"), F.lit(False)), "broken")
        .when((F.col("last_rank") == USER) | (F.col("n_blank_bot") > 0), "missing_reply")
    )
    return c.select("account", "conversation", "first_id", F.timestamp_micros("first_at").alias("first_at"), F.timestamp_micros("last_at").alias("last_at"), "n_rows", "n_turns", reason.alias("reason"))


def to_drop(messages: DataFrame, **options) -> DataFrame:
    """(account, first_id, reason) of conversations that are empty, broken or lack a reply."""
    gap = options.get("gap_seconds", 1800)
    return verdicts(ordered_rows(messages, **options), gap).where("reason is not null").select("account", "first_id", "reason")


def conversations(messages: DataFrame, account: str = "tg_id", id_col: str = "id", role: str = "role", content: str = "content", created: str = "created_at", loaded: str | None = "loaded_at", **options) -> DataFrame:
    """Turns of the kept conversations: (account, first_id, block, seg, pos, id, speaker, content); sort by block, seg, pos.

    Only turns come out (user and bot rows that aren't blank). Texts join their place by id in one shuffle.
    """
    from tamarack.session import cut

    gap = options.get("gap_seconds", 1800)
    named = dict(account=account, id_col=id_col, role=role, content=content, created=created, loaded=loaded)
    ordered = cut(ordered_rows(messages, **named, **options))
    kept = verdicts(ordered, gap).where("reason is null").select("account", "conversation", "first_id")
    places = numbered_segments(ordered, gap).select("account", "block", "seg", "conversation").join(kept, ["account", "conversation"])
    turns = ordered.where(~F.col("blank") & F.col("rank").isin(USER, BOT)).join(places, ["account", "block", "seg"])
    texts = first_loaded(messages, **named, more=F.col(content).alias("content")).select("id", "content")
    speaker = F.when(F.col("rank") == USER, "user").otherwise("assistant")
    return turns.join(texts, "id").select("account", "first_id", "block", "seg", "pos", "id", speaker.alias("speaker"), "content")
