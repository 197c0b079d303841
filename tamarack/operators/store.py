"""Conversation store: upserts, appends, deletes and lookups as DataFrame transforms. Writing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of table with the changes' columns set where they aren't null, and the changes' new rows. changes: one row per key."""
    cols = [c for c in changes.columns if c != key]
    both = table.alias("t").join(changes.alias("c"), key, "full_outer")
    return both.select(key, *[F.coalesce(F.col(f"c.{c}"), F.col(f"t.{c}")).alias(c) if c in cols else F.col(f"t.{c}") for c in table.columns if c != key])


def set_columns(table: DataFrame, keys: DataFrame, key: str, **values: Column) -> DataFrame:
    """table with the columns set for the rows whose key is listed."""
    out = table.join(keys.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    for c, v in values.items():
        out = out.withColumn(c, F.when(F.col("__hit"), v).otherwise(F.col(c)))
    return out.drop("__hit")


def last_messages(messages: DataFrame, users: DataFrame, n: int = 6, key: str = "tg_id", at: str = "created_at", tie: str = "id") -> DataFrame:
    """The last n messages of each known user, oldest first (position 1..n). The rank is cut before it is sorted as a whole."""
    by = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(tie).desc())
    last = messages.where(F.col(at).isNotNull()).join(users.select(key).distinct(), key, "left_semi")
    last = last.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= n)
    return last.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(F.col("__n").desc()))).drop("__n")


def history_text(last: DataFrame, key: str = "tg_id", empty: str = "") -> DataFrame:
    """(key, history): 'role: content' of the last messages, oldest first."""
    line = F.concat(F.coalesce(F.lower(F.trim("role")), F.lit("")), F.lit(": "), F.coalesce(F.col("content"), F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct("position", line.alias("t"))))
    return last.groupBy(key).agg(F.coalesce(F.array_join(F.transform(lines, lambda x: x["t"]), "\n\n"), F.lit(empty)).alias("history"))


def message_pairs(pairs: DataFrame, key: str = "tg_id") -> DataFrame:
    """A user row and an answer row for each (key, question, answer, created_at); equal times keep the question first."""
    turn = lambda role, text, order: F.struct(F.lit(role).alias("role"), F.col(text).alias("content"), F.lit(order).alias("turn"))
    return pairs.select(key, "created_at", F.inline(F.array(turn("user", "question", 0), turn("assistant", "answer", 1))))


def active_after(users: DataFrame, pairs: DataFrame, key: str = "tg_id") -> DataFrame:
    """Users after pairs (key, created_at) are added: new ones are created, last_active is the time of the last pair, and who wrote is
    no longer reminded."""
    last = pairs.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("created_at").alias("__at"), F.lit(True).alias("__wrote"))
    out = users.join(last, key, "full_outer")
    set_ = {"last_active": F.coalesce("__at", "last_active"), "reengagement_sent_at": F.when(F.col("__wrote").isNull(), F.col("reengagement_sent_at"))}
    return out.select(key, *[set_.get(c, F.col(c)).alias(c) for c in users.columns if c != key])


def appended(table: DataFrame, rows: DataFrame, cut: Sequence[str] = (), most: int = 1000) -> DataFrame:
    """table and rows; the columns named in cut are shortened to most characters in what is added."""
    return table.unionByName(rows.select(*[F.substring(c, 1, most).alias(c) if c in cut else F.col(c) for c in rows.columns]), allowMissingColumns=True)


def without(table: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key isn't listed."""
    return table.join(keys, on, "left_anti")


def cascade_delete(tables: dict[str, DataFrame], keys: DataFrame, key: str = "tg_id") -> dict[str, DataFrame]:
    return {name: without(t, keys.select(key).distinct(), key) for name, t in tables.items()}


def entity_upsert(entities: DataFrame, found: DataFrame, key: str = "tg_id", seq: str = "created_at") -> DataFrame:
    """(key, type, value) with the highest confidence and the source seen first."""
    every = entities.unionByName(found, allowMissingColumns=True)
    return every.groupBy(key, "entity_type", "entity_value").agg(F.max("confidence").alias("confidence"), F.min_by("source", seq).alias("source"), F.min(seq).alias(seq))


def listed_entities(entities: DataFrame, key: str = "tg_id", kind: str | None = None) -> DataFrame:
    """Entities by confidence, then by change, rows without one first; with their rank per user."""
    by = Window.partitionBy(key).orderBy(F.col("confidence").desc_nulls_first(), F.col("updated_at").desc_nulls_first(), "entity_type", "entity_value")
    return (entities if kind is None else entities.where(F.col("entity_type") == kind)).withColumn("rank", F.row_number().over(by))


def idle_users(users: DataFrame, now: Column, hours: int = 48, limit: int = 50) -> DataFrame:
    """Users with a journey, silent for so long and not yet written to; the longest silent first, ties by id."""
    idle = (F.col("last_active") < now - F.make_dt_interval(hours=F.lit(hours))) & F.col("reengagement_sent_at").isNull() & F.col("journey_state").isNotNull()
    return users.where(idle).orderBy(F.col("last_active").asc_nulls_last(), "tg_id").limit(limit)


def retained(messages: DataFrame, now: Column, days: int = 90, at: str = "created_at") -> DataFrame:
    return messages.where(F.col(at) >= now - F.make_dt_interval(F.lit(days)))


def allowed(rows: DataFrame, banned: DataFrame, user: str = "tg_id", chat: str | None = None) -> DataFrame:
    """Rows of users (and, where given, chats) that aren't banned."""
    out = rows.join(banned.where("is_user").select(F.col("tg_id").alias(user)), user, "left_anti")
    return out if chat is None else out.join(banned.where("not is_user").select(F.col("tg_id").alias(chat)), chat, "left_anti")


def permitted(rows: DataFrame, admins: DataFrame, flag: str, user: str = "tg_id") -> DataFrame:
    return rows.join(admins.where(F.col(flag)).select(F.col("tg_id").alias(user)), user, "left_semi")


def latest_rows(table: DataFrame, key: str = "id", loaded: str = "loaded_at", columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key, the one loaded last (any of several, without that column), of the columns named.

    Columns are chosen before anything moves, and of each key one row per map task is left before the exchange (WindowGroupLimit), so
    a key that a third of all rows share is no large group.
    """
    kept = [c for c in (columns if columns is not None else table.columns) if c != key]
    order = [F.col(loaded).desc_nulls_last()] if loaded in table.columns else []
    narrow = table.select(key, *kept, *([F.col(loaded).alias("__l")] if order else []))
    by = Window.partitionBy(key).orderBy(*([F.col("__l").desc_nulls_last()] if order else [F.col(key)]))
    return narrow.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= 1).select(key, *kept)


def merged_stages(state: Column, discussed: Column) -> Column:
    """Stage map with the found stages set to discussed; nothing is taken back."""
    found = F.map_from_arrays(discussed, F.transform(discussed, lambda s: F.lit("discussed")))
    old = F.coalesce(state, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(discussed, k)), found)


def discussed_count(state: Column) -> Column:
    return F.coalesce(F.size(F.map_filter(state, lambda k, v: (v == "discussed") & ~k.startswith("_"))), F.lit(0))


def progress_percent(state: Column, stages: int = 9) -> Column:
    return F.floor(F.lit(100) * discussed_count(state) / F.lit(stages)).cast("int")


def user_stage(state: Column) -> Column:
    n = discussed_count(state)
    return F.when(n <= 2, "novice").when(n <= 6, "in_progress").otherwise("advanced")


def skipped_prerequisites(states: DataFrame, prerequisites: DataFrame, key: str = "tg_id", state: str = "journey_state") -> DataFrame:
    """(key, stage, prerequisite): discussed stages whose prerequisite isn't. prerequisites: (stage, prerequisite), a fixed small graph."""
    done = states.select(key, F.explode(F.map_filter(state, lambda k, v: v == "discussed")).alias("stage", "__v")).drop("__v").distinct()
    need = done.join(prerequisites, "stage")
    return need.join(done.select(key, F.col("stage").alias("prerequisite")), [key, "prerequisite"], "left_anti").select(key, "stage", "prerequisite")
