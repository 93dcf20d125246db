"""Reader state from events, and the lifecycle of hypotheses as an ordered fold."""

from __future__ import annotations

from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwire.functions import patterns as P
from sparkwire.functions.text import nz, text, trim

from .windows import top_per_key


def reactions(events: DataFrame, key: str = "article_hash", user: str = "user", order: str = "seq") -> DataFrame:
    """(key, user, action): the last action of each, cleared ones gone."""
    last = events.groupBy(key, user).agg(F.max_by("value", order).alias("action"))
    return last.where(F.col("action").isin("like", "dislike"))


def reaction_totals(last: DataFrame, key: str = "article_hash") -> DataFrame:
    return last.groupBy(key).agg(F.count_if(F.col("action") == "like").alias("likes"), F.count_if(F.col("action") == "dislike").alias("dislikes"))


def notes(events: DataFrame, order: str = "seq") -> DataFrame:
    last = events.groupBy("article_hash", "user").agg(F.max_by(trim(text(F.col("value"))), order).alias("note"))
    return last.where("note <> ''")


def bookmarks(events: DataFrame, key: str = "article_hash", user: str = "user") -> DataFrame:
    """(key, user) of odd numbers of toggles."""
    return events.groupBy(key, user).agg(F.count("*").alias("n")).where("n % 2 = 1").drop("n")


def chats(events: DataFrame, order: str = "seq", most: int = 30, cut: int = 6000) -> DataFrame:
    """The last messages after the last clearing of each (article_hash, user); blank ones do not count."""
    keys = ["article_hash", "user"]
    cleared = events.where("kind = 'clear_chat'").groupBy(*keys).agg(F.max(order).alias("__cut"))
    said = events.where("kind = 'chat'").withColumn("value", F.left(trim(text(F.col("value"))), F.lit(cut))).where("value <> ''")
    live = said.join(cleared, keys, "left").where(F.col("__cut").isNull() | (F.col(order) > F.col("__cut"))).drop("__cut")
    return top_per_key(live, keys, most, F.desc(order))


#: Preferences that users can set.
PREFERENCES = ("theme", "lang", "sort", "filter", "density", "notify")


def preferences(events: DataFrame, order: str = "seq", allowed=PREFERENCES) -> DataFrame:
    """(user, prefs map): the last value of each allowed key; events' value is key=value."""
    kv = events.select("user", order, F.substring_index("value", "=", 1).alias("k"), F.regexp_extract("value", "(?s)=(.*)", 1).alias("v")).where(F.col("k").isin(*allowed))
    last = kv.groupBy("user", "k").agg(F.max_by("v", order).alias("v"))
    return last.groupBy("user").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("prefs"))


def feed(events: DataFrame, user: str, order: str = "seq") -> DataFrame:
    """What one reader sees at each article: totals, own marks, three others who like it."""
    kinds = {k: events.where(F.col("kind") == k) for k in ("react", "note", "bookmark")}
    last = reactions(kinds["react"], order=order)
    mine = F.col("user") == user
    # every key that was ever touched is listed, with or without a mark that stands
    touched = kinds["react"].select("article_hash").union(kinds["note"].select("article_hash")).union(kinds["bookmark"].select("article_hash")).distinct()
    r = last.groupBy("article_hash").agg(
        F.count_if(F.col("action") == "like").alias("likes"), F.count_if(F.col("action") == "dislike").alias("dislikes"), F.max(F.when(mine, F.col("action"))).alias("my")
    )
    top = top_per_key(last.where((F.col("action") == "like") & ~mine), ["article_hash"], 3, F.col("user")).groupBy("article_hash").agg(F.sort_array(F.collect_list("user")).alias("top_reactors"))
    n = notes(kinds["note"], order).where(mine).select("article_hash", F.lit(True).alias("has_note"))
    b = bookmarks(kinds["bookmark"]).groupBy("article_hash").agg(F.count("*").alias("bookmark_total"), F.max(mine).alias("bookmarked"))
    out = touched.join(r, "article_hash", "left").join(top, "article_hash", "left").join(n, "article_hash", "left").join(b, "article_hash", "left")
    zero, no = F.lit(0).cast("long"), F.lit(False)
    return out.select(
        "article_hash", F.coalesce("likes", zero).alias("likes"), F.coalesce("dislikes", zero).alias("dislikes"), "my", F.coalesce("bookmarked", no).alias("bookmarked"),
        F.coalesce("bookmark_total", zero).alias("bookmark_total"), F.coalesce("has_note", no).alias("has_note"), F.coalesce("top_reactors", F.array().cast("array<string>")).alias("top_reactors"),
    )


def detail(events: DataFrame, article: str, user: str, order: str = "seq", most: int = 10) -> DataFrame:
    """One row: what one reader sees at one article, with the first others who like or dislike it."""
    own = events.where(F.col("article_hash") == article)
    last = reactions(own.where("kind = 'react'"), order=order)
    mine = F.col("user") == user
    others = lambda a: F.slice(F.sort_array(F.collect_list(F.when((F.col("action") == a) & ~mine & (F.col("__rank") <= most), F.col("user")))), 1, most)
    rank = F.row_number().over(Window.partitionBy("action").orderBy(mine.cast("int"), "user"))
    r = last.withColumn("__rank", rank).agg(
        F.count_if(F.col("action") == "like").alias("likes"), F.count_if(F.col("action") == "dislike").alias("dislikes"), F.max(F.when(mine, F.col("action"))).alias("my_reaction"),
        others("like").alias("likers_other"), others("dislike").alias("dislikers_other"),
    )
    b = bookmarks(own.where("kind = 'bookmark'")).agg(F.coalesce(F.max(mine), F.lit(False)).alias("bookmarked"), F.count("*").alias("bookmark_total"))
    n = notes(own.where("kind = 'note'"), order).where(mine).agg(F.coalesce(F.max("note"), F.lit("")).alias("my_note"))
    tails = chats(own, order)
    c = tails.agg(F.count_if(mine).alias("my_chat_msgs"), F.count_distinct("user").alias("team_chat_active"))
    return r.join(b).join(n).join(c)  # four single rows


def checked(events: DataFrame, state: DataFrame) -> DataFrame:
    """result of one transition event for each hypothesis (to, caller, confirm) against its state."""
    edges = events.sparkSession.createDataFrame([(a, b) for a, bs in P.TRANSITIONS.items() for b in bs], "lifecycle_status string, to string")
    met = events.join(state, "id", "left").join(edges.withColumn("ok", F.lit(True)), ["lifecycle_status", "to"], "left")
    owner = nz(F.col("owner_username"))
    result = (
        F.when(F.col("lifecycle_status").isNull(), "not_found")
        .when(F.col("lifecycle_status") == F.col("to"), "unchanged")
        .when(F.col("ok").isNull(), "transition_not_allowed")
        .when((F.col("to") == "archived") & ~F.coalesce("confirm", F.lit(False)), "confirm_required")
        .when(F.col("to").isin("validated", "adopted") & owner.isNull(), "assign_owner_first")
        .otherwise("ok")
    )
    after = F.when((result == "ok") & (F.col("to") == "in_review") & owner.isNull(), F.col("caller")).otherwise(F.col("owner_username"))
    return met.select("id", "to", "caller", result.alias("result"), F.when(result == "ok", F.col("to")).otherwise(F.col("lifecycle_status")).alias("lifecycle_status"), after.alias("owner_username"))


FOLDED = "id string, seq long, kind string, result string, lifecycle_status string, owner_username string, next_check_at string"


def fold(state: DataFrame, events: DataFrame) -> DataFrame:
    """Every event's result and the state after it, in order of seq within each hypothesis.

    Events: (id, seq, kind transition | owner | next_check, value, caller, is_admin, confirm). Histories
    stream through their tasks in order; of each only the state so far is held. The same as a stream with
    kept state is streaming.keyed.lifecycle.
    """
    both = events.select("id", "seq", "kind", "value", "caller", "is_admin", "confirm").join(state.select("id", "lifecycle_status", "owner_username", "next_check_at"), "id")
    return both.repartition("id").sortWithinPartitions("id", "seq").mapInArrow(_fold, FOLDED)


def _fold(it):
    ident, now = None, None
    for batch in it:
        out = []
        for r in batch.to_pylist():
            if r["id"] != ident:
                ident, now = r["id"], (r["lifecycle_status"], r["owner_username"], r["next_check_at"])
            result, now = step(now, r["kind"], r["value"], r["caller"], r["is_admin"], r["confirm"])
            out.append((r["id"], r["seq"], r["kind"], result, *now))
        names = [f.split()[0] for f in FOLDED.split(", ")]
        kinds = [pa.int64() if n == "seq" else pa.string() for n in names]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _is_date(value: str) -> bool:
    try:
        return len(value) == 10 and date.fromisoformat(value) is not None
    except ValueError:
        return False


def step(now: tuple, kind: str, value: str | None, caller: str | None, is_admin: bool | None, confirm: bool | None) -> tuple[str, tuple]:
    """One event's result, and (lifecycle_status, owner_username, next_check_at) after it."""
    status, owner, check = now
    if kind == "transition":
        if value == status:
            return "unchanged", now
        if value not in P.TRANSITIONS.get(status, ()):
            return "transition_not_allowed", now
        if value == "archived" and not confirm:
            return "confirm_required", now
        if value in ("validated", "adopted") and not owner:
            return "assign_owner_first", now
        return "ok", (value, caller if value == "in_review" and not owner else owner, check)
    if kind == "owner":
        who = (value or "").strip()
        if not is_admin and who != caller:
            return "forbidden", now
        if not is_admin and owner and owner != caller:
            return "already_owned", now
        return "ok", (status, who or None, check)
    if kind == "next_check":
        if value and not _is_date(value):
            return "bad_date", now
        if not is_admin and owner != caller:
            return "forbidden", now
        return "ok", (status, owner, value)
    return "ok", now


def latest_state(folded: DataFrame) -> DataFrame:
    return folded.withColumn("__r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))).where("__r = 1").select("id", "lifecycle_status", "owner_username", "next_check_at")
