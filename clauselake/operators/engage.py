"""Engagement tables: counters, guarded likes, favourites, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.functions import lexicons as lx
from clauselake.operators.ordered import Scan, running
from clauselake.operators.skew import lookup_join
from clauselake.runtime import cut_lineage

MARK_MICROS = lx.LIKE_MARK_HOURS * 3_600_000_000
HOUR_MICROS = 3_600_000_000
#: events of a key that share a block, and slices of an hour at most
EVENTS_PER_BLOCK, MOST_SLICES = 4096, 1 << 20


def hour_block(micros: str = "at") -> Column:
    return F.floor(F.col(micros) / HOUR_MICROS)


def busy_blocks(events: DataFrame, keys: list[str], micros: str = "at", limit: int = EVENTS_PER_BLOCK) -> DataFrame:
    """Add ``block``: hours of a key, and equal slices of an hour that holds more than ``limit`` events of it.

    Blocks ascend with time, so one key that is very busy within an hour is still spread over many tasks; only events of
    one microsecond stay together.  ``keys`` hold no nulls.
    """
    hourly = events.withColumn("__hour", hour_block(micros))
    busy = hourly.groupBy(*keys, "__hour").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit)
    busy = busy.select(*keys, "__hour", F.least(F.ceil(F.col("__n") / limit), F.lit(MOST_SLICES)).alias("__slices"))
    sliced = lookup_join(hourly, busy, [*keys, "__hour"])
    within = F.col(micros) - F.col("__hour") * HOUR_MICROS
    part = F.coalesce(F.floor(within * F.col("__slices") / HOUR_MICROS), F.lit(0))
    return sliced.select(*events.columns, (F.col("__hour") * MOST_SLICES + part).alias("block"))


def clamped_counter(deltas: DataFrame, keys: list[str], order: list[str], block: Column) -> DataFrame:
    """Final counter per key when a decrement only applies above zero.

    Equals the sum minus the lowest point the running sum reaches below zero.
    Blocks are scanned on their own and joined through their totals, so one
    busy key is spread over its blocks.
    """
    part = [*keys, "__block"]
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = deltas.withColumn("__block", block).select(*part, "delta", F.sum("delta").over(inside).alias("level"))
    blocks = local.groupBy(*part).agg(F.sum("delta").alias("total"), F.min("level").alias("low"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)))
    return placed.groupBy(*keys).agg(
        (F.sum("total") - F.least(F.lit(0), F.min(F.col("base") + F.col("low")))).alias("counter")
    )


def toggled(events: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are set after all toggles (an odd number of them); needs no order."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").drop("n")


def guarded_marks(events: DataFrame, mark: str, unmark: str, ttl_micros: int = MARK_MICROS) -> DataFrame:
    """Decide which marks and un-marks of a user on a post take effect.

    A mark counts when no live mark exists and lives for ``ttl_micros``; an
    un-mark needs a live mark.  ``events``: ``event_id, user_id, post_id,
    action, at`` (microseconds).  Returns them with ``accepted``.

    After an un-mark nothing is marked, so un-marks cut a key into segments.
    Inside a segment each accepted mark points to the first mark at least one
    lifetime later.  Those pointers are found inside hour blocks and followed by
    doubling, so neither a fold over a whole key nor a single task per key is
    needed, however busy one pair of user and post is.
    """
    keys = ["user_id", "post_id"]
    wanted = events.filter(F.col("action").isin(mark, unmark)).select("event_id", *keys, "action", "at")
    is_unmark = F.when(F.col("action") == unmark, 1).otherwise(0)
    counted = running(wanted, keys, ["at", "event_id"], hour_block(), [Scan("undone", "sum", is_unmark)])
    segmented = cut_lineage(counted.withColumn("segment", F.col("undone") - is_unmark).drop("undone"))

    seg = [*keys, "segment"]
    marks = segmented.filter(F.col("action") == mark).select("event_id", *seg, "at")
    ordered = running(marks, seg, ["at", "event_id"], hour_block(), [Scan("prev_at", "prev", F.col("at"))])
    is_head = F.col("prev_at").isNull() | (F.col("at") - F.col("prev_at") >= ttl_micros)
    heads = ordered.filter(is_head).select("event_id")
    accepted = cut_lineage(_follow(heads, _next_marks(marks, seg, ttl_micros)))

    good = marks.join(accepted, "event_id", "left_semi")
    newest = good.groupBy(*seg).agg(F.max("at").alias("marked_at"))
    undo = segmented.filter(F.col("action") == unmark).join(newest, seg, "left")
    undo = undo.withColumn("accepted", F.coalesce(F.col("at") - F.col("marked_at") < ttl_micros, F.lit(False)))
    did = segmented.filter(F.col("action") == mark).join(accepted.withColumn("hit", F.lit(True)), "event_id", "left")
    did = did.withColumn("accepted", F.coalesce("hit", F.lit(False)))
    out = ["event_id", *keys, "action", "at", "accepted"]
    return did.select(*out).unionByName(undo.select(*out))


def _next_marks(marks: DataFrame, seg: list[str], ttl_micros: int) -> DataFrame:
    """``src, dst``: the first mark of the segment at least one lifetime after ``src``."""
    is_mark = F.col("is_mark")
    here = marks.select("event_id", *seg, "at", F.lit(1).alias("is_mark"))
    probe = marks.select("event_id", *seg, (F.col("at") + ttl_micros).alias("at"), F.lit(0).alias("is_mark"))
    both = here.unionByName(probe).withColumn("block", hour_block())
    found = F.struct("at", "event_id")
    ahead = (
        Window.partitionBy(*seg, "block").orderBy("at", "is_mark", "event_id").rowsBetween(1, Window.unboundedFollowing)
    )
    rows = both.withColumn("in_block", F.first(F.when(is_mark == 1, F.col("event_id")), ignorenulls=True).over(ahead))
    firsts = both.groupBy(*seg, "block").agg(F.min(F.when(is_mark == 1, found)).alias("first"))
    later = Window.partitionBy(*seg).orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    jumps = firsts.select(
        *seg, "block", F.first(F.col("first.event_id"), ignorenulls=True).over(later).alias("next_block")
    )
    probes = rows.filter("is_mark = 0").join(jumps, [*seg, "block"], "left")
    return probes.select(F.col("event_id").alias("src"), F.coalesce("in_block", "next_block").alias("dst")).filter(
        "dst IS NOT NULL"
    )


def _follow(heads: DataFrame, pointers: DataFrame) -> DataFrame:
    """All ids reachable from ``heads``; the reach doubles per round."""
    reached, jump = cut_lineage(heads), cut_lineage(pointers)
    while True:
        step = reached.join(jump, reached["event_id"] == jump["src"]).select(F.col("dst").alias("event_id"))
        fresh = cut_lineage(step.distinct().join(reached, "event_id", "left_anti"))
        if fresh.isEmpty():
            return reached
        reached = cut_lineage(reached.unionByName(fresh))
        onward = jump.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
        jump = cut_lineage(lookup_join(jump, onward, ["dst"], "inner").select("src", F.col("far").alias("dst")))


def post_stats(events: DataFrame, likes: DataFrame, favorites: DataFrame) -> DataFrame:
    """Views, likes and favourites per post from the view log and the decided marks."""
    views = events.filter("action = 'view'").groupBy("post_id").agg(F.count(F.lit(1)).alias("views"))

    def net(marks: DataFrame, mark: str, name: str) -> DataFrame:
        change = F.when(F.col("action") == mark, 1).otherwise(-1)
        return marks.filter("accepted").groupBy("post_id").agg(F.sum(change).alias(name))

    posts = events.select("post_id").distinct()
    joined = posts.join(views, "post_id", "left").join(net(likes, "like", "likes"), "post_id", "left")
    joined = joined.join(net(favorites, "favorite", "favorites"), "post_id", "left")
    zero = F.lit(0)
    return joined.select("post_id", *[F.coalesce(c, zero).alias(c) for c in ("views", "likes", "favorites")])


def _category_levels(categories: DataFrame, root_name: str | None) -> DataFrame:
    """Rows of all levels; ``closes`` marks a row whose category already stands on its own path.  Such a row has no children."""
    c = F.col
    roots = categories.filter(c("parent_id") == 0)
    if root_name is not None:
        roots = roots.filter(c("name") == root_name)
    level = roots.select(
        c("id").alias("root_id"), "id", "name", "parent_id", F.lit(1).alias("depth"), c("id").cast("string").alias("path"), F.lit(False).alias("closes")
    )
    children = categories.select("id", "name", "parent_id")
    tree = level
    while True:
        above = level.filter("NOT closes").select(c("id").alias("parent_id"), "root_id", "depth", "path")
        below = lookup_join(children, above, ["parent_id"], "inner").select(
            "root_id", "id", "name", "parent_id", (c("depth") + 1).alias("depth"), F.concat("path", F.lit("/"), c("id").cast("string")).alias("path"),
            F.array_contains(F.split("path", "/"), c("id").cast("string")).alias("closes"),
        )
        level = cut_lineage(below)
        if level.isEmpty():
            return tree
        tree = tree.unionByName(level)


def category_tree(categories: DataFrame, root_name: str | None = None) -> DataFrame:
    """Every category below a level-1 category: ``root_id, id, name, parent_id, depth, path``.

    One join per level; each level is written out, so depth does not lengthen
    the plan, and a parent with very many children is spread by the lookup join.
    A category that is its own ancestor is not entered again (``category_cycles``).
    """
    return _category_levels(categories, root_name).filter("NOT closes").drop("closes")


def category_cycles(categories: DataFrame, root_name: str | None = None) -> DataFrame:
    """The rows that lead back into their own path: ``root_id, id, name, parent_id, depth, path``."""
    return _category_levels(categories, root_name).filter("closes").drop("closes")
