"""Prefetch orders, cache eviction and playback steps as queries over frames and cache entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefetch_plan(frames: DataFrame, strategy: str, playhead: str = "playhead", n: str = "n", visits: DataFrame | None = None) -> DataFrame:
    """Frames to fetch, in order: (source, priority, frame), before cached ones are left out.

    frames has one row a source with its number of frames and playhead.
    on-demand takes the playhead and then the visited frames, newest first;
    forward goes around from the next frame; full-range from the playhead;
    bidirectional alternates ahead and behind in growing distance, and names
    frames again beyond half way round.
    """
    p, c = F.col(playhead), F.col(n)
    if strategy == "on-demand":
        seen = frames.join(visits, "source").filter((F.col("frame") >= 0) & (F.col("frame") < c)).select("source", "frame", "visit")
        now = frames.filter((p >= 0) & (p < c)).select("source", p.cast("long").alias("frame"), F.lit(2**62).alias("visit"))
        latest = seen.unionByName(now).groupBy("source", "frame").agg(F.max("visit").alias("visit"))
        order = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("visit"), "frame"))
        return latest.select("source", (order - 1).alias("priority"), "frame")
    if strategy == "bidirectional":
        steps = frames.filter(c > 1).select("source", c.alias("_n"), p.alias("_p"), F.explode(F.sequence(F.lit(1), c - 1)).alias("r"))
        ahead, behind = F.pmod(F.col("_p") + F.col("r"), F.col("_n")), F.pmod(F.col("_p") - F.col("r"), F.col("_n"))
        both = steps.select("source", F.posexplode(F.when(ahead == behind, F.array(ahead)).otherwise(F.array(ahead, behind))).alias("side", "frame"), "r")
        return both.select("source", (2 * (F.col("r") - 1) + F.col("side")).alias("priority"), "frame")
    first = 1 if strategy == "forward" else 0
    steps = frames.filter(c > first).select("source", c.alias("_n"), p.alias("_p"), F.explode(F.sequence(F.lit(first), c - 1)).alias("step"))
    return steps.select("source", F.col("step").alias("priority"), F.pmod(F.col("_p") + F.col("step"), F.col("_n")).alias("frame"))


def uncached(plan: DataFrame, cached: DataFrame) -> DataFrame:
    return plan.join(cached.select("source", "frame"), ["source", "frame"], "left_anti").select("source", "priority", "frame")


def limit_bytes(mb: int) -> int:
    """A cache's limit, which stays within 64 and 65536 MB, in bytes."""
    return max(64, min(65536, mb)) * 1024 * 1024


def placed(entries: DataFrame, frames: DataFrame) -> DataFrame:
    """entries with the frame's place in its sequence, from frames (source, frame_id, frame); null for those that are in none."""
    return entries.join(frames.select("source", "frame_id", "frame"), ["source", "frame_id"], "left")


def evicted(entries: DataFrame, limit: int, policy: str = "oldest", playhead: str | None = None, distance: int = 64) -> DataFrame:
    """What leaves a cache that holds more than limit bytes, with rank; a row an entry and buffer: (source, tier, key, age, buffer_id, bytes[, frame]).

    With policy 'distance' decoded frames farther than `distance` from the
    playhead go first, farthest first; then the oldest buffers, then the oldest
    frames, then the oldest parts, until the rest fits.  The order does not
    depend on what is freed.  A buffer that several entries hold counts once,
    and is freed with the last of them.
    """
    far = F.lit(None).cast("long")
    if policy == "distance":
        d = F.abs(F.col("frame") - F.col(playhead))
        far = F.when((F.col("tier") == "frame") & (d > distance), d)
    tier = F.when(far.isNotNull(), 0).when(F.col("tier") == "buffer", 1).when(F.col("tier") == "frame", 2).otherwise(3)
    w = Window.partitionBy("source").orderBy(tier, far.desc_nulls_last(), "age", "key")
    ranked = entries.withColumn("rank", F.dense_rank().over(w))
    holders = Window.partitionBy("source", "buffer_id").orderBy(F.desc("rank"), F.desc("bytes"))
    ranked = ranked.withColumn("_own", F.when(F.row_number().over(holders) == 1, F.col("bytes")).otherwise(0))
    total = F.sum("_own").over(Window.partitionBy("source"))
    freed = F.coalesce(F.sum("_own").over(Window.partitionBy("source").orderBy("rank").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranked.withColumn("_over", total - freed > limit).filter("_over").drop("_over", "_own")


def within(entries: DataFrame, most: int, by: list[str], age: str) -> DataFrame:
    """The `most` youngest entries of each group: of more, the oldest go."""
    w = Window.partitionBy(*by).orderBy(F.desc(age))
    return entries.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= most).drop("_place")


def history(visits: DataFrame, most: int = 64) -> DataFrame:
    """The last visits (source, frame, visit) of each source, at most so many; a frame that is visited again at once counts once."""
    before = F.lag("frame").over(Window.partitionBy("source").orderBy("visit"))
    moved = visits.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.col("frame"))).drop("_before")
    return within(moved, most, ["source"], "visit")


def stepped(place: Column, direction: int, n: Column) -> Column:
    """The place one step on or back, around the ends; no place counts as the first."""
    return F.pmod(F.coalesce(place, F.lit(0)) + direction, n)


def cache_stats(entries: DataFrame) -> DataFrame:
    """Totals by source: bytes and entries of each tier, and bytes of distinct buffers."""
    of = lambda t: F.when(F.col("tier") == t, F.col("bytes"))
    sums = [F.coalesce(F.sum(of(t)), F.lit(0)).alias(f"{t}_bytes") for t in ("part", "frame", "buffer")]
    counts = [F.count(of(t)).alias(f"{t}_count") for t in ("part", "frame", "buffer")]
    all_ = entries.groupBy("source").agg(F.sum("bytes").alias("cache_bytes"), *sums, *counts)
    once = entries.groupBy("source", "buffer_id").agg(F.max("bytes").alias("b")).groupBy("source").agg(F.sum("b").alias("unique_bytes"))
    return all_.join(once, "source")


def next_frame(players: DataFrame, cached: DataFrame, mode: str) -> DataFrame:
    """(source, next) of each player (source, n, playhead).

    'every' steps by one; 'cached' does so only when the next frame is cached;
    'timing' goes to the next cached frame around, or else by one.
    """
    step = F.pmod(F.col("playhead") + 1, F.col("n"))
    if mode == "every":
        return players.select("source", step.alias("next"))
    known = cached.select("source", "frame").distinct()
    if mode == "cached":
        hit = known.select(F.col("source").alias("_s"), F.col("frame").alias("_f"))
        joined = players.withColumn("step", step).join(hit, (F.col("source") == F.col("_s")) & (F.col("step") == F.col("_f")), "left")
        return joined.select("source", F.when(F.col("_f").isNotNull(), F.col("step")).otherwise(F.col("playhead")).alias("next"))
    around = players.join(known, "source", "left").withColumn("ahead", F.pmod(F.col("frame") - F.col("playhead") - 1, F.col("n")))
    usable = F.when((F.col("frame") >= 0) & (F.col("frame") < F.col("n")), F.struct("ahead", "frame"))
    return around.groupBy("source", "n", "playhead").agg(F.min(usable)["frame"].alias("hit")).select("source", F.coalesce("hit", step).alias("next"))


def stage_of(frames: DataFrame, decoded: DataFrame, buffered: DataFrame) -> DataFrame:
    """(source, frame, stage) of each frame: decoded, buffered or none."""
    d, b = (x.select("source", "frame").distinct().withColumn(f, F.lit(True)) for x, f in ((decoded, "_d"), (buffered, "_b")))
    both = frames.join(d, ["source", "frame"], "left").join(b, ["source", "frame"], "left")
    return both.select("source", "frame", F.when(F.col("_d"), "decoded").when(F.col("_b"), "buffered").otherwise("none").alias("stage"))


def usage(used: Column, limit_mb: Column) -> tuple[Column, Column]:
    """(share of the limit in use, at most 1; is it exceeded?); the limit stays within 64 and 65536 MB."""
    limit = F.greatest(F.lit(64), F.least(F.lit(65536), limit_mb)) * 1024 * 1024
    return F.least(used / limit, F.lit(1.0)), used > limit
