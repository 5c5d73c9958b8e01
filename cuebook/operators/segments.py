"""Speech segments: framing, padded runs, prefix sums, time re-mapping and the best place to split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuebook.operators import timeline
from cuebook.operators.ordered import MOST, Ordered, following, latest, total_before


def frames(samples: str, width: int) -> Column:
    """Root mean square (plus 1e-10 under the root) of each block of width samples; the last block is filled up with zeros.

    Fewer samples than one block give null. Row-local, so that a long file is never exploded into sample rows."""
    n = F.size(samples)

    def rms(k: Column) -> Column:
        part = F.slice(samples, k * width + 1, F.lit(width))
        return F.sqrt(F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / width + F.lit(1e-10))

    return F.when(n >= width, F.transform(F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1), rms))


def padded_runs(flags: DataFrame, key: str, order: list[str], frame_ms: int = 50, pad_ms: int = 300, least: int = 2, most: int = MOST) -> DataFrame:
    """Runs of at least `least` true flags as (key, start_ms, end_ms), widened by pad_ms within the file; a run that reaches the end ends there."""
    total = flags.groupBy(key).agg((F.count("*") * frame_ms).alias("total"))
    r = timeline.runs(flags, key, order, most=most).where(F.col("flag") & (F.col("length") >= least)).join(total, key)
    start = F.greatest(F.lit(0), (F.col("first") - 1) * frame_ms - pad_ms)
    return r.select(key, start.cast("long").alias("start_ms"), F.least("total", F.col("last") * frame_ms + pad_ms).cast("long").alias("end_ms"))


def with_offsets(segments: DataFrame, key: str = "file_id", order: str = "seg_no", most: int = MOST) -> DataFrame:
    """segments (start, end) with before, the summed length of the earlier segments of the file."""
    return Ordered(segments, key, [order], most).scan(before=total_before(F.col("end") - F.col("start"))).rows()


def remapped(cues: DataFrame, segments: DataFrame, key: str = "file_id", time: str = "start_cs", most: int = MOST) -> DataFrame:
    """cues of speech-only audio with their times in the whole file; those past the last segment go.

    Segments and cues of a file lie in one order of time, in which each cue takes the last segment begun: linear in both, with no pairs formed."""
    length = F.col("end") - F.col("start")
    s = with_offsets(segments, key, most=most).select(key, F.col("before").alias("_at"), F.struct("start", "before", length.alias("len")).alias("_seg"), length.alias("_len"))
    names = [F.col(c) for c in cues.columns]
    c = cues.select(F.col(key), F.col(time).alias("_at"), F.struct(*names).alias("_cue"))
    d = Ordered(s.unionByName(c, allowMissingColumns=True), key, ["_at", F.col("_cue").isNotNull(), "_len"], most).scan(_seg=latest("_seg")).rows()
    d = d.where("_cue is not null and _at >= _seg.before and _at < _seg.before + _seg.len")
    moved = F.col("_seg.start") + F.col("_at") - F.col("_seg.before")
    return d.select(*[moved.alias(time) if n == time else F.col("_cue")[n].alias(n) for n in cues.columns])


def split_points(segments: DataFrame, totals: DataFrame, key: str = "file_id", order: str = "seg_no", least: int = 100, most: int = MOST) -> DataFrame:
    """(key, split_at): the middle of the gap of at least `least` between neighbours that is nearest to half of the total; ties take the
    earliest, no gap takes half of the total. totals has key and total."""
    g = Ordered(segments, key, [order], most).scan(next=following("start")).rows().where(F.col("next") - F.col("end") >= least)
    g = g.join(totals, key).withColumn("mid", (F.col("end") + F.col("next")) / 2)
    best = g.groupBy(key).agg(F.min_by("mid", F.struct(F.abs(F.col("mid") - F.col("total") / 2), order)).alias("mid"))
    return totals.join(best, key, "left").select(key, F.coalesce("mid", F.col("total") / 2).alias("split_at"))


def speech_ratio(segments: DataFrame, totals: DataFrame, key: str = "file_id", below: float = 0.8) -> DataFrame:
    """(key, ratio, use_speech): length of the segments over the total (0 for no total), and whether it lies under the gate."""
    spoken = segments.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("spoken"))
    ratio = F.coalesce(F.try_divide(F.coalesce("spoken", F.lit(0)), F.col("total")), F.lit(0.0))
    return totals.join(spoken, key, "left").select(key, ratio.alias("ratio"), (ratio < below).alias("use_speech"))


def levels(frames: DataFrame, column: str) -> DataFrame:
    """frames with loudest, the largest magnitude, and mean_square."""
    x = F.transform(column, lambda v: F.abs(v.cast("double")))
    square = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    return frames.withColumn("loudest", F.array_max(x)).withColumn("mean_square", F.try_divide(square, F.size(column)))


def joined_results(parts: DataFrame, key: str, order: str, text: str = "text", tokens: tuple[str, ...] = ("tokens",), flex: str = "flex", failed: str | None = None) -> DataFrame:
    """One row per task of its parts: summed tokens, whether all were flex, and their texts in order (ties by text) joined by newlines. With failed, a flag of
    parts, a task of which any part failed has no result."""
    if failed is not None:
        bad = F.bool_or(F.coalesce(failed, F.lit(False))).alias("_bad")
        return joined_results(parts, key, order, text, tokens, flex).join(parts.groupBy(key).agg(bad).where("not _bad").drop("_bad"), key)
    rows = F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("s"))))
    return parts.groupBy(key).agg(*[F.sum(t).alias(t) for t in tokens], F.bool_and(flex).alias("all_flex"), F.array_join(F.transform(rows, lambda r: r["s"]), "\n").alias("text"))
