"""Timed text and energy segments: formats, shifts, runs, merges and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuebook.functions.labels import trimmed, without_speaker
from cuebook.operators.ordered import MOST, Ordered, following, place, previous, top_before, total


#: Fixed value: a timed line, exactly two digits of minutes and seconds, two or three of the fraction.
LINE = r"^\[(\d{2}):(\d{2})\.(\d{2,3})\]([^\n]*)"


def padded(number: Column, width: int) -> Column:
    """A whole number with zeros in front; longer ones stay whole."""
    text = number.cast("long").cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def clock(ms: Column, mark: str) -> Column:
    """hh:mm:ss and milliseconds after the mark, from milliseconds; negative times are 0, fractions are cut off."""
    t = F.greatest(ms, F.lit(0)).cast("long")
    at = lambda n, m: F.floor(t / n) % m
    return F.concat(padded(F.floor(t / 3600000), 2), F.lit(":"), padded(at(60000, 60), 2), F.lit(":"), padded(at(1000, 60), 2), F.lit(mark), padded(t % 1000, 3))


def stamp(ms: Column) -> Column:
    """[mm:ss.cc] of a time in milliseconds, cut off to centiseconds."""
    return F.concat(F.lit("["), padded(F.floor(ms / 60000), 2), F.lit(":"), padded(F.floor(ms / 1000) % 60, 2), F.lit("."), padded(F.floor(ms % 1000 / 10), 2), F.lit("]"))


def line_ms(line: Column) -> Column:
    """Milliseconds of a timed line."""
    part = lambda i: F.regexp_extract(line, LINE, i)
    return (part(1).cast("long") * 60 + part(2).cast("long")) * 1000 + F.rpad(part(3), 3, "0").cast("long")


def line_text(line: Column) -> Column:
    """Text of a timed line, trimmed, without a speaker's label."""
    return without_speaker(trimmed(F.regexp_extract(line, LINE, 4)))


def parse_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Timed lines with start_ms and text; other lines go."""
    return lines.where(F.col(column).rlike(LINE)).withColumn("start_ms", line_ms(F.col(column))).withColumn("text", line_text(F.col(column)))


def with_ends(cues: DataFrame, last_ms: int = 5000, most: int = MOST) -> DataFrame:
    """cues with end_ms: the next line's start in line order, or the start plus last_ms; and number, their place (from 1) among the file's cues."""
    d = Ordered(cues, "file_id", ["line_no"], most).scan(end_ms=following("start_ms"), number=place()).rows()
    return d.withColumn("end_ms", F.coalesce("end_ms", F.col("start_ms") + last_ms)).withColumn("number", F.col("number").cast("int"))


def document(cues: DataFrame, style: str) -> DataFrame:
    """One srt, vtt or txt text per file, lines in order. srt blocks are numbered, vtt blocks aren't; both end with a newline."""
    mark, arrow = ("," if style == "srt" else "."), F.lit(" --> ")
    number = F.concat(F.col("number").cast("string"), F.lit("\n")) if style == "srt" else F.lit("")
    body = F.col("text") if style == "txt" else F.concat(number, clock(F.col("start_ms"), mark), arrow, clock(F.col("end_ms"), mark), F.lit("\n"), F.col("text"), F.lit("\n"))
    rows = F.array_sort(F.collect_list(F.struct("line_no", body.alias("s"))))
    head = "WEBVTT\n\n" if style == "vtt" else ""
    return cues.groupBy("file_id").agg(F.concat(F.lit(head), F.array_join(F.transform(rows, lambda r: r["s"]), "\n")).alias("content"))


def converted(rows: DataFrame, text: str, last_ms: int = 5000) -> DataFrame:
    """rows with lrc, srt, vtt and txt of a whole timed text, row by row without a shuffle. A blank or null text gives four empty ones, one without a timed line
    itself and three empty ones. The cues are a column of their own, so that a text is parsed once."""
    clean = trimmed(F.coalesce(text, F.lit("")))
    lines = F.filter(F.split(clean, "\n"), lambda x: x.rlike(LINE))
    cues = F.transform(lines, lambda x, i: F.struct((i + 1).alias("n"), line_ms(x).alias("ms"), line_text(x).alias("s")))

    def blocks(mark: str, numbered: bool) -> Column:
        def block(c, after):
            number = F.concat(c["n"].cast("string"), F.lit("\n")) if numbered else F.lit("")
            return F.concat(number, clock(c["ms"], mark), F.lit(" --> "), clock(F.coalesce(after["ms"], c["ms"] + last_ms), mark), F.lit("\n"), c["s"], F.lit("\n"))

        return F.array_join(F.zip_with("_cues", F.slice("_cues", F.lit(2), F.size("_cues")), block), "\n")

    d = rows.withColumn("_cues", cues).withColumn("lrc", F.when(clean == "", "").otherwise(F.col(text)))
    d = d.withColumn("srt", blocks(",", True)).withColumn("vtt", F.when(F.size("_cues") > 0, F.concat(F.lit("WEBVTT\n\n"), blocks(".", False))).otherwise(""))
    return d.withColumn("txt", F.array_join(F.transform("_cues", lambda c: c["s"]), "\n")).drop("_cues")


def shifted(text: Column, offset_s: float) -> Column:
    """A timed text with its times moved, seconds in two decimals; other lines stay as they are, and so does the whole text for an offset of 0."""
    if offset_s == 0:
        return text

    def move(x):
        t = line_ms(x) / 1000 + F.lit(float(offset_s))
        minutes = (t / 60).cast("long")
        seconds = F.format_string("%05.2f", t - F.floor(t / 60) * 60)
        return F.when(x.rlike(LINE), F.concat(F.lit("["), padded(minutes, 2), F.lit(":"), seconds, F.lit("]"), F.regexp_extract(x, LINE, 4))).otherwise(x)

    return F.array_join(F.transform(F.split(trimmed(text), "\n"), move), "\n")


def remapped_text(cues: DataFrame, segments: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, lrc): the cues (line_no, start_cs, text) of speech-only audio printed at their times in the whole file, labels stripped; '' where none is left."""
    from cuebook.operators import segments as parts

    at = parts.remapped(cues, segments, key)
    line = F.concat(stamp(F.col("start_cs") * 10), without_speaker(trimmed(F.col("text"))))
    rows = F.array_sort(F.collect_list(F.struct("line_no", line.alias("s"))))
    text = at.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["s"]), "\n").alias("lrc"))
    return cues.select(key).distinct().join(text, key, "left").select(key, F.coalesce("lrc", F.lit("")).alias("lrc"))


def runs(flags: DataFrame, key: str, order: list[str], flag: str = "flag", most: int = MOST) -> DataFrame:
    """Maximal runs of equal flags: key, run (from 1), flag, first and last place (from 1), length."""
    d = Ordered(flags, key, order, most).scan(place=place(), _before=previous(flag))
    d = d.with_column("turn", F.when(F.col(flag).eqNullSafe(F.col("_before")) & (F.col("place") > 1), 0).otherwise(1)).scan(run=total("turn")).rows()
    return d.groupBy(key, "run", flag).agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("length"))


def filled(flags: DataFrame, key: str, order: list[str], flag: str = "flag", gap: int = 20, most: int = MOST) -> DataFrame:
    """Runs after silent runs shorter than gap are set, a leading one too but the last run never; then joined with their neighbours."""
    d = Ordered(runs(flags, key, order, flag, most), key, ["run"], most).scan(_next=following("run"))
    d = d.with_column("on", F.col(flag) | ((F.col("length") < gap) & F.col("_next").isNotNull())).scan(_on=previous("on"))
    g = d.with_column("turn", F.when(F.col("on") == F.coalesce("_on", ~F.col("on")), 0).otherwise(1)).scan(g=total("turn")).rows()
    return g.groupBy(key, "g", "on").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("g")


def merged(intervals: DataFrame, key: str, start: str = "start", end: str = "end", most: int = MOST) -> DataFrame:
    """Overlapping or touching intervals of a key as one."""
    d = Ordered(intervals, key, [start, end], most).scan(_top=top_before(end))
    d = d.with_column("new", F.when(F.col("_top").isNull() | (F.col(start) > F.col("_top")), 1).otherwise(0)).scan(g=total("new")).rows()
    return d.groupBy(key, "g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("g")


def clusters(rows: DataFrame, time: str, kind: str, tie: str, gap_seconds: int = 600, most: int = MOST) -> DataFrame:
    """rows with cluster (from 1), over all rows in order of time: a row joins the cluster before it if it is at most the gap later and of the same kind. A row
    without a time, or from 1970's first instant, begins its own; these come first. Null kinds are ''."""
    d = rows.withColumn(time, F.coalesce(F.col(time).cast("timestamp"), F.timestamp_micros(F.lit(0)))).withColumn(kind, F.coalesce(kind, F.lit(""))).withColumn("_all", F.lit(0))
    return _joined(d, "_all", time, kind, tie, gap_seconds, most, "cluster", F.unix_micros(time) > 0).drop("_all")


def sessions(rows: DataFrame, key: str, time: str, kind: str, tie: str, gap_seconds: int = 600, most: int = MOST) -> DataFrame:
    """rows with session (from 1): a new one starts when the gap is exceeded or the kind changes."""
    return _joined(rows, key, time, kind, tie, gap_seconds, most, "session", F.lit(True))


def _joined(rows: DataFrame, key: str, time: str, kind: str, tie: str, gap_seconds: int, most: int, name: str, may: Column) -> DataFrame:
    d = Ordered(rows, key, [time, tie], most).scan(_time=previous(time), _kind=previous(kind))
    seconds = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("_time").cast("timestamp"))) / 1e6
    apart = seconds.isNull() | (seconds > gap_seconds) | (F.col(kind) != F.col("_kind")) | ~may
    return d.with_column("_new", F.when(apart, 1).otherwise(0)).scan(**{name: total("_new")}).rows().drop("_time", "_kind", "_new")


def frame_rms(frames: DataFrame, column: str) -> DataFrame:
    """frames with rms, the root of the mean square plus 1e-10."""
    square = F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return frames.withColumn("rms", F.sqrt(square / F.size(column) + F.lit(1e-10)))
