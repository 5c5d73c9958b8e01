"""Scalar functions for tasks, prices, times and timed lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Fixed value: a speaker's label at the start of a text.
SPEAKER = r"^\s*Speaker\s+[A-Z]:\s*"
#: Fixed value: what names an overloaded service in an error message.
BUSY = "429|503|resource_exhausted|unavailable"


def trimmed(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def tier(header: Column, guess: Column) -> Column:
    """The tier the service names, where it is a known one, else the one asked for."""
    h = F.lower(header)
    return F.when(h.isin("flex", "standard", "priority"), h).otherwise(guess)


def error_class(code: Column, message: Column) -> Column:
    """`transient` for overload codes or messages, else `permanent`."""
    busy = F.lower(F.coalesce(message, F.lit(""))).rlike(BUSY)
    return F.when(F.coalesce(code.isin(429, 503), F.lit(False)) | busy, "transient").otherwise("permanent")


def ago(seconds: Column) -> Column:
    """Coarse age: minutes, hours or days; empty for null, zero and negative ages."""
    whole = lambda n: F.floor(seconds / n).cast("string")
    return (
        F.when(seconds.isNull() | (seconds <= 0), "")
        .when(seconds < 60, "<1m")
        .when(seconds < 3600, F.concat(whole(60), F.lit("m")))
        .when(seconds < 86400, F.concat(whole(3600), F.lit("h")))
        .otherwise(F.concat(whole(86400), F.lit("d")))
    )


def clock_short(seconds: Column) -> Column:
    """h:mm:ss, or m:ss under an hour."""
    s = F.floor(seconds).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m = F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s % 60))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(s % 60)))


def back_off(attempt: Column, base: float, factor: float, most: float) -> Column:
    """Delay before the attempt (from 0): base * factor ^ attempt, most at the longest."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(float(factor)), attempt))


def estimate(megabytes: Column) -> dict[str, Column]:
    """Minutes, tokens, cost and processing minutes expected of an upload, a megabyte a minute."""
    tokens = F.round(megabytes * 800)
    return {"minutes": megabytes, "tokens": tokens.cast("long"), "cost": tokens * 1.5e-5, "processing": F.greatest(F.lit(1.0), F.round(megabytes * 0.3))}


def without_speaker(text: Column) -> Column:
    """A text without a leading label of one speaker letter."""
    return F.regexp_replace(text, SPEAKER, "")


def threshold(loudest: Column) -> Column:
    """Level that a frame must exceed to be speech; null for silence."""
    return F.when(loudest >= 1e-4, F.greatest(loudest * 0.005, F.lit(0.0005)))


def mime(name: Column) -> Column:
    """Media type by extension; null for an unknown one."""
    # Types of the accepted extensions.
    types = {".m4a": "audio/mp4", ".mp4": "audio/mp4", ".mp3": "audio/mpeg", ".wav": "audio/wav", ".flac": "audio/flac", ".ogg": "audio/ogg", ".opus": "audio/opus", ".webm": "audio/webm", ".aac": "audio/aac", ".wma": "audio/x-ms-wma"}
    at = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return F.try_element_at(at, F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)))


def valid_uuid(text: Column) -> Column:
    """The text in lower case if it has the form of a UUID, else null."""
    return F.when(text.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lower(text))
