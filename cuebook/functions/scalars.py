"""Scalar text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(name: Column) -> Column:
    """File name without its last extension; null gives `transcript`."""
    return F.coalesce(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit("transcript"))


def safe_name(name: Column) -> Column:
    """Forbidden and control characters to _, blanks and dots trimmed, 80 characters at most, `audio` when empty."""
    # Fixed value: characters that file systems forbid.
    s = F.substring(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"^[ .]+|[ .]+\z", ""), 1, 80)
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("audio"))


def fingerprint(text: Column) -> Column:
    return F.concat(F.lit("len="), F.length(text).cast("string"), F.lit(" md5="), F.substring(F.md5(text), 1, 8))


def folder_name(name: Column, task: Column) -> Column:
    """Folder of a task's files: its name's safe stem and the first 12 letters or digits of its id, `task` without any."""
    base = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\\\]", ""), r"(?<=.)\.[^.]*$", "")
    short = F.substring(F.regexp_replace(task, "[^a-zA-Z0-9]", ""), 1, 12)
    return F.concat(safe_name(base), F.lit("_"), F.coalesce(F.nullif(short, F.lit("")), F.lit("task")))


def prompt(template: Column, source: Column, target: Column, many: Column, names: Column, speaker: Column, translate: Column) -> Column:
    """A template with its places {source_lang}, {speaker_instruction} and {translate_instruction} filled, newlines at the end gone.

    names maps language codes to names. The speaker line stands only for many speakers; the translate line, whose {n} is 7 then and 6 else and whose {target_lang}
    is named, only for a target other than the source."""
    named = lambda c: F.coalesce(F.try_element_at(names, c), c)
    wanted = F.coalesce((F.nullif(target, F.lit("")).isNotNull()) & (target != source), F.lit(False))
    line = F.when(wanted, F.replace(F.replace(translate, F.lit("{n}"), F.when(many, "7").otherwise("6")), F.lit("{target_lang}"), named(target))).otherwise("")
    text = F.replace(F.replace(template, F.lit("{source_lang}"), named(source)), F.lit("{speaker_instruction}"), F.when(many, speaker).otherwise(""))
    return F.regexp_replace(F.replace(text, F.lit("{translate_instruction}"), line), r"\n+\z", "")


def short_date(at: Column) -> Column:
    return F.date_format(at, "MM/dd HH:mm")


def hours_minutes(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), (F.floor(s / 60).cast("long") % 60).cast("string"), F.lit("m"))


def short_number(n: Column) -> Column:
    """Thousands with one decimal and k, millions with two and M, smaller numbers as they are."""
    return F.when(n >= 1000000, F.concat(F.format_string("%.2f", n / 1e6), F.lit("M"))).when(n >= 1000, F.concat(F.format_string("%.1f", n / 1e3), F.lit("k"))).otherwise(n.cast("string"))


def half_even(x: Column, digits: int) -> Column:
    """A double rounded to digits (0 to 22) as its exact binary value asks, a true half to the even neighbour."""
    return _rounded(x, digits, lambda low: low % 2 == 1)


def half_up(x: Column, digits: int) -> Column:
    """As half_even(), but a true half goes to the greater neighbour, that of a negative number to the lesser."""
    return _rounded(x, digits, lambda low: F.lit(True))


def _rounded(x: Column, digits: int, up_at_half) -> Column:
    """From 2^52 tenths (hundredths, ...) on the decimal text decides.

    x times the power of ten is one double plus its error, which Dekker's product gives exactly; the error decides whether a half is one."""
    x = x.cast("double")
    ten, size = float(10**digits), F.abs(x)

    def halves(v):
        c = v * 134217729.0
        high = c - (c - v)
        return high, v - high

    p = size * ten
    (a, b), (c, d) = halves(size), halves(F.lit(ten))
    error = b * d - (((p - a * c) - b * c) - a * d)
    low = F.floor(p).cast("double")
    rest = p - low
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & up_at_half(low))))
    made = (low + F.when(up, 1.0).otherwise(0.0)) / ten
    return F.when(p < 2.0**52, F.when(x < 0, -made).otherwise(made)).when(F.isnan(x) | (size == float("inf")), x).otherwise(F.bround(x, digits))


def down_mix(left: Column, right: Column) -> Column:
    """Mean of two channels, sample by sample."""
    return F.zip_with(left, right, lambda a, b: (a.cast("double") + b.cast("double")) / 2)


def text_list(text: Column) -> Column:
    """Array of strings of a JSON text; broken or null text gives an empty one."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def nested_text(text: Column, *path: str) -> Column:
    """A text deep in a JSON text, trimmed; null where a step is missing, the JSON is broken or nothing is left."""
    from cuebook.functions.labels import trimmed

    return F.nullif(trimmed(F.get_json_object(text, "$" + "".join(f"['{p}']" for p in path))), F.lit(""))


def is_video_site(url: Column) -> Column:
    """Whether a url names the video site by one of its hosts."""
    return url.contains("youtube.com") | url.contains("youtu.be")


def plain_id(uuid: Column) -> Column:
    return F.replace(uuid, F.lit("-"), F.lit(""))


def client_id(prefix: str, at: Column, number: Column) -> Column:
    """prefix, the time in milliseconds and a number in base 36."""
    return F.concat_ws("-", F.lit(prefix), F.unix_millis(at.cast("timestamp")).cast("string"), F.lower(F.conv(number.cast("string"), 10, 36)))


def millis(text: Column) -> Column:
    """Milliseconds of a time as text, 0 for null and for what is no time."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(text)), F.lit(0))



def of_family(model: Column, prefix: str) -> Column:
    """Whether a model's name begins with a family's."""
    return model.startswith(prefix)


def thousands(n: Column) -> Column:
    """A whole number with a comma between thousands; a dash for null and 0."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, "\u2014").otherwise(F.format_number(n, 0))


def money(x: Column, digits: int = 4) -> Column:
    """$ and so many decimals; a dash for null."""
    return F.when(x.isNull(), "\u2014").otherwise(F.concat(F.lit("$"), F.format_string(f"%.{digits}f", half_up(x, digits))))
