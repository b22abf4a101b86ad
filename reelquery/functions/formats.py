"""Times, ids, labels and numbers as they are stored and shown."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _hms(t: Column) -> tuple[Column, Column]:
    whole = F.floor(t)
    return F.floor(whole / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long")


def clock(t: Column | str) -> Column:
    """HH:MM:SS, seconds cut."""
    t = _c(t).cast("double")
    h, m = _hms(t)
    return F.format_string("%02d:%02d:%02d", h, m, F.floor(t % 60).cast("long"))


def clock_millis(t: Column | str) -> Column:
    """HH:MM:SS.mmm, rounded within the minute."""
    t = _c(t).cast("double")
    h, m = _hms(t)
    millis = F.round((t % 60) * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", h, m, F.floor(millis / 1000).cast("long"), millis % 1000)


def clock_hundredths(t: Column | str) -> Column:
    """HH:MM:SS.ss, the form in which results are shown."""
    t = _c(t).cast("double")
    h, m = _hms(t)
    hundredths = F.round((t % 60) * 100).cast("long")
    return F.format_string("%02d:%02d:%02d.%02d", h, m, F.floor(hundredths / 100).cast("long"), hundredths % 100)


def srt_seconds(x: Column | str) -> Column:
    """Seconds of H:M:S,mmm at the start of a text; null if there is none."""
    x = _c(x)
    part = lambda i: F.nullif(F.regexp_extract(x, r"^(\d+):(\d+):(\d+),(\d+)", i), F.lit("")).cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000


def episode_numbers(name: Column | str) -> tuple[Column, Column]:
    """Season and episode of SxxExx, one or two digits, blanks allowed; null if there is none."""
    part = lambda i: F.nullif(F.regexp_extract(_c(name), r"[Ss](\d{1,2})\s*[Ee](\d{1,2})", i), F.lit("")).cast("int")
    return part(1), part(2)


def episode_numbers_strict(name: Column | str) -> tuple[Column, Column]:
    """The same of two digits each and no blanks."""
    part = lambda i: F.nullif(F.regexp_extract(F.lower(_c(name)), r"s(\d{2})e(\d{2})", i), F.lit("")).cast("int")
    return part(1), part(2)


def safe_id(x: Column | str) -> Column:
    """Lower case, everything but a-z and 0-9 as single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def media_id(title: Column | str, season: Column | str, episode: Column | str) -> Column:
    """title_s01e02, or the title alone for what has no season."""
    s, e = _c(season), _c(episode)
    return F.when(s.isNull(), safe_id(title)).otherwise(F.concat(safe_id(title), F.lit("_s"), F.lpad(s.cast("string"), 2, "0"), F.lit("e"), F.lpad(e.cast("string"), 2, "0")))


def rational(x: Column | str) -> Column:
    """The number n/d, or a plain number; 0 if d is 0 or nothing can be read."""
    x = _c(x)
    n = F.regexp_extract(x, r"^\s*([0-9.]+)", 1).try_cast("double")
    d = F.when(x.contains("/"), F.regexp_extract(x, r"/\s*([0-9.]+)", 1).try_cast("double")).otherwise(1.0)
    return F.coalesce(n / F.nullif(d, F.lit(0.0)), F.lit(0.0))


def confidence(score: Column | str) -> Column:
    s = _c(score)
    return F.when(s >= 0.90, "Very High").when(s >= 0.80, "High").when(s >= 0.70, "Moderate").otherwise("Low")


def display_name(title: Column | str, season: Column | str, episode: Column | str, fallback: Column | str) -> Column:
    """"title S01 E02", the title alone without a season, the fallback without a title."""
    t, s, e = F.coalesce(_c(title), _c(fallback)), _c(season), _c(episode)
    return F.when(s.isNull() | e.isNull(), t).otherwise(F.format_string("%s S%02d E%02d", t, s, e))


def safe_number(x: Column | str, default: float = 0.0) -> Column:
    """A string as a number, or the default."""
    return F.coalesce(_c(x).try_cast("double"), F.lit(default))


def linspace(lo: Column, hi: Column, n: int) -> Column:
    """n evenly spaced values from lo to hi; their middle if n is 1."""
    if n == 1:
        return F.array((lo + hi) / 2)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo + (hi - lo) * i / (n - 1))


def strict_seconds(x: Column | str) -> Column:
    """A string as seconds; an error that names what can't be read. Null stays null."""
    x = _c(x)
    return F.when(x.isNotNull(), F.coalesce(x.try_cast("double"), F.raise_error(F.concat(F.lit("not a time: "), x.cast("string"))).cast("double")))
