"""Scalar functions: time formats, slugs, punctuation classes, clamps and plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The three punctuation classes of the recordings' texts.
FILLER_PUNCTUATION = "[，。！？、：；]"
PHRASE_PUNCTUATION = r"[，。！？、：；\"'（）\s]"
RESTART_PUNCTUATION = "[，。！？、]"


def strip_class(text: Column, punctuation: str = FILLER_PUNCTUATION) -> Column:
    """P2."""
    return F.regexp_replace(text, punctuation, "")


def strip_ends(text: Column, punctuation: str = PHRASE_PUNCTUATION) -> Column:
    """Punctuation at both ends only."""
    return F.regexp_replace(F.regexp_replace(text, f"^{punctuation}+", ""), f"{punctuation}+$", "")


def normalise(text: Column) -> Column:
    """No white space, no punctuation."""
    return F.regexp_replace(text, r"[\s\p{P}]+", "")


def slug(text: Column) -> Column:
    """P14."""
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


def has_repeat(text: Column, longest: int = 3) -> Column:
    """One to ``longest`` characters said twice in a row."""
    return text.rlike(rf"(.{{1,{longest}}})\1")


def clock(ms: Column) -> Column:
    """M:SS, or H:MM:SS from an hour on."""
    s = F.floor(ms / 1000)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s % 60))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(s % 60)))


def shifted(ms: Column, offset: Column) -> Column:
    """A time moved by an offset, not before 0."""
    return F.greatest(F.lit(0), ms + offset)


def ramp(n: Column, base: int = 5000, step: int = 1000, top: int = 9500) -> Column:
    """Confidence in basis points."""
    return F.least(base + step * n, F.lit(top))


def fade_ms(duration: Column) -> Column:
    """None under .3 s, else 8 % between 30 and 300 ms, and no more than 30 % of the segment."""
    return F.when(duration < 300, 0).otherwise(F.least(F.greatest(F.floor(duration * 8 / 100), F.lit(30)), F.lit(300), F.floor(duration * 3 / 10))).cast("bigint")


def sample_times(duration: Column, steps: int = 6) -> Column:
    """N + 1 evenly spaced times in the middle 80 % of a recording."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.floor(duration / 10) + F.floor(duration * 8 * i / (10 * steps)))
