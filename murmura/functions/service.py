"""Rules of the service as Column expressions: parameters, predicates, verdicts, messages, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The modes and back ends a session may ask for, the most speakers of a session.
MODES = ["auto", "fixed"]
BACKENDS = ["sortformer", "auto", "embedding"]
MOST_SPEAKERS = 8


# --- session parameters ---------------------------------------------------------------


def speaker_count(asked: Column, default: int = 0) -> Column:
    """A count as a whole number of 0 or more; anything that is no number reads as the default."""
    return F.greatest(F.lit(0), F.coalesce(F.trim(asked).try_cast("int"), F.lit(default)))


def speaker_mode(asked: Column, expected: Column) -> Column:
    """``fixed`` only if asked for with a count, else ``auto``."""
    mode = F.lower(F.trim(F.coalesce(asked, F.lit(""))))
    return F.when((mode == "fixed") & (expected > 0), "fixed").otherwise("auto")


def speaker_cap(expected: Column, most: int = MOST_SPEAKERS) -> Column:
    """The expected speakers, if any are expected, but no more than ``most``."""
    return F.least(F.when(expected > 0, expected).otherwise(most), F.lit(most))


def backend(asked: Column) -> Column:
    name = F.lower(F.trim(F.coalesce(asked, F.lit(""))))
    return F.when(name.isin(*BACKENDS), name).otherwise("embedding")


# --- predicates -----------------------------------------------------------------------


def is_rate_limit(error: Column) -> Column:
    return F.coalesce(F.contains(error, F.lit("429")) | F.contains(error, F.lit("RESOURCE_EXHAUSTED")), F.lit(False))


def is_clean(margin: Column, best: Column, least_margin: float, most: float) -> Column:
    """Whether a window is clearly nearest to one speaker, and near enough."""
    return (margin >= least_margin) & (best <= most)


def embeddable(duration: Column, embedding: Column, least: float = 0.9) -> Column:
    """The embedding, or null where too little sound stands behind it."""
    return F.when(duration >= least, embedding)


def may_sign_in(organization_status: Column, user_status: Column) -> Column:
    """The reason for a refusal, or ``accept``; a suspended organisation's users may sign in."""
    return F.when(organization_status.isNull() | (organization_status == "closed"), "organization_closed").when(F.coalesce(user_status, F.lit("")) != "active", "user_inactive").otherwise("accept")


# --- numbers --------------------------------------------------------------------------


def share(part: Column, whole: Column) -> Column:
    """A ratio that is 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def percent(value: Column) -> Column:
    """A share as whole percent; halves go to the even number."""
    return F.concat(F.rint(value * 100).cast("long"), F.lit("%"))


def bar(n: Column, total: Column, width: int = 24) -> Column:
    """A bar as long as the share of ``total``."""
    return F.repeat(F.lit("█"), F.rint(share(n * width, total)).cast("int"))


def level(power: Column) -> Column:
    """A level meter's percent of mean power."""
    return F.least(F.lit(100), F.rint(F.sqrt(power) * 260).cast("int"))


def backoff(attempt: Column, most: float = 8.0) -> Column:
    """The longest wait before an attempt; the wait itself is drawn between 0 and this."""
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(most))


def cooldown(failures: Column, most: float = 30.0) -> Column:
    return F.when(failures > 0, F.least(F.pow(F.lit(2.0), failures - 1) * 2, F.lit(most))).otherwise(0.0)


def real_time(seconds_of_work: Column, seconds_of_sound: Column) -> Column:
    """How many seconds of work a second of sound takes."""
    return share(seconds_of_work, seconds_of_sound)


# --- identifiers and messages ---------------------------------------------------------


def make_id(prefix: Column, at_ms: Column, random: Column) -> Column:
    """``prefix_milliseconds_hex``: identifiers of one prefix sort by time."""
    return F.concat_ws("_", prefix, F.lpad(at_ms.cast("string"), 13, "0"), random)


def id_parts(identifier: Column) -> dict[str, Column]:
    """What ``make_id`` has put together: prefix, time in milliseconds and the rest; null where it is no such identifier."""
    pattern = r"^(.+)_(\d{13})_([0-9a-f]+)$"
    ok = identifier.rlike(pattern)
    part = lambda k: F.when(ok, F.regexp_extract(identifier, pattern, k))
    return {"prefix": part(1), "at_ms": part(2).cast("long"), "random": part(3)}


def message(kind: str, **fields: Column) -> Column:
    """A message as JSON, its type first; null fields are left out."""
    return F.to_json(F.struct(F.lit(kind).alias("type"), *(c.alias(k) for k, c in fields.items())))


def word_timings(json: Column, offset: Column) -> Column:
    """Word timings from JSON, as (text, start, end) on the session's clock; words without both times are left out."""
    words = F.from_json(json, "array<struct<text:string,start_offset:string,end_offset:string>>")
    number = lambda c: F.regexp_replace(F.trim(c), "s$", "").try_cast("double")
    timed = F.transform(words, lambda w: F.struct(w["text"].alias("text"), (number(w["start_offset"]) + offset).alias("start"), (number(w["end_offset"]) + offset).alias("end")))
    return F.filter(timed, lambda w: w["start"].isNotNull() & w["end"].isNotNull())
