"""Scalar rules of media timelines, as Column expressions.

Three roundings are kept apart: ``half_up`` for frame indices, ``half_even`` for estimates of counts and
``truncated`` for byte estimates.  Text that cannot be read becomes null, never an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frame sizes by name.
RESOLUTIONS = {"480p": (854, 480), "720p": (1280, 720), "1080p": (1920, 1080), "1440p": (2560, 1440), "2160p": (3840, 2160), "4k": (3840, 2160)}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row and named once in the plan, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("long")


def half_even(x: Column) -> Column:
    return F.rint(x).cast("long")


def truncated(x: Column) -> Column:
    return x.cast("long")


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, low if isinstance(low, Column) else F.lit(low)), high if isinstance(high, Column) else F.lit(high))


def positive(x: Column) -> Column:
    """Null unless above zero: zero counts as missing."""
    return F.when(x > 0, x)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two positive longs (40 steps reach beyond any frame rate's size)."""
    step = lambda p, _: F.struct(
        p["b"].alias("a"), F.when(p["b"] == 0, F.lit(0).cast("long")).otherwise(F.try_mod(p["a"], p["b"])).alias("b")
    )
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(40)),
        start,
        lambda p, k: F.when(p["b"] == 0, p).otherwise(step(p, k)),
        lambda p: p["a"],
    )


#: Largest denominator of a rate that is given as a decimal.
MAX_DENOMINATOR = 100_000


def nearest_fraction(x: Column, limit: int = MAX_DENOMINATOR) -> Column:
    """The fraction nearest to a positive decimal of nine places at most, as struct(num, den), den <= ``limit``.

    Continued fraction in whole numbers: convergents until the denominator passes the limit, then the better of the
    last convergent and the last mediant before the limit.
    """
    scale = 1_000_000_000
    long = lambda c: c.cast("long")
    names = ("p0", "q0", "p1", "q1", "n", "d")
    pack = lambda *values: F.struct(*(long(v).alias(k) for k, v in zip(names, values)))
    start = pack(F.lit(0), F.lit(1), F.lit(1), F.lit(0), x.cast("decimal(38,9)") * scale, F.lit(scale))

    def step(s: Column, _: Column) -> Column:
        whole = F.floor(F.try_divide(s["n"].cast("decimal(38,0)"), s["d"]))
        more = (s["d"] > 0) & (s["q0"] + whole * s["q1"] <= limit)
        grown = pack(
            s["p1"], s["q1"], s["p0"] + whole * s["p1"], s["q0"] + whole * s["q1"], s["d"], s["n"] - whole * s["d"]
        )
        return F.when(more, grown).otherwise(s)

    def best(s: Column) -> Column:
        k = F.floor((limit - s["q0"]) / F.greatest(s["q1"], F.lit(1)))
        p, q = s["p0"] + k * s["p1"], s["q0"] + k * s["q1"]
        far = lambda a, b: F.abs(F.try_divide(a, b) - x.cast("double"))
        last = (s["d"] == 0) | (far(s["p1"], s["q1"]) <= far(p, q))
        return F.struct(
            F.when(last, s["p1"]).otherwise(long(p)).alias("num"), F.when(last, s["q1"]).otherwise(long(q)).alias("den")
        )

    return F.when(x > 0, F.aggregate(F.sequence(F.lit(1), F.lit(24)), start, step, best))


def rational(text: Column) -> Column:
    """"n/d", a whole number or a decimal as a reduced struct(num, den); null for anything else, zero parts included."""
    parts = F.split(F.trim(text), "/")
    num = F.get(parts, 0).try_cast("long")
    den = F.when(F.size(parts) == 1, F.lit(1).cast("long")).otherwise(F.get(parts, 1).try_cast("long"))
    sure = (F.size(parts) <= 2) & (num > 0) & (den > 0)
    divisor = gcd(num, den)
    decimal = F.when((F.size(parts) == 1) & F.get(parts, 0).contains("."), F.get(parts, 0).try_cast("decimal(38,9)"))
    return F.when(decimal.isNotNull(), nearest_fraction(decimal)).when(
        sure, F.struct((num / divisor).cast("long").alias("num"), (den / divisor).cast("long").alias("den"))
    )


def total_frames(num: Column, den: Column, seconds: Column) -> Column:
    return half_up(num.cast("double") / den * seconds)


def drops_frames(num: Column, den: Column) -> Column:
    return (den == 1001) & (num % 1000 == 0)


def target_multiplier(num: Column, den: Column, target: Column, multiplier: Column) -> Column:
    """How often each source frame is shown: what is asked for, else the nearest to the target rate, 1 at least."""
    return F.greatest(F.lit(1).cast("long"), F.coalesce(multiplier.cast("long"), half_even(target / (num.cast("double") / den))))


def clock_seconds(text: Column) -> Column:
    """Seconds of "s", "m:s" or "h:m:s"."""
    parts = F.split(text, ":")
    at = lambda k: F.element_at(parts, k).try_cast("double")
    return (
        F.when(F.size(parts) == 1, at(1))
        .when(F.size(parts) == 2, at(1) * 60 + at(2))
        .when(F.size(parts) == 3, at(1) * 3600 + at(2) * 60 + at(3))
    )


def scene_threshold(x: Column) -> Column:
    """Thresholds up to 1 are of the old scale."""
    return F.when(x <= 1, clamp(x, 0.0, 1.0) * 67.5).otherwise(F.greatest(x, F.lit(0.0)))


def frame_name(index: Column, suffix: str = "png") -> Column:
    return F.concat(F.lpad(index.cast("string"), 8, "0"), F.lit(f".{suffix}"))


def progress_text(done: Column, total: Column) -> Column:
    return F.when(
        total > 0,
        F.concat(F.least(F.greatest(done, F.lit(0)), total).cast("string"), F.lit("/"), total.cast("string")),
    ).otherwise(F.lit("--"))


def elapsed_text(seconds: Column) -> Column:
    s = seconds.cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s % 3600 / 60)), two(s % 60))


def flags_text(**flags: Column) -> Column:
    """Names of the set flags joined by "+", or "0"."""
    names = F.array(*(F.when(v, F.lit(k)) for k, v in flags.items()))
    return F.coalesce(F.nullif(F.array_join(names, "+"), F.lit("")), F.lit("0"))


def number_without_unit(text: Column) -> Column:
    """A number before trailing letters of "kbits/s" (a set of characters, not a suffix)."""
    return F.trim(F.regexp_replace(F.trim(text), "[kbits/]+$", "")).try_cast("double")


def vendor(adapter: Column) -> Column:
    name = F.lower(adapter)
    has = lambda *w: [name.contains(x) for x in w]
    nvidia, intel = has("nvidia", "intel")
    amd = has("amd", "ati", "radeon")
    return F.when(nvidia, "nvidia").when(intel, "intel").when(amd[0] | amd[1] | amd[2], "amd").otherwise("unknown")


def encoder_family(name: Column) -> Column:
    return F.when(name.rlike("^lib"), "software").otherwise(F.nullif(F.regexp_extract(name, "_([a-z0-9]+)$", 1), F.lit("")))


def stage_label(name: Column) -> Column:
    return F.initcap(F.replace(F.regexp_replace(name, r"^\d+_", ""), F.lit("_"), F.lit(" ")))


def tile_bucket(height: Column) -> Column:
    return (F.floor(height / 360) * 360).cast("long")


def resolution(name: Column) -> Column:
    """struct(width, height) of a named size; null for unknown names."""
    found = F.lit(None).cast("struct<width:int,height:int>")
    for k, (w, h) in RESOLUTIONS.items():
        found = F.when(F.lower(name) == k, F.struct(F.lit(w).alias("width"), F.lit(h).alias("height"))).otherwise(found)
    return found


def loose_number(text: Column) -> Column:
    """A number, or null for anything else ("N/A", empty)."""
    return F.trim(text).try_cast("double")


def loose_flag(text: Column) -> Column:
    """A flag from "1", "true", "True", "yes", or a number that is not zero; null counts as unset."""
    t = F.trim(text)
    return F.coalesce(t.isin("1", "true", "True", "yes") | (t.try_cast("double") != 0), F.lit(False))


def bytes_text(size: Column) -> Column:
    """Sizes in the largest unit that gives one or more, with one decimal beyond bytes."""
    unit = lambda power, name: F.format_string(f"%.1f {name}", size / 1024.0**power)
    return (
        F.when(size >= 1024**3, unit(3, "GiB"))
        .when(size >= 1024**2, unit(2, "MiB"))
        .when(size >= 1024, unit(1, "KiB"))
        .otherwise(F.concat(size.cast("string"), F.lit(" B")))
    )


#: Device generations by compute capability.
GENERATIONS = {"6.1": "pascal", "7.5": "turing", "8.6": "ampere", "8.9": "ada", "12.0": "blackwell"}


def generation(capability: Column) -> Column:
    found = F.lit("unknown")
    for k, name in GENERATIONS.items():
        found = F.when(capability == k, name).otherwise(found)
    return found


def output_rate(text: Column) -> Column:
    """struct(num, den) of "n/d", else of a decimal in thousandths; 24000/1001 where nothing is given."""
    t = F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("24000/1001"))
    parts = F.split(t, "/")
    whole = F.struct(F.get(parts, 0).try_cast("long").alias("num"), F.get(parts, 1).try_cast("long").alias("den"))
    decimal = F.struct(half_even(t.try_cast("double") * 1000).alias("num"), F.lit(1000).cast("long").alias("den"))
    return F.when(F.size(parts) == 2, whole).otherwise(decimal)


def epoch_seconds(text: Column) -> Column:
    """Seconds since 1970 of an ISO time in UTC, null for anything else."""
    return F.unix_timestamp(F.try_to_timestamp(text))


# Rate controls that a name of the preset editor stands for, by family of encoders.
RATE_CONTROLS = {
    "amf": {"cqp": ("cqp", "constqp", "qp"), "vbr": ("vbr_peak", "vbr_latency"), "cbr": ("cbr",)},
    "nvenc": {"cqp": ("constqp",), "vbr": ("vbr",), "cbr": ("cbr",)},
}


def rate_control_matches(wanted: Column, family: Column, rc: Column) -> Column:
    """Whether a rate control is the one that an editor's name stands for.

    A name without an entry stands for itself; other families match nothing.
    """
    key, cur, out = F.lower(wanted), F.lower(rc), F.lit(False)
    for name, controls in RATE_CONTROLS.items():
        own = key == cur
        for k, values in controls.items():
            own = F.when(key == k, cur.isin(*values)).otherwise(own)
        out = F.when(family == name, own).otherwise(out)
    return F.coalesce(out, F.lit(False))


#: A date of eight digits that is no part of a longer word.
DATE_TAG = r"(?<![\p{L}\p{N}_])(20[0-9]{6})(?![\p{L}\p{N}_])"


def plausible_date(tag: Column) -> Column:
    """Whether eight digits are a day from 2018 to 2099."""
    day = F.try_to_timestamp(tag, F.lit("yyyyMMdd"))
    return tag.rlike("^[0-9]{8}$") & day.isNotNull() & F.coalesce(F.year(day).between(2018, 2099), F.lit(False))


def first_date_tag(blobs: Column, prefer: Column) -> Column:
    """The first plausible date in an array of texts; ``prefer`` wins if it is plausible and stands in any of them."""
    known = F.filter(blobs, lambda b: b.isNotNull())
    wins = F.coalesce(plausible_date(prefer), F.lit(False)) & F.exists(known, lambda b: F.contains(b, prefer))
    tags = F.flatten(F.transform(known, lambda b: F.regexp_extract_all(b, F.lit(DATE_TAG), F.lit(1))))
    return F.when(wins, prefer).otherwise(F.get(F.filter(tags, plausible_date), F.lit(0)))
