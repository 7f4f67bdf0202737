"""Reading one time text into all the moments it can denote (JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Offsets in minutes of the zone abbreviations that are read.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "CET": 60, "CEST": 120, "EST": -300,
    "EDT": -240, "PST": -480, "PDT": -420, "JST": 540,
}
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
#: 2020-01-01 up to, not including, 2031-01-01.
FIRST_MS, END_MS = 1_577_836_800_000, 1_924_992_000_000

_ZONE = r"(Z|z|[A-Za-z]{3,4}|[+-]\d{2}(?::?\d{2})?)?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
#: name, pattern, canonical form: year|month|day|hour|minute|second|fraction|half|zone
FORMS = (
    ("iso", rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})[Tt ]{_CLOCK}\s?{_ZONE}(?:\[[^\]]*\])?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt ]?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("slash", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),?\s+{_CLOCK}(?:\s?([AaPp])\.?[Mm]\.?)?\s?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("dotted", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),?\s+{_CLOCK}\s?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    ("clf", rf"^(\d{{1,2}})/([A-Za-z]{{3}})/(\d{{4}}):{_CLOCK}\s?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    ("mail", rf"^(?:[A-Za-z]{{3}},\s*)?(\d{{1,2}})\s([A-Za-z]{{3}})\s(\d{{4}})\s{_CLOCK}\s?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    ("ctime", rf"^[A-Za-z]{{3}}\s([A-Za-z]{{3}})\s+(\d{{1,2}})\s{_CLOCK}\s(?:{_ZONE}\s)?(\d{{4}})$", "$8|$1|$2|$3|$4|$5|$6||$7"),
)


def trimmed(c: Column) -> Column:
    """Without surrounding white space, inner runs and odd blanks as one blank."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def form_of(t: Column) -> Column:
    """The one form of ``FORMS`` a trimmed text can have, by where its separators stand;
    whether it does is for that form's pattern to say."""
    letter = lambda i: F.upper(F.substring(t, i, 1)) != F.lower(F.substring(t, i, 1))
    early = lambda mark: F.instr(t, mark).isin(2, 3)
    return (
        F.when(F.substring(t, 5, 1) == "-", "iso")
        .when(letter(1), F.when(F.substring(t, 4, 1) == ",", "mail").otherwise("ctime"))
        .when(early("/"), F.when(letter(3) | letter(4), "clf").otherwise("slash"))
        .when(early("."), "dotted")
        .when(early(" "), "mail")
        .otherwise("compact")
    )


def epoch_ms(ntz: Column) -> Column:
    """Epoch milliseconds of a zone-less UTC time, whatever the session's zone."""
    days = F.datediff(F.to_date(ntz), F.lit("1970-01-01").cast("date")).cast("long")
    return ((days * 24 + F.hour(ntz)) * 60 + F.minute(ntz)) * 60_000 + F.floor(F.second(ntz)) * 1000


def _number(parts: Column) -> Column:
    """Two-digit text or month name as an int; null for anything else."""
    named = F.instr(F.lit(MONTHS), F.lower(parts))
    return F.when(parts.rlike(r"^\d+$"), parts.try_cast("int")).when(
        (F.length(parts) == 3) & (named > 0) & ((named - 1) % 3 == 0), ((named + 2) / 3).cast("int")
    )


def _apart(parts: Column) -> Column:
    """The same list, by a lambda: a projection that holds one is compiled as small
    methods of its own.  Fused with its neighbours these expressions make one method of
    more than 8,000 bytecodes, and the JVM leaves methods that long to its interpreter."""
    return F.transform(parts, lambda x: x)


def _by_zone(shift, zone: Column, at: Column, zones: list[str]) -> Column:
    """``shift(at, zone)``; a zone given as a literal is resolved once, not for every row."""
    out = shift(at, zone)
    for z in zones[:64]:
        out = F.when(zone == z, shift(at, F.lit(z))).otherwise(out)
    return out


def with_readings(df: DataFrame, text: str, zone: Column, order: Column, off_rule: float, out: str = "readings", zones: list[str] = []) -> DataFrame:  # noqa: B006
    """Add ``out``, all moments ``text`` can denote, as ``array<struct<fmt, ms, cost>>``.

    ``zone`` (an IANA name, not null) is the clock a text without zone is local
    to, ``order`` (dmy or mdy) that clock's slash dates.  A reading that follows
    them costs 0; the other slash order and the second pass of a repeated hour
    are readings too, at ``off_rule`` each.  A skipped local time is read with the
    offset in force before the skip.  Numbers count from 1970 in the unit whose
    size puts them into 2020-2030 (``zones`` may list the names ``zone`` takes: each is
    then looked up once instead of once a row); with a fraction they are seconds.  Digits finer
    than a millisecond are cut off.  Null, blank and unreadable texts and moments
    outside the range give an empty array.

    The steps are separate projections on purpose: each is used more than once,
    so the optimizer keeps them apart and every pattern runs once a row.
    """
    df = df.withColumn("_t", trimmed(F.col(text))).withColumn("_k", form_of(F.col("_t")))
    canonical = F.lit(None).cast("string")
    for name, pattern, to in FORMS:
        canonical = F.when(F.col("_k") == name, F.regexp_replace("_t", pattern, f"{name}|{to}")).otherwise(canonical)
    df = df.withColumn("_c", canonical)
    # a text its pattern does not match comes back unchanged
    df = df.withColumn("_p", F.when(F.col("_c") != F.col("_t"), F.split("_c", r"\|")))
    number = (F.col("_k") == "compact") & F.col("_p").isNull()
    df = df.withColumn("_n", F.when(number & F.col("_t").rlike(r"^\d{10,19}$"), F.col("_t").try_cast("long")))
    part = lambda i: F.try_element_at("_p", F.lit(i + 2))
    half, hour = F.lower(part(7)), part(3).try_cast("int")
    fixed = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    z = F.upper(part(8))
    df = df.withColumns(
        {
            "_q": _apart(F.col("_p")),
            "_form": F.get("_p", F.lit(0)),
            "_y": part(0).try_cast("int"),
            "_a": _number(part(1)),
            "_b": _number(part(2)),
            "_h": F.when(half == "", hour)
            .when((hour < 1) | (hour > 12), F.lit(None).cast("int"))
            .otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0)),
            "_m": part(4).try_cast("int"),
            "_s": F.when(part(5) == "", F.lit(0)).otherwise(part(5).try_cast("int")),
            "_f": F.rpad(F.substring(part(6), 1, 3), 3, "0").try_cast("long"),
            "_local": z == "",
            "_shift": F.when(
                z.rlike(r"^[+-]"),
                F.when(z.startswith("-"), -1).otherwise(1)
                * (F.substring(z, 2, 2).try_cast("int") * 60 + F.coalesce(F.substring(F.regexp_replace(z, ":", ""), 4, 2).try_cast("int"), F.lit(0))),
            ).otherwise(F.try_element_at(fixed, z)),
            "_zone_of": zone,
            "_dmy": F.coalesce(order, F.lit("dmy")) != "mdy",
        }
    )
    slash = F.col("_form") == "slash"
    wall = lambda month, day: F.try_make_timestamp_ntz("_y", month, day, "_h", "_m", F.col("_s").cast("decimal(16,6)"))
    # a, b: month and day; of a slash date its first and second number
    df = df.withColumns({"_w1": wall(F.col("_a"), F.col("_b")), "_w2": F.when(slash, wall(F.col("_b"), F.col("_a")))})
    # wall clocks and moments as plain milliseconds from here on
    df = df.withColumns({f"_e{k}": epoch_ms(F.col(f"_w{k}")) for k in (1, 2)})
    shifted = lambda by, ms: _by_zone(by, F.col("_zone_of"), F.timestamp_millis(ms), zones)
    df = df.withColumns({f"_u{k}": F.when(F.col("_local"), F.unix_millis(shifted(F.to_utc_timestamp, F.col(f"_e{k}")))) for k in (1, 2)} | {"_r": _apart(F.col("_q"))})

    def entry(fmt: Column | str, ms: Column, cost: Column | float) -> Column:
        fmt = F.lit(fmt) if isinstance(fmt, str) else fmt
        cost = F.lit(float(cost)) if isinstance(cost, (int, float)) else cost
        return F.struct(fmt.alias("fmt"), F.when((ms >= FIRST_MS) & (ms < END_MS), ms).alias("ms"), cost.alias("cost"))

    def passes(k: int, fmt: Column, cost: Column) -> list[Column]:
        wall_k, utc, again = F.col(f"_e{k}"), F.col(f"_u{k}"), F.col(f"_u{k}") + 3_600_000
        first = F.when(F.col("_local"), utc).when(F.col("_shift").isNotNull(), wall_k - F.col("_shift").cast("long") * 60_000)
        second = F.when(F.unix_millis(shifted(F.from_utc_timestamp, again)) == wall_k, again)
        return [entry(fmt, first + F.col("_f"), cost), entry(fmt, second + F.col("_f"), cost + F.lit(float(off_rule)))]

    t = F.col("_t")
    value = F.col("_n")
    frac = F.when(
        F.col("_n").isNull() & t.rlike(r"^\d{9,11}\.\d+$"),
        F.substring_index(t, ".", 1).try_cast("long") * 1000 + F.rpad(F.substring(F.substring_index(t, ".", -1), 1, 3), 3, "0").try_cast("long"),
    )
    numeric = [  # one at most is in the range: the units' ranges are disjoint
        entry("num_s", F.when(F.length(t) <= 11, value * 1000), 0),
        entry("num_ms", value, 0),
        entry("num_us", F.expr("_n div 1000"), 0),
        entry("num_ns", F.expr("_n div 1000000"), 0),
        entry("num_frac", frac, 0),
    ]
    rule, other = F.lit(0.0), F.lit(float(off_rule))
    one = passes(1, F.when(slash, F.lit("slash_mdy")).otherwise(F.col("_form")), F.when(slash & F.col("_dmy"), other).otherwise(rule))
    two = passes(2, F.lit("slash_dmy"), F.when(F.col("_dmy"), rule).otherwise(other))
    every = F.when(F.col("_r").isNull(), F.array(*numeric)).otherwise(
        F.when(F.col("_dmy"), F.array(*two, *one)).otherwise(F.array(*one, *two))
    )
    df = df.withColumns({"_every": every, "_last": _apart(F.col("_r"))})
    # both are named twice, so neither moves into the filter, whose input no compiler sees
    there = (F.size("_every") >= 0) & (F.size(F.coalesce("_last", F.array().cast("array<string>"))) >= 0)
    df = df.withColumn(out, F.when(there, F.filter("_every", lambda c: c["ms"].isNotNull())))
    return df.drop("_q", "_r", "_every", "_last", "_t", "_k", "_c", "_n", "_p", "_form", "_y", "_a", "_b", "_h", "_m", "_s", "_f", "_local", "_shift", "_zone_of", "_dmy", "_w1", "_w2", "_e1", "_e2", "_u1", "_u2")
