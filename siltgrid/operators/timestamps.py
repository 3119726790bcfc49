"""Mixed timestamp texts to UTC instants.

Every text is brought by its layout to calendar parts, and each valid reading of the parts is a candidate: a slashed
date may put the day or the month first, a serial day number may count from either of two day-ones. Expectation-
maximisation over the mixture of readings of each source (writer) and family weighs candidates by how well they fall into the
observation window of the record's stack, beside a component of junk that fits nothing. Conventions that are known of a
source enter as a prior of PSEUDO values, which the source's own values outweigh. A reading that a source hardly ever uses (weight
under `least`) is no candidate: a text that is impossible in every reading of its source names no real time. Posteriors over the
others choose; values whose best posterior stays under `sure` while another valid reading differs, and texts that only an
unused reading makes possible, are marked 'ambiguous' with the other instant beside them.

Zones: a zone or offset in the text holds first, then the record's zone name, then the site's; serial numbers and counts
since 1970 are UTC. A local time that occurs twice is the earlier instant, one that is skipped counts with the
offset before the change.

Defined cases: null, empty and junk texts, impossible dates and hours, unknown zones in a text give no instant (status
'none'); an unknown zone name of a record is as if it were missing, and without any zone a local time gives none;
blanks around a text mean nothing; records of unknown stacks have no window, so only mixture weights decide.
"""

from __future__ import annotations

import zoneinfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltgrid.session import stored

#: Usual offsets of zone abbreviations in minutes.
ABBREVIATIONS = {"Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "CET": 60, "CEST": 120, "EST": -300, "EDT": -240, "JST": 540}
#: Month names.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: Number of 1970-01-01 when 0000-01-01 is day 1, and when 0001-01-01 is.
EPOCH_YEAR_0, EPOCH_YEAR_1 = 719529, 719163
#: Usual reading of each family, and sources known to differ; a prior and no rule.
CONVENTIONS = {"slashed": ("dmy", {}), "serial": ("year0", {})}
#: Values that a known convention counts for, its share of them and that of the other reading; what is left is junk, whose fit is JUNK.
PSEUDO, KNOWN, OTHER, JUNK = 10.0, 0.98, 0.015, 0.001
READINGS = {"slashed": ("dmy", "mdy"), "serial": ("year0", "year1")}

_ZONE = r"\s*(Z|[A-Z]{2,4}|[+-]\d{2}(?::?\d{2})?|[A-Za-z]+(?:/[A-Za-z_+-]+)+)?$"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
#: Layout: pattern, and where y|month|day|hour|minute|second|fraction|half|zone|day of year come from.
LAYOUTS = {
    "iso": (r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ]" + _TIME + r")?" + _ZONE, "$1|$2|$3|$4|$5|$6|$7||$8|"),
    "ordinal": (r"^(\d{4})-(\d{3})(?:[T ]" + _TIME + r")?" + _ZONE, "$1|||$3|$4|$5|$6||$7|$2"),
    "compact": (r"^(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(\d{2})(?:[.,](\d{1,9}))?)?" + _ZONE, "$1|$2|$3|$4|$5|$6|$7||$8|"),
    "slashed": (r"^(\d{1,2})/(\d{1,2})/(\d{4})(?:[T ]" + _TIME + r"\s?([AaPp][Mm])?)?" + _ZONE, "$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
    "named": (r"^(\d{1,2})[- ]([A-Za-z]{3})[a-z]*[- ](\d{4})(?:[T ]" + _TIME + r")?" + _ZONE, "$3|$2|$1|$4|$5|$6|$7||$8|"),
    "mail": (r"^[A-Za-z]{3}, (\d{1,2}) ([A-Za-z]{3}) (\d{4}) " + _TIME + _ZONE, "$3|$2|$1|$4|$5|$6|$7||$8|"),
    "spoken": (r"^([A-Za-z]{3})[a-z]* (\d{1,2}), (\d{4})(?: " + _TIME + r"\s?([AaPp][Mm])?)?" + _ZONE, "$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
    "number": (r"^(\d{5,7}|\d{9,17})(?:\.(\d{1,18}))?$", "$1||||||$2|||"),
}


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days from 1970-01-01 of a proleptic Gregorian date, in plain integer arithmetic that never raises."""
    y2 = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(y2 / 400)
    yoe = y2 - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return era * 146097 + doe - 719468


def _month_length(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _zones() -> list[str]:
    return sorted(zoneinfo.available_timezones())


def _offset_minutes(zone: Column) -> Column:
    """Fixed offset of an abbreviation or of +hh, +hhmm, +hh:mm; null for anything else."""
    out = F.when(
        zone.rlike(r"^[+-]\d{2}(:?\d{2})?$"),
        F.when(zone.startswith("-"), -1).otherwise(1) * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.coalesce(F.regexp_extract(zone, r"^[+-]\d{2}:?(\d{2})$", 1).try_cast("int"), F.lit(0))),
    )
    for name, minutes in ABBREVIATIONS.items():
        out = out.when(zone == name, F.lit(minutes))
    return out


def _settled(df: DataFrame) -> DataFrame:
    """df with its columns computed once: the optimiser would otherwise copy the expressions below into each use above."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def candidates(df: DataFrame, text: str, writer: str, zone_name: str, site_zone: str, keep: list[str]) -> DataFrame:
    """A row per text with its layout and up to two candidate instants (micros; null where invalid)."""
    t = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    layout = F.lit(None).cast("string")
    for name, (pattern, _) in reversed(LAYOUTS.items()):
        layout = F.when(t.rlike(pattern), F.lit(name)).otherwise(layout)
    parts = F.lit(None).cast("string")
    for name, (pattern, to) in LAYOUTS.items():
        parts = F.when(F.col("layout") == name, F.regexp_replace(t, pattern, to)).otherwise(parts)
    rows = _settled(_settled(df.withColumn("layout", layout)).withColumn("parts", F.split(parts, r"\|")))
    p = [F.col("parts")[k] for k in range(10)]
    number = lambda c: c.try_cast("int")
    name = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(p[1], 1, 3))).try_cast("int")
    hour, half = F.coalesce(number(p[3]), F.lit(0)), F.lower(p[7])
    clock = (hour <= 23) & ((half == "") | hour.between(1, 12)) & (F.coalesce(number(p[4]), F.lit(0)) <= 59) & (F.coalesce(number(p[5]), F.lit(0)) <= 59)
    hour = F.when(half == "am", hour % 12).when(half == "pm", hour % 12 + 12).otherwise(hour)
    fraction = F.rpad(F.substring(p[6], 1, 6), 6, "0").try_cast("long")
    of_day = (hour.cast("long") * 3600 + F.coalesce(number(p[4]), F.lit(0)) * 60 + F.coalesce(number(p[5]), F.lit(0))) * 1000000 + F.coalesce(fraction, F.lit(0))
    rows = rows.select(
        *keep, F.col(writer).alias("_writer"), "layout", p[0].alias("_head"), p[6].alias("_tail"), p[8].alias("_zone"),
        F.col(zone_name).alias("_zone_name"), F.col(site_zone).alias("_site_zone"),
        number(p[0]).alias("_y"),
        F.when(F.col("layout").isin("named", "mail", "spoken"), name).otherwise(number(p[1])).alias("_m"),
        number(p[2]).alias("_d"), number(p[9]).alias("_doy"), clock.alias("_clock"), of_day.alias("_of_day"),
    )
    rows = _settled(rows)
    y, m, d, doy = (F.col(c) for c in ("_y", "_m", "_d", "_doy"))
    real = lambda y, m, d: (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= _month_length(y, m))
    first = F.when(F.col("layout") == "ordinal", F.when((y >= 1) & (doy >= 1) & (doy <= 337 + _month_length(y, F.lit(2))), _days(y, F.lit(1), F.lit(1)) + doy - 1))
    first = first.when(F.col("layout") == "slashed", F.when(real(y, d, m), _days(y, d, m)))  # the first number is the day
    first = first.when(F.col("layout") != "number", F.when(real(y, m, d), _days(y, m, d)))
    second = F.when((F.col("layout") == "slashed") & real(y, m, d), _days(y, m, d))
    local = lambda day: F.when(F.col("_clock"), day.cast("long") * 86400000000 + F.col("_of_day"))
    rows = rows.withColumn("_local1", local(first)).withColumn("_local2", local(second))
    known = ", ".join(f"'{z}'" for z in _zones())  # names of the time-zone database, a set of fixed size
    usable = lambda c: F.when(F.expr(f"{c} IN ({known})") | _offset_minutes(F.col(c)).isNotNull(), F.col(c))
    zone = F.when(F.col("_zone") != "", usable("_zone")).otherwise(F.coalesce(usable("_zone_name"), usable("_site_zone")))
    rows = _settled(_settled(rows.withColumn("_z", zone)).withColumn("_minutes", _offset_minutes(F.col("_z"))))

    def instant(local: str) -> Column:
        region = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(F.col(local)), F.coalesce(F.col("_z"), F.lit("UTC"))))
        return F.when(F.col("_minutes").isNotNull(), F.col(local) - F.col("_minutes").cast("long") * 60000000).when(F.col("_z").isNotNull(), region)

    digits, head = F.length("_head"), F.col("_head").try_cast("long")
    tail = F.when(F.col("_tail") != "", F.concat(F.lit("0."), F.substring("_tail", 1, 18)).try_cast("decimal(19,18)"))
    unit = F.when(digits <= 7, F.lit(86400000000)).when(digits <= 11, F.lit(1000000)).when(digits <= 14, F.lit(1000)).otherwise(F.lit(1)).cast("long")
    part = F.coalesce(F.round(tail * unit.cast("decimal(12,0)")).cast("long"), F.lit(0))
    is_number = F.col("layout") == "number"
    serial = is_number & (digits <= 7)
    of_number = F.when(serial, (head - EPOCH_YEAR_0) * unit + part).otherwise(head * unit + part)
    return rows.select(
        *keep, "_writer", "layout",
        F.when(serial, "serial").when(F.col("layout") == "slashed", "slashed").alias("family"),
        F.when(is_number, of_number).otherwise(instant("_local1")).alias("us1"),
        F.when(serial, (head - EPOCH_YEAR_1) * unit + part).otherwise(instant("_local2")).alias("us2"),
    )


def _first_is_usual(conventions: dict, writer: Column) -> Column:
    """Is the first reading of a row's family what is known of its source?"""
    out = F.lit(None).cast("boolean")
    for family, (usual, others) in conventions.items():
        known = F.lit(usual)
        for source, reading in others.items():
            known = F.when(writer == source, F.lit(reading)).otherwise(known)
        out = F.when(F.col("family") == family, known == READINGS[family][0]).otherwise(out)
    return out


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    """Mixture weights of both readings of one source and family by EM; rows are counts of like values."""
    n, fit = group["n"].to_numpy(float), np.c_[group["l1"], group["l2"], np.full(len(group), JUNK)]
    known = [KNOWN, OTHER] if group["first_is_usual"].iloc[0] else [OTHER, KNOWN]
    prior = PSEUDO * np.array([*known, 1 - KNOWN - OTHER])
    w = prior / prior.sum()
    for _ in range(500):
        r = w * fit
        new = prior + (n[:, None] * r / r.sum(1, keepdims=True)).sum(0)
        new /= new.sum()
        done = np.abs(new - w).max() < 1e-9
        w = new
        if done:
            break
    return pd.DataFrame({"_writer": [group["_writer"].iloc[0]], "family": [group["family"].iloc[0]], "w1": [w[0]], "w2": [w[1]]})


def normalise(log: DataFrame, stacks: DataFrame, fields: dict[str, str], sure: float = 0.9, conventions: dict | None = None, least: float = 0.1) -> DataFrame:
    """One row per record and field: layout, chosen reading, utc_us, posterior, status ('ok', 'ambiguous', 'none'), other_us.

    log: rec_id, stack_id, writer, tz_name and the texts. fields: name of the result to the text's column. conventions: like CONVENTIONS.
    Texts are parsed once and stored; values are counted by source, family and likelihood before the mixtures are fitted, so a
    source with a third of all rows is a handful of rows there.
    """
    site = stacks.select("stack_id", "site_tz", "master_day", (F.col("first_day") - F.col("repeat_days")).alias("_from"), (F.col("first_day") + F.col("n_slots") * F.col("repeat_days")).alias("_to")).dropDuplicates(["stack_id"])
    texts = F.explode(F.array(*(F.struct(F.lit(name).alias("field_name"), F.col(c).alias("raw")) for name, c in fields.items())))
    rows = log.select("rec_id", "stack_id", "writer", "tz_name", texts.alias("t")).select("rec_id", "stack_id", "writer", "tz_name", "t.*").join(site, "stack_id", "left")
    rows = _settled(candidates(rows, "raw", "writer", "tz_name", "site_tz", ["rec_id", "field_name", "master_day", "_from", "_to"]))

    def likelihood(us: str) -> Column:
        day = F.floor(F.col(us) / 86400000000) + EPOCH_YEAR_0
        master = (F.col("field_name") == "master_day") & (F.abs(day - F.col("master_day")) <= 1)
        return F.when(F.col(us).isNull(), 0.0).when(master, 1.0).when(day.between(F.col("_from"), F.col("_to")), 0.2).otherwise(0.01)

    rows = rows.withColumn("l1", likelihood("us1")).withColumn("l2", likelihood("us2")).withColumn("_writer", F.coalesce("_writer", F.lit("")))
    rows = stored(rows.select("rec_id", "field_name", "layout", "family", "_writer", "us1", "us2", "l1", "l2"), "instants")
    counts = rows.where(F.col("family").isNotNull() & (F.col("l1") + F.col("l2") > 0)).groupBy("_writer", "family", "l1", "l2").agg(F.count("*").cast("double").alias("n"))
    counts = counts.withColumn("first_is_usual", _first_is_usual(conventions or CONVENTIONS, F.col("_writer")))
    weights = counts.groupBy("_writer", "family").applyInPandas(_fit, "_writer string, family string, w1 double, w2 double")
    rows = rows.join(weights, ["_writer", "family"], "left")
    used = lambda k: F.when(F.col(f"w{k}") >= least, F.col(f"w{k}") * F.col(f"l{k}")).otherwise(0.0)
    rows = _settled(rows.withColumn("_a", used(1)).withColumn("_b", used(2)))
    plain, a, b = F.col("family").isNull(), F.col("_a"), F.col("_b")
    first = plain | (a >= b)
    us = F.when(plain | (first & (a > 0)), F.col("us1")).when(b > a, F.col("us2"))
    best = F.when(plain, F.lit(1.0)).when(a + b > 0, F.greatest(a, b) / (a + b))
    other = F.when(us.isNull(), F.when(~plain, F.coalesce("us1", "us2"))).when(~plain & (a > 0) & (b > 0) & (F.col("us1") != F.col("us2")) & (best < sure), F.when(first, F.col("us2")).otherwise(F.col("us1")))
    status = F.when(other.isNotNull(), "ambiguous").when(us.isNull(), "none").otherwise("ok")
    reading = F.lit(None).cast("string")
    for family, (one, two) in READINGS.items():
        reading = F.when(F.col("family") == family, F.when(first, F.lit(one)).otherwise(F.lit(two))).otherwise(reading)
    return rows.select("rec_id", "field_name", "layout", F.when(us.isNotNull(), reading).alias("reading"), us.alias("utc_us"), F.when(us.isNotNull(), best).alias("posterior"), status.alias("status"), other.alias("other_us"))
