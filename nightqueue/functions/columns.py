"""Column functions: times, sky geometry, sizes, tiers, bands and null-tolerant casts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Obliquity of the ecliptic in degrees, albedo, tier limits in days, slope floor in days.
OBLIQUITY = 23.4393
ALBEDO = 0.14
STALE_DAYS = 3.0
MULTI_NIGHT_ARC = 1.0
SLOPE_FLOOR = 0.01
#: Main-belt classes and one-hot sites of the model features.
MAIN_BELT = ("MB1", "MB2", "MB3", "Pal", "Han", "Hun", "Pho", "Hil")
SITES = ("G96", "703", "F51", "F52", "I41", "T05", "T08", "M22")
#: The order of orbit classes in score text.
ORBIT_CLASSES = ("Int", "NEO", "MC", "Hun", "Pho", "Han", "MB1", "Pal", "MB2", "MB3", "Hil", "JTr", "JFC")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c) -> Column:
    """Text or number to double; null for empty, None and anything that isn't a plain number."""
    s = F.trim(col(c).cast("string"))
    plain = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    return F.when(s.rlike(plain), s.try_cast("double"))


def first_nonempty(*cols) -> Column:
    return F.coalesce(*[F.when(~col(c).cast("string").isin("", "None"), col(c).cast("string")) for c in cols])


def t_days(year, month, day) -> Column:
    """Days since 2000-01-01 00:00; the day may have a fraction."""
    return F.datediff(F.make_date(col(year), col(month), F.lit(1)), F.lit("2000-01-01").cast("date")) + col(day) - F.lit(1)


def wrap180(x) -> Column:
    return F.pmod(col(x) + 180.0, F.lit(360.0)) - 180.0


def wrap_hours(x) -> Column:
    return F.when(col(x) > 12, col(x) - 24).when(col(x) < -12, col(x) + 24).otherwise(col(x))


def ecliptic_lat(ra, dec) -> Column:
    a, d, e = F.radians(col(ra)), F.radians(col(dec)), F.radians(F.lit(OBLIQUITY))
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(d) * F.cos(e) - F.cos(d) * F.sin(a) * F.sin(e)))))


def ecliptic_lon(ra, dec) -> Column:
    a, d, e = F.radians(col(ra)), F.radians(col(dec)), F.radians(F.lit(OBLIQUITY))
    return F.pmod(F.degrees(F.atan2(F.cos(d) * F.sin(a) * F.cos(e) + F.sin(d) * F.sin(e), F.cos(d) * F.cos(a))), F.lit(360.0))


def solar_longitude(t) -> Column:
    c = col(t) / 36525.0
    m = F.radians(F.pmod(357.52911 + 35999.05029 * c, F.lit(360.0)))
    centre = (1.914602 - 0.004817 * c) * F.sin(m) + 0.019993 * F.sin(2 * m)
    return F.pmod(F.pmod(280.46646 + 36000.76983 * c, F.lit(360.0)) + centre, F.lit(360.0))


def elongation(lon, sun) -> Column:
    return F.abs(wrap180(col(lon) - col(sun)))


def opposition_distance(lon, sun) -> Column:
    d = F.pmod(col(lon) - col(sun) - 180.0, F.lit(360.0))
    return F.least(d, 360.0 - d)


def size_m(h) -> Column:
    return 1329000 / F.sqrt(F.lit(ALBEDO)) * F.pow(F.lit(10.0), -col(h) / 5)


def fmt_size(m) -> Column:
    m = col(m)
    return F.when(m.isNull(), "").when(m >= 1000, F.format_string("%.1f km", m / 1000)).otherwise(F.format_string("%.0f m", m))


def followup_status(arc, unseen) -> Column:
    """unknown, going_stale, tracked or needs_followup, decided in this order."""
    a, u = col(arc), col(unseen)
    return F.when(a.isNull() & u.isNull(), "unknown").when(u > STALE_DAYS, "going_stale").when(a >= MULTI_NIGHT_ARC, "tracked").otherwise("needs_followup")


def score_band(s) -> Column:
    return F.when(col(s) >= 90, "high").when(col(s) >= 70, "medium").otherwise("low")


def p_band(p) -> Column:
    return F.when(col(p) >= 0.8, "high").when(col(p) >= 0.4, "medium").otherwise("low")


def disc_ymd(year, month, day) -> Column:
    return F.when(col(year).isNull(), "").otherwise(F.format_string("%d-%02d-%04.1f", col(year), col(month), col(day)))


def posting_end(stamp) -> Column:
    """The day of a posting (first 8 characters, yyyyMMdd) in days from noon of 2000-01-01."""
    d = F.try_to_timestamp(F.substring(col(stamp), 1, 8), F.lit("yyyyMMdd")).cast("date")
    return F.when(F.length(col(stamp)) >= 8, F.datediff(d, F.lit("2000-01-01").cast("date")) - 0.5)


def odds(ip) -> Column:
    p = col(ip)
    return F.when(p.isNull() | (p <= 0), "").otherwise(F.concat(F.lit("1 in "), F.format_number(F.round(1 / p), 0)))


def subject_label(md) -> Column:
    """struct(is_real boolean or null, label_source) of a metadata map."""
    answer, word = col(md)["#feedback_2_answer"], col(md)["!sKeyword"]
    real = F.when(answer == "0", True).when(answer == "1", False).when(word == "rjct", False)
    source = F.when(answer.isin("0", "1"), "expert_feedback").when(word == "rjct", "keyword_rjct").otherwise("unlabeled")
    return F.struct(real.alias("is_real"), source.alias("label_source"))


def vetted_label(is_real, keyword) -> Column:
    """1 or 0 of a cached subject: its own label, or else the survey's verdict in its keyword, or else null."""
    word = col(keyword)
    return F.coalesce(col(is_real), F.when(word == "normal", True).when(word == "rjct", False)).cast("int")


def cutout_url(base, stamp, field, ccd, quadrant, band, ra, dec) -> Column:
    """The archive path of a difference image for a 14-digit exposure stamp."""
    s, f, c = col(stamp), F.lpad(col(field).cast("string"), 6, "0"), F.lpad(col(ccd).cast("string"), 2, "0")
    name = F.concat(F.lit("ztf_"), s, F.lit("_"), f, F.lit("_"), col(band), F.lit("_c"), c, F.lit("_o_q"), col(quadrant).cast("string"), F.lit("_scimrefdiffimg.fits.fz"))
    where = F.format_string("?center=%.5f,%.5f&size=60arcsec&gzip=false", col(ra), col(dec))
    return F.concat(F.lit(base), F.lit("/"), F.substring(s, 1, 4), F.lit("/"), F.substring(s, 5, 4), F.lit("/"), F.substring(s, 9, 14), F.lit("/"), name, where)


def rate_parts(rate, angle, dec) -> tuple[Column, Column]:
    """Degrees a day in right ascension and declination; the cosine is at least 0.05."""
    a = F.radians(col(angle))
    return col(rate) * F.sin(a) / F.greatest(F.cos(F.radians(col(dec))), F.lit(0.05)), col(rate) * F.cos(a)


def extrapolate(ra, dec, ra_rate, dec_rate, days) -> Column:
    """struct(ra, dec, stale): a straight line for at most seven days."""
    d = F.least(col(days), F.lit(7.0))
    return F.struct(F.pmod(col(ra) + col(ra_rate) * d, F.lit(24.0)).alias("ra"), F.greatest(F.lit(-90.0), F.least(F.lit(90.0), col(dec) + col(dec_rate) * d)).alias("dec"), (col(days) > 7).alias("stale"))


def filled(c, value, zero_is_missing: bool = False) -> Column:
    x = F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))
    return F.coalesce(F.nullif(x, F.lit(0.0)) if zero_is_missing else x, F.lit(value))
