"""Registered queries of the vetting operators over the driver's tables, with equivalent SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import columns as C
from ..operators import boosting as B, calibration as K, images as I, metrics as M, models as ML, outcomes as O, snapshots as S, tracklets as T
from ..sources import readers as R
from ..sources.tables import shared_dir
from ..streaming import logs as L, streams as ST
from .views import VIEWS, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def rsql(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


FIRST = "first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trksub ORDER BY stamp, tie) AS k FROM snap) WHERE k = 1)"
STATUS = "CASE WHEN arc IS NULL AND unseen IS NULL THEN 'unknown' WHEN unseen > 3 THEN 'going_stale' WHEN arc >= 1 THEN 'tracked' ELSE 'needs_followup' END"
SIZE = "1329000 / sqrt(0.14) * pow(10, -h / 5)"
BAND = "CASE WHEN p >= 0.8 THEN 'high' WHEN p >= 0.4 THEN 'medium' ELSE 'low' END"


# ---- snapshots ----


@query(f"""WITH {FIRST}, q AS (SELECT *, {STATUS} AS followup_status, {SIZE} AS size, coalesce(score / 100.0, 0) AS p FROM first)
SELECT trksub, score, v, h, nobs, arc, unseen, followup_status, round(size, 3) AS size_m, CASE WHEN size >= 1000 THEN printf('%.1f km', size / 1000) ELSE printf('%.0f m', size) END AS size_text, round(p, 6) AS p, {BAND} AS band,
row_number() OVER (ORDER BY p DESC, trksub) AS rank FROM q""")
def vetting_queue(spark, d):
    rows = S.vetting_rows(view(spark, d, "snap"))
    ranked = M.running(rows, [F.col("p").desc(), F.col("trksub")], {"rank": F.lit(1)})
    return ranked.select("trksub", "score", "v", "h", "nobs", "arc", "unseen", "followup_status", F.round("size_m", 3).alias("size_m"), C.fmt_size("size_m").alias("size_text"), F.round("p", 6).alias("p"), C.p_band("p").alias("band"), "rank")


@query(f"""WITH {FIRST}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trksub ORDER BY stamp DESC, tie DESC) AS k FROM snap) WHERE k = 1)
SELECT f.trksub, f.stamp, f.score, f.nobs, l.stamp AS last_stamp, l.score AS latest_score, l.nobs AS latest_nobs, l.arc AS latest_arc, l.unseen AS latest_unseen, l.v AS latest_v, l.h AS latest_h FROM first f JOIN last l ON f.trksub = l.trksub""")
def first_posting_latest(spark, d):
    f = S.first_posting(view(spark, d, "snap"))
    return f.select("trksub", "stamp", "score", "nobs", "last_stamp", *[f"latest_{c}" for c in S.FIELDS])


def _end(c: str) -> str:
    return f"arg_min({c}, struct_pack(s := stamp, t := tie)) FILTER ({c} IS NOT NULL) AS {c}_a, arg_max({c}, struct_pack(s := stamp, t := tie)) FILTER ({c} IS NOT NULL) AS {c}_b"


EV = f"""g AS (SELECT trksub, count(*) AS ts_n_snapshots, (epoch_us(max(stamp)) - epoch_us(min(stamp))) / 86400e6 AS span, max(unseen) AS um, {', '.join(_end(c) for c in ('score', 'arc', 'nobs', 'unseen', 'v'))} FROM snap GROUP BY trksub),
ev AS (SELECT trksub, ts_n_snapshots, span AS ts_span_days, CAST(score_b - score_a AS DOUBLE) AS ts_score_delta, CASE WHEN score_a IS NOT NULL THEN CASE WHEN span > 0.01 THEN (score_b - score_a) / span ELSE 0 END END AS ts_score_slope,
arc_b - arc_a AS ts_arc_growth, CAST(nobs_b - nobs_a AS DOUBLE) AS ts_nobs_growth, CASE WHEN span > 0.01 THEN (nobs_b - nobs_a) / span ELSE 0 END AS ts_nobs_rate, um AS ts_unseen_max, unseen_b - unseen_a AS ts_unseen_trend, v_b - v_a AS ts_v_faded FROM g)"""
EV_OUT = "SELECT trksub, ts_n_snapshots, round(ts_span_days, 3) AS ts_span_days, " + rsql("ts_score_delta", "ts_score_slope", "ts_arc_growth", "ts_nobs_growth", "ts_nobs_rate", "ts_unseen_max", "ts_unseen_trend", "ts_v_faded") + " FROM ev"


@query(f"WITH {EV} {EV_OUT}")
def ts_evolution(spark, d):
    return rounded(S.evolution_features(view(spark, d, "snap")))


@query(f"WITH {EV} SELECT count(*) AS n_objects, count(*) FILTER (ts_n_snapshots > 1) AS n_repeated, median(ts_nobs_growth) AS median_nobs_growth FROM ev")
def ts_summary(spark, d):
    return S.evolution_summary(S.evolution_features(view(spark, d, "snap")))


HIST = """w AS (SELECT *, lag(ra_h) OVER o AS pr, lag(dec_deg) OVER o AS pd, row_number() OVER o AS n FROM snap WINDOW o AS (PARTITION BY trksub ORDER BY stamp, tie)),
hist AS (SELECT trksub, stamp, tie, ra_h, dec_deg, row_number() OVER (PARTITION BY trksub ORDER BY stamp, tie) AS pos FROM w WHERE n = 1 OR ra_h IS DISTINCT FROM pr OR dec_deg IS DISTINCT FROM pd)"""
RATE = """k AS (SELECT *, row_number() OVER (PARTITION BY trksub ORDER BY pos DESC) AS k FROM hist), m AS (SELECT a.trksub, a.ra_h, a.dec_deg, a.stamp, (epoch_us(a.stamp) - epoch_us(b.stamp)) / 86400e6 AS days, a.ra_h - b.ra_h AS dr, a.dec_deg - b.dec_deg AS dd FROM k a LEFT JOIN k b ON a.trksub = b.trksub AND b.k = 2 WHERE a.k = 1),
rate AS (SELECT trksub, ra_h, dec_deg, stamp, CASE WHEN days > 0 THEN (CASE WHEN dr > 12 THEN dr - 24 WHEN dr < -12 THEN dr + 24 ELSE dr END) / days END AS ra_rate, CASE WHEN days > 0 THEN dd / days END AS dec_rate FROM m)"""


@query(f"WITH {HIST} SELECT * FROM hist")
def position_history(spark, d):
    return S.position_history(view(spark, d, "snap"))


def _motion(spark, d) -> DataFrame:
    """Histories in which every third object has kept its last position only, with tracklets to fall back on."""
    hist = S.position_history(view(spark, d, "snap").where("trksub % 3 > 0")).unionByName(S.position_history(S.first_posting(view(spark, d, "snap").where("trksub % 3 = 0")).select("trksub", "stamp", "tie", "ra_h", "dec_deg")))
    return S.motion_or_tracklet(S.motion_rate(hist), T.tracklet_features(view(spark, d, "obs")))


@query(f"WITH {HIST}, {RATE} SELECT trksub, ra_h, dec_deg, stamp, round(ra_rate, 4) AS ra_rate, round(dec_rate, 4) AS dec_rate FROM rate")
def motion_rate(spark, d):
    return rounded(S.motion_rate(S.position_history(view(spark, d, "snap"))), 4)


@query(f"""WITH {HIST}, {RATE}, x AS (SELECT *, (epoch_us(TIMESTAMP '2024-02-05 00:00:00') - epoch_us(stamp)) / 86400e6 AS age, ra_h + ra_rate * least((epoch_us(TIMESTAMP '2024-02-05 00:00:00') - epoch_us(stamp)) / 86400e6, 7) AS r FROM rate)
SELECT trksub, round(((r % 24) + 24) % 24, 3) AS ra, CASE WHEN dec_rate IS NOT NULL THEN round(greatest(-90, least(90, dec_deg + dec_rate * least(age, 7))), 3) END AS dec, age > 7 AS stale FROM x""")
def extrapolate(spark, d):
    rate = S.motion_rate(S.position_history(view(spark, d, "snap")))
    age = (F.unix_micros(F.lit("2024-02-05 00:00:00").cast("timestamp")) - F.unix_micros(F.col("stamp").cast("timestamp"))) / 86400e6
    x = rate.select("trksub", "dec_rate", C.extrapolate("ra_h", "dec_deg", "ra_rate", "dec_rate", age).alias("x"))
    return x.select("trksub", F.round("x.ra", 3).alias("ra"), F.when(F.col("dec_rate").isNotNull(), F.round("x.dec", 3)).alias("dec"), F.col("x.stale").alias("stale"))


NEWEST = "newest AS (SELECT DISTINCT trksub FROM snap WHERE stamp = (SELECT max(stamp) FROM snap))"


@query(f"WITH {FIRST}, {NEWEST} SELECT trksub, stamp, score FROM first WHERE trksub IN (SELECT trksub FROM newest)")
def current_semi(spark, d):
    snap = view(spark, d, "snap")
    return S.current_only(S.first_posting(snap).select("trksub", "stamp", "score"), snap)


@query(f"WITH {FIRST}, {NEWEST} SELECT trksub, stamp, score FROM first WHERE trksub NOT IN (SELECT trksub FROM newest)")
def rolled_off(spark, d):
    snap = view(spark, d, "snap")
    return S.rolled_off(S.first_posting(snap).select("trksub", "stamp", "score"), snap)


@query("SELECT count(*) AS n, min(score) AS lowest, max(score) AS highest, count(*) FILTER (score >= 90) AS n_high, count(*) FILTER (unseen > 3) AS n_at_risk FROM snap")
def frame_summary(spark, d):
    return S.frame_summary(view(spark, d, "snap"))


@query(f"WITH {FIRST} SELECT {STATUS} AS followup_status, count(*) AS n FROM first GROUP BY 1")
def followup_tally(spark, d):
    return S.vetting_rows(view(spark, d, "snap")).groupBy("followup_status").agg(F.count("*").alias("n"))


@query(f"WITH {FIRST} SELECT trksub, coalesce(score / 100.0, 0) AS p FROM first ORDER BY p DESC, trksub LIMIT 10")
def score_fallback(spark, d):
    rows = S.first_posting(view(spark, d, "snap"))
    return ML.score_queue(rows).select("trksub", "p").orderBy(F.col("p").desc(), "trksub").limit(10)


@query("SELECT trksub, tie, score, CASE WHEN score >= 90 THEN 'high' WHEN score >= 70 THEN 'medium' ELSE 'low' END AS band FROM snap WHERE score >= 90 ORDER BY score DESC, tie")
def frame_by_score(spark, d):
    return view(spark, d, "snap").where("score >= 90").select("trksub", "tie", "score", C.score_band("score").alias("band")).orderBy(F.col("score").desc(), "tie")


# ---- sources ----


@query("""SELECT trksub, CAST(score AS INT) AS score, 2024 AS year, CAST(1 + tie % 12 AS INT) AS month, round(1 + (tie % 280) / 10.0, 1) AS day, concat('Added Jan. ', CAST(tie % 28 AS VARCHAR), ' UT') AS updated, CAST(nobs AS INT) AS nobs FROM (SELECT CAST(trksub AS VARCHAR) AS trksub, * EXCLUDE trksub FROM snap) WHERE score IS NOT NULL""")
def feed_text_parse(spark, d):
    s = view(spark, d, "snap").where("score IS NOT NULL")
    line = F.concat_ws(" ", F.col("trksub").cast("string"), F.col("score"), F.lit("2024"), 1 + F.col("tie") % 12, F.format_string("%.1f", 1 + (F.col("tie") % 280) / 10.0), F.lit("12.5 -3.25 20.1 Added Jan."), F.col("tie") % 28, F.lit("UT"), F.col("nobs"), F.lit("0.5 21.3 1.25"))
    return R.parse_feed_text(s.select(line.alias("line"))).select("trksub", "score", "year", "month", "day", "updated", "nobs")


RECORDS = "SELECT CAST(trksub AS VARCHAR) AS Temp_Desig, CAST(score AS VARCHAR) AS Score, CAST(nobs AS VARCHAR) AS NObs FROM snap"


def _broken_record():
    return F.format_string('{"Temp_Desig": "%d", "Score": %s, "NObs": 1, "NObs": %d', F.col("trksub"), F.coalesce(F.col("score").cast("string"), F.lit("null")), F.col("nobs"))


@query(RECORDS)
def feed_recover(spark, d):
    files = view(spark, d, "snap").groupBy((F.col("tie") / 200).cast("long").alias("file")).agg(F.array_join(F.collect_list(_broken_record()), ", ").alias("value"))
    return R.recover_feed(files, ["Temp_Desig", "Score", "NObs"]).select("Temp_Desig", "Score", "NObs")


@query(RECORDS)
def feed_recover_files(spark, d):
    path = f"{shared_dir(spark)}/feeds-{uuid.uuid4().hex}"
    view(spark, d, "snap").select(_broken_record()).write.text(path)
    return R.recover_files(spark, path, ["Temp_Desig", "Score", "NObs"]).select("Temp_Desig", "Score", "NObs")


def _obs_lines(obs: DataFrame) -> DataFrame:
    """Observations as 80-column lines, every third one in the 75-column form."""
    s = F.abs("dec")
    ra = F.col("ra") / 15
    h, m = F.floor(ra), F.floor((ra - F.floor(ra)) * 60)
    dd, dm = F.floor(s), F.floor((s - F.floor(s)) * 60)
    # whole numbers are padded as text: format_string took most of the time of a line
    wide = lambda x, n=2: F.lpad(x.cast("string"), n, "0")
    tenth = (F.col("line_no") % 10).cast("string")
    head = [F.lit("     "), F.rpad(F.concat(F.lit("K"), F.col("trksub") % 100000), 7, " "), F.lit("  C"), wide(F.year("date"), 4), F.lit(" "), wide(F.month("date")), F.lit(" ")]
    day = [wide(F.dayofmonth("date")), F.lit("."), tenth, F.lit("00000")]
    place = [wide(h), F.lit(" "), wide(m), F.lit(" "), wide(F.col("line_no") % 60), F.lit(".000"), F.when(F.col("dec") < 0, "-").otherwise("+"), wide(dd), F.lit(" "), wide(dm), F.lit(" "), wide(F.col("line_no") % 50), F.lit(".00         ")]
    line = F.concat(*head, *day, *place, F.coalesce(F.lpad(F.round("mag", 1).cast("string"), 5, " "), F.lit("     ")), F.lit("  NEOCP"), F.rpad(F.col("obscode"), 3, " "))
    return obs.select("trksub", "line_no", F.when(F.col("line_no") % 3 == 0, F.substring(line, 6, 75)).otherwise(line).alias("raw"))


@query("""SELECT trksub, line_no, concat('K', CAST(trksub % 100000 AS VARCHAR)) AS desig, round(datediff('day', DATE '2000-01-01', date) + (line_no % 10) / 10.0, 6) AS t,
round(15.0 * (floor(ra / 15) + floor((ra / 15 - floor(ra / 15)) * 60) / 60 + (line_no % 60) / 3600.0), 6) AS ra,
round((CASE WHEN dec < 0 THEN -1 ELSE 1 END) * (floor(abs(dec)) + floor((abs(dec) - floor(abs(dec))) * 60) / 60 + (line_no % 50) / 3600.0), 6) AS dec, round(mag, 1) AS mag, obscode FROM obs""")
def obs80_parse(spark, d):
    return rounded(R.parse_obs80(_obs_lines(view(spark, d, "obs")), keep=("trksub", "line_no")))


SCORES = [f"d2_{c}_{k}" for c in C.ORBIT_CLASSES for k in ("raw", "noid")]


@query("SELECT concat('P', CAST(trksub AS VARCHAR)) AS desig, CASE WHEN trksub % 4 = 0 THEN NULL ELSE round((trksub % 90) / 100.0, 6) END AS d2_rms, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in SCORES) + " FROM d2")
def score_text_parse(spark, d):
    v = view(spark, d, "d2")
    nums = [F.coalesce(F.col(f"d2_{c}_{k}"), F.lit(0)).cast("string") for c in C.ORBIT_CLASSES for k in ("raw", "noid")]
    line = F.concat_ws(" ", F.concat(F.lit("P"), F.col("trksub")), F.when(F.col("trksub") % 4 == 0, "**").otherwise(F.format_string("%.2f", (F.col("trksub") % 90) / 100.0)), *nums)
    junk = v.select(F.lit("heading line without scores").alias("line")).limit(1)
    return R.parse_scores(v.select(line.alias("line")).union(junk))


def _outcome_pages(spark, d) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    k = F.col("o_orderkey")
    t = F.concat(F.lit("T"), k)
    forms = [F.concat(F.lit("2026 A"), k % 50, F.lit(" = "), t, F.lit(" (July 1.5 UT) [MPEC 2026-N"), k % 90 + 1, F.lit("]")), F.concat(F.lit("2026 B"), k % 50, F.lit(" = "), t, F.lit(" (July 1.5 UT)")), F.concat(F.lit("X"), k, F.lit(" = "), t, F.lit(" (July 1.5 UT)")), F.concat(F.lit("Comet C/2026 A1 = "), t, F.lit(" (July 1.5 UT) see MPEC 2026-A1")), F.concat(F.lit("- "), t, F.lit(" does not exist (July 1.5 UT)")), F.concat(t, F.lit(" was not a minor planet (July 1.5 UT)")), F.concat(t, F.lit(" vanished slowly (July 1.5 UT)")), F.concat(t, F.lit("longname vanished (July 1.5 UT)")), F.concat(t, F.lit(" has no time mark"))]
    line = F.coalesce(*[F.when(k % 9 == i, f) for i, f in enumerate(forms)])
    return o.groupBy((k / 500).cast("long").alias("page")).agg(F.concat(F.lit("<html><ul><li>"), F.array_join(F.collect_list(line), "</li><li><b>"), F.lit("</b></ul>")).alias("value"))


@query("""WITH o AS (SELECT o_orderkey AS k, concat('T', CAST(o_orderkey AS VARCHAR)) AS t FROM orders)
SELECT t AS trksub, CASE k % 9 WHEN 0 THEN 'neo' WHEN 1 THEN 'designated_other' WHEN 2 THEN 'linked' WHEN 3 THEN 'comet' WHEN 4 THEN 'does_not_exist' WHEN 5 THEN 'was_not_a_minor_planet' ELSE 'other' END AS outcome_class,
CASE k % 9 WHEN 0 THEN concat('2026 A', CAST(k % 50 AS VARCHAR)) WHEN 1 THEN concat('2026 B', CAST(k % 50 AS VARCHAR)) WHEN 2 THEN concat('X', CAST(k AS VARCHAR)) WHEN 3 THEN 'Comet C/2026 A1' WHEN 6 THEN 'vanished slowly' ELSE '' END AS designation,
CASE k % 9 WHEN 0 THEN concat('2026-N', CAST(k % 90 + 1 AS VARCHAR)) WHEN 3 THEN '2026-A1' END AS mpec FROM o WHERE k % 9 < 7 AND NOT (k % 9 = 6 AND length(t) > 8)""")
def outcome_classify(spark, d):
    lines = R.outcome_lines(_outcome_pages(spark, d))
    return O.upgrade_designated(O.classify_outcomes(lines)).select("trksub", "outcome_class", "designation", "mpec")


@query("SELECT CAST(c_custkey AS VARCHAR) AS des, concat('(', CAST(c_custkey AS VARCHAR), ')') AS fullname, CASE WHEN c_custkey % 7 = 0 THEN -99.0 ELSE round(-(c_acctbal / 100), 4) END AS ps_cum, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('1 in ', format('{:,}', CAST(1000 * (c_custkey + 1) AS BIGINT))) END AS odds FROM customer ORDER BY ps_cum DESC, des LIMIT 12")
def risk_top(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    k = F.col("c_custkey")
    null = F.lit(None).cast("string")
    r = F.struct(k.cast("string").alias("des"), F.concat(F.lit(" ("), k, F.lit(") ")).alias("fullname"), F.when(k % 5 != 0, (1 / (1000.0 * (k + 1))).cast("string")).alias("ip"), F.when(k % 7 != 0, F.round(-F.col("c_acctbal") / 100, 4).cast("string")).alias("ps_cum"), null.alias("ts_max"), null.alias("diameter"), null.alias("h"), null.alias("n_imp"), null.alias("range"), null.alias("last_obs"))
    rows = R.flatten_risk(c.select(F.array(r).alias("data")))
    top = rows.orderBy(F.col("ps_cum").desc(), "des").limit(12)
    return top.select("des", "fullname", "ps_cum", C.odds("ip_cum").alias("odds"))


@query("SELECT CAST(doc_id AS VARCHAR) AS subject_id, CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 3 = 1 THEN false WHEN doc_id % 2 = 0 THEN false END AS is_real, CASE WHEN doc_id % 3 < 2 THEN 'expert_feedback' WHEN doc_id % 2 = 0 THEN 'keyword_rjct' ELSE 'unlabeled' END AS label_source, CAST(1 + doc_id % 4 AS INT) AS n_frames, concat('http://x/', CAST(doc_id AS VARCHAR)) AS first_url FROM documents")
def subject_index(spark, d):
    i = F.col("doc_id")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    md = F.map_from_arrays(F.array(F.lit("#feedback_2_answer"), F.lit("!sKeyword")), F.array((i % 3).cast("string"), F.when(i % 2 == 0, "rjct").otherwise("ok")))
    loc = F.transform(F.sequence(F.lit(0), i % 4), lambda n: F.create_map(F.lit("image/png"), F.concat(F.lit("http://x/"), i.cast("string"))))
    pages = docs.groupBy((i / 500).cast("long").alias("page")).agg(F.collect_list(F.struct(i.cast("string").alias("id"), md.alias("metadata"), loc.alias("locations"))).alias("subjects"))
    return R.flatten_subjects(pages).select("subject_id", "is_real", "label_source", "n_frames", "first_url")


# ---- geometry and tracklets ----

E = "radians(23.4393)"
LAT = f"degrees(asin(greatest(-1, least(1, sin(radians(D)) * cos({E}) - cos(radians(D)) * sin(radians(R)) * sin({E})))))"
LON = f"((degrees(atan2(cos(radians(D)) * sin(radians(R)) * cos({E}) + sin(radians(D)) * sin({E}), cos(radians(D)) * cos(radians(R)))) + 360) % 360)"
SUN_M = "radians(((357.52911 + 35999.05029 * (T / 36525.0)) % 360 + 360) % 360)"
SUN = f"((((280.46646 + 36000.76983 * (T / 36525.0)) % 360 + 360) % 360 + (1.914602 - 0.004817 * (T / 36525.0)) * sin({SUN_M}) + 0.019993 * sin(2 * {SUN_M}) + 360) % 360)"


def geo(text: str, r: str, dec: str, t: str) -> str:
    import re

    return re.sub(r"\bT\b", t, re.sub(r"\bD\b", dec, re.sub(r"\bR\b", r, text)))


@query(f"""WITH g AS (SELECT trksub, line_no, {geo(LAT, 'ra', 'dec', 't')} AS lat, {geo(LON, 'ra', 'dec', 't')} AS lon, {geo(SUN, 'ra', 'dec', 't')} AS sun FROM obs)
SELECT trksub, line_no, {rsql('lat', 'lon', 'sun')}, round(abs(((lon - sun + 180) % 360 + 360) % 360 - 180), 6) AS elong, round(least(((lon - sun - 180) % 360 + 360) % 360, 360 - ((lon - sun - 180) % 360 + 360) % 360), 6) AS opp FROM g""")
def ecliptic_solar(spark, d):
    g = view(spark, d, "obs").select("trksub", "line_no", C.ecliptic_lat("ra", "dec").alias("lat"), C.ecliptic_lon("ra", "dec").alias("lon"), C.solar_longitude("t").alias("sun"))
    return rounded(g.withColumn("elong", C.elongation("lon", "sun")).withColumn("opp", C.opposition_distance("lon", "sun")))


@query("""SELECT trksub, line_no, concat('arch/2019/0104/084051/ztf_20190104084051_', lpad(CAST(trksub % 1000 AS VARCHAR), 6, '0'), '_zr_c', lpad(CAST(line_no AS VARCHAR), 2, '0'), '_o_q', CAST(1 + line_no % 4 AS VARCHAR), '_scimrefdiffimg.fits.fz?center=', printf('%.5f', ra), ',', printf('%.5f', dec), '&size=60arcsec&gzip=false') AS url FROM obs""")
def cutout_url(spark, d):
    o = view(spark, d, "obs")
    return o.select("trksub", "line_no", C.cutout_url("arch", F.lit("20190104084051"), F.col("trksub") % 1000, "line_no", 1 + F.col("line_no") % 4, F.lit("zr"), "ra", "dec").alias("url"))


W180 = "(((X) + 180) % 360 + 360) % 360 - 180"
TRK = f"""e AS (SELECT trksub, count(*) AS n, first(t ORDER BY t, line_no) AS t0, last(t ORDER BY t, line_no) AS t1, first(ra ORDER BY t, line_no) AS ra0, last(ra ORDER BY t, line_no) AS ra1, first(dec ORDER BY t, line_no) AS dec0, last(dec ORDER BY t, line_no) AS dec1, first(obscode ORDER BY t, line_no) AS site,
avg(mag) AS mag_mean, CASE WHEN count(mag) > 1 THEN max(mag) - min(mag) ELSE 0 END AS mag_range FROM obs GROUP BY trksub HAVING count(*) >= 2),
e2 AS (SELECT *, greatest(t1 - t0, 1e-6) AS dt, cos(radians((dec0 + dec1) / 2)) AS cosd, {W180.replace('X', 'ra1 - ra0')} AS dra, dec1 - dec0 AS ddec FROM e),
res AS (SELECT o.trksub, sqrt(avg(pow(({W180.replace('X', 'ra - (ra0 + dra * ((t - t0) / dt))')}) * cosd, 2) + pow(dec - (dec0 + ddec * ((t - t0) / dt)), 2))) * 3600 AS gc FROM obs o JOIN e2 ON o.trksub = e2.trksub GROUP BY o.trksub),
e3 AS (SELECT e2.*, gc, {geo(LAT, 'ra0', 'dec0', 't0')} AS lat, {geo(LON, 'ra0', 'dec0', 't0')} AS lon, {geo(SUN, 'ra0', 'dec0', 't0')} AS sun FROM e2 JOIN res ON e2.trksub = res.trksub),
trk AS (SELECT trksub, n AS nobs_tracklet, dt AS arc_days_tracklet, sqrt(pow(dra * cosd, 2) + pow(ddec, 2)) / dt AS sky_rate_deg_day, (degrees(atan2(dra * cosd, ddec)) + 360) % 360 AS motion_pa_deg, lat AS ecl_lat_deg, abs(((lon - sun + 180) % 360 + 360) % 360 - 180) AS solar_elong_deg,
least(((lon - sun - 180) % 360 + 360) % 360, 360 - ((lon - sun - 180) % 360 + 360) % 360) AS opposition_dist_deg, gc AS gc_rms_arcsec, mag_mean, mag_range, site AS obscode_first, CASE WHEN dt > 0.5 THEN 1 ELSE 0 END AS multi_night FROM e3)"""


@query(f"""WITH {TRK} SELECT trksub, nobs_tracklet, round(arc_days_tracklet, 4) AS arc_days_tracklet, CASE WHEN sky_rate_deg_day > 1000 THEN round(sky_rate_deg_day, 0) ELSE round(sky_rate_deg_day, 4) END AS sky_rate_deg_day, round(motion_pa_deg, 4) AS motion_pa_deg, round(ecl_lat_deg, 4) AS ecl_lat_deg, round(solar_elong_deg, 4) AS solar_elong_deg, round(opposition_dist_deg, 4) AS opposition_dist_deg, round(gc_rms_arcsec, 4) AS gc_rms_arcsec, round(mag_mean, 4) AS mag_mean, round(mag_range, 4) AS mag_range, obscode_first, multi_night FROM trk""")
def tracklet_features(spark, d):
    t = T.tracklet_features(view(spark, d, "obs"))
    # an arc without length makes rates of up to 1e8, of which four places would be noise
    return rounded(t.withColumn("sky_rate_deg_day", F.when(F.col("sky_rate_deg_day") > 1000, F.round("sky_rate_deg_day", 0)).otherwise(F.col("sky_rate_deg_day"))), 4)


LAST = HIST.replace("FROM snap WINDOW", "FROM kept WINDOW")


@query(f"""WITH {FIRST}, kept AS (SELECT trksub, stamp, tie, ra_h, dec_deg FROM snap WHERE trksub % 3 > 0 UNION ALL SELECT trksub, stamp, tie, ra_h, dec_deg FROM first WHERE trksub % 3 = 0), {LAST}, {RATE}, {TRK}
SELECT r.trksub, ra_h, dec_deg, stamp, round(coalesce(ra_rate, coalesce(sky_rate_deg_day, 0) * sin(radians(coalesce(motion_pa_deg, 0))) / greatest(cos(radians(dec_deg)), 0.05) / 15), 3) AS ra_rate, round(coalesce(dec_rate, coalesce(sky_rate_deg_day, 0) * cos(radians(coalesce(motion_pa_deg, 0)))), 3) AS dec_rate FROM rate r LEFT JOIN trk ON r.trksub = trk.trksub""")
def motion_fallback(spark, d):
    return rounded(_motion(spark, d), 3)


@query("""WITH w AS (SELECT *, 40.0 * (trksub % 90) AS e FROM obs), i AS (SELECT *, bool_or(t BETWEEN e - 120 AND e + 2) OVER (PARTITION BY trksub) AS any_in FROM w), k AS (SELECT * FROM i WHERE NOT any_in OR t BETWEEN e - 120 AND e + 2),
f AS (SELECT *, first_value(CAST(trunc(t) AS INT)) OVER o AS d0, first_value(obscode) OVER o AS s0 FROM k WINDOW o AS (PARTITION BY trksub ORDER BY t, line_no)) SELECT trksub, line_no, t, obscode FROM f WHERE CAST(trunc(t) AS INT) = d0 AND obscode = s0""")
def discovery_tracklet(spark, d):
    o = view(spark, d, "obs").withColumn("window_end", F.lit(40.0) * (F.col("trksub") % 90))
    return T.discovery_tracklet(T.in_posting_window(o)).select("trksub", "line_no", "t", "obscode")


@query("SELECT trksub, CAST(strftime(m.date, '%Y-%m-%d') AS VARCHAR) AS date, m.ra AS ra, m.dec AS dec FROM (SELECT trksub, min(struct_pack(date := date, ra := ra, dec := dec)) AS m FROM obs WHERE obscode = 'X4' AND year(date) BETWEEN 1999 AND 2001 GROUP BY trksub)")
def earliest_site_obs(spark, d):
    return T.earliest_site_obs(view(spark, d, "obs"), "X4", 1999, 2001).withColumn("date", F.col("date").cast("string"))


@query("""WITH x AS (SELECT o_orderkey AS exposure, CAST(o_orderdate AS DATE) AS date, (o_custkey * 37 % 36000) / 100.0 AS era, (o_custkey * 71 % 16000) / 100.0 - 80 AS edec, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS stamp FROM orders),
o AS (SELECT trksub, date, ra, dec FROM obs)
SELECT trksub, m.e AS exposure, m.s AS stamp FROM (SELECT trksub, min(struct_pack(e := exposure, s := stamp)) AS m FROM o JOIN x ON o.date = x.date AND stamp <> '' AND degrees(2 * asin(sqrt(least(1, pow(sin(radians(dec - edec) / 2), 2) + cos(radians(dec)) * cos(radians(edec)) * pow(sin(radians(ra - era) / 2), 2))))) <= 25 GROUP BY trksub)""")
def exposure_match(spark, d):
    k = F.col("o_custkey")
    x = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("exposure"), F.col("o_orderdate").cast("date").alias("date"), (k * 37 % 36000 / 100.0).alias("ra"), (k * 71 % 16000 / 100.0 - 80).alias("dec"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderkey").cast("string")).alias("stamp"))
    return T.match_exposures(view(spark, d, "obs").select("trksub", "date", "ra", "dec"), x, 25.0)


@query("""WITH u AS (SELECT trksub, CASE WHEN trksub % 3 = 0 OR trksub % 2 = 0 AND line_no % 2 = 0 THEN 'api' ELSE 'circular' END AS source FROM obs), g AS (SELECT trksub, source, count(*) AS n FROM u GROUP BY trksub, source HAVING count(*) >= 2)
SELECT * FROM g WHERE source = 'circular' OR trksub NOT IN (SELECT trksub FROM g WHERE source = 'circular')""")
def tracklet_union(spark, d):
    o = view(spark, d, "obs")
    api = (F.col("trksub") % 3 == 0) | (F.col("trksub") % 2 == 0) & (F.col("line_no") % 2 == 0)
    u = o.where(~api).withColumn("source", F.lit("circular")).unionByName(o.where(api).withColumn("source", F.lit("api")))
    return T.by_source(u, ["circular", "api"], least=2).groupBy("trksub", "source").agg(F.count("*").alias("n"))


@query("SELECT trksub, line_no FROM obs WHERE trksub % 4 > 0 AND 66 - line_no % 40 > 40")
def object_lines(spark, d):
    o = view(spark, d, "obs")
    who = F.when(F.col("trksub") % 4 > 0, F.concat(F.lit("#"), F.lpad(F.col("trksub").cast("string"), 12, "0"))).otherwise("#no object    ")
    line = F.rpad(F.concat(who, F.lit(" observed")), (66 - F.col("line_no") % 40).cast("int"), "x")
    lines = o.select("line_no", F.concat(F.lit("#"), F.lpad(F.col("trksub").cast("string"), 12, "0")).alias("name"), "trksub", line.alias("raw"))
    return R.mentions(lines, key="name").select("trksub", "line_no")


# ---- outcomes and labels ----

LOG = "log AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trksub, outcome_class, designation ORDER BY stamp, line_no) AS k FROM event) WHERE k = 1)"
RES = "res AS (SELECT * EXCLUDE k FROM (SELECT * EXCLUDE k, row_number() OVER (PARTITION BY trksub ORDER BY CASE WHEN outcome_class IN ('linked', 'other') THEN 1 ELSE 0 END, stamp DESC, line_no DESC) AS k FROM log) WHERE k = 1)"
Y = "CASE WHEN outcome_class = 'neo' THEN 1 WHEN outcome_class IN ('designated_other', 'was_not_confirmed', 'does_not_exist', 'was_a_star') THEN 0 END"
LAB = f"lab AS (SELECT f.trksub, f.score, f.stamp AS discovered, outcome_class, designation, {Y} AS y, CASE WHEN outcome_class IS NULL THEN 'unresolved' WHEN ({Y}) IS NULL THEN 'excluded' ELSE 'labeled' END AS state FROM first f LEFT JOIN res ON f.trksub = res.trksub)"


def _log(spark, d) -> DataFrame:
    return O.outcome_log(view(spark, d, "event"))


def _features(spark, d) -> DataFrame:
    return S.first_posting(view(spark, d, "snap")).select("trksub", "score", F.col("stamp").alias("discovered"))


@query(f"WITH {LOG} SELECT trksub, outcome_class, designation, mpec, stamp, line_no FROM log")
def outcome_log(spark, d):
    return _log(spark, d).select("trksub", "outcome_class", "designation", "mpec", "stamp", "line_no")


@query("WITH old AS (SELECT DISTINCT trksub, outcome_class, designation FROM event WHERE line_no % 3 > 0) SELECT DISTINCT trksub, outcome_class, designation FROM event WHERE line_no % 3 = 0 EXCEPT SELECT * FROM old")
def outcome_append(spark, d):
    e = view(spark, d, "event")
    return O.new_outcomes(e.where("line_no % 3 = 0"), e.where("line_no % 3 > 0")).select(*O.KEY)


@query(f"WITH {LOG}, {RES} SELECT trksub, outcome_class, designation, mpec FROM res")
def outcome_resolve(spark, d):
    return O.resolve_outcomes(_log(spark, d)).select("trksub", "outcome_class", "designation", "mpec")


@query(f"""WITH {LOG}, {RES}, w AS (SELECT o.trksub, line_no, t, datediff('day', DATE '2000-01-01', CAST(stamp AS DATE)) + 0.0 AS e FROM obs o JOIN (SELECT trksub, stamp FROM res) r ON o.trksub = r.trksub), i AS (SELECT *, t BETWEEN e - 1200 AND e + 2 AS inside FROM w)
SELECT trksub, line_no FROM (SELECT *, bool_or(inside) OVER (PARTITION BY trksub) AS any_in FROM i) WHERE inside OR NOT any_in""")
def outcome_window(spark, d):
    ends = O.resolve_outcomes(_log(spark, d)).select("trksub", (F.datediff(F.col("stamp").cast("date"), F.lit("2000-01-01").cast("date")) + 0.0).alias("window_end"))
    return T.in_posting_window(view(spark, d, "obs").join(ends, "trksub"), days=1200).select("trksub", "line_no")


@query("""WITH g AS (SELECT o_orderkey // 500 AS page, count(*) FILTER (o_orderkey % 9 < 8) AS n_lines FROM orders GROUP BY 1) SELECT page, n_lines, n_lines = 0 AS suspect FROM g""")
def page_quality(spark, d):
    pages = _outcome_pages(spark, d)
    return R.page_quality(pages, R.outcome_lines(pages, keep=("page",)))


@query("SELECT concat('T', CAST(o_orderkey AS VARCHAR), 'longname vanished (July 1.5 UT)') AS line FROM orders WHERE o_orderkey % 9 = 7 UNION ALL SELECT concat('T', CAST(o_orderkey AS VARCHAR), ' vanished slowly (July 1.5 UT)') FROM orders WHERE o_orderkey % 9 = 6 AND length(CAST(o_orderkey AS VARCHAR)) > 7")
def outcome_quarantine(spark, d):
    return O.unparsed_outcomes(R.outcome_lines(_outcome_pages(spark, d)).select("line"))


@query(f"WITH {LOG} SELECT outcome_class, count(*) AS n FROM log GROUP BY 1")
def outcome_histogram(spark, d):
    return O.outcome_histogram(_log(spark, d))


@query("SELECT DISTINCT trksub, designation FROM event WHERE outcome_class IN ('neo', 'designated_other') AND designation <> ''")
def designated_rows(spark, d):
    return O.designated(view(spark, d, "event")).select("trksub", "designation").distinct()


@query(f"WITH {FIRST}, {LOG}, {RES}, {LAB} SELECT trksub, score, outcome_class, designation, y FROM lab WHERE state = 'labeled'")
def labeled_table(spark, d):
    return O.label_state(_features(spark, d), O.resolve_outcomes(_log(spark, d))).where("state = 'labeled'").select("trksub", "score", "outcome_class", "designation", "y")


@query(f"WITH {FIRST}, {LOG}, {RES}, {LAB} SELECT count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg, count(*) FILTER (state = 'unresolved') AS unresolved, count(*) FILTER (state = 'excluded') AS excluded FROM lab")
def label_summary(spark, d):
    return O.label_summary(O.label_state(_features(spark, d), O.resolve_outcomes(_log(spark, d))))


EPOCHS = """days AS (SELECT trksub, CAST(stamp AS DATE) AS day, arg_min(score, (stamp, tie)) AS score, min(stamp) AS discovered FROM snap GROUP BY ALL), disc AS (SELECT trksub, discovered, row_number() OVER (PARTITION BY trksub ORDER BY day) AS epoch FROM
(SELECT *, lag(day) OVER (PARTITION BY trksub ORDER BY day) AS was FROM days) WHERE was IS NULL OR day - was > 1), log AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trksub, outcome_class, designation ORDER BY stamp, line_no) AS k FROM reported) WHERE k = 1)"""


@query(f"""WITH {EPOCHS}, near AS (SELECT disc.*, outcome_class, row_number() OVER (PARTITION BY disc.trksub, epoch ORDER BY CASE WHEN outcome_class IN ('linked', 'other') THEN 1 ELSE 0 END, stamp DESC, line_no DESC) AS k
FROM disc JOIN log ON disc.trksub = log.trksub AND abs(datediff('day', CAST(discovered AS DATE), stamp)) <= 3), won AS (SELECT * FROM near WHERE k = 1)
SELECT d.trksub, CAST(d.epoch AS INT) AS epoch, d.discovered, w.outcome_class, {Y} AS y, CASE WHEN w.outcome_class IS NULL THEN 'unresolved' WHEN ({Y}) IS NULL THEN 'excluded' ELSE 'labeled' END AS state FROM disc d LEFT JOIN won w ON d.trksub = w.trksub AND d.epoch = w.epoch""")
def epoch_guard(spark, d):
    found = S.discoveries(view(spark, d, "snap"), gap_days=1).withColumnRenamed("stamp", "discovered")
    labels = O.label_epochs(found, O.outcome_log(view(spark, d, "reported")), days=3)
    return labels.select("trksub", "epoch", "discovered", "outcome_class", "y", "state")


@query("""SELECT trksub, neo_at AS discovered, outcome_class, y FROM (VALUES ('neo', 5, 'neo', 1), ('was_not_confirmed', 735, 'was_not_confirmed', 0), ('none', 400, NULL, NULL)) t(k, after, outcome_class, y), (SELECT c_custkey AS trksub FROM customer), LATERAL (SELECT DATE '2024-01-05' + CAST(after + trksub % 50 - 5 AS INT) AS neo_at)""")
def epoch_reuse(spark, d):
    """Each customer number is a designation that is used again: a neo, two years later one that wasn't confirmed, and one between without an outcome near it."""
    names = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("trksub"))
    day = lambda n: F.date_add(F.lit("2024-01-05").cast("date"), (F.col("trksub") % 50 + n).cast("int"))
    found = names.select("trksub", F.explode(F.array(day(0), day(395), day(730))).alias("discovered"))
    told = names.select("trksub", F.explode(F.array(F.struct(F.lit("neo").alias("c"), day(5).alias("s")), F.struct(F.lit("linked").alias("c"), day(6).alias("s")), F.struct(F.lit("was_not_confirmed").alias("c"), day(735).alias("s")))).alias("o"))
    log = told.select("trksub", F.col("o.c").alias("outcome_class"), F.lit("").alias("designation"), F.lit(None).cast("string").alias("mpec"), F.col("o.s").alias("stamp"), F.lit(1).alias("line_no"))
    return O.label_epochs(found, log, days=60).select("trksub", "discovered", "outcome_class", "y")


BACK = f"back AS (SELECT trksub, 1 AS y, d2_NEO_noid FROM d2 WHERE trksub % 2 = 0), tr AS (SELECT trksub, y, 'capture' AS source, NULL AS d2_NEO_noid FROM lab WHERE state = 'labeled' UNION ALL SELECT trksub, y, 'backfill', d2_NEO_noid FROM back WHERE trksub NOT IN (SELECT trksub FROM lab WHERE state = 'labeled'))"


def _training(spark, d, guard_col: str | None = None) -> DataFrame:
    lab = O.label_state(_features(spark, d), O.resolve_outcomes(_log(spark, d))).where("state = 'labeled'").select("trksub", "y")
    back = view(spark, d, "d2").where("trksub % 2 = 0").select("trksub", F.lit(1).alias("y"), F.lit("backfill").alias("source"), "d2_NEO_noid")
    return O.training_frame(lab, back, guard_col).select("trksub", "y", "source", "d2_NEO_noid")


@query(f"WITH {FIRST}, {LOG}, {RES}, {LAB}, {BACK} SELECT trksub, y, source, d2_NEO_noid FROM tr")
def backfill_union(spark, d):
    return _training(spark, d)


@query(f"WITH {FIRST}, {LOG}, {RES}, {LAB}, {BACK} SELECT count(DISTINCT y) AS n_labels, count(DISTINCT y) = 2 AS ok FROM tr WHERE d2_NEO_noid IS NOT NULL")
def leak_guard(spark, d):
    return O.leak_guard(_training(spark, d))


@query(f"WITH {FIRST}, {LOG}, {RES}, {LAB}, {BACK} SELECT trksub, y, source, d2_NEO_noid FROM tr WHERE source = 'capture' OR (SELECT count(DISTINCT y) = 2 FROM tr WHERE d2_NEO_noid IS NOT NULL)")
def guarded_training(spark, d):
    return _training(spark, d, guard_col="d2_NEO_noid")


@query(f"WITH {FIRST}, {LOG}, {RES}, {LAB}, {BACK} SELECT count(DISTINCT trksub) AS n_labeled, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, (SELECT count(*) FROM log) AS n_outcomes FROM tr")
def growth_counts(spark, d):
    n = _log(spark, d).agg(F.count("*").alias("n_outcomes"))
    g = _training(spark, d).agg(F.countDistinct("trksub").alias("n_labeled"), F.count_if(F.col("y") == 1).alias("n_pos"), F.count_if(F.col("y") == 0).alias("n_neg"))
    return g.crossJoin(F.broadcast(n))  # one row each


@query(f"WITH {FIRST}, {TRK} SELECT f.trksub, f.score, nobs_tracklet, CASE WHEN sky_rate_deg_day > 1000 THEN round(sky_rate_deg_day, 0) ELSE round(sky_rate_deg_day, 4) END AS sky_rate_deg_day, d2_NEO_noid FROM first f LEFT JOIN trk ON f.trksub = trk.trksub LEFT JOIN d2 ON f.trksub = d2.trksub")
def feature_assembly(spark, d):
    t = O.feature_table(_features(spark, d), T.tracklet_features(view(spark, d, "obs")), view(spark, d, "d2").drop("obscode_first"))
    return t.select("trksub", "score", "nobs_tracklet", F.when(F.col("sky_rate_deg_day") > 1000, F.round("sky_rate_deg_day", 0)).otherwise(F.round("sky_rate_deg_day", 4)).alias("sky_rate_deg_day"), "d2_NEO_noid")


@query("WITH b AS (SELECT trksub, first(concat('X', CAST((trksub * 3 + line_no) % 500 AS VARCHAR)) ORDER BY t, line_no) AS desig FROM obs GROUP BY trksub) SELECT b.trksub, b.desig, d2_NEO_raw FROM b JOIN (SELECT concat('X', CAST(trksub AS VARCHAR)) AS desig, d2_NEO_raw FROM d2) s ON b.desig = s.desig")
def score_bridge(spark, d):
    scores = view(spark, d, "d2").select(F.concat(F.lit("X"), F.col("trksub")).alias("desig"), "d2_NEO_raw")
    obs = view(spark, d, "obs").withColumn("desig", F.concat(F.lit("X"), (F.col("trksub") * 3 + F.col("line_no")) % 500))
    return O.bridge_scores(scores, obs).select("trksub", "desig", "d2_NEO_raw")


@query("SELECT DISTINCT trksub FROM snap WHERE trksub NOT IN (SELECT trksub FROM obs WHERE trksub % 5 = 0) ORDER BY 1")
def worklist_missing(spark, d):
    return O.missing_work(view(spark, d, "snap"), view(spark, d, "obs").where("trksub % 5 = 0"))


@query("SELECT doc_id, source, count(*) OVER () AS n_matches FROM documents WHERE lower(text) LIKE '%the an%'")
def search_desig(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").where(F.contains(F.lower("text"), F.lit("the an"))).select("doc_id", "source")
    return docs.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n_matches"))))  # one row: the count


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN CAST(p_size AS DOUBLE) WHEN p_partkey % 6 = 5 THEN p_retailprice END AS x, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_brand END AS name, CASE WHEN p_size = 7 THEN 20.0 ELSE CAST(p_size AS DOUBLE) END AS filled FROM part")
def null_numeric(spark, d):
    k = F.col("p_partkey")
    forms = F.when(k % 6 == 0, F.col("p_size").cast("string")).when(k % 6 == 1, "None").when(k % 6 == 2, "").when(k % 6 == 3, "18.4d").when(k % 6 == 5, F.col("p_retailprice").cast("string"))
    alias = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, "None").otherwise("")
    gap = F.when(F.col("p_size") != 7, F.col("p_size"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", C.num(forms).alias("x"), C.first_nonempty(alias, "p_brand").alias("name"), C.filled(gap, 20.0).alias("filled"))


@query("SELECT o_orderkey, concat(CAST(year(o_orderdate) AS VARCHAR), '-', lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0'), '-', lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0'), '.5') AS disc, datediff('day', DATE '2000-01-01', CAST(o_orderdate AS DATE)) - CAST(0.5 AS DOUBLE) AS posting FROM orders")
def disc_date(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", C.disc_ymd(F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate") + 0.5).alias("disc"), C.posting_end(F.date_format("o_orderdate", "yyyyMMdd'T'HHmm")).alias("posting"))


# ---- metrics and splits ----

TH = "g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY p), th AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM g)"


def _point(w1: str = "1.0", w0: str = "1.0", target: float = 0.99, ceil: bool = True) -> str:
    need = f"ceil({target} * np)" if ceil else f"{target} * np"
    return f"""r AS (SELECT *, sum(CASE WHEN y = 1 THEN {w1} ELSE 0 END) OVER o AS tp, sum(CASE WHEN y = 0 THEN {w0} ELSE 0 END) OVER o AS fp, row_number() OVER o AS n FROM scored WINDOW o AS (ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING)), tot AS (SELECT max(tp) AS np, max(fp) AS nn FROM r), pt AS (SELECT * FROM r, tot WHERE tp >= {need} - 1e-9 ORDER BY n LIMIT 1)"""


POINT_OUT = "SELECT round(p, 6) AS threshold, round(tp / np, 6) AS recall, round((nn - fp) / nn, 6) AS excluded, round(tp / (tp + fp), 6) AS precision FROM pt"


@query(f"WITH {TH} SELECT round(sum(neg * (tp - pos / 2.0)) / sum(pos) / sum(neg), 6) AS roc_auc FROM th")
def roc_auc(spark, d):
    return rounded(M.roc_auc(view(spark, d, "scored")))


#: The best rising step function at a score: over all runs of scores around it, the largest of the least means.
ISOTONIC = """g AS (SELECT p, sum(y) AS total, count(*) AS w, row_number() OVER (ORDER BY p) AS i FROM scored GROUP BY p), c AS (SELECT *, sum(total) OVER (ORDER BY i) AS st, sum(w) OVER (ORDER BY i) AS sw FROM g),
means AS (SELECT a.i AS a, b.i AS b, (b.st - a.st + a.total) / CAST(b.sw - a.sw + a.w AS DOUBLE) AS mean FROM c a JOIN c b ON a.i <= b.i), least AS (SELECT a, b AS i, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM means), iso AS (SELECT i, max(m) AS value FROM least GROUP BY i)"""


@query(f"WITH {ISOTONIC} SELECT s.id, s.y, s.p, round(iso.value, 6) AS calibrated FROM scored s JOIN g ON s.p = g.p JOIN iso ON g.i = iso.i")
def isotonic_calibration(spark, d):
    rows = view(spark, d, "scored").select("id", "y", "p")
    return K.isotonic_apply(rows, K.isotonic_fit(rows)).select("id", "y", "p", F.round("calibrated", 6).alias("calibrated"))


@query(f"WITH {ISOTONIC}, t AS (SELECT round(iso.value, 6) AS value, g.* FROM g JOIN iso ON g.i = iso.i) SELECT value, min(p) AS lo, max(p) AS hi, CAST(sum(w) AS DOUBLE) AS weight FROM t GROUP BY value")
def isotonic_blocks(spark, d):
    return K.isotonic_fit(view(spark, d, "scored")).select(F.round("value", 6).alias("value"), "lo", "hi", "weight")


@query(f"WITH {TH} SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS average_precision FROM th")
def average_precision(spark, d):
    return rounded(M.average_precision(view(spark, d, "scored")))


@query(f"WITH {_point()} {POINT_OUT}")
def recall_point(spark, d):
    return rounded(M.recall_point(view(spark, d, "scored")))


@query(f"WITH pr AS (SELECT avg(y) AS a FROM scored), {_point('0.08 / (SELECT a FROM pr)', '0.92 / (1 - (SELECT a FROM pr))', ceil=False)} {POINT_OUT}")
def prior_shift(spark, d):
    return rounded(M.prior_shift(view(spark, d, "scored")))


@query("""WITH g AS (SELECT tag, p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY tag, p), th AS (SELECT *, sum(pos) OVER (PARTITION BY tag ORDER BY p DESC) AS tp, sum(neg) OVER (PARTITION BY tag ORDER BY p DESC) AS fp FROM g),
m AS (SELECT tag, CAST(sum(pos) + sum(neg) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS n_pos, round(sum(neg * (tp - pos / 2.0)) / sum(pos) / sum(neg), 6) AS roc_auc, round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS average_precision FROM th GROUP BY tag HAVING sum(pos) > 0 AND sum(neg) > 0),
r AS (SELECT tag, p, sum(y) OVER o AS tp, sum(1 - y) OVER o AS fp, row_number() OVER o AS i, sum(y) OVER (PARTITION BY tag) AS np, sum(1 - y) OVER (PARTITION BY tag) AS nn FROM scored WINDOW o AS (PARTITION BY tag ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING)),
pt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY i) AS k FROM r WHERE tp >= ceil(0.99 * np) - 1e-9) WHERE k = 1)
SELECT m.*, round(p, 6) AS threshold, round(tp / np, 6) AS recall, round((nn - fp) / nn, 6) AS excluded, round(tp / (tp + fp), 6) AS precision FROM m JOIN pt ON m.tag = pt.tag""")
def baseline_eval(spark, d):
    return rounded(M.evaluate(view(spark, d, "scored")))


@query("WITH r AS (SELECT p, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS n FROM scored WHERE y = 1) SELECT coalesce(max(p), 0) AS threshold FROM r WHERE k = greatest(floor((n + 1) * 0.05) - 1, 0) + 1")
def conformal_threshold(spark, d):
    return M.conformal_threshold(view(spark, d, "scored"), 0.05)


HASH = "(id * 2654435761 + rep * 40503) % 1000003"


@query(f"""WITH s AS (SELECT scored.*, rep FROM scored, range(0, 40) t(rep)), h AS (SELECT *, row_number() OVER (PARTITION BY rep, y ORDER BY {HASH}, id) % 2 AS half FROM s),
c AS (SELECT rep, p, row_number() OVER (PARTITION BY rep ORDER BY p, id) AS k, count(*) OVER (PARTITION BY rep) AS n FROM h WHERE half = 0 AND y = 1), t AS (SELECT rep, max(p) AS threshold FROM c WHERE n >= 5 AND k = greatest(floor((n + 1) * 0.1) - 1, 0) + 1 GROUP BY rep),
e AS (SELECT h.rep, max(threshold) AS threshold, avg(CASE WHEN y = 1 THEN (p >= threshold)::INT END) AS recall, avg(CASE WHEN y = 0 THEN (p < threshold)::INT END) AS excluded FROM h JOIN t ON h.rep = t.rep WHERE half = 1 GROUP BY h.rep)
SELECT count(*) AS n_splits, round(avg(recall), 6) AS recall_mean, round(stddev_pop(recall), 6) AS recall_std, round(avg(excluded), 6) AS excluded_mean, round(stddev_pop(excluded), 6) AS excluded_std, round(avg(threshold), 6) AS threshold_mean, round(stddev_pop(threshold), 6) AS threshold_std FROM e""")
def conformal_repeated(spark, d):
    return rounded(M.conformal_repeated(view(spark, d, "scored"), 0.1))


@query("SELECT id, row_number() OVER (ORDER BY disc, id) <= floor(0.75 * count(*) OVER ()) AS is_train FROM scored")
def time_split(spark, d):
    return M.time_split(view(spark, d, "scored")).select("id", "is_train")


FOLDS = f"s AS (SELECT scored.*, rep FROM scored, range(0, 6) t(rep)), f AS (SELECT *, CAST((row_number() OVER (PARTITION BY rep, y ORDER BY {HASH}, id) - 1) % 5 AS INT) AS fold FROM s)"


@query(f"WITH {FOLDS} SELECT rep, fold, y, count(*) AS n FROM f GROUP BY rep, fold, y")
def kfold_counts(spark, d):
    return M.stratified_folds(view(spark, d, "scored")).groupBy(F.col("rep").cast("long").alias("rep"), "fold", "y").agg(F.count("*").alias("n"))


@query("WITH h AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY id * 2654435761 % 1000003, id) AS k, count(*) OVER (PARTITION BY y) AS n FROM scored) SELECT id, y, k > floor(n * 0.75) AS is_test FROM h")
def stratified_holdout(spark, d):
    return M.stratified_holdout(view(spark, d, "scored"), 0.25).select("id", "y", "is_test")


@query("WITH h AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY id * 2654435761 % 1000003, id) AS k FROM scored) SELECT id, y FROM h WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM scored GROUP BY y))")
def class_balance(spark, d):
    return M.balance_classes(view(spark, d, "scored")).select("id", "y")


@query(f"WITH {FOLDS}, g AS (SELECT fold, p, sum(y) AS pos, sum(1 - y) AS neg FROM f WHERE rep = 0 GROUP BY fold, p), th AS (SELECT *, sum(pos) OVER (PARTITION BY fold ORDER BY p DESC) AS tp FROM g), a AS (SELECT fold, sum(neg * (tp - pos / 2.0)) / sum(pos) / sum(neg) AS auc FROM th GROUP BY fold) SELECT round(avg(auc), 6) AS auc_mean, round(stddev_pop(auc), 6) AS auc_std, count(auc) AS n_folds FROM a")
def cv_summary(spark, d):
    return rounded(M.cv_summary(M.stratified_folds(view(spark, d, "scored"), reps=1)))


@query("SELECT lang, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL GROUP BY lang")
def labeled_only(spark, d):
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    return docs.select("doc_id", "lang").join(labels.where(F.col("quality").isNotNull()), "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


SITE = "sf AS (SELECT coalesce(obscode_first, '') AS obscode_first, count(*) / (SELECT count(*) FROM d2) AS site_freq FROM d2 GROUP BY 1)"
BELT = " + ".join(f"coalesce(d2_{m}_noid, 0)" for m in C.MAIN_BELT)


@query(f"WITH {SITE} SELECT obscode_first, round(site_freq, 6) AS site_freq FROM sf")
def site_frequency(spark, d):
    return rounded(M.site_frequency(view(spark, d, "d2")))


@query(f"WITH {SITE} SELECT trksub, {BELT} AS mb_sum, d2_NEO_noid - ({BELT}) AS neo_minus_mb, d2_NEO_noid - d2_NEO_raw AS noid_minus_raw, d2_NEO_noid - d2_MC_noid AS neo_minus_mc, " + ", ".join(f"CAST(coalesce(d2.obscode_first, '') = '{x}' AS INT)::DOUBLE AS site_{x}" for x in C.SITES) + f", round(site_freq, 6) AS site_freq FROM d2 JOIN sf ON coalesce(d2.obscode_first, '') = sf.obscode_first")
def augment_features(spark, d):
    v = view(spark, d, "d2")
    return rounded(ML.augment(v, M.site_frequency(v)).select("trksub", "mb_sum", "neo_minus_mb", "noid_minus_raw", "neo_minus_mc", *[f"site_{x}" for x in C.SITES], "site_freq"))


# ---- images ----

SM = "sm AS (SELECT a.subject, a.frame, a.r, a.c, a.v, sum(b.v) / 9 AS sm FROM pix a JOIN pix b ON a.subject = b.subject AND a.frame = b.frame AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY ALL)"
BLOB = f"{SM}, md AS (SELECT subject, frame, median(v) AS med FROM pix GROUP BY ALL), ma AS (SELECT p.subject, p.frame, any_value(med) AS med, median(abs(v - med)) + 1e-6 AS mad FROM pix p JOIN md ON p.subject = md.subject AND p.frame = md.frame GROUP BY ALL), bk AS (SELECT *, row_number() OVER (PARTITION BY subject, frame ORDER BY round(sm, 12) DESC, r, c) AS k FROM sm), blob AS (SELECT bk.subject, bk.frame, r - 4 AS r, c - 4 AS c, (sm - med) / (1.4826 * mad) AS snr, sm - med AS flux FROM bk JOIN ma ON bk.subject = ma.subject AND bk.frame = ma.frame WHERE k = 1)"
MOT = f"""{BLOB}, st AS (SELECT *, snr > 1 AS det, sqrt(pow(r - lag(r) OVER o, 2) + pow(c - lag(c) OVER o, 2)) AS step FROM blob WINDOW o AS (PARTITION BY subject ORDER BY frame)),
o1 AS (SELECT subject, count(*) FILTER (det) AS n, regr_slope(r, frame) FILTER (det) AS rs, regr_intercept(r, frame) FILTER (det) AS ri, regr_slope(c, frame) FILTER (det) AS cs, regr_intercept(c, frame) FILTER (det) AS ci, stddev_pop(step) / (avg(step) + 1e-6) AS step_cv, max(step) AS max_step_px, min(snr) AS min_snr, avg(snr) AS mean_snr,
coalesce(stddev_pop(flux) FILTER (det), stddev_pop(flux)) / (abs(coalesce(avg(flux) FILTER (det), avg(flux))) + 1e-6) AS flux_cv FROM st GROUP BY subject),
o2 AS (SELECT st.subject, sqrt(avg(pow(r - ri - rs * frame, 2) + pow(c - ci - cs * frame, 2))) AS rms FROM st JOIN o1 ON st.subject = o1.subject WHERE det GROUP BY st.subject),
mot AS (SELECT o1.subject, n AS n_detected, CASE WHEN n >= 3 THEN rms END AS linearity_rms, CASE WHEN n >= 3 THEN sqrt(rs * rs + cs * cs) END AS rate_px_frame, step_cv, flux_cv, max_step_px, min_snr, mean_snr FROM o1 LEFT JOIN o2 ON o1.subject = o2.subject)"""


@query("""WITH rgb AS (SELECT subject, frame, r, c, floor((v + 0.6) * 200) AS R1, CASE WHEN (r * 8 + c) % 17 = 3 THEN 250.0 ELSE floor((v + 0.6) * 190) END AS G1, floor((v + 0.6) * 180) AS B1 FROM pix), g AS (SELECT *, (R1 + G1 + B1) / 3 AS v FROM rgb), m AS (SELECT subject, frame, median(v) AS med FROM g GROUP BY ALL)
SELECT g.subject, g.frame, r, c, round(CASE WHEN G1 > 1.4 * R1 + 20 AND G1 > 1.4 * B1 + 20 THEN med ELSE v END, 6) AS v FROM g JOIN m ON g.subject = m.subject AND g.frame = m.frame WHERE r BETWEEN 2 AND 5 AND c BETWEEN 2 AND 5""")
def frame_clean(spark, d):
    p, v = view(spark, d, "pix"), F.col("v") + 0.6
    rgb = p.select("subject", "frame", "r", "c", F.floor(v * 200).cast("double").alias("red"), F.when((F.col("r") * 8 + F.col("c")) % 17 == 3, 250.0).otherwise(F.floor(v * 190).cast("double")).alias("green"), F.floor(v * 180).cast("double").alias("blue"))
    return rounded(I.clean_frames(rgb, crop=4))


@query("WITH s AS (SELECT subject, avg(v) AS m, stddev_pop(v) AS sd FROM pix GROUP BY subject) SELECT p.subject, frame, r, c, round((v - m) / (sd + 1e-6), 6) AS v FROM pix p JOIN s ON p.subject = s.subject")
def frame_standardize(spark, d):
    return rounded(I.standardize(view(spark, d, "pix")))


@query(f"WITH {SM} SELECT subject, frame, r, c, round(sm, 6) AS sm FROM sm")
def box_smooth(spark, d):
    return rounded(I.box_smooth(view(spark, d, "pix")).select("subject", "frame", "r", "c", "sm"))


@query(f"WITH {BLOB} SELECT subject, frame, r, c, round(snr, 5) AS snr, round(flux, 5) AS flux FROM blob")
def blob_peak(spark, d):
    return rounded(I.blob_peaks(view(spark, d, "pix"), search=4), 5)


@query(f"WITH {MOT} SELECT subject, n_detected, round(linearity_rms, 4) AS linearity_rms, round(rate_px_frame, 4) AS rate_px_frame, round(step_cv, 4) AS step_cv, round(flux_cv, 4) AS flux_cv, round(max_step_px, 4) AS max_step_px, round(min_snr, 4) AS min_snr, round(mean_snr, 4) AS mean_snr FROM mot")
def motion_features(spark, d):
    return rounded(I.motion_features(I.blob_peaks(view(spark, d, "pix"), search=4), least_snr=1.0), 4)


@query(f"WITH {MOT} SELECT subject, round(CASE WHEN n_detected < 3 OR linearity_rms IS NULL THEN 0.15 ELSE least(0.99, greatest(0.01, exp(-greatest(linearity_rms - 2, 0) / 6) * exp(-greatest(step_cv - 0.25, 0) / 0.5) * exp(-greatest(flux_cv - 0.6, 0)) * CASE WHEN rate_px_frame < 1 THEN 0.3 ELSE 1 END)) END, 4) AS score FROM mot")
def motion_heuristic(spark, d):
    m = I.motion_features(I.blob_peaks(view(spark, d, "pix"), search=4), least_snr=1.0)
    return m.select("subject", F.round(I.motion_score(), 4).alias("score"))


@query("""WITH p AS (SELECT subject * 4 + frame AS trksub, r, c, CASE WHEN (r * 8 + c + subject) % 19 = 0 THEN NULL ELSE v END AS v FROM pix), m AS (SELECT trksub, median(v) AS med FROM p GROUP BY trksub), q AS (SELECT p.*, med, sqrt(pow(r - 4, 2) + pow(c - 4, 2)) AS rc, greatest(v - med, 0) AS up FROM p JOIN m ON p.trksub = m.trksub)
SELECT trksub, CASE WHEN count(v) >= 50 AND max(v) - min(v) >= 1e-3 THEN 1 ELSE 0 END AS has_cutout, round((max(v) FILTER (rc <= 5) - any_value(med)) / (median(abs(v - med)) * 1.4826 + 1e-6), 5) AS snr, round(sum(up) FILTER (rc <= 5 AND v IS NOT NULL), 5) AS pos_flux, round(sum(up) FILTER (rc <= 1.5 AND v IS NOT NULL) / (sum(up) FILTER (rc <= 2.5 AND v IS NOT NULL) + 1e-6), 5) AS compactness, round(avg((v < med)::INT) FILTER (rc <= 5 AND v IS NOT NULL), 5) AS neg_frac, round(avg((v IS NULL)::INT), 5) AS masked_frac, round(median(abs(v - med)) * 1.4826 + 1e-6, 5) AS bkg_mad FROM q GROUP BY trksub""")
def cutout_features(spark, d):
    p = view(spark, d, "pix").select((F.col("subject") * 4 + F.col("frame")).alias("trksub"), "r", "c", F.when((F.col("r") * 8 + F.col("c") + F.col("subject")) % 19 != 0, F.col("v")).alias("v"))
    return rounded(I.cutout_features(p, least=50), 5)


@query("WITH a AS (SELECT vec_id AS subject, label AS y FROM embeddings WHERE vec_id % 7 > 0), b AS (SELECT vec_id AS subject, label + CASE WHEN vec_id % 50 = 1 THEN 1 ELSE 0 END AS y FROM embeddings WHERE vec_id % 5 > 0), j AS (SELECT a.y AS ya, b.y AS yb, a.subject AS sa, b.subject AS sb FROM a FULL JOIN b ON a.subject = b.subject) SELECT count(*) FILTER (sa IS NULL OR sb IS NULL) AS unmatched, count(*) FILTER (sa IS NOT NULL AND sb IS NOT NULL AND ya <> yb) AS differing, count(*) FILTER (sa IS NULL OR sb IS NULL OR ya <> yb) = 0 AS aligned FROM j")
def alignment_guard(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("subject"), F.col("label").alias("y"))
    other = e.where("subject % 5 > 0").withColumn("y", F.col("y") + F.when(F.col("subject") % 50 == 1, 1).otherwise(0))
    return I.alignment_guard(e.where("subject % 7 > 0"), other)


# ---- streams: each equals its batch twin ----

def _stream(spark, d, name: str, text: str) -> DataFrame:
    """A view over a table that is read as a stream of its files."""
    static = spark.read.parquet(f"{d}/{name}.parquet")
    rows = spark.readStream.schema(static.schema).parquet(f"{d}/{name}.parquet*")
    return spark.sql(text.replace(f"FROM {name}", "FROM {rows}"), rows=rows)


def _snap_stream(spark, d) -> DataFrame:
    return _stream(spark, d, "events", VIEWS["snap"]).withColumn("stamp", F.col("stamp").cast("timestamp"))


def _stream_path(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@query(f"WITH {FIRST} SELECT trksub, stamp, tie, score FROM first")
def stream_first_posting(spark, d):
    out = ST.first_postings(_snap_stream(spark, d), _stream_path(spark), days=5)
    return out.select("trksub", F.col("stamp").cast("timestamp_ntz").alias("stamp"), "tie", "score")


@query(f"WITH {EV} {EV_OUT}")
def stream_evolution(spark, d):
    return rounded(ST.evolutions(_snap_stream(spark, d), _stream_path(spark), days=5))


@query("SELECT DISTINCT trksub, outcome_class, designation FROM event")
def stream_outcome_log(spark, d):
    """A log that holds a third of the outcomes, and a stream of all of them."""
    path, rows = _stream_path(spark), view(spark, d, "event").select(*O.KEY)
    L.start_log(rows.where("trksub % 3 = 0"), f"{path}/log", O.KEY)
    L.append_stream(_stream(spark, d, "orders", VIEWS["event"]).select(*O.KEY), f"{path}/log", O.KEY, "feed", f"{path}/state")
    return L.read_log(spark, f"{path}/log", rows.schema, O.KEY)


@query("SELECT DISTINCT trksub, outcome_class, designation FROM event")
def stream_outcome_dedup(spark, d):
    return ST.drain(ST.outcome_stream(_stream(spark, d, "orders", VIEWS["event"]), O.KEY).select(*O.KEY))


@query(f"SELECT s.trksub, tie, c_mktsegment, {STATUS} AS followup_status, round({SIZE}, 3) AS size_m FROM snap s LEFT JOIN customer ON trksub = c_custkey")
def stream_enriched(spark, d):
    static = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("trksub"), "c_mktsegment")
    out = ST.drain(ST.enriched_stream(_snap_stream(spark, d), static))
    return out.select("trksub", "tie", "c_mktsegment", "followup_status", F.round("size_m", 3).alias("size_m"))


@query("""WITH g AS (SELECT CAST(date_trunc('day', stamp) AS TIMESTAMP) AS day, count(*) AS n_rows, round(avg(unseen), 6) AS mean_unseen, max(score) AS top_score FROM snap GROUP BY 1), f AS (SELECT CAST(date_trunc('day', t) AS TIMESTAMP) AS day, count(*) AS n_new FROM (SELECT min(stamp) AS t FROM snap GROUP BY trksub) GROUP BY 1)
SELECT g.*, coalesce(n_new, 0) AS n_new FROM g LEFT JOIN f USING (day) WHERE day + INTERVAL 1 DAY <= (SELECT max(stamp) - INTERVAL 2 DAY FROM snap)""")
def stream_daily_window(spark, d):
    out = ST.drain(ST.daily_stream(_snap_stream(spark, d), key="trksub"))
    return rounded(out.withColumn("day", F.col("day").cast("timestamp_ntz")))


# ---- models: no SQL says them ----


@query("SELECT vec_id AS id, len(embedding) AS n_img, round(list_sum(embedding::DOUBLE[]), 5) AS s_img, round(list_sum(embedding[1:8]::DOUBLE[]), 5) AS s_mot FROM embeddings")
def matrix_vectors(spark, d):
    from pyspark.ml.functions import vector_to_array

    rows = R.matrix_vectors(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").alias("x_img"), F.slice("embedding", 1, 8).alias("x_mot")), ("x_img", "x_mot"))
    total = lambda c: F.round(F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, x: a + x), 5)
    return rows.select(F.col("vec_id").alias("id"), F.size(vector_to_array("x_img")).cast("long").alias("n_img"), total("x_img").alias("s_img"), total("x_mot").alias("s_mot"))


@query()
def image_comparison(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    rows = e.select(F.col("vec_id").alias("id"), (F.col("label") % 2).cast("long").alias("y"), (F.col("label") / 10.0 + F.col("vec_id") % 7 / 10.0).alias("d2"), F.col("embedding").alias("x_img"), F.slice("embedding", 1, 8).alias("x_mot"))
    scored = ML.compare_vectors(R.matrix_vectors(rows, ("x_img", "x_mot")), rounds=2)
    by_seed = M.roc_auc(scored.withColumn("by", F.struct("tag", "seed")), "by")
    return rounded(by_seed.groupBy(F.col("by.tag").alias("tag")).agg(F.count("roc_auc").alias("n_seeds"), F.avg("roc_auc").alias("auc_mean"), F.stddev_pop("roc_auc").alias("auc_std")))


@query()
def oof_conformal(spark, d):
    return rounded(ML.oof_conformal(_model_rows(spark, d), COLS, 0.1))


@query()
def queue_by_model(spark, d):
    """The later quarter of rows as the queue, by a model of the rows before it."""
    rows = M.time_split(_model_rows(spark, d).withColumn("disc", F.col("id")))
    return rounded(ML.score_queue(rows.where("NOT is_train"), ML.fit_vetting(rows.where("is_train"), COLS, small=True), COLS).select("id", "p"))


COLS = ["a", "b", "c"]


def _model_rows(spark, d) -> DataFrame:
    s = view(spark, d, "scored")
    return s.select("id", "y", F.col("p").alias("a"), (F.col("disc") / 1000.0).alias("b"), F.when(F.col("id") % 9 != 0, (F.col("y") * 0.3 + F.col("id") % 10 / 10.0)).alias("c"))


@query()
def logistic_scores(spark, d):
    rows = M.time_split(_model_rows(spark, d).withColumn("disc", F.col("id")))
    return rounded(ML.scored(rows.where("NOT is_train"), ML.fit_vetting(rows.where("is_train"), COLS, small=True), COLS))


@query()
def dropout_boosting_scores(spark, d):
    rows = M.time_split(_model_rows(spark, d).withColumn("disc", F.col("id")))
    model = B.fit_boosted(rows.where("is_train"), COLS, B.Options(rounds=24, rate=0.2))
    return rounded(B.boosted_scores(rows.where("NOT is_train"), model))


@query()
def gbt_scores(spark, d):
    rows = M.time_split(_model_rows(spark, d).withColumn("disc", F.col("id")))
    model = ML.fit_vetting(rows.where("is_train"), COLS, small=False, rounds=10)
    return rounded(ML.scored(rows, model, COLS))


@query()
def oof_scores(spark, d):
    return rounded(ML.oof_scores(_model_rows(spark, d), COLS))


def _fused(spark, d, **how) -> DataFrame:
    own = _model_rows(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 100 / 100.0).alias("logit"))
    return rounded(ML.late_fusion(docs.join(own.select("id", "y"), "id"), own, [*COLS, "logit"], zero_is_missing=("a",), **how))


@query()
def fusion_scores(spark, d):
    return _fused(spark, d)


@query()
def fusion_boosted(spark, d):
    return _fused(spark, d, boosted=B.Options(rounds=12, rate=0.2, depth=3, leaves=8, l2=1.0, columns=1.0, dropout=0.0))


@query()
def model_comparison(spark, d):
    return rounded(M.evaluate(ML.compare_models(_model_rows(spark, d), {"score": ["a"], "motion": ["b"], "fused": COLS})))
