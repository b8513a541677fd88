import json
import os

import pytest
from nightqueue.functions import columns as C
from nightqueue.operators import metrics as M, models as ML, outcomes as O, snapshots as S
from nightqueue.sources import readers as R
from nightqueue.streaming import streams as ST
from pyspark.sql import functions as F

ROW = {"Temp_Desig": "XAaiiXA", "Score": 99, "Discovery_year": 2026, "Discovery_month": 8, "Discovery_day": 19.7, "R.A.": 21.7739, "Decl.": 0.8538, "V": 21.4, "Updated": "Added Aug. 19.77 UT", "NObs": 3, "Arc": 0.02, "H": 21.3, "Not_Seen_dys": 0.044}
GOOD = "     6H33A21*KC2026 08 04.16151 20 05 05.58 -06 10 31.9          18.2 GVNEOCPW94"
NO_MAG = "     6H33A21 4C2026 08 04.20863 20 05 24.51 -06 03 42.6                qNEOCPW97"
SHORT = "8N8R001*KB2026 07 05.90778917 12 19.634-05 05 17.77         19.0 GXNEOCPK19"
BAD = ["     K18V03Q  s2018 12 15.73610 1 + 6125.3592 + 2582.6663 - 1703.7093   ~2rAXC51", "     K26K02T  v2026 05 28.1463671 253.27893  +32.28259      1           EK123270", "short", ""]


def test_snapshots_by_file_and_stream(spark, tmp_path):
    for stamp, rows in (("20260819T1833", [ROW]), ("20260820T0605", [ROW | {"NObs": 5, "Note": "x"}, ROW | {"Temp_Desig": "B"}])):
        (tmp_path / f"neocp_{stamp}.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "neocp_bad.json").write_text(json.dumps([ROW]))
    df = R.read_snapshots(spark, str(tmp_path))
    assert df.count() == 3 and df.where("trksub = 'B'").first()["ra_h"] == 21.7739
    rows = S.first_posting(df.withColumn("tie", F.lit(0))).collect()
    assert {r["trksub"]: (r["nobs"], r["latest_nobs"]) for r in rows} == {"XAaiiXA": (3, 5), "B": (3, 3)}
    out = ST.first_postings(R.stream_snapshots(spark, str(tmp_path)).withColumn("tie", F.lit(0)), str(tmp_path / "rolled"))
    assert {r["trksub"]: r["nobs"] for r in out.collect()} == {"XAaiiXA": 3, "B": 3}


def test_observation_lines(spark, tmp_path):
    (tmp_path / "T1.obs80").write_text("\r\n".join([GOOD, NO_MAG, SHORT, *BAD]))
    lines = R.read_obs_lines(spark, str(tmp_path), "api")
    got = R.parse_obs80(lines, keep=("trksub", "line_no")).orderBy("line_no").collect()
    assert [r["obscode"] for r in got] == ["W94", "W97", "K19"] and [r["mag"] for r in got] == [18.2, None, 19.0]
    assert got[0]["trksub"] == "T1" and got[0]["dec"] == pytest.approx(-(6 + 10 / 60 + 31.9 / 3600))
    t = spark.range(1).select(C.t_days(F.lit(2026), F.lit(5), F.lit(23.05095)).alias("t")).first()["t"]
    assert t == pytest.approx(9639.05095)


def test_outcome_lines(spark, tmp_path):
    said = ["2026 NE1 = P12o0Y2 (July 10.68 UT) [MPEC 2026-N53]", "2026 NF1 = P12nXcB (July 10.65 UT)", "A11Eq8v = A11Evav (July 10.15 UT)", "Comet P/2021 N1 = A11E5qv (June 26.57 UT)", "A11E7px was not a minor planet (June 26.86 UT)"]
    (tmp_path / "prev_20260710.txt").write_text("\n".join([*said, "", "unknown line", said[1]]))
    got = O.rebuild_outcomes(R.read_outcome_files(spark, str(tmp_path))).collect()
    assert {(r["trksub"], r["outcome_class"], r["designation"], r["mpec"]) for r in got} == {("P12o0Y2", "neo", "2026 NE1", "2026-N53"), ("P12nXcB", "designated_other", "2026 NF1", None), ("A11Evav", "linked", "A11Eq8v", None), ("A11E5qv", "comet", "Comet P/2021 N1", None), ("A11E7px", "was_not_a_minor_planet", "", None)}


def test_append_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("a", "neo", "1"), ("a", "neo", "1"), ("b", "comet", None)], "trksub string, outcome_class string, designation string")
    path = str(tmp_path / "log")
    df.limit(0).write.parquet(path)
    for _ in range(2):
        R.append_new(df, path, O.KEY)
    assert spark.read.parquet(path).count() == 2


def test_tables_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 0)], "b int, trksub string, y int")
    R.write_table(df, str(tmp_path / "t"), "csv")
    assert spark.read.csv(str(tmp_path / "t"), header=True).columns == ["trksub", "y", "b"]
    R.write_report(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 1


def test_risk_and_links(spark, tmp_path):
    (tmp_path / "risk.json").write_text(json.dumps({"data": [{"des": "1", "ip": "1e-3", "ps_cum": "-2.5"}, {"des": "2", "ip": None, "ps_cum": "x"}]}))
    got = R.read_risk(spark, str(tmp_path / "risk.json")).orderBy("des").collect()
    assert [(r["ip_cum"], r["ps_cum"]) for r in got] == [(0.001, -2.5), (0.0, -99.0)]
    (tmp_path / "links.txt").write_text("A|2026 A1|2026-N1|http://x\n")
    assert R.read_links(spark, str(tmp_path / "links.txt")).first()["mpec"] == "2026-N1"


def test_angle_wrap_is_periodic(spark):
    rows = spark.range(-50, 50).select((F.col("id") * 17.3).alias("x"))
    assert rows.where(F.abs(C.wrap180("x") - C.wrap180(F.col("x") + 360)) > 1e-9).count() == 0


def test_recall_reaches_its_target_in_any_row_order(spark):
    rows = [(i, i * 7 % 3 % 2, (i * 37 % 101) / 101) for i in range(300)]
    a = M.recall_point(spark.createDataFrame(rows, "id long, y int, p double"), 0.9).first()
    b = M.recall_point(spark.createDataFrame(rows[::-1], "id long, y int, p double").repartition(7), 0.9).first()
    assert a == b and a["recall"] >= 0.9


def test_models_choose_by_size(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 2, float(i % 2) + (i % 7) / 7, None if i % 5 == 0 else 1.0) for i in range(60)], "id long, y int, a double, b double")
    model = ML.fit_vetting(rows, ["a", "b"])
    model.write().overwrite().save(str(tmp_path / "m"))
    from pyspark.ml import PipelineModel

    again = ML.scored(rows, PipelineModel.load(str(tmp_path / "m")), ["a", "b"])
    assert again.where("p >= 0 AND p <= 1").count() == 60
    assert ML.model_columns(rows.withColumn("d2_x", F.lit(1)), ("a",)) == ["a", "d2_x"]


def test_rebuild_overwrites_and_quarantines(spark, tmp_path):
    lines = spark.createDataFrame([(0, "2026 NE1 = P1 (July 10.68 UT) [MPEC 2026-N53]"), (1, "no form at all"), (2, "X=Y2 (a=b UT)"), (3, "Comet = P3 (July 1 UT)"), (4, "- P4 does not exist(July 1 UT)"), (5, "2026 (AB) = P5 (July UT) see MPEC* [2026-A12]")], "line_no int, line string").withColumn("stamp", F.lit("20260710"))
    for _ in range(2):
        R.write_outcome_log(lines, str(tmp_path / "log"), str(tmp_path / "odd"))
    got = {(r["trksub"], r["outcome_class"], r["designation"], r["mpec"]) for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert got == {("P1", "neo", "2026 NE1", "2026-N53"), ("Y2", "linked", "X", None), ("P3", "linked", "Comet", None), ("P4", "does_not_exist", "", None), ("P5", "neo", "2026 (AB)", "2026-A12")}
    assert [r["line"] for r in spark.read.parquet(str(tmp_path / "odd")).collect()] == ["no form at all"]


def test_pages_cut_at_tags(spark):
    pages = spark.createDataFrame([(1, "<ul><LI class=x>a (1 UT)</li><b>b</b> (2 UT)<br/>c < d (3 UT)\r\ne (4 UT)"), (2, "<p>nothing</p>"), (3, None)], "page int, value string")
    lines = R.outcome_lines(pages, keep=("page",))
    assert [r["line"] for r in lines.orderBy("page", "line_no").collect()] == ["a (1 UT)", "b (2 UT)", "c < d (3 UT)", "e (4 UT)"]
    assert {(r["page"], r["n_lines"], r["suspect"]) for r in R.page_quality(pages, lines).collect()} == {(1, 4, False), (2, 0, True), (3, 0, True)}


def test_lines_that_name_their_object(spark):
    rows = [("T1", "T1 " + "x" * 40), ("T1", "T2 " + "x" * 40), ("T1", "T1 short" + " " * 60), (None, "x" * 50)]
    assert R.mentions(spark.createDataFrame(rows, "trksub string, raw string")).count() == 1
    code = spark.createDataFrame([("a" * 72 + "I41",), ("a" * 77 + "703",), ("short",)], "raw string").select(R.short_line_site().alias("s"))
    assert [r["s"] for r in code.collect()] == ["I41", "703", None]


def test_frames_with_metadata(spark, tmp_path):
    import struct
    import zlib

    def png(path, pixels):
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        raw = b"".join(b"\0" + b"".join(bytes(p) for p in row) for row in pixels)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))

    for subject, n in (("s1", 4), ("s2", 3), ("s3", 4)):
        for k in range(n):
            png(tmp_path / subject / f"frame_{k}.png", [[(10 * k, 1, 2), (3, 4, 5)], [(6, 7, 8), (250, 251, 252)]])
    meta = spark.createDataFrame([("s1", 1), ("s2", 0)], "subject string, y int")
    got = R.read_frames(spark, f"{tmp_path}/*", meta).collect()
    assert len(got) == 16 and {r["subject"] for r in got} == {"s1"} and {r["y"] for r in got} == {1}
    assert {(r["red"], r["green"], r["blue"]) for r in got if r["frame"] == 2} == {(20, 1, 2), (3, 4, 5), (6, 7, 8), (250, 251, 252)}
    assert R.read_frames(spark, f"{tmp_path}/*").select("subject").distinct().count() == 2


def test_late_rows_are_left_out_of_closed_days(spark, tmp_path):
    rows = [[("2026-01-01 10:00:00", 1.0, 5), ("2026-01-01 11:00:00", 3.0, 9)], [("2026-01-09 00:00:00", 1.0, 1)], [("2026-01-09 01:00:00", 1.0, 1)], [("2026-01-01 12:00:00", 9.0, 99)], [("2026-01-20 00:00:00", 1.0, 1)]]
    schema = "stamp timestamp, unseen double, score int"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "stamp string, unseen double, score int").select(F.col("stamp").cast("timestamp"), "unseen", "score").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        for f in (tmp_path / f"in/{i}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + 60 * i,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = {str(r["day"])[:10]: (r["n_rows"], r["mean_unseen"], r["top_score"]) for r in ST.drain(ST.daily_stream(stream)).collect()}
    assert got == {"2026-01-01": (2, 2.0, 9), "2026-01-09": (2, 1.0, 1)}


def test_guard_drops_a_backfill_that_tells_the_label(spark):
    own = spark.createDataFrame([("a", 1), ("b", 0)], "trksub string, y int")
    back = spark.createDataFrame([("c", 1, "backfill", 50), ("a", 1, "backfill", 9)], "trksub string, y int, source string, d2_NEO_noid int")
    assert O.training_frame(own, back).count() == 3
    assert {r["source"] for r in O.training_frame(own, back, "d2_NEO_noid").collect()} == {"capture"}
    both = back.union(spark.createDataFrame([("d", 0, "backfill", 7)], back.schema))
    assert O.training_frame(own, both, "d2_NEO_noid").count() == 4


def test_out_of_fold_scores_and_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 2, float(i % 2) + (i % 7) / 7, None if i % 5 == 0 else 1.0, "G96") for i in range(90)], "id long, y int, a double, b double, obscode_first string")
    got = ML.oof_scores(rows, ["a", "b"]).collect()
    assert sorted(r["id"] for r in got) == list(range(90)) and {r["fold"] for r in got} == {0, 1, 2}
    again = ML.oof_scores(rows.orderBy(F.desc("id")).repartition(5), ["a", "b"]).collect()
    assert {(r["id"], round(r["p"], 6)) for r in got} == {(r["id"], round(r["p"], 6)) for r in again}
    auc = M.roc_auc(spark.createDataFrame(got)).first()[0]
    assert auc > M.roc_auc(rows.select("id", "y", (F.col("id") % 7 / 7.0).alias("p"))).first()[0] + 0.2
    ML.save_artifact(str(tmp_path / "m"), ML.fit_vetting(rows, ["a", "b"]), ["a", "b"], M.site_frequency(rows), 90, "small")
    model, cols, freq = ML.load_artifact(spark, str(tmp_path / "m"))
    assert ML.score_queue(rows, model, cols).where("p BETWEEN 0 AND 1").count() == 90 and freq.first()["site_freq"] == 1.0


def test_recovered_numbers_keep_their_exponents(spark):
    text = '{"Temp_Desig": "P1", "Score": 1e-5, "V": -2.5E+3, "Arc": null} {"Temp_Desig": "P2", "Score": 7, "V": 1.5e2'
    got = R.recover_feed(spark.createDataFrame([("f", text)], "file string, value string"), ["Temp_Desig", "Score", "V", "Arc"]).orderBy("Temp_Desig").collect()
    assert [tuple(r)[-4:] for r in got] == [("P1", "1e-5", "-2.5E+3", None), ("P2", "7", "1.5e2", None)]


def test_positions_of_plain_feeds(spark):
    good = "P1 99 2024 01 05.3 10.5 -4.25 20.1 Added Jan. 6 UT 4 0.5 22.1 1.25"
    lines = [good, good.replace("-4.25", "south"), good.replace(" 4 0.5", " four 0.5"), "P2 too short", "", None]
    got = R.parse_feed_positions(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [tuple(r) for r in got] == [("P1", 99, 157.5, -4.25, 20.1, 4, 0.5, 22.1, 1.25)]


def test_keyword_is_a_label_where_there_is_no_other(spark):
    rows = [(True, "rjct"), (None, "normal"), (None, "rjct"), (None, "odd"), (None, None), (False, None)]
    df = spark.createDataFrame(rows, "is_real boolean, keyword string")
    assert [r[0] for r in df.select(C.vetted_label("is_real", "keyword")).collect()] == [1, 1, 0, None, None, 0]


def test_the_first_fitting_sign_parts_designation_and_object(spark):
    lines = ["2024 AB = P1 (Jan. 5.1 UT)", "A = B = P2 (Jan. 5.1 UT) = x", "A = B = P3 (that)", "A = B = P4 (one = two)"]
    got = O.classify_outcomes(spark.createDataFrame([(x,) for x in lines], "line string")).select("trksub", "designation").collect()
    assert [tuple(r) for r in got] == [("P1", "2024 AB"), ("P3", "A = B"), ("P4", "A = B")]


def test_feeds_in_splits_equal_feeds_in_one_cell(spark, tmp_path):
    """Records across the borders of splits, keys before the first record, repeated keys, no closing quote at the end."""
    record = lambda i: f'{{"Temp_Desig"\n: "P{i:05d}", "Score":\r\n\t{i % 101},\n "Note" :\t"{"x" * (i % 37)}", "NObs": 1, "NObs": {"null" if i % 13 == 0 else i}, "V": -1.5e-{i % 9}}},'
    texts = {"a.json": '{"Score": 5, "NObs": 7} ' + "".join(map(record, range(700))), "b.json": "[" + "".join(map(record, range(900, 1000))) + '{"Temp_Desig": "open', "c.json": "", "d.json": '"NObs" "V": true'}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    keys = ["Temp_Desig", "Score", "Note", "NObs", "V"]
    one = R.recover_feed(spark.createDataFrame(list(texts.items()), "file string, value string"), keys)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (1000, 997, 64 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            files = R.recover_files(spark, str(tmp_path), keys)
            got = sorted((tuple(r) for r in files.drop("start").collect()), key=str)
            assert got == sorted((tuple(r) for r in one.drop("rec").collect()), key=str)
            assert size > 1000 or files.select("file", "start").distinct().count() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert ("a.json", None, "5", None, "7", None) in got and ("a.json", "P00014", "14", "x" * 14, "14", "-1.5e-5") in got
    assert len(got) == 801 and ("a.json", "P00013", "13", "x" * 13, None, "-1.5e-4") in got
