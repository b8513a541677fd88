"""Sources and sinks: feed snapshots, text feeds, observation lines, outcome pages, score text, tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.columns import ORBIT_CLASSES, num

FIELDS = [("Temp_Desig", "string"), ("Score", "int"), ("Discovery_year", "int"), ("Discovery_month", "int"), ("Discovery_day", "double"), ("R.A.", "double"), ("Decl.", "double"), ("V", "double"), ("Updated", "string"), ("Note", "string"), ("NObs", "int"), ("Arc", "double"), ("H", "double"), ("Not_Seen_dys", "double")]
RENAMED = {"Temp_Desig": "trksub", "Score": "score", "R.A.": "ra_h", "Decl.": "dec_deg", "V": "v", "H": "h", "Arc": "arc", "NObs": "nobs", "Not_Seen_dys": "unseen"}


#: What may stand around the colon of a key.
BLANKS = " \t\r\n\f\x0b"


def snapshot_schema() -> T.StructType:
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in FIELDS])


def named(raw: DataFrame) -> DataFrame:
    """Snapshot rows under their short names, with the stamp of the file name; other files' rows go."""
    stamp = F.try_to_timestamp(F.regexp_extract("__file", r"neocp_(\d{8}T\d{4})", 1), F.lit("yyyyMMdd'T'HHmm"))
    return raw.select(*[F.col(f"`{n}`").alias(RENAMED.get(n, n)) for n, _ in FIELDS], stamp.alias("stamp")).where("stamp IS NOT NULL")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(snapshot_schema()).option("multiLine", True).json(path)
    return named(raw.withColumn("__file", F.col("_metadata.file_name")))


def stream_snapshots(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.readStream.schema(snapshot_schema()).option("multiLine", True).json(path)
    return named(raw.withColumn("__file", F.col("_metadata.file_name")))


def recover_feed(texts: DataFrame, keys: list[str], file_col: str = "file", text_col: str = "value", first_key: str = "Temp_Desig") -> DataFrame:
    """Records of malformed feeds, one whole feed a row: a value of `first_key` begins a record, a repeated key's last value holds.

    What stands before the first record is a record of its own (rec 0), if any key has a value there.
    `recover_files` does the same for files of any size."""
    parts = F.split(text_col, f'"{re.escape(first_key)}"(?=\\s*:\\s*(?:"|null|[-+]?[0-9.]))')
    pieces = texts.select(file_col, F.posexplode(parts).alias("rec", "__t"))
    return _records(pieces, [file_col, "rec"], "__t", F.col("rec") > 0, keys, first_key)


def recover_files(spark: SparkSession, path: str, keys: list[str], first_key: str = "Temp_Desig") -> DataFrame:
    """As recover_feed for files, which are read in splits: the name of `first_key` ends a line of the text source,
    so the reader of a split carries on to the end of the record that it began, and no file is ever one row.

    The name must not stand in a feed as a value. Columns: file, start (of the split), and the keys."""
    pieces = spark.read.option("lineSep", f'"{first_key}"').text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    begun = F.ltrim("value", F.lit(BLANKS)).startswith(":")
    return _records(pieces, ["file", "start"], "value", begun, keys, first_key)


def _records(pieces: DataFrame, keep: list[str], text: str, begun: Column, keys: list[str], first_key: str) -> DataFrame:
    """A row per piece of text with the last value of each key; a begun piece lacks the name of its first key.

    The text is cut at quotes. What is quoted is a key where a colon follows; its value is what is quoted
    next, if only blanks lie between, or else a bare number or null."""
    whole = F.when(begun, F.concat(F.lit(f'"{first_key}"'), text)).otherwise(F.col(text))
    # arrays keep the optimizer from copying the cuts into every use
    rows = pieces.select(*keep, F.explode(F.array(F.split(whole, '"'))).alias("__s"))
    tail = lambda i: F.get("__s", i + 1)
    after = lambda i: F.ltrim(F.substring(F.ltrim(tail(i), F.lit(BLANKS)), F.lit(2), F.length(tail(i))), F.lit(BLANKS))

    def cut(i: Column) -> Column:
        closed = i + 3 < F.size("__s")  # a quote must close a quoted value
        return F.struct(F.get("__s", i).alias("k"), after(i).alias("a"), F.when(closed, F.get("__s", i + 2)).alias("q"))

    def value(c: Column) -> Column:
        bare = F.regexp_extract(c["a"], r"^[^,\]}\s]+", 0)
        number = bare.try_cast("double").isNotNull() & bare.rlike("[0-9]")
        x = F.when(c["a"] == "", c["q"]).when(number, bare)
        return F.struct(c["k"].alias("k"), x.alias("x"), (x.isNotNull() | (bare == "null")).alias("ok"))

    colon = lambda i: F.startswith(F.ltrim(tail(i), F.lit(BLANKS)), F.lit(":"))
    places = F.when(F.size("__s") > 1, F.filter(F.sequence(F.lit(0), F.size("__s") - 2), colon))
    pairs = rows.select(*keep, F.explode(F.array(F.filter(F.transform(F.transform(places, cut), value), lambda p: p["ok"]))).alias("__p")).where(F.size("__p") > 0)
    last = lambda k: F.get(F.reverse(F.filter("__p", lambda p: p["k"] == k)), F.lit(0))["x"]
    return pairs.select(*keep, *[last(k).alias(k) for k in keys])


def parse_feed_text(lines: DataFrame, line_col: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """Plain feed lines: first fields from the front, the last four from the back, free text between."""
    a = F.split(F.trim(line_col), r"\s+")
    rows = lines.select(*keep, a.alias("a")).where(F.size("a") >= 12)
    at = lambda k: F.element_at("a", k)
    out = rows.select(
        *keep, at(1).alias("trksub"), at(2).try_cast("int").alias("score"), at(3).try_cast("int").alias("year"), at(4).try_cast("int").alias("month"), num(at(5)).alias("day"),
        num(at(6)).alias("ra"), num(at(7)).alias("dec"), num(at(8)).alias("v"), F.array_join(F.slice("a", F.lit(9), F.size("a") - 12), " ").alias("updated"),
        at(-4).try_cast("int").alias("nobs"), num(at(-3)).alias("arc"), num(at(-2)).alias("h"), num(at(-1)).alias("unseen"),
    )
    return out.where("score IS NOT NULL AND nobs IS NOT NULL AND unseen IS NOT NULL")


def parse_feed_positions(lines: DataFrame, line_col: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """Plain feed lines as positions for a sky map, right ascension in degrees; lines with any field that isn't a number go."""
    a = F.split(F.trim(line_col), r"\s+")
    rows = lines.select(*keep, a.alias("a")).where(F.size("a") >= 12)
    at = lambda k: F.element_at("a", k)
    out = rows.select(
        *keep, at(1).alias("trksub"), at(2).try_cast("int").alias("score"), (at(6).try_cast("double") * 15).alias("ra_deg"), at(7).try_cast("double").alias("dec_deg"), at(8).try_cast("double").alias("v"),
        at(-4).try_cast("int").alias("nobs"), at(-3).try_cast("double").alias("arc"), at(-2).try_cast("double").alias("h"), at(-1).try_cast("double").alias("unseen"),
    )
    return out.dropna(subset=["score", "ra_deg", "dec_deg", "v", "nobs", "arc", "h", "unseen"])


def read_obs_lines(spark: SparkSession, path: str, source: str) -> DataFrame:
    """trksub (file stem), source, line_no and raw line of observation files."""
    raw = spark.read.option("wholetext", True).text(path).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("trksub"), "value")
    return raw.select("trksub", F.lit(source).alias("source"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "raw")).where("trim(raw) <> ''")


#: First column and width of the fields of an 80-column line.
PLACES = {"desig": (6, 7), "y": (16, 4), "mo": (21, 2), "d": (24, 9), "rh": (33, 2), "rm": (36, 2), "rs": (39, 6), "sign": (45, 1), "dd": (46, 2), "dm": (49, 2), "ds": (52, 5), "mag": (66, 5), "obscode": (78, 3)}


def parse_obs80(lines: DataFrame, raw: str = "raw", keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed observations of 80- or 75-column lines: desig, t, ra, dec, mag, obscode; others are left out.

    Fields are cut and cast once, in a step of their own; later steps only see numbers."""
    full = F.when(F.col(raw).rlike(r"^\S"), F.concat(F.lit("     "), F.col(raw))).otherwise(F.col(raw))
    cut = F.struct("__n", *[F.trim(F.substring("__l", a, n)).alias(c) for c, (a, n) in PLACES.items()])
    # the array keeps the optimizer from copying the cuts into every use, and what makes the line into the filter
    rows = lines.select(*keep, full.alias("__l"), F.length(raw).alias("__n")).select(*keep, F.explode(F.array(cut)).alias("f")).where("f.__n >= 70")
    whole = lambda c: F.when(F.col(f"f.{c}").rlike("^[0-9]+$"), F.col(f"f.{c}").try_cast("int"))
    numbers = F.struct(*[whole(c).alias(c) for c in ("y", "mo", "rh", "rm", "dd", "dm")], *[num(F.col(f"f.{c}")).alias(c) for c in ("d", "rs", "ds", "mag")])
    rows = rows.select(*keep, "f.desig", "f.obscode", "f.sign", F.explode(F.array(numbers)).alias("x"))
    x = lambda c: F.col(f"x.{c}")
    first = F.when(x("mo").between(1, 12), F.make_date(x("y"), x("mo"), F.lit(1)))
    t = F.datediff(first, F.lit("2000-01-01").cast("date")) + x("d") - 1
    ra = 15.0 * (x("rh") + x("rm") / 60 + x("rs") / 3600)
    dec = F.when(F.col("sign") == "-", -1.0).otherwise(1.0) * (x("dd") + x("dm") / 60 + x("ds") / 3600)
    out = rows.select(*keep, "desig", t.alias("t"), ra.alias("ra"), dec.alias("dec"), x("mag").alias("mag"), "obscode")
    return out.where("t IS NOT NULL AND ra IS NOT NULL AND dec IS NOT NULL")


def short_line_site(raw: str = "raw") -> Column:
    """The site of a raw line: columns 78-80, or 73-75 where the line is 75 to 79 long."""
    return F.when(F.length(raw) >= 80, F.trim(F.substring(raw, 78, 3))).when(F.length(raw) >= 75, F.trim(F.substring(raw, 73, 3)))


#: Beginnings of tags that end a line.
LINE_TAGS = ("li", "/li", "br", "p", "/p", "div", "/div", "tr", "/tr", "ul", "/ul")


def outcome_lines(pages: DataFrame, text_col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines of outcome pages (HTML or text) that hold a time mark, in order (line_no).

    A page is cut at every opening angle bracket; what follows up to the closing one is a tag, and goes."""
    def untagged(part, i):
        tag, rest = F.lower(F.ltrim(F.substring_index(part, ">", 1))), F.substring(part, F.instr(part, ">") + 1, F.length(part))
        ends = F.exists(F.array(*map(F.lit, LINE_TAGS)), lambda t: F.startswith(tag, t))
        return F.when(i == 0, part).when(~F.contains(part, F.lit(">")), F.concat(F.lit("<"), part)).otherwise(F.concat(F.when(ends, "\n").otherwise(""), rest))

    text = F.array_join(F.transform(F.split(text_col, "<"), untagged), "")
    rows = pages.select(*keep, F.posexplode(F.split(text, "\r?\n")).alias("line_no", "line"))
    return rows.withColumn("line", F.trim("line")).where(F.col("line").contains("UT)"))


def page_quality(pages: DataFrame, lines: DataFrame, page_col: str = "page") -> DataFrame:
    """Per page the number of outcome lines, and whether it is suspect for having none."""
    n = lines.groupBy(page_col).agg(F.count("*").alias("n_lines"))
    met = pages.select(page_col).distinct().join(n, page_col, "left")
    return met.select(page_col, F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.col("n_lines").isNull().alias("suspect"))


def mentions(lines: DataFrame, line_col: str = "raw", key: str = "trksub", longer_than: int = 40) -> DataFrame:
    """Observation lines that name their object and are long enough to be observations."""
    return lines.where(F.contains(line_col, F.col(key).cast("string")) & (F.length(F.trim(line_col)) > longer_than))


def read_outcome_files(spark: SparkSession, path: str) -> DataFrame:
    """Lines of dated outcome files, with the stamp of the file name."""
    raw = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{8})", 1).alias("stamp"), "value")
    return raw.select("stamp", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).where("trim(line) <> ''")


def parse_scores(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """desig, d2_rms and 26 class scores of score text; a star in the residual means none."""
    n = 2 * len(ORBIT_CLASSES)
    rows = lines.where(~F.col(line_col).rlike(r"^\s")).select(F.split(F.trim(line_col), r"\s+").alias("a")).where(F.size("a") == n + 2)
    rows = rows.where(F.element_at("a", 2).rlike("^[0-9.*]+$") & F.forall(F.slice("a", 3, n), lambda x: x.rlike("^[0-9]+$")))
    score = [F.element_at("a", 3 + 2 * i + j).cast("int").alias(f"d2_{c}_{k}") for i, c in enumerate(ORBIT_CLASSES) for j, k in enumerate(("raw", "noid"))]
    rms = F.element_at("a", 2)
    return rows.select(F.element_at("a", 1).alias("desig"), F.when(~rms.contains("*"), num(rms)).alias("d2_rms"), *score)


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("trksub string, outcome_class string, designation string, mpec string, first_seen_utc string").csv(path, header=True)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("trksub string, designation string, mpec string, url string").option("sep", "|").csv(path)


def flatten_subjects(pages: DataFrame) -> DataFrame:
    """One row per subject of index pages: label, its source, keyword, frames and first location."""
    from ..functions.columns import subject_label

    s = pages.select(F.explode("subjects").alias("s"))
    label = subject_label(F.col("s.metadata"))
    return s.select(F.col("s.id").alias("subject_id"), label["is_real"].alias("is_real"), label["label_source"].alias("label_source"), F.coalesce(F.trim(F.col("s.metadata")["!sKeyword"]), F.lit("")).alias("keyword"), F.size("s.locations").alias("n_frames"), F.map_values(F.get("s.locations", F.lit(0)))[0].alias("first_url"))


def read_frames(spark: SparkSession, path: str, meta: DataFrame | None = None) -> DataFrame:
    """Pixels (subject, frame, r, c, red, green, blue) of PNG frames; subjects with fewer than four frames are left out.

    With `meta` (a row per subject) also subjects without one, and its columns are added. Spark's image
    source stores rows of pixels as blue, green, red bytes."""
    name = F.col("image.origin")
    img = spark.read.format("image").load(path).select(F.element_at(F.split(name, "/"), -2).alias("subject"), F.regexp_extract(name, r"frame_(\d+)", 1).cast("int").alias("frame"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("n"), F.col("image.data").alias("x"))
    four = img.groupBy("subject").agg(F.count("*").alias("frames")).where("frames >= 4").select("subject")
    if meta is not None:
        four = four.join(meta, "subject")
    n = F.octet_length("x") / F.col("n")
    px = img.join(four, "subject").withColumn("i", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)))
    byte = lambda k: F.conv(F.hex(F.substring(F.col("x"), F.col("i") * F.col("n") + k + 1, F.lit(1))), 16, 10).cast("int")
    extra = [] if meta is None else [c for c in meta.columns if c != "subject"]
    return px.select("subject", "frame", F.floor(F.col("i") / F.col("w")).cast("int").alias("r"), (F.col("i") % F.col("w")).cast("int").alias("c"), byte(2).alias("red"), byte(1).alias("green"), byte(0).alias("blue"), *extra)


def read_matrices(spark: SparkSession, path: str, columns: tuple[str, ...] = ("x_img", "x_mot")) -> DataFrame:
    """Cached matrices (a row per subject, array<double> columns) as vectors that models take; nulls in them become 0."""
    return matrix_vectors(spark.read.parquet(path), columns)


def matrix_vectors(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    known = lambda c: F.transform(F.coalesce(F.col(c).cast("array<double>"), F.array().cast("array<double>")), lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))
    return rows.withColumns({c: array_to_vector(known(c)) for c in columns})


def flatten_risk(payload: DataFrame) -> DataFrame:
    r = payload.select(F.explode("data").alias("r"))
    return r.select(F.coalesce("r.des", F.lit("")).alias("des"), F.trim(F.coalesce("r.fullname", "r.des", F.lit(""))).alias("fullname"), F.coalesce(num("r.ip"), F.lit(0.0)).alias("ip_cum"), F.coalesce(num("r.ps_cum"), F.lit(-99.0)).alias("ps_cum"), F.col("r.ts_max").alias("ts_max"), num("r.diameter").alias("diameter_km"), num("r.h").alias("h"), F.col("r.n_imp").alias("n_imp"), F.col("r.range").alias("range"), F.col("r.last_obs").alias("last_obs"))


def read_risk(spark: SparkSession, path: str) -> DataFrame:
    fields = ", ".join(f"{n}:string" for n in ("des", "fullname", "ip", "ps_cum", "ts_max", "diameter", "h", "n_imp", "range", "last_obs"))
    return flatten_risk(spark.read.schema(f"data array<struct<{fields}>>").option("multiLine", True).json(path))


def ragged_columns(df: DataFrame, first: tuple[str, ...] = ("trksub", "y")) -> list[str]:
    return [c for c in first if c in df.columns] + sorted(c for c in df.columns if c not in first)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    out = df.select(*[F.col(f"`{c}`") for c in ragged_columns(df)])
    out.write.mode("overwrite").csv(path, header=True) if kind == "csv" else out.write.mode("overwrite").parquet(path)


def write_outcome_log(lines: DataFrame, path: str, quarantine: str | None = None) -> None:
    """Rebuilds the outcome log from raw lines and overwrites it; unparsed lines go to `quarantine`, if named."""
    from ..operators.outcomes import rebuild_outcomes, unparsed_outcomes

    rebuild_outcomes(lines).write.mode("overwrite").parquet(path)
    if quarantine:
        unparsed_outcomes(lines).write.mode("overwrite").parquet(quarantine)


def append_new(new: DataFrame, log_path: str, keys: list[str]) -> None:
    """Appends rows whose key the log doesn't have; null keys count as equal."""
    spark = new.sparkSession
    log = spark.read.schema(new.schema).parquet(log_path)
    match: Column = F.lit(True)
    for k in keys:
        match = match & new[k].eqNullSafe(log[k])
    new.dropDuplicates(keys).join(log, match, "left_anti").write.mode("append").parquet(log_path)


def write_report(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)
