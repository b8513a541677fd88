"""Outcome lines, the outcome log, labels and their guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


#: Phrasings of negative outcomes.
REASONS = (
    "was not confirmed", "does not exist", "was not a minor planet", "was probably not a real object", "was suspected artificial",
    "was not interesting", "was a star", "had insufficient followup", "had bad astrometry",
)
#: Classes that labels leave out.
EXCLUDED = ("comet", "linked", "other")
KEY = ["trksub", "outcome_class", "designation"]


def circular(line) -> Column:
    """The code of the first circular that a line names, or null."""
    after = F.slice(F.split(line, "MPEC"), F.lit(2), F.size(F.split(line, "MPEC")))
    codes = F.transform(after, lambda x: F.regexp_extract(F.ltrim(x, F.lit(" \t*[]")), "^[0-9]{4}-[A-Z][0-9]{1,3}", 0))
    return F.get(F.filter(codes, lambda x: x != ""), F.lit(0))


def classify_outcomes(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Adds trksub, outcome_class, designation and mpec; lines of no known form go.

    A line is a statement and a time in brackets; a remark about a circular may follow. The statement is
    `designation = object` or `object reason`; lines of another shape are `other` where the object is short."""
    return outcome_forms(lines, line_col).where("trksub IS NOT NULL")


def unparsed_outcomes(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """The lines that classify_outcomes leaves out, for a quarantine table."""
    return outcome_forms(lines, line_col).where("trksub IS NULL").select(*lines.columns)


def outcome_forms(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """classify_outcomes with nulls for lines of no known form."""
    line = F.ltrim(F.trim(line_col), F.lit("- "))
    head = F.rtrim(F.get(F.split(line, r"(?i)(?:see|mpec)\b", 2), F.lit(0)))
    whole = F.rtrim(F.when(head.endswith("["), F.left(head, F.length(head) - 1)).otherwise(head))
    # one-element arrays keep the optimizer from copying each step into all uses of it
    step = lambda **made: F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()])))
    rows = lines.select(*lines.columns, step(text=whole, mpec=circular(line)).alias("__a"))
    text, mpec = F.col("__a.text"), F.col("__a.mpec")
    timed = text.endswith(")")
    # designation = object (time): the sign is the first that has such a right side
    parts = F.split(text, "=")
    cuts = F.transform(parts, lambda _, i: F.struct(F.trim(F.array_join(F.slice(parts, F.lit(1), i), "=")).alias("desig"), F.trim(F.array_join(F.slice(parts, i + 1, F.size(parts)), "=")).alias("rest")))
    side = F.when(timed, F.get(F.filter(cuts, lambda c: (c["desig"] != "") & c["rest"].rlike(r"^\S+\s+\(.")), F.lit(0)))
    # object reason (time)
    token = F.get(F.split(text, r"\s+", 2), F.lit(0))
    said = F.get(F.split(text, r"\s+", 2), F.lit(1))
    rows = rows.select(*lines.columns, "__a", step(pair=side, token=token, said=said).alias("__b"))
    said = F.col("__b.said")
    brief = F.coalesce(*[F.when(timed & said.startswith(r) & F.ltrim(F.substring(said, len(r) + 1, 10_000)).startswith("("), F.lit(r)) for r in REASONS])
    what = F.rtrim(F.substring_index(said, "(", 1))
    rows = rows.select(*lines.columns, "__a", "__b", step(reason=brief, other=F.when(timed & said.contains("(") & (what != "") & (F.length("__b.token") <= 8), what)).alias("__c"))
    desig, pair, reason, other = F.col("__b.pair.desig"), F.col("__b.pair").isNotNull(), F.col("__c.reason").isNotNull(), F.col("__c.other").isNotNull()
    comet = desig.rlike(r"^Comet\s")
    kind = F.when(comet, "comet").when(~desig.rlike(r"\s"), "linked").when(mpec.isNotNull(), "neo").otherwise("designated_other")
    return rows.select(
        *lines.columns,
        F.when(pair, F.get(F.split("__b.pair.rest", r"\s+", 2), F.lit(0))).when(reason | other, F.col("__b.token")).alias("trksub"),
        F.when(pair, kind).when(reason, F.replace("__c.reason", F.lit(" "), F.lit("_"))).when(other, "other").alias("outcome_class"),
        F.when(pair, desig).when(reason, "").when(other, F.col("__c.other")).alias("designation"), F.when(pair, mpec).alias("mpec"),
    )


def upgrade_designated(rows: DataFrame) -> DataFrame:
    """designated_other with a circular is neo."""
    return rows.withColumn("outcome_class", F.when(F.col("mpec").isNotNull() & (F.col("outcome_class") == "designated_other"), "neo").otherwise(F.col("outcome_class")))


def outcome_log(rows: DataFrame, order: tuple[str, ...] = ("stamp", "line_no")) -> DataFrame:
    """The first row of each (trksub, outcome_class, designation)."""
    w = Window.partitionBy(*KEY).orderBy(*order)
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def rebuild_outcomes(lines: DataFrame) -> DataFrame:
    return outcome_log(upgrade_designated(classify_outcomes(lines))).drop("line")


def new_outcomes(new: DataFrame, log: DataFrame) -> DataFrame:
    return new.dropDuplicates(KEY).join(log.select(*KEY), KEY, "left_anti")


def resolve_outcomes(log: DataFrame, order: tuple[str, ...] = ("stamp", "line_no"), plain_last: bool = False) -> DataFrame:
    """One outcome per object: a definitive one beats linked and other; else the last wins."""
    bookkeeping = F.lit(0) if plain_last else F.col("outcome_class").isin("linked", "other").cast("int")
    w = Window.partitionBy("trksub").orderBy(bookkeeping, *[F.col(o).desc() for o in order])
    return log.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def outcome_histogram(log: DataFrame) -> DataFrame:
    return log.groupBy("outcome_class").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "outcome_class")


def label_class(c: str = "outcome_class"):
    """1, 0, or null with the reason in with_labels."""
    return F.when(F.col(c) == "neo", 1).when((F.col(c) == "designated_other") | F.col(c).isin(*[r.replace(" ", "_") for r in REASONS]), 0)


def with_labels(met: DataFrame) -> DataFrame:
    """Adds y and state (labeled, excluded or unresolved) to rows with an outcome_class."""
    return met.withColumn("y", label_class()).withColumn("state", F.when(F.col("outcome_class").isNull(), "unresolved").when(F.col("outcome_class").isin(*EXCLUDED) | F.col("y").isNull(), "excluded").otherwise("labeled"))


def label_state(features: DataFrame, resolved: DataFrame) -> DataFrame:
    """Features with the one outcome of their designation, and state: labeled, excluded or unresolved."""
    return with_labels(features.join(resolved.withColumnRenamed("stamp", "outcome_stamp").drop("line_no"), "trksub", "left"))


def day_number(c: str) -> Column:
    return F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date"))


def label_epochs(features: DataFrame, log: DataFrame, days: int = 60, order: tuple[str, ...] = ("stamp", "line_no")) -> DataFrame:
    """Features (trksub, discovered) with the outcome of their own epoch: of the log's outcomes within `days` of
    the discovery a definitive one beats linked and other, else the last wins. Designations are used again, so
    two discoveries of one designation may have two outcomes; one without any near it is unresolved.

    An interval join by buckets of 2 * days + 1 days: a discovery is in one, an outcome reaches at most two.
    Both sides are reduced before they meet: to the days on which a designation was discovered, and to the
    winning outcome of each of its days. So what meets in a bucket is bounded by days, however many rows share
    a designation, and a designation that is used all the time falls apart into its buckets. Both joins are
    merges: Spark takes the size of what was exploded from a file for that of the file, and would send it whole."""
    width = 2 * days + 1
    bucket = lambda day: F.floor(day / F.lit(width))
    fields = ("outcome_class", "designation", "mpec")
    firm = ~F.col("outcome_class").isin("linked", "other")
    won = log.groupBy("trksub", day_number("stamp").alias("__day")).agg(F.max(F.struct(firm.alias("firm"), *order, *fields)).alias("__o"))
    won = won.withColumn("__bucket", F.explode(F.array_distinct(F.array(bucket(F.col("__day") - days), bucket(F.col("__day") + days)))))
    asked = features.select("trksub", day_number("discovered").alias("__at")).distinct().withColumn("__bucket", bucket(F.col("__at")))
    near = asked.join(won.hint("merge"), ["trksub", "__bucket"]).where(F.abs(F.col("__at") - F.col("__day")) <= days)
    best = near.groupBy("trksub", "__at").agg(F.max("__o").alias("__o"))
    met = features.withColumn("__at", day_number("discovered")).join(best.hint("merge"), ["trksub", "__at"], "left")
    return with_labels(met.select(*features.columns, *[F.col(f"__o.{c}").alias(c) for c in fields], F.col("__o.stamp").alias("outcome_stamp")))


def label_summary(states: DataFrame) -> DataFrame:
    return states.agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"), F.count_if(F.col("state") == "unresolved").alias("unresolved"), F.count_if(F.col("state") == "excluded").alias("excluded"))


def training_frame(labeled: DataFrame, backfill: DataFrame | None = None, guard_col: str | None = None) -> DataFrame:
    """Captured rows, then backfill rows of other objects; columns that one side lacks are null.

    With `guard_col` the backfill only stays if rows that have this sub-score carry both labels: else
    having one would tell the label."""
    own = labeled if "source" in labeled.columns else labeled.withColumn("source", F.lit("capture"))
    if backfill is None:
        return own
    both = own.unionByName(backfill.join(labeled.select("trksub"), "trksub", "left_anti"), allowMissingColumns=True)
    if guard_col is None or leak_guard(both, guard_col).first()["ok"]:
        return both
    return both.where(~F.col("source").eqNullSafe("backfill"))


def leak_guard(df: DataFrame, score_col: str = "d2_NEO_noid") -> DataFrame:
    """n_labels among rows with sub-scores, and whether the backfill may be used (both labels have some)."""
    return df.where(F.col(score_col).isNotNull()).agg(F.countDistinct("y").alias("n_labels")).withColumn("ok", F.col("n_labels") == 2)


def bridge_scores(scores: DataFrame, obs: DataFrame, order: tuple[str, ...] = ("t", "line_no")) -> DataFrame:
    """Sub-scores by object, through the packed designation of each object's first kept line."""
    bridge = obs.groupBy("trksub").agg(F.min(F.struct(*order, "desig"))["desig"].alias("desig"))
    return bridge.join(scores, "desig")


def missing_work(wanted: DataFrame, stored: DataFrame, key: str = "trksub", limit: int | None = None) -> DataFrame:
    """Keys without a stored row, in order; a limit is the work list's own."""
    out = wanted.select(key).distinct().join(stored.select(key), key, "left_anti").orderBy(key)
    return out if limit is None else out.limit(limit)


def designated(log: DataFrame) -> DataFrame:
    return log.where(F.col("outcome_class").isin("neo", "designated_other") & (F.coalesce("designation", F.lit("")) != ""))


def feature_table(first: DataFrame, *sides: DataFrame) -> DataFrame:
    """The first postings with all side tables joined by object."""
    for s in sides:
        first = first.join(s, "trksub", "left")
    return first
