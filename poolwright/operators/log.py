"""The decision log: reading it, last-wins and field-wise folds, effects of decisions, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

c = F.col

#: kinds whose latest record replaces earlier ones; the others add up
REPLACING = ("which_measure", "include_dataset", "group_n")
KINDS = ("value", "mark_reviewed", "exclude_dataset", "eligibility", "re_extract", "orientation", *REPLACING)
SCHEMA = (
    "seq long, kind string, paper string, dataset string, outcome string, arm string, mean double, spread double, spread_type string, n double, "
    "unit string, justification string, eligible boolean"
)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Decisions of JSON lines. A damaged line is a row of kind `unreadable`, never skipped; a missing seq
    is the line's number within its file. A log file is one decision history and is read whole."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    lines = lines.where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", SCHEMA + ", broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}))
    broken = c("r").isNull() | c("r.broken").isNotNull() | c("r.kind").isNull()
    fields = [x.split()[0] for x in SCHEMA.split(", ")]
    out = {f: F.when(~broken, c(f"r.{f}")) for f in fields}
    out["kind"] = F.when(broken, "unreadable").otherwise(c("r.kind"))
    out["seq"] = F.coalesce(out["seq"], (c("line") + 1).cast("long"))
    return parsed.select("file", *[x.alias(f) for f, x in out.items()])


def validate(log: DataFrame) -> DataFrame:
    """`problem` of each decision: null where it can be applied."""
    needs = F.when(~c("kind").isin(list(KINDS)), "unknown kind")
    needs = needs.when(c("kind").isin("value", "orientation", "group_n") & (c("dataset").isNull() | c("outcome").isNull()), "no cell named")
    needs = needs.when((c("kind") == "value") & c("arm").isNull(), "no arm named")
    needs = needs.when((c("kind") == "value") & c("mean").isNull() & c("spread").isNull() & c("n").isNull(), "no value given")
    needs = needs.when((c("kind") == "value") & (c("n") < 2), "n too small").when((c("kind") == "value") & (c("spread") < 0), "negative spread")
    needs = needs.when((c("kind") == "exclude_dataset") & c("dataset").isNull(), "no dataset named")
    return log.withColumn("problem", needs)


def live(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Replacing kinds: the last of each kind and key. All others: every record."""
    last = Window.partitionBy("kind", *keys).orderBy(F.desc(seq))
    replacing = c("kind").isin(list(REPLACING))
    return log.withColumn("turn", F.when(replacing, F.row_number().over(last)).otherwise(1)).where("turn = 1").drop("turn")


def last_stated(log: DataFrame, keys: list[str], fields: list[str], seq: str = "seq") -> DataFrame:
    """Field-wise latest value: a record overwrites only what it states. One aggregate, no window."""
    return log.groupBy(*keys).agg(*[F.max_by(f, F.when(c(f).isNotNull(), c(seq))).alias(f) for f in fields], F.max(seq).alias("last_seq"))


def fold_values(cells: DataFrame, log: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Cells with the stated values over their own; `touched` where a decision landed."""
    stated = last_stated(log.where("kind = 'value'"), keys, fields)
    renamed = stated.select(*keys, *[c(f).alias(f"new_{f}") for f in fields], c("last_seq"))
    out = cells.join(renamed, keys, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(c(f"new_{f}"), c(f)))
    return out.withColumn("touched", c("last_seq").isNotNull()).drop(*[f"new_{f}" for f in fields], "last_seq")


def excluded(cells: DataFrame, log: DataFrame, dataset: str, paper: str) -> DataFrame:
    """Cells of datasets or papers that a decision takes out are dropped."""
    sets = log.where("kind = 'exclude_dataset'").select(c("dataset").alias(dataset)).distinct()
    papers = last_stated(log.where("kind = 'eligibility'"), ["paper"], ["eligible"]).where("eligible = false").select(c("paper").alias(paper))
    return cells.join(sets, dataset, "left_anti").join(papers, paper, "left_anti")


def within_read_tolerance(a: Column, b: Column, sd: Column) -> Column:
    """Two readings of one value: equal to a relative 1e-9, or within a tenth of the SD."""
    return (F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b))) | F.coalesce(F.abs(a - b) <= 0.1 * sd, F.lit(False))


def retained(events: DataFrame, key: str, seq: str, most: int) -> DataFrame:
    """Of each key's events the first and the last `most` - 1: the middle of a long log is dropped."""
    rank = Window.partitionBy(key).orderBy(F.desc(seq))
    return events.withColumn("from_end", F.row_number().over(rank)).withColumn("first", F.min(seq).over(Window.partitionBy(key))).where(
        (c("from_end") <= most - 1) | (c(seq) == c("first"))
    ).drop("from_end", "first")


def distinct_readings(values: DataFrame, key: str, order: str, value: str, relative: float = 0.005) -> DataFrame:
    """Greedy groups of a key's readings in order: a reading joins the first group whose value is within
    0.5 % and has the same sign. A fold over one question's few readings."""
    ordered = values.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("xs"))

    def joins(group: Column, x: Column) -> Column:
        return (F.abs(group - x) <= relative * F.greatest(F.abs(group), F.abs(x))) & (F.signum(group) == F.signum(x))

    empty = F.array().cast("array<double>")
    fold = F.reduce("xs", empty, lambda acc, x: F.when(F.exists(acc, lambda g: joins(g, x[value])), acc).otherwise(F.concat(acc, F.array(x[value]))))
    return ordered.select(key, fold.alias("groups"))
