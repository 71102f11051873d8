"""Fingerprint tables and their textual form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..session import materialise
from ..functions.cells import generated
from ..functions.lanes import acc_to_text

_NUMBER = r"^[0-9]+$"


def unsigned(text, limit: str) -> Column:
    """Strictly numeric text as DECIMAL(20,0); NULL when it is not a number up to ``limit``."""
    c = F.col(text) if isinstance(text, str) else text
    value = F.when(c.rlike(_NUMBER) & (F.length(F.ltrim(c, F.lit("0"))) <= 20),
                   c.try_cast("decimal(38,0)"))
    return F.when(value <= F.lit(limit).cast("decimal(38,0)"), value.cast("decimal(20,0)"))


MAX_ID = "18446744073709551615"
MAX_SIZE = "9223372036854775807"


def write_fingerprints(fps: DataFrame, path: str, complete: bool, mode: str = "append") -> None:
    """Store fingerprint rows. While work is in progress rows are appended with
    ``complete = false``; the final call overwrites the table with ``complete = true``."""
    out = fps.drop("complete").withColumn("complete", F.lit(complete))
    out = out.select(*[f.name for f in schemas.FINGERPRINTS])
    if complete:
        out = materialise(out, "fingerprints")  # the rows may come from the very path they replace
    out.write.mode("overwrite" if complete else mode).parquet(path)


def load_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FINGERPRINTS).parquet(path)


def read_fingerprints(rows: DataFrame, line_no: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """Validate raw rows ``(dataset, line_no, snap, size, state, version_id)`` given as text.

    Returns (valid, rejected). Of rows with one name the last wins. The lane count follows
    from the length of the state.
    """
    size, vid = unsigned("size", MAX_SIZE), unsigned("version_id", MAX_ID)
    lanes = F.call_function("div", F.length("state"), F.lit(4)).cast("int")
    hex_ok = F.col("state").rlike("^([0-9a-fA-F]{4})+$")
    reason = (F.when(F.col("snap").isNull() | (F.col("snap") == ""), "missing name")
               .when(F.col("snap").rlike(r"\s"), "blank in name")
               .when(size.isNull(), "size is not a number")
               .when(vid.isNull(), "id is not a number")
               .when(~F.coalesce(hex_ok, F.lit(False)), "state is not hex"))
    checked = rows.withColumn("reason", reason)
    good = (checked.filter(F.col("reason").isNull())
            .groupBy("dataset", "snap")
            .agg(F.max_by(F.struct(size.cast("long").alias("size"), F.unhex("state").alias("acc"),
                                   lanes.alias("lanes"), vid.alias("version_id")),
                          F.col(line_no)).alias("r"))
            .select("dataset", "snap", "r.*"))
    return good, checked.filter(F.col("reason").isNotNull())


def file_problems(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Whole-file checks on raw text lines ``(dataset, line)``: header, cell size, entries.

    ``files`` lists the expected datasets, so that an empty file is noticed as well.
    """
    t = F.trim(F.regexp_replace("line", r"\s+", " "))
    w = F.split(t, " ")
    comment = t.startswith("#")
    facts = lines.groupBy("dataset").agg(
        F.max((comment & (F.size(w) >= 4) & (F.get(w, F.lit(2)) == "fingerprint")).cast("int")).alias("header"),
        F.max(F.when(comment & (F.size(w) >= 3) & (F.get(w, F.lit(1)) == "cellsize"),
                     unsigned(F.get(w, F.lit(2)), MAX_SIZE).cast("long"))).alias("cell_size"),
        F.sum((~comment & (t != "")).cast("long")).alias("entries"))
    problem = (F.when(F.coalesce("header", F.lit(0)) == 0, "no header")
                .when(F.coalesce("cell_size", F.lit(0)) == 0, "no cell size")
                .when(F.coalesce("entries", F.lit(0)) == 0, "no entries"))
    return files.join(facts, "dataset", "left").select("dataset", "cell_size", problem.alias("problem"))


def strict_import(lines: DataFrame) -> DataFrame:
    """Like ``import_text``, but a file with any rejected line gives no rows at all: the job fails."""
    good, bad = import_text(lines)
    reasons = bad.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("line_no", "reason")).alias("first"))
    shown = reasons.limit(8).collect()
    if shown:
        raise ValueError("; ".join(f"{r['dataset']}: {r['n']} bad lines, line {r['first'][0]}: {r['first'][1]}" for r in shown))
    return good


def import_text(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parse text lines ``(dataset, line_no, line)`` of fingerprint files.

    Returns (fingerprints with ``cell_size``, rejected lines with a reason).
    """
    # generated: words are found once a line, not once for each use of them
    body = generated(lines, _t=F.trim(F.regexp_replace("line", r"\s+", " "))).filter((F.col("_t") != "") & ~F.col("_t").startswith("#"))
    body, w = generated(body, _w=F.split("_t", " ")), F.col("_w")
    four = F.size(w) == 4
    cols = body.select("dataset", "line_no", "line",
                       F.when(four, F.get(w, F.lit(0))).alias("snap"),
                       F.when(four, F.get(w, F.lit(1))).alias("size"),
                       F.when(four, F.get(w, F.lit(2))).alias("state"),
                       F.when(four, F.get(w, F.lit(3))).alias("version_id"))
    good, bad = read_fingerprints(cols)
    bad = bad.withColumn("reason", F.when(F.col("snap").isNull(), "not four fields").otherwise(F.col("reason")))
    # one row a file, written: lines need not move to meet it, and it is read twice
    sizes = materialise(file_problems(lines, lines.select("dataset").distinct()), "file-problems")
    good = good.join(sizes.filter(F.col("problem").isNull()).drop("problem"), "dataset")
    refused = sizes.filter(F.col("problem").isNotNull()).select(
        "dataset", F.lit(None).cast("long").alias("line_no"), F.lit(None).cast("string").alias("line"),
        F.col("problem").alias("reason"))
    return good, bad.select("dataset", "line_no", "line", "reason").unionByName(refused)


# Fixed values of the text format.
TITLE = "# blockhist fingerprint v1"
COLUMNS = "# columns: snapshot volsize fingerprint guid"


def export_text(fps: DataFrame, complete: bool = True) -> DataFrame:
    """Text lines ``(dataset, line_no, line)`` of a fingerprint file per dataset.

    ``ord`` numbers the body lines; four header lines come first and, in a finished file,
    a closing line last.
    """
    body = fps.select("dataset", (F.col("ord").cast("long") + 4).alias("line_no"),
                      F.concat_ws(" ", "snap", F.col("size").cast("string"), acc_to_text("acc"),
                                  F.col("version_id").cast("string")).alias("line"))
    per_file = fps.groupBy("dataset").agg(F.max("cell_size").alias("cs"), F.count(F.lit(1)).alias("n"),
                                          F.max("ord").alias("last"))
    state = "" if complete else " (in progress)"

    def row(no, text):
        return F.struct(no.cast("long").alias("line_no"), text.alias("line"))
    heads = [row(F.lit(1), F.lit(TITLE)),
             row(F.lit(2), F.concat(F.lit("# dataset "), "dataset", F.lit(state))),
             row(F.lit(3), F.concat(F.lit("# cellsize "), F.col("cs").cast("string"))),
             row(F.lit(4), F.lit(COLUMNS))]
    if complete:
        heads.append(row(F.col("last") + 5, F.concat(F.lit("# dataset "), "dataset", F.lit(" complete ("),
                                                     F.col("n").cast("string"), F.lit(" snapshots)"))))
    head = per_file.select("dataset", F.inline(F.array(*heads)))
    return head.unionByName(body)
