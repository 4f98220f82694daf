"""Fill-in-the-middle by relational units.

A text is a row of units, the matches of a pattern from left to right. Runs of
up to RUN units are posexploded with their lengths, and a window sums the
lengths of the runs before each. A cut request names a unit by its ordinal and
is joined to the run that holds it; that run's units are posexploded in turn and
the lengths of those before the ordinal summed. The offsets of a document are
aggregated from its requests, and substring makes prefix, middle and suffix.
Runs are two levels of the same relation: what is sorted and shuffled is a row
for each run, only runs with a request carry their text, and no text, however
long, becomes an array of single units.

Defined cases: a null text is the empty one and plain; a null doc_id draws as
the word null; rows are cut each for itself, so repeated rows and ids give equal
rows; a request at or after the number of units cuts at the end of the text; a
pattern that leaves characters out fails with an error; an empty table gives no
rows; columns other than doc_id and text are not read, so their names cannot
clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import partitions

#: One code point. A pattern of units has to cover every text, and may not look around or match nothing.
CODE_POINT = "(?s:.)"
#: Units in a run.
RUN = 256
#: Marks before prefix, suffix and middle.
PRE, SUF, MID = "<P>", "<S>", "<M>"
#: Of 100 documents, those that are changed at all, and of these, those with the suffix first.
RATE, SPM = 90, 20
SEED = 1


def _runs(text: Column, unit: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?:{unit}){{1,{RUN}}}"), F.lit(0))


def count_units(text: Column, unit: str = CODE_POINT) -> Column:
    """Units of a text: every run but the last is full, so only that one is counted."""
    found = _runs(text, unit)
    last = F.regexp_count(F.element_at(found, -1), F.lit(unit))
    return F.when(F.size(found) == 0, F.lit(0)).otherwise((F.size(found) - 1) * RUN + last).cast("long")


def number(docs: DataFrame, unit: str = CODE_POINT) -> DataFrame:
    """(row, doc_id, text, n): a key for each row, its text and number of units, dealt by key.

    Texts are shuffled here once. Units, requests and the last join all read this
    one exchange, so keys are given once and no text moves again.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition(partitions(docs.sparkSession), "row").withColumn("n", count_units(F.col("text"), unit))


def offsets(rows: DataFrame, unit: str = CODE_POINT) -> DataFrame:
    """(row, ats): for rows with row, text and cuts (array of unit ordinals), the characters before each of these units.

    ats maps a cut's place in cuts to its offset; it lacks cuts at the end of a text.
    """
    covered = lambda found: F.aggregate(found, F.lit(0), lambda a, x: a + F.length(x)) == F.length("text")
    whole = rows.select("row", "cuts", _runs(F.col("text"), unit).alias("runs"), "text")
    tiled = F.when(covered("runs"), F.col("runs")).otherwise(F.raise_error(F.lit("the unit pattern leaves characters out")).cast("array<string>"))
    pieces = whole.select("row", "cuts", F.posexplode(tiled).alias("run", "piece"))
    asked = F.exists("cuts", lambda c: F.floor(c / RUN) == F.col("run"))
    light = pieces.select("row", "cuts", "run", F.length("piece").alias("chars"), F.when(asked, F.col("piece")).alias("piece"))
    earlier = Window.partitionBy("row").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = light.withColumn("start", F.coalesce(F.sum("chars").over(earlier), F.lit(0))).filter("piece IS NOT NULL")

    # Requests stand beside the runs of their row, so the join to the run that holds an ordinal moves nothing.
    requests = starts.select("row", "run", "piece", "start", F.posexplode("cuts").alias("cut", "ordinal"))
    joined = requests.filter(F.col("run") == F.floor(F.col("ordinal") / RUN))
    units = joined.select("row", "cut", "start", (F.col("ordinal") % RUN).alias("upto"), F.posexplode(F.regexp_extract_all("piece", F.lit(unit), F.lit(0))).alias("pos", "unit"))
    found = units.groupBy("row", "cut", "start").agg(F.sum(F.when(F.col("pos") < F.col("upto"), F.length("unit")).otherwise(0)).alias("inside"))
    return found.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("cut", (F.col("start") + F.col("inside")).cast("long").alias("at")))).alias("ats"))


def split(rows: DataFrame, unit: str = CODE_POINT) -> DataFrame:
    """Add parts: the pieces of text between its ascending cuts, one more than there are cuts."""
    found = offsets(rows, unit).withColumnRenamed("row", "__row")
    # Offsets are small beside texts, so they are the hashed side and texts stream past unsorted.
    joined = rows.join(found.hint("shuffle_hash"), F.col("row") == F.col("__row"), "left").drop("__row")
    end = F.length("text").cast("long")
    bounds = F.concat(F.array(F.lit(0).cast("long")), F.transform("cuts", lambda c, i: F.coalesce(F.element_at("ats", i), end)), F.array(end))
    joined = joined.withColumn("__bounds", bounds)
    pieces = F.transform(
        F.sequence(F.lit(1), F.size("__bounds") - 1),
        lambda i: F.substring("text", (F.element_at("__bounds", i) + 1).cast("int"), (F.element_at("__bounds", i + 1) - F.element_at("__bounds", i)).cast("int")),
    )
    return joined.withColumn("parts", pieces).drop("ats", "__bounds")


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned numbers of 32 bits from a hash of the id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(key, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, unit: str = CODE_POINT) -> DataFrame:
    """(doc_id, text, n, form, parts, output) for documents with doc_id and text; parts is null where the form is plain."""
    rows = number(docs, unit)
    h1, h2, h3, h4 = draws(F.col("doc_id"))
    one, two = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    marked = F.contains("text", F.lit(PRE)) | F.contains("text", F.lit(SUF)) | F.contains("text", F.lit(MID))
    plain = (F.col("text") == "") | marked | (h3 % 100 >= RATE)
    rows = rows.withColumn("form", F.when(plain, "plain").when(h4 % 100 < SPM, "spm").otherwise("psm"))
    # A text that stays plain asks for no cut.
    none = F.array().cast("array<bigint>")
    parted = split(rows.withColumn("cuts", F.when(F.col("form") == "plain", none).otherwise(F.array(F.least(one, two), F.greatest(one, two)))), unit)
    prefix, middle, suffix = (F.element_at("parts", k) for k in (1, 2, 3))
    psm = F.concat(F.lit(PRE), prefix, F.lit(SUF), suffix, F.lit(MID), middle)
    spm = F.concat(F.lit(SUF), suffix, F.lit(PRE), prefix, F.lit(MID), middle)
    parts = F.when(F.col("form") != "plain", F.col("parts"))
    out = parted.withColumn("output", F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm))
    return out.select("doc_id", "text", "n", "form", parts.alias("parts"), "output")


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from. Its marks are the first of their kind, as a text that holds one stays plain."""
    at = lambda mark: F.locate(mark, output)
    until = lambda mark, end: F.substring(output, at(mark) + len(mark), end - at(mark) - len(mark))
    middle = until(MID, F.length(output) + 1)
    psm = F.concat(until(PRE, at(SUF)), middle, until(SUF, at(MID)))
    spm = F.concat(until(PRE, at(MID)), middle, until(SUF, at(PRE)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def query(spark, sf_dir: str) -> DataFrame:
    made = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    size = lambda k: F.length(F.element_at("parts", k)).cast("long")
    return made.select(
        "doc_id", "n", "form",
        size(1).alias("prefix_chars"), size(2).alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
r AS (SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS e FROM d),
f AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '{PRE}') OR contains(t, '{SUF}') OR contains(t, '{MID}') OR c >= {RATE} THEN 'plain' WHEN e < {SPM} THEN 'spm' ELSE 'psm' END AS form,
  least(a, b) AS lo, greatest(a, b) AS hi FROM r),
p AS (SELECT doc_id, t, n, form, lo, hi, substring(t, 1, lo) AS pre, substring(t, lo + 1, hi - lo) AS mid, substring(t, hi + 1, n - hi) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PRE}' || pre || '{SUF}' || suf || '{MID}' || mid ELSE '{SUF}' || suf || '{PRE}' || pre || '{MID}' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
