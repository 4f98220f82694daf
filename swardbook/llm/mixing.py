"""Mix sources to target weights with Efraimidis-Spirakis sampling (native).

Each document draws an exponential key -ln(u) / quality from a hash of its id,
so a rerun draws the same keys. Within its source, documents are sorted by key
and prefix-summed against what the source's word budget leaves after complete
epochs. DataFrame expressions only.

Defined cases: a null text has size 0 and is never taken by the fractional
part; a null source is a source of its own, last in order; equal keys are
ordered by doc_id, then size (equal rows are interchangeable); an empty table
gives no rows; a very long text is a document of its size. Repeated rows of one
doc_id and text are taken alike by the pipeline stage, which goes by these two;
so are null ids. The input's other columns are not read, so their names cannot
clash with the ones used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import running_totals, stash, unstash
from .words import word_count

#: Weights of the sources in code point order, null last.
WEIGHTS = (1, 2, 3)
#: No source, and so no document, is taken more often than this.
MAX_EPOCHS = 3
#: Passes of the fractional selection; each fills the gap that the last one left.
PASSES = 3


def quality(text: Column) -> Column:
    """Share of letters of any script among a text's characters, from 1 to 100 in whole per cent."""
    letters = F.length(F.regexp_replace(text, "[^\\p{L}]+", ""))
    share = F.floor(letters * 100 / F.greatest(F.length(text), F.lit(1)))
    return F.greatest(F.coalesce(share, F.lit(1)), F.lit(1)).cast("long")


def draw(doc_id: Column, weight: Column) -> Column:
    """Exponential key: smaller comes first; 52 bits of an MD5 of the id give u in (0, 1)."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("long")
    return -F.ln((bits.cast("double") + 0.5) / float(2**52)) / weight


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    The level L solves sum(min(3 * size, L * weight)) = sum(size). With sources
    sorted by the level at which each reaches its ceiling, L is what remains
    after the ceilings before the first source that stays under its own. The
    windows run over one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), place + 1).cast("long")
    capped = sizes.select("source", "source_size", w.alias("weight"), (F.col("source_size") * MAX_EPOCHS).alias("ceiling"))
    full_at = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full_at.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("ceiling").over(before), F.lit(0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = capped.withColumn("level", rest / weights)
    under = F.min(F.when(F.col("ceiling") / F.col("weight") >= F.col("level"), F.struct(F.col("ceiling") / F.col("weight"), F.col("level").alias("level")))).over(every)
    return levels.select("source", "source_size", F.least(F.col("ceiling").cast("double"), under["level"] * F.col("weight")).alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, mark) for documents with doc_id, source and text; mark is a hash of the text."""
    light = stash(
        docs.select("doc_id", "source", F.xxhash64("text").alias("mark"), word_count(F.col("text")).alias("size"), quality(F.col("text")).alias("quality")).withColumn("key", draw(F.col("doc_id"), F.col("quality"))),
        "mix",
    )
    aims = targets(light.groupBy("source").agg(F.sum("size").alias("source_size")))
    aims = aims.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    aims = stash(aims.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size")), "aims")

    rows = light.select("doc_id", "source", "size", "key", "mark").withColumn("picked", F.lit(0).cast("long"))
    gaps = aims.select(F.col("source").alias("__source"), F.col("left").alias("__gap"))
    last: DataFrame | None = None
    for turn in range(PASSES):
        offered = rows.join(gaps, rows["source"].eqNullSafe(gaps["__source"])).drop("__source")
        fits = (F.col("picked") == 0) & (F.col("size") > 0) & ((F.col("size") <= F.col("__gap")) if turn else F.lit(True))
        offered = offered.withColumn("__offer", F.when(fits, F.col("size")).otherwise(0))
        summed = running_totals(offered, ["source"], ["key", "doc_id", "size", "mark"], {"__before": "__offer"})
        end = F.col("__before") + (F.col("size") if turn < PASSES - 1 else F.col("size") / 2)
        take = (F.col("__offer") > 0) & (end <= F.col("__gap"))
        rows = stash(summed.select("doc_id", "source", "size", "key", "mark", F.when(take, 1).otherwise(F.col("picked")).cast("long").alias("picked")), "picked")
        if last is not None:
            unstash(last)
        last = rows
        if turn < PASSES - 1:
            spent = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("picked")).alias("__spent"))
            gaps = aims.join(spent, aims["source"].eqNullSafe(spent["source"])).select(aims["source"].alias("__source"), (F.col("left") - F.col("__spent")).alias("__gap"))
    aims = aims.withColumnRenamed("source", "__source")
    out = rows.join(aims, rows["source"].eqNullSafe(aims["__source"]))
    return out.select("doc_id", "source", "size", "source_size", "target", ((F.col("epochs") + F.col("picked")) * F.col("size")).alias("taken"), "mark")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("mark")


def resample(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, columns unchanged."""
    taken = stash(mix(docs), "taken").filter("size > 0 AND taken > 0")
    times = taken.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), (F.col("taken") / F.col("size")).cast("int").alias("__times"))
    times = times.groupBy("__id", "__mark").agg(F.max("__times").alias("__times"))
    # The ids grow with the corpus, so small corpora join as large ones do.
    joined = docs.join(times.hint("merge"), docs["doc_id"].eqNullSafe(times["__id"]) & (F.xxhash64(docs["text"]) == times["__mark"]))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def _oracle() -> str:
    steps = [
        """light AS (SELECT doc_id, source, n AS size, -ln((bits + 0.5) / 4503599627370496.0) / q AS key FROM (
  SELECT doc_id, source,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))::BIGINT AS n,
    greatest(1, coalesce(floor(length(regexp_replace(text, '[^\\p{L}]+', '', 'g')) * 100 / greatest(length(text), 1)), 1)) AS q,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE AS bits
  FROM documents) t)""",
        "sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM light GROUP BY source)",
        "weighed AS (SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, source_size * 3 AS ceiling FROM sizes)",
        """levels AS (SELECT *, ceiling / w AS full_at,
  (sum(source_size) OVER () - coalesce(sum(ceiling) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
  FROM weighed WINDOW b AS (ORDER BY ceiling / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
        "level AS (SELECT level AS l FROM levels WHERE full_at >= level ORDER BY full_at, level LIMIT 1)",
        """aims AS (SELECT source, source_size, least(ceiling::DOUBLE, l * w) AS target,
  CASE WHEN source_size > 0 THEN floor(least(ceiling::DOUBLE, l * w) / source_size) ELSE 0 END::BIGINT AS epochs FROM levels, level)""",
        "gap0 AS (SELECT source, target - epochs * source_size AS gap FROM aims)",
        "rows0 AS (SELECT *, 0 AS picked FROM light)",
    ]
    for k in range(PASSES):
        fit = "AND size <= gap" if k else ""
        end = "size" if k < PASSES - 1 else "size / 2"
        steps.append(f"""rows{k + 1} AS (SELECT doc_id, source, size, key, CASE WHEN offer > 0 AND before + {end} <= gap THEN 1 ELSE picked END AS picked FROM (
  SELECT *, coalesce(sum(offer) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
    SELECT r.*, g.gap, CASE WHEN picked = 0 AND size > 0 {fit} THEN size ELSE 0 END AS offer FROM rows{k} r JOIN gap{k} g ON r.source IS NOT DISTINCT FROM g.source) a) b)""")
        steps.append(f"gap{k + 1} AS (SELECT a.source, gap - s AS gap FROM gap0 a JOIN (SELECT source, sum(size * picked) AS s FROM rows{k + 1} GROUP BY source) x ON a.source IS NOT DISTINCT FROM x.source)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT r.doc_id, r.source, r.size, a.source_size, a.target, ((a.epochs + r.picked) * r.size)::BIGINT AS taken
FROM rows{PASSES} r JOIN aims a ON r.source IS NOT DISTINCT FROM a.source"""


ORACLE = _oracle()
