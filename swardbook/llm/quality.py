"""Quality rules with adaptive thresholds from mergeable quantile sketches (native).

Every metric of a document becomes an integer; a log-linear sketch counts the
documents of a (language, source) by the metric's bucket: exact below 128, then
64 buckets for each power of two, so a bucket is within 1/64 of its values.
Such sketches merge by adding counts. A (language, source) with too few
documents merges into its language's sketch, and a language with too few into
the sketch of all documents. Each sketch's quartiles give far-out fences, which
replace fixed cutoffs; documents are joined to their fences and filtered.
DataFrame expressions only.

Defined cases: a null text has no words and fails the base rules; a very long
text is counted whole, whatever its length; null lang or source form groups of
their own; equal rows get equal verdicts, and rows of one doc_id are judged each
for itself; an empty table gives no rows; other columns are not read (the
pipeline stage carries them under names of its own), so their names cannot clash; an empty language or corpus sketch cannot arise, as it holds the
document that asks for it. Documents that fail the base rules are not sketched,
so that junk cannot widen the fences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stash
from .words import word_array

#: Base rules, given.
MIN_WORDS = 50
REPEAT_NUM, REPEAT_DEN = 50, 100
#: A group with fewer documents uses the wider group's sketch.
MIN_GROUP = 100
#: Fences lie so many interquartile ranges out, and at least the metric's own distance.
REACH = 6
#: metric: (expression over the base columns, distance, does it have a lower fence)
METRICS = {
    "word_len": ("floor(word_chars * 100 / n_words)", 250, True),
    "symbols": ("floor(n_symbols * 10000 / word_chars)", 1000, False),
    "dup_lines": ("floor(n_dup_lines * 10000 / n_words)", 500, False),
    "repeats": ("floor(n_repeat_words * 10000 / n_words)", 3500, False),
}


def _repeat_words(words: Column, stage: str, df: DataFrame) -> DataFrame:
    """Add n_repeat_words: words in 3-word windows that occur at least twice in the text.

    Each window is one long: as many bits of its hash as its position leaves, over
    the position, so a primitive sort brings equal windows together. Windows with
    equal hash bits are compared by their words; where two of a text differ in
    these alone, the text's windows are sorted once more as strings.
    """
    low, hashed, order, exact = (f"{stage}_{x}" for x in ("low", "hashed", "order", "exact"))
    one = F.lit(1).cast("long")
    df = df.withColumn(low, F.call_function("shiftleft", one, F.length(F.bin(F.size(words)))) - one)
    starts = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    mask = F.col(low)
    packed = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(-1 - mask).bitwiseOR(i.cast("long")))
    df = df.withColumn(hashed, F.sort_array(packed))
    s = F.col(hashed)

    def like(x: Column, y: Column) -> Column:
        """1: equal windows; 2: other windows with these hash bits; 0: other hash bits, or no window."""
        a, b = x.bitwiseAND(mask).cast("int"), y.bitwiseAND(mask).cast("int")
        full = (F.get(words, a) == F.get(words, b)) & (F.get(words, a + 1) == F.get(words, b + 1)) & (F.get(words, a + 2) == F.get(words, b + 2))
        return F.when(F.coalesce(x.bitwiseXOR(y).bitwiseAND(-1 - mask), F.lit(1)) != 0, 0).when(full, 1).otherwise(2)

    df = df.withColumn(order, F.transform(s, lambda x, j: like(x, F.get(s, j - 1))))
    code = F.col(order)
    strings = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("p"))))
    df = df.withColumn(exact, F.when(F.array_contains(code, 2), strings))
    t = F.col(exact)
    same = lambda x, y: F.coalesce(x["w"] == y["w"], F.lit(False))
    sure = F.transform(F.filter(t, lambda x, j: same(x, F.get(t, j - 1)) | same(x, F.get(t, j + 1))), lambda x: x["p"].cast("long"))
    quick = F.transform(F.filter(s, lambda x, j: (F.get(code, j) == 1) | (F.coalesce(F.get(code, j + 1), F.lit(0)) == 1)), lambda x: x.bitwiseAND(mask))
    df = df.withColumn(stage, F.sort_array(F.when(t.isNotNull(), sure).otherwise(quick)))
    covered = F.aggregate(
        F.col(stage),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("at")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["at"])).alias("n"), p.alias("at")),
        lambda acc: acc["n"],
    )
    return df.withColumn("n_repeat_words", covered).drop(stage, low, hashed, order, exact)


def measure(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) after the columns to carry."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*carry, "doc_id", "lang", "source", text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]"))
    df = df.select(
        *carry,
        "doc_id",
        "lang",
        "source",
        word_array(F.col("text")).alias("__words"),
        lines.alias("__lines"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
    )
    df = df.select(
        *carry,
        "doc_id",
        "lang",
        "source",
        "n_symbols",
        "__words",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
    )
    df = _repeat_words(F.col("__words"), "__windows", df).drop("__words")
    failed = (F.col("n_words") < MIN_WORDS) | (REPEAT_DEN * F.col("n_repeat_words") > REPEAT_NUM * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def bucket(value: Column) -> Column:
    """Lower end of a value's bucket: all values below 128, then 64 for each power of two."""
    drop = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    step = F.pow(F.lit(2.0), drop).cast("long")
    return value - value % step


def sketches(metrics: DataFrame) -> DataFrame:
    """(metric, scope, lang, source, value, n): bucket counts of each group, of each language and of all."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("value")) for m in METRICS))
    counts = metrics.select("lang", "source", F.explode(pairs).alias("p")).groupBy("lang", "source", "p.metric", "p.value").agg(F.count("*").alias("n"))
    scopes = F.array(
        F.struct(F.lit(0).alias("scope"), F.col("lang"), F.col("source")),
        F.struct(F.lit(1).alias("scope"), F.col("lang"), F.lit(None).cast("string").alias("source")),
        F.struct(F.lit(2).alias("scope"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")),
    )
    merged = counts.select("metric", "value", "n", F.explode(scopes).alias("s"))
    return merged.groupBy("metric", "s.scope", "s.lang", "s.source", "value").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """One row for each (scope, lang, source): its document count and each metric's fences."""
    group = ["metric", "scope", "lang", "source"]
    upto = Window.partitionBy(*group).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = sketch.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
    at = lambda num: F.min(F.when(F.col("upto") * 4 >= F.col("total") * num, F.col("value")))
    quart = cum.groupBy(*group).agg(F.max("total").alias("docs"), at(1).alias("q1"), at(3).alias("q3"))
    out = []
    for m, (_, least, lower) in METRICS.items():
        mine = F.col("metric") == m
        spread = F.greatest((F.col("q3") - F.col("q1")) * REACH, F.lit(least))
        out.append(F.max(F.when(mine, F.col("q3") + spread)).alias(f"{m}_hi"))
        out.append(F.max(F.when(mine, F.col("q1") - spread if lower else F.lit(-1))).cast("long").alias(f"{m}_lo"))
    return quart.groupBy("scope", "lang", "source").agg(F.max("docs").alias("docs"), *out)


def judge(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """measure() plus kept: the base rules hold and every metric lies within its group's fences.

    Fences have one row for each (lang, source); documents stay where they are.
    """
    base = stash(measure(docs, carry), "quality")
    good = base.filter(~F.col("base_failed")).select("lang", "source", *(F.expr(e).cast("long").alias(m) for m, (e, _, _) in METRICS.items()))
    limits = stash(fences(sketches(good)), "fences")
    names = [f"{m}_{end}" for m in METRICS for end in ("hi", "lo")]
    pick = lambda scope: limits.filter(F.col("scope") == scope).select(*(F.col(c).alias(f"__{c}_{scope}") for c in ("lang", "source", "docs", *names)))
    own, lang, every = pick(0), pick(1), pick(2)
    df = base.join(own, base["lang"].eqNullSafe(own["__lang_0"]) & base["source"].eqNullSafe(own["__source_0"]), "left")
    df = df.join(lang, base["lang"].eqNullSafe(lang["__lang_1"]), "left")
    # A join with one row, which Spark may run as a nested loop.
    df = df.withColumn("__all", F.lit(2)).join(every.withColumn("__scope", F.lit(2)), F.col("__all") == F.col("__scope"), "left")

    def limit(name: str) -> Column:
        return F.when(F.col("__docs_0") >= MIN_GROUP, F.col(f"__{name}_0")).when(F.col("__docs_1") >= MIN_GROUP, F.col(f"__{name}_1")).otherwise(F.col(f"__{name}_2"))

    inside = F.lit(True)
    for m, (e, _, _) in METRICS.items():
        value = F.expr(e).cast("long")
        inside = inside & (value <= limit(f"{m}_hi")) & (value >= limit(f"{m}_lo"))
    kept = F.when(F.col("base_failed"), False).otherwise(inside)
    return df.select(*(base[c] for c in base.columns), kept.alias("kept"))


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*COLUMNS)


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep."""
    names = {c: f"__doc_{i}" for i, c in enumerate(docs.columns)}
    carried = docs.select("doc_id", "lang", "source", "text", *(F.col(c).alias(n) for c, n in names.items()))
    kept = judge(carried, tuple(names.values())).filter("kept")
    return kept.select(*(F.col(n).alias(c) for c, n in names.items()))


def _oracle() -> str:
    cut = "({v} - {v} % (2 ** greatest(length(bin({v})) - 7, 0))::BIGINT)"
    duck = {m: e.replace("/", "//").replace("floor", "") for m, (e, _, _) in METRICS.items()}
    long = " UNION ALL ".join(f"SELECT scope, lang, source, '{m}' AS metric, {cut.format(v=m)} AS value FROM scoped" for m in METRICS)
    sides = []
    for m, (_, least, lower) in METRICS.items():
        spread = f"greatest((q3 - q1) * {REACH}, {least})"
        sides.append(f"max(CASE WHEN metric = '{m}' THEN q3 + {spread} END) AS {m}_hi")
        sides.append(f"max(CASE WHEN metric = '{m}' THEN {f'q1 - {spread}' if lower else '-1'} END) AS {m}_lo")
    limit = lambda n: f"CASE WHEN o.docs >= {MIN_GROUP} THEN o.{n} WHEN l.docs >= {MIN_GROUP} THEN l.{n} ELSE a.{n} END"
    inside = " AND ".join(f"({duck[m]}) BETWEEN {limit(f'{m}_lo')} AND {limit(f'{m}_hi')}" for m in METRICS)
    return f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS lines,
    row_number() OVER () AS rid FROM documents),
win AS (SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w) t),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win) t WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) t GROUP BY rid),
base AS (SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR {REPEAT_DEN} * n_repeat_words > {REPEAT_NUM} * n_words AS base_failed FROM base),
good AS (SELECT lang, source, {", ".join(f"{duck[m]} AS {m}" for m in METRICS)} FROM judged WHERE NOT base_failed),
scoped AS (SELECT 0 AS scope, * FROM good UNION ALL SELECT 1, lang, NULL, {", ".join(METRICS)} FROM good UNION ALL SELECT 2, NULL, NULL, {", ".join(METRICS)} FROM good),
vals AS ({long}),
hist AS (SELECT scope, lang, source, metric, value, count(*) AS n FROM vals GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY scope, lang, source, metric ORDER BY value) AS upto, sum(n) OVER (PARTITION BY scope, lang, source, metric) AS total FROM hist),
quart AS (SELECT scope, lang, source, metric, max(total) AS docs, min(CASE WHEN upto * 4 >= total THEN value END) AS q1, min(CASE WHEN upto * 4 >= total * 3 THEN value END) AS q3 FROM cum GROUP BY ALL),
lim AS (SELECT scope, lang, source, max(docs) AS docs, {", ".join(sides)} FROM quart GROUP BY scope, lang, source)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE {inside} END AS kept
FROM judged j LEFT JOIN lim o ON o.scope = 0 AND j.lang IS NOT DISTINCT FROM o.lang AND j.source IS NOT DISTINCT FROM o.source
LEFT JOIN lim l ON l.scope = 1 AND j.lang IS NOT DISTINCT FROM l.lang LEFT JOIN lim a ON a.scope = 2"""


ORACLE = _oracle()
