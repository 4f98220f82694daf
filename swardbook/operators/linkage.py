"""Record linkage: sheet names to roster clients.

Exact keys are an equi-join. Names without one are scored, each distinct name
once, but only against rows that an index brings together. Two names reach the
least score only if the longest token of one is like some token of the other, or
their loose keys are nearly equal, or one has no token and the keys are nearly
equal. Tokens that are alike are found once for the vocabulary, by index keys.
Rows and names then meet in the blocks of a token; the blocks of a token that
many share are cut in parts, so that every name meets every row of its token in
one task or another, and no task holds them all. Inside a block letter counts
bound each score, rows are scored in falling order of their bounds, and a name
stops when no row left can change its answer.

Rows that are told apart by numbers alone (SMITH, Mary 1001) have a body: the
name with its rare numbers left open. A dense run of numbers has many neighbours
of each, nearly all of other names, so these rows are not met by their tokens.
Names meet the bodies first, and go to the rows of a body only if some number
could bring them to the least score; inside, likeness of numbers is looked up.

Nothing is broadcast by hand or collected. The names and the roster, with their
forms, are read many times, so both are checkpointed when they are made; all
else is one lazy plan. Tokens and keys are many times the names that they are
of, which Spark does not expect when it plans, so their joins are asked for as
merges: else it sends what it takes for small through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType

from ..functions import names as N
from ..functions import text as T
from .numbering import numbered, prefix
from .once import once
from .views import has_prices, is_set_up

#: Fixed values of the rule: least score, least lead over the second.
SCORE, MARGIN = 0.82, 0.04
#: Names in a part of a block of tokens, and how many times as many names and rows of a body.
PART, WIDE = 2048, 8
#: Rows that share a token or a body, from so many on, for it to be a common one.
COMMON = 32
#: Parts of the names, for each partition, that meet the bodies.
FINE = 4
#: Rows of a block that are scored without bounds, that are bounded before numbers are looked up, and rows of like numbers that are scored first, at most.
FEW, SOME, NEAR = 4, 48, 64


@F.pandas_udf(DoubleType())
def name_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([N.similarity(a or "", b or "") for a, b in zip(left, right)], dtype="float64")


def _keys(least: float | None, left: bool):
    """Index keys of a column of tokens (least None) or keys."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: N.token_keys(t, left) if least is None else N.index_keys(t, least, left))

    return run


def _keys_for(least: float, left: bool):
    """Index keys of keys for the lengths that the other side has."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([N.index_keys(t, least, left, sorted(set(map(int, n)))) for t, n in zip(texts, sizes)])

    return run


@F.pandas_udf(BooleanType())
def _alike(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([N.alike(a, b) for a, b in zip(left, right)], dtype="bool")


@F.pandas_udf(BooleanType())
def _near(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    return pd.Series([N.reaches(x, y, n) for x, y, n in zip(a, b, least)], dtype="bool")


def with_forms(df: DataFrame, name: str) -> DataFrame:
    """Add key, loose, tokens and lead of a name, as functions.names has them."""
    low = F.lower(F.coalesce(name, F.lit("")))
    words = F.filter(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 1)
    df = df.withColumns({"key": F.regexp_replace(low, "[^a-z0-9]", ""), "tokens": words})
    longest = F.aggregate("tokens", F.lit(""), lambda acc, w: F.when(F.length(w) > F.length(acc), w).otherwise(acc))
    return df.withColumns({"loose": F.regexp_replace("key", r"(.)\1+", "$1"), "lead": longest})


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def alike_tokens(names: DataFrame, rows: DataFrame) -> DataFrame:
    """(t, u): tokens of names and of rows that count as the same, one of them the longest of its name. Both with forms."""
    spread = lambda df: df.select(F.explode("tokens").alias("t"), "lead").groupBy("t").agg(F.max(F.col("t") == F.col("lead")).alias("leads"))
    mine = spread(names).select("t", "leads", F.explode(_keys(None, True)("t")).alias("k"))
    theirs = spread(rows).select(F.col("t").alias("u"), F.col("leads").alias("u_leads"), F.explode(_keys(None, False)("t")).alias("__k"))
    met = mine.join(theirs.hint("merge"), (F.col("k") == F.col("__k")) & (F.col("leads") | F.col("u_leads"))).select("t", "u")
    # The pairs are few bytes and much work: a set number of parts, and no filter that slips below it.
    return met.repartition(_parts(names), "t").distinct().filter(_alike.asNondeterministic()("t", "u"))


def _token_sides(names: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, sheet_name, far) and (block, id, name, rank, priced): a name and a row share a block if they may be alike by a token.

    A row stands under its longest token, where names with any token like it come,
    and under its others, where only names whose longest token is like them come.
    """
    pairs = alike_tokens(names, rows)
    said = names.select("sheet_name", F.explode("tokens").alias("token"), "lead").join(pairs.hint("merge"), F.col("token") == F.col("t"))
    block = lambda lead: F.explode(F.when(lead, F.array(F.concat(F.lit("lead:"), "u"), F.concat(F.lit("other:"), "u"))).otherwise(F.array(F.concat(F.lit("lead:"), "u"))))
    mine = said.select("sheet_name", block(F.col("token") == F.col("lead")).alias("block"), F.lit(True).alias("far")).distinct()
    kind = F.when(F.col("token") == F.col("lead"), "lead:").otherwise("other:")
    theirs = rows.select("id", "name", "rank", "priced", F.explode(F.array_distinct("tokens")).alias("token"), "lead").select("id", "name", "rank", "priced", F.concat(kind, "token").alias("block"))
    return mine, theirs


def _open_numbers(rows: DataFrame) -> DataFrame:
    """Add body: the words of a name with # for each digit of a rare number, where COMMON rows or more share it; else null.

    There is none for names with another rare token, whose index keys are few,
    with digits elsewhere, or with one common token or none besides the numbers.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce("name", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    each = rows.select("rank", F.posexplode(words).alias("pos", "word"))
    common = each.filter("length(word) > 1").groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON).select(F.col("word").alias("__word"))
    word, token, rare = F.col("word"), F.length("word") > 1, F.col("__word").isNull()
    opened = token & rare & word.rlike("^[0-9]+$")
    kind = F.when(opened, 2).when(word.rlike("[0-9]") | token & rare, 3).when(token, 1).otherwise(0)
    told = each.join(common, word == F.col("__word"), "left").select("rank", "pos", kind.alias("kind"), F.when(opened, F.repeat(F.lit(N.OPEN), F.length("word"))).otherwise(word).alias("word"))
    kinds = {f"n{k}": F.count_if(F.col("kind") == k) for k in (1, 2, 3)}
    bodies = told.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"), *(v.alias(k) for k, v in kinds.items())).filter("n1 > 1 AND n2 > 0 AND n3 = 0")
    bodies = bodies.select("rank", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("body"))
    many = bodies.groupBy("body").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON).select("body")
    return rows.join(bodies.join(many, "body", "left_semi").hint("merge"), "rank", "left")


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, body, far) of names and the bodies with a row that they may be close to; far: also one whose number is not like theirs. Bodies come before names, and parts come whole."""
    types = (pa.string(), pa.string(), pa.bool_())
    at, bodies, table = None, [], None
    for batch in batches:
        out = []
        for part, side, text in zip(*(c.to_pylist() for c in batch.columns)):
            if part != at:
                at, bodies, table = part, [], None
            if side == 0:
                bodies.append(text)
            elif bodies:
                table = table or N.Bodies(bodies)
                far = table.bounds(text, apart=True)
                out += [(text, bodies[k], bool(far[k] >= SCORE)) for k in np.flatnonzero(table.bounds(text) >= SCORE)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], names=["text", "body", "far"])


def _body_sides(names: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same as _token_sides for rows with a body: they stand under it, where the names come that may be close to one of them.

    Names that differ in digits alone fit the same bodies.
    """
    n = FINE * _parts(names)
    shape = F.concat(F.regexp_replace(F.lower("sheet_name"), "[0-9]", "0"), F.lit("|"), F.length("loose"))
    shaped = names.select("sheet_name", shape.alias("shape"))
    shapes = shaped.groupBy("shape").agg(F.min("sheet_name").alias("text"))
    left = shapes.select(F.pmod(F.xxhash64("text"), n).cast("int").alias("part"), F.lit(1).alias("side"), "text")
    right = rows.select("body").distinct().select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"), F.lit(0).alias("side"), F.col("body").alias("text"))
    dealt = right.union(left).repartition(_parts(names), "part").sortWithinPartitions("part", "side")
    block = F.concat(F.lit("body:"), "body").alias("block")
    fit = dealt.mapInArrow(_fit, "text string, body string, far boolean").select("text", block, "far")
    mine = shaped.join(shapes.hint("merge"), "shape").join(fit.hint("merge"), "text")
    return mine.select("block", "sheet_name", "far"), rows.select("id", "name", "rank", "priced", block)


def _sides(names: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names and rows in their blocks: rows with a body by it, others by their tokens. Of names, far: rows without a number like theirs count too."""
    told, others = rows.filter("body IS NOT NULL"), rows.filter("body IS NULL")
    sides = [f(names, r) for f, r in ((_body_sides, told), (_token_sides, others)) if not r.isEmpty()] or [_token_sides(names, others)]
    mine, theirs = zip(*sides)
    return reduce(DataFrame.union, (m.select("block", "sheet_name", "far") for m in mine)), reduce(DataFrame.union, (t.select("block", "id", "name", "rank", "priced") for t in theirs))


def _near_keys(names: DataFrame, rows: DataFrame) -> DataFrame:
    """(sheet_name, id, name, rank, priced) of names and rows whose loose keys are nearly equal, or their keys where one has no token."""
    row = ["id", "name", "rank", "priced"]

    def met(left: DataFrame, right: DataFrame, form: str, least: float) -> DataFrame:
        both = left.join(right.hint("merge"), F.col("k") == F.col("__k")).select("sheet_name", *row, form, f"r_{form}")
        dealt = both.repartition(_parts(names), "sheet_name").distinct()
        return dealt.filter(_near.asNondeterministic()(form, f"r_{form}", F.lit(least))).select("sheet_name", *row)

    def side(df: DataFrame, form: str, keys: Column, left: bool) -> DataFrame:
        return df.select("sheet_name", form, F.explode(keys).alias("k")) if left else df.select(*row, F.col(form).alias(f"r_{form}"), F.explode(keys).alias("__k"))

    loose = met(side(names, "loose", _keys(N.SURE, True)("loose"), True), side(rows, "loose", _keys(N.SURE, False)("loose"), False), "loose", N.SURE)
    bare = lambda df: df.filter("key <> '' AND cardinality(tokens) = 0")
    # Whole keys are indexed for those lengths only that keys without a token have.
    sized = lambda df, of: df.crossJoin(bare(of).agg(F.collect_set(F.length("key")).alias("sizes"))).filter("cardinality(sizes) > 0")
    few = met(side(bare(names), "key", _keys(SCORE, True)("key"), True), side(sized(rows, names), "key", _keys_for(SCORE, False)("key", "sizes"), False), "key", SCORE)
    back = met(side(sized(names, rows), "key", _keys_for(SCORE, True)("key", "sizes"), True), side(bare(rows), "key", _keys(SCORE, False)("key"), False), "key", SCORE)
    return loose.union(few).union(back).distinct()


def _counted(df: DataFrame, n: str) -> DataFrame:
    return df.groupBy("block").agg(F.count("*").alias(n))


def candidate_pairs(names: DataFrame, roster: DataFrame) -> DataFrame:
    """(names, rows, pairs): how many pairs the blocks bring together; roster as for filing."""
    asked = once(with_forms(names.select("sheet_name").filter("sheet_name IS NOT NULL").distinct(), "sheet_name"))
    people = _people(roster)
    mine, theirs = _sides(asked, people)
    both = _counted(mine, "n").join(_counted(theirs, "m"), "block").agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("pairs"))
    return asked.agg(F.count("*").alias("names")).crossJoin(people.agg(F.count("*").alias("rows"))).crossJoin(both)


_BEST = "sheet_name string, id long, score double, rank long"


class _Block:
    """Rows of a block, and a name's answer from them."""

    def __init__(self, rows: list[tuple], skip_same: bool) -> None:
        self.rows, self.skip_same = rows, skip_same
        self.keys = [N.spelling(r[1]).key for r in rows]
        # A few rows are sooner scored than bounded.
        self.table = N.Table([r[1] for r in rows]) if len(rows) > FEW else None

    def best(self, name: str, far: bool = True) -> list[tuple]:
        """The two best rows, or two that show a tie: (name, id, score, rank); without far, of rows with a number that is like a token of the name.

        Only the best is used, and only if no other comes close, so rows whose
        bound cannot change that are not scored. Rows of like numbers are scored
        first: where they are two of the highest score, none is bounded.
        """
        own = N.spelling(name).key
        found: list[tuple[float, int, int]] = []

        def settled(most: float) -> bool:
            if most < SCORE or found and most <= -found[0][0] - MARGIN:
                return True
            first, second = (-found[0][0], -found[1][0]) if len(found) == 2 else (0.0, 0.0)
            return len(found) == 2 and (most <= second or most <= first and second > first - MARGIN)

        def score(k: int) -> None:
            nonlocal found
            i, text, rank, priced = self.rows[k]
            equal = self.keys[k] == own
            # A row of the same key is filed by it, or is no suggestion.
            score = 0.0 if equal and (self.skip_same or not priced) else 1.0 if equal else N.similarity(name, text, SCORE)
            if score >= SCORE:
                found = sorted([*found, (-score, rank, i)])[:2]

        likely: list[int] = []
        # In a small block all rows are sooner bounded than numbers looked up.
        if self.table and len(self.rows) > SOME:
            near = self.table.near_numbers(name).tolist()
            likely = near if not far or len(near) <= NEAR else []
        for k in likely:
            if settled(1.0):
                break
            score(k)
        if (far or len(self.rows) <= SOME) and not settled(1.0):
            least = max(SCORE, -found[0][0] - MARGIN) if found else SCORE
            bounds = self.table.bounds(name, least) if self.table else np.ones(len(self.rows))
            bounds[likely] = 0.0
            left = np.flatnonzero(bounds >= SCORE)
            for k in left[(-bounds[left]).argsort(kind="stable")].tolist():
                if settled(bounds[k]):
                    break
                score(k)
        return [(name, i, -score, rank) for score, rank, i in found]


def _meet(skip_same: bool):
    """Score the names of each block with its rows; rows come before names, and blocks come whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, block, out = None, [], None, []
        for batch in batches:
            for *key, side, name, i, rank, priced, far in zip(*(c.to_pylist() for c in batch.columns)):
                if key != at:
                    at, rows, block = key, [], None
                if side == 0:
                    rows.append((i, name, rank, priced))
                elif rows:
                    block = block or _Block(rows, skip_same)
                    out += block.best(name, far)
            if out:
                yield _best_rows(out)
                out = []

    return run


def _best_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.float64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in _BEST.split(", ")])


def _parted(df: DataFrame, sizes: DataFrame, own: str, other: str, by: str) -> DataFrame:
    """Deal the rows of a block to parts of about PART, or WIDE times that in a block of a body, and repeat them for each part of the other side."""
    parts = lambda n: F.ceil(F.col(n) / F.when(F.col("block").startswith("body:"), PART * WIDE).otherwise(PART)).cast("int")
    mine = F.pmod(F.xxhash64(by), parts(own)).cast("int").alias(f"{own}_part")
    return df.join(sizes.hint("merge"), df["block"] == sizes["__block"]).select("*", mine, F.explode(F.sequence(F.lit(0), parts(other) - 1)).alias(f"{other}_part"))


def _scored(names: DataFrame, roster: DataFrame, skip_same: bool) -> DataFrame:
    """(sheet_name, id, score, rank): rows that decide a name's answer. names: sheet_name; roster: id, name, rank, priced, body; both with forms."""
    asked, rows = (df.filter("key <> ''") for df in (names, roster))
    mine, theirs = _sides(asked, rows)
    mine = once(mine)
    sizes = _counted(mine, "n").join(_counted(theirs, "m").hint("merge"), "block").withColumnRenamed("block", "__block")
    columns = ["block", "n_part", "m_part", "side", "name", "id", "rank", "priced", "far"]
    nothing = {"id": F.lit(None).cast("long"), "rank": F.lit(None).cast("long"), "priced": F.lit(None).cast("boolean")}
    left = _parted(mine, sizes, "n", "m", "sheet_name").withColumns({"side": F.lit(1), "name": F.col("sheet_name"), **nothing}).select(columns)
    right = _parted(theirs, sizes, "m", "n", "id").withColumns({"side": F.lit(0), "far": F.lit(None).cast("boolean")}).select(columns)
    dealt = right.union(left).repartition(_parts(names), "block", "n_part", "m_part").sortWithinPartitions("block", "n_part", "m_part", "side")
    by_token = dealt.mapInArrow(_meet(skip_same), _BEST)

    others = rows.filter("body IS NULL")
    if others.isEmpty():
        return by_token
    near = _near_keys(asked, others).withColumn("equal", T.name_key(F.col("sheet_name")) == T.name_key(F.col("name")))
    near = near.filter(~F.col("equal") | (F.lit(not skip_same) & F.col("priced")))
    near = near.select("sheet_name", "id", F.when(F.col("equal"), 1.0).otherwise(name_similarity("sheet_name", "name")).alias("score"), "rank").filter(F.col("score") >= SCORE)
    return by_token.union(near).distinct()


def _ranked(roster: DataFrame) -> DataFrame:
    """The roster with rank, its order: sort_order with nulls last, then name, then id."""
    people = roster.withColumns({"priced": has_prices(), "set_up": is_set_up()})
    place = F.col("sort_order")
    return numbered(people, "rank", [place.asc_nulls_last(), "name", "id"], [place.isNull(), place, prefix(F.col("name"))])


def _people(roster: DataFrame) -> DataFrame:
    people = once(with_forms(_ranked(roster).select("id", "name", "on_roster", "priced", "set_up", "rank"), "name"))
    return once(_open_numbers(people))


def _clear_best(scored: DataFrame) -> DataFrame:
    """(sheet_name, best, tied): the best row of each name, and whether the second is too close."""
    w = Window.partitionBy("sheet_name").orderBy(F.desc("score"), "rank")
    rows = scored.withColumns({"__r": F.row_number().over(w), "__next": F.lead("score").over(w)}).filter("__r = 1")
    return rows.select("sheet_name", F.col("id").alias("best"), F.coalesce(F.col("__next") > F.col("score") - MARGIN, F.lit(False)).alias("tied"))


def file_clients(names: DataFrame, roster: DataFrame) -> DataFrame:
    """(sheet_name, client_id): the client whose bill each distinct name belongs on, null if none is clear.

    In order: an exact key with prices; an exact key left off the roster; one
    clear close spelling among set-up clients; an exact key, set up or not.
    """
    people = _people(roster)
    asked = with_forms(names.select("sheet_name").filter(F.col("sheet_name").isNotNull()).distinct(), "sheet_name")
    first = lambda when: F.min_by(F.when(when, F.col("id")), F.when(when, F.col("rank")))
    off = F.coalesce(~F.col("on_roster"), F.lit(False))
    exact = people.filter("key <> ''").groupBy("key").agg(first(F.col("priced")).alias("e_priced"), first(off).alias("e_off"), first(F.col("set_up")).alias("e_set"), first(~F.col("set_up")).alias("e_unset"), first(F.lit(True)).alias("e_any"))
    named = once(asked.join(exact.hint("merge"), "key", "left"))
    sure = F.coalesce("e_priced", "e_off")
    best = _clear_best(_scored(named.filter(sure.isNull()), people.filter("set_up"), skip_same=False))
    out = named.join(best.hint("merge"), "sheet_name", "left")
    none = F.col("best").isNull()
    scored = F.when(none, F.coalesce("e_set", "e_unset", "e_any")).when(F.col("tied"), F.coalesce("e_set", "e_unset")).otherwise(F.col("best"))
    return out.select("sheet_name", F.coalesce(sure, scored).alias("client_id"))


def suggest_clients(names: DataFrame, roster: DataFrame) -> DataFrame:
    """(sheet_name, suggestion, suggestion_name): the one close spelling of another key, set up or not."""
    people = _people(roster)
    asked = once(with_forms(names.select("sheet_name").filter(F.col("sheet_name").isNotNull()).distinct(), "sheet_name"))
    best = _clear_best(_scored(asked, people, skip_same=True)).filter(~F.col("tied"))
    return best.join(people.select(F.col("id").alias("best"), F.col("name").alias("suggestion_name")).hint("merge"), "best").select("sheet_name", F.col("best").alias("suggestion"), "suggestion_name")


def open_conflicts(rows: DataFrame, roster: DataFrame, resolutions: DataFrame | None = None, filed: DataFrame | None = None) -> DataFrame:
    """Names on sheets that file nowhere and are not answered: one row a key with all its work, and a suggestion.

    rows: seq, name, work. Texts already contained in the joined work are not
    repeated. filed: what file_clients gave for the names, if that is known.
    """
    keyed = rows.withColumn("key", T.name_key(F.col("name"))).filter("key <> ''")
    if filed is None:
        filed = file_clients(keyed.select(F.col("name").alias("sheet_name")), roster)
    filed = filed.filter("client_id IS NOT NULL")
    still = keyed.join(filed.hint("merge"), F.col("name") == F.col("sheet_name"), "left_anti")
    if resolutions is not None:
        done = resolutions.select(T.name_key(F.col("name")).alias("__key")).distinct()
        still = still.join(done, F.col("key") == F.col("__key"), "left_anti")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("work", F.lit("")).alias("work")))), lambda x: x["work"])
    joined = F.aggregate(texts, F.lit(""), lambda acc, x: F.when(acc == "", x).when((x == "") | acc.contains(x), acc).otherwise(F.concat_ws(" ", acc, x)))
    grouped = still.groupBy("key").agg(F.min("seq").alias("seq"), F.min_by("name", "seq").alias("name"), joined.alias("work"))
    hints = suggest_clients(grouped.select(F.col("name").alias("sheet_name")), roster)
    return grouped.join(hints.hint("merge"), F.col("name") == F.col("sheet_name"), "left").drop("sheet_name")


def retarget_month(work: DataFrame, roster: DataFrame, month: str) -> DataFrame:
    """(month, source, target) moves of a month's clients to the client their name files under."""
    mine = work.filter(F.col("month") == month).select("client_id").distinct()
    names = roster.join(mine.hint("merge"), F.col("id") == F.col("client_id"), "left_semi").select(F.col("id").alias("source"), F.col("name").alias("sheet_name"))
    filed = file_clients(names, roster.filter(F.coalesce("on_roster", F.lit(True))))
    return names.join(filed.hint("merge"), "sheet_name").filter("client_id IS NOT NULL AND client_id <> source").select(F.lit(month).alias("month"), "source", F.col("client_id").alias("target"))


def orphans(clients: DataFrame, work: DataFrame, moves: DataFrame) -> DataFrame:
    """Sources of moves that are not set up and have no work left: rows to delete."""
    moved = moves.select(F.col("source").alias("__s")).distinct()
    return clients.join(moved, F.col("id") == F.col("__s"), "left_semi").filter(~is_set_up()).join(work.select(F.col("client_id").alias("__c")), F.col("id") == F.col("__c"), "left_anti").select("id")
