"""Mixing sources to target weights by Pareto order sampling.

DataFrame operations only. Every source has a target number of words. Whole
copies that every document of a source gets for certain are allotted first.
The rest of the target is an order sample with unequal probabilities: a
document's probability of inclusion is in proportion to a preference (the root
of its size), documents whose probability would reach 1 are certain, and the
others are ranked by the odds of a random number divided by the odds of their
inclusion. The lowest ranks are taken until the sample has its size, which is
fixed in words; what is left over goes to the next ranks that still fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, give_back, staged
from .simhash import ROW_HASH, row_hash

#: Rounds that the SQL of the same mix spells out; here they go on until nothing fits.
ROUNDS = 12
#: Bits of the bins in which a source's cut is searched.
BIN_BITS = 16
#: Steps of a preference's unit.
STEPS = 16


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with place, their number from 0 in the order of ``by`` (nulls last), sorted by ranges: one count per range reaches the driver."""
    order = F.col(by).asc_nulls_last()
    ranged = staged(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    before, total = [], 0
    for k, n in sorted(map(tuple, ranged.groupBy("_range").count().collect())):
        before += [F.lit(k), F.lit(total)]
        total += n
    first = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return ranged.withColumn("place", first + (F.create_map(*before)[F.col("_range")] if before else F.lit(0))).drop("_range")


def source_targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """Per source: source_size and target, from rows (source, size).

    Sources by code point, null last, get ``weights`` in turn and share
    ``share`` times all sizes; no target is over ``cap`` times its source's
    size, and what is cut off goes to the others by weight until none is above.
    That is min(cap * size, level * weight) with one level for all, which rises
    until no further source is cut. Only sums of sources reach the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = numbered(per, "source")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    per = staged(per.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("most")), "mix-sources")
    level, full = 0.0, -1
    while True:
        over = F.col("most") < F.lit(level) * F.col("weight")
        total, cut_off, free, n = per.agg(F.sum("source_size"), F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if n == full or not free:
            break
        level, full = ((total or 0) * float(share) - (cut_off or 0.0)) / free, n
    return per.select("source", "source_size", F.least("most", F.lit(level) * F.col("weight")).alias("target") if free else F.col("most").alias("target"))


def _with(rows: DataFrame, per_source: DataFrame, how: str = "left") -> DataFrame:
    """``rows`` with the columns of a table of one row per source (null is a source)."""
    other = per_source.withColumnRenamed("source", "_source")
    return rows.join(other, rows["source"].eqNullSafe(other["_source"]), how).drop("_source")


def inclusion(rows: DataFrame, per: DataFrame) -> DataFrame:
    """``per`` (source, gap) with scale, above and rest.

    A document of the source is included with probability scale * x, which
    makes the expected words of the sample the gap; those with x over ``above``
    (null: none) are certain, and ``rest`` is what they leave of the gap. Words
    are summed by x first, so a window has one row for each value of it.
    """
    groups = rows.filter("size > 0").groupBy("source", "x").agg(F.sum("size").alias("words"))
    groups = _with(groups, per.filter("gap > 0").select("source", "gap"), "inner")
    down = Window.partitionBy("source").orderBy(F.col("x").desc())
    certain = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    weighted = F.sum((F.col("x") * F.col("words")).cast("decimal(38,0)")).over(down.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    groups = groups.withColumn("rest", F.col("gap") - certain).withColumn("scale", (F.col("rest") / weighted)).filter((F.col("rest") >= 0) & (F.col("scale") * F.col("x") < 1))
    found = groups.groupBy("source").agg(F.max("x").alias("above"), F.max_by("scale", "x").alias("scale"), F.max_by("rest", "x").alias("rest"))
    return _with(per, found)


def _cuts(rows: DataFrame) -> DataFrame:
    """Per source (source, bin, cut, used) where its running size passes its gap.

    ``rows`` has source, size, gap, rank and fine, the rank's bin. Sizes are
    summed by bins before running sums are taken, so that only rows of the one
    bin in 2 ** BIN_BITS in which the gap is passed are ever ordered together.
    A source that fits whole has no row.
    """
    sums = rows.groupBy("source", "fine").agg(F.sum("size").alias("words"), F.first("gap").alias("gap"))
    reach = F.sum("words").over(Window.partitionBy("source").orderBy("fine"))
    over = sums.withColumn("reach", reach).filter("reach > gap")
    passed = over.groupBy("source").agg(F.min("fine").alias("bin"), F.min_by(F.col("reach") - F.col("words"), "fine").alias("base"))
    few = _with(rows, passed, "inner").filter("fine = bin")
    fits = few.withColumn("reach", F.col("base") + F.sum("size").over(Window.partitionBy("source").orderBy("rank")))
    inside = F.col("reach") <= F.col("gap")
    used = F.coalesce(F.max(F.when(inside, F.col("reach"))), F.first("base"))
    return fits.groupBy("source").agg(F.first("bin").alias("bin"), F.max(F.when(inside, F.col("rank"))).alias("cut"), used.alias("used"))


def _draws(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` (id, ROW_HASH and others) with u, a random number between 0 and 1 for each row.

    It is a function of the id where no other row has it. Rows that repeat an
    id, null included, draw each for itself: by ROW_HASH, and equal rows by a
    running number, which is dealt to their count, so no group is ordered.
    """

    def drawn(*parts: Column) -> Column:
        key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")), *parts)
        draw = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("bigint")
        return (draw + 0.5) / F.lit(2.0**52)

    repeated = rows.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("_n")).filter("_n > 1")
    repeated = staged(repeated, "mix-repeated")
    if repeated.isEmpty():
        return rows.withColumn("u", drawn())
    same = rows["id"].eqNullSafe(repeated["_id"])
    alone = rows.join(repeated, same, "left_anti").withColumn("u", drawn())
    several = rows.join(repeated, same, "left_semi").groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    several = several.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    several = several.withColumn("u", drawn(F.lit(":"), F.col(ROW_HASH).cast("string"), F.lit(":"), F.col("_k").cast("string")))
    return staged(alone.union(several.select(*alone.columns)), "mix-draws")


def mix(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """Per row of ``docs``: id, source, size, source_size, target, taken (``how``: see ``_mixed``)."""
    return _mixed(docs, id_col=id_col, **how).drop(ROW_HASH)


def _mixed(
    docs: DataFrame,
    *,
    weights: list[float],
    share: float,
    cap: float = 2.0,
    preference: Column | None = None,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per row of ``docs``: id, source, size, source_size, target, taken, ROW_HASH.

    size counts the words of the whole text (null: 0); taken is a multiple of
    it: the whole copies that every document of the source gets for certain,
    plus one if the order sample takes it. Probabilities of inclusion are in
    proportion to ``preference`` (default: the root of the size), which counts
    in steps of 1 / STEPS, one at least; null counts as that one.
    Ranks are a function of id and seed, so reruns agree; rows that repeat an
    id differ in their draws (``_draws``), so a cut can fall between them. The
    sample of a source has its certain documents and the longest run of lowest
    ranks that fits; documents over what is left are passed over, and further
    rounds fill the rest until no document fits.
    Null sources form one source, null ids one id; other columns only tell rows
    of one id apart; an empty table gives an empty table.
    """
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), size.alias("size"), (F.lit(None) if preference is None else preference).cast("double").alias("favour"), row_hash(docs).alias(ROW_HASH))
    favour = F.sqrt(F.col("size").cast("double")) if preference is None else F.col("favour")
    rows = rows.withColumn("x", F.coalesce(F.greatest(F.floor(favour * STEPS), F.lit(1)), F.lit(1)).cast("bigint")).drop("favour")
    rows = _draws(staged(rows, "mix-sizes"), seed)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    per = source_targets(rows.select("source", "size"), weights, share, cap).withColumn("copies", copies)
    per = per.withColumn("gap", F.floor(F.col("target") - F.col("copies") * F.col("source_size")).cast("bigint"))
    state = staged(inclusion(rows, per).withColumn("gap0", F.coalesce("rest", F.lit(0).cast("bigint"))), "mix-state")
    chance = F.col("scale") * F.col("x")
    rank = F.try_divide(F.col("u") / (1 - F.col("u")), F.try_divide(chance, 1 - chance))
    fine = F.floor(rank / (rank + 1) * (1 << BIN_BITS)).cast("bigint")
    certain = F.coalesce((F.col("size") > 0) & (F.col("x") > F.col("above")), F.lit(False))

    def taken_in(k: int) -> Column:
        below = F.col(f"bin{k}").isNull() | (F.col("fine") < F.col(f"bin{k}")) | ((F.col("fine") == F.col(f"bin{k}")) & F.coalesce(F.col("rank") <= F.col(f"cut{k}"), F.lit(False)))
        return (F.col("size") > 0) & (F.col("size") <= F.col(f"gap{k}")) & below & ~certain

    here = _with(rows, state.filter("gap0 > 0").select("source", "scale", "above"), "inner").withColumn("rank", rank).withColumn("fine", fine)
    open_, k = here.filter(~certain & (F.col("size") > 0)).select("source", "size", "rank", "fine", "x", "above"), 0
    while True:
        fitting = _with(open_, state.select("source", F.col(f"gap{k}").alias("gap")), "inner").filter("size <= gap")
        fitting = staged(fitting, "mix-open") if k else fitting
        if k and fitting.isEmpty():
            break
        fresh = _cuts(fitting).select("source", F.col("bin").alias(f"bin{k}"), F.col("cut").alias(f"cut{k}"), "used")
        # a source that fits whole has nothing left to fill
        state = staged(_with(state, fresh).withColumn(f"gap{k + 1}", F.coalesce(F.col(f"gap{k}") - F.col("used"), F.lit(0).cast("bigint"))).drop("used"), "mix-state")
        open_ = _with(fitting, state.select("source", f"gap{k}", f"bin{k}", f"cut{k}"), "inner").filter(~taken_in(k)).select("source", "size", "rank", "fine", "x", "above")
        k += 1
        give_back(docs.sparkSession)  # each round plans some joins more than the last
    here = _with(rows, state).withColumn("rank", rank).withColumn("fine", fine)
    chosen = certain
    for j in range(k):
        chosen = chosen | taken_in(j)
    taken = F.col("size") * (F.col("copies") + F.coalesce(chosen, F.lit(False)).cast("bigint"))
    return here.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.alias("taken"), ROW_HASH)


def keep_mixed(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them (none, once or more).

    Every row is decided for itself; rows that are equal in all columns are
    copied as often as all of them together are taken. Rows without words
    (null texts) are never taken; an empty table gives an empty one.
    """
    found = _mixed(docs, id_col=id_col, **how).filter("size > 0")
    times = found.groupBy(F.col(f"`{id_col}`").alias("_id"), F.col(ROW_HASH).alias("_hash")).agg(F.sum((F.col("taken") / F.col("size")).cast("int")).cast("int").alias("_times"), F.count("*").alias("_equal"))
    times = staged(times.filter("_times > 0"), "mix-times")
    marked = docs.select(F.col(f"`{id_col}`").alias("_own"), row_hash(docs).alias(ROW_HASH), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    kept = marked.join(times, (marked[ROW_HASH] == times["_hash"]) & marked["_own"].eqNullSafe(times["_id"]))
    if not times.filter("_equal > 1").isEmpty():
        kept = kept.filter("_equal = 1").union(kept.filter("_equal > 1").dropDuplicates(["_id", "_hash"]))
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*(F.col("_row")[c].alias(c) for c in docs.columns))
