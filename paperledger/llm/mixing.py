"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, -ln(u) / weight, whose ``u`` is a hash of its id and the seed, so that reruns
agree. Within a source, documents in key order are a weighted sample without replacement of any length. A source's
target is taken as so many complete epochs, each all of its documents, and then the documents of least key up to the
rest of the budget.

No task sorts a whole source, whatever the weights: keys fall into bins by their logarithm, ``COARSE`` to an octave, and
within a bin into ``FINE`` more; sizes are summed by source and bin, the bin in which the budget ends is found from
those sums, then the finer bin within it, and only that one's documents are sorted. The decision is a cut key for each
source, so a source that holds a third of all rows is no harder than others. Sources, of which there may be many, are
numbered by a distributed sort, and their targets are found by sums over all sources.

Defined cases: a null text has size 0 and is never taken; null sources are one source, the last; an empty table gives
an empty result; rows that repeat a ``doc_id`` share one key, count each, and are taken alike; null ids share one key
too; of a very long text only its number of words goes further; other columns, whatever their names, go along as they
are. A weight must be positive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

COARSE, FINE = 256, 4096
WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.05 to 1: the squared share of letters and white space, low for junk of signs and digits."""
    text = F.coalesce(text, F.lit(""))
    share = F.try_divide(F.length(F.regexp_replace(text, r"[^\p{L}\s]+", "")), F.length(text))
    return F.greatest(F.lit(0.05), F.pow(F.coalesce(share, F.lit(0.0)), 2))


def exponential_key(doc_id: Column, weight: Column, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(doc_id.cast("string"), F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / weight


def _keyed(docs: DataFrame, seed: int, weight: Column | None) -> DataFrame:
    """The whole row, and beside it what the mix needs of it."""
    text = F.col("text")
    key = exponential_key(F.col("doc_id"), quality_weight(text) if weight is None else weight, seed)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, F.col("doc_id").alias("id"), words(text).alias("size"), F.greatest(key, F.lit(1e-300)).alias("key"), F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source"))


def _bins(key: Column) -> tuple[Column, Column]:
    """The coarse bin of a key, and the fine one within it; both rise with the key."""
    at = F.log2(key) * COARSE
    return F.floor(at), F.floor((at - F.floor(at)) * FINE)


def _numbered(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with ``number``, their rank from 0 in the order of ``by``: within its partition of a sort, and past the
    rows of those before. Written, ids are the same in every scan."""
    kept = scratch.table(rows.orderBy(*by).withColumn("at", F.monotonically_increasing_id()), "numbered")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = kept.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    joined = kept.withColumn("part", part).join(F.broadcast(before), "part")  # a row for each partition of the sort
    return joined.withColumn("number", F.col("before") + within).drop("part", "before", "at")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``none, source, source_size`` with ``target`` added. Sources take ``weights`` in turn, by code point, null last.
    Water-filling: the level rises by what full sources leave to the others until no more become full."""
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    full = F.col("source_size") * F.lit(float(most))
    t = scratch.table(_numbered(sizes, "none", "source").select("none", "source", "source_size", turn.alias("w"), full.alias("full")), "sources")
    level, last = 0.0, -1
    while True:
        open_ = F.col("full") > F.lit(level) * F.col("w")
        left = t.agg(F.sum("source_size").alias("all"), F.sum(F.when(open_, 0.0).otherwise(F.col("full"))).alias("full"), F.sum(F.when(open_, F.col("w"))).alias("w"), F.count(F.when(~open_, 1)).alias("n")).first()
        if not left.w or left.n == last:
            break
        last = left.n
        level = max(level, (left.all - left.full) / left.w)
    return t.select("none", "source", "source_size", F.least("full", F.lit(level) * F.col("w")).alias("target"))


def _end(sized: DataFrame, by: list[str], at: str, goals: DataFrame) -> DataFrame:
    """Of each group of ``by``, the bin ``at`` in which the budget ``rest`` ends, with the budget that is left there."""
    sums = sized.groupBy(*by, at).agg(F.sum("size").alias("in_bin"))
    upto = F.sum("in_bin").over(Window.partitionBy(*by).orderBy(at))
    ends = sums.withColumn("before", upto - F.col("in_bin")).join(goals, by).where("before <= rest and rest < before + in_bin")
    return ends.select(*by, at, (F.col("rest") - F.col("before")).alias("rest"))


def _cuts(light: DataFrame, goals: DataFrame) -> DataFrame:
    """For each source: source_size, target, epochs, and the bin, last key and id of the fractional epoch (null: none)."""
    by = ["none", "source"]
    goals = goals.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
    goals = goals.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    coarse, fine = _bins(F.col("key"))
    ends = _end(light.withColumn("coarse", coarse), by, "coarse", goals.select(*by, "rest"))
    ends = scratch.table(ends, "mixing-bins")
    within = light.withColumns({"coarse": coarse, "fine": fine}).join(ends.drop("rest"), [*by, "coarse"])
    last = within.join(_end(within, [*by, "coarse"], "fine", ends), [*by, "coarse", "fine"])
    last = last.withColumn("upto", F.sum("size").over(Window.partitionBy(*by).orderBy("key", "id")))
    # The document that crosses the budget comes in when that lands nearer to it than to leave it out.
    near = last.where(F.col("upto") - F.col("rest") <= F.col("rest") - (F.col("upto") - F.col("size")))
    cut = near.groupBy(*by).agg(F.max(F.struct("key", "id")).alias("cut"))
    first = last.groupBy(*by).agg(F.min("fine").alias("fine"))
    found = ends.drop("rest").join(first, by, "left").join(cut, by, "left")
    return goals.drop("rest").join(found, by, "left")


def mix(docs: DataFrame, seed: int = 17, weight: Column | None = None, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (size times the number of times it is taken).
    ``weight`` is a positive Column over ``docs``; by default it comes from the text."""
    light = scratch.table(_keyed(docs, seed, weight).drop("row"), "mixing")
    return _plan(light, weights).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def _plan(light: DataFrame, weights: tuple[float, ...], rows: DataFrame | None = None) -> DataFrame:
    goals = targets(light.groupBy("none", "source").agg(F.sum("size").alias("source_size")), weights)
    ends = scratch.table(_cuts(light, goals), "mixing-cuts").withColumnsRenamed({"coarse": "end_coarse", "fine": "end_fine"})
    coarse, fine = _bins(F.col("key"))
    part = (coarse < F.col("end_coarse")) | ((coarse == F.col("end_coarse")) & (fine < F.col("end_fine"))) | (F.struct("key", "id") <= F.col("cut"))
    taken = F.when(F.col("size") > 0, F.col("epochs") + F.coalesce(part, F.lit(False)).cast("long")).otherwise(F.lit(0))
    return (light if rows is None else rows).join(ends, ["none", "source"]).withColumn("times", taken)


def mixed(docs: DataFrame, seed: int = 17, weight: Column | None = None, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as the mix takes it, in the columns of ``docs``."""
    rows = _keyed(docs, seed, weight)
    light = scratch.table(rows.drop("row"), "mixing")
    times = F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))
    return _plan(light, weights, rows).where("times > 0").select("row", times.alias("time")).select("row.*")
