"""Mixing sources to target weights over training time, with DataFrame operations only.

Each source has a weight and a schedule: a piecewise linear density of its demand over training time 0..1. The source's
target is its share of all words, at most ``max_repeats`` times its size, the excess shared out again by weight (a
water level over the sources). A source's documents, in md5 order of their ids, form a stream that is read round and
round until the target is met; the cumulative words before a copy are its demand level, and inverting the schedule's
integral at that level gives the copy's training position. Documents are range-sorted by position.

The running sums use md5 buckets: sums per (source, bucket), a running sum over a source's buckets, and one inside each
bucket, so that a source with a third of all rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, fresh, materialize, row_keys

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Schedules by the source's place in the order, repeating: (time, density) knots, scaled so that each integral is 1.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.4), (0.5, 0.8), (1.0, 2.0)))


def n_words(text: Column) -> Column:
    """Number of runs of other characters than space and U+0009-U+000D; null has none."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return (F.length(F.regexp_replace(F.concat(F.lit(" "), flat), r" (?=[^ ])", "  ")) - F.length(flat) - 1).cast("long")


def integral(knots: tuple[tuple[float, float], ...]) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def inverse(level: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which the schedule's integral reaches level (0..1) of its whole."""
    whole, done, out, prior = integral(knots), 0.0, F.lit(knots[-1][0]), []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        a, b, part = (w1 - w0) / (t1 - t0) / whole, w0 / whole, (t1 - t0) * (w0 + w1) / 2 / whole
        x = level - F.lit(done)
        # a/2 s^2 + b s = x, in the form that also holds for a = 0
        s = F.lit(2.0) * x / (F.lit(b) + F.sqrt(F.greatest(F.lit(0.0), F.lit(b * b) + F.lit(2.0 * a) * x)))
        prior.append((done + part, F.when(x <= 0, F.lit(t0)).otherwise(F.lit(t0) + s)))
        done += part
    for top, t in reversed(prior):
        out = F.when(level <= F.lit(top), t).otherwise(out)
    return F.least(F.lit(knots[-1][0]), out)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """(source, source_size, rank, target) of (source, source_size): a row for each source.

    Sources by code point, null last. target = min(weight * level, max_repeats * size), with the level at which all
    targets add up to all words. Sources sorted by max_repeats * size / weight: the first ones are at their cap.
    """
    w = Window.orderBy(F.col("source").isNull(), "source")
    s = sizes.withColumn("rank", F.row_number().over(w) - 1)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    s = s.withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", "rank")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("total", total)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(rest))
    # The first source in this order that is not at its cap fixes the level of all after it; taking later ones for the
    # first gives lower levels, so it is the greatest.
    level = F.max(F.when(F.col("full_at") > F.col("level"), F.col("level"))).over(Window.partitionBy())
    s = s.withColumn("level", level)
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("level")))
    return s.select("source", "source_size", "rank", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = 3, schedules=SCHEDULES, bucket_rows: int = 2000) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies, position (of the first copy) and positions of all documents.

    copies: how often the document is read, the last time perhaps in part. position is null where taken is 0 (documents
    without words, or beyond the target). Null ids and sources count as values; equal ids are ordered by size. Reruns
    agree as only ids, sizes and sources decide. Sizes are counted once, into a narrow table of the shared folder.
    """
    d = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    return _mix(d, weights, max_repeats, schedules, bucket_rows)


def _mix(d: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = 3, schedules=SCHEDULES, bucket_rows: int = 2000, keep: tuple[str, ...] = ()) -> DataFrame:
    """mix of (doc_id, source, size) and the columns to keep."""
    n = d.count()
    digits = 1
    while digits < 6 and 16**digits * bucket_rows < n:
        digits += 1
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    d = d.withColumns({"_key": key, "_bucket": F.substring(key, 1, digits)})
    sums = d.groupBy("source", "_bucket").agg(F.sum("size").alias("n"))
    w = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    per = source_targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, max_repeats)
    place = sums.alias("a").join(per.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    place = place.select("a.source", "a._bucket", "_before", "source_size", "rank", "target")
    x = d.alias("d").join(place.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d._bucket") == F.col("p._bucket")))
    x = x.select("d.*", "_before", "source_size", "rank", "target")
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    x = x.withColumn("_start", start)
    goal = F.floor("target")
    part = [F.least(F.col("size"), F.greatest(F.lit(0), goal - F.col("source_size") * k - F.col("_start"))) for k in range(max_repeats)]
    taken = sum(part[1:], part[0])
    copies = sum((F.when(p > 0, 1).otherwise(0) for p in part[1:]), F.when(part[0] > 0, 1).otherwise(0))

    def at(k: int) -> Column:
        level = (F.col("_start") + F.col("source_size") * k) / F.col("target")
        out = F.lit(None).cast("double")
        for i, knots in enumerate(schedules):
            out = F.when(F.col("rank") % len(schedules) == i, inverse(level, knots)).otherwise(out)
        return F.when(part[k] > 0, out)

    x = x.withColumns({"taken": taken.cast("long"), "copies": copies, "_at": F.array(*[at(k) for k in range(max_repeats)])})
    x = x.withColumn("positions", F.filter("_at", lambda v: v.isNotNull())).withColumn("position", F.get("positions", F.lit(0)))
    return x.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "position", "positions", *keep)


def spread() -> Column:
    """A number from 1 to 2 by id: the place of rows without position, behind all others and over many ranges."""
    return F.lit(1.0) + F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def range_sorted(mixed: DataFrame) -> DataFrame:
    """Documents in the order of their (first) training position; untaken ones follow in md5 order."""
    at = F.coalesce("position", spread())
    return mixed.withColumn("_at", at).orderBy("_at", "doc_id").drop("_at")


def training_order(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = 3, schedules=SCHEDULES) -> DataFrame:
    """The mix itself: a row of docs' columns for each copy, range-sorted by the copy's position.

    Positions are found on narrow rows (a hash of the whole row, id, source, size); texts are joined to them once. Of equal
    rows each has positions of its own. Columns of any name and type pass unchanged. A copy that the mix takes in part (the
    last one of a source) is given whole, so that a source exceeds its target by less than one document.
    """
    k1, k2, at = fresh(docs.columns, "_k1", "_k2", "_position")
    one, two = row_keys(docs)
    keyed = docs.withColumns({k1: one, k2: two})
    d = materialize(keyed.select("doc_id", "source", n_words(F.col("text")).alias("size"), column(k1).alias("_k1"), column(k2).alias("_k2")))
    places = _mix(d, weights, max_repeats, schedules, keep=("_k1", "_k2")).select(F.col("_k1").alias(k1), F.col("_k2").alias(k2), F.explode("positions").alias(at))
    if not d.groupBy("_k1", "_k2").count().where("count > 1").isEmpty():
        keyed = keyed.dropDuplicates([k1, k2])  # equal rows' positions stand at one key
    out = keyed.join(places, [k1, k2]).orderBy(at, "doc_id", k1)
    return out.select(*[column(c) for c in docs.columns])
