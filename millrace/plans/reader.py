"""Reading a table: profile, role guess, role statistics and rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import auc
from ..functions.running import running
from ..functions.scalar import known, missing


@dataclass(frozen=True)
class Role:
    """What a column is used for: numeric, category, datetime, text, target, group, fold, weights, treatment or drop."""

    name: str
    options: dict = field(default_factory=dict, hash=False)


def guess_roles(df: DataFrame, given: dict[str, str] | None = None) -> dict[str, Role]:
    """A role by type: numbers numeric, times datetime, the rest category; given ones win."""
    given = given or {}
    out = {}
    for f in df.schema.fields:
        if f.name in given:
            out[f.name] = Role(given[f.name])
        elif isinstance(f.dataType, T.NumericType):
            out[f.name] = Role("numeric")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out[f.name] = Role("datetime")
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            out[f.name] = Role("category")
        else:
            out[f.name] = Role("drop")
    return out


#: Microseconds of the units that numbers count times in.
UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "D": 86_400_000_000}


def cast_roles(df: DataFrame, roles: dict[str, Role]) -> DataFrame:
    """df with columns of the type that their role needs; what cannot be read becomes null, nothing fails.

    Numeric: double (also from text). Datetime: text by the option format, or as Spark reads it; numbers count the option unit
    (us, ms, s or D) from the option origin (a date, 1970-01-01 without one). Category and text: string.
    """
    out = {}
    for c, r in roles.items():
        if c not in df.columns:
            continue
        kind, x = df.schema[c].dataType, F.col(c)
        if r.name == "numeric":
            out[c] = x.cast("double") if isinstance(kind, (T.NumericType, T.BooleanType)) else x.cast("string").try_cast("double")
        elif r.name == "datetime" and isinstance(kind, T.NumericType):
            start = F.unix_micros(F.to_timestamp(F.lit(r.options.get("origin", "1970-01-01"))))
            out[c] = F.timestamp_micros((x.cast("double") * UNITS[r.options.get("unit", "s")]).try_cast("long") + start)
        elif r.name == "datetime" and isinstance(kind, T.StringType):
            out[c] = F.try_to_timestamp(x, F.lit(r.options["format"])) if "format" in r.options else x.try_cast("timestamp")
        elif r.name in ("category", "text"):
            out[c] = x.cast("string")
    return df.withColumns(out)


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, nan_rate, n_unique, unique_rate, top_freq): missing share, distinct values, and the share of the most
    frequent one; from one unpivot and two aggregates for all columns."""
    x = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.when(~missing(F.col(c)) if isinstance(df.schema[c].dataType, T.NumericType) else F.col(c).isNotNull(), F.col(c).cast("string")).alias("value")) for c in columns])).alias("_p")).select("_p.*")
    by = x.groupBy("feature", "value").agg(F.count("*").alias("n"))
    there = F.col("value").isNotNull()
    out = by.groupBy("feature").agg(
        F.sum("n").alias("n"), (F.coalesce(F.sum(F.when(~there, F.col("n"))), F.lit(0)) / F.sum("n")).alias("nan_rate"),
        F.sum(there.cast("long")).alias("n_unique"), F.coalesce(F.max(F.when(there, F.col("n"))), F.lit(0)).alias("_top"),
    )
    return out.select("feature", "n", "nan_rate", "n_unique", (F.col("n_unique") / F.col("n")).alias("unique_rate"), (F.col("_top") / F.col("n")).alias("top_freq"))


def usable(prof: DataFrame, max_nan: float = 0.999, max_constant: float = 0.999) -> DataFrame:
    """profile's rows with ok: neither nearly all missing nor nearly all one value."""
    return prof.withColumn("ok", (F.col("nan_rate") < max_nan) & (F.col("top_freq") < max_constant))


def feature_ginis(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(feature, gini): |2 AUC - 1| of each column as a score; rows where it is missing are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), known(F.col(c)).alias("x")) for c in columns]))
    x = df.select(pairs.alias("_p"), F.col(target).alias("y")).select("_p.*", "y").where("x is not null")
    return auc(x, "y", "x", "feature").select("feature", F.abs(F.col("auc") * 2 - 1).alias("gini"))


def null_scores(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(feature, gini) of each column's missing flag; columns without or with only missing values are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), missing(F.col(c)).cast("int").alias("x")) for c in columns]))
    x = df.select(pairs.alias("_p"), F.col(target).alias("y")).select("_p.*", "y")
    some = x.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo < hi").select("feature")
    return auc(x.join(some, "feature", "left_semi"), "y", "x", "feature").select("feature", F.abs(F.col("auc") * 2 - 1).alias("gini"))


def numeric_stats(df: DataFrame, columns: list[str], target: str, fold: str, bins: int = 10) -> DataFrame:
    """(feature, raw, binned, encoded, freq, n_unique, unique_rate, top_freq, nan_rate): Ginis of a column as a number,
    by out-of-fold means of its bins, by those of its values, and by its values' counts."""
    from ..operators.categorical import TargetEncoder, freq_encoder
    from ..operators.numeric import QuantileBinning

    raw = feature_ginis(df, columns, target).withColumnRenamed("gini", "raw")
    b = QuantileBinning.fit(df, columns, bins).apply(df)
    bn = [f"qntl__{c}" for c in columns]
    b = TargetEncoder.fit(b, bn, target, fold).apply_train(b)
    binned = feature_ginis(b, [f"oof__{c}" for c in bn], target).select(F.regexp_replace("feature", "^oof__qntl__", "").alias("feature"), F.col("gini").alias("binned"))
    e = TargetEncoder.fit(df, columns, target, fold).apply_train(df)
    enc = feature_ginis(e, [f"oof__{c}" for c in columns], target).select(F.regexp_replace("feature", "^oof__", "").alias("feature"), F.col("gini").alias("encoded"))
    f = freq_encoder(df, columns).apply(df)
    freq = feature_ginis(f, [f"freq__{c}" for c in columns], target).select(F.regexp_replace("feature", "^freq__", "").alias("feature"), F.col("gini").alias("freq"))
    return raw.join(binned, "feature", "left").join(enc, "feature", "left").join(freq, "feature", "left").join(profile(df, columns).drop("n"), "feature")


#: Thresholds of the role rules (fixed values): unique share, best to third, bins to others, best to raw, share of the
#: best feature's score, least score.
RULES = {"unique": 0.999, "third": 1.1, "bins": 2.0, "raw": 1.1, "share": 0.2, "least": 0.04}


def encoding_rules(stats: DataFrame) -> DataFrame:
    """numeric_stats' rows with their rules and role: any rule makes a column numeric.

    raw_best: the raw score is the best; two_values; many_values; no_matter: the best is hardly better than the third;
    bins_win: bins are best by far; raw_near: the raw score is a near second; weak: a low score. Numeric columns that
    aren't weak and whose bins score twice their raw score are discretised. Others are categories: coded as they are
    with under 10 values, by counts where those score 1.3 times as well as target means, else by the automatic choice.
    """
    kinds = ("raw", "binned", "encoded", "freq")
    score = lambda k: F.coalesce(F.col(k), F.lit(0.0))
    ranked = F.array_sort(F.array(*[F.struct((-score(k)).alias("s"), F.lit(i).alias("i")) for i, k in enumerate(kinds)]))
    x = stats.withColumn("_r", ranked)
    at = lambda k: -F.col("_r")[k]["s"]
    top = F.max(at(0)).over(Window.partitionBy())
    rules = {
        "raw_best": F.col("_r")[0]["i"] == 0, "two_values": F.col("n_unique") <= 2, "many_values": F.col("unique_rate") > RULES["unique"],
        "no_matter": F.coalesce(F.try_divide(at(0), at(2)) < RULES["third"], F.lit(False)),
        "bins_win": (F.col("_r")[0]["i"] == 1) & F.coalesce(F.try_divide(at(0), at(2)) > RULES["bins"], F.lit(True)),
        "raw_near": (F.col("_r")[1]["i"] == 0) & F.coalesce(F.try_divide(at(0), at(1)) < RULES["raw"], F.lit(False)),
        "weak": F.coalesce(F.try_divide(at(0), top) < RULES["share"], F.lit(True)) | (at(0) < RULES["least"]),
    }
    x = x.withColumns(rules)
    number = F.greatest(*[F.col(r) for r in rules])
    role = F.when(number & ~F.col("weak") & F.coalesce(F.try_divide(score("binned"), score("raw")) > 2, F.lit(False)), "numeric_binned")
    role = role.when(number, "numeric").when(F.col("n_unique") < 10, "category_int")
    role = role.when(F.coalesce(F.try_divide(score("freq"), score("encoded")) > 1.3, F.lit(False)), "category_freq").otherwise("category_auto")
    return x.withColumns({"role": role, "ordinal": F.col("unique_rate") > 0.01}).drop("_r")


def category_stats(df: DataFrame, columns: list[str], target: str, fold: str) -> DataFrame:
    """(feature, encoded, freq, ord): Ginis of out-of-fold means, counts and ranks of a category."""
    from ..operators.categorical import TargetEncoder, freq_encoder, ordinal_encoder

    x = TargetEncoder.fit(df, columns, target, fold).apply_train(df)
    x = ordinal_encoder(df, columns, 0).apply(freq_encoder(df, columns).apply(x))
    g = feature_ginis(x, [f"{p}__{c}" for p in ("oof", "freq", "ord") for c in columns], target)
    kind = F.regexp_extract("feature", "^([a-z]+)__", 1)
    g = g.select(F.regexp_replace("feature", "^[a-z]+__", "").alias("f"), kind.alias("kind"), "gini")
    one = lambda k: F.max(F.when(F.col("kind") == k, F.col("gini")))
    return g.groupBy(F.col("f").alias("feature")).agg(one("oof").alias("encoded"), one("freq").alias("freq"), one("ord").alias("ord"))


def category_rules(stats: DataFrame) -> DataFrame:
    """category_stats' rows with the handler of the greatest score: auto (target means), freq or ord; ties to the first."""
    a = F.array(*[F.coalesce(c, F.lit(0.0)) for c in ("encoded", "freq", "ord")])
    return stats.withColumn("handler", F.element_at(F.array(F.lit("auto"), F.lit("freq"), F.lit("ord")), F.array_position(a, F.array_max(a)).cast("int")))


def top_categories(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """(value, n): the n most frequent values (ties by value), all others as <OTHER>."""
    by = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    top = by.orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(n).select(F.col("value").alias("_v"), F.lit(True).alias("_top"))
    x = by.join(top, F.col("value").eqNullSafe(F.col("_v")), "left")
    return x.groupBy(F.when(F.col("_top"), F.col("value")).otherwise(F.lit("<OTHER>")).alias("value")).agg(F.sum("n").alias("n"))


def sample_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows in md5 order of the key: reruns take the same."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def equal_bins(df: DataFrame, score: str, key: str, n: int = 20) -> DataFrame:
    """df with bin: n bins of equal size by descending score (ties by key)."""
    rows = df.count()
    by = df.groupBy(F.col(score).alias("_s")).agg(F.count("*").alias("_n"))
    before = running(by, "_s", ["_n"], descending=True).select("_s", F.col("before__n").alias("_before"))
    x = df.join(before, F.col(score).eqNullSafe(F.col("_s")))
    i = F.col("_before") + F.row_number().over(Window.partitionBy(score).orderBy(key)) - 1
    return x.withColumn("bin", F.floor(i * n / F.lit(rows)).cast("int")).drop("_s", "_before")
