"""The engine's queries over the standard tables, and the same queries in SQL for comparison.

Fixtures: ``orders`` with its customer as a supervised table (target: the order is finished), folds and predictions from
md5 of the key, missing values put in where the key divides by 7.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metrics as M
from .functions.scalar import hash24, hash_fold, hash_unit
from .functions import losses
from .operators import additive, binning, blend, boosting, categorical, dates, metalearners, models, numeric, selection, texts, uplift
from .plans import automl, explain, folds, levels, pipelines, reader, report, selectors, tuning, uplift_search
from .sources.tables import batches, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, to: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in columns})


def sql_hash(k: str) -> str:
    return f"CAST(concat('0x', substr(md5(CAST({k} AS VARCHAR)), 1, 6)) AS BIGINT)"


# ---------------------------------------------------------------- fixtures


def nulls(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose price is missing where the key divides by 7 (NaN where by 21)."""
    x = F.when(F.col("o_orderkey") % 21 == 0, F.lit(float("nan"))).when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))
    return table(spark, d, "orders").select("o_orderkey", x.alias("x"))


NULLS = "n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS x FROM orders)"


def joined(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return x.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus", "c_mktsegment", "c_nationkey", "c_acctbal",
                    (F.col("o_orderstatus") == "F").cast("int").alias("y"), hash_fold(F.col("o_orderkey"), 5).alias("fold"))


JOINED = f"""j AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority, o_orderstatus, c_mktsegment, c_nationkey, c_acctbal,
  CAST(o_orderstatus = 'F' AS INTEGER) AS y, CAST({sql_hash("o_orderkey")} % 5 AS INTEGER) AS fold FROM orders JOIN customer ON o_custkey = c_custkey)"""


def guess(salt: str, key: str = "o_orderkey") -> Column:
    """A prediction in (0, 1) with ties."""
    return (hash24(F.concat(F.lit(salt), F.col(key).cast("string"))) % 997 + 1) / F.lit(998.0)


def sql_guess(salt: str, key: str = "o_orderkey") -> str:
    return f"(({sql_hash(f"concat('{salt}', {key})")} % 997 + 1) / 998.0)"


def scores(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    x = o.select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"), status.alias("c"), F.col("o_totalprice").alias("t"), (F.col("o_custkey") % 2).cast("int").alias("w"),
                 F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("u"), guess("p").alias("p"), guess("a").alias("a"), guess("b").alias("b"), guess("c").alias("d"))
    total = F.col("a") + F.col("b") + F.col("d")
    x = x.withColumns({"r": F.col("t") * (F.col("p") + 0.5), "p0": F.col("a") / total, "p1": F.col("b") / total, "p2": F.col("d") / total})
    return x.withColumns({"hat": M.best_class([F.col("p0"), F.col("p1"), F.col("p2")])})


SCORES = f"""s0 AS (SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS y, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS c,
  o_totalprice AS t, CAST(o_custkey % 2 AS INTEGER) AS w, CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS u,
  {sql_guess("p")} AS p, {sql_guess("a")} AS a, {sql_guess("b")} AS b, {sql_guess("c")} AS d FROM orders),
s AS (SELECT *, t * (p + 0.5) AS r, a / (a + b + d) AS p0, b / (a + b + d) AS p1, d / (a + b + d) AS p2,
  CASE WHEN a / (a + b + d) >= greatest(b / (a + b + d), d / (a + b + d)) THEN 0 WHEN b / (a + b + d) >= d / (a + b + d) THEN 1 ELSE 2 END AS hat FROM s0)"""


# ---------------------------------------------------------------- numeric


@query("nan_flags", f"WITH {NULLS} SELECT o_orderkey, CAST(x IS NULL AS FLOAT) AS nanflg__x FROM n")
def nan_flags(spark, d):
    x = nulls(spark, d)
    return numeric.NanFlags.fit(x, ["x"]).apply(x).select("o_orderkey", "nanflg__x")


@query("fill_median", f"WITH {NULLS} SELECT o_orderkey, coalesce(x, (SELECT quantile_cont(x, 0.5) FROM n)) AS fillnamed__x FROM n")
def fill_median(spark, d):
    x = nulls(spark, d)
    return numeric.FillMedian.fit(x, ["x"]).apply(x).select("o_orderkey", "fillnamed__x")


@query("fill_inf", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS fillinf__x FROM orders")
def fill_inf(spark, d):
    inf = F.when(F.col("o_orderkey") % 10 == 0, F.lit(float("inf"))).when(F.col("o_orderkey") % 5 == 0, F.lit(float("-inf"))).otherwise(F.col("o_totalprice"))
    return numeric.fill_inf(table(spark, d, "orders").select("o_orderkey", inf.alias("x")), ["x"]).select("o_orderkey", "fillinf__x")


@query("log_odds", f"WITH {SCORES} SELECT o_orderkey, round(ln(greatest(1e-7, least(1 - 1e-7, p)) / (1.0 - greatest(1e-7, least(1 - 1e-7, p)))), 6) AS logodds__p FROM s")
def log_odds_query(spark, d):
    return rounded(numeric.to_log_odds(scores(spark, d), ["p"]).select("o_orderkey", "logodds__p"), "logodds__p")


@query("standard_scale", "SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS scaler__o_totalprice FROM orders")
def standard_scale(spark, d):
    x = table(spark, d, "orders")
    return rounded(numeric.StandardScaler.fit(x, ["o_totalprice"]).apply(x).select("o_orderkey", "scaler__o_totalprice"), "scaler__o_totalprice")


@query("quantile_bins", f"""WITH {NULLS}, e AS (SELECT DISTINCT unnest(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM n)
SELECT o_orderkey, CAST(CASE WHEN x IS NULL THEN 0 ELSE 1 + (SELECT count(*) FROM e WHERE e.e < n.x) END AS INTEGER) AS qntl__x FROM n""")
def quantile_bins(spark, d):
    x = nulls(spark, d)
    return numeric.QuantileBinning.fit(x, ["x"]).apply(x).select("o_orderkey", "qntl__x")


# ---------------------------------------------------------------- categories


@query("label_encode", """WITH v AS (SELECT p_brand AS v, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 5),
k AS (SELECT v, row_number() OVER (ORDER BY n DESC, v) AS code FROM v)
SELECT p_partkey, CAST(coalesce(code, 0) AS INTEGER) AS le__p_brand FROM part LEFT JOIN k ON p_brand = v""")
def label_encode(spark, d):
    x = table(spark, d, "part")
    return categorical.label_encoder(x, ["p_brand"]).apply(x).select("p_partkey", "le__p_brand")


@query("freq_encode", """WITH v AS (SELECT p_name AS v, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1)
SELECT p_partkey, CAST(coalesce(n, 1) AS DOUBLE) AS freq__p_name FROM part LEFT JOIN v ON p_name = v""")
def freq_encode(spark, d):
    x = table(spark, d, "part")
    return categorical.freq_encoder(x, ["p_name"]).apply(x).select("p_partkey", "freq__p_name")


@query("ordinal_encode", """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS x FROM part),
v AS (SELECT x, CAST(rank() OVER (ORDER BY x) AS DOUBLE) AS code FROM (SELECT x FROM p WHERE x IS NOT NULL GROUP BY x HAVING count(*) > 5))
SELECT p_partkey, CASE WHEN p.x IS NULL THEN (SELECT max(code) + 1 FROM v) ELSE code END AS ord__x FROM p LEFT JOIN v ON p.x = v.x""")
def ordinal_encode(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_type")).alias("x"))
    return categorical.ordinal_encoder(x, ["x"]).apply(x).select("p_partkey", "ord__x")


@query("one_hot", "SELECT r_regionkey, " + ", ".join(f"CAST(r_regionkey = {k} AS FLOAT) AS ohe_{k}__r_regionkey" for k in range(5)) + " FROM region")
def one_hot(spark, d):
    x = table(spark, d, "region").select("r_regionkey")
    return categorical.OneHot.fit(x, ["r_regionkey"]).apply(x)


def sql_target(feature: str, target: str, binary: bool) -> str:
    """Out-of-fold means of a feature of j with the best alpha: tables cells, best."""
    loss = "-(s * ln(greatest(1e-15, least(1 - 1e-15, code))) + (n - s) * ln(1.0 - greatest(1e-15, least(1 - 1e-15, code))))" if binary else "s2 - 2 * code * s + n * code * code"
    return f"""c0 AS (SELECT {feature} AS v, fold, CAST(sum({target}) AS DOUBLE) AS s, count(*) AS n, CAST(sum({target} * {target}) AS DOUBLE) AS s2 FROM j GROUP BY 1, 2),
c1 AS (SELECT *, sum(s) OVER (PARTITION BY v) - s AS os, sum(n) OVER (PARTITION BY v) - n AS onn,
  (sum(s) OVER () - sum(s) OVER (PARTITION BY fold)) / (sum(n) OVER () - sum(n) OVER (PARTITION BY fold)) AS prior FROM c0),
g AS (SELECT c1.*, alpha, (os + alpha * prior) / (onn + alpha) AS code FROM c1, (SELECT unnest([0.5, 1.0, 2.0, 5.0, 10.0, 50.0, 250.0, 1000.0]) AS alpha)),
best AS (SELECT alpha FROM (SELECT alpha, round(sum({loss}), 6) AS loss FROM g GROUP BY alpha) ORDER BY loss, alpha LIMIT 1),
cells AS (SELECT v, fold, code FROM g WHERE alpha = (SELECT alpha FROM best))"""


@query("target_encode_binary", f"WITH {JOINED}, {sql_target('c_mktsegment', 'y', True)} SELECT o_orderkey, round(code, 6) AS oof__c_mktsegment FROM j JOIN cells ON c_mktsegment = v AND j.fold = cells.fold")
def target_encode_binary(spark, d):
    x = joined(spark, d)
    return rounded(categorical.TargetEncoder.fit(x, ["c_mktsegment"], "y", "fold").apply_train(x).select("o_orderkey", "oof__c_mktsegment"), "oof__c_mktsegment")


@query("target_encode_reg", f"WITH {JOINED}, {sql_target('c_nationkey', 'o_totalprice', False)} SELECT o_orderkey, round(code, 4) AS oof__c_nationkey FROM j JOIN cells ON c_nationkey = v AND j.fold = cells.fold")
def target_encode_reg(spark, d):
    x = joined(spark, d)
    return rounded(categorical.TargetEncoder.fit(x, ["c_nationkey"], "o_totalprice", "fold", binary=False).apply_train(x).select("o_orderkey", "oof__c_nationkey"), "oof__c_nationkey", to=4)


@query("target_encode_inference", f"""WITH {JOINED}, {sql_target('o_orderpriority', 'y', True)},
f AS (SELECT o_orderpriority AS v, (sum(y) + (SELECT alpha FROM best) * (SELECT avg(y) FROM j)) / (count(*) + (SELECT alpha FROM best)) AS code FROM j GROUP BY 1)
SELECT o_orderkey, round(coalesce(code, (SELECT avg(y) FROM j)), 6) AS oof__o_orderpriority
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'unseen' ELSE o_orderpriority END AS p FROM j) LEFT JOIN f ON p = v""")
def target_encode_inference(spark, d):
    x = joined(spark, d)
    enc = categorical.TargetEncoder.fit(x, ["o_orderpriority"], "y", "fold")
    new = x.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "unseen").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    return rounded(enc.apply(new).select("o_orderkey", "oof__o_orderpriority"), "oof__o_orderpriority")


@query("target_encode_multiclass", f"""WITH {JOINED}, c0 AS (SELECT c_mktsegment AS value, fold, {", ".join(f"CAST(sum(CAST(o_orderstatus = '{c}' AS INTEGER)) AS DOUBLE) AS s{i}" for i, c in enumerate("FOP"))}, count(*) AS n FROM j GROUP BY 1, 2),
c1 AS (SELECT *, {", ".join(f"sum(s{i}) OVER (PARTITION BY value) - s{i} AS o{i}, (sum(s{i}) OVER () - sum(s{i}) OVER (PARTITION BY fold)) / (sum(n) OVER () - sum(n) OVER (PARTITION BY fold)) AS p{i}" for i in range(3))}, sum(n) OVER (PARTITION BY value) - n AS onn FROM c0),
g0 AS (SELECT c1.*, alpha, {", ".join(f"(o{i} + alpha * p{i}) / (onn + alpha) AS r{i}" for i in range(3))} FROM c1, (SELECT unnest([0.5, 1.0, 2.0, 5.0, 10.0, 50.0, 250.0, 1000.0]) AS alpha)),
g AS (SELECT *, r0 / (r0 + r1 + r2) AS k0, r1 / (r0 + r1 + r2) AS k1, r2 / (r0 + r1 + r2) AS k2 FROM g0),
b AS (SELECT alpha FROM (SELECT alpha, round(sum(-s0 * ln(greatest(1e-15, k0)) - s1 * ln(greatest(1e-15, k1)) - s2 * ln(greatest(1e-15, k2))), 6) AS loss FROM g GROUP BY alpha) ORDER BY loss, alpha LIMIT 1)
SELECT value, fold, alpha, round(k0, 6) AS code_0, round(k1, 6) AS code_1, round(k2, 6) AS code_2 FROM g WHERE alpha = (SELECT alpha FROM b)""")
def target_encode_multiclass(spark, d):
    x = joined(spark, d)
    return rounded(categorical.multiclass_target_encoder(x, "c_mktsegment", "o_orderstatus", "fold", ["F", "O", "P"]), "code_0", "code_1", "code_2")


@query("cat_intersections", """WITH v AS (SELECT p_brand || '_' || p_type AS v, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 5),
k AS (SELECT v, row_number() OVER (ORDER BY n DESC, v) AS code FROM v)
SELECT p_partkey, CAST(coalesce(code, 0) AS INTEGER) AS le FROM part LEFT JOIN k ON p_brand || '_' || p_type = v""")
def cat_intersections(spark, d):
    x, names = categorical.intersections(table(spark, d, "part"), ["p_brand", "p_type"])
    return categorical.label_encoder(x.withColumnRenamed(names[0], "b"), ["b"]).apply(x.withColumnRenamed(names[0], "b")).select("p_partkey", F.col("le__b").alias("le"))


# ---------------------------------------------------------------- dates


@query("time_to_num", "SELECT o_orderkey, round((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '2020-01-01')) / 8.64e10, 6) AS days FROM orders")
def time_to_num(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(dates.time_to_num(F.col("o_orderdate")), 6).alias("days"))


@query("base_diff", "SELECT l_orderkey, l_partkey, l_suppkey, round((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 8.64e10, 6) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def base_diff(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return dates.base_diffs(x, ["o_orderdate"], ["l_shipdate"]).select("l_orderkey", "l_partkey", "l_suppkey", F.round("basediff_o_orderdate__l_shipdate", 6).alias("days"))


@query("date_seasons", """SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(isodow(ts) - 1 AS INTEGER) AS wd,
CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS s, CAST(epoch_us(ts) % 1000000 AS INTEGER) AS us FROM events""")
def date_seasons(spark, d):
    parts = ("y", "m", "d", "wd", "hour", "min", "sec", "ms")
    x = dates.seasons(table(spark, d, "events"), "ts", parts)
    return x.select("event_id", *[F.col(f"season_{p}__ts").alias(n) for p, n in zip(parts, ("y", "m", "d", "wd", "h", "mi", "s", "us"))])


@query("date_holidays", "SELECT o_orderkey, CAST(month(o_orderdate) = 12 AND day(o_orderdate) = 25 AS INTEGER) AS hol FROM orders")
def date_holidays(spark, d):
    o = table(spark, d, "orders")
    days = spark.range(1980, 2040).select(F.make_date(F.col("id").cast("int"), F.lit(12), F.lit(25)).alias("day"))
    return dates.seasons(o, "o_orderdate", (), days).select("o_orderkey", F.col("season_hol__o_orderdate").alias("hol"))


@query("change_datetime", """SELECT o_orderkey, CAST(make_date(2023, month(o_orderdate), least(day(o_orderdate), day(last_day(make_date(2023, month(o_orderdate), 1))))) AS VARCHAR) AS in_2023,
CAST(make_date(year(o_orderdate), 2, least(day(o_orderdate), day(last_day(make_date(year(o_orderdate), 2, 1))))) AS VARCHAR) AS in_february,
CAST(CAST(o_orderdate AS DATE) + CAST(3 - isodow(o_orderdate) AS INTEGER) AS VARCHAR) AS on_wednesday FROM orders""")
def change_datetime(spark, d):
    c = F.col("o_orderdate")
    made = {"in_2023": ("year", 2023), "in_february": ("month", 2), "on_wednesday": ("weekday", 2)}
    return table(spark, d, "orders").select("o_orderkey", *[dates.change_datetime(c, *v).cast("date").cast("string").alias(k) for k, v in made.items()])


# ---------------------------------------------------------------- reading


@query("column_profile", """WITH x AS (SELECT 'o_custkey' AS feature, CAST(o_custkey AS VARCHAR) AS v FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders
UNION ALL SELECT 'x', CAST(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS VARCHAR) FROM orders), c AS (SELECT feature, v, count(*) AS n FROM x GROUP BY 1, 2)
SELECT feature, CAST(sum(n) AS BIGINT) AS n, round(coalesce(sum(n) FILTER (v IS NULL), 0) / sum(n), 6) AS nan_rate, count(v) AS n_unique, round(count(v) / sum(n), 6) AS unique_rate,
round(max(n) FILTER (v IS NOT NULL) / sum(n), 6) AS top_freq, coalesce(sum(n) FILTER (v IS NULL), 0) / sum(n) < 0.999 AND max(n) FILTER (v IS NOT NULL) / sum(n) < 0.999 AS ok FROM c GROUP BY feature""")
def column_profile(spark, d):
    x = table(spark, d, "orders").withColumn("x", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")))
    return rounded(reader.usable(reader.profile(x, ["o_custkey", "o_orderstatus", "x"])), "nan_rate", "unique_rate", "top_freq")


def sql_auc(rows: str, *groups: str) -> str:
    """SELECT groups, auc of a table with y and x."""
    g = ", ".join(groups)
    part = f"PARTITION BY {g} " if g else ""
    lead = f"{g}, " if g else ""
    return f"""(SELECT {lead}sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc FROM (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
FROM (SELECT {lead}x, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) - sum(y) AS DOUBLE) AS neg FROM {rows} GROUP BY {lead}x)){" GROUP BY " + g if g else ""})"""


@query("feature_ginis", f"""WITH {JOINED}, u AS (SELECT 'o_totalprice' AS feature, o_totalprice AS x, y FROM j UNION ALL SELECT 'c_acctbal', c_acctbal, y FROM j UNION ALL SELECT 'c_nationkey', c_nationkey, y FROM j)
SELECT feature, round(abs(2 * auc - 1), 6) AS gini FROM {sql_auc('u', 'feature')}""")
def feature_ginis(spark, d):
    return rounded(reader.feature_ginis(joined(spark, d), ["o_totalprice", "c_acctbal", "c_nationkey"], "y"), "gini")


@query("null_scores", f"""WITH u AS (SELECT CAST(o_orderkey % 7 = 0 AS INTEGER) AS x, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders) SELECT 'x' AS feature, round(abs(2 * auc - 1), 6) AS gini FROM {sql_auc('u')}""")
def null_scores(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("x"), "o_custkey")
    return rounded(reader.null_scores(o, ["x", "o_custkey"], "y"), "gini")


@query("gini_normalized", """WITH s AS (SELECT o_totalprice AS p, CAST(o_orderstatus = 'F' AS INTEGER) AS y, o_orderkey FROM orders),
r AS (SELECT y, row_number() OVER (ORDER BY p, o_orderkey) AS i, row_number() OVER (ORDER BY y, o_orderkey) AS k, count(*) OVER () AS n FROM s)
SELECT round((sum(y * (n - i + 1)) / sum(y) - (max(n) + 1) / 2.0) / (sum(y * (n - k + 1)) / sum(y) - (max(n) + 1) / 2.0), 6) AS gini FROM r""")
def gini_normalized(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return rounded(M.gini(o, "y", "o_totalprice", "o_orderkey"), "gini")


def sql_encoded(column: str, source: str = "j") -> str:
    """SELECT x, y: out-of-fold means of a column of a table with y and fold."""
    return f"""SELECT code AS x, y FROM {source} t JOIN (WITH j AS (SELECT {column} AS f, fold, y FROM {source}), {sql_target('f', 'y', True)} SELECT v, fold AS cfold, code FROM cells) c ON t.{column} = c.v AND t.fold = c.cfold"""


def sql_counted(column: str) -> str:
    """SELECT x, y: how often the value was seen."""
    return f"SELECT CAST(n AS DOUBLE) AS x, y FROM j JOIN (SELECT {column} AS v, count(*) AS n FROM j GROUP BY 1) ON {column} = v"


def sql_ginis(parts: dict[tuple[str, str], str]) -> str:
    """SELECT feature, kind, gini of tables of x and y."""
    rows = " UNION ALL ".join(f"SELECT '{f}' AS feature, '{k}' AS kind, x, y FROM ({q})" for (f, k), q in parts.items())
    return f"(SELECT feature, kind, abs(2 * auc - 1) AS gini FROM {sql_auc(f'({rows})', 'feature', 'kind')})"


_NUMBERS = ("o_totalprice", "c_acctbal", "c_nationkey")
_BINS = ", ".join(
    f"b_{c} AS (SELECT fold, y, 1 + (SELECT count(*) FROM (SELECT DISTINCT unnest(quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM j) WHERE e < j.{c}) AS q FROM j)" for c in _NUMBERS
)
_ROLE_PARTS = {(c, k): q for c in _NUMBERS for k, q in (("raw", f"SELECT CAST({c} AS DOUBLE) AS x, y FROM j"), ("binned", sql_encoded("q", f"b_{c}")), ("encoded", sql_encoded(c)), ("freq", sql_counted(c)))}
_PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n, count(DISTINCT {c}) AS n_unique, (SELECT max(k) FROM (SELECT count(*) AS k FROM j GROUP BY {c})) AS most FROM j" for c in _NUMBERS)


@query("role_stats", f"""WITH {JOINED}, {_BINS}, u AS {sql_ginis(_ROLE_PARTS)},
g AS (SELECT feature, {", ".join(f"max(gini) FILTER (kind = '{k}') AS {k}" for k in ("raw", "binned", "encoded", "freq"))} FROM u GROUP BY 1),
p AS ({_PROFILE}), r AS (SELECT *, list_sort([{", ".join(f"{{'s': -{k}, 'i': {i}}}" for i, k in enumerate(("raw", "binned", "encoded", "freq")))}]) AS r FROM g JOIN p USING (feature)),
a AS (SELECT *, -r[1].s AS a0, -r[2].s AS a1, -r[3].s AS a2, max(-r[1].s) OVER () AS top FROM r),
k AS (SELECT *, r[1].i = 0 AS raw_best, n_unique <= 2 AS two_values, n_unique / n > 0.999 AS many_values, coalesce(a0 / nullif(a2, 0) < 1.1, false) AS no_matter,
  r[1].i = 1 AND coalesce(a0 / nullif(a2, 0) > 2, true) AS bins_win, r[2].i = 0 AND coalesce(a0 / nullif(a1, 0) < 1.1, false) AS raw_near, coalesce(a0 / nullif(top, 0) < 0.2, true) OR a0 < 0.04 AS weak FROM a),
z AS (SELECT *, raw_best OR two_values OR many_values OR no_matter OR bins_win OR raw_near OR weak AS number FROM k)
SELECT feature, round(raw, 6) AS raw, round(binned, 6) AS binned, round(encoded, 6) AS encoded, round(freq, 6) AS freq, 0.0 AS nan_rate, n_unique, n_unique / n AS unique_rate, most / n AS top_freq,
  raw_best, two_values, many_values, no_matter, bins_win, raw_near, weak, CASE WHEN number AND NOT weak AND coalesce(binned / nullif(raw, 0) > 2, false) THEN 'numeric_binned' WHEN number THEN 'numeric'
  WHEN n_unique < 10 THEN 'category_int' WHEN coalesce(freq / nullif(encoded, 0) > 1.3, false) THEN 'category_freq' ELSE 'category_auto' END AS role, n_unique / n > 0.01 AS ordinal FROM z""")
def role_stats(spark, d):
    s = reader.numeric_stats(joined(spark, d), list(_NUMBERS), "y", "fold")
    return rounded(reader.encoding_rules(s), "raw", "binned", "encoded", "freq")


_CATEGORIES = ("o_orderpriority", "c_mktsegment")
_CATEGORY_PARTS = {(c, k): q for c in _CATEGORIES for k, q in (("encoded", sql_encoded(c)), ("freq", sql_counted(c)), ("ord", f"SELECT CAST(k AS DOUBLE) AS x, y FROM j JOIN (SELECT {c} AS v, rank() OVER (ORDER BY {c}) AS k FROM j GROUP BY 1) ON {c} = v"))}


@query("category_roles", f"""WITH {JOINED}, u AS {sql_ginis(_CATEGORY_PARTS)}, g AS (SELECT feature, {", ".join(f"max(gini) FILTER (kind = '{k}') AS {k}" for k in ("encoded", "freq", "ord"))} FROM u GROUP BY 1)
SELECT feature, round(encoded, 6) AS encoded, round(freq, 6) AS freq, round(ord, 6) AS ord, CASE WHEN encoded >= greatest(freq, ord) THEN 'auto' WHEN freq >= ord THEN 'freq' ELSE 'ord' END AS handler FROM g""")
def category_roles(spark, d):
    return rounded(reader.category_rules(reader.category_stats(joined(spark, d), list(_CATEGORIES), "y", "fold")), "encoded", "freq", "ord")


@query("class_mapping", "SELECT value, n, CAST(row_number() OVER (ORDER BY n DESC, value) - 1 AS INTEGER) AS class FROM (SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1)")
def class_mapping(spark, d):
    return folds.class_order(table(spark, d, "events"), "event_type").withColumn("class", F.col("class").cast("int"))


@query("top_categories", """WITH c AS (SELECT p_name AS v, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS k FROM c)
SELECT CASE WHEN k <= 10 THEN v ELSE '<OTHER>' END AS value, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def top_categories(spark, d):
    return reader.top_categories(table(spark, d, "part"), "p_name", 10)


@query("row_batches", "SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1000) AS BIGINT) AS batch FROM orders")
def row_batches(spark, d):
    return batches(table(spark, d, "orders"), "o_orderkey", 1000).select("o_orderkey", "batch")


@query("sampled_rows", "SELECT o_orderkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 500")
def sampled_rows(spark, d):
    return reader.sample_rows(table(spark, d, "orders"), "o_orderkey", 500).select("o_orderkey")


# ---------------------------------------------------------------- folds


@query("kfold", f"SELECT o_orderkey, CAST({sql_hash('o_orderkey')} % 5 AS INTEGER) AS fold FROM orders")
def kfold(spark, d):
    return folds.kfold(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", "fold")


@query("group_kfold", f"SELECT event_id, CAST({sql_hash('user_id')} % 5 AS INTEGER) AS fold FROM events")
def group_kfold(spark, d):
    return folds.group_kfold(table(spark, d, "events"), "user_id").select("event_id", "fold")


@query("stratified_kfold", "SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders")
def stratified_kfold(spark, d):
    return folds.stratified_kfold(table(spark, d, "orders"), "o_orderkey", "o_orderstatus").select("o_orderkey", "fold")


@query("holdout", f"SELECT o_orderkey, {sql_hash('o_orderkey')} < CAST(floor(0.2 * 16777216) AS BIGINT) AS holdout FROM orders")
def holdout(spark, d):
    return folds.holdout(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", "holdout")


@query("time_split_dates", "SELECT o_orderkey, CAST(o_orderdate > TIMESTAMP '1994-01-01' AS INTEGER) + CAST(o_orderdate > TIMESTAMP '1996-06-01' AS INTEGER) AS fold FROM orders")
def time_split_dates(spark, d):
    cuts = [F.to_timestamp_ntz(F.lit(x)) for x in ("1994-01-01 00:00:00", "1996-06-01 00:00:00")]
    o = table(spark, d, "orders")
    return o.select("o_orderkey", sum(((F.col("o_orderdate") > c).cast("int") for c in cuts), F.lit(0)).alias("fold"))


@query("time_split_parts", "SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS fold FROM orders")
def time_split_parts(spark, d):
    return folds.time_parts(table(spark, d, "orders"), "o_orderdate", "o_orderkey", 7).select("o_orderkey", "fold")


@query("uplift_folds", f"SELECT o_orderkey, CASE WHEN o_custkey % 2 = 1 THEN -1 ELSE CAST({sql_hash('o_orderkey')} % 5 AS INTEGER) END AS fold FROM orders")
def uplift_folds(spark, d):
    x = table(spark, d, "orders").withColumn("w", (F.col("o_custkey") % 2).cast("int"))
    return folds.uplift_folds(x, "o_orderkey", "w", 1).select("o_orderkey", "fold")


@query("fold_sizes", f"WITH {JOINED} SELECT k, count(*) FILTER (fold <> k) AS train, count(*) FILTER (fold = k) AS valid FROM j, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY k")
def fold_sizes(spark, d):
    x = joined(spark, d).select("fold").withColumn("k", F.explode(F.array(*map(F.lit, range(5)))))
    return x.groupBy("k").agg(F.count_if(F.col("fold") != F.col("k")).alias("train"), F.count_if(F.col("fold") == F.col("k")).alias("valid"))


# ---------------------------------------------------------------- metrics


@query("metrics_reg", f"""WITH {SCORES} SELECT round(avg((t - r) * (t - r)), 2) AS mse, round(avg(abs(t - r)), 6) AS mae, round(1 - sum((t - r) * (t - r)) / (var_pop(t) * count(*)), 6) AS r2,
round(sqrt(avg((ln(1 + r) - ln(1 + t)) * (ln(1 + r) - ln(1 + t)))), 6) AS rmsle, round(avg(abs(t - r) / abs(t)), 6) AS mape,
round(avg(CASE WHEN abs(r - t) < 0.9 THEN 0.5 * (r - t) * (r - t) ELSE 0.9 * abs(r - t) - 0.405 END), 6) AS huber,
round(avg(0.81 * (abs(r - t) / 0.9 - ln(abs(r - t) / 0.9 + 1))), 6) AS fair, round(avg(CASE WHEN r - t > 0 THEN 0.9 ELSE 1 - 0.9 END * abs(r - t)), 6) AS quantile FROM s""")
def metrics_reg(spark, d):
    t, r = F.col("t"), F.col("r")
    names = ("mse", "mae", "r2", "rmsle", "mape", "huber", "fair", "quantile")
    return scores(spark, d).agg(*[F.round(getattr(M, n)(t, r), 2 if n == "mse" else 6).alias(n) for n in names])


@query("metrics_binary", f"""WITH {SCORES}, u AS (SELECT y, p AS x FROM s) SELECT (SELECT round(auc, 6) FROM {sql_auc('u')}) AS auc,
(SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) FROM s) AS logloss, (SELECT round(avg(CAST(CAST(p > 0.5 AS INTEGER) = y AS INTEGER)), 6) FROM s) AS accuracy""")
def metrics_binary(spark, d):
    s = scores(spark, d)
    a = M.auc(s, "y", "p").select(F.round("auc", 6).alias("auc"))
    return a.crossJoin(s.agg(F.round(M.logloss(F.col("y"), F.col("p")), 6).alias("logloss"), F.round(M.accuracy(F.col("y"), F.col("p")), 6).alias("accuracy")))


@query("metrics_weighted", f"WITH {SCORES} SELECT round(sum(abs(t - r) * p) / sum(p), 6) AS mae, round(sum(-(y * ln(p) + (1 - y) * ln(1 - p)) * b) / sum(b), 6) AS logloss FROM s")
def metrics_weighted(spark, d):
    c = F.col
    return scores(spark, d).agg(F.round(M.mae(c("t"), c("r"), c("p")), 6).alias("mae"), F.round(M.logloss(c("y"), c("p"), c("b")), 6).alias("logloss"))


@query("metrics_multiclass", f"""WITH {SCORES}, k AS (SELECT unnest([0, 1, 2]) AS k), m AS (SELECT k, CAST(count(*) FILTER (c = k) AS DOUBLE) AS t, CAST(count(*) FILTER (hat = k) AS DOUBLE) AS q, CAST(count(*) FILTER (c = k AND hat = k) AS DOUBLE) AS tp FROM s, k GROUP BY k)
SELECT (SELECT round(avg(-ln(CASE c WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)), 6) FROM s) AS crossentropy, (SELECT round(avg(CAST(c = hat AS INTEGER)), 6) FROM s) AS accuracy,
round(sum(tp) / sum(t), 6) AS f1_micro, round(avg(2 * tp / (t + q)), 6) AS f1_macro, round(sum(2 * tp / (t + q) * t) / sum(t), 6) AS f1_weighted FROM m""")
def metrics_multiclass(spark, d):
    s = scores(spark, d)
    a = s.agg(F.round(M.crossentropy(F.col("c"), [F.col(f"p{i}") for i in range(3)]), 6).alias("crossentropy"), F.round(F.avg((F.col("c") == F.col("hat")).cast("double")), 6).alias("accuracy"))
    return a.crossJoin(rounded(M.f1(s, "c", "hat"), "f1_micro", "f1_macro", "f1_weighted"))


@query("auc_ovr", f"WITH {SCORES}, u AS (SELECT k, CAST(c = k AS INTEGER) AS y, CASE k WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS x FROM s, (SELECT unnest([0, 1, 2]) AS k)) SELECT round(avg(auc), 6) AS auc FROM {sql_auc('u', 'k')}")
def auc_ovr(spark, d):
    return rounded(M.auc_ovr(scores(spark, d), "c", ["p0", "p1", "p2"]), "auc")


@query("auc_mu", f"""WITH {SCORES}, u AS (SELECT 1 AS k, CAST(c = 1 AS INTEGER) AS y, p1 - p0 AS x FROM s WHERE c IN (0, 1) UNION ALL SELECT 2, CAST(c = 2 AS INTEGER), p2 - p0 FROM s WHERE c IN (0, 2)
UNION ALL SELECT 3, CAST(c = 2 AS INTEGER), p2 - p1 FROM s WHERE c IN (1, 2)) SELECT round(avg(auc), 6) AS auc FROM {sql_auc('u', 'k')}""")
def auc_mu(spark, d):
    return rounded(M.auc_mu(scores(spark, d), "c", ["p0", "p1", "p2"]), "auc")


@query("confusion_matrix", f"WITH {SCORES} SELECT c AS y, hat AS yhat, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY c), 6) AS share FROM s GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return rounded(M.confusion(scores(spark, d), "c", "hat"), "share")


# ---------------------------------------------------------------- selection and blending


@query("high_correlation", """WITH l AS (SELECT l_quantity AS a, l_extendedprice AS b, l_quantity * 2 + l_discount AS c, l_tax AS d FROM lineitem)
SELECT * FROM (SELECT 'a' AS a, 'b' AS b, round(corr(a, b), 6) AS r FROM l UNION ALL SELECT 'a', 'c', round(corr(a, c), 6) FROM l UNION ALL SELECT 'a', 'd', round(corr(a, d), 6) FROM l
UNION ALL SELECT 'b', 'c', round(corr(b, c), 6) FROM l UNION ALL SELECT 'b', 'd', round(corr(b, d), 6) FROM l UNION ALL SELECT 'c', 'd', round(corr(c, d), 6) FROM l)""")
def high_correlation(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"), (F.col("l_quantity") * 2 + F.col("l_discount")).alias("c"), F.col("l_tax").alias("d"))
    return rounded(selection.correlations(x, ["a", "b", "c", "d"]), "r")


@query("drop_correlated", "SELECT unnest(['a', 'b', 'd']) AS feature")
def drop_correlated(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"), (F.col("l_quantity") * 2 + F.col("l_discount")).alias("c"), F.col("l_tax").alias("d"), F.lit(1).alias("e"))
    return spark.createDataFrame([(f,) for f in selection.drop_correlated(x, ["a", "b", "c", "d", "e"])], "feature string")


@query("importance_rollup", """SELECT p_type AS feature, round(sum(p_retailprice), 4) AS importance FROM part GROUP BY 1""")
def importance_rollup(spark, d):
    p = table(spark, d, "part").select(F.concat(F.element_at(F.array(F.lit("oof__"), F.lit("freq__"), F.lit("")), (F.col("p_size") % 3 + 1).cast("int")), F.col("p_type")).alias("feature"), F.col("p_retailprice").alias("importance"))
    raw = [r.p_type for r in table(spark, d, "part").select("p_type").distinct().collect()]
    return rounded(selection.raw_importance(p, raw), "importance", to=4)


@query("permuted_column", """WITH h AS (SELECT o_orderkey, o_totalprice, md5('42:' || CAST(o_orderkey AS VARCHAR)) AS h FROM orders), b AS (SELECT *, CAST(concat('0x', substr(h, 1, 6)) AS BIGINT) % 256 AS b FROM h),
r AS (SELECT *, row_number() OVER (ORDER BY b, h, o_orderkey) AS i, count(*) OVER () AS n FROM b)
SELECT x.o_orderkey, z.o_totalprice FROM r x JOIN r z ON z.i = CASE WHEN x.i = 1 THEN x.n ELSE x.i - 1 END""")
def permuted_column(spark, d):
    return selection.permuted(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


def with_gaps(spark, d):
    return scores(spark, d).withColumn("a", F.when(F.col("o_orderkey") % 3 != 0, F.col("a"))).withColumn("b", F.when(F.col("o_orderkey") % 6 != 0, F.col("b")))


GAPS = f"{SCORES}, q AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN a END AS a, CASE WHEN o_orderkey % 6 <> 0 THEN b END AS b FROM s)"


@query("mean_blend", f"WITH {GAPS} SELECT o_orderkey, round((coalesce(a, 0) + coalesce(b, 0)) / nullif(CAST(a IS NOT NULL AS INTEGER) + CAST(b IS NOT NULL AS INTEGER), 0), 6) AS blend FROM q")
def mean_blend(spark, d):
    return with_gaps(spark, d).select("o_orderkey", F.round(blend.mean_blend(["a", "b"]), 6).alias("blend"))


@query("weighted_blend", f"WITH {GAPS} SELECT o_orderkey, round((coalesce(a * 0.3, 0) + coalesce(b * 0.7, 0)) / nullif(CASE WHEN a IS NULL THEN 0 ELSE 0.3 END + CASE WHEN b IS NULL THEN 0 ELSE 0.7 END, 0), 6) AS blend FROM q")
def weighted_blend(spark, d):
    return with_gaps(spark, d).select("o_orderkey", F.round(blend.weighted_blend(["a", "b"], [0.3, 0.7]), 6).alias("blend"))


@query("best_model", f"WITH {SCORES} SELECT m AS model FROM (SELECT 'a' AS m, avg((y - a) * (y - a)) AS e FROM s UNION ALL SELECT 'b', avg((y - b) * (y - b)) FROM s UNION ALL SELECT 'd', avg((y - d) * (y - d)) FROM s) ORDER BY e LIMIT 1")
def best_model(spark, d):
    m = blend.best_model(scores(spark, d), ["a", "b", "d"], lambda p: M.mse(F.col("y"), p), -1)
    return spark.createDataFrame([(m,)], "model string")


@query("blend_weights")
def blend_weights(spark, d):
    w = blend.optimise_weights(scores(spark, d), ["a", "b", "d"], lambda p: M.logloss(F.col("y"), p), -1, rounds=1)
    return spark.createDataFrame(list(zip(["a", "b", "d"], w)), "model string, weight double")


# ---------------------------------------------------------------- uplift


def sql_curve(mode: str, score: str = "p", name: str = "s") -> str:
    value = {
        "qini": "yt / allt - yc / (allr - allt)",
        "cum_gain": "(coalesce(yt / nullif(nt, 0), 0) - coalesce(yc / nullif(n - nt, 0), 0)) * n / allr",
        "adj_qini": "(yt - yc * coalesce(nt / nullif(n - nt, 0), 0)) / allt",
    }[mode]
    return f"""(SELECT n / allr AS share, {value} AS value FROM (SELECT x, sum(n) OVER w AS n, sum(nt) OVER w AS nt, sum(yt) OVER w AS yt, sum(yc) OVER w AS yc, sum(n) OVER () AS allr, sum(nt) OVER () AS allt
FROM (SELECT {score} AS x, CAST(count(*) AS DOUBLE) AS n, CAST(sum(w) AS DOUBLE) AS nt, CAST(sum(u * w) AS DOUBLE) AS yt, CAST(sum(u * (1 - w)) AS DOUBLE) AS yc FROM {name} GROUP BY 1)
WINDOW w AS (ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) UNION ALL SELECT 0.0, 0.0)"""


def sql_area(curve: str) -> str:
    return f"(SELECT sum((share - s0) * (value + v0) / 2) AS auc FROM (SELECT share, value, lag(share) OVER (ORDER BY share) AS s0, lag(value) OVER (ORDER BY share) AS v0 FROM {curve}))"


@query("perfect_uplift", f"WITH {SCORES} SELECT o_orderkey, CASE WHEN w = 1 THEN CASE WHEN u = 1 THEN 2 ELSE 0 END ELSE CASE WHEN u = 1 THEN -1 ELSE 1 END END AS ideal FROM s")
def perfect_uplift(spark, d):
    return scores(spark, d).select("o_orderkey", uplift.perfect_score(F.col("u"), F.col("w")).alias("ideal"))


def _curve(mode: str):
    @query(f"uplift_curve_{mode}", f"WITH {SCORES} SELECT round(share, 6) AS share, round(value, 6) AS value FROM {sql_curve(mode)}")
    def run(spark, d):
        return rounded(uplift.curve(scores(spark, d), "u", "p", "w", mode), "share", "value")

    return run


for _m in uplift.MODES:
    _curve(_m)


@query("uplift_auc", f"WITH {SCORES} SELECT " + ", ".join(f"(SELECT round(auc, 6) FROM {sql_area(sql_curve(m))}) AS {m}" for m in uplift.MODES))
def uplift_auc(spark, d):
    return rounded(uplift.curve_areas(scores(spark, d), "u", "p", "w"), *uplift.MODES)


@query("uplift_auc_normed", f"""WITH {SCORES}, i AS (SELECT *, CASE WHEN w = 1 THEN 2 * u ELSE 1 - 2 * u END AS ideal FROM s)
SELECT round((a.auc - b.lo) / (c.auc - b.lo), 6) AS auc FROM {sql_area(sql_curve('adj_qini'))} a, (SELECT (avg(u) FILTER (w = 1) - avg(u) FILTER (w = 0)) / 2 AS lo FROM s) b, {sql_area(sql_curve('adj_qini', 'ideal', 'i'))} c""")
def uplift_auc_normed(spark, d):
    return rounded(uplift.uplift_auc(scores(spark, d), "u", "p", "w", normed=True), "auc")


@query("uplift_at_top", f"WITH {SCORES}, k AS (SELECT quantile_cont(p, 0.7) AS k FROM s) SELECT round(avg(u) FILTER (w = 1) - avg(u) FILTER (w = 0), 6) AS score FROM s, k WHERE p > k")
def uplift_at_top(spark, d):
    return rounded(uplift.uplift_at_top(scores(spark, d), "u", "p", "w"), "score")


@query("uplift_total_score", f"WITH {SCORES}, k AS (SELECT quantile_cont(p, 0.7) AS k FROM s) SELECT round(avg(u) FILTER (w = 0 AND p <= k) * (1 - avg(w)) + avg(u) FILTER (w = 1 AND p > k) * avg(w), 6) AS score FROM s, k")
def uplift_total_score(spark, d):
    return rounded(uplift.total_score(scores(spark, d), "u", "p", "w"), "score")


# ---------------------------------------------------------------- text

_EN = r"list_filter(string_split(lower(trim(regexp_replace(regexp_replace(trim(regexp_replace(trim(coalesce(text, '')), '[^A-Za-zА-Яа-я0-9]+', ' ', 'g')), '\b\d+\b', ' ', 'g'), ' +', ' ', 'g'))), ' '), lambda w: w <> '')"
_DOCS = f"k AS (SELECT doc_id, {_EN} AS toks FROM documents)"


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", texts.tokens_en(F.col("text")).alias("toks"))


@query("tokenize_en", f"WITH {_DOCS} SELECT doc_id, array_to_string(toks, ' ') AS tokens FROM k")
def tokenize_en(spark, d):
    return tokens(spark, d).select("doc_id", F.array_join("toks", " ").alias("tokens"))


@query("tokenize_ru", r"""WITH f AS (SELECT doc_id, trim(regexp_replace(replace(replace(coalesce(text, ''), 'ё', 'е'), 'Ё', 'Е'), '[^A-Za-zА-Яа-я0-9]+', ' ', 'g')) AS t FROM documents),
w AS (SELECT doc_id, list_filter(string_split(t, ' '), lambda w: length(w) > 1 AND NOT regexp_matches(w, '[0-9]')) AS w FROM f),
c AS (SELECT doc_id, array_to_string(list_transform(w, lambda w: CASE WHEN length(w) <= 5 AND length(regexp_replace(w, '[^A-ZА-Я]', '', 'g')) > 1 THEN w ELSE lower(w) END), ' ') AS t FROM w)
SELECT doc_id, trim(replace(replace(' ' || t, ' не ', ' не'), ' ни ', ' ни')) AS tokens FROM c""")
def tokenize_ru(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(texts.tokens_ru(F.col("text")), " ").alias("tokens"))


@query("concat_text", "SELECT doc_id, coalesce(lang, '') || ' [SEP] ' || coalesce(source, '') AS joined FROM documents")
def concat_text(spark, d):
    return table(spark, d, "documents").select("doc_id", texts.concat_texts(["lang", "source"]).alias("joined"))


@query("document_frequencies", f"""WITH {_DOCS}, t AS (SELECT DISTINCT doc_id, unnest(toks) AS token FROM k), f AS (SELECT token, count(*) AS df FROM t GROUP BY 1 HAVING count(*) >= 5)
SELECT token, df, round(ln((1.0 + (SELECT count(*) FROM documents)) / (df + 1)) + 1, 6) AS idf FROM f ORDER BY df DESC, token LIMIT 30000""")
def document_frequencies(spark, d):
    return rounded(texts.document_frequencies(tokens(spark, d), "toks"), "idf")


TFIDF = f"""WITH {_DOCS}, t AS (SELECT doc_id, unnest(toks) AS token FROM k), f AS (SELECT token, count(DISTINCT doc_id) AS df FROM t GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
v AS (SELECT token, ln((1.0 + (SELECT count(*) FROM documents)) / (df + 1)) + 1 AS idf FROM f ORDER BY df DESC, token LIMIT 30000), x AS (SELECT doc_id, token, count(*) * any_value(idf) AS w FROM t JOIN v USING (token) GROUP BY 1, 2)
SELECT doc_id, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM x"""


@query("tfidf", TFIDF)
def tfidf(spark, d):
    """Over the operator's own vocabulary of 30,000 tokens, fitted and applied in one go."""
    return rounded(texts.fit_tfidf(tokens(spark, d), "doc_id", "toks")[1], "weight")


@query("tfidf_whole", TFIDF)
def tfidf_whole(spark, d):
    """The same with a vocabulary that was fitted before."""
    x = tokens(spark, d)
    return rounded(texts.tfidf(x, "doc_id", "toks", texts.document_frequencies(x, "toks")), "weight")


@query("sif_weights", f"WITH {_DOCS}, t AS (SELECT doc_id, unnest(toks) AS token FROM k), c AS (SELECT token, count(*) AS n, count(DISTINCT doc_id) AS df FROM t GROUP BY 1) SELECT token, n, df, round(0.001 / (0.001 + n / (SELECT count(*) FROM t)), 6) AS weight FROM c")
def sif_weights(spark, d):
    return rounded(texts.word_weights(tokens(spark, d), "toks").withColumn("n", F.col("n").cast("long")), "weight")


@query("word_vectors_mean")
def word_vectors_mean(spark, d):
    """Documents as weighted means of hashed word vectors."""
    x = tokens(spark, d)
    words = texts.word_weights(x, "toks", "idf")
    vec = words.select("token", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.pmod(F.xxhash64("token", i), F.lit(2001)) / 1000.0 - 1.0).alias("vector"))
    return rounded(texts.average_vectors(x, "doc_id", "toks", vec, words), "value")


@query("pooled_vectors", """WITH v AS (SELECT label, vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT label, CAST(dim AS INTEGER) AS dim, max(v) AS value FROM v GROUP BY 1, 2""")
def pooled_vectors(spark, d):
    return texts.pool(table(spark, d, "embeddings").select("label", F.col("vec_id").alias("pos"), F.col("embedding").alias("vector")), "label", "max")


# ---------------------------------------------------------------- report


@query("score_bins", f"""WITH {SCORES}, b AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY p DESC, o_orderkey) - 1) * 20 / count(*) OVER ()) AS INTEGER) AS bin FROM s)
SELECT bin, count(*) AS n, round(avg(y), 6) AS mean_target, round(min(p), 6) AS min_score, round(avg(p), 6) AS mean_score, round(max(p), 6) AS max_score FROM b GROUP BY bin""")
def score_bins(spark, d):
    return rounded(report.score_bins(scores(spark, d), "y", "p", "o_orderkey"), "mean_target", "min_score", "mean_score", "max_score")


@query("score_quartiles", f"""WITH {SCORES}, b AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY p DESC, o_orderkey) - 1) * 20 / count(*) OVER ()) AS INTEGER) AS bin FROM s)
SELECT bin, round(quantile_cont(p, 0.25), 6) AS q1, round(quantile_cont(p, 0.5), 6) AS median, round(quantile_cont(p, 0.75), 6) AS q3 FROM b GROUP BY bin""")
def score_quartiles(spark, d):
    return rounded(report.score_quartiles(scores(spark, d), "p", "o_orderkey"), "q1", "median", "q3")


_CUTS = f"""{SCORES}, g AS (SELECT greatest(1, least(99, CAST(ceil(round(p / 0.01, 9)) AS INTEGER))) AS k, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n FROM s GROUP BY 1),
h AS (SELECT k, sum(pos) OVER () - sum(pos) OVER w AS tp, sum(pos) OVER w AS fn, sum(n - pos) OVER () - sum(n - pos) OVER w AS fp FROM g WINDOW w AS (ORDER BY k)),
i AS (SELECT k * 0.01 AS cutoff, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM h), f AS (SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM i)"""


@query("f1_threshold", f"WITH {_CUTS} SELECT round(cutoff, 6) AS cutoff, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def f1_threshold(spark, d):
    return rounded(report.f1_cutoffs(scores(spark, d), "y", "p"), "cutoff", "precision", "recall", "f1")


@query("best_f1", f"WITH {_CUTS} SELECT round(max(f1), 6) AS f1, round(avg(cutoff), 6) AS cutoff FROM f WHERE f1 = (SELECT max(f1) FROM f)")
def best_f1(spark, d):
    return rounded(report.best_cutoff(report.f1_cutoffs(scores(spark, d), "y", "p")), "f1", "cutoff")


_RANKED = f"""{SCORES}, g AS (SELECT p AS score, CAST(sum(y) AS DOUBLE) AS pp, CAST(count(*) - sum(y) AS DOUBLE) AS nn FROM s GROUP BY 1),
h AS (SELECT score, sum(pp) OVER w AS tp, sum(nn) OVER w AS fp, sum(pp) OVER () AS pos, sum(nn) OVER () AS neg FROM g WINDOW w AS (ORDER BY score DESC))"""


@query("roc_points", f"WITH {_RANKED} SELECT round(score, 6) AS score, round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr FROM h")
def roc_points(spark, d):
    return rounded(report.roc_points(scores(spark, d), "y", "p"), "score", "fpr", "tpr")


@query("pr_points", f"WITH {_RANKED} SELECT round(score, 6) AS score, round(tp / (tp + fp), 6) AS precision, round(tp / pos, 6) AS recall FROM h")
def pr_points(spark, d):
    return rounded(report.pr_points(scores(spark, d), "y", "p"), "score", "precision", "recall")


@query("average_precision", f"WITH {_RANKED} SELECT round(sum(tp / (tp + fp) * (tp - t0) / pos), 6) AS ap FROM (SELECT *, coalesce(lag(tp) OVER (ORDER BY score DESC), 0) AS t0 FROM h)")
def average_precision(spark, d):
    return rounded(report.average_precision(scores(spark, d), "y", "p"), "ap")


@query("threshold_counts", f"WITH {SCORES} SELECT count(*) FILTER (y = 1 AND p > 0.4) AS tp, count(*) FILTER (y = 0 AND p > 0.4) AS fp, count(*) FILTER (y = 1 AND p <= 0.4) AS fn, count(*) FILTER (y = 0 AND p <= 0.4) AS tn FROM s")
def threshold_counts(spark, d):
    return report.threshold_counts(scores(spark, d), "y", "p", 0.4)


@query("value_histogram", """WITH l AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT event_type, CAST(least(29, floor((value - lo) / (hi - lo) * 30)) AS INTEGER) AS bin, count(*) AS n FROM events, l WHERE value IS NOT NULL GROUP BY 1, 2""")
def value_histogram(spark, d):
    return report.histogram(table(spark, d, "events"), "value", 30, "event_type")


@query("logit_histogram", f"""WITH {SCORES}, z AS (SELECT y, ln(p / (1 - p)) AS l FROM s), k AS (SELECT min(l) AS lo, max(l) AS hi FROM z) SELECT y, CAST(least(19, floor((l - lo) / (hi - lo) * 20)) AS INTEGER) AS bin, count(*) AS n FROM z, k GROUP BY 1, 2""")
def logit_histogram(spark, d):
    return report.logit_histogram(scores(spark, d), "y", "p", 20)


@query("error_histogram", f"""WITH {SCORES}, z AS (SELECT r - t AS e FROM s), k AS (SELECT min(e) AS lo, max(e) AS hi FROM z) SELECT CAST(least(19, floor((e - lo) / (hi - lo) * 20)) AS INTEGER) AS bin, count(*) AS n FROM z, k GROUP BY 1""")
def error_histogram(spark, d):
    return report.histogram(scores(spark, d).select((F.col("r") - F.col("t")).alias("e")), "e", 20)


@query("regression_line", f"WITH {SCORES} SELECT round(regr_slope(t, r), 6) AS slope, round(regr_intercept(t, r), 4) AS intercept, round(regr_r2(t, r), 6) AS r2 FROM s")
def regression_line(spark, d):
    x = rounded(report.regression_line(scores(spark, d), "t", "r"), "slope", "r2")
    return rounded(x, "intercept", to=4)


@query("numeric_feature_table", """WITH u AS (SELECT 'o_totalprice' AS feature, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS v FROM orders UNION ALL SELECT 'o_custkey', o_custkey FROM orders)
SELECT feature, count(*) AS n, round(avg(CAST(v IS NULL AS INTEGER)), 6) AS nan_rate, round(min(v), 4) AS min, round(quantile_cont(v, 0.25), 4) AS q25, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS q75, round(max(v), 4) AS max, round(stddev_pop(v), 4) AS std FROM u GROUP BY feature""")
def numeric_feature_table(spark, d):
    x = table(spark, d, "orders").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))
    t = report.numeric_features(x, ["o_totalprice", "o_custkey"])
    return rounded(rounded(t, "nan_rate"), "min", "q25", "mean", "median", "q75", "max", "std", to=4)


@query("category_feature_table", """WITH u AS (SELECT 'p_brand' AS feature, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS v FROM part UNION ALL SELECT 'p_type', p_type FROM part), c AS (SELECT feature, v, count(*) AS n FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY v IS NULL, n DESC, v) AS k FROM c)
SELECT feature, round(coalesce(sum(n) FILTER (v IS NULL), 0) / sum(n), 6) AS nan_rate, count(v) AS n_unique, max(v) FILTER (k = 1) AS top, round(max(n) FILTER (k = 1) / sum(n), 6) AS top_share FROM r GROUP BY feature""")
def category_feature_table(spark, d):
    x = table(spark, d, "part").withColumn("p_brand", F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")))
    return rounded(report.category_features(x, ["p_brand", "p_type"]), "nan_rate", "top_share")


@query("datetime_feature_table", "SELECT 'o_orderdate' AS feature, 0.0 AS nan_rate, CAST(min(o_orderdate) AS TIMESTAMP) AS first, CAST(max(o_orderdate) AS TIMESTAMP) AS last FROM orders")
def datetime_feature_table(spark, d):
    return report.datetime_features(table(spark, d, "orders"), ["o_orderdate"])


@query("text_length_histogram", """WITH v AS (SELECT 'chars' AS kind, CAST(length(text) AS DOUBLE) AS v FROM documents UNION ALL SELECT 'tokens', len(string_split(text, ' ')) FROM documents), k AS (SELECT kind, min(v) AS lo, max(v) AS hi FROM v GROUP BY kind)
SELECT kind, CAST(least(19, floor((v - lo) / (hi - lo) * 20)) AS INTEGER) AS bin, count(*) AS n FROM v JOIN k USING (kind) GROUP BY 1, 2""")
def text_length_histogram(spark, d):
    return report.text_lengths(table(spark, d, "documents"), "text")


@query("woe_iv", f"""WITH {JOINED}, c AS (SELECT c_mktsegment AS value, CAST(sum(y) AS DOUBLE) AS p, CAST(count(*) AS BIGINT) AS n FROM j GROUP BY 1), s AS (SELECT value, n, (p + 0.5) / sum(p) OVER () AS b, (n - p + 0.5) / sum(n - p) OVER () AS g FROM c)
SELECT value, n, round(ln(b / g), 6) AS woe, round((b - g) * ln(b / g), 6) AS iv FROM s""")
def woe_iv(spark, d):
    return rounded(models.woe_table(joined(spark, d), "c_mktsegment", "y"), "woe", "iv")


# ---------------------------------------------------------------- models (rows and scores only)


@query("linear_oof")
def linear_oof(spark, d):
    x = joined(spark, d)
    scaled = numeric.StandardScaler.fit(x, ["o_totalprice", "c_acctbal"]).apply(x)
    _, out, _ = models.linear_path(scaled, ["scaler__o_totalprice", "scaler__c_acctbal"], "y", "binary", 5, "prediction", path=(0.1, 10.0))
    return out.select("o_orderkey", "y", "fold", "prediction")


@query("trees_oof")
def trees_oof(spark, d):
    x = joined(spark, d).select("o_orderkey", "c_acctbal", "c_nationkey", "o_totalprice", "fold")
    _, out = models.fit_folds(x, ["c_acctbal", "c_nationkey"], "o_totalprice", "reg", models.trees("reg", 3, 5), 5, "prediction")
    return out.select("o_orderkey", "prediction")


@query("boosted_means", f"""WITH {JOINED}, s AS (SELECT c_mktsegment, fold, sum(o_totalprice) AS s, count(*) AS n FROM j GROUP BY 1, 2),
a AS (SELECT c_mktsegment, fold, (sum(s) OVER w - s) / (sum(n) OVER w - n) AS m FROM s WINDOW w AS (PARTITION BY c_mktsegment))
SELECT o_orderkey, round(m, 2) AS prediction FROM j JOIN a USING (c_mktsegment, fold)""")
def boosted_means(spark, d):
    """Full steps on squared error tell all five segments apart: a row's prediction is its segment's mean over the other folds."""
    p = boosting.Params(rounds=2, rate=1.0, depth=4, patience=0, least_rows=1)
    _, out = boosting.boost(joined(spark, d), ["c_mktsegment"], "o_totalprice", losses.mse(), p, 5, "prediction", "o_orderkey")
    return rounded(out.select("o_orderkey", "prediction"), "prediction", to=2)


@query("boosted_losses", f"""WITH {JOINED} SELECT loss, count(*) AS n, count(*) AS n_predicted, true AS no_worse FROM j, (VALUES ('mae'), ('quantile'), ('huber')) AS l(loss) GROUP BY 1""")
def boosted_losses(spark, d):
    """Boosted regressions of several losses, stopped on each fold. The SQL states what must hold of any: each row predicted
    once, the folds' loss at the chosen round not above that of the constant start."""
    out = None
    x = joined(spark, d).withColumn("t", F.col("o_totalprice") / 1e5)
    for name in ("mae", "quantile", "huber"):
        b, got = boosting.boost(x, ["c_acctbal", "o_orderpriority", "c_nationkey"], "t", losses.of("reg", name), boosting.Params(rounds=3, depth=3, rate=0.5, patience=2), 5, "p", "o_orderkey")
        fine = all(h[k] <= h[0] for h, k in zip(b.history, b.best))
        row = got.agg(F.lit(name).alias("loss"), F.count("*").alias("n"), F.count("p").alias("n_predicted"), F.lit(fine).alias("no_worse"))
        out = row if out is None else out.unionByName(row)
    return out


@query("boosted_multiclass", "SELECT o_orderstatus, count(*) AS n, count(*) AS n_distributions FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def boosted_multiclass(spark, d):
    """Softmax boosting of the order's status. The SQL states what must hold of any model: a distribution for each row."""
    x = joined(spark, d).withColumn("k", F.array_position(F.array(*map(F.lit, "FOP")), F.col("o_orderstatus")) - 1)
    _, out = boosting.boost(x, ["o_totalprice", "c_acctbal", "o_orderpriority", "c_mktsegment"], "k", losses.crossentropy(3), boosting.Params(rounds=4, depth=3, rate=0.3), 5, "p", "o_orderkey")
    p = F.col("p")
    fine = (F.size(p) == 3) & (F.abs(F.aggregate(p, F.lit(0.0), lambda a, v: a + v) - 1) < 1e-9) & F.forall(p, lambda v: v.between(0, 1))
    return out.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum(fine.cast("long")).alias("n_distributions"))


@query("additive_weights", f"""WITH {JOINED}, v AS (SELECT 'c_mktsegment' AS feature, c_mktsegment AS value FROM j UNION SELECT 'o_orderpriority', o_orderpriority FROM j
  UNION SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM j), o AS (SELECT DISTINCT feature, '<OTHER>' AS value FROM v)
SELECT feature, value, true AS weighted FROM (SELECT * FROM v UNION ALL SELECT * FROM o UNION ALL SELECT '<INTERCEPT>', NULL UNION ALL SELECT 'scaler__o_totalprice', NULL)""")
def additive_weights(spark, d):
    """An additive logistic model with a weight for each customer, segment and priority. The SQL states which weights there are."""
    x = joined(spark, d)
    x = numeric.StandardScaler.fit(x, ["o_totalprice"]).apply(x).withColumn("fold", F.lit(0))
    m, _ = additive.fit(x.unionByName(x.withColumn("fold", F.lit(1))), ["scaler__o_totalprice"], ["c_mktsegment", "o_orderpriority", "o_custkey"], "y", "binary", 2, "p", path=(0.1,))
    return m.weights().select("feature", "value", (F.abs("weight") < 50).alias("weighted"))


@query("additive_oof", f"""WITH {JOINED} SELECT fold, count(*) AS n, count(*) AS n_probabilities FROM j GROUP BY 1""")
def additive_oof(spark, d):
    """Out-of-fold probabilities of an additive model with the customer as a category; the SQL states their number and bounds."""
    x = joined(spark, d)
    x = numeric.StandardScaler.fit(x, ["o_totalprice"]).apply(x)
    _, out = additive.fit(x, ["scaler__o_totalprice"], ["c_mktsegment", "o_custkey"], "y", "binary", 5, "p", path=(0.1, 10.0))
    return out.groupBy("fold").agg(F.count("*").alias("n"), F.sum(F.col("p").between(0.001, 0.999).cast("long")).alias("n_probabilities"))


@query("selected_columns", """SELECT * FROM (VALUES ('none', 'o_totalprice,c_acctbal,twice,flat,y2'), ('predefined', 'c_acctbal,flat'), ('uncorrelated', 'o_totalprice,c_acctbal,y2'),
  ('cutoff', 'y2'), ('composed', 'y2')) AS t(selector, columns)""")
def selected_columns(spark, d):
    """What selectors keep of columns of which one is the target with an error in ten rows, one is twice another and one is constant."""
    x = joined(spark, d)
    x = x.withColumns({"twice": F.col("c_acctbal") * 2 + 1, "flat": F.lit(1.0), "y2": F.when(hash24(F.concat(F.lit("e"), F.col("o_orderkey"))) % 10 == 0, 1 - F.col("y")).otherwise(F.col("y")).cast("double")})
    columns = ["o_totalprice", "c_acctbal", "twice", "flat", "y2"]
    problem = selectors.Problem("y", "binary", "o_orderkey", params=boosting.Params(rounds=3, rate=0.5, depth=1, patience=2))
    some = {
        "none": selectors.Selector(), "predefined": selectors.Predefined(["flat", "c_acctbal", "absent"]), "uncorrelated": selectors.HighCorrelation(),
        "cutoff": selectors.Cutoff(), "composed": selectors.Composed([selectors.HighCorrelation(), selectors.Cutoff(), selectors.Forward(by="gain")]),
    }
    rows = [(k, ",".join(s.fit(x, columns, problem).selected)) for k, s in some.items()]
    return spark.createDataFrame(rows, "selector string, columns string")


@query("tuned_boosting", f"WITH {JOINED} SELECT 4 AS trials, true AS best_is_least, true AS no_worse_than_start FROM j LIMIT 1")
def tuned_boosting(spark, d):
    """Four trials on one holdout. The SQL states what must hold: so many trials, the chosen one has the least loss."""
    space = {"rate": tuning.log(0.05, 1.0), "depth": tuning.integer(1, 3)}
    start = boosting.Params(rounds=3, patience=2)
    _, s = tuning.tune_boosting(joined(spark, d), ["o_totalprice", "c_acctbal", "o_orderpriority"], "y", losses.logloss(), start, "o_orderkey", 4, space=space)
    rows = [(len(s.trials), s.loss == min(t for _, t in s.trials), s.loss <= 0.7)]
    return spark.createDataFrame(rows, "trials int, best_is_least boolean, no_worse_than_start boolean")


@query("automl_binary")
def automl_binary(spark, d):
    x = joined(spark, d).drop("fold", "o_orderstatus", "o_custkey")
    return automl.TabularAutoML("binary", n_folds=2).fit_predict(x, "y", "o_orderkey")


@query("automl_selected", f"""WITH {JOINED} SELECT count(*) AS n, count(*) AS n_probabilities, 'y2' AS columns FROM j""")
def automl_selected(spark, d):
    """The loop with a selector, additive and boosted models; the SQL states the rows, their bounds and the column chosen."""
    x = joined(spark, d).withColumn("y2", F.when(hash24(F.concat(F.lit("e"), F.col("o_orderkey"))) % 10 == 0, 1 - F.col("y")).otherwise(F.col("y")).cast("double"))
    x = x.select("o_orderkey", "y", "o_totalprice", "c_acctbal", "y2")
    m = automl.TabularAutoML("binary", n_folds=2, algorithms=("additive", "boost"), selector=selectors.Cutoff(), boosting=boosting.Params(rounds=3, rate=0.5, depth=1, patience=2))
    out = m.fit_predict(x, "y", "o_orderkey", {"y2": "numeric"})
    return out.agg(F.count("*").alias("n"), F.sum(F.col("prediction").between(0, 1).cast("long")).alias("n_probabilities"), F.lit(",".join(m.selector.selected)).alias("columns"))


@query("automl_text", "SELECT count(*) AS n, count(*) AS n_probabilities, true AS no_worse FROM documents JOIN labels USING (doc_id)")
def automl_text(spark, d):
    """Quality by text and source; the SQL states the rows, their bounds, and a loss not above that of the share of good ones."""
    x = spread(table(spark, d, "documents").select("doc_id", "text", "source")).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    m = automl.TabularAutoML("binary", n_folds=2, algorithms=("boost",), boosting=boosting.Params(rounds=3, rate=0.5, depth=2, patience=2, least_rows=5))
    out = m.fit_predict(x, "quality", "doc_id", {"text": "text"})
    y = F.col("quality").cast("double")
    plain = F.avg("quality")
    return out.agg(F.count("*").alias("n"), F.sum(F.col("prediction").between(0, 1).cast("long")).alias("n_probabilities"),
                   (M.logloss(y, F.col("prediction")) <= 0.02 - plain * F.log(plain) - (1 - plain) * F.log(1 - plain)).alias("no_worse"))


@query("parsed_roles", """SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS DOUBLE) AS price, CAST(TRY_CAST(CASE WHEN o_orderkey % 5 = 0 THEN '2020-13-45' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE) AS TIMESTAMP) AS day,
CAST(DATE '2000-01-01' + CAST(o_orderkey % 1000 AS INTEGER) AS TIMESTAMP) AS counted, CAST(o_custkey AS VARCHAR) AS customer FROM orders""")
def parsed_roles(spark, d):
    x = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("price"),
        F.when(F.col("o_orderkey") % 5 == 0, "2020-13-45").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), (F.col("o_orderkey") % 1000).alias("counted"), F.col("o_custkey").alias("customer"))
    return reader.cast_roles(x, {"price": reader.Role("numeric"), "day": reader.Role("datetime", {"format": "yyyy-MM-dd"}), "counted": reader.Role("datetime", {"unit": "D", "origin": "2000-01-01"}), "customer": reader.Role("category")})


@query("automl_multiclass", "SELECT o_orderstatus, count(*) AS n, count(*) AS n_predicted, count(*) AS n_distributions FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IS NOT NULL GROUP BY 1")
def automl_multiclass(spark, d):
    """The SQL states what must hold of any model: each row once, with a distribution over the three classes."""
    x = joined(spark, d).drop("fold", "y", "o_custkey")
    out = automl.TabularAutoML("multiclass", n_folds=2).fit_predict(x, "o_orderstatus", "o_orderkey")
    p = F.col("prediction")
    whole = F.aggregate(p, F.lit(0.0), lambda a, v: a + v)
    fine = (F.size(p) == 3) & (F.abs(whole - 1) < 1e-9) & F.forall(p, lambda v: v.between(0, 1))
    return out.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count("prediction").alias("n_predicted"), F.sum(fine.cast("long")).alias("n_distributions"))


@query("nested_levels", f"WITH {JOINED} SELECT count(*) AS n, count(*) AS n_probabilities, 0 AS n_changed FROM j WHERE fold % 2 = 0")
def nested_levels(spark, d):
    """Two levels of boosted trees, nested, trained twice: the second time the targets of one fold are turned around. The SQL
    states that no prediction of that fold has seen its target."""
    x = joined(spark, d).withColumn("fold", F.col("fold") % 2)
    p = boosting.Params(rounds=2, rate=0.5, depth=2, patience=2)
    task, columns = levels.Task("binary", "y", "o_orderkey"), ["o_totalprice", "c_acctbal", "o_orderpriority"]
    graph = lambda: levels.Graph([[levels.Boost(p)], [levels.Boost(p)]], inner=2)
    a = graph().fit_predict(x, columns, task, 2).where("fold = 0").select("o_orderkey", F.col("prediction").alias("a"))
    turned = x.withColumn("y", F.when(F.col("fold") == 0, 1 - F.col("y")).otherwise(F.col("y")))
    b = graph().fit_predict(turned, columns, task, 2).where("fold = 0").select("o_orderkey", F.col("prediction").alias("b"))
    fine = F.col("a").between(0, 1).cast("long")
    return a.join(b, "o_orderkey").agg(F.count("*").alias("n"), F.sum(fine).alias("n_probabilities"), F.sum((F.col("a") != F.col("b")).cast("int")).cast("int").alias("n_changed"))


@query("text_feature_oof", "SELECT count(*) AS n, count(*) AS n_probabilities FROM documents JOIN labels USING (doc_id)")
def text_feature_oof(spark, d):
    """Quality by a hashed text model of each fold; the SQL states the rows and the bounds."""
    x = tokens(spark, d).join(table(spark, d, "labels"), "doc_id").withColumn("fold", hash_fold(F.col("doc_id"), 3))
    _, out = models.text_oof(x, "toks", "quality", "binary", 3, "p")
    return out.agg(F.count("*").alias("n"), F.sum(F.col("p").between(0, 1).cast("long")).alias("n_probabilities"))


@query("text_surrogate", r"""WITH w AS (SELECT item_id, len(list_distinct(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> ''))) AS n FROM benchmark)
SELECT item_id, least(n, 10)::BIGINT AS tokens FROM w WHERE n > 0""")
def text_surrogate(spark, d):
    """The ten tokens of each item that move its share of the letter e most, by a ridge surrogate; the SQL states their number."""
    score = lambda t: t.withColumn("score", F.length(F.regexp_replace("text", "[^e]", "")) / F.greatest(F.lit(1), F.length("text")))
    got = explain.surrogate(spread(table(spark, d, "benchmark")), "text", "item_id", score, samples=50)
    return got.groupBy("item_id").agg(F.count("*").alias("tokens"))


@query("supervised_bins", "SELECT 'c_acctbal' AS feature, true AS no_less, true AS few UNION ALL SELECT 'o_totalprice', true, true FROM (SELECT 1 FROM orders LIMIT 1)")
def supervised_bins(spark, d):
    """The SQL states what must hold of bins cut by the target: five at most, and no less information value than quantile bins."""
    x = joined(spark, d)
    columns = ["c_acctbal", "o_totalprice"]
    ours, plain = binning.SupervisedBins.fit(x, columns, "y"), numeric.QuantileBinning.fit(x, columns, 5)
    coded = plain.apply(ours.apply(x))
    iv = lambda c: models.woe_table(coded, c, "y").agg(F.sum("iv")).first()[0]
    rows = [(c, iv(f"sbin__{c}") >= iv(f"qntl__{c}") - 1e-3, len(ours.cuts[c]) <= 4) for c in columns]
    return spark.createDataFrame(rows, "feature string, no_less boolean, few boolean")


@query("pca")
def pca(spark, d):
    return selection.project(table(spark, d, "embeddings"), "embedding", "vec_id", 500)


@query("svd")
def svd(spark, d):
    return selection.project(table(spark, d, "embeddings"), "embedding", "vec_id", 100, centred=False)


def _learner(name: str):
    @query(f"uplift_{name}_learner")
    def run(spark, d):
        x = scores(spark, d).withColumns({"f1": F.col("t") / 1e5, "f2": hash_unit(F.col("o_orderkey"))})
        return metalearners.LEARNERS[name](x, x, ["f1", "f2"], "u", "w").select("o_orderkey", "uplift")

    return run


for _m in metalearners.LEARNERS:
    _learner(_m)


@query("uplift_search", "SELECT 8 AS candidates, 16 AS fits, true AS best_is_greatest, count(*) AS n, count(*) AS n_predicted FROM orders")
def uplift_search_query(spark, d):
    """Four learners over two kinds of base models, judged on held-out rows. The SQL states that eight base models of each kind
    were fitted once, and that the winner has the greatest area and predicts all rows."""
    x = scores(spark, d).withColumns({"f1": F.col("t") / 1e5, "f2": hash_unit(F.col("o_orderkey"))})
    kinds = {"linear": uplift_search.linear, "boosted": uplift_search.boosted(boosting.Params(rounds=2, rate=0.5, depth=2, patience=2))}
    found = uplift_search.search(x, ["f1", "f2"], "u", "w", "o_orderkey", kinds=kinds)
    great = found.areas[found.best] == max(found.areas.values())
    return found.predict(x).agg(F.lit(len(found.areas)).alias("candidates"), F.lit(found.fits).alias("fits"), F.lit(great).alias("best_is_greatest"), F.count("*").alias("n"), F.count("uplift").alias("n_predicted"))


@query("text_explanation")
def text_explanation(spark, d):
    """Which tokens move a text's share of the letter e."""
    x = table(spark, d, "benchmark")
    score = lambda t: t.withColumn("score", F.length(F.regexp_replace("text", "[^e]", "")) / F.greatest(F.lit(1), F.length("text")))
    return automl.explain_text(x, "text", "item_id", score, samples=50)




# ---------------------------------------------------------------- feature pipelines


def _roles() -> dict[str, reader.Role]:
    return {"o_totalprice": reader.Role("numeric"), "c_acctbal": reader.Role("numeric"), "o_orderpriority": reader.Role("category"), "c_mktsegment": reader.Role("category"), "o_orderdate": reader.Role("datetime")}


@query("simple_features", f"""WITH {JOINED}, a AS (SELECT o_orderpriority AS v, CAST(rank() OVER (ORDER BY o_orderpriority) AS DOUBLE) AS k FROM j GROUP BY 1 HAVING count(*) > 5), b AS (SELECT c_mktsegment AS v, CAST(rank() OVER (ORDER BY c_mktsegment) AS DOUBLE) AS k FROM j GROUP BY 1 HAVING count(*) > 5)
SELECT o_orderkey, c_acctbal, o_totalprice, round((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '2020-01-01')) / 8.64e10, 6) AS time__o_orderdate, b.k AS ord__c_mktsegment, a.k AS ord__o_orderpriority FROM j LEFT JOIN a ON o_orderpriority = a.v LEFT JOIN b ON c_mktsegment = b.v""")
def simple_features(spark, d):
    x = joined(spark, d)
    s = pipelines.simple_features(x, _roles())
    return rounded(s.apply(x).select("o_orderkey", *s.names), "time__o_orderdate")


_DAYS = "(epoch_us(o_orderdate) - epoch_us(TIMESTAMP '2020-01-01')) / 8.64e10"
_SCALED = {"scaler__fillnamed__c_acctbal": "c_acctbal", "scaler__fillnamed__o_totalprice": "o_totalprice", "scaler__fillnamed__time__o_orderdate": _DAYS}
_CODES = ", ".join(f"{n} AS (SELECT {c} AS {n}v, row_number() OVER (ORDER BY count(*) DESC, {c}) AS {n}k, count(*) AS {n}n FROM j GROUP BY 1 HAVING count(*) > 5)" for n, c in (("a", "c_mktsegment"), ("b", "o_orderpriority")))
_CODED = "j LEFT JOIN a ON c_mktsegment = av LEFT JOIN b ON o_orderpriority = bv"


@query("linear_features", f"""WITH {JOINED}, {_CODES} SELECT o_orderkey, {", ".join(f"round(({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER (), 5) AS {n}" for n, x in _SCALED.items())},
{", ".join(f"CAST(coalesce({t}k = {k}, false) AS FLOAT) AS ohe_{k}__le__{c}" for t, c in (("a", "c_mktsegment"), ("b", "o_orderpriority")) for k in range(1, 6))} FROM {_CODED}""")
def linear_features(spark, d):
    x = joined(spark, d)
    s = pipelines.linear_features(x, _roles())
    return rounded(s.apply(x).select("o_orderkey", *s.names), *_SCALED, to=5)


@query("advanced_features", f"""WITH {JOINED}, {_CODES}, x AS (SELECT *, c_mktsegment || '__' || o_orderpriority AS pair FROM j), m AS (SELECT o_orderkey AS mkey, code FROM x JOIN (WITH j AS (SELECT pair AS f, fold, y FROM x),
{sql_target('f', 'y', True)} SELECT v, fold AS cfold, code FROM cells) c ON x.pair = c.v AND x.fold = c.cfold)
SELECT o_orderkey, c_acctbal, o_totalprice, round({_DAYS}, 6) AS time__o_orderdate, CAST(month(o_orderdate) AS INTEGER) AS season_m__o_orderdate, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS season_wd__o_orderdate,
CAST(hour(CAST(o_orderdate AS TIMESTAMP)) AS INTEGER) AS season_hour__o_orderdate, CAST(an AS DOUBLE) AS freq__c_mktsegment, CAST(bn AS DOUBLE) AS freq__o_orderpriority, CAST(ak AS INTEGER) AS le__c_mktsegment,
CAST(bk AS INTEGER) AS le__o_orderpriority, round(code, 6) AS "oof__(c_mktsegment__o_orderpriority)" FROM {_CODED} JOIN m ON o_orderkey = mkey""")
def advanced_features(spark, d):
    x = joined(spark, d)
    s = pipelines.advanced_features(x, _roles(), "y", "fold")
    out = s.apply(x).select("o_orderkey", *[F.col(f"`{n}`") for n in s.names])
    oof = "oof__(c_mktsegment__o_orderpriority)"
    return rounded(out, "time__o_orderdate").withColumn(oof, F.round(F.col(f"`{oof}`"), 6))


@query("scorecard")
def scorecard(spark, d):
    x = joined(spark, d)
    return pipelines.Scorecard.fit(x, ["o_totalprice", "c_acctbal"], ["c_mktsegment"], "y").apply(x).select("o_orderkey", "score")


@query("nested_folds", f"SELECT o_orderkey, CAST({sql_hash('o_orderkey')} % 5 AS INTEGER) AS fold, CAST({sql_hash(f"concat('inner:', CAST({sql_hash('o_orderkey')} % 5 AS INTEGER), ':', o_orderkey)")} % 3 AS INTEGER) AS inner FROM orders".replace("AS inner FROM", 'AS "inner" FROM'))
def nested_folds(spark, d):
    x = folds.kfold(table(spark, d, "orders"), "o_orderkey")
    return pipelines.nested_folds(x, "o_orderkey").select("o_orderkey", "fold", "inner")


@query("tfidf_svd")
def tfidf_svd(spark, d):
    return texts.tfidf_svd(tokens(spark, d), "doc_id", "toks")


@query("random_projection")
def random_projection(spark, d):
    return rounded(texts.random_projection(tokens(spark, d), "doc_id", "toks", 8), "value")


@query("without_first_direction")
def without_first_direction(spark, d):
    return texts.without_first_direction(table(spark, d, "embeddings"), "vec_id", "embedding")
