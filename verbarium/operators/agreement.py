"""Coder agreement and the fold of qualitative event logs. Ratings are (unit, coder, label)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbarium.corpus import round6, table


def cohen(ratings: DataFrame) -> DataFrame:
    """Two coders, no missing values: kappa NULL where chance agreement is 1."""
    wide = ratings.groupBy("unit").agg(F.max(F.when(F.col("coder") == "a", F.col("label"))).alias("a"), F.max(F.when(F.col("coder") == "b", F.col("label"))).alias("b"))
    cells = wide.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    n = cells.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    ma, mb = cells.groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("x")), cells.groupBy(F.col("b").alias("c")).agg(F.sum("n").alias("y"))
    e = ma.join(mb, "c").agg(F.sum(F.col("x") * F.col("y")).alias("e"))
    po, pe = F.col("same") / F.col("t"), F.col("e") / (F.col("t") * F.col("t"))
    return n.crossJoin(e).select(round6(po).alias("observed"), round6(pe).alias("expected"), round6(F.try_divide(po - pe, 1 - pe)).alias("kappa"))


def fleiss(ratings: DataFrame) -> DataFrame:
    """Complete ratings by the same number of coders."""
    c = ratings.groupBy("unit", "label").agg(F.count(F.lit(1)).alias("n"))
    unit = c.groupBy("unit").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("s"))
    p = unit.agg(F.avg(F.col("s") / (F.col("m") * (F.col("m") - 1))).alias("po"), F.sum("m").alias("t"))
    share = c.groupBy("label").agg(F.sum("n").alias("k")).crossJoin(F.broadcast(p)).agg(F.sum((F.col("k") / F.col("t")) * (F.col("k") / F.col("t"))).alias("pe"), F.first("po").alias("po"))
    return share.select(round6(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe"))).alias("kappa"))


def krippendorff(ratings: DataFrame, level: str = "nominal") -> DataFrame:
    """Alpha with missing values: units need two values at least; coincidences weigh 1 / (m - 1)."""
    r = ratings.where(F.col("label").isNotNull()).withColumn("v", F.col("label").cast("double"))
    sizes = r.groupBy("unit").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    counts = r.join(sizes, "unit").groupBy("unit", "m", "v").agg(F.count(F.lit(1)).alias("n"))
    # pairs of different or equal values in a unit, without pairing its rows
    x = counts.select("unit", "m", F.col("v").alias("a"), F.col("n").alias("na")).join(counts.select("unit", F.col("v").alias("b"), F.col("n").alias("nb")), "unit")
    pairs = F.when(F.col("a") == F.col("b"), F.col("na") * (F.col("na") - 1)).otherwise(F.col("na") * F.col("nb"))
    o = x.groupBy("a", "b").agg(F.sum(pairs / (F.col("m") - 1)).alias("o"))
    k = o.groupBy("a").agg(F.sum("o").alias("k"))
    run = k.withColumn("below", F.sum("k").over(Window.orderBy("a")))  # one row per category
    ab = run.select(F.col("a"), F.col("k").alias("ka"), F.col("below").alias("sa")).crossJoin(F.broadcast(run.select(F.col("a").alias("b"), F.col("k").alias("kb"), F.col("below").alias("sb"))))
    gap = F.abs(F.col("sa") - F.col("sb")) + F.when(F.col("sa") > F.col("sb"), F.col("kb") - F.col("ka")).otherwise(F.col("ka") - F.col("kb")) / 2
    d = {"nominal": (F.col("a") != F.col("b")).cast("double"), "interval": (F.col("a") - F.col("b")) * (F.col("a") - F.col("b")), "ratio": F.coalesce(F.try_divide((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")), (F.col("a") + F.col("b")) * (F.col("a") + F.col("b"))), F.lit(0.0)), "ordinal": F.when(F.col("a") == F.col("b"), 0.0).otherwise(gap * gap)}[level]
    s = ab.join(o, ["a", "b"], "left").agg(F.sum(F.coalesce("o", F.lit(0.0)) * d).alias("do"), F.sum(F.col("ka") * F.col("kb") * d).alias("de"))
    n = k.agg(F.sum("k").alias("n"))
    return s.crossJoin(n).select(round6(1 - F.try_divide((F.col("n") - 1) * F.col("do"), F.col("de"))).alias("alpha"))


def krippendorff_interval(ratings: DataFrame, resamples: int = 1000, seed: int = 20260918, level: float = 0.95) -> tuple[float, float]:
    """Percentile interval of nominal alpha by resampling units, on the table of rating patterns.

    Units with the same multiset of values are interchangeable, so only the distinct patterns reach the driver.
    """
    r = ratings.where(F.col("label").isNotNull()).groupBy("unit").agg(F.sort_array(F.collect_list(F.col("label").cast("double"))).alias("p")).where(F.size("p") > 1)
    rows = sorted(((tuple(x.p), x.n) for x in r.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()), key=lambda x: x[0])
    cats = sorted({v for p, _ in rows for v in p})
    c = np.array([[p.count(v) for v in cats] for p, _ in rows], float)
    m = c.sum(1)
    weights, rng, out = np.array([n for _, n in rows], float), np.random.default_rng(seed), []
    agree, kept = ((c * (c - 1)).sum(1) / (m - 1)), c
    for w in rng.multinomial(int(weights.sum()), weights / weights.sum(), size=resamples):
        k, n = w @ kept, (w * m).sum()
        expected = n * n - (k * k).sum()
        out.append(1 - (n - 1) * (n - (w * agree).sum()) / expected if expected > 0 else 1.0)
    return float(np.quantile(out, (1 - level) / 2)), float(np.quantile(out, (1 + level) / 2))


def fold(events: DataFrame) -> DataFrame:
    """Active codings of an append-only log (seq, kind, unit, coder, label, target): the last coding of each unit and
    coder that no retraction names."""
    gone = events.where("kind = 'retract'").select(F.col("target").alias("seq"))
    active = events.where("kind = 'code'").join(gone, "seq", "left_anti")
    return active.groupBy("unit", "coder").agg(F.max_by("label", "seq").alias("label"), F.count(F.lit(1)).alias("codings"))


def _codings(events: DataFrame) -> DataFrame:
    """(unit, coder, n, label): how many active codings a coder has of a unit."""
    gone = events.where("kind = 'retract'").select(F.col("target").alias("seq"))
    return events.where("kind = 'code'").join(gone, "seq", "left_anti").groupBy("unit", "coder").agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("label"))


def agreement_table(events: DataFrame) -> DataFrame:
    """Unit by coder with one active coding; agreement_counted also says how many ambiguous units were dropped."""
    per = _codings(events)
    bad = per.where("n > 1").select("unit").distinct()
    return per.join(bad, "unit", "left_anti").select("unit", "coder", "label")


def agreement_counted(events: DataFrame) -> DataFrame:
    """agreement_table with the number of ambiguous units in each row; where no unit is left, one row has only that."""
    units = _codings(events).groupBy("unit").agg(F.max("n").alias("n"))
    count = units.agg(F.count_if(F.col("n") > 1).alias("ambiguous_units"), F.count_if(F.col("n") == 1).alias("kept"))
    table = agreement_table(events)
    none = count.where("kept = 0").select(*(F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns), "ambiguous_units")
    return table.crossJoin(F.broadcast(count.drop("kept"))).unionByName(none)


def _labels(spark, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(F.col("doc_id").alias("unit"), F.inline(F.array(F.struct(F.lit("a").alias("coder"), F.col("quality").alias("label")), F.struct(F.lit("b").alias("coder"), (1 - F.col("toxic")).alias("label")))))


def _graded(spark, sf: str) -> DataFrame:
    """Three graded ratings per order, some missing."""
    o = table(spark, sf, "lineitem")
    return o.select((F.col("l_orderkey") % 500).alias("unit"), (F.col("l_linenumber") % 3).alias("coder"), F.when(F.col("l_quantity") < 45, F.ceil(F.col("l_quantity").cast("double") / 10).cast("int")).alias("label"))


def event_log(spark, sf: str, unit: Column | None = None) -> DataFrame:
    """A coding log out of the events table: every seventh event retracts the coding three before it."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 == 0, "retract").otherwise("code").alias("kind"), (F.col("user_id") % 50 if unit is None else unit).alias("unit"), (F.col("event_id") % 3).alias("coder"), F.col("event_type").alias("label"), (F.col("event_id") - 3).alias("target"))


def daily_log(spark, sf: str) -> DataFrame:
    """event_log over all events, a unit being what one user did on one day: most units have one active coding a coder."""
    return event_log(spark, sf, F.concat_ws("@", F.col("user_id"), F.to_date("ts")))


def _level(level: str):
    return lambda s, sf: krippendorff(_graded(s, sf), level)


QUERIES = {
    "cohen_kappa": lambda s, sf: cohen(_labels(s, sf)), "fleiss_kappa": lambda s, sf: fleiss(_labels(s, sf)), "kripp_nominal": _level("nominal"), "kripp_interval": _level("interval"), "kripp_ratio": _level("ratio"), "kripp_ordinal": _level("ordinal"),
    "kripp_ci": lambda s, sf: s.createDataFrame([krippendorff_interval(_labels(s, sf))], "low double, high double"), "coding_agreement": lambda s, sf: cohen(_labels(s, sf)).crossJoin(fleiss(_labels(s, sf)).withColumnRenamed("kappa", "fleiss")).crossJoin(krippendorff(_labels(s, sf))),
    "qual_fold": lambda s, sf: fold(event_log(s, sf)), "qual_table": lambda s, sf: agreement_counted(daily_log(s, sf)),
}
_R = "WITH r AS (SELECT doc_id AS unit, 'a' AS coder, quality AS label FROM labels UNION ALL SELECT doc_id, 'b', 1 - toxic FROM labels)"
_G = """WITH r AS (SELECT l_orderkey % 500 AS unit, CAST(ceil(CAST(l_quantity AS DOUBLE) / 10) AS DOUBLE) AS v, row_number() OVER () AS rid FROM lineitem WHERE l_quantity < 45),
m AS (SELECT unit, count(*) AS m FROM r GROUP BY unit HAVING count(*) > 1),
o AS (SELECT x.v AS a, y.v AS b, sum(1 / (m - 1)) AS o FROM r x JOIN r y ON x.unit = y.unit AND x.rid <> y.rid JOIN m ON m.unit = x.unit GROUP BY ALL),
k AS (SELECT a AS v, sum(o) AS k FROM o GROUP BY a), n AS (SELECT sum(k) AS n FROM k),
c AS (SELECT v, k, sum(k) OVER (ORDER BY v) AS s FROM k), ab AS (SELECT x.v AS a, y.v AS b, x.k AS ka, y.k AS kb, {d} AS d FROM c x, c y)
SELECT round(1 - (SELECT n - 1 FROM n) * (SELECT sum(o * d) FROM o JOIN ab USING (a, b)) / (SELECT sum(ka * kb * d) FROM ab), 6) AS alpha"""
_LOG = "WITH e AS (SELECT event_id AS seq, CASE WHEN event_id % 7 = 0 THEN 'retract' ELSE 'code' END AS kind, user_id % 50 AS unit, event_id % 3 AS coder, event_type AS label, event_id - 3 AS target FROM events), a AS (SELECT * FROM e WHERE kind = 'code' AND seq NOT IN (SELECT target FROM e WHERE kind = 'retract'))"
ORACLES = {
    "cohen_kappa": """WITH c AS (SELECT quality AS a, 1 - toxic AS b, count(*) AS n FROM labels GROUP BY ALL), t AS (SELECT sum(n) AS t, sum(CASE WHEN a = b THEN n ELSE 0 END) AS s FROM c),
      e AS (SELECT sum(x * y) AS e FROM (SELECT a AS c, sum(n) AS x FROM c GROUP BY 1) JOIN (SELECT b AS c, sum(n) AS y FROM c GROUP BY 1) USING (c)), p AS (SELECT s / t AS po, e / (t * t) AS pe FROM t, e)
      SELECT round(po, 6) AS observed, round(pe, 6) AS expected, round((po - pe) / (1 - pe), 6) AS kappa FROM p""",
    "fleiss_kappa": _R + """, c AS (SELECT unit, label, count(*) AS n FROM r GROUP BY ALL), u AS (SELECT unit, sum(n) AS m, sum(n * (n - 1)) AS s FROM c GROUP BY unit),
      p AS (SELECT avg(s / (m * (m - 1))) AS po, sum(m) AS t FROM u), q AS (SELECT sum((k / t) ** 2) AS pe FROM (SELECT sum(n) AS k FROM c GROUP BY label), p) SELECT round((po - pe) / (1 - pe), 6) AS kappa FROM p, q""",
    "kripp_nominal": _G.format(d="CASE WHEN x.v = y.v THEN 0 ELSE 1 END"), "kripp_interval": _G.format(d="(x.v - y.v) ** 2"), "kripp_ratio": _G.format(d="((x.v - y.v) / (x.v + y.v)) ** 2"),
    "kripp_ordinal": _G.format(d="CASE WHEN x.v = y.v THEN 0 ELSE (abs(x.s - y.s) + CASE WHEN x.s > y.s THEN y.k - x.k ELSE x.k - y.k END / 2) ** 2 END"),
    "qual_fold": _LOG + " SELECT unit, coder, max_by(label, seq) AS label, count(*) AS codings FROM a GROUP BY unit, coder",
    "qual_table": _LOG.replace("user_id % 50", "concat_ws('@', user_id, CAST(ts AS DATE))") + """, p AS (SELECT unit, coder, count(*) AS n, max(label) AS label FROM a GROUP BY unit, coder), u AS (SELECT unit, max(n) AS n FROM p GROUP BY unit),
      k AS (SELECT count(*) FILTER (n > 1) AS ambiguous_units, count(*) FILTER (n = 1) AS kept FROM u)
      SELECT p.unit, coder, label, ambiguous_units FROM p JOIN u ON u.unit = p.unit AND u.n = 1, k UNION ALL SELECT NULL, NULL, NULL, ambiguous_units FROM k WHERE kept = 0""",
}
