"""Mergeable quantile summaries: order statistics with rank intervals.

A batch is range-sorted over the cluster, which gives every distinct value its exact rank; its summary keeps evenly spaced order
statistics, each with the interval in which the counts of rows below it and up to it lie (exact ones, for a batch). A merge takes
only summaries: at each value that any of them keeps, the bounds that the summaries give are added up. Its result is a summary
again. An estimate is the kept value whose worst rank error is least.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vocalis.llm.frames import stored, unused
from vocalis.llm.ranks import placed

#: Order statistics that a batch's summary keeps by rank, and distinct values that it keeps at least, where it has so many.
POINTS, LEAST = 200, 10
#: What a summary's rows have beside their keys: the value, bounds of the rows below it and up to it, and the summary's rows.
BOUNDS = ("x", "below_lo", "below_hi", "upto_lo", "upto_hi", "n")


def counted(rows: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Each distinct x of each group and how often it occurs, counted before anything is shuffled. Rows without an x are dropped."""
    return rows.where(F.col("x").isNotNull()).groupBy(*keys, "x").agg((F.sum(weight) if weight else F.count("*")).alias("w"))


def ranked(values: DataFrame, keys: list[str]) -> DataFrame:
    """From counted(): (keys, x, below, upto, n, place, distinct), the exact counts of rows below and up to each value."""
    out = placed(values, keys, ["x"], "w")
    return out.select(*keys, "x", F.col("before").alias("below"), (F.col("before") + F.col("w")).alias("upto"), F.col("total").alias("n"), F.col("position").alias("place"), F.col("rows").alias("distinct"))


def _spaced(first: Column, last: Column, n: Column, k: int) -> Column:
    """Whether one of k evenly spaced ranks of 1 to n (1 and n among them) lies in first to last; all do if n is at most k."""
    upto = lambda r: F.least(F.floor((r * (k - 1) + n - 2) / F.greatest(n - 1, F.lit(1))), F.lit(k))  # noqa: E731  such ranks that are r at most
    return (n <= k) | (upto(last) > upto(first - 1))


def summarise(ranks: DataFrame, keys: list[str], points: int = POINTS, least: int = LEAST) -> DataFrame:
    """The summary of each group of ranked(): (keys, *BOUNDS), at most points + least rows each, and no more than its distinct values.

    The least and the greatest value are always kept; of ``points`` or fewer rows all distinct values are.
    """
    keep = _spaced(F.col("below") + 1, F.col("upto"), F.col("n"), points) | _spaced(F.col("place") + 1, F.col("place") + 1, F.col("distinct"), least)
    exact = {"below_lo": "below", "below_hi": "below", "upto_lo": "upto", "upto_hi": "upto"}
    return ranks.where(keep).select(*keys, "x", *[F.col(c).alias(name) for name, c in exact.items()], "n")


def merge(summaries: DataFrame, keys: list[str], batch: str, points: int | None = None) -> DataFrame:
    """The summary of all of a group's summaries, which ``batch`` tells apart: (keys, *BOUNDS). Reads nothing but the summaries.

    A summary that doesn't keep x has at least as many rows below x as up to its last value under x, and at most as many rows up to
    x as below its next value. Written as steps from one kept value to the next, the sums over all summaries are running sums.
    A group's task holds its summaries' points; many batches are merged in levels, with ``points`` to thin out each result.
    """
    chain = W.partitionBy(*keys, batch).orderBy("x")
    steps = summaries.withColumn("upto_before", F.coalesce(F.lag("upto_lo").over(chain), F.lit(0))).withColumn("below_next", F.coalesce(F.lead("below_hi").over(chain), "n"))
    steps = steps.withColumns({"first": F.lag("x").over(chain).isNull(), "low_here": F.col("below_lo") - F.col("upto_before"), "low": F.col("upto_lo") - F.col("upto_before"), "high_here": F.col("upto_hi") - F.col("below_hi"), "high": F.col("below_next") - F.col("below_hi")})
    start = F.sum(F.when(F.col("first"), F.col("below_hi")).otherwise(0)).alias("start"), F.sum(F.when(F.col("first"), F.col("n")).otherwise(0)).alias("rows")
    at = steps.groupBy(*keys, "x").agg(*[F.sum(c).alias(c) for c in ("low_here", "low", "high_here", "high")], *start)
    group, upto = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    low, high = F.sum("low").over(upto), F.sum("start").over(group) + F.sum("high").over(upto)
    out = at.select(*keys, "x", (low - F.col("low") + F.col("low_here")).alias("below_lo"), (high - F.col("high")).alias("below_hi"), low.alias("upto_lo"), (high - F.col("high") + F.col("high_here")).alias("upto_hi"), F.sum("rows").over(group).alias("n"))
    if points is None:
        return out
    middle = F.floor((F.lag("upto_lo", 1, 0).over(W.partitionBy(*keys).orderBy("x")) + F.lag("upto_hi", 1, 0).over(W.partitionBy(*keys).orderBy("x"))) / 2) + 1
    ends = F.row_number().over(W.partitionBy(*keys).orderBy("x")).isin(1) | F.lead("x").over(W.partitionBy(*keys).orderBy("x")).isNull()
    last = F.floor((F.col("upto_lo") + F.col("upto_hi")) / 2)
    return out.withColumn("kept", ends | _spaced(middle, last, F.col("n"), points)).where("kept").drop("kept")


def estimate(summaries: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """For i in 1 to parts - 1: (keys, i, n, target, points, answer) with target = ceil(i * n / parts).

    ``answer`` is the kept value with the least bound of its rank error, the smallest of equals, so that answers don't decrease in i.
    """
    at = summaries.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(parts - 1)))).withColumn("target", _target(F.col("n"), F.col("i"), parts))
    worst = F.greatest(F.lit(0).cast("long"), F.col("below_hi") + 1 - F.col("target"), F.col("target") - F.col("upto_lo"))
    return at.groupBy(*keys, "i", "n", "target").agg(F.count("*").alias("points"), F.min_by("x", F.struct(worst.alias("worst"), F.col("x").alias("at"))).alias("answer"))


def _target(n: Column, i: Column, parts: int) -> Column:
    return F.floor((i * n + parts - 1) / parts).cast("long")


def batch_of(id_column: Column, count: int = 4) -> Column:
    """crc32 of an id in decimal modulo ``count``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(count)).cast("int")


def scaled(money: Column, batch: Column) -> Column:
    """floor(100 * money + 0.5) + 1000 * batch; null where money is null, not a number or infinite."""
    sound = money.isNotNull() & ~F.isnan(money) & (F.abs(money) != float("inf"))
    return F.when(sound, F.floor(100 * money + 0.5).cast("long") + 1000 * batch)


def audit(rows: DataFrame, keys: list[str], parts: int = 4, least_rows: int = 20, points: int = POINTS, least: int = LEAST, tolerance: int = 20) -> DataFrame:
    """Summaries of each batch of each group and, merged from these alone, of the whole group (batch -1), held against exact ranks.

    From rows with keys, ``batch``, ``x`` and the count ``w``. Returns keys, batch, i, n, target, exact_x, points, answer, n_below,
    n_upto, rank_error and within (rank_error is at most ``tolerance`` thousandths of n), for summaries of ``least_rows`` rows or
    more. An empty table gives an empty result. The exact columns come from the same range sort; the summaries of the whole don't.
    """
    whole = rows.withColumn("batch", F.explode(F.array("batch", F.lit(-1))))
    by = [*keys, "batch"]
    ranks = stored(ranked(counted(whole, by, "w"), by))
    parted = summarise(ranks.where("batch >= 0"), by, points, least)
    merged = merge(parted, keys, "batch").withColumn("batch", F.lit(-1))
    answers = estimate(parted.unionByName(merged).where(F.col("n") >= least_rows), by, parts)
    at = F.explode(F.filter(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: _target(F.col("n"), i, parts).between(F.col("below") + 1, F.col("upto"))))
    exact = ranks.where(F.col("n") >= least_rows).select(*by, at.alias("i"), F.col("x").alias("exact_x"))
    place = ranks.select(*by, F.col("x").alias("answer"), F.col("below").alias("n_below"), F.col("upto").alias("n_upto"))
    out = answers.join(exact.hint("merge"), [*by, "i"]).join(place.hint("merge"), [*by, "answer"])
    error = F.greatest(F.lit(0).cast("long"), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    out = out.withColumn("rank_error", error).withColumn("within", 1000 * F.col("rank_error") <= tolerance * F.col("n"))
    return out.select(*by, "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error", "within")


def shop(clicks: DataFrame, sale_lines: DataFrame, items: DataFrame) -> DataFrame:
    """The streams ``value`` and ``price`` of a shop's tables as (stream, grp, batch, x, w).

    Rows of clicks with one click_id are one row (null is one id, too); of unequal ones that with the least client and value counts.
    A line's x depends on its item and its vendor's batch alone, so lines are counted by those before they meet the items. Of items
    with one id each counts. A line without a known item, or of one without a brand or a price, is dropped.
    """
    once = clicks.groupBy("click_id").agg(F.min(F.struct("client_id", F.col("value").cast("double").alias("value"))).alias("c"))
    once = once.select(F.lit("value").alias("stream"), F.col("c.client_id").cast("string").alias("grp"), batch_of(F.col("click_id")).alias("batch"), F.col("c.value").alias("money"), F.lit(1).cast("long").alias("w"))
    lines = sale_lines.where("item_id is not null").groupBy("item_id", batch_of(F.col("vendor_id")).alias("batch")).agg(F.count("*").alias("w"))
    priced = lines.join(items.select("item_id", F.col("brand").alias("grp"), F.col("price").cast("double").alias("money")).hint("merge"), "item_id")
    rows = once.unionByName(priced.select(F.lit("price").alias("stream"), "grp", "batch", "money", "w"))
    return rows.where("grp is not null").select("stream", "grp", "batch", scaled(F.col("money"), F.col("batch")).alias("x"), "w").where("x is not null")


#: Written apart from the operator: exact ranks by window functions over all rows, bounds by looking up neighbours.
ORACLE_SQL = f"""
WITH ids AS (SELECT DISTINCT v FROM (SELECT click_id::VARCHAR AS v FROM clicks UNION ALL SELECT vendor_id::VARCHAR FROM sale_lines)),
crc AS (
  SELECT v, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(v) + 1), lambda i: ord(v[i])::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda p, q: CASE WHEN p & 1 = 1 THEN xor(p >> 1, 3988292384) ELSE p >> 1 END)), 4294967295) % 4)::INT AS batch FROM ids
), streams AS (
  SELECT 'value' AS stream, client_id::VARCHAR AS grp, click_id::VARCHAR AS v, value AS money FROM (SELECT DISTINCT click_id, client_id, value FROM clicks)
  UNION ALL SELECT 'price', brand, vendor_id::VARCHAR, price FROM sale_lines JOIN items USING (item_id)
), one AS (
  SELECT stream, grp, batch, floor(100 * money + 0.5)::BIGINT + 1000 * batch AS x FROM streams JOIN crc USING (v) WHERE grp IS NOT NULL AND money IS NOT NULL
), k AS (
  SELECT stream, grp, batch, x, count(*) AS w FROM one GROUP BY ALL UNION ALL SELECT stream, grp, -1, x, count(*) FROM one GROUP BY stream, grp, x
), r AS (
  SELECT *, (sum(w) OVER (PARTITION BY stream, grp, batch ORDER BY x) - w)::BIGINT AS below, (sum(w) OVER (PARTITION BY stream, grp, batch ORDER BY x))::BIGINT AS upto,
         (sum(w) OVER (PARTITION BY stream, grp, batch))::BIGINT AS n, row_number() OVER (PARTITION BY stream, grp, batch ORDER BY x) AS place, count(*) OVER (PARTITION BY stream, grp, batch) AS distincts FROM k
), p AS (
  SELECT * FROM r WHERE batch >= 0 AND (n <= {POINTS} OR distincts <= {LEAST}
    OR EXISTS (SELECT 1 FROM range({POINTS}) j(j) WHERE 1 + j * (n - 1) // {POINTS - 1} BETWEEN below + 1 AND upto)
    OR EXISTS (SELECT 1 FROM range({LEAST}) j(j) WHERE 1 + j * (distincts - 1) // {LEAST - 1} = place))
), c AS (SELECT DISTINCT stream, grp, x FROM p), g AS (SELECT DISTINCT stream, grp, batch, n FROM p),
e AS (SELECT c.*, g.batch, g.n FROM c JOIN g USING (stream, grp)),
u AS (SELECT e.stream, e.grp, e.batch, e.x, e.n, q.upto AS floor_, q.x AS qx, q.below AS qbelow FROM e ASOF LEFT JOIN p q ON e.stream = q.stream AND e.grp = q.grp AND e.batch = q.batch AND e.x >= q.x),
o AS (SELECT u.*, s.below AS ceil_ FROM u ASOF LEFT JOIN p s ON u.stream = s.stream AND u.grp = s.grp AND u.batch = s.batch AND u.x < s.x),
m AS (
  SELECT stream, grp, -1 AS batch, x, sum(n)::BIGINT AS n, sum(CASE WHEN qx = x THEN qbelow ELSE coalesce(ceil_, n) END)::BIGINT AS below_hi, sum(coalesce(floor_, 0))::BIGINT AS upto_lo FROM o GROUP BY stream, grp, x
  UNION ALL SELECT stream, grp, batch, x, n, below, upto FROM p
), b AS (
  SELECT stream, grp, batch, i::INT AS i, n, (i * n + 3) // 4 AS target, count(*) AS points,
         first(x ORDER BY greatest(0, below_hi + 1 - (i * n + 3) // 4, (i * n + 3) // 4 - upto_lo), x) AS answer
  FROM m, range(1, 4) t(i) WHERE n >= 20 GROUP BY stream, grp, batch, i, n
), f AS (
  SELECT b.*, t.x AS exact_x, a.below AS n_below, a.upto AS n_upto, greatest(0, a.below + 1 - target, target - a.upto) AS rank_error
  FROM b JOIN r t ON b.stream = t.stream AND b.grp = t.grp AND b.batch = t.batch AND target BETWEEN t.below + 1 AND t.upto
  JOIN r a ON b.stream = a.stream AND b.grp = a.grp AND b.batch = a.batch AND a.x = b.answer
)
SELECT stream, grp, batch, i, n, target, exact_x, points, answer, n_below, n_upto, rank_error, 1000 * rank_error <= 20 * n AS within FROM f
"""
