"""Queries of orders, quotas, curricula, balanced parts and set operations, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.answers import over
from quern.operators import balance as BA
from quern.operators import filters as L
from quern.operators import lookups as LK
from quern.operators import sampling as M
from quern.plans.data_queries import _query
from quern.plans.queries import ROLLOUTS, rollouts

ORDERS = "WITH o AS (SELECT o_orderkey AS id, o_custkey AS cust, o_orderpriority AS field, o_totalprice AS price, floor(o_totalprice / 100)::BIGINT + 1 AS length FROM orders)"


def orders(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("field"), F.col("o_totalprice").alias("price"), (F.floor(F.col("o_totalprice") / 100) + 1).alias("length"))


_PLACED = ORDERS + ", p AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS place FROM o)"


@_query("SMP-02", ROLLOUTS.rstrip() + " SELECT row_idx, (row_number() OVER (ORDER BY row_idx % 8 // 2, row_idx // 8, row_idx % 2) - 1)::BIGINT AS place FROM r")
def _(spark, d):
    r = rollouts(spark, d).select("row_idx", M.scatter_order(F.col("row_idx"), 8, 4).alias("o"))
    return M.number_rows(r.select("row_idx", "o.rank", "o.question", "o.answer"), ["rank", "question", "answer"], "place").select("row_idx", "place")


for _epoch, _name in ((0, "SMP-03"), (2, "SMP-04")):
    _query(_name, _PLACED.format(order=f"md5('11:{_epoch}:' || id), id") + f" SELECT id, place, {_epoch} AS epoch, (place + {_epoch} * (SELECT count(*) FROM o)) // 32 AS batch FROM p")(
        lambda spark, d, e=_epoch: M.epoch_batches(orders(spark, d).select("id"), "id", 11, e, 32)
    )


@_query("SMP-06", ORDERS + """, n AS (SELECT field, count(*) AS n, 2 + ascii(field) % 7 AS target FROM o GROUP BY 1), s AS (SELECT field, n - target AS surplus FROM n WHERE n > target),
x AS (SELECT field, surplus, row_number() OVER (ORDER BY field) AS i, count(*) OVER () AS of, least(round_even(23 * surplus / sum(surplus) OVER (), 0), surplus) AS give FROM s),
y AS (SELECT *, 23 - coalesce(sum(give) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM x)
SELECT field AS bucket, CASE WHEN i = of THEN least(rest, surplus) ELSE least(give, rest) END::BIGINT AS extra FROM y WHERE CASE WHEN i = of THEN least(rest, surplus) ELSE least(give, rest) END > 0""")
def _(spark, d):
    sizes = sorted(tuple(r) for r in orders(spark, d).groupBy("field").count().collect())  # a row per field
    over = {f: n - (2 + ord(f[0]) % 7) for f, n in sizes if n > 2 + ord(f[0]) % 7}
    extra = {f: n for f, n in L.redistribute_shortfall(23, over).items() if n > 0}
    return spark.createDataFrame(list(extra.items()), "bucket string, extra long")


@_query("SMP-07", ORDERS + ", s AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY md5('3:' || id), id) AS k FROM o), q AS (SELECT field, row_number() OVER (ORDER BY field) AS i FROM (SELECT DISTINCT field FROM o)) SELECT id, field FROM s JOIN q USING (field) WHERE k <= 10 + (i <= 3)::INT")
def _(spark, d):
    return M.balanced(orders(spark, d), "field", "id", 53, 3).select("id", "field")


@_query("SMP-08", ORDERS + """, dev AS (SELECT id FROM o WHERE id % 3 = 0), h AS (SELECT event_id % 400 AS id, avg((value > 10)::INT) AS mean FROM events GROUP BY 1),
p AS (SELECT dev.id, row_number() OVER (ORDER BY coalesce(mean, 0.5), dev.id) - 1 AS place, count(*) OVER () AS n FROM dev LEFT JOIN h ON h.id = dev.id),
k AS (SELECT id FROM p WHERE place >= floor(n * 0.1) AND place < n - floor(n * 0.2)),
f AS (SELECT id, row_number() OVER (ORDER BY md5('4:' || id), id) AS k FROM o WHERE id % 3 <> 1 AND id % 7 > 0 AND id NOT IN (SELECT id FROM p))
SELECT id, 'kept' AS origin FROM k UNION ALL SELECT id, 'pool' FROM f WHERE k <= (SELECT max(floor(n * 0.1) + floor(n * 0.2)) FROM p)""")
def _(spark, d):
    o = orders(spark, d)
    h = spark.read.parquet(f"{d}/events.parquet").select((F.col("event_id") % 400).alias("id"), (F.col("value") > 10).cast("int").alias("accuracy"))
    return M.curriculum(o.where("id % 3 = 0"), h, o.where("id % 3 <> 1"), o.where("id % 7 = 0"), "id", 0.1, 0.2, 4)


@_query("JN-05-pool", ORDERS + " SELECT id FROM o WHERE id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0) AND id NOT IN (SELECT id FROM o WHERE price < 100000)")
def _(spark, d):
    o = orders(spark, d)
    used = spark.read.parquet(f"{d}/events.parquet").where("event_id % 3 = 0").select(F.col("event_id").alias("id"))
    return o.select("id").join(used, "id", "left_anti").join(o.where("price < 100000").select("id"), "id", "left_anti")


@_query("SMP-09", ROLLOUTS.rstrip() + ' SELECT "group", doc AS loop, count(ok) AS n, round(avg(ok), 5) + 0.0 AS accuracy FROM r GROUP BY 1, 2')
def _(spark, d):
    return LK.loop_accuracy(rollouts(spark, d), "group", "doc", "ok").select("group", "loop", "n", (F.round("accuracy", 5) + 0.0).alias("accuracy"))


@_query("SMP-10", ORDERS + " SELECT id FROM o ORDER BY md5('7:' || id), id LIMIT 40")
def _(spark, d):
    return M.subsample(orders(spark, d), "id", 40, 7).select("id")


_SNAKE = _PLACED.format(order="length DESC, id") + ", s AS (SELECT id, length, (CASE WHEN place // {k} % 2 = 0 THEN place % {k} ELSE {k} - 1 - place % {k} END)::INT AS part FROM p)"


@_query("SMP-17-snake", _SNAKE.format(k=8) + " SELECT id, part FROM s")
def _(spark, d):
    return M.snake_parts(orders(spark, d), "length", "id", 8).select("id", "part")


@_query("SMP-15-snake", _SNAKE.replace("{k}", "(SELECT greatest(1, ceil(sum(length) / 50000))::BIGINT FROM o)") + " SELECT id, part FROM s")
def _(spark, d):
    return M.capped_batches(orders(spark, d), "length", "id", 50000).select("id", F.col("part").cast("int").alias("part"))


#: Orders in batches of 512 by number; dealing a batch can't be said in SQL, so tests hold it to a plain version.
BATCH = 512


def _batches(spark, d):
    placed = M.number_rows(orders(spark, d).select("id", "length"), ["id"], "place")
    return M.truncated(placed, "place", 8).withColumn("batch", F.floor(F.col("place") / BATCH))


@_query("SMP-12", None)
def _(spark, d):
    return BA.balanced(_batches(spark, d), "batch", "id", "length", 8, equal_size=True)


@_query("SMP-13", None)
def _(spark, d):
    return BA.greedily(_batches(spark, d), "batch", "id", "length", 8, equal_size=True)


@_query("SMP-15", None)
def _(spark, d):
    return BA.capped(_batches(spark, d), "batch", "id", "length", 50_000, multiple=2)


@_query("SMP-17", None)
def _(spark, d):
    return BA.ranked(_batches(spark, d), "batch", "id", "length", 8)


@_query("AGG-40", _SNAKE.format(k=8) + ", x AS (SELECT sum(length) AS s FROM s GROUP BY part) SELECT min(s)::BIGINT AS least, max(s)::BIGINT AS most, (max(s) - min(s))::BIGINT AS spread, round(avg(s), 5) + 0.0 AS mean FROM x")
def _(spark, d):
    return M.balance_report(M.snake_parts(orders(spark, d), "length", "id", 8), "part", "length")


@_query("SMP-16", _PLACED.format(order="md5('1:' || id), id") + " SELECT id AS place, place AS id FROM p")
def _(spark, d):
    o = orders(spark, d).select("id").withColumn("h", F.md5(F.concat(F.lit("1:"), F.col("id").cast("string"))))
    return M.reverse_index(M.number_rows(o, ["h", "id"], "place").select("place", "id"), "place", "id")


@_query("SMP-20", "SELECT item_id, doc::BIGINT AS doc FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS place, count(*) OVER () AS n FROM benchmark) JOIN range(1234) t(doc) ON doc % n = place")
def _(spark, d):
    return M.replicate(spark.read.parquet(f"{d}/benchmark.parquet").select("item_id"), "item_id", 1234)


@_query("SMP-21", ROLLOUTS.rstrip() + " SELECT row_idx FROM r WHERE row_idx < (SELECT count(*) - count(*) % 7 FROM r)")
def _(spark, d):
    return M.truncated(rollouts(spark, d), "row_idx", 7).select("row_idx")


@_query("FLT-06", """WITH n AS (SELECT n_nationkey AS k FROM nation) SELECT k, CASE k % 4 WHEN 0 THEN 'Top-Alpha' WHEN 1 THEN 'top ' || k WHEN 2 THEN ' RandomOne ' ELSE 'random_' || k END AS given,
CASE k % 4 WHEN 0 THEN 'top_alpha' WHEN 1 THEN 'top_' || k WHEN 2 THEN 'random_one' ELSE 'random_' || k END AS mode, CASE k % 4 WHEN 1 THEN k WHEN 2 THEN 1 WHEN 3 THEN k END::BIGINT AS keep FROM n WHERE k <> 1""")
def _(spark, d):
    given = "case n_nationkey % 4 when 0 then 'Top-Alpha' when 1 then concat('top ', n_nationkey) when 2 then ' RandomOne ' else concat('random_', n_nationkey) end"
    n = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey <> 1").select(F.col("n_nationkey").alias("k"), F.expr(given).alias("given"))
    return n.select("k", "given", over(M.filter_mode)(F.col("given")).alias("mode"), over(M.keep_count, "long")(F.col("given")).alias("keep"))


@_query("FLT-07", 'SELECT o_orderpriority AS field, ceil(0.15 * count(*))::BIGINT AS keep FROM orders GROUP BY 1')
def _(spark, d):
    return LK.keep_shares(orders(spark, d), "field", 0.15)


_AB = 'WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders), b AS (SELECT DISTINCT user_id AS id FROM events)'


def _ids(spark, d):
    a = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("id")).distinct()
    return a, spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("id")).distinct()


@_query("SET-02", ROLLOUTS.rstrip() + " SELECT row_idx, 0 AS loop FROM r WHERE doc < 5 UNION ALL SELECT row_idx, 1 FROM r WHERE doc >= 3")
def _(spark, d):
    r = rollouts(spark, d)
    return LK.by_loop([r.where("doc < 5").select("row_idx"), r.where("doc >= 3").select("row_idx")])


@_query("SET-03", _AB + " SELECT id FROM a EXCEPT SELECT id FROM b")
def _(spark, d):
    a, b = _ids(spark, d)
    return LK.outside(a, b, "id")


@_query("SET-04", _AB + " SELECT id FROM a INTERSECT SELECT id FROM b")
def _(spark, d):
    a, b = _ids(spark, d)
    return LK.inside(a, b, "id")


@_query("SET-06", "SELECT conv_id, list(text ORDER BY turn, text) AS texts FROM (SELECT * FROM conversations WHERE conv_id % 2 = 0 UNION ALL SELECT * FROM conversations WHERE conv_id % 3 = 0) GROUP BY 1")
def _(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    both = c.where("conv_id % 2 = 0").unionByName(c.where("conv_id % 3 = 0"))
    return both.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))


@_query("GRP-01", ROLLOUTS.rstrip() + ' SELECT "group", list(row_idx ORDER BY row_idx) AS rows FROM r GROUP BY 1')
def _(spark, d):
    return LK.in_order(rollouts(spark, d), "group", ["row_idx"], ["row_idx"]).withColumnRenamed("row_idx", "rows")


@_query("GRP-02", "SELECT c_custkey, CASE WHEN o IS NULL AND e IS NULL THEN 'neither' WHEN e IS NULL THEN 'dev_only' WHEN o IS NULL THEN 'gen_only' ELSE 'both' END AS label FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON o = c_custkey LEFT JOIN (SELECT DISTINCT user_id AS e FROM events) ON e = c_custkey")
def _(spark, d):
    a, b = _ids(spark, d)
    return LK.membership(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey"), "c_custkey", a, b, ("dev", "gen"))


@_query("PRJ-17", ORDERS + ", e AS (SELECT id, x AS epoch, row_number() OVER (PARTITION BY x ORDER BY md5('2:' || x || ':' || id), id) - 1 AS k FROM o, range(3) t(x)) SELECT id, epoch::INT AS epoch, k // 64 AS batch FROM e")
def _(spark, d):
    o = orders(spark, d).select("id")
    parts = [M.epoch_batches(o, "id", 2, e, 64).select("id", "epoch", F.floor(F.col("place") / 64).alias("batch")) for e in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query("PRJ-18", "SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS parts, list(l_linenumber ORDER BY l_linenumber, l_partkey) AS numbers FROM lineitem GROUP BY 1")
def _(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    listed = LK.in_order(x, "l_orderkey", ["l_linenumber", "l_partkey"], ["l_partkey", "l_linenumber"])
    return listed.withColumnsRenamed({"l_partkey": "parts", "l_linenumber": "numbers"})
