"""One query per operator family over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelmill.functions.values import amount_or_null, blank_to_null, capitals, quoted_identifier, quoted_literal
from reelmill.operators import relational as R
from reelmill.queries.problems import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(*tables: str, sql: str | None):
    """Register a function of the named tables; ``sql`` gives the same rows."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[table(spark, sf_dir, t) for t in tables])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return run

    return wrap


def day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def big(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def money(c: Column, digits: int = 2) -> Column:
    return F.round(c.cast("double"), digits)


@query("orders", sql="SELECT o_orderkey AS order_key, o_custkey AS customer_key, round(CAST(o_totalprice AS DOUBLE), 2) AS total, strftime(o_orderdate, '%Y-%m-%d') AS ordered_on FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000")
def scan_project_filter(orders):
    return orders.where((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 100000)).select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("customer_key"), money(F.col("o_totalprice")).alias("total"), day("o_orderdate").alias("ordered_on"))


@query("documents", sql="SELECT s AS source, count(*) AS n_rows, count(t) AS n_texts FROM (SELECT nullif(trim(source), '') AS s, nullif(trim(target_text), '') AS t FROM documents) GROUP BY s")
def blank_to_null_counts(documents):
    return documents.select(blank_to_null(F.col("source")).alias("source"), blank_to_null(F.col("target_text")).alias("t")).groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.count("t").alias("n_texts"))


@query("customer", sql="SELECT c_nationkey, count(*) AS n, count(CASE WHEN c_acctbal >= 1000 THEN 1 END) AS n_kept, round(avg(CASE WHEN c_acctbal >= 1000 THEN c_acctbal END), 2) AS avg_kept FROM customer GROUP BY 1")
def sentinel_to_null(customer):
    kept = amount_or_null(F.col("c_acctbal"), 1000)
    return customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count(kept).alias("n_kept"), money(F.avg(kept)).alias("avg_kept"))


@query("nation", sql="SELECT n_nationkey, nullif(substr(upper(trim(n_name)), 1, 2), '') AS code FROM nation")
def code_normalise(nation):
    return nation.select("n_nationkey", capitals(F.col("n_name")).alias("code"))


@query("events", sql="SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def dedup_latest(events):
    return R.leading(events, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type")


@query("lineitem", sql="SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice ASC NULLS LAST, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1")
def first_per_key(lineitem):
    first = R.leading(lineitem, ["l_orderkey"], [F.col("l_extendedprice").asc_nulls_last(), F.col("l_linenumber"), F.col("l_partkey")])
    return first.select("l_orderkey", "l_linenumber", money(F.col("l_extendedprice")).alias("price"))


@query("customer", "supplier", sql="SELECT nation, kind, name, round(balance, 2) AS balance FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY balance DESC NULLS LAST, name) AS rn FROM (SELECT c_nationkey AS nation, 'customer' AS kind, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, 'supplier', s_name, s_acctbal FROM supplier)) WHERE rn = 1")
def freshest_union(customer, supplier):
    a = customer.select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = supplier.select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    best = R.leading(a.unionByName(b), ["nation"], [F.col("balance").desc_nulls_last(), F.col("name")])
    return best.withColumn("balance", money(F.col("balance")))


@query("events", sql="SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn > 1")
def dup_rank(events):
    return R.trailing(events, ["user_id", "event_type"], [F.col("event_id")]).select("event_id")


@query("orders", sql="SELECT o_orderstatus, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM orders GROUP BY 1")
def share_of_total(orders):
    counts = orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy(F.lit(1)))  # one row per status
    return counts.select("o_orderstatus", "n", F.round((100.0 * F.col("n") / whole).cast("double"), 4).alias("pct"))


@query("part", sql="SELECT p_brand, p_partkey, CAST(rn AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 10")
def top_n_per_group(part):
    return R.leading(part, ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 10, "rn").select("p_brand", "p_partkey", big("rn").alias("rank"))


@query("customer", "orders", sql="SELECT c_custkey, n IS NOT NULL AS has_match, round(c_acctbal - avg_total, 6) AS gap, CASE WHEN n > 0 THEN round(c_acctbal / n, 8) END AS ratio FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS avg_total FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def left_enrich(customer, orders):
    totals = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("avg_total"))
    j = customer.join(totals, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", F.col("n").isNotNull().alias("has_match"), money(F.col("c_acctbal") - F.col("avg_total"), 6).alias("gap"), F.when(F.col("n") > 0, money(F.col("c_acctbal") / F.col("n"), 8)).alias("ratio"))


@query("lineitem", "part", "supplier", sql="SELECT p_brand, count(*) AS n_lines, round(avg(l_discount), 4) AS avg_discount, round(avg(l_quantity), 4) AS avg_quantity, count(*) FILTER (WHERE s_acctbal > 0) AS n_solvent FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def inner_3way_stats(lineitem, part, supplier):
    j = lineitem.select("l_partkey", "l_suppkey", "l_discount", "l_quantity").join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(supplier.select("s_suppkey", "s_acctbal"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_lines"), money(F.avg("l_discount"), 4).alias("avg_discount"), money(F.avg("l_quantity"), 4).alias("avg_quantity"), F.count_if(F.col("s_acctbal") > 0).alias("n_solvent"))


@query("customer", "nation", sql="SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON c_nationkey = n_nationkey")
def left_lookup(customer, nation):
    return customer.join(nation.where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("customer", "orders", "lineitem", sql="SELECT c_custkey, c_name, count(DISTINCT o_orderkey) AS n_orders, round(avg(l_quantity), 2) AS avg_quantity, round(sum(l_extendedprice), 2) AS amount FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2 ORDER BY n_orders DESC, c_custkey LIMIT 15")
def top_entities(customer, orders, lineitem):
    # lines are summed per order before the join, so that the wide side of the shuffle is one row per order
    lines = lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p"), F.count("l_quantity").alias("k"))
    per = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.countDistinct("o_orderkey").alias("n_orders"), money(F.sum("q") / F.sum("k")).alias("avg_quantity"), money(F.sum("p")).alias("amount"))
    return customer.join(per, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "n_orders", "avg_quantity", "amount").orderBy(F.col("n_orders").desc(), "c_custkey").limit(15)


@query("region", "nation", sql="SELECT r_name, (SELECT string_agg(n_name, ', ' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey) AS nations FROM region")
def scalar_subquery_listagg(region, nation):
    names = nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("nations"))
    return region.join(names, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("r_name", "nations")


@query("part", sql="SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types FROM part GROUP BY 1")
def listagg_distinct(part):
    return part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("types"))


@query("customer", "orders", sql="SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_in(customer, orders):
    return customer.join(orders.where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("part", "lineitem", sql="SELECT p_partkey, CASE WHEN p_partkey IS NULL THEN NULL ELSE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 AND l_partkey IS NOT NULL) END AS bulky FROM part")
def mark_join(part, lineitem):
    return R.with_membership(part.select("p_partkey"), "p_partkey", lineitem.where("l_quantity > 49"), "l_partkey", "bulky")


@query("customer", "orders", sql="SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 200000)")
def anti_exists(customer, orders):
    large = orders.where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000))
    return customer.join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("lineitem", "part", "supplier", sql="SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 5) OR NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0)")
def anti_or(lineitem, part, supplier):
    return R.missing_any(lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), [("l_partkey", part.where("p_size > 5"), "p_partkey"), ("l_suppkey", supplier.where("s_acctbal > 0"), "s_suppkey")]).select("l_orderkey", "l_linenumber")


@query("nation", "customer", "supplier", sql="SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)")
def anti_and(nation, customer, supplier):
    a = nation.join(customer.where("c_acctbal > 9900"), F.col("n_nationkey") == F.col("c_nationkey"), "left_anti")
    return a.join(supplier.where("s_acctbal > 5000"), F.col("n_nationkey") == F.col("s_nationkey"), "left_anti").select("n_nationkey")


@query("customer", sql="SELECT c_custkey FROM customer a WHERE NOT EXISTS (SELECT 1 FROM customer b WHERE a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND (coalesce(b.c_acctbal, 0), b.c_custkey) > (coalesce(a.c_acctbal, 0), a.c_custkey))")
def keep_max_per_key(customer):
    return R.leading(customer, ["c_nationkey", "c_mktsegment"], [F.coalesce("c_acctbal", F.lit(0)).desc(), F.col("c_custkey").desc()]).select("c_custkey")


@query("orders", sql="SELECT o_orderpriority, count(*) FILTER (WHERE quarter(o_orderdate) <= 2) AS n_before, count(*) FILTER (WHERE quarter(o_orderdate) > 2) AS n_after FROM orders GROUP BY 1")
def phase_pivot(orders):
    phase = F.when(F.quarter("o_orderdate") <= 2, "n_before").otherwise("n_after")
    out = orders.groupBy("o_orderpriority", phase.alias("phase")).agg(F.count(F.lit(1)).alias("n")).groupBy("o_orderpriority").pivot("phase", ["n_before", "n_after"]).agg(F.sum("n"))
    return out.select("o_orderpriority", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))


_SCORES = "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag))"


def _scores(lineitem: DataFrame) -> DataFrame:
    fine = lineitem.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    # the coarser set is summed from the finer one: the table is read and shuffled once
    return fine.unionByName(fine.groupBy("flag").agg(F.sum("n").alias("n")).select("flag", F.lit(None).cast("string").alias("status"), "n"))


@query("lineitem", sql=_SCORES)
def grouping_sets_score(lineitem):
    return _scores(lineitem)


@query("lineitem", sql=f"WITH s AS ({_SCORES}) SELECT a.flag, a.status, a.n AS n_a, b.n AS n_b FROM s a JOIN s b ON a.flag = b.flag AND a.status IS NOT DISTINCT FROM b.status")
def nullsafe_join(lineitem):
    a, b = _scores(lineitem).alias("a"), _scores(lineitem).alias("b")
    return a.join(b, (F.col("a.flag") == F.col("b.flag")) & F.col("a.status").eqNullSafe(F.col("b.status"))).select("a.flag", "a.status", F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))


@query("lineitem", sql=f"WITH s AS ({_SCORES}) SELECT a.flag, a.status, a.n AS n_a FROM s a JOIN s b ON a.flag = b.flag AND a.status = b.status")
def plain_join_drops_null(lineitem):
    a, b = _scores(lineitem).alias("a"), _scores(lineitem).alias("b")
    return a.join(b, (F.col("a.flag") == F.col("b.flag")) & (F.col("a.status") == F.col("b.status"))).select("a.flag", "a.status", F.col("a.n").alias("n_a"))


@query("customer", "supplier", sql="SELECT coalesce(c.k, s.k) AS k, CASE WHEN s.k IS NULL THEN 'customer' ELSE 'supplier' END AS only_in FROM (SELECT DISTINCT c_nationkey * 10 + c_custkey % 3 AS k FROM customer) c FULL JOIN (SELECT DISTINCT s_nationkey * 10 + s_suppkey % 3 AS k FROM supplier) s ON c.k = s.k WHERE c.k IS NULL OR s.k IS NULL")
def full_diff(customer, supplier):
    a = customer.select((big("c_nationkey") * 10 + F.col("c_custkey") % 3).alias("k"))
    b = supplier.select((big("s_nationkey") * 10 + F.col("s_suppkey") % 3).alias("k"))
    return R.full_diff(a, b, ["k"], "customer", "supplier")


@query("orders", sql="SELECT indicator, value FROM (SELECT CAST(count(*) AS DOUBLE) AS n_orders, round(avg(o_totalprice), 2) AS avg_total, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS n_customers, round(max(o_totalprice), 2) AS max_total FROM orders) UNPIVOT (value FOR indicator IN (n_orders, avg_total, n_customers, max_total))")
def unpivot_kpis(orders):
    one = orders.agg(F.count(F.lit(1)).alias("n_orders"), money(F.avg("o_totalprice")).alias("avg_total"), F.countDistinct("o_custkey").alias("n_customers"), money(F.max("o_totalprice")).alias("max_total"))
    return R.unpivot(one, one.columns, "indicator", "value").select("indicator", "value")


@query("lineitem", sql="SELECT l_orderkey, l_linenumber, unnest([l_partkey, l_suppkey]) AS ref FROM lineitem WHERE l_quantity >= 50")
def explode_pairs(lineitem):
    return lineitem.where("l_quantity >= 50").select("l_orderkey", "l_linenumber", F.explode(F.array("l_partkey", "l_suppkey")).alias("ref"))


@query("embeddings", sql="SELECT vec_id, CAST(i - 1 AS BIGINT) AS pos, round(CAST(x AS DOUBLE), 4) AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def explode_positions(embeddings):
    return embeddings.select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", big("pos").alias("pos"), money(F.col("x"), 4).alias("x"))


@query("orders", "lineitem", sql="SELECT min(n) AS least, round(avg(n), 4) AS mean, max(n) AS most FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)")
def cardinality_profile(orders, lineitem):
    lines = lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    per = orders.select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return per.agg(F.min("n").alias("least"), money(F.avg("n"), 4).alias("mean"), F.max("n").alias("most"))


@query("people_records", sql="SELECT lower(trim(coalesce(original_name, name))) AS name, year(source_fetched_at) AS year, count(*) AS n FROM people_records WHERE source_fetched_at IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def group_having(people):
    name = F.lower(F.trim(F.coalesce("original_name", "name")))
    return people.where("source_fetched_at is not null").groupBy(name.alias("name"), big(F.year("source_fetched_at")).alias("year")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("lineitem", "part", sql="SELECT 'quantity' AS measure, min(l_quantity) AS least, CAST(quantile_disc(l_quantity, 0.5) AS DOUBLE) AS middle, max(l_quantity) AS most FROM lineitem UNION ALL SELECT 'size', CAST(min(p_size) AS DOUBLE), CAST(quantile_disc(p_size, 0.5) AS DOUBLE), CAST(max(p_size) AS DOUBLE) FROM part")
def percentile_profile(lineitem, part):
    def one(df: DataFrame, c: str, name: str) -> DataFrame:
        # the aggregate merges counts per value below its shuffle: rows are neither sorted nor gathered
        v = F.col(c).cast("double")
        return df.agg(F.min(v).alias("least"), F.expr(f"percentile_disc(0.5) within group (order by cast({c} as double))").alias("middle"), F.max(v).alias("most")).select(F.lit(name).alias("measure"), "least", "middle", "most")

    return one(lineitem, "l_quantity", "quantity").unionByName(one(part, "p_size", "size"))


@query("orders", sql="SELECT o_custkey, bool_or(o_orderstatus = 'F') AS any_done, bool_or(o_totalprice > 300000) AS any_large FROM orders GROUP BY 1")
def bool_or_presence(orders):
    return orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("any_done"), F.bool_or(F.col("o_totalprice") > 300000).alias("any_large"))


@query("events", sql="SELECT event_type, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def distinct_on_latest(events):
    # few types, many rows: the latest row as an aggregate is merged below the shuffle
    latest = events.groupBy("event_type").agg(F.max(F.struct("ts", "event_id", "user_id")).alias("r"))
    return latest.select("event_type", "r.event_id", "r.user_id")


@query("customer", "supplier", "nation", sql="SELECT (SELECT count(*) FROM customer) + (SELECT count(s_acctbal) FROM supplier) + (SELECT count(*) FROM nation) AS population")
def scalar_sum_population(customer, supplier, nation):
    counts = customer.agg(F.count(F.lit(1)).alias("n")).unionByName(supplier.agg(F.count("s_acctbal").alias("n"))).unionByName(nation.agg(F.count(F.lit(1)).alias("n")))
    return counts.agg(F.sum("n").alias("population"))


_FILL = ("text", "lang", "source", "target_text", "target_lang", "file_id")


@query("documents", sql=" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_null, count(*) FILTER (WHERE trim({c}) = '') AS n_blank, round(100.0 * count(*) FILTER (WHERE trim({c}) <> '') / count(*), 2) AS useful_pct FROM documents" for c in _FILL))
def fill_rate_profile(documents):
    return R.fill_rates(documents, _FILL)


_COUNTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "movies")


@query(*_COUNTED, sql=" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _COUNTED))
def clean_counts(*tables):
    out = None
    for name, df in zip(_COUNTED, tables):
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("orders", sql="SELECT year(o_orderdate) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1")
def year_rollup(orders):
    return orders.groupBy(big(F.year("o_orderdate")).alias("year")).agg(F.count(F.lit(1)).alias("n"), money(F.sum("o_totalprice")).alias("total"), money(F.avg("o_totalprice")).alias("mean"))


@query("part", sql="SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n FROM part GROUP BY 1")
def case_buckets(part):
    return part.groupBy(F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("movies", sql=r"SELECT id FROM movies WHERE title ILIKE '%the pi%' ESCAPE '\' OR tagline ILIKE '%100\%%' ESCAPE '\'")
def ilike_search(movies):
    return movies.where(R.contains_text(F.col("title"), "the pi") | R.contains_text(F.col("tagline"), "100%")).select("id")


@query("part", sql="SELECT p_partkey, least(coalesce(CAST(p_size AS DOUBLE), p_retailprice), coalesce(p_retailprice, CAST(p_size AS DOUBLE))) AS smaller FROM part ORDER BY smaller, p_partkey LIMIT 10")
def topk_least(part):
    size = F.col("p_size").cast("double")
    return part.select("p_partkey", F.least(F.coalesce(size, "p_retailprice"), F.coalesce("p_retailprice", size)).alias("smaller")).orderBy("smaller", "p_partkey").limit(10)


@query("movies", sql="SELECT id, vote_count FROM movies ORDER BY vote_count DESC NULLS LAST, id LIMIT 50")
def order_nulls_last_limit(movies):
    return movies.select("id", "vote_count").orderBy(F.col("vote_count").desc_nulls_last(), "id").limit(50)


@query("part", sql="SELECT count(p_brand) AS population, count(*) FILTER (WHERE NOT regexp_full_match(p_brand, 'Brand#[0-9]+')) AS anomalies, round(count(*) FILTER (WHERE NOT regexp_full_match(p_brand, 'Brand#[0-9]+')) / count(p_brand)::DOUBLE, 6) AS rate FROM part")
def regex_validity(part):
    bad = F.count_if(~F.col("p_brand").rlike(r"^Brand#[0-9]+\z"))
    return part.agg(F.count("p_brand").alias("population"), bad.alias("anomalies"), F.round(F.try_divide(bad, F.count("p_brand")), 6).alias("rate"))


@query("movies", sql="SELECT id, 'vote_average' AS column_name FROM movies WHERE vote_average NOT BETWEEN 3 AND 8 UNION ALL SELECT id, 'runtime' FROM movies WHERE runtime NOT BETWEEN 80 AND 160 UNION ALL SELECT id, 'release_date' FROM movies WHERE release_date NOT BETWEEN DATE '1970-01-01' AND DATE '2020-12-31'")
def range_validity(movies):
    checks = {"vote_average": ~F.col("vote_average").between(3, 8), "runtime": ~F.col("runtime").between(80, 160), "release_date": ~F.col("release_date").between("1970-01-01", "2020-12-31")}
    found = F.array(*[F.when(bad, F.lit(c)) for c, bad in checks.items()])
    return movies.select("id", F.explode(F.array_compact(found)).alias("column_name"))


@query("events", sql="SELECT event_id FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')")
def domain_validity(events):
    return events.where(~F.col("event_type").isin("click", "view", "purchase")).select("event_id")


@query("people_records", sql="SELECT record_id, c AS column_name FROM (SELECT record_id, unnest(['name', 'original_name', 'known_for_department', 'profile_path']) AS c, unnest([name, original_name, known_for_department, profile_path]) AS v FROM people_records) WHERE trim(v) = '' OR v <> trim(v)")
def text_hygiene(people):
    columns = ("name", "original_name", "known_for_department", "profile_path")
    cells = R.unpivot(people.select("record_id", *columns), columns, "column_name", "v", "string")
    return cells.where("trim(v) = '' or v <> trim(v)").select("record_id", "column_name")


def _orders_split(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = orders.select("o_orderkey", "o_custkey", "o_orderstatus", money(F.col("o_totalprice")).alias("total"))
    target = rows.where(F.col("o_orderkey") % 3 != 0)
    staged = rows.where(F.col("o_orderkey") % 2 == 0).withColumn("o_orderstatus", F.lit("X"))
    return target, staged


@query("orders", sql="WITH t AS (SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS total FROM orders WHERE o_orderkey % 3 <> 0), s AS (SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, round(o_totalprice, 2) AS total FROM orders WHERE o_orderkey % 2 = 0) SELECT * FROM s UNION ALL SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s)")
def upsert_merge(orders):
    """A load merged into a table: rows of equal keys are replaced (both are made from one table)."""
    return R.merge_upsert(*_orders_split(orders), ["o_orderkey"])


@query("orders", sql="WITH t AS (SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS total FROM orders WHERE o_orderkey % 3 <> 0), s AS (SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, round(o_totalprice, 2) AS total FROM orders WHERE o_orderkey % 2 = 0) SELECT * FROM t UNION ALL SELECT * FROM s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)")
def insert_or_nothing(orders):
    return R.merge_insert(*_orders_split(orders), ["o_orderkey"])


@query("orders", "lineitem", sql="SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') OR (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_quantity < 25)")
def stale_purge(orders, lineitem):
    """Lines of reloaded orders stay only if the load still holds them; here it holds those of small quantity."""
    lines = lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    reloaded = orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    kept = R.purge_stale(lines.select("l_orderkey", "l_linenumber"), lines.where("l_quantity < 25"), reloaded, ["l_orderkey", "l_linenumber"], "l_orderkey")
    return kept


@query("nation", "customer", "supplier", sql="SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) OR n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def orphan_purge(nation, customer, supplier):
    kept = R.purge_orphans(nation, "n_nationkey", [(customer.where("c_acctbal > 9900"), "c_nationkey"), (supplier.where("s_acctbal > 5000"), "s_nationkey")])
    return kept.select("n_nationkey", "n_name")


@query("events", sql="SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_high FROM events GROUP BY 1, 2")
def history_trend(events):
    return events.groupBy(day("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("n_high"))


@query("events", sql="SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def json_props(events):
    return events.groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"), money(F.sum("value")).alias("total"))


@query("events", sql="SELECT event_type, strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS n, round(count(*) / 300.0, 6) AS per_second FROM events GROUP BY 1, 2")
def event_rate(events):
    w = events.groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "5 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "n", F.round((F.col("n") / 300.0).cast("double"), 6).alias("per_second"))


@query("movies", sql="SELECT * FROM (SELECT CASE WHEN original_language IS NULL OR trim(original_language) = '' THEN 'none' ELSE original_language END AS lang, count(*) AS n FROM movies GROUP BY 1) ORDER BY n DESC, lang LIMIT 10")
def top_languages(movies):
    lang = F.coalesce(F.when(F.trim("original_language") != "", F.col("original_language")), F.lit("none"))
    return movies.groupBy(lang.alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(10)


@query("movies", sql="SELECT split_part(poster_path, '.', 2) AS kind, count(*) AS n, sum(CASE WHEN left(poster_path, 1) = '/' THEN 1 ELSE 0 END)::BIGINT AS n_rooted FROM movies WHERE poster_path IS NOT NULL GROUP BY 1")
def split_part_left(movies):
    return movies.where("poster_path is not null").groupBy(F.split_part("poster_path", F.lit("."), F.lit(2)).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("left(poster_path, 1) = '/'")).alias("n_rooted"))


@query("genres", sql="""SELECT id, '''' || replace(name, '''', '''''') || '''' AS literal, CASE WHEN regexp_full_match(lower(name), '[a-z_][a-z0-9_]*') THEN lower(name) ELSE '"' || replace(lower(name), '"', '""') || '"' END AS identifier FROM genres""")
def quoted_names(genres):
    return genres.select("id", quoted_literal(F.col("name")).alias("literal"), quoted_identifier(F.lower("name")).alias("identifier"))
