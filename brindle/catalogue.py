"""All queries on the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import clean, normalize, text
from brindle.operators import answers, audit, frame, graph, keys, linking, profile, retrieve
from brindle.plans import dialect
from brindle.plans.ir import Plan, Step, lower
from brindle.sources import readers, schemas
from brindle.sources.boxes import Boxes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of Tables under its name, with the SQL of equal result."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


c = F.col
n = lambda: F.count(F.lit(1)).alias("n")
since = lambda day: F.expr(f"timestamp_ntz'{day}'")

# --- the flagship, as a plan of steps

REVENUE = Plan((
    Step("recent", "filter", ("orders",), {"where": "o_orderdate >= timestamp_ntz'1996-01-01'"}),
    Step("sold", "merge", ("lineitem", "recent"), {"left_on": ["l_orderkey"], "right_on": ["o_orderkey"]}),
    Step("bought", "merge", ("sold", "customer"), {"left_on": ["o_custkey"], "right_on": ["c_custkey"]}),
    Step("placed", "merge", ("bought", "nation"), {"left_on": ["c_nationkey"], "right_on": ["n_nationkey"]}),
    Step("totals", "group", ("placed",), {"keys": ["n_name"], "aggregates": {"total": ("sum", "l_extendedprice * (1 - l_discount)")}}),
    Step("rounded", "project", ("totals",), {"columns": ["n_name", "round(total, 2) AS revenue"]}),
    Step("sorted", "sort", ("rounded",), {"by": [("revenue", False), ("n_name", False)]}),
    Step("top", "head", ("sorted",), {"n": 1}),
))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation whose customers' orders since 1996 brought the most revenue."""
    t, boxes = Tables(spark, sf_dir), Boxes(spark)
    boxes.add_all({x: getattr(t, x) for x in ("lineitem", "orders", "customer", "nation")})
    return lower(REVENUE, boxes)


QUERIES["flagship"] = QUERIES["join_fk_path"] = flagship
ORACLE_SQL["flagship"] = ORACLE_SQL["join_fk_path"] = """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY n_name ORDER BY revenue DESC, n_name DESC LIMIT 1"""

# --- scans


@query("SELECT * FROM nation")
def scan_box(t):
    return t.nation


@query("SELECT * FROM customer ORDER BY c_custkey LIMIT 50")
def scan_limit(t):
    return t.customer.orderBy("c_custkey").limit(50)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def scan_kg_strings(t):
    return t.nation.select(*[c(x).cast("string").alias(x) for x in t.nation.columns])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 40 OFFSET 20")
def slice_examples(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(20).limit(40)


@query("""SELECT c_custkey AS id, CAST(r AS INTEGER) AS row_no, h AS column_name, CASE h WHEN 'name' THEN c_name WHEN 'segment' THEN c_mktsegment END AS cell
    FROM customer, (VALUES (0)) a(r), (VALUES ('name'), ('segment')) b(h)""")
def embedded_table(t):
    made = t.customer.select(c("c_custkey").alias("id"), F.to_json(F.struct(F.array(F.lit("name"), F.lit("segment")).alias("header"), F.array(F.array("c_name", "c_mktsegment")).alias("rows"))).alias("table_json"))
    return readers.embedded_table(made)


# --- projection and filters


@query("SELECT o_orderkey, o_totalprice FROM orders")
def project_cols(t):
    return t.orders.select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_eq(t):
    return t.customer.where(frame.equal(c("c_mktsegment"), "BUILDING")).select("c_custkey", "c_name")


@query("SELECT c_custkey, nullif(c_nationkey, 3) AS nation FROM customer WHERE nullif(c_nationkey, 3) IS DISTINCT FROM 5")
def filter_neq_keeps_null(t):
    return t.customer.select("c_custkey", F.nullif(c("c_nationkey"), F.lit(3)).alias("nation")).where(frame.unequal(c("nation"), 5))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def filter_between(t):
    return t.lineitem.where(c("l_quantity").between(10, 20)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_isin(t):
    return t.orders.where(c("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 300000) AND NOT o_orderpriority = '5-LOW'")
def filter_or(t):
    return t.orders.where(((c("o_orderstatus") == "F") | (c("o_totalprice") > 300000)) & ~(c("o_orderpriority") == "5-LOW")).select("o_orderkey")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%1%' OR lower(p_type) LIKE '%brass%'")
def filter_contains(t):
    return t.part.where(frame.contains(c("p_name"), "1", case=False) | frame.contains(c("p_type"), "BRASS", case=False)).select("p_partkey", "p_name")


@query("SELECT o_orderkey FROM orders WHERE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) LIKE '1996-0%'")
def filter_date_prefix(t):
    return t.orders.where(frame.startswith(F.date_format("o_orderdate", "yyyy-MM-dd"), "1996-0")).select("o_orderkey")


@query("SELECT count(*) AS n, count(nullif(c_mktsegment, 'BUILDING')) AS n_set, count(*) - count(nullif(c_mktsegment, 'BUILDING')) AS n_null FROM customer")
def null_check(t):
    v = F.nullif(c("c_mktsegment"), F.lit("BUILDING"))
    return t.customer.agg(n(), F.count_if(v.isNotNull()).alias("n_set"), F.count_if(v.isNull()).alias("n_null"))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer)) AND c_custkey <> (SELECT min(c_custkey) FROM customer)")
def same_as_excluding(t):
    least = t.customer.agg(F.min("c_custkey")).scalar()
    own = t.customer.where(c("c_custkey") == least).select("c_nationkey").scalar()
    return t.customer.where((c("c_nationkey") == own) & (c("c_custkey") != least)).select("c_custkey", "c_nationkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def scalar_subquery(t):
    return t.orders.where(c("o_totalprice") > t.orders.agg(F.avg("o_totalprice")).scalar()).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS state FROM orders")
def value_mapping(t):
    return t.orders.select("o_orderkey", F.when(c("o_orderstatus") == "F", "final").when(c("o_orderstatus") == "O", "open").otherwise("other").alias("state"))


# --- joins


@query("SELECT a.c_custkey, s_suppkey FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) a JOIN (SELECT s_suppkey, nullif(s_nationkey, 3) AS j FROM supplier) b ON k IS NOT DISTINCT FROM j")
def join_inner(t):
    a = t.customer.select("c_custkey", F.nullif(c("c_nationkey"), F.lit(3)).alias("k"))
    b = t.supplier.select("s_suppkey", F.nullif(c("s_nationkey"), F.lit(3)).alias("j"))
    return frame.merge(a, b, ["k"], ["j"], many=True).select("c_custkey", "s_suppkey")


@query("SELECT n_nationkey AS key, n_name AS name_x, r_name AS name_y FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_suffixes(t):
    a = t.nation.select(c("n_nationkey").alias("key"), c("n_name").alias("name"), c("n_regionkey").alias("region"))
    b = t.region.select(c("r_regionkey").alias("region"), c("r_name").alias("name"))
    return frame.merge(a, b, ["region"], ["region"]).select("key", "name_x", "name_y")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON CAST(c_nationkey AS VARCHAR) = CAST(n_nationkey AS VARCHAR)")
def join_cast_keys(t):
    a = t.customer.select("c_custkey", c("c_nationkey").cast("string").alias("k"))
    b = t.nation.select("n_name", c("n_nationkey").cast("string").alias("k"))
    return frame.merge(a, b, ["k"], ["k"]).select("c_custkey", "n_name")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_left(t):
    return t.customer.join(t.orders, c("c_custkey") == c("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(t):
    return t.customer.join(t.orders, c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(t):
    return t.customer.join(t.orders.where(c("o_totalprice") > 300000), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT n_name, r_name FROM nation JOIN region ON trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(replace(n_name, ' ', '_')), '[^a-z0-9]+', ' ', 'g')) AND n_regionkey = r_regionkey")
def multi_source_join(t):
    boxes = Boxes(t.spark)
    boxes.add("nation", t.nation.select(text.surface(c("n_name")).alias("form"), "n_name", "n_regionkey"), "db_")
    boxes.add("names", t.nation.join(t.region, c("n_regionkey") == c("r_regionkey")).select(text.surface(F.replace(c("n_name"), F.lit(" "), F.lit("_"))).alias("form"), "r_name"), "csv_")
    return frame.merge(boxes["db_nation"], boxes["csv_names"], ["form"], ["form"]).select("n_name", "r_name")


@query("SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING'")
def values_coexist(t):
    return t.orders.where(c("o_orderstatus") == "F").join(t.customer.where(c("c_mktsegment") == "BUILDING"), c("o_custkey") == c("c_custkey")).agg(n())


@query("""WITH named AS (SELECT a.n_nationkey AS id, b.n_name AS n_name, 1.0 / (1 + abs(a.n_nationkey - b.n_nationkey)) AS s FROM nation a JOIN nation b ON length(a.n_name) = length(b.n_name)),
    placed AS (SELECT n_nationkey AS id, r_name, CASE WHEN n_regionkey = r_regionkey THEN 0.0 ELSE 1.0 END AS s FROM nation, region),
    met AS (SELECT id, n_name, r_name, max(named.s + placed.s) AS s FROM nation JOIN region ON n_regionkey = r_regionkey JOIN named USING (n_name) JOIN placed USING (id, r_name) GROUP BY ALL)
    SELECT id, n_name, r_name, CAST(round(s, 4) AS DOUBLE) AS similarity FROM met QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, n_name, r_name) = 1""")
def values_together(t):
    a = t.nation.select(c("n_nationkey").alias("id"), F.length("n_name").alias("size"), c("n_regionkey").alias("region"))
    b = t.nation.select(c("n_nationkey").alias("k"), c("n_name").alias("value"), F.length("n_name").alias("size"))
    named = a.join(b, "size").select("id", "value", (F.lit(1.0) / (1 + F.abs(c("id") - c("k")))).alias("similarity"))
    every = t.region.agg(F.collect_list(F.struct("r_regionkey", "r_name")).alias("all"))
    placed = a.join(every, F.lit(True)).select("id", "region", F.inline("all")).select("id", c("r_name").alias("value"), F.when(c("region") == c("r_regionkey"), 0.0).otherwise(1.0).alias("similarity"))
    rows = t.nation.join(t.region, c("n_regionkey") == c("r_regionkey"))
    return linking.coexisting({"n_name": named, "r_name": placed}, rows)


# --- aggregation


@query("SELECT count(*) AS n FROM lineitem")
def count_rows(t):
    return t.lineitem.agg(n())


@query("SELECT count(DISTINCT l_suppkey) AS n FROM lineitem")
def count_distinct(t):
    return t.lineitem.agg(F.count_distinct("l_suppkey").alias("n"))


@query("SELECT round(sum(l_quantity), 4) AS total, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS low, max(l_quantity) AS high, count(l_quantity) AS n FROM lineitem")
def agg_scalar(t):
    q = c("l_quantity")
    return t.lineitem.agg(F.round(frame.total(q), 4).alias("total"), F.round(F.avg(q), 6).alias("mean"), F.min(q).alias("low"), F.max(q).alias("high"), F.count(q).alias("n"))


@query("SELECT coalesce(sum(l_quantity), 0) AS total, avg(l_quantity) AS mean FROM lineitem WHERE l_quantity < 0")
def agg_empty(t):
    return t.lineitem.where(c("l_quantity") < 0).agg(frame.total(c("l_quantity")).alias("total"), F.avg("l_quantity").alias("mean"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS total, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_agg(t):
    return frame.group(t.lineitem, ["l_returnflag", "l_linestatus"], total=F.round(F.sum("l_quantity"), 4), n=F.count(F.lit(1)))


@query("SELECT k, count(*) AS n FROM (SELECT nullif(c_nationkey, 3) AS k FROM customer) WHERE k IS NOT NULL GROUP BY k")
def group_drops_null(t):
    return frame.group(t.customer.select(F.nullif(c("c_nationkey"), F.lit(3)).alias("k")), ["k"], n=F.count(F.lit(1)))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def group_having(t):
    return frame.group(t.orders, ["o_custkey"], n=F.count(F.lit(1))).where("n > 12")


@query("SELECT l_shipyear, count(*) FILTER (l_returnflag = 'R') AS n_returned, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END), 4) AS open_quantity FROM (SELECT *, CAST(year(l_shipdate) AS INTEGER) AS l_shipyear FROM lineitem) GROUP BY l_shipyear")
def cond_agg(t):
    return t.lineitem.groupBy(F.year("l_shipdate").alias("l_shipyear")).agg(F.count_if(c("l_returnflag") == "R").alias("n_returned"), F.round(F.sum(F.when(c("l_linestatus") == "O", c("l_quantity")).otherwise(0)), 4).alias("open_quantity"))


@query("SELECT round(count(*) FILTER (o_orderstatus = 'F') * 100.0 / count(*), 6) AS share FROM orders")
def percentage(t):
    return t.orders.agg(F.round(F.count_if(c("o_orderstatus") == "F") * F.lit(100.0) / F.count(F.lit(1)), 6).alias("share"))


@query("SELECT c_mktsegment, count(DISTINCT c_custkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 200000 GROUP BY c_mktsegment")
def inflation_safe_count(t):
    buyers = t.orders.where(c("o_totalprice") > 200000).select("o_custkey").distinct()
    return t.customer.join(buyers, c("c_custkey") == c("o_custkey"), "left_semi").groupBy("c_mktsegment").agg(n())


def _profile_sql(table: str, *columns: str) -> str:
    one = "SELECT '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_values, count(DISTINCT {c}) AS n_distinct, round(1 - count({c}) / count(*), 4) AS null_ratio, CASE WHEN 1 - count({c}) / count(*) > 0.5 THEN 'HIGH-NULL' ELSE '' END AS flag FROM {t}"
    return " UNION ALL ".join(one.format(c=x, t=table) for x in columns)


@query(_profile_sql("customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
def profile_columns(t):
    return profile.profile(t.customer)


@query("""SELECT 'day' AS column_name, 'DATE' AS flags UNION ALL SELECT 'id', 'ID' UNION ALL SELECT 'at', 'TIME' UNION ALL SELECT 'o_orderkey', ''
    UNION ALL SELECT 'rare', CASE WHEN count(*) FILTER (o_orderstatus = 'P') < count(*) * 0.5 THEN 'HIGH-NULL' ELSE '' END FROM orders""")
def profile_flags(t):
    made = t.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.concat(F.lit("m."), c("o_orderkey").cast("string")).alias("id"), F.date_format("o_orderdate", "HH:mm:ss").alias("at"), "o_orderkey", F.when(c("o_orderstatus") == "P", c("o_custkey")).alias("rare"))
    return profile.flagged(made)


@query("""WITH cells AS (SELECT 'o_orderstatus' AS column_name, o_orderstatus AS cell FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders)
    SELECT column_name, cell, count(*) AS n, row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, cell) AS place FROM cells WHERE cell IS NOT NULL GROUP BY column_name, cell QUALIFY place <= 5""")
def profile_top_values(t):
    return profile.top_values(t.orders.select("o_orderstatus", "o_orderpriority", "o_custkey"))


@query("""SELECT 'd' AS column_name, 'date' AS pattern UNION ALL SELECT 'k', NULL UNION ALL SELECT 'i', 'freebase_id'""")
def value_patterns(t):
    made = t.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), c("o_orderkey").cast("string").alias("k"), F.concat(F.lit("m."), c("o_orderkey").cast("string")).alias("i"))
    return profile.cells(made, "").groupBy("column_name").agg(profile.pattern(c("cell")).alias("pattern"))


@query("SELECT count(*) AS n_examples, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 4) AS em, count(*) FILTER (quality = 1) AS n_success, round(avg(doc_id), 4) AS avg_time FROM labels")
def run_metrics(t):
    return t.labels.agg(F.count(F.lit(1)).alias("n_examples"), F.round(F.avg(F.when(c("quality") == c("toxic"), 1.0).otherwise(0.0)), 4).alias("em"), F.count_if(c("quality") == 1).alias("n_success"), F.round(F.avg("doc_id"), 4).alias("avg_time"))


@query("SELECT event_type AS stage, count(*) AS calls, round(sum(value), 4) AS total, round(max(value), 4) AS longest FROM events GROUP BY event_type")
def stage_profile(t):
    return t.events.groupBy(c("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 4).alias("longest"))


_VOTES = "(SELECT conv_id AS example_id, turn AS vote_id, CASE WHEN length(text) % 7 = 0 THEN NULL ELSE role END AS hash FROM conversations)"


def _votes(t):
    return t.conversations.select(c("conv_id").alias("example_id"), c("turn").alias("vote_id"), F.when(F.length("text") % 7 != 0, c("role")).alias("hash"))


@query(f"""SELECT example_id, vote_id, CASE WHEN hash IS NULL THEN 0 ELSE n END AS vote_count, CAST(total AS BIGINT) AS total_votes FROM (
    SELECT *, sum(n) OVER (PARTITION BY example_id) AS total, row_number() OVER (PARTITION BY example_id ORDER BY hash IS NULL, n DESC, hash) AS r
    FROM (SELECT example_id, hash, count(*) AS n, min(vote_id) AS vote_id FROM {_VOTES} GROUP BY example_id, hash)) WHERE r = 1""")
def majority_vote(t):
    return answers.vote(_votes(t))


@query(f"""SELECT example_id, CASE WHEN hash IS NULL THEN 'failed' ELSE 'vote_' || CAST(v AS VARCHAR) END AS label, round(n * 100.0 / sum(n) OVER (PARTITION BY example_id), 4) AS percentage
    FROM (SELECT example_id, hash, count(*) AS n, min(vote_id) AS v FROM {_VOTES} GROUP BY example_id, hash)""")
def vote_distribution(t):
    return answers.vote_shares(_votes(t))


# --- windows, order, limits, duplicates


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def window_rank(t):
    return t.orders.select("o_orderkey", F.rank().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("bigint").alias("place"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def window_running_sum(t):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, 0)
    return t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"))


@query("SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer ORDER BY k DESC NULLS LAST, c_custkey LIMIT 1400")
def sort_nulls_last(t):
    return frame.ordered(t.customer.select("c_custkey", F.nullif(c("c_nationkey"), F.lit(3)).alias("k")), ("k", False), ("c_custkey", True)).limit(1400)


@query("SELECT c_custkey, k, row_number() OVER (ORDER BY k DESC NULLS LAST, c_custkey) AS place FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) ORDER BY place")
def sort_nulls_last_whole(t):
    """Every row and its place: rows are numbered within a key, after those of the keys before it."""
    rows = t.customer.select("c_custkey", F.nullif(c("c_nationkey"), F.lit(3)).alias("k"))
    before = W.orderBy(F.desc_nulls_last("_k")).rowsBetween(W.unboundedPreceding, -1)
    keys_ = rows.groupBy(c("k").alias("_k")).agg(n()).select("_k", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    placed = rows.join(keys_, c("k").eqNullSafe(c("_k"))).withColumn("place", c("_before") + F.row_number().over(W.partitionBy("k").orderBy("c_custkey")))
    return frame.ordered(placed.select("c_custkey", "k", "place"), ("k", False), ("c_custkey", True))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(t):
    return frame.largest(t.orders.select("o_orderkey", "o_totalprice"), 10, "o_totalprice", ["o_orderkey"])


@query("SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ORDER BY n DESC, o_custkey LIMIT 5")
def topk_grouped(t):
    return frame.largest(frame.group(t.orders, ["o_custkey"], n=F.count(F.lit(1))), 5, "n", ["o_custkey"])


@query("SELECT c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_name DESC LIMIT 1")
def superlative_one(t):
    return frame.ordered(t.customer.select("c_name", "c_acctbal"), ("c_acctbal", False), ("c_name", False)).limit(1)


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def argmax_row(t):
    return frame.first_of(t.orders, ["o_custkey"], [F.desc("o_totalprice"), c("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1")
def dedupe_first(t):
    return frame.first_of(t.events, ["user_id"], [c("event_id")]).select("user_id", "event_id")


@query("SELECT DISTINCT c_name FROM customer WHERE c_name IS NOT NULL ORDER BY c_name LIMIT 5000")
def distinct_values(t):
    return t.customer.select("c_name").where("c_name IS NOT NULL").distinct().orderBy("c_name").limit(5000)


# --- sets


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return t.customer.select(c("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersect_rows(t):
    return t.customer.select(c("c_custkey").alias("k")).intersect(t.orders.select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_rows(t):
    return t.customer.select(c("c_custkey").alias("k")).subtract(t.orders.select("o_custkey"))


@query("""SELECT DISTINCT s, p, o FROM (SELECT * FROM (SELECT c_name AS s, 'in' AS p, CAST(c_nationkey AS VARCHAR) AS o FROM customer ORDER BY c_name LIMIT 3)
    UNION ALL (SELECT c_name, 'in', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_nationkey = 7 ORDER BY c_name LIMIT 2))""")
def entity_sample(t):
    rows = t.customer.select(c("c_name").alias("s"), F.lit("in").alias("p"), c("c_nationkey").cast("string").alias("o"))
    return rows.orderBy("s").limit(3).unionByName(rows.where("o = '7'").orderBy("s").limit(2)).distinct()


@query("""SELECT table_name, column_name, cell FROM (
    SELECT 'nation' AS table_name, 'n_nationkey' AS column_name, CAST(n_nationkey AS VARCHAR) AS cell FROM nation UNION SELECT 'nation', 'n_name', n_name FROM nation UNION SELECT 'nation', 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation
    UNION SELECT 'region', 'r_regionkey', CAST(r_regionkey AS VARCHAR) FROM region UNION SELECT 'region', 'r_name', r_name FROM region)""")
def unpivot_distinct(t):
    return profile.distinct_cells({"nation": t.nation, "region": t.region})


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def drop_null_columns(t):
    return frame.without_null_columns(t.orders.select("o_orderkey", F.lit(None).cast("string").alias("nothing"), "o_orderstatus"))


# --- schema, keys, linking

FOREIGN = [("nation", "region"), ("customer", "nation"), ("supplier", "nation"), ("orders", "customer"), ("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier")]


@query("SELECT * FROM (VALUES ('student', 'id', 'primary'), ('class', 'id', 'primary'), ('takes', 'student_id,class_id', 'primary')) v(table_name, column_names, kind)")
def keys_from_metadata(t):
    rows = [(["student", "class", "takes"], [(-1, "*"), (0, "id"), (0, "class_id"), (1, "id"), (2, "student_id"), (2, "class_id")], [[1], [3], [4, 5]])]
    return keys.keys(t.spark.createDataFrame(rows, "table_names array<string>, column_names array<struct<table:int,name:string>>, primary_keys array<array<int>>"))


@query("SELECT * FROM (VALUES ('nation', 'region'), ('customer', 'nation')) v(from_table, to_table)")
def prune_tables(t):
    fks = t.spark.createDataFrame(FOREIGN, "from_table string, to_table string")
    return keys.pruned(fks, t.spark.createDataFrame([("nation",), ("region",), ("customer",)], "table_name string"))


@query("SELECT table_name, n FROM (SELECT 'nation' AS table_name, count(*) AS n FROM nation UNION ALL SELECT 'none', count(*) FROM nation WHERE n_nationkey < 0 UNION ALL SELECT 'region', count(*) FROM region) WHERE n > 0")
def prune_empty(t):
    count = lambda name, df: df.agg(n()).select(F.lit(name).alias("table_name"), "n")
    return graph.union([count("nation", t.nation), count("none", t.nation.where("n_nationkey < 0")), count("region", t.region)]).where("n > 0")


@query("SELECT DISTINCT lower(split_part(path, '.', 1)) AS table_name FROM (VALUES ('Orders.o_orderkey'), ('orders'), ('Customer.c_name')) v(path)")
def linked_tables(t):
    return keys.linked_tables(t.spark.createDataFrame([("Orders.o_orderkey",), ("orders",), ("Customer.c_name",)], "path string"))


@query("SELECT * FROM (VALUES ('nation'), ('supplier')) v(table_name)")
def bridge_tables(t):
    a = keys.bridges(t.spark, FOREIGN, ["customer", "region"])
    return a.union(keys.bridges(t.spark, FOREIGN, ["lineitem", "nation"])).distinct()


def _cells(t):
    return profile.distinct_cells({"nation": t.nation, "customer": t.customer.select("c_name", "c_mktsegment"), "part": t.part.select("p_name", "p_brand", "p_type")})


_CELLS = """(SELECT 'nation' AS table_name, 'n_name' AS column_name, n_name AS cell FROM nation UNION SELECT 'nation', 'n_nationkey', CAST(n_nationkey AS VARCHAR) FROM nation UNION SELECT 'nation', 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation
    UNION SELECT 'customer', 'c_name', c_name FROM customer UNION SELECT 'customer', 'c_mktsegment', c_mktsegment FROM customer
    UNION SELECT 'part', 'p_name', p_name FROM part UNION SELECT 'part', 'p_brand', p_brand FROM part UNION SELECT 'part', 'p_type', p_type FROM part)"""


@query(f"""SELECT value, table_name, column_name, trim(cell) AS matched_value, CAST(1.0 AS DOUBLE) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY value ORDER BY table_name, column_name, cell) AS r FROM {_CELLS} JOIN (VALUES ('nation_3 '), ('building'), ('NATION_19'), ('nowhere')) v(value) ON lower(trim(cell)) = lower(trim(value))) WHERE r = 1""")
def value_resolve_exact(t):
    values = t.spark.createDataFrame([("nation_3 ",), ("building",), ("NATION_19",), ("nowhere",), ("12",)], "value string")
    return linking.resolve_exact(values, _cells(t))


@query()
def value_resolve_fuzzy(t):
    values = t.spark.createDataFrame([("nation 3",), ("buildings",), ("NATION_019",), ("Custmer#00000012",)], "value string")
    return linking.resolve_fuzzy(values, _cells(t))


_NAMES = "(SELECT DISTINCT c_name AS db_value FROM customer)"


def _names(t):
    return t.customer.select(c("c_name").alias("db_value")).distinct()


@query(f"""SELECT value, db_value AS corrected, round(CAST(length(value) AS DOUBLE) / length(db_value), 3) AS similarity FROM (
    SELECT *, row_number() OVER (PARTITION BY value ORDER BY CAST(length(value) AS DOUBLE) / length(db_value) DESC, db_value DESC) AS r FROM {_NAMES} JOIN (VALUES ('0012'), ('mer'), ('x1')) v(value) ON contains(db_value, value) AND length(value) >= 3) WHERE r = 1""")
def correct_substring(t):
    return linking.correct_substring(t.spark.createDataFrame([("0012",), ("mer",), ("x1",)], "value string"), _names(t))


@query("SELECT 'building' AS value, c_mktsegment AS corrected FROM customer WHERE lower(c_mktsegment) = 'building' GROUP BY c_mktsegment")
def correct_casefold(t):
    return linking.correct_casefold(t.spark.createDataFrame([("building",), ("none",)], "value string"), t.customer.select(c("c_mktsegment").alias("db_value")).distinct())


@query("SELECT 'small fine tin box' AS value, 'tin box small' AS corrected, CAST(0.75 AS DOUBLE) AS score")
def correct_token_overlap(t):
    column = t.spark.createDataFrame([("tin box small",), ("a tin",), ("fine",), ("large steel box",)], "db_value string")
    return linking.correct_tokens(t.spark.createDataFrame([("small fine tin box",), ("one",)], "value string"), column)


@query()
def correct_by_priority(t):
    """Mistyped names of customers and segments against all of them."""
    column = _names(t).union(t.customer.select("c_mktsegment").distinct())
    hints = t.spark.createDataFrame([(0, "MACHINERY"), (1, "FURNITURE")], "place int, hint string")
    values = t.spark.createDataFrame([("0012",), ("FURNITUR E",), ("Custmer#000000012",), ("building",), ("AUTOMOBLE",), ("nowhere",)], "value string")
    return linking.correct(values, column, hints)


@query(f"""SELECT value, n_matched, n_parts FROM (SELECT 'Customer 00012' AS value, max(CAST(contains(lower(db_value), 'customer') AS BIGINT) + CAST(contains(lower(db_value), '00012') AS BIGINT)) AS n_matched, CAST(2 AS BIGINT) AS n_parts FROM {_NAMES}) WHERE n_matched >= 1""")
def correct_to_contains(t):
    return linking.contains_instead(t.spark.createDataFrame([("Customer 00012",), ("ab cd",)], "value string"), _names(t))


@query("""SELECT 'nation.n_name' AS left_column, 'copy.name' AS right_column, count(DISTINCT f) AS n_common, min(f) AS example FROM (SELECT trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS f FROM nation)""")
def link_exact(t):
    a = profile.cells(t.nation.select("n_name"), "nation").withColumn("source_id", F.lit(1))
    b = profile.cells(t.nation.select(F.replace(c("n_name"), F.lit("_"), F.lit("-")).alias("name")), "copy").withColumn("source_id", F.lit(2))
    return linking.link_exact(a.unionByName(b))


@query()
def link_fuzzy(t):
    form = lambda x: t.customer.select(text.surface(x).alias("form"))
    return linking.link_fuzzy(t.nation.select(text.surface(c("n_name")).alias("form")), t.nation.select(text.surface(F.concat(c("n_name"), F.lit("s"))).alias("form")).union(form(c("c_mktsegment"))))


# --- text


def _strings(t, *values):
    return t.spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string")


def _values(*values) -> str:
    return "(VALUES " + ", ".join("({}, {})".format(i, "NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values)) + ") v(id, v)"


@query("SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')) AS form FROM documents")
def surface_normalize(t):
    return t.documents.select("doc_id", text.surface(c("text")).alias("form"))


_IDENT = ("people/person", "4.h club", ".a.b.", "x y-z", "")


@query("SELECT id, CASE WHEN regexp_matches(s, '^([0-9]|$)') THEN 'box_' || s ELSE s END AS name FROM (SELECT id, replace(regexp_replace(regexp_replace(replace(trim(v), '/', '.'), '^\\.+|\\.+$', '', 'g'), '[^A-Za-z0-9_.]+', '_', 'g'), '.', '_') AS s FROM " + _values(*_IDENT) + ")")
def sanitize_ident(t):
    return _strings(t, *_IDENT).select("id", text.identifier(c("v")).alias("name"))


@query("SELECT p_partkey AS id, CAST(CASE p_size % 6 WHEN 0 THEN CAST(p_retailprice AS DECIMAL(18,2)) WHEN 1 THEN p_size * 1000000 WHEN 2 THEN p_size / 100 WHEN 4 THEN p_size END AS DOUBLE) AS number FROM part")
def clean_numeric(t):
    """Prices with a sign and commas, millions, shares, times (no numbers), signs, and text without digits."""
    size, price = c("p_size").cast("string"), F.format_number(c("p_retailprice").cast("decimal(18,2)"), 2)
    forms = [F.concat(F.lit("$"), price), F.concat(size, F.lit(" million")), F.concat(size, F.lit("%")), F.concat(size, F.lit(":30")), F.concat(F.lit("-"), size), F.lit("not stated")]
    cell = reduce(lambda rest, i: F.when(c("p_size") % 6 == i, forms[i]).otherwise(rest), range(5), forms[5])
    return t.part.select(c("p_partkey").alias("id"), F.round(clean.number(cell), 6).alias("number"))


_DATES = {"January 5, 2014": "2014-01-05", "Jan 5 2014": "2014-01-05", "5 January 2014": "2014-01-05", "2014-01-05": None, "October 5": "XXXX-10-05", "soon": None, "Dec 31": "XXXX-12-31"}


@query("SELECT * FROM " + _values(*_DATES.values()).replace("v(id, v)", "v(id, day)"))
def clean_date(t):
    return _strings(t, *_DATES).select("id", clean.date(c("v")).alias("day"))


_TIMES = {"0:00": 0.0, "5:30": 330.0, "1:30:45": 5445.0, "5h 29' 10\"": 19750.0, "5:19.35": None, "x": None}


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {'NULL' if v is None else f'CAST({v!r} AS DOUBLE)'})" for i, v in enumerate(_TIMES.values())) + ") v(id, seconds)")
def clean_time(t):
    return _strings(t, *_TIMES).select("id", clean.seconds(c("v")).alias("seconds"))


@query("SELECT * FROM (VALUES ('day', 'mixed'), ('named_day', 'date'), ('price', 'numeric'), ('name', 'mixed'), ('nothing', 'unknown')) v(column_name, kind)")
def detect_column_type(t):
    d = t.orders.orderBy("o_orderkey").limit(10)
    made = d.select(F.date_format("o_orderdate", "'d'").alias("day"), F.date_format("o_orderdate", "MMMM d, yyyy").alias("named_day"), c("o_totalprice").cast("string").alias("price"), F.lit("abc").alias("name"), F.lit(None).cast("string").alias("nothing"))
    kinds = profile.cells(made, "").groupBy("column_name").agg(F.collect_list(clean.cell_kind(c("cell"))).alias("kinds"), F.count("cell").alias("total"))
    return kinds.select("column_name", clean.column_kind(c("kinds"), c("total")).alias("kind"))


_PLAIN = ("12", " 3.5 ", "1d", "1e3", "abc", "", None, "-7")


@query("SELECT id, CASE WHEN regexp_matches(trim(v), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN CAST(trim(v) AS DOUBLE) END AS number FROM " + _values(*_PLAIN))
def to_numeric(t):
    return _strings(t, *_PLAIN).select("id", clean.to_numeric(c("v")).alias("number"))


@query("SELECT * FROM (VALUES (0, TIMESTAMP '1996-02-03'), (1, NULL), (2, NULL)) v(id, stamp)")
def to_datetime(t):
    return _strings(t, "1996-02-03", "03.02.1996", None).select("id", clean.to_datetime(c("v")).alias("stamp"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, strftime(o_orderdate, '%Y-%m') AS month, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 2440587.5 AS DOUBLE) AS julian FROM orders")
def date_parts(t):
    return dialect.query(_view(t.orders, "orders"), "SELECT o_orderkey, year(o_orderdate) AS year, STRFTIME('%Y-%m', o_orderdate) AS month, CAST(JULIANDAY(o_orderdate) AS DOUBLE) AS julian FROM orders")


def _view(df: DataFrame, name: str) -> SparkSession:
    df.createOrReplaceTempView(name)
    return df.sparkSession


@query("SELECT c_custkey, replace(c_name, '#', '') AS plain, ltrim(substr(c_name, 10), '0') AS number FROM customer")
def string_clean(t):
    return t.customer.select("c_custkey", F.replace(c("c_name"), F.lit("#"), F.lit("")).alias("plain"), F.ltrim(F.substring("c_name", 10, 100), F.lit("0")).alias("number"))


_STAMPS = {"2011-02-15 15:22:25.0": "2011-02-15 15:22:25", "2010-07-19T19:16:14.0": "2010-07-19 19:16:14", "1983-02-07T00:00:00": "1983-02-07", "1983-02-07 00:00:00": "1983-02-07", "2010-07-19 19:16:14": "2010-07-19 19:16:14", "x": "x"}


@query("SELECT * FROM " + _values(*_STAMPS.values()).replace("v(id, v)", "v(id, stamp)"))
def normalize_datetime(t):
    return _strings(t, *_STAMPS).select("id", normalize.datetime_string(c("v")).alias("stamp"))


@query("SELECT * FROM (VALUES (0, '507', '507', '507', '507'), (1, '3.1', '3.1', '3.1', '3.1'), (2, 'Abc', 'Abc', 'abc', 'abc'), (3, '', NULL, '', ''), (4, '$1,200', '$1,200', '1200', '$1,200')) v(id, by_rows, by_sets, by_table, by_graph)")
def normalize_values(t):
    return _strings(t, "507.0", "3.10", " Abc ", None, "$1,200").select("id", *[normalize.value(c("v"), p).alias(f"by_{p}") for p in normalize.PROFILES])


@query("SELECT doc_id, CAST(length(text) // 3 + 1 AS BIGINT) AS tokens FROM documents")
def token_estimate(t):
    return t.documents.select("doc_id", text.token_estimate(c("text")).alias("tokens"))


_FREE = ('```json\n{"a": 1}\n```', 'so {"a": 2} it is', "none", None)


@query("SELECT * FROM (VALUES (0, '1'), (1, '2'), (2, NULL), (3, NULL)) v(id, a)")
def json_extract(t):
    return _strings(t, *_FREE).select("id", F.get_json_object(text.json_object(c("v")), "$.a").alias("a"))


@query("SELECT * FROM (VALUES (0, 'a|b'), (1, 'x|y'), (2, '7')) v(id, items)")
def parse_answer(t):
    return _strings(t, '["a", "b"]', "x, y,", "7").select("id", F.array_join(text.answer_items(c("v")), "|").alias("items"))


_CODE = ("SELECT SUM(CASE WHEN a THEN 1 END) FROM t", "df.merge(a).merge(b).merge(c)", "SELECT a FROM t JOIN u WHERE x BETWEEN 1 AND 2", "print(1)", "df[df.a.isna()].sort_values('b').head(3)")


@query("SELECT * FROM (VALUES (0, 'conditional_agg'), (1, 'multi_join'), (2, 'between,join'), (3, 'basic'), (4, 'null_check,order_limit')) v(id, labels)")
def pattern_classify(t):
    return _strings(t, *_CODE).select("id", F.array_join(text.pattern_labels(c("v")), ",").alias("labels"))


@query("SELECT * FROM (VALUES (0, '2011-02-15'), (1, 'at 15:22:25'), (2, '507'), (3, 'x')) v(id, answer)")
def answer_postprocess(t):
    return _strings(t, "2011-02-15T00:00:00", "at 15:22:25.0", "507.0", "x").select("id", normalize.answer(c("v")).alias("answer"))


# --- graph


def _triples(t):
    customers = graph.triples_of(t.customer, c("c_name"), {"in_nation": F.concat(F.lit("m.n"), c("c_nationkey").cast("string")), "segment": c("c_mktsegment"), "type": F.lit("customer")})
    nations = graph.triples_of(t.nation, F.concat(F.lit("m.n"), c("n_nationkey").cast("string")), {"in_region": F.concat(F.lit("m.r"), c("n_regionkey").cast("string")), "type": F.lit("nation")})
    return customers.unionByName(nations)


_TRIPLES = """(SELECT c_name AS s, 'in_nation' AS p, 'm.n' || CAST(c_nationkey AS VARCHAR) AS o FROM customer UNION ALL SELECT c_name, 'segment', c_mktsegment FROM customer UNION ALL SELECT c_name, 'type', 'customer' FROM customer
    UNION ALL SELECT 'm.n' || CAST(n_nationkey AS VARCHAR), 'in_region', 'm.r' || CAST(n_regionkey AS VARCHAR) FROM nation UNION ALL SELECT 'm.n' || CAST(n_nationkey AS VARCHAR), 'type', 'nation' FROM nation)"""


@query(f"SELECT s, p, o FROM {_TRIPLES}")
def kg_triples(t):
    return _triples(t)


@query(f"SELECT DISTINCT s AS entity, o AS entity_type FROM {_TRIPLES} WHERE lower(p) = 'type'")
def kg_types(t):
    return graph.types(_triples(t))


@query(f"""WITH e AS (SELECT DISTINCT * FROM {_TRIPLES} WHERE p IN ('in_nation', 'in_region')), n0 AS (SELECT 'm.r1' AS node),
    n1 AS (SELECT node FROM n0 UNION SELECT s FROM e JOIN n0 ON o = node UNION SELECT o FROM e JOIN n0 ON s = node)
    SELECT DISTINCT s, p, o FROM e WHERE s IN (SELECT node FROM n1) OR o IN (SELECT node FROM n1)""")
def kg_subgraph(t):
    return graph.subgraph(_triples(t), t.spark.createDataFrame([("m.r1",)], "node string"), ["in_nation", "in_region"], 2)


@query(f"SELECT DISTINCT s AS customer, CASE WHEN p = 'in_nation' THEN o END AS in_nation, CASE WHEN p = 'segment' THEN o END AS segment FROM {_TRIPLES} WHERE p IN ('in_nation', 'segment')")
def kg_sparse_box(t):
    triples = _triples(t)
    own = graph.typed(triples.where(~graph.is_type(c("p"))), graph.types(triples))
    return graph.sparse_box(own, "customer", "customer", ["in_nation", "segment"])


@query("SELECT 'customer-in_nation' AS left_column, 'nation-nation' AS right_column")
def kg_infer_fks(t):
    triples = _triples(t)
    own = graph.typed(triples.where(~graph.is_type(c("p"))), graph.types(triples))
    return graph.inferred_keys({"customer": graph.sparse_box(own, "customer", "customer", ["in_nation", "segment"]), "nation": graph.sparse_box(own, "nation", "nation", ["in_region"])})


@query("""SELECT c_name AS start, 'm.n' || CAST(c_nationkey AS VARCHAR) AS middle, 'm.r' || CAST(n_regionkey AS VARCHAR) AS "end" FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def kg_cvt_join(t):
    return graph.two_hops(_triples(t), "in_nation", "in_region")


@query("SELECT c_name AS s, coalesce(n_name, 'm.n' || CAST(c_nationkey AS VARCHAR)) AS o FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def kg_id_to_name(t):
    names = t.nation.select(F.concat(F.lit("m.n"), c("n_nationkey").cast("string")).alias("id"), c("n_name").alias("name"), c("n_nationkey").alias("pos"))
    return graph.id_to_name(_triples(t).where("p = 'in_nation'").select("s", "o"), "o", names)


@query("SELECT o_orderkey, 'bought by ' || coalesce(c_name, 'm.c' || o_custkey) || ', not xm.c' || o_custkey || ' or g.o' || o_orderkey || '.' AS v FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey")
def kg_names_in_text(t):
    names = t.customer.where(c("c_mktsegment") == "BUILDING").select(F.concat(F.lit("m.c"), c("c_custkey").cast("string")).alias("id"), c("c_name").alias("name"), c("c_custkey").alias("pos"))
    customer, key = c("o_custkey").cast("string"), c("o_orderkey").cast("string")
    texts = t.orders.select("o_orderkey", F.concat(F.lit("bought by m.c"), customer, F.lit(", not xm.c"), customer, F.lit(" or g.o"), key, F.lit(".")).alias("v"))
    return graph.names_in_text(texts, ["o_orderkey"], "v", names)


@query("SELECT * FROM (VALUES ('in_nation', CAST(25 AS BIGINT), CAST(25 AS BIGINT), CAST(25 AS BIGINT), true), ('name', CAST(50 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false)) v(column_name, n, n_ids, n_unknown, is_cvt)")
def profile_kg_cvt(t):
    df = t.customer.select(c("c_name").alias("name"), F.concat(F.lit("m.n"), c("c_nationkey").cast("string")).alias("in_nation"))
    return profile.cvt_columns(df, t.region.select(F.concat(F.lit("m.r"), c("r_regionkey").cast("string")).alias("id")))


@query("SELECT n_name FROM nation WHERE n_nationkey IN (3, 7)")
def entity_filter(t):
    named = _strings(t, "about m.n3 and (m.n7 too").select(F.explode(F.regexp_extract_all("v", F.lit(r"((?:cvt\.|m\.|g\.)\S+)"), F.lit(1))).alias("id"))
    return t.nation.join(named, F.concat(F.lit("m.n"), c("n_nationkey").cast("string")) == c("id"), "left_semi").select("n_name")


# --- retrieval


def _query_vector(t) -> list[float]:
    return list(t.embeddings.orderBy("vec_id").select("embedding").first()[0])


_COSINE = """SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q, q))), 6) AS score
    FROM embeddings, (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1) {where} ORDER BY score DESC, vec_id LIMIT 5"""


@query(_COSINE.format(where=""))
def cosine_topk(t):
    return retrieve.cosine_top(t.embeddings, _query_vector(t), 5)


@query(_COSINE.format(where="WHERE label = 3"))
def cosine_topk_filtered(t):
    return retrieve.cosine_top(t.embeddings, _query_vector(t), 5, c("label") == 3)


@query("SELECT role AS dataset_id, conv_id AS id, text AS question, text AS code, ok FROM (SELECT *, true AS ok, row_number() OVER (PARTITION BY role, conv_id ORDER BY turn) AS r FROM conversations WHERE length(text) % 5 <> 0 AND text <> '') WHERE r = 1")
def memory_load(t):
    rows = t.conversations.select(c("role").alias("dataset_id"), c("conv_id").alias("id"), c("text").alias("question"), c("text").alias("code"), (F.length("text") % 5 != 0).alias("ok"), c("turn").alias("pos"))
    return retrieve.verified_memory(rows)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 100")
def resume_pending(t):
    return retrieve.pending(t.documents.select("doc_id"), t.labels, "doc_id", 100)


# --- scoring


_SIDE = "(SELECT conv_id AS example_id, CASE WHEN turn < {} THEN 'opening' ELSE role END AS a, length(text) % 5 AS b FROM conversations)"
_PRED, _GOLD = _SIDE.format(1), _SIDE.format(2)


def _score_sql(item: str) -> str:
    side = lambda x: f"(SELECT DISTINCT example_id, {item} AS item FROM {x})"
    return f"""SELECT example_id, tp, fp, fn, CAST(CASE WHEN fp = 0 AND fn = 0 THEN 1 ELSE 0 END AS DOUBLE) AS em, round(CASE WHEN tp > 0 THEN CAST(2.0 AS DOUBLE) * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1 FROM (
    SELECT coalesce(p.example_id, g.example_id) AS example_id, count(*) FILTER (p.item IS NOT NULL AND g.item IS NOT NULL) AS tp, count(*) FILTER (g.item IS NULL) AS fp, count(*) FILTER (p.item IS NULL) AS fn
    FROM {side(_PRED)} p FULL JOIN {side(_GOLD)} g ON p.example_id = g.example_id AND p.item = g.item GROUP BY 1)"""


def _sides(t, item):
    def side(k):
        a = F.when(c("turn") < k, "opening").otherwise(c("role"))
        d = t.conversations.select(c("conv_id").alias("example_id"), a.alias("a"), (F.length("text") % 5).alias("b"))
        return d.select("example_id", item(d).alias("item"))

    return side(1), side(2)


@query(_score_sql("a || ' ' || CAST(b AS VARCHAR)"))
def eval_tuple_set(t):
    return answers.score(*_sides(t, lambda d: answers.tuple_item([c("a"), c("b")])))


@query(_score_sql("a || ' ' || CAST(b AS VARCHAR)"))
def eval_row_set(t):
    return answers.score(*_sides(t, lambda d: answers.row_set_item([c("b"), c("a"), c("b")])))


@query(_score_sql("a"))
def eval_first_col(t):
    return answers.score(*_sides(t, lambda d: normalize.value(c("a"), "table")))


@query("""SELECT conv_id AS example_id, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS hit_1 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r = 1""")
def eval_hit1(t):
    ranked = t.conversations.select(c("conv_id").alias("example_id"), c("turn").alias("pos"), c("role").alias("item"))
    return answers.hit_at_1(ranked, t.conversations.select(c("conv_id").alias("example_id")).distinct().withColumn("item", F.lit("User")))


@query("SELECT * FROM (VALUES ('q1', 'm.1'), ('q1', 'm.2')) v(id, answer)")
def gold_nested(t):
    raw = t.spark.createDataFrame([("q1", '{"Parses": [{"Answers": [{"AnswerArgument": "m.1"}, {"AnswerArgument": "m.2"}]}]}'), ("q2", '{"Parses": []}')], "id string, raw string")
    parsed = raw.select("id", F.from_json("raw", "Parses array<struct<Answers:array<struct<AnswerArgument:string>>>>").alias("r"))
    return parsed.select("id", F.explode(F.get("r.Parses", F.lit(0))["Answers"]["AnswerArgument"]).alias("answer"))


@query(_score_sql("a || ' ' || CAST(b AS VARCHAR)"))
def eval_casefold_set(t):
    shouted = lambda d: answers.casefold_item([F.concat(F.lit(" "), F.upper("a")), c("b")])
    return answers.score(*_sides(t, shouted))


@query("SELECT a, b, min(o_orderkey) AS pos FROM (SELECT nullif(o_orderstatus, 'F') AS a, nullif(o_orderpriority, '5-LOW') AS b, o_orderkey FROM orders) WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY a, b")
def answer_dedupe(t):
    rows = t.orders.select(F.nullif(c("o_orderstatus"), F.lit("F")).alias("a"), F.nullif(c("o_orderpriority"), F.lit("5-LOW")).alias("b"), c("o_orderkey").alias("pos"))
    return answers.distinct_rows(rows, "pos")


_MARKED = ("Apple###m.0123", "['Apple###m.0123']", "g.11x", "NATION_3", "nobody", "a###b###m.9")


@query("SELECT * FROM " + _values("m.0123", "m.0123", "g.11x", "m.n3", "nobody", "m.9").replace("v(id, v)", "v(id, answer)"))
def answer_ids(t):
    names = t.nation.select(c("n_name").alias("name"), F.concat(F.lit("m.n"), c("n_nationkey").cast("string")).alias("id"))
    return answers.restored_ids(_strings(t, *_MARKED), "v", names).select("id", c("v").alias("answer"))


# --- more joins, groups and positions


@query("""SELECT c_custkey, s_suppkey FROM customer FULL JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey) ON c_nationkey = s_nationkey AND c_acctbal > 0""")
def join_full(t):
    first = t.supplier.where("s_acctbal > 0").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s_suppkey"))
    return t.customer.join(first, (c("c_nationkey") == c("s_nationkey")) & (c("c_acctbal") > 0), "full").select("c_custkey", "s_suppkey")


@query("""SELECT a.event_id, b.ts AS last_ts, b.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a
    ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL) b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def asof_join(t):
    clicks = t.events.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    bought = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return frame.asof(bought, clicks, ["user_id"], "ts", ["value"], "last_", F.date_trunc("day", "ts")).select("event_id", "last_ts", "last_value")


@query("SELECT o_orderkey, n_name FROM orders JOIN nation ON o_totalprice >= n_nationkey * 20000.0 AND o_totalprice < n_nationkey * 20000.0 + 30000.0")
def range_join(t):
    bands = t.nation.select("n_name", (c("n_nationkey") * 20000.0).alias("low"), (c("n_nationkey") * 20000.0 + 30000.0).alias("high"))
    return frame.within(t.orders.select("o_orderkey", "o_totalprice"), bands, "o_totalprice", "low", "high", 10000.0).select("o_orderkey", "n_name")


@query("SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS level, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def group_cube(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().cast("bigint").alias("level"), n())


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
def group_rollup(t):
    return t.customer.rollup("c_nationkey", "c_mktsegment").agg(n())


@query("SELECT c_nationkey, c_custkey, place FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place <= 5")
def topk_per_group(t):
    return frame.largest_of(t.customer, 5, ["c_nationkey"], [F.desc("c_acctbal"), c("c_custkey")], "place").select("c_nationkey", "c_custkey", c("place").cast("bigint").alias("place"))


@query("SELECT c_custkey, place FROM (SELECT *, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS place FROM customer) WHERE place > 5")
def rank_direction(t):
    """Lower than 5th: a larger rank."""
    w = W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))
    return t.customer.select("c_custkey", F.rank().over(w).cast("bigint").alias("place")).where("place > 5")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1 OFFSET 7")
def row_position(t):
    return frame.row_at(t.orders, 7, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT p_name, count(*) AS n, string_split(p_name, ' ')[1] AS first_word, array_to_string(list_sort(string_split(p_name, ' ')), '+') AS sorted_words, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS n_words, list_contains(string_split(p_name, ' '), 'red') AS is_red FROM part GROUP BY p_name")
def array_functions(t):
    words = F.split("p_name", " ")
    named = t.part.groupBy("p_name").agg(n())
    return named.select("p_name", "n", F.get(words, F.lit(0)).alias("first_word"), F.array_join(F.array_sort(words), "+").alias("sorted_words"), F.size(words).alias("n_words"), F.array_contains(words, "red").alias("is_red"))


# --- more text and cells

_HALVES = {"0.125": 0.12, "0.375": 0.38, "-0.125": -0.12, "1.0": 1.0}


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, CAST({v!r} AS DOUBLE))" for i, v in enumerate(_HALVES.values())) + ") v(id, rounded)")
def round_half_even(t):
    return _strings(t, *_HALVES).select("id", F.bround(c("v").cast("double"), 2).alias("rounded"))


_G = {"507.0": "507", "3.10": "3.1", "0.1234567": "0.123457", "1234567.5": "1.23457e+06", "0.000012345678": "1.23457e-05", "abc": "abc", "-0": "-0", " 7 ": "7", "nan": "nan", "1e3": "1000"}


@query("SELECT * FROM " + _values(*_G.values()).replace("v(id, v)", "v(id, number)"))
def numeric_string(t):
    return _strings(t, *_G).select("id", normalize.numeric_string(c("v")).alias("number"))


_NAMED = ("find King Arthur and King", "nothing here")


@query("SELECT * FROM " + _values("find m.2 and m.1", "nothing here").replace("v(id, v)", "v(id, code)"))
def names_to_ids(t):
    return _strings(t, *_NAMED).select("id", text.names_to_ids(c("v"), {"King": "m.1", "King Arthur": "m.2"}).alias("code"))


@query("SELECT v AS value FROM " + _values("BUILDING", "x", "FURNITURE") + " WHERE length(trim(v)) >= 2 AND NOT contains('df[df.segment == ''BUILDING'']', trim(v))")
def missing_values(t):
    return linking.unused(_strings(t, "BUILDING", "x", "FURNITURE").select(c("v").alias("value")), "df[df.segment == 'BUILDING']")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_totalprice AS DOUBLE) AS price, 'x 12:30' AS kept FROM orders")
def clean_table(t):
    d = t.orders.select("o_orderkey", F.date_format("o_orderdate", "MMMM d, yyyy").alias("day"), F.concat(F.lit("$"), c("o_totalprice").cast("decimal(18,2)").cast("string")).alias("price"), F.lit("x 12:30").alias("kept"))
    done = profile.cleaned(d, ["o_orderkey"], ["day", "price", "kept"])
    return done.withColumn("price", c("price").cast("double"))


@query("SELECT * FROM (VALUES ('lineitem.a.b.nation', 'nation'), ('region', 'region')) v(file, box)")
def match_tables(t):
    files = t.spark.createDataFrame([("lineitem.a.b.nation", 25), ("region", 5), ("x.customer", 0), ("nowhere", 3)], "file string, n_rows int")
    boxes = t.spark.createDataFrame([("nation",), ("region",), ("customer",)], "box string")
    return linking.files_of_boxes(files, boxes)


# --- releases


@query("""SELECT 'nation' AS dataset, count(*) AS n_records, 25 AS expected, count(*) = 25 AS complete FROM nation UNION ALL SELECT 'region', count(*), 6, count(*) = 6 FROM region""")
def dataset_complete(t):
    return audit.complete({"nation": (t.nation, 25), "region": (t.region, 6)})


@query("SELECT CAST(event_id AS VARCHAR) AS id, event_type AS question FROM events")
def release_projection(t):
    return audit.projected(t.events.select("event_id", c("event_type").alias("question"), "props"), ["id", "question"], "event_id")


@query("SELECT 'k' AS key, count(*) AS n FROM events WHERE json_exists(props, '$.k')")
def forbidden_keys(t):
    return audit.nested_keys(t.events, "props", ["k", "sql", "answer"])


# --- SQL surface


@query("SELECT o_orderpriority, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) // 2 AS BIGINT) AS half FROM orders WHERE o_orderpriority ILIKE '%h%' GROUP BY o_orderpriority")
def sql_dialect(t):
    return dialect.query(_view(t.orders, "orders"), "SELECT \"o_orderpriority\", count(*) AS n, sum(IIF(o_orderstatus = 'F', 1, 0)) div 2 AS half FROM orders WHERE o_orderpriority LIKE '%H%' GROUP BY o_orderpriority")


@query("SELECT l_orderkey, l_linenumber, CAST(l_partkey // l_linenumber AS BIGINT) AS per_line, CAST((l_partkey + 1) // 2 // 3 AS BIGINT) AS sixth, CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity / l_tax END AS by_tax FROM lineitem")
def sql_division(t):
    sql = 'SELECT l_orderkey, l_linenumber, l_partkey / l_linenumber AS per_line, (l_partkey + 1) / 2 / 3 AS sixth, "l_quantity" / l_tax AS by_tax FROM lineitem'
    return dialect.query(_view(t.lineitem, "lineitem"), sql)


@query(r"""SELECT o_orderkey, CAST(regexp_extract(o_orderpriority, '^[0-9]+') AS BIGINT) AS urgency, 0::BIGINT AS none, CAST(trunc(o_totalprice) AS BIGINT) AS whole,
    CAST(regexp_extract(CAST(o_totalprice AS VARCHAR), '^[0-9]+') AS DOUBLE) AS start FROM orders""")
def sql_casts(t):
    sql = "SELECT o_orderkey, CAST(o_orderpriority AS INTEGER) AS urgency, CAST(o_orderstatus AS INTEGER) AS none, CAST(o_totalprice AS INTEGER) AS whole, CAST(CAST(CAST(o_totalprice AS INTEGER) AS TEXT) || ' x' AS REAL) AS start FROM orders"
    return dialect.query(_view(t.orders, "orders"), sql)


@query("""SELECT c_nationkey, arg_max(c_custkey, (c_acctbal, c_custkey)) AS c_custkey, max(c_acctbal) AS most FROM (SELECT * FROM customer WHERE (c_nationkey, c_acctbal, c_custkey) IN (SELECT (c_nationkey, c_acctbal, max(c_custkey)) FROM customer GROUP BY c_nationkey, c_acctbal)) GROUP BY c_nationkey""")
def sql_bare_column(t):
    """The customer beside each nation's largest balance; of equal balances the last customer stays."""
    one = t.customer.groupBy("c_nationkey", "c_acctbal").agg(F.max("c_custkey").alias("c_custkey"))
    return dialect.query(_view(one, "customer"), "SELECT c_nationkey, c_custkey, MAX(c_acctbal) AS most FROM customer GROUP BY c_nationkey")


@query("""SELECT strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m at %d') AS day, CAST(sum(dayofweek(o_orderdate)) AS BIGINT) AS weekdays, round(max(julian(o_orderdate)) - 0.5, 4) AS last
    FROM (SELECT o_orderkey, o_orderdate FROM orders) GROUP BY ALL""")
def sql_dates(t):
    sql = "SELECT STRFTIME('%Y', date(o_orderdate)) AS year, STRFTIME('%m at %d', o_orderdate) AS day, SUM(CAST(STRFTIME('%w', o_orderdate) AS INTEGER)) AS weekdays, ROUND(MAX(JULIANDAY(o_orderdate)) + 0.0, 4) AS last FROM orders GROUP BY 1, 2"
    return dialect.query(_view(t.orders, "orders"), sql)


# --- retrieval modes, shapes, and boxes of all types

_DATASETS = "CASE WHEN label % 2 = 0 THEN 'Even' ELSE 'odd' END"


@query(_COSINE.format(where=f"WHERE lower({_DATASETS}) = 'even'"))
def retrieve_same_dataset(t):
    return retrieve.retrieved(t.embeddings.withColumn("dataset_id", F.expr(_DATASETS)), _query_vector(t), 5, "same_dataset", "EVEN")


@query("""SELECT p_partkey, CAST(p_size AS VARCHAR) AS size, CASE WHEN CAST(p_retailprice AS DECIMAL(18,2)) = floor(CAST(p_retailprice AS DECIMAL(18,2))) THEN CAST(CAST(floor(CAST(p_retailprice AS DECIMAL(18,2))) AS BIGINT) AS VARCHAR) ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) END AS price, p_name AS name FROM part""")
def table_answer_cells(t):
    price = c("p_retailprice").cast("decimal(18,2)").cast("string")
    return t.part.select("p_partkey", normalize.table_cell(F.concat(c("p_size").cast("string"), F.lit(".0"))).alias("size"), normalize.table_cell(price).alias("price"), normalize.table_cell(c("p_name")).alias("name"))


@query("""SELECT 'customer' AS box, count(*) AS n, count(DISTINCT c_name) AS n_subjects, 'customer,in_nation,segment' AS columns FROM (SELECT c_name, c_nationkey AS v FROM customer UNION ALL SELECT c_name, -1 FROM customer) UNION ALL
    SELECT 'nation', count(*), count(*), 'nation,in_region' FROM nation""")
def kg_all_boxes(t):
    """Each type's box: rows, subjects and columns."""
    found = schemas.graph_boxes(_triples(t).where("p <> 'name'"))
    parts = [df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(c(f"`{box}`")).alias("n_subjects")).select(F.lit(box).alias("box"), "n", "n_subjects", F.lit(",".join(df.columns)).alias("columns")) for box, df in found.items()]
    return graph.union(parts)
