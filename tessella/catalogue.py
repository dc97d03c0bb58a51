"""Queries over the driver's tables, one for each operator, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.predicates import Param, all_of, any_of, raw
from tessella.operators.changes import ALL_ROWS, Changes, when
from tessella.operators.include import Include, every, exists, none, some
from tessella.plans.select import columns_of
from tessella.schema import ForeignKey, Model, Relation
from tessella.session import Db

# the driver's tables; its Parquet files declare every column nullable

region = Model("region", {"r_regionkey": "int", "r_name": "string"}, ("r_regionkey",))
nation = Model("nation", {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int?"}, ("n_nationkey",), foreign=(ForeignKey("n_regionkey", "region", "r_regionkey", "cascade"),))
customer = Model("customer", {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int?", "c_acctbal": "double", "c_mktsegment": "string"}, ("c_custkey",))
orders = Model(
    "orders",
    {"o_orderkey": "bigint", "o_custkey": "bigint?", "o_orderstatus": "string", "o_totalprice": "double?", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string?"},
    ("o_orderkey",),
    foreign=(ForeignKey("o_custkey", "customer", "c_custkey", "set_null"),),
)
lineitem = Model(
    "lineitem",
    {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"},
    ("l_orderkey", "l_linenumber"),
    foreign=(ForeignKey("l_orderkey", "orders", "o_orderkey", "cascade"),),
)
part = Model("part", {"p_partkey": "bigint", "p_name": "string"}, ("p_partkey",))
supplier = Model("supplier", {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int"}, ("s_suppkey",))
events = Model("events", {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string?"}, ("event_id",))
conversations = Model("conversations", {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string?"}, ("conv_id", "turn"))
MODELS = (region, nation, customer, orders, lineitem, part, supplier, events, conversations)

ORDERS_OF = Relation("orders", "orders", "o_custkey", "c_custkey")
CUSTOMER_OF = Relation("customer", "customer", "c_custkey", "o_custkey", many=False)
LINES_OF = Relation("lines", "lineitem", "l_orderkey", "o_orderkey")
PARTS_OF = Relation("parts", "part", "p_partkey", "o_orderkey", through=("lineitem", "l_orderkey", "l_partkey"))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str) -> Callable:
    """Adds a query that takes a Db, and its SQL."""

    def add(make: Callable[[Db], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = make(Db(spark, MODELS, sf_dir))
            return out.to_df() if hasattr(out, "to_df") else out

        QUERIES[name], SQL[name] = run, sql
        return make

    return add


def simple(name: str, make: Callable[[Db], object], sql: str) -> None:
    register(name, sql)(make)


def _orders(db: Db, f) -> object:
    return db.select(orders).filter(f).columns(orders.o_orderkey, orders.o_totalprice)


def filters() -> None:
    """Orders, parts or customers that meet one predicate."""
    o = orders
    for name, f, sql in (
        ("filter_eq", o.o_orderstatus.eq("F"), "o_orderstatus = 'F'"),
        ("filter_ne", o.o_orderstatus.ne("F"), "o_orderstatus <> 'F'"),
        ("filter_range", o.o_totalprice.gt(100000.0) & o.o_totalprice.lte(200000.0), "o_totalprice > 100000 AND o_totalprice <= 200000"),
        ("filter_between", o.o_totalprice.between(100000.0, 150000.0), "o_totalprice BETWEEN 100000 AND 150000"),
        ("filter_in", o.o_orderpriority.in_(["1-URGENT", "2-HIGH"]), "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
        ("filter_not_in", o.o_orderpriority.not_in(["1-URGENT", "2-HIGH"]), "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"),
        ("filter_in_nothing", o.o_orderpriority.not_in([]) & ~o.o_orderkey.in_([]), "TRUE"),
        ("filter_eq_null", o.o_custkey.eq(None) | o.o_custkey.ne(None), "o_custkey IS NULL OR o_custkey IS NOT NULL"),
        ("filter_and_or_not", (o.o_orderstatus.eq("F") & o.o_totalprice.gt(300000.0)) | ~o.o_orderpriority.eq("5-LOW"), "(o_orderstatus = 'F' AND o_totalprice > 300000) OR NOT o_orderpriority = '5-LOW'"),
        ("filter_all", all_of([o.o_orderstatus.eq("O"), o.o_totalprice.lt(90000.0), o.o_custkey.gte(100)]), "o_orderstatus = 'O' AND o_totalprice < 90000 AND o_custkey >= 100"),
        ("filter_any", any_of([o.o_orderkey.eq(3), o.o_totalprice.gt(490000.0), o.o_custkey.eq(7)]), "o_orderkey = 3 OR o_totalprice > 490000 OR o_custkey = 7"),
        ("filter_nothing", all_of([]) & any_of([]), "FALSE"),
        ("filter_raw", raw("o_totalprice * {} > {} AND o_orderstatus <> {}", 2, 800000, "it's"), "o_totalprice * 2 > 800000 AND o_orderstatus <> 'it''s'"),
        ("in_subquery", None, "o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
        ("not_in_subquery", None, "o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    ):
        if f is None:
            def make(db: Db, negate: bool = name.startswith("not")) -> object:
                keys = db.select(customer).filter(customer.c_mktsegment.eq("BUILDING")).columns(customer.c_custkey)
                return _orders(db, orders.o_custkey.not_in(keys) if negate else orders.o_custkey.in_(keys))
        else:
            def make(db: Db, f=f) -> object:
                return _orders(db, f)
        simple(name, make, f"SELECT o_orderkey, o_totalprice FROM orders WHERE {sql}")
    p, c = part, customer
    simple(
        "filter_like_contains",
        lambda db: db.select(p).filter(p.p_name.contains("ed wid")),
        "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ed wid%'",
    )
    simple(
        "filter_like_wildcard",
        lambda db: db.select(p).filter(p.p_name.contains("r_d")),
        "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%r_d%'",
    )
    simple(
        "filter_starts_with",
        lambda db: db.select(p).filter(p.p_name.starts_with("blue")),
        "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'blue%'",
    )
    simple(
        "filter_ends_with",
        lambda db: db.select(p).filter(p.p_name.ends_with("bolt")),
        "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%bolt'",
    )
    simple(
        "filter_ilike",
        lambda db: db.select(c).filter(c.c_name.ilike("CUSTOMER#00000000")).columns(c.c_custkey),
        "SELECT c_custkey FROM customer WHERE c_name ILIKE '%CUSTOMER#00000000%'",
    )
    line = lineitem
    simple(
        "filter_column_compare",
        lambda db: db.select(line).filter(line.l_tax.compare(">", line.l_discount)).columns(line.l_orderkey, line.l_linenumber),
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > l_discount",
    )
    simple(
        "or_filter_chain",
        lambda db: db.select(o).filter(o.o_orderstatus.eq("P")).or_filter(o.o_totalprice.gt(450000.0)).filter(o.o_custkey.lt(500)).columns(o.o_orderkey),
        "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'P' OR o_totalprice > 450000) AND o_custkey < 500",
    )
    simple("or_filter_fresh", lambda db: db.select(o).or_filter(o.o_orderstatus.eq("P")).columns(o.o_orderkey), "SELECT o_orderkey FROM orders")
    simple(
        "filter_if",
        lambda db: db.select(o).filter_if(None, o.o_orderkey.eq).filter_if("F", o.o_orderstatus.eq).or_filter_if(None, o.o_orderkey.eq).columns(o.o_orderkey),
        "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'",
    )


def shapes() -> None:
    """Projection, distinct, order, limits and pages."""
    o, line = orders, lineitem
    top = "ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey ASC NULLS LAST"
    best = (o.o_totalprice.desc(), o.o_orderkey.asc())
    two = (o.o_orderkey, o.o_totalprice)
    simple("scan_project", lambda db: db.select(nation).columns(nation.n_nationkey, nation.n_name), "SELECT n_nationkey, n_name FROM nation")
    simple("scan_model", lambda db: db.select("supplier"), "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
    simple(
        "distinct_projection",
        lambda db: db.select(line).columns(line.l_returnflag, line.l_linestatus).distinct(),
        "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    )
    simple(
        "order_limit",
        lambda db: db.select(o).columns(*two).order_by(*best).limit(25),
        f"SELECT o_orderkey, o_totalprice FROM orders {top} LIMIT 25",
    )
    simple(
        "order_limit_offset",
        lambda db: db.select(o).columns(*two).order_by(*best).order_by_if(None).limit(25).offset(40),
        f"SELECT o_orderkey, o_totalprice FROM orders {top} LIMIT 25 OFFSET 40",
    )
    simple(
        "keyset_after",
        lambda db: db.select(o).columns(*two).after(o.o_orderkey, 1000, 20),
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 20",
    )
    simple(
        "keyset_before",
        lambda db: db.select(o).columns(*two).before(o.o_orderkey, 1000, 20),
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 1000 ORDER BY o_orderkey DESC LIMIT 20",
    )
    simple(
        "count_filtered",
        lambda db: db.select(o).filter(o.o_orderstatus.eq("F")).filtered().agg(F.count("*").alias("n")),
        "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'",
    )
    simple(
        "exists_filtered",
        lambda db: db.spark.range(1).select(db.select(o).filter(o.o_totalprice.gt(499000.0)).filtered().exists().alias("found")),
        "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 499000) AS found",
    )
    simple(
        "page_first",
        lambda db: db.select(o).columns(o.o_orderkey).order_by(o.o_orderkey.desc()).page_rows(10),
        "SELECT o_orderkey, TRUE AS has_next FROM orders ORDER BY o_orderkey DESC LIMIT 10",
    )
    simple("page_last", lambda db: db.select(region).columns(region.r_regionkey).page_rows(10), "SELECT r_regionkey, FALSE AS has_next FROM region")
    asked = lambda db: db.select(o).filter(o.o_custkey.eq(Param(0)) & o.o_totalprice.between(Param(1), Param(2))).columns(*two).prepare()
    simple(
        "prepared_builder",
        lambda db: asked(db).bind_many([1, 0.0, 1.0]).bind(0, 5).bind(2, 300000.0),
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 5 AND o_totalprice BETWEEN 0 AND 300000",
    )
    simple(
        "prepared_rebind",
        lambda db: db.prepare("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = ? AND o_totalprice > ?").bind_many([1, 0]).bind(0, 5).bind(9, "ignored"),
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 5 AND o_totalprice > 0",
    )
    simple(
        "raw_query",
        lambda db: db.sql("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> :name", {"name": "ASIA"}),
        "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'",
    )


def aggregates() -> None:
    """Aggregates as a whole, by groups, with hidden keys."""
    o, line = orders, lineitem
    cents = lambda q, *names: q.to_df().withColumns({n: F.round(n, 2) for n in names})
    simple(
        "agg_global",
        lambda db: cents(db.select(o).filter(o.o_orderstatus.eq("F")).aggregate(o.o_orderkey.count(), o.o_totalprice.sum(), o.o_totalprice.avg(), o.o_totalprice.min(), o.o_totalprice.max()), "sum_o_totalprice", "avg_o_totalprice"),
        "SELECT count(o_orderkey) AS count_o_orderkey, round(sum(o_totalprice), 2) AS sum_o_totalprice, round(avg(o_totalprice), 2) AS avg_o_totalprice, min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice"
        " FROM orders WHERE o_orderstatus = 'F'",
    )
    simple(
        "agg_empty",
        lambda db: db.select(o).filter(o.o_orderkey.lt(0)).aggregate(o.o_orderkey.sum(), o.o_orderkey.count()),
        "SELECT CAST(sum(o_orderkey) AS BIGINT) AS sum_o_orderkey, count(o_orderkey) AS count_o_orderkey FROM orders WHERE o_orderkey < 0",
    )
    simple(
        "agg_group",
        lambda db: cents(db.select(line).group_by(line.l_returnflag, line.l_linestatus).aggregate(line.l_quantity.sum(), line.l_extendedprice.avg(), line.l_orderkey.count()).include_keys(), "sum_l_quantity", "avg_l_extendedprice"),
        "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_l_quantity, round(avg(l_extendedprice), 2) AS avg_l_extendedprice, count(l_orderkey) AS count_l_orderkey"
        " FROM lineitem GROUP BY ALL",
    )
    simple(
        "agg_hidden_key",
        lambda db: db.select(line).group_by(line.l_returnflag).aggregate(line.l_orderkey.count()).order_by(line.l_returnflag.asc()),
        "SELECT count(l_orderkey) AS count_l_orderkey FROM lineitem GROUP BY l_returnflag",
    )
    simple(
        "agg_having",
        lambda db: db.select(o).group_by(o.o_orderpriority).aggregate(o.o_orderkey.count()).include_keys().having(o.o_orderpriority.gt("1-URGENT")).having_if(None, o.o_orderpriority.eq),
        "SELECT o_orderpriority, count(o_orderkey) AS count_o_orderkey FROM orders WHERE o_orderpriority > '1-URGENT' GROUP BY ALL",
    )
    simple(
        "agg_having_raw",
        lambda db: db.select(o).group_by(o.o_custkey).aggregate(o.o_orderkey.count()).include_keys().having(raw("count_o_orderkey > {}", 12)),
        "SELECT o_custkey, count(o_orderkey) AS count_o_orderkey FROM orders GROUP BY o_custkey HAVING count(o_orderkey) > 12",
    )
    simple(
        "agg_where_group",
        lambda db: db.select(o).group_by(o.o_orderstatus).aggregate(o.o_custkey.count_distinct(), o.o_custkey.max()).filter(o.o_totalprice.gt(200000.0)).include_keys(),
        "SELECT o_orderstatus, count(DISTINCT o_custkey) AS count_distinct_o_custkey, max(o_custkey) AS max_o_custkey FROM orders"
        " WHERE o_totalprice > 200000 GROUP BY ALL",
    )
    simple(
        "agg_order_limit",
        lambda db: db.select(o).group_by(o.o_custkey).aggregate(o.o_orderkey.sum()).order_by(o.o_custkey.asc()).limit(10).offset(5),
        "SELECT CAST(sum(o_orderkey) AS BIGINT) AS sum_o_orderkey FROM orders GROUP BY o_custkey ORDER BY o_custkey LIMIT 10 OFFSET 5",
    )

    simple(
        "agg_filter_if",
        lambda db: db.select(o).group_by(o.o_orderstatus).aggregate(o.o_orderkey.count()).include_keys().filter_if("1-URGENT", o.o_orderpriority.eq).or_filter_if("2-HIGH", o.o_orderpriority.eq).filter_if(None, o.o_custkey.eq),
        "SELECT o_orderstatus, count(o_orderkey) AS count_o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY ALL",
    )
    simple(
        "agg_or_having_if",
        lambda db: db.select(o).group_by(o.o_orderpriority).aggregate(o.o_orderkey.count()).include_keys().having(o.o_orderpriority.eq("1-URGENT")).or_having_if("5-LOW", o.o_orderpriority.eq).or_having_if(None, o.o_orderpriority.eq),
        "SELECT o_orderpriority, count(o_orderkey) AS count_o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY ALL",
    )


def joins() -> None:
    """Joins of two models; each side is a struct, null where the outer side is absent."""
    c, o, n, r, s, t = customer, orders, nation, region, supplier, conversations
    flat = lambda q, *cells: q.to_df().select(*[F.col(x).alias(x.split(".")[-1]) for x in cells])
    simple(
        "join_inner",
        lambda db: flat(db.select(o).inner_join(c, o.o_custkey.on(c.c_custkey)).filter(o.o_totalprice.gt(400000.0)), "left.o_orderkey", "right.c_name"),
        "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000",
    )
    simple(
        "join_left",
        lambda db: flat(db.select(c).left_join(o, c.c_custkey.on(o.o_custkey) & o.o_totalprice.gt(400000.0)), "left.c_custkey", "right.o_orderkey"),
        "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000",
    )
    simple(
        "join_left_absent",
        lambda db: db.select(c).left_join(o, c.c_custkey.on(o.o_custkey)).to_df().where("right is null").select("left.c_custkey"),
        "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    )
    simple(
        "join_right",
        lambda db: flat(db.select(o).right_join(c, o.o_custkey.on(c.c_custkey) & o.o_orderstatus.eq("P")), "left.o_orderkey", "right.c_custkey"),
        "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'",
    )
    simple(
        "join_full",
        lambda db: flat(db.select(c).full_join(s, c.c_custkey.on(s.s_suppkey) & c.c_nationkey.on(s.s_nationkey)), "left.c_custkey", "right.s_suppkey"),
        "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey",
    )
    simple(
        "join_self_inner",
        lambda db: db.select(t).inner_join(t, t.conv_id.on(t.conv_id.aliased("nx")) & raw("conversations.turn + 1 = nx.turn"), "nx").to_df().select("left.conv_id", "left.turn", F.col("right.role").alias("next_role")),
        "SELECT a.conv_id, a.turn, b.role AS next_role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn",
    )
    simple(
        "join_self_left",
        lambda db: db.select(t).left_join(t, t.conv_id.on(t.conv_id.aliased("nx")) & raw("conversations.turn + 1 = nx.turn"), "nx").to_df().select("left.conv_id", "left.turn", F.col("right.role").alias("next_role")),
        "SELECT a.conv_id, a.turn, b.role AS next_role FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn",
    )
    simple(
        "join_theta",
        lambda db: flat(db.select(n).inner_join(r, n.n_regionkey.compare("<", r.r_regionkey)), "left.n_nationkey", "right.r_regionkey"),
        "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey < r_regionkey",
    )
    simple(
        "join_or",
        lambda db: flat(db.select(n).inner_join(r, n.n_regionkey.on(r.r_regionkey) | n.n_nationkey.on(r.r_regionkey)), "left.n_nationkey", "right.r_regionkey"),
        "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey OR n_nationkey = r_regionkey",
    )
    simple(
        "join_count",
        lambda db: db.select(o).inner_join(c, o.o_custkey.on(c.c_custkey)).filter(c.c_mktsegment.eq("BUILDING")).filtered().agg(F.count("*").alias("n")),
        "SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
    )


def subqueries() -> None:
    """EXISTS, relation filters, set operations and common table expressions."""
    c, o, s = customer, orders, supplier
    big = o.o_totalprice.gt(450000.0)
    keys = lambda q: q.columns(c.c_custkey)
    simple(
        "exists_correlated",
        lambda db: keys(db.select(c).filter(exists(db.select(o).filter(o.o_custkey.outer(c.c_custkey) & big)))),
        "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    )
    simple(
        "not_exists_correlated",
        lambda db: keys(db.select(c).filter(~exists(db.select(o).filter(o.o_custkey.outer(c.c_custkey) & big)))),
        "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    )
    simple(
        "rel_some",
        lambda db: keys(db.select(c).filter(some(c, ORDERS_OF, o.o_orderstatus.eq("P")))),
        "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    )
    simple(
        "rel_none",
        lambda db: keys(db.select(c).filter(none(c, ORDERS_OF, o.o_orderstatus.eq("P")))),
        "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    )
    simple(
        "rel_every",
        lambda db: keys(db.select(c).filter(every(c, ORDERS_OF, o.o_totalprice.lt(400000.0)))),
        "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT o_totalprice < 400000)",
    )
    simple(
        "rel_some_through",
        lambda db: db.select(o).filter(some(o, PARTS_OF, part.p_name.starts_with("red"))).columns(o.o_orderkey),
        "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name LIKE 'red%')",
    )
    left = lambda db: db.select(c).filter(c.c_acctbal.gt(5000.0)).columns(c.c_custkey)
    right = lambda db: db.select(o).filter(o.o_orderstatus.eq("P")).columns(o.o_custkey)
    a, b = "(SELECT c_custkey FROM customer WHERE c_acctbal > 5000)", "(SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"
    simple("set_union", lambda db: left(db).union(right(db)), f"{a} UNION {b}")
    simple("set_union_all", lambda db: left(db).union_all(right(db)), f"{a} UNION ALL {b}")
    simple("set_intersect", lambda db: left(db).intersect(right(db)), f"{a} INTERSECT {b}")
    simple("set_except", lambda db: left(db).except_(right(db)), f"{a} EXCEPT {b}")
    simple(
        "set_operand_limit",
        lambda db: left(db).order_by(c.c_custkey.asc()).limit(5).union_all(db.select(s).columns(s.s_suppkey).order_by(s.s_suppkey.desc()).limit(3)),
        "SELECT * FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 5000 ORDER BY c_custkey LIMIT 5) UNION ALL SELECT *"
        " FROM (SELECT s_suppkey FROM supplier ORDER BY s_suppkey DESC LIMIT 3)",
    )
    spend = Model("spend", {"o_custkey": "bigint?", "sum_o_totalprice": "double?"}, ("o_custkey",))

    @register(
        "cte",
        "WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT o_custkey FROM spend WHERE total > 3000000",
    )
    def cte(db: Db) -> object:
        wide = db.with_cte(spend, db.select(o).group_by(o.o_custkey).aggregate(o.o_totalprice.sum()).include_keys())
        return wide.select(spend).filter(spend.sum_o_totalprice.gt(3000000.0)).columns(spend.o_custkey)

    chain = Model("chain", {"turn": "bigint", "n": "bigint"}, ("turn",))

    @register(
        "cte_recursive",
        "WITH RECURSIVE chain(turn, n) AS (SELECT turn, count(*) FROM conversations WHERE turn = 0 GROUP BY turn UNION ALL"
        " SELECT chain.turn + 1, chain.n FROM chain WHERE chain.turn < 6) SELECT turn, n FROM chain",
    )
    def cte_recursive(db: Db) -> object:
        t = conversations
        first = Model("first", {"turn": "bigint", "count_conv_id": "bigint"}, ("turn",))
        anchor = db.with_cte(first, db.select(t).filter(t.turn.eq(0)).group_by(t.turn).aggregate(t.conv_id.count()).include_keys()).select(first)
        return db.with_recursive(chain, anchor, "SELECT chain.turn + 1, chain.n FROM chain WHERE chain.turn < 6").select(chain)

    @register(
        "cte_merge",
        "WITH rich AS (SELECT c_custkey FROM customer WHERE c_acctbal > 9000), spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)"
        " SELECT c_custkey FROM rich UNION SELECT o_custkey FROM spend WHERE total > 3000000",
    )
    def cte_merge(db: Db) -> object:
        """Both sides of a set operation bring a common table expression of their own."""
        rich = Model("rich", {"c_custkey": "bigint"}, ("c_custkey",))
        one = db.with_cte(rich, db.select(c).filter(c.c_acctbal.gt(9000.0)).columns(c.c_custkey))
        two = db.with_cte(spend, db.select(o).group_by(o.o_custkey).aggregate(o.o_totalprice.sum()).include_keys())
        return one.select(rich).union(two.select(spend).filter(spend.sum_o_totalprice.gt(3000000.0)).columns(spend.o_custkey))

    walk = Model("walk", {"conv_id": "bigint", "turn": "bigint", "chars": "bigint"}, ("conv_id", "turn"))

    @register(
        "cte_recursive_walk",
        "WITH RECURSIVE walk(conv_id, turn, chars) AS (SELECT conv_id, turn, 0::BIGINT FROM conversations WHERE turn = 0"
        " UNION ALL SELECT walk.conv_id, c.turn, walk.chars + coalesce(length(c.text), 0) FROM walk JOIN conversations c ON c.conv_id = walk.conv_id AND c.turn = walk.turn + 1) SELECT * FROM walk",
    )
    def cte_recursive_walk(db: Db) -> object:
        """Each conversation from its first turn on, as long as turns follow, with the characters said so far."""
        t = conversations
        start = Model("start", {"conv_id": "bigint", "turn": "bigint", "chars": "bigint"}, ("conv_id",))
        zero = db.with_tables(start=db.table(t).where("turn = 0").select("conv_id", "turn", F.lit(0).cast("long").alias("chars")))
        step = "SELECT walk.conv_id, c.turn, walk.chars + coalesce(length(c.text), 0) FROM walk JOIN conversations c ON c.conv_id = walk.conv_id AND c.turn = walk.turn + 1"
        return db.with_recursive(walk, zero.select(start), step).select(walk)

    def holes(db: Db) -> Db:
        """Orders of which some have no customer or price."""
        rows = db.table(o).withColumn("o_custkey", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey"))).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")))
        return db.with_tables(orders=rows)

    with_holes = "WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS o_custkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS o_totalprice FROM orders) "
    simple(
        "filter_null_rows",
        lambda db: holes(db).select(o).filter(o.o_custkey.is_null() & o.o_totalprice.ne(None)).columns(o.o_orderkey),
        with_holes + "SELECT o_orderkey FROM o WHERE o_custkey IS NULL AND o_totalprice IS NOT NULL",
    )
    simple(
        "filter_not_of_null",
        lambda db: holes(db).select(o).filter(~o.o_totalprice.gt(100000.0) | o.o_custkey.not_in([1, 2])).columns(o.o_orderkey),
        with_holes + "SELECT o_orderkey FROM o WHERE NOT o_totalprice > 100000 OR o_custkey NOT IN (1, 2)",
    )
    simple(
        "rel_every_null_child",
        lambda db: keys(holes(db).select(c).filter(every(c, ORDERS_OF, o.o_totalprice.lt(400000.0)))),
        with_holes + "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM o WHERE o_custkey = c_custkey AND NOT o_totalprice < 400000)",
    )
    simple(
        "join_left_absent_rows",
        lambda db: holes(db).select(c).left_join(o, c.c_custkey.on(o.o_custkey)).to_df().where("right is null").select("left.c_custkey"),
        with_holes + "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM o WHERE o_custkey IS NOT NULL)",
    )
    simple(
        "set_limit",
        lambda db: left(db).union(right(db)).limit(50).offset(7).to_df().agg(F.count("*").alias("n")),
        f"SELECT count(*) AS n FROM (({a} UNION {b}) LIMIT 50 OFFSET 7)",
    )
    simple(
        "set_of_sets",
        lambda db: left(db).union_all(right(db)).to_df().exceptAll(left(db).intersect(right(db)).to_df()),
        f"({a} UNION ALL {b}) EXCEPT ALL ({a} INTERSECT {b})",
    )
    simple(
        "related_many",
        lambda db: db.related(ORDERS_OF, 5).filter(o.o_totalprice.gt(1000.0)).columns(o.o_orderkey),
        "SELECT o_orderkey FROM orders WHERE o_custkey = 5 AND o_totalprice > 1000",
    )
    simple(
        "related_through",
        lambda db: db.related(PARTS_OF, 1).columns(part.p_partkey),
        "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey = 1)",
    )


def documents_and_arrays() -> None:
    """JSON text and arrays."""
    e = events
    ids = lambda q: q.columns(e.event_id)
    k = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
    simple(
        "json_compare",
        lambda db: ids(db.select(e).filter(e.props.get("k").gt(50) & e.props.get("k").ne(77))),
        f"SELECT event_id FROM events WHERE {k} > 50 AND {k} <> 77",
    )
    simple(
        "json_text_like",
        lambda db: ids(db.select(e).filter(e.props.get_text("k").starts_with("7"))),
        "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') LIKE '7%'",
    )
    simple(
        "json_has_key",
        lambda db: ids(db.select(e).filter(e.props.has_key("k") & ~e.props.has_key("other") & e.value.gt(20.0))),
        "SELECT event_id FROM events WHERE value > 20",
    )
    simple("json_contains", lambda db: ids(db.select(e).filter(e.props.json_contains({"k": 42}))), f"SELECT event_id FROM events WHERE {k} = 42")
    simple(
        "json_order",
        lambda db: ids(db.select(e).order_by(e.props.get("k").number().desc(), e.event_id.asc()).limit(15)),
        f"SELECT event_id FROM events ORDER BY {k} DESC NULLS FIRST, event_id LIMIT 15",
    )

    def kept_as(db: Db, props: Callable) -> Db:
        return db.with_tables(events=db.table(e).withColumn("props", props(F.get_json_object("props", "$.k"))))

    quoted = lambda v: F.to_json(F.create_map(F.lit("it's"), F.struct(v.cast("double").alias("in"))))
    simple(
        "json_quoted_key",
        lambda db: ids(kept_as(db, quoted).select(e).filter(e.props.get("it's").get("in").gt(50))),
        f"SELECT event_id FROM events WHERE {k} > 50",
    )
    listed = lambda v: F.concat(F.lit('[0, {"k": '), v, F.lit("}]"))
    simple(
        "json_at",
        lambda db: ids(kept_as(db, listed).select(e).filter(e.props.at(1).get("k").lte(50))),
        f"SELECT event_id FROM events WHERE {k} <= 50",
    )
    nested = lambda v: F.concat(F.lit('{"a": {"b": '), v, F.lit(', "c": "Word"}, "t": ["x", "'), v, F.lit('"]}'))
    simple(
        "json_contains_nested",
        lambda db: ids(kept_as(db, nested).select(e).filter(e.props.json_contains({"a": {"b": 42, "c": "Word"}, "t": ["42"]}))),
        f"SELECT event_id FROM events WHERE {k} = 42",
    )
    simple(
        "json_ilike",
        lambda db: ids(kept_as(db, nested).select(e).filter(e.props.get("a").get_text("c").ilike("wOR") & e.props.get("t").at(1).eq("42"))),
        f"SELECT event_id FROM events WHERE {k} = 42",
    )
    baskets = Model("baskets", {"l_orderkey": "bigint", "flags": "array<string>"}, ("l_orderkey",))

    def with_baskets(db: Db) -> Db:
        made = db.table(lineitem).groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("flags"))
        return Db(db.spark, [*MODELS, baskets], db.root, {"baskets": made})

    basket = "WITH baskets AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey FROM baskets WHERE "
    for name, f, sql in (
        ("array_contains", baskets.flags.contains_all(["A", "R"]), "list_has_all(flags, ['A', 'R'])"),
        ("array_contained_by", baskets.flags.contained_by(["A", "N"]), "list_has_all(['A', 'N'], flags)"),
        ("array_overlaps", baskets.flags.overlaps(["A", "X"]), "list_has_any(flags, ['A', 'X'])"),
    ):
        simple(name, lambda db, f=f: with_baskets(db).select(baskets).filter(f).columns(baskets.l_orderkey), basket + sql)


def relations() -> None:
    """Relation loading, flattened for comparison."""
    c, o, line = customer, orders, lineitem
    simple(
        "include_list",
        lambda db: db.select(c).include(Include(ORDERS_OF)).to_df().select("c_custkey", F.size("orders").cast("long").alias("n"), F.array_join(F.transform("orders", lambda x: x["o_orderkey"].cast("string")), ",").alias("keys")),
        "SELECT c_custkey, count(o_orderkey) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ','"
        " ORDER BY o_orderkey), '') AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    )
    simple(
        "include_one",
        lambda db: db.select(o).filter(o.o_totalprice.gt(400000.0)).include(Include(CUSTOMER_OF)).to_df().select("o_orderkey", "customer.c_name"),
        "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000",
    )
    simple(
        "include_take",
        lambda db: db.select(c).include(Include(ORDERS_OF).order_by(o.o_totalprice.desc()).take(2)).to_df().select("c_custkey", F.array_join(F.transform("orders", lambda x: x["o_orderkey"].cast("string")), ",").alias("keys")),
        "WITH ranked AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey"
        " ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey) AS rn FROM orders)"
        " SELECT c_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn), '') AS keys FROM customer LEFT"
        " JOIN ranked ON o_custkey = c_custkey AND rn <= 2 GROUP BY c_custkey",
    )
    simple(
        "include_filtered",
        lambda db: db.select(c).include(Include(ORDERS_OF).filter(o.o_orderstatus.eq("P"))).to_df().select("c_custkey", F.size("orders").cast("long").alias("n")),
        "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey",
    )
    simple(
        "include_nested",
        lambda db: db.select(c).include(Include(ORDERS_OF).include(Include(LINES_OF).filter(line.l_quantity.gt(45.0)))).to_df().select("c_custkey", F.size("orders").cast("long").alias("n_orders"), F.aggregate("orders", F.lit(0).cast("long"), lambda n, x: n + F.size(x["lines"])).alias("n_lines")),
        "SELECT c_custkey, count(DISTINCT o_orderkey) AS n_orders, count(l_orderkey) AS n_lines FROM customer LEFT"
        " JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45"
        " GROUP BY c_custkey",
    )
    simple(
        "include_through",
        lambda db: db.select(o).filter(o.o_orderstatus.eq("P")).include(Include(PARTS_OF)).to_df().select("o_orderkey", F.size("parts").cast("long").alias("n"), F.array_join(F.transform("parts", lambda x: x["p_partkey"].cast("string")), ",").alias("keys")),
        "SELECT o_orderkey, count(p_partkey) AS n, coalesce(string_agg(CAST(p_partkey AS VARCHAR), ','"
        " ORDER BY p_partkey), '') AS keys FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT"
        " JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'P' GROUP BY o_orderkey",
    )

    simple(
        "include_contents",
        lambda db: db.select(c).filter(c.c_custkey.lt(400)).include(Include(ORDERS_OF).filter(o.o_totalprice.gt(100000.0)).include(Include(LINES_OF).filter(line.l_quantity.gt(30.0))))
        .to_df()
        .select("c_custkey", F.array_join(F.transform("orders", lambda x: F.concat_ws(":", x["o_orderkey"], F.array_join(F.transform(x["lines"], lambda y: y["l_linenumber"].cast("string")), "/"))), ",").alias("tree")),
        "WITH one AS (SELECT o_custkey, o_orderkey, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), '/' ORDER BY l_linenumber), '') AS lines"
        " FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 30 WHERE o_totalprice > 100000 GROUP BY ALL)"
        " SELECT c_custkey, coalesce(string_agg(o_orderkey || ':' || lines, ',' ORDER BY o_orderkey), '') AS tree FROM customer LEFT JOIN one ON o_custkey = c_custkey WHERE c_custkey < 400 GROUP BY c_custkey",
    )
    simple(
        "include_ordered",
        lambda db: db.select(c).include(Include(ORDERS_OF).order_by(o.o_orderpriority.asc(), o.o_totalprice.desc())).to_df().select("c_custkey", F.array_join(F.transform("orders", lambda x: x["o_orderkey"].cast("string")), ",").alias("keys")),
        "SELECT c_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey), '') AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    )
    last = Relation("last", "orders", "o_custkey", "c_custkey", many=False)
    simple(
        "include_one_of_many",
        lambda db: db.select(c).filter(c.c_custkey.lt(900)).include(Include(last).order_by(o.o_totalprice.desc())).to_df().select("c_custkey", "last.o_orderkey"),
        "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1) ON o_custkey = c_custkey WHERE c_custkey < 900",
    )


def changes() -> None:
    """States of tables after changes that are staged and not written."""
    o, c, n, r, line = orders, customer, nation, region, lineitem
    cols = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"
    state = lambda t: t.table(o).select(*cols.split(", "))

    def change(name: str, do: Callable[[Changes], object], sql: str, show: Callable[[Changes], DataFrame] = state) -> None:
        def make(db: Db) -> DataFrame:
            tx = Changes(db)
            do(tx)
            return show(tx)

        simple(name, make, sql)

    new = {"o_orderkey": 99_000_001, "o_custkey": 5, "o_orderstatus": "N", "o_totalprice": 10.5, "o_orderdate": None, "o_orderpriority": "1-URGENT"}
    old = new | {"o_orderkey": 3}
    added = f"SELECT {cols} FROM orders UNION ALL SELECT 99000001, 5, 'N', 10.5"
    change("insert_many", lambda t: t.insert(o, [new, new | {"o_orderkey": 99_000_002}]), added + " UNION ALL SELECT 99000002, 5, 'N', 10.5")
    change(
        "upsert_update",
        lambda t: t.upsert(o, [new, old], ("o_orderkey",), ("o_totalprice",)),
        "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey = 3 THEN 10.5 ELSE o_totalprice END AS o_totalprice"
        " FROM orders UNION ALL SELECT 99000001, 5, 'N', 10.5",
    )
    change("upsert_nothing", lambda t: t.upsert(o, [new, old], ("o_orderkey",)), added)
    change(
        "update_set",
        lambda t: t.update(o, o.o_orderstatus.eq("P"), o_totalprice=F.col("o_totalprice") * 2, o_orderstatus="Q"),
        "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'Q' ELSE o_orderstatus END AS o_orderstatus,"
        " CASE WHEN o_orderstatus = 'P' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders",
    )
    change(
        "update_null",
        lambda t: t.update(o, ALL_ROWS, o_totalprice=None),
        "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(NULL AS DOUBLE) AS o_totalprice FROM orders",
    )
    change("delete_filtered", lambda t: t.delete(o, o.o_totalprice.gt(250000.0)), f"SELECT {cols} FROM orders WHERE NOT o_totalprice > 250000")
    change(
        "delete_cascade",
        lambda t: t.delete(o, o.o_orderstatus.eq("F")),
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
        lambda t: t.table(line).select("l_orderkey", "l_linenumber"),
    )
    change(
        "delete_set_null",
        lambda t: t.delete(c, c.c_mktsegment.eq("BUILDING")),
        "SELECT o_orderkey,"
        " CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice FROM orders"
        " LEFT JOIN customer ON o_custkey = c_custkey",
    )
    change(
        "update_json",
        lambda t: t.update_json(events, events.event_id.lt(100), "props", "seen", True),
        "SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_id < 100 THEN 'true' END AS seen FROM events",
        lambda t: t.table(events).select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.seen").alias("seen")),
    )
    change(
        "nested_create",
        lambda t: t.create(r, {"r_regionkey": 77, "r_name": "NEW"}, {Relation("nations", "nation", "n_regionkey", "r_regionkey"): [{"n_nationkey": 770, "n_name": "A"}, {"n_nationkey": 771, "n_name": "B"}]}),
        "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL VALUES (770, 'A', 77), (771, 'B', 77)",
        lambda t: t.table(n),
    )
    change(
        "connect",
        lambda t: t.connect(ORDERS_OF, 1, o.o_orderkey.in_([1, 2, 3])),
        "SELECT o_orderkey, CASE WHEN o_orderkey IN (1, 2, 3) THEN 1 ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice FROM orders",
    )

    change("upsert_repeated_key", lambda t: t.upsert(o, [new, new | {"o_totalprice": 99.0}, old, old], ("o_orderkey",)), added)
    change(
        "update_count",
        lambda t: t,
        "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P'",
        lambda t: t.update(o, o.o_orderstatus.eq("P"), o_orderstatus="Q").to_df(),
    )
    change(
        "delete_count",
        lambda t: t,
        "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') + (SELECT count(*) FROM lineitem"
        " JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F') AS n",
        lambda t: t.delete(o, o.o_orderstatus.eq("F")).to_df(),
    )
    change(
        "update_filter_if",
        lambda t: (t.update(o, when("P", o.o_orderstatus.eq), o_orderstatus="Q"), t.update(o, when(None, o.o_orderkey.eq), o_totalprice=1.0)),
        "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'Q' ELSE o_orderstatus END AS o_orderstatus, 1.0 AS o_totalprice FROM orders",
    )
    change(
        "set_related_many",
        lambda t: t.set_related(ORDERS_OF, 5, [1, 2, 3]),
        "SELECT o_orderkey,"
        " CASE WHEN o_orderkey IN (1, 2, 3) THEN 5 WHEN o_custkey <> 5 THEN o_custkey END AS o_custkey, o_orderstatus, o_totalprice"
        " FROM orders",
    )
    change(
        "disconnect",
        lambda t: t.disconnect(ORDERS_OF, o.o_custkey.eq(5)),
        "SELECT o_orderkey, CASE WHEN o_custkey <> 5 THEN o_custkey END AS o_custkey, o_orderstatus, o_totalprice FROM orders",
    )
    change(
        "tx_sql",
        lambda t: t.delete(o, o.o_orderstatus.eq("F")),
        "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 1000 GROUP BY o_orderstatus",
        lambda t: t.sql("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > ? GROUP BY o_orderstatus", [1000]),
    )
    halved = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice / 2 AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey <> :gone"
    change(
        "tx_execute",
        lambda t: t.execute(o, halved, {"gone": 3}),
        "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice / 2 AS o_totalprice FROM orders WHERE o_orderkey <> 3",
    )

    def tree(db: Db, rule: str) -> tuple[Changes, Model]:
        """Parts as a binary tree: 2 and 3 hang on 1, 4 and 5 on 2."""
        node = Model("node", {"id": "bigint", "up": "bigint?"}, foreign=(ForeignKey("up", "node", "id", rule),))
        rows = db.table(part).select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("up"))
        return Changes(Db(db.spark, [*MODELS, node], db.root, {"node": rows})), node

    as_tree = "node AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS up FROM part)"

    @register(
        "delete_self_cascade",
        f"WITH RECURSIVE {as_tree}, gone AS (SELECT id FROM node WHERE id = 3 UNION ALL SELECT node.id FROM node"
        " JOIN gone ON node.up = gone.id) SELECT id, up FROM node WHERE id NOT IN (SELECT id FROM gone)",
    )
    def delete_self_cascade(db: Db) -> DataFrame:
        t, node = tree(db, "cascade")
        t.delete(node, node.id.eq(3))
        return t.table(node)

    @register("delete_self_set_null", f"WITH {as_tree} SELECT id, CASE WHEN up NOT IN (3, 5) THEN up END AS up FROM node WHERE id NOT IN (3, 5)")
    def delete_self_set_null(db: Db) -> DataFrame:
        t, node = tree(db, "set_null")
        t.delete(node, node.id.in_([3, 5]))
        return t.table(node)

    def savepoints(t: Changes) -> None:
        t.delete(o, o.o_orderstatus.eq("P"))
        point = t.savepoint()
        t.delete(o, ALL_ROWS)
        t.rollback_to(point)

    def rolled_back(t: Changes) -> None:
        t.delete(o, ALL_ROWS)
        t.rollback()

    change("tx_savepoint", savepoints, f"SELECT {cols} FROM orders WHERE o_orderstatus <> 'P'")
    change("tx_rollback", rolled_back, f"SELECT {cols} FROM orders")
    likes = Model("tags", {"post": "bigint", "tag": "bigint"}, ("post", "tag"))
    tags = Relation("tags", "nation", "n_nationkey", "r_regionkey", through=("tags", "post", "tag"))

    @register(
        "m2m_set",
        "SELECT CAST(n_regionkey AS BIGINT) AS post, CAST(n_nationkey AS BIGINT) AS tag FROM nation"
        " WHERE n_regionkey NOT IN (1, 2) UNION SELECT * FROM (VALUES (1, 3), (1, 4), (2, 900)) v(post, tag) UNION"
        " SELECT n_regionkey, n_nationkey FROM nation WHERE n_regionkey = 2 AND n_nationkey <> 8",
    )
    def m2m_set(db: Db) -> DataFrame:
        ties = db.table(n).select(F.col("n_regionkey").cast("long").alias("post"), F.col("n_nationkey").cast("long").alias("tag"))
        t = Changes(Db(db.spark, [*MODELS, likes], db.root, {"tags": ties}))
        t.set_related(tags, 1, [3, 4])
        t.attach(tags, 2, [900])
        t.detach(tags, 2, [8])
        return t.table(likes)


for family in (filters, shapes, aggregates, joins, subqueries, documents_and_arrays, relations, changes):
    family()
