"""Statements that exercise every operator on the driver's tables, with SQL of the same meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veldra.engine import Engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: SELECTs whose text is valid standard SQL too.
SELECTS = {
    "seq_scan": "SELECT * FROM nation;",
    "project_columns": "SELECT c_name, c_custkey FROM customer;",
    "project_qualified": "SELECT part.p_brand, part.p_size FROM part;",
    "filter_eq_string": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING';",
    "filter_eq_int": "SELECT * FROM part WHERE p_size = 10;",
    "filter_neq": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F';",
    "filter_neq_bang": "SELECT o_orderkey FROM orders WHERE o_orderstatus != 'O';",
    "filter_lt": "SELECT p_partkey FROM part WHERE p_size < 5;",
    "filter_gt_float": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000.0;",
    "filter_le": "SELECT p_partkey FROM part WHERE p_size <= 5;",
    "filter_ge": "SELECT p_partkey FROM part WHERE p_size >= 45;",
    "filter_string_range": "SELECT c_custkey FROM customer WHERE c_mktsegment < 'FURNITURE';",
    "filter_and": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45.0;",
    "filter_or": "SELECT event_id FROM events WHERE event_type = 'purchase' OR event_type = 'signup';",
    "filter_nested_parens": "SELECT p_partkey FROM part WHERE p_size > 5 AND (p_brand = 'Brand#11' OR p_size <= 10);",
    "filter_negative": "SELECT c_custkey FROM customer WHERE c_acctbal < -500.0;",
    "filter_true": "SELECT r_name FROM region WHERE TRUE;",
    "filter_literal_left": "SELECT p_partkey FROM part WHERE 40 < p_size;",
    "filter_arithmetic": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * l_discount > 5000.0;",
    "filter_integer_arithmetic": "SELECT p_partkey FROM part WHERE p_size * 2 + 1 > 90 - p_size;",
    "join_inner": "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON customer.c_custkey = orders.o_custkey;",
    "join_inner_keyword": "SELECT n_name, r_name FROM nation INNER JOIN region ON n_regionkey = r_regionkey;",
    "join_star": "SELECT * FROM nation JOIN region ON nation.n_regionkey = region.r_regionkey;",
    "join_swapped_on": "SELECT c_name, n_name FROM customer JOIN nation ON nation.n_nationkey = customer.c_nationkey;",
    "join_where_left": "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE customer.c_mktsegment = 'BUILDING';",
    "join_where_right": "SELECT c_custkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE orders.o_totalprice > 400000.0;",
    "join_where_both": "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 0.0 AND o_orderstatus = 'F';",
    "join_nonkey_compare": "SELECT l_orderkey, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_extendedprice < p_retailprice;",
}
FLAGSHIP = "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 400000.0;"

#: SELECTs whose SQL differs, since families don't mix here.
OTHERS = {
    "filter_type_mismatch": ("SELECT n_nationkey FROM nation WHERE n_nationkey = '2' OR n_nationkey != '2';", "SELECT n_nationkey FROM nation"),
    "join_type_mismatch": ("SELECT n_name, c_name FROM nation JOIN customer ON n_nationkey = c_name;", "SELECT n_name, c_name FROM nation, customer WHERE FALSE"),
    "self_join": ("SELECT nation.n_name FROM nation JOIN nation ON nation.n_nationkey = nation.n_regionkey;", "SELECT a.n_name FROM nation a JOIN nation b ON a.n_nationkey = b.n_regionkey"),
}

ANY = "CREATE INDEX i ON {0} ({1});"
#: Statements before a SELECT, and SQL for what it returns. Tables changed are copied first.
SCRIPTS = {
    # joins that read an index copy: made by the join, made before it, with filters on either side, after a change
    "index_join_filter_outer": ([ANY.format("customer", "c_custkey"), "SELECT c_name FROM customer WHERE c_custkey = 7;", "SELECT o_orderkey, c_name FROM orders JOIN customer ON customer.c_custkey = orders.o_custkey WHERE orders.o_totalprice > 300000.0;"],
        "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 300000.0"),
    "index_join_filter_inner": ([ANY.format("customer", "c_custkey"), "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0.0;"],
        "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0.0"),
    "index_join_after_delete": ([ANY.format("nation", "n_nationkey"), "SELECT * FROM nation WHERE n_nationkey > 3;", "DELETE FROM nation WHERE n_regionkey = 1;", "SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey;"],
        "SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1"),
    "index_copy_then_update": ([ANY.format("part", "p_size"), "SELECT p_partkey FROM part WHERE p_size = 50;", "UPDATE part SET p_size = 51 WHERE p_size = 50;", "SELECT p_partkey, p_size FROM part WHERE p_size > 48;"],
        "SELECT p_partkey, CAST(CASE WHEN p_size = 50 THEN 51 ELSE p_size END AS INTEGER) AS p_size FROM part WHERE p_size > 48"),
    "index_copy_then_insert": ([ANY.format("region", "r_regionkey"), "SELECT * FROM region WHERE r_regionkey = 1;", "INSERT INTO region VALUES (9, 'MOON'), (9, 'MARS');", "SELECT * FROM region WHERE r_regionkey >= 4;"],
        "SELECT * FROM region WHERE r_regionkey >= 4 UNION ALL SELECT * FROM (VALUES (9, 'MOON'), (9, 'MARS')) t(r_regionkey, r_name)"),
    "index_range_lt": ([ANY.format("orders", "o_totalprice"), "SELECT o_orderkey FROM orders WHERE o_totalprice < 5000.0;"], "SELECT o_orderkey FROM orders WHERE o_totalprice < 5000.0"),
    "index_range_le": ([ANY.format("part", "p_size"), "SELECT p_partkey FROM part WHERE p_size <= 3;"], "SELECT p_partkey FROM part WHERE p_size <= 3"),
    "index_range_gt": ([ANY.format("part", "p_size"), "SELECT p_partkey FROM part WHERE p_size > 48;"], "SELECT p_partkey FROM part WHERE p_size > 48"),
    "index_string_point": ([ANY.format("customer", "c_mktsegment"), "SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY';"], "SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'"),
    "index_type_mismatch": ([ANY.format("part", "p_size"), "SELECT p_partkey FROM part WHERE p_size = '3';"], "SELECT p_partkey FROM part WHERE FALSE"),
    # a column as a predicate; names with their tables in changes; repeated targets; several statements
    "filter_bare_boolean": (["CREATE TABLE f (k INTEGER, ok BOOLEAN);", "INSERT INTO f VALUES (1, TRUE), (2, FALSE), (3, 2 > 1), (4, 'a' = 'b');", "SELECT k FROM f WHERE ok;"], "SELECT * FROM (VALUES (CAST(1 AS INTEGER)), (3)) t(k)"),
    "filter_boolean_and": (["CREATE TABLE f (k INTEGER, ok BOOLEAN);", "INSERT INTO f VALUES (1, TRUE), (2, FALSE), (3, TRUE);", "SELECT k FROM f WHERE ok AND k > 1 OR ok = FALSE;"], "SELECT * FROM (VALUES (CAST(2 AS INTEGER)), (3)) t(k)"),
    "update_qualified_where": (["UPDATE part SET p_size = 0 WHERE part.p_size < 10 AND part.p_brand = 'Brand#11';", "SELECT p_partkey, p_size FROM part;"], "SELECT p_partkey, CAST(CASE WHEN p_size < 10 AND p_brand = 'Brand#11' THEN 0 ELSE p_size END AS INTEGER) AS p_size FROM part"),
    "delete_qualified_where": (["DELETE FROM orders WHERE orders.o_orderstatus <> 'O' OR orders.o_totalprice > 100000.0;", "SELECT o_orderkey FROM orders;"], "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice <= 100000.0"),
    "update_repeated_target": (["UPDATE part SET p_size = 1, p_size = p_size + 100, p_retailprice = 5;", "SELECT p_partkey, p_size, p_retailprice FROM part;"], "SELECT p_partkey, CAST(p_size + 100 AS INTEGER) AS p_size, CAST(5 AS DOUBLE) AS p_retailprice FROM part"),
    "update_old_values": (["UPDATE part SET p_size = p_size + 1, p_retailprice = p_retailprice * 2.0 WHERE p_size > 25;", "SELECT p_partkey, p_size, p_retailprice FROM part;"],
        "SELECT p_partkey, CAST(CASE WHEN p_size > 25 THEN p_size + 1 ELSE p_size END AS INTEGER) AS p_size, CASE WHEN p_size > 25 THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice FROM part"),
    "many_changes": (["DELETE FROM part WHERE p_size > 40;", "UPDATE part SET p_size = 41 WHERE p_size < 5;", "INSERT INTO part VALUES (900001, 'a', 'b', 'c', 7, 1.0);", "DELETE FROM part WHERE p_size = 41;", "SELECT p_partkey, p_size FROM part;"],
        "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 40 UNION ALL SELECT 900001, 7"),
    "index_point": (["CREATE INDEX i ON orders (o_orderkey);", "SELECT * FROM orders WHERE o_orderkey = 7;"], "SELECT * FROM orders WHERE o_orderkey = 7"),
    "index_range": (["CREATE INDEX i ON orders (o_totalprice);", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 490000.0;"], "SELECT o_orderkey FROM orders WHERE o_totalprice >= 490000.0"),
    "index_join": (
        ["CREATE INDEX i ON customer (c_custkey);", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE orders.o_orderstatus = 'P';"],
        "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE orders.o_orderstatus = 'P'",
    ),
    "index_after_update": (
        ["CREATE INDEX i ON part (p_size);", "UPDATE part SET p_size = 51 WHERE p_size = 50;", "SELECT p_partkey, p_size FROM part WHERE p_size > 49;"],
        "SELECT p_partkey, CAST(51 AS INTEGER) AS p_size FROM part WHERE p_size = 50",
    ),
    "create_insert_select": (
        ["CREATE TABLE t (id INTEGER, name VARCHAR(50), score FLOAT, ok BOOLEAN);", "INSERT INTO t VALUES (1, 'Alice', 1.5, TRUE), (2, 'Bob', -2.5, FALSE);", "SELECT * FROM t;"],
        "SELECT * FROM (VALUES (CAST(1 AS INTEGER), 'Alice', CAST(1.5 AS DOUBLE), TRUE), (2, 'Bob', -2.5, FALSE)) t(id, name, score, ok)",
    ),
    "drop_and_create": (
        ["CREATE TABLE t (id INTEGER);", "INSERT INTO t VALUES (1);", "CREATE INDEX i ON t (id);", "DROP TABLE t;", "CREATE TABLE t (id INTEGER);", "INSERT INTO t VALUES (2), (3);", "CREATE INDEX i ON t (id);", "SELECT id FROM t WHERE id > 0;"],
        "SELECT * FROM (VALUES (CAST(2 AS INTEGER)), (3)) t(id)",
    ),
    "update_where": (["UPDATE part SET p_size = 99 WHERE p_size > 40;", "SELECT p_partkey, p_size FROM part;"], "SELECT p_partkey, CASE WHEN p_size > 40 THEN CAST(99 AS INTEGER) ELSE p_size END AS p_size FROM part"),
    "update_swap": (["UPDATE customer SET c_name = c_mktsegment, c_mktsegment = c_name;", "SELECT c_custkey, c_name, c_mktsegment FROM customer;"], "SELECT c_custkey, c_mktsegment AS c_name, c_name AS c_mktsegment FROM customer"),
    "delete_where": (["DELETE FROM orders WHERE o_orderstatus = 'F';", "SELECT o_orderkey, o_orderstatus FROM orders;"], "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F')"),
    "delete_all": (["DELETE FROM region;", "SELECT * FROM region;"], "SELECT * FROM region WHERE FALSE"),
    **{
        f"arith_{name}": ([f"UPDATE part SET p_size = p_size {op} 7;", "SELECT p_partkey, p_size FROM part;"], f"SELECT p_partkey, CAST(p_size {sql} 7 AS INTEGER) AS p_size FROM part")
        for name, op, sql in (("add", "+", "+"), ("sub", "-", "-"), ("mul", "*", "*"), ("div", "/", "//"))
    },
}


def _engine(spark: SparkSession, null_mode: str = "three_valued") -> Engine:
    """Its tables are copies in a folder that goes when the driver ends."""
    return Engine(spark, null_mode=null_mode)


def engine_on(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine with the driver's tables registered."""
    engine = _engine(spark)
    for name in TABLES:
        engine.register_parquet(name, f"{sf_dir}/{name}.parquet")
    return engine


def _needed(spark: SparkSession, sf_dir: str, statements: list[str]) -> Engine:
    """Only the tables that the statements name, so that the others' files aren't opened."""
    engine, text = _engine(spark), " ".join(statements)
    for name in TABLES:
        if name in text:
            engine.register_parquet(name, f"{sf_dir}/{name}.parquet")
    return engine


def run(spark: SparkSession, sf_dir: str, *statements: str) -> DataFrame:
    """All statements; the frame of the last."""
    engine = _needed(spark, sf_dir, list(statements))
    for text in statements:
        result = engine.sql(text)
        if not result.success:
            raise RuntimeError(f"{text} {result.message}")
    return result.frame


def _saved(spark: SparkSession, sf_dir: str, table: str, *statements: str) -> DataFrame:
    """A copy, indexed and saved, and what another engine that loads it answers."""
    engine = _needed(spark, sf_dir, [table])
    engine.copy_table("d", table)
    for text in statements[:-1]:
        engine.sql(text)
    engine.save()
    again = Engine(spark, engine.catalog.folder)
    again.load()
    return again.sql(statements[-1]).frame


def save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts."""
    return _saved(spark, sf_dir, "documents", "SELECT * FROM d;")


def save_load_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saved(spark, sf_dir, "lineitem", "SELECT * FROM d;")


def save_load_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index is used by the engine that loads it."""
    return _saved(spark, sf_dir, "customer", "CREATE INDEX i ON d (c_custkey);", "DELETE FROM d WHERE c_acctbal < 0.0;", "SELECT c_custkey, c_name, c_acctbal FROM d WHERE c_custkey <= 200;")


def index_lookup(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """Direct use of an index on part (p_size)."""

    def go(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = _needed(spark, sf_dir, ["part"])
        engine.sql("CREATE INDEX i ON part (p_size);")
        index = engine.index("i")
        if kind == "is_empty":
            before = index.is_empty()
            engine.sql("DELETE FROM part;")
            return spark.createDataFrame([(before, index.is_empty())], "before boolean, after boolean")
        frame = {"search": lambda: index.search(10), "range": lambda: index.range(10, 20, high_inclusive=False), "entries": index.entries}[kind]()
        return frame.select("p_partkey", "p_size")

    return go


def nulls(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    """Comparisons of nulls; the keys of region 2 are null."""

    def go(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = _engine(spark, mode)
        nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
        engine.register_frame("n", nation.selectExpr("n_nationkey as k", "nullif(n_regionkey, 2) as r"))
        return engine.sql("SELECT k FROM n WHERE r <= 1 OR r <> r OR r > 3;").frame

    return go


#: Statements in order, and the messages that they end with.
MESSAGES = [
    ("CREATE TABLE t (id INTEGER, f FLOAT, s VARCHAR(5), b BOOLEAN);", "Table 't' created."),
    ("CREATE TABLE t (id INTEGER);", "Table 't' already exists."),
    ("INSERT INTO t VALUES (1, 1, 'a', TRUE), (2, 2.5, 'bb', FALSE), (3, 0.5, 'much longer', 1 < 2);", "3 row(s) inserted."),
    ("INSERT INTO t VALUES (4, 1.0, 'c', TRUE), (5, 1.0);", "Column count mismatch: expected 4, got 2"),
    ("INSERT INTO t VALUES (4, 1.0, 'c', TRUE), (1 / 0, 1.0, 'c', TRUE);", "Division by zero"),
    ("INSERT INTO t VALUES ('4', 1.0, 'c', TRUE);", "Type mismatch: Expected INTEGER for column id, got VARCHAR"),
    ("INSERT INTO nope VALUES (1);", "Table not found: nope"),
    ("UPDATE t SET id = id * 10 WHERE id >= 2;", "2 row(s) updated."),
    ("UPDATE t SET id = id / (id - 1);", "Division by zero"),
    ("UPDATE t SET nope = 1;", "Unknown column: nope"),
    ("UPDATE t SET id = 1 WHERE u.id = 1;", "Unknown table qualifier in column: u.id"),
    ("UPDATE t SET id = 1.5;", "Type mismatch: Expected INTEGER for column id, got FLOAT"),
    ("DELETE FROM t WHERE id > 'a';", "Cannot compare different types: INTEGER > VARCHAR"),
    ("DELETE FROM t WHERE id + 1;", "Type mismatch: Expected BOOLEAN"),
    ("DELETE FROM t WHERE id = 20;", "1 row(s) deleted."),
    ("DELETE FROM t WHERE id = 20;", "0 row(s) deleted."),
    ("CREATE INDEX i ON t (id);", "Index 'i' created on t(id)."),
    ("CREATE INDEX i ON t (f);", "Failed to create index 'i'. Table or column may not exist, or index name is already taken."),
    ("SELECT nope FROM t;", "Unknown column: nope"),
    ("SELECT Id FROM t;", "Unknown column: Id"),
    ("SELECT id FROM t JOIN t ON t.id = t.nope;", "Invalid JOIN columns in ON clause: t.id = t.nope"),
    ("SELECT * FROM t JOIN nope ON t.id = nope.id;", "Join table not found: nope"),
    ("DELETE FROM t;", "2 row(s) deleted."),
    ("DROP TABLE t;", "Table 't' dropped."),
    ("DROP TABLE t;", "Table 't' does not exist."),
]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each statement says, failures included, which change nothing."""
    engine = _engine(spark)
    said = [(k, engine.sql(text).message) for k, (text, _) in enumerate(MESSAGES)]
    return spark.createDataFrame(said, "line int, message string")


def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _needed(spark, sf_dir, ["nation region part"]).show_tables()


def explain_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan's lines."""
    text = _needed(spark, sf_dir, ["customer orders"]).sql(f"EXPLAIN {FLAGSHIP}").message
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line int, plan string")


def explain_index_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _needed(spark, sf_dir, ["customer orders"])
    engine.sql("CREATE INDEX i ON customer (c_custkey);")
    text = engine.sql("EXPLAIN SELECT * FROM orders JOIN customer ON customer.c_custkey = orders.o_custkey WHERE o_orderstatus = 'P';").message
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line int, plan string")


def explain_logical(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _needed(spark, sf_dir, ["customer orders"]).logical_plan(FLAGSHIP)
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line int, plan string")


#: Lines of the plans, indented by two spaces a level.
PLANS = {
    "explain_join": [
        "Projection(columns=[c_custkey, o_orderkey, o_totalprice])", "  HashJoin(left=customer, right=orders, on=c_custkey = o_custkey, build=left)", "    SeqScan(table=customer)",
        "    Filter", "      predicate:", "        BinaryOp(GT)", "          Column(o_totalprice)", "          Literal(400000.000000)", "      SeqScan(table=orders)",
    ],
    "explain_index_join": [
        "Projection(columns=*)", "  IndexNestedLoopJoin(outer=orders, inner=customer(index on c_custkey), on=customer.c_custkey = orders.o_custkey)",
        "    Filter", "      predicate:", "        BinaryOp(EQ)", "          Column(o_orderstatus)", "          Literal(P)", "      SeqScan(table=orders)", "    SeqScan(table=customer)",
    ],
    "explain_logical": [
        "Projection(columns=[c_custkey, o_orderkey, o_totalprice])", "  Filter", "    predicate:", "      BinaryOp(GT)", "        Column(o_totalprice)", "        Literal(400000.000000)",
        "    Join(type=inner, on=c_custkey = o_custkey)", "      SeqScan(table=customer)", "      SeqScan(table=orders)",
    ],
}
#: Queries made by functions, with their SQL.
MADE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "save_load": (save_load, "SELECT * FROM documents"),
    "save_load_doubles": (save_load_doubles, "SELECT * FROM lineitem"),
    "save_load_index": (save_load_index, "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 0.0 AND c_custkey <= 200"),
    "index_search": (index_lookup("search"), "SELECT p_partkey, p_size FROM part WHERE p_size = 10"),
    "index_two_sided_range": (index_lookup("range"), "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20"),
    "index_entries": (index_lookup("entries"), "SELECT p_partkey, p_size FROM part"),
    "index_is_empty": (index_lookup("is_empty"), "SELECT FALSE AS before, TRUE AS after"),
    "nulls_three_valued": (nulls("three_valued"), "SELECT k FROM (SELECT n_nationkey AS k, nullif(n_regionkey, 2) AS r FROM nation) WHERE r <= 1 OR r <> r OR r > 3"),
    "nulls_two_valued": (nulls("two_valued"), "SELECT n_nationkey AS k FROM nation WHERE n_regionkey <> 3"),
    "explain_join": (explain_join, ""),
    "explain_index_join": (explain_index_join, ""),
    "explain_logical": (explain_logical, ""),
}


def _lines(name: str, lines: list[str]) -> str:
    quoted = ", ".join(f"(CAST({k} AS INTEGER), '{x.replace(chr(39), 2 * chr(39))}')" for k, x in enumerate(lines))
    return f"SELECT * FROM (VALUES {quoted}) t(line, {name})"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    texts = {**{k: [v] for k, v in SELECTS.items()}, **{k: [v] for k, (v, _) in OTHERS.items()}, **{k: v for k, (v, _) in SCRIPTS.items()}}
    out = {k: (lambda spark, sf_dir, s=s: run(spark, sf_dir, *s)) for k, s in texts.items()}
    return out | {"show_tables": show_tables, "messages": messages} | {k: f for k, (f, _) in MADE.items()}


def oracle_sql() -> dict[str, str]:
    same = {k: v.rstrip(";") for k, v in SELECTS.items()}
    other = {k: sql for k, (_, sql) in {**OTHERS, **SCRIPTS, **MADE}.items()} | {k: _lines("plan", x) for k, x in PLANS.items()}
    tables = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS row_count, '{c}' AS columns FROM {t}" for t, c in (("region", "r_regionkey, r_name"), ("nation", "n_nationkey, n_name, n_regionkey"), ("part", "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice")))
    return {**same, **other, "show_tables": tables, "messages": _lines("message", [m for _, m in MESSAGES])}
