"""Statements from text to rows."""

import pytest

from veldra import Engine, EngineError, ParseError

PLANTS = ("CREATE TABLE plants (id INTEGER, kind VARCHAR(40));", "INSERT INTO plants VALUES (5, 'fern'), (3, 'moss'), (8, 'oak'), (9, 'reed');")
CUTS = ("CREATE TABLE cuts (id INTEGER, plant INTEGER, grams FLOAT);", "INSERT INTO cuts VALUES (40, 8, 1.5), (41, 3, 12.0), (42, 3, 0.5), (43, 2, 7.25), (44, 3, 3.0);")
SHELF = ("CREATE TABLE shelf (slot INTEGER, load INTEGER);", "INSERT INTO shelf VALUES (1, 26), (2, 7), (3, 15), (5, 40), (8, 15);")


def fails(engine, text, part=""):
    result = engine.sql(text)
    assert not result.success and part in result.message, result.message


def test_create_insert_select(run):
    assert run(*PLANTS, "SELECT * FROM plants;") == [(5, "fern"), (3, "moss"), (8, "oak"), (9, "reed")]
    assert run("INSERT INTO plants VALUES (7, 'elm');", "SELECT kind FROM plants WHERE id > 6;") == [("oak",), ("reed",), ("elm",)]


def test_messages(engine):
    assert engine.sql(PLANTS[0]).message == "Table 'plants' created."
    assert engine.sql(PLANTS[1]).message == "4 row(s) inserted."
    assert engine.sql("UPDATE plants SET kind = 'X' WHERE id > 4;").message == "3 row(s) updated."
    assert engine.sql("DELETE FROM plants WHERE id = 3;").message == "1 row(s) deleted."
    assert engine.sql("CREATE INDEX i ON plants (id);").message == "Index 'i' created on plants(id)."
    assert engine.sql("DROP TABLE plants;").message == "Table 'plants' dropped."


def test_errors(engine, run):
    run(*PLANTS, *CUTS)
    fails(engine, PLANTS[0], "already exists")
    fails(engine, "INSERT INTO plants VALUES (1);", "Column count mismatch: expected 2, got 1")
    fails(engine, "INSERT INTO nope VALUES (1);", "Table not found: nope")
    fails(engine, "SELECT * FROM nope;", "Table not found: nope")
    fails(engine, "SELECT * FROM plants JOIN nope ON id = x;", "Join table not found: nope")
    fails(engine, "DROP TABLE nope;", "does not exist")
    fails(engine, "SELECT nope FROM plants;", "Unknown column: nope")
    fails(engine, "SELECT ID FROM plants;", "Unknown column: ID")
    fails(engine, "UPDATE plants SET nope = 1;", "Unknown column: nope")
    fails(engine, "UPDATE plants SET id = 9 WHERE cuts.id = 1;", "Unknown table qualifier in column")
    fails(engine, "DELETE FROM plants WHERE cuts.id = 1;", "Unknown table qualifier in column")
    fails(engine, "SELECT id FROM plants JOIN cuts ON plants.id = cuts.plant;", "Ambiguous column reference: id")
    fails(engine, "SELECT plants.id FROM plants JOIN cuts ON plants.id = cuts.plant WHERE id > 1;", "Ambiguous")
    fails(engine, "SELECT * FROM plants JOIN cuts ON plants.nope = cuts.plant;", "Invalid JOIN columns in ON clause")
    fails(engine, "SELECT * FROM plants JOIN cuts ON x.id = cuts.plant;", "Invalid JOIN columns in ON clause")
    fails(engine, "INSERT INTO plants VALUES (id, 'x');", "Column reference without tuple context")
    fails(engine, "SELECT * FROM plants WHERE id;", "Expected BOOLEAN")
    fails(engine, "SELECT * FROM plants WHERE id AND TRUE;", "Expected BOOLEAN")
    with pytest.raises(ParseError):
        engine.sql("SELEC * FROM plants;")


def test_names_are_checked_on_empty_tables_too(engine, run):
    run("CREATE TABLE e (a INTEGER);")
    fails(engine, "SELECT * FROM e WHERE nope = 1;", "Unknown column: nope")
    assert run("SELECT * FROM e;") == []
    assert engine.sql("UPDATE e SET a = 1;").message == "0 row(s) updated."
    assert engine.sql("DELETE FROM e;").message == "0 row(s) deleted."


def test_where_forms(run):
    run(*SHELF)
    slots = lambda where: [r[0] for r in run(f"SELECT slot FROM shelf WHERE {where};")]
    assert slots("load = 15") == [3, 8]
    assert slots("load <> 15") == slots("load != 15") == [1, 2, 5]
    assert slots("load < 15") == [2] and slots("load <= 15") == [2, 3, 8]
    assert slots("load > 26") == [5] and slots("load >= 26") == [1, 5]
    assert slots("20 < load") == [1, 5]
    assert slots("slot = 1 OR slot = 2 AND load = 0") == [1]
    assert slots("(slot = 1 OR slot = 2) AND load > 10") == [1]
    assert slots("TRUE") == [1, 2, 3, 5, 8] and slots("FALSE") == []
    assert slots("load + slot * 5 = 30") == [3]
    assert slots("load / 13 = 1") == [3, 8]
    assert slots("load - slot > 20") == [1, 5]
    assert slots("slot > -1") == [1, 2, 3, 5, 8]


def test_families_do_not_mix(engine, run):
    run(*SHELF)
    assert run("SELECT slot FROM shelf WHERE slot = '2';") == []
    assert len(run("SELECT slot FROM shelf WHERE slot <> '2';")) == 5
    assert run("SELECT slot FROM shelf WHERE slot = 2.0;") == []
    fails(engine, "SELECT slot FROM shelf WHERE slot > '2';", "Cannot compare different types")
    fails(engine, "SELECT slot FROM shelf WHERE slot + 1.0 = 2;", "Type mismatch")
    fails(engine, "SELECT slot FROM shelf WHERE slot + 'x' = 2;", "Type mismatch")


def test_division(engine, run):
    run(*SHELF)
    with pytest.raises(EngineError, match="Division by zero"):
        engine.sql("SELECT * FROM shelf WHERE slot / 0 = 1;").collect()
    assert list(engine.sql("SELECT * FROM shelf WHERE slot / (slot - slot) = 1;").lines()) == ["Error: Division by zero"]
    fails(engine, "UPDATE shelf SET load = load / 0;", "Division by zero")
    assert run("SELECT load FROM shelf WHERE slot = 1;") == [(26,)]  # nothing has changed
    assert run("UPDATE shelf SET load = (slot - 8) / 2;", "SELECT load FROM shelf;") == [(-3,), (-3,), (-2,), (-1,), (0,)]


def test_insert_is_strict_and_whole(engine, run):
    run("CREATE TABLE n (id INTEGER, f FLOAT);")
    fails(engine, "INSERT INTO n VALUES ('x', 1.0);", "Type mismatch")
    fails(engine, "INSERT INTO n VALUES (1, 1.0), (2);", "Column count mismatch")
    fails(engine, "INSERT INTO n VALUES (1, 1.0), (2 / 0, 1.0);", "Division by zero")
    assert run("SELECT * FROM n;") == []
    assert run("INSERT INTO n VALUES (1, 1), (1 + 2 * 3, 0.5 * 3.0);", "SELECT * FROM n;") == [(1, 1.0), (7, 1.5)]


def test_booleans_and_constants(run):
    run("CREATE TABLE b (id INTEGER, ok BOOLEAN);", "INSERT INTO b VALUES (1, TRUE), (2, 1 = 2), (3, 'a' < 'b');")
    assert run("SELECT id FROM b WHERE ok;") == [(1,), (3,)]
    assert run("SELECT id FROM b WHERE ok = FALSE;") == [(2,)]


def test_update(run):
    assert run(*SHELF, "UPDATE shelf SET load = 99 WHERE slot = 2;", "SELECT load FROM shelf;") == [(26,), (99,), (15,), (40,), (15,)]
    assert run("UPDATE shelf SET load = 0;", "SELECT load FROM shelf WHERE shelf.slot = 1;") == [(0,)]
    assert run("UPDATE shelf SET slot = load, load = slot WHERE slot = 3;", "SELECT * FROM shelf;")[2] == (0, 3)
    assert run("UPDATE shelf SET load = 5, load = 6 WHERE slot = 1;", "SELECT load FROM shelf;")[0] == (6,)


def test_update_is_strict(engine, run):
    run("CREATE TABLE s (a INTEGER, f FLOAT, x VARCHAR(1));", "INSERT INTO s VALUES (1, 1.0, 'a');")
    fails(engine, "UPDATE s SET a = 'x';", "Type mismatch")
    fails(engine, "UPDATE s SET a = 1.5;", "Type mismatch")
    assert run("UPDATE s SET f = 3, x = 'longer than declared';", "SELECT f, x FROM s;") == [(3.0, "longer than declared")]


def test_delete(run, engine):
    assert run(*SHELF, "DELETE FROM shelf WHERE load > 10 AND load < 40;", "SELECT slot FROM shelf;") == [(2,), (5,)]
    assert engine.sql("DELETE FROM shelf;").message == "2 row(s) deleted."
    assert run("SELECT * FROM shelf;") == []
    assert run("INSERT INTO shelf VALUES (7, 7);", "SELECT * FROM shelf;") == [(7, 7)]


def test_joins(run):
    run(*PLANTS, *CUTS)
    wanted = [("moss", 41), ("moss", 42), ("moss", 44), ("oak", 40)]
    assert run("SELECT plants.kind, cuts.id FROM plants JOIN cuts ON plants.id = cuts.plant;") == wanted
    assert run("SELECT kind, cuts.id FROM plants INNER JOIN cuts ON cuts.plant = plants.id;") == wanted
    assert run("SELECT kind, cuts.id FROM plants JOIN cuts ON id = plant;") == wanted
    assert run("SELECT * FROM plants JOIN cuts ON plants.id = cuts.plant;")[0] == (3, "moss", 41, 3, 12.0)
    assert run("SELECT kind FROM plants JOIN cuts ON plants.id = cuts.plant WHERE cuts.grams > 1.0;") == [("moss",), ("moss",), ("oak",)]
    assert run("SELECT cuts.id FROM plants JOIN cuts ON plants.id = cuts.plant WHERE plants.kind = 'moss';") == [(41,), (42,), (44,)]
    assert run("SELECT grams FROM plants JOIN cuts ON plants.id = cuts.plant WHERE plants.id = 8 OR cuts.grams > 5.0;") == [(12.0,), (1.5,)]


def test_output_names_may_repeat(engine, run):
    run(*PLANTS, *CUTS)
    result = engine.sql("SELECT plants.id, cuts.id, plants.id FROM plants JOIN cuts ON plants.id = cuts.plant;")
    assert result.column_names == ["id", "id", "id"] and result.frame.columns == ["id", "id", "id"]
    assert tuple(result.collect()[0]) == (3, 41, 3)


def test_swapped_on_goes_by_qualifier(run):
    run("CREATE TABLE a (n INTEGER, m INTEGER);", "INSERT INTO a VALUES (4, 6), (5, 4);", "CREATE TABLE b (n INTEGER, m INTEGER);", "INSERT INTO b VALUES (6, 8), (9, 5);")
    assert run("SELECT a.n, b.n FROM a JOIN b ON b.n = a.m;") == [(4, 6)]


def test_join_of_different_families_is_empty(run):
    run(*PLANTS, "CREATE TABLE s (k VARCHAR(5));", "INSERT INTO s VALUES ('3');")
    assert run("SELECT * FROM plants JOIN s ON plants.id = s.k;") == []
    assert run("CREATE INDEX i ON s (k);", "SELECT * FROM plants JOIN s ON plants.id = s.k;") == []


def test_self_join(run):
    run(*SHELF)
    assert run("SELECT shelf.slot FROM shelf JOIN shelf ON shelf.load = shelf.load WHERE shelf.slot > 2;") == [(3,), (3,), (5,), (8,), (8,)]
    assert run("SELECT * FROM shelf JOIN shelf ON shelf.slot = shelf.slot WHERE shelf.slot = 1;") == [(1, 26, 1, 26)]


def test_larger_join(run):
    rows = ", ".join(f"({3 * k}, 'p{k}')" for k in range(12))
    cuts = ", ".join(f"({k}, {k * k})" for k in range(10))
    run("CREATE TABLE plants (id INTEGER, kind VARCHAR(9));", f"INSERT INTO plants VALUES {rows};", "CREATE TABLE cuts (id INTEGER, plant INTEGER);", f"INSERT INTO cuts VALUES {cuts};")
    assert run("SELECT cuts.id, kind FROM plants JOIN cuts ON plants.id = cuts.plant WHERE plants.id < 30;") == [(0, "p0"), (3, "p3")]


def test_indexes(engine, run):
    run(*SHELF, "CREATE INDEX i ON shelf (load);")
    fails(engine, "CREATE INDEX i ON shelf (slot);", "already taken")
    fails(engine, "CREATE INDEX j ON nope (slot);", "may not exist")
    fails(engine, "CREATE INDEX j ON shelf (nope);", "may not exist")
    run("INSERT INTO shelf VALUES (9, 10), (4, 15);")
    assert run("SELECT slot FROM shelf WHERE load = 15;") == [(3,), (8,), (4,)]
    assert run("SELECT slot FROM shelf WHERE load >= 15;") == [(3,), (8,), (4,), (1,), (5,)]
    assert run("SELECT slot FROM shelf WHERE load < 15;") == [(2,), (9,)]
    assert run("UPDATE shelf SET load = 1 WHERE slot = 5;", "SELECT slot FROM shelf WHERE load <= 10;") == [(5,), (2,), (9,)]
    assert run("DELETE FROM shelf WHERE load = 15;", "SELECT slot FROM shelf WHERE load > 0;") == [(5,), (2,), (9,), (1,)]
    assert run("SELECT slot FROM shelf WHERE load = '15';") == []


def test_the_index_copy_is_pruned_by_its_predicate(engine, run):
    run(*SHELF, "CREATE INDEX i ON shelf (load);")
    plan = engine.spark_plan("SELECT slot FROM shelf WHERE load = 15;")
    assert "/shelf/index-" in plan and "EqualTo(c1,15)" in plan and "ReadSchema: struct<c0:int,c1:int>" in plan


def test_index_lookups(engine, run):
    run(*SHELF, "INSERT INTO shelf VALUES (9, 26), (4, 2);", "CREATE INDEX i ON shelf (load);")
    rows = lambda frame: [tuple(r) for r in frame.collect()]
    index = engine.index("i")
    assert rows(index.search(26)) == [(1, 26), (9, 26)] and rows(index.search(27)) == []
    assert rows(index.range(7, 15)) == [(2, 7), (3, 15), (8, 15)]
    assert rows(index.range(7, 40, low_inclusive=False, high_inclusive=False)) == [(3, 15), (8, 15), (1, 26), (9, 26)]
    assert rows(index.range(high=7)) == [(4, 2), (2, 7)] and rows(index.range(low=40)) == [(5, 40)]
    assert [r[1] for r in rows(index.entries())] == [2, 7, 15, 15, 26, 26, 40] and not index.is_empty()
    run("DELETE FROM shelf;")
    assert index.is_empty()
    with pytest.raises(EngineError, match="Index not found"):
        engine.index("nope")


def test_filters_stay_with_an_index_join(engine, run):
    run(*PLANTS, *CUTS, "CREATE INDEX i ON plants (id);", "SELECT * FROM plants WHERE id = 3;")
    assert engine.catalog.is_current(engine.catalog.indexes["i"])
    assert run("SELECT cuts.id, kind FROM cuts JOIN plants ON cuts.plant = plants.id;") == [(40, "oak"), (41, "moss"), (42, "moss"), (44, "moss")]
    assert run("SELECT cuts.id, kind FROM cuts JOIN plants ON plants.id = cuts.plant WHERE cuts.grams < 2.0;") == [(40, "oak"), (42, "moss")]
    assert run("SELECT cuts.id, kind FROM cuts JOIN plants ON plants.id = cuts.plant WHERE plants.kind = 'oak' AND cuts.id > 3;") == [(40, "oak")]


def test_an_index_join_reads_the_index(engine, run):
    """EXPLAIN says what runs, before and after changes."""
    run(*PLANTS, *CUTS, "CREATE INDEX i ON plants (id);")
    text = "SELECT kind FROM plants JOIN cuts ON plants.id = cuts.plant;"
    for n in (4, 3):
        assert "IndexNestedLoopJoin(outer=cuts, inner=plants(index on id)" in explain(engine, text)
        assert "/plants/index-" in engine.spark_plan(text) and len(run(text)) == n
        run("DELETE FROM plants WHERE kind = 'oak';")


def test_drop_takes_indexes_along(engine, run):
    run(*SHELF, "CREATE INDEX i ON shelf (slot);", "SELECT * FROM shelf WHERE slot = 1;", "DROP TABLE shelf;", "CREATE TABLE shelf (slot INTEGER);", "INSERT INTO shelf VALUES (9);", "CREATE INDEX i ON shelf (slot);")
    assert run("SELECT * FROM shelf WHERE slot > 0;") == [(9,)]


def explain(engine, text):
    result = engine.sql(f"EXPLAIN {text}")
    assert result.success, result.message
    return result.message


def test_explain(engine, run):
    run(*PLANTS, "CREATE TABLE cuts (id INTEGER, plant INTEGER, grams FLOAT);", "INSERT INTO cuts VALUES (40, 8, 1.5), (41, 3, 12.0), (42, 3, 0.5), (44, 9, 2.5);")
    text = explain(engine, "SELECT plants.id, cuts.grams FROM plants JOIN cuts ON plants.id = cuts.plant WHERE cuts.grams > 1.0;")
    assert text.split("\n")[0] == "Projection(columns=[plants.id, cuts.grams])"
    assert "NestedLoopJoin(left=plants, right=cuts, on=plants.id = cuts.plant, outer=left)" in text
    assert text.index("NestedLoopJoin") < text.index("Filter") < text.index("SeqScan(table=cuts)") and "BinaryOp(GT)" in text
    text = explain(engine, "SELECT * FROM plants JOIN cuts ON plants.id = cuts.plant WHERE plants.id > 1 AND cuts.id > 1;")
    assert text.index("Filter") < text.index("NestedLoopJoin")
    assert explain(engine, "SELECT * FROM plants;") == "Projection(columns=*)\n  SeqScan(table=plants)"
    run("CREATE INDEX i ON plants (id);")
    assert "IndexScan(table=plants, column=id, point=3)" in explain(engine, "SELECT * FROM plants WHERE id = 3;")
    assert "low=3 (exclusive), high=null" in explain(engine, "SELECT * FROM plants WHERE id > 3;")
    assert "low=null (exclusive), high=3 (inclusive)" in explain(engine, "SELECT * FROM plants WHERE id <= 3;")
    assert "SeqScan" in explain(engine, "SELECT * FROM plants WHERE id = '3';")
    assert "SeqScan" in explain(engine, "SELECT * FROM plants WHERE 3 = id;")
    assert "IndexNestedLoopJoin(outer=cuts, inner=plants(index on id)" in explain(engine, "SELECT * FROM plants JOIN cuts ON cuts.plant = plants.id;")
    run("DELETE FROM cuts WHERE id > 40;", "DROP TABLE plants;", *PLANTS)
    assert "outer=right" in explain(engine, "SELECT * FROM plants JOIN cuts ON plants.id = cuts.plant;")
    run("INSERT INTO plants VALUES " + ", ".join(f"({k}, 'x')" for k in range(20)) + ";")
    assert "HashJoin(left=plants, right=cuts, on=plants.id = cuts.plant, build=right)" in explain(engine, "SELECT * FROM plants JOIN cuts ON plants.id = cuts.plant;")
    fails(engine, "EXPLAIN SELECT nope FROM plants;", "Unknown column")


def test_logical_plan(engine, run):
    run(*PLANTS, *CUTS, "CREATE INDEX i ON plants (id);")
    text = engine.logical_plan("SELECT kind FROM plants JOIN cuts ON plants.id = cuts.plant WHERE cuts.id = 41;")
    assert text == "\n".join(
        ["Projection(columns=[kind])", "  Filter", "    predicate:", "      BinaryOp(EQ)", "        Column(cuts.id)", "        Literal(41)", "    Join(type=inner, on=plants.id = cuts.plant)", "      SeqScan(table=plants)", "      SeqScan(table=cuts)"]
    )
    assert engine.logical_plan("EXPLAIN SELECT * FROM plants;") == "Projection(columns=*)\n  SeqScan(table=plants)"
    for text in ("SELECT * FROM nope;", "DROP TABLE plants;"):
        with pytest.raises(EngineError):
            engine.logical_plan(text)


def test_save_and_load(spark, engine, run):
    texts = ["a  b ", "", "tab\there", "ünï 日本", "line\nbreak"]
    run("CREATE TABLE p (id INTEGER, s VARCHAR(9), f FLOAT, b BOOLEAN);", "CREATE INDEX i ON p (id);")
    run(*[f"INSERT INTO p VALUES ({k}, '{s}', 3.141592653589793, TRUE);" for k, s in enumerate(texts)])
    engine.save()
    again = Engine(spark, engine.catalog.folder)
    assert again.load() == 1
    assert [tuple(r) for r in again.sql("SELECT * FROM p;").collect()] == [(k, s, 3.141592653589793, True) for k, s in enumerate(texts)]
    assert "IndexScan" in again.sql("EXPLAIN SELECT * FROM p WHERE id = 1;").message
    assert again.catalog.table("p").columns[1].length == 9
    engine.sql("DELETE FROM p WHERE id > 0;")
    engine.save()
    assert again.sql("SELECT * FROM p;").frame.count() == 5
    assert engine.catalog.vacuum() == 4
    assert run("SELECT id FROM p;") == [(0,)]
    assert Engine(spark, engine.catalog.folder + "-none").load() == 0


def test_changes_write_touched_files_only(engine, run):
    run("CREATE TABLE k (a INTEGER);", *[f"INSERT INTO k VALUES ({10 * k}), ({10 * k + 1});" for k in range(4)])
    before = engine.catalog.table("k").segments
    run("UPDATE k SET a = 99 WHERE a = 11;")
    after = engine.catalog.table("k").segments
    assert [s in after for s in before] == [True, False, True, True] and len(after) == 4 and not engine.catalog.table("k").without
    assert run("SELECT a FROM k;") == [(0,), (1,), (10,), (99,), (20,), (21,), (30,), (31,)]
    run("DELETE FROM k WHERE a > 20 AND a < 31;", "UPDATE k SET a = 5 WHERE a = 1000;")
    assert engine.catalog.table("k").segments[0] == before[0] and engine.catalog.table("k").rows == 6
    engine.catalog.vacuum()
    assert run("SELECT a FROM k;") == [(0,), (1,), (10,), (99,), (20,), (31,)]


def test_a_file_of_many_is_replaced(spark, engine, run):
    engine.register_frame("r", spark.range(100).repartitionByRange(5, "id").selectExpr("cast(id as int) as a", "cast(id as int) as `b c`"))
    engine.copy_table("k", "r")
    run("UPDATE k SET a = -1 WHERE a = 3;")
    table = engine.catalog.table("k")
    assert len(table.segments) == 2 and len(table.without) == 1  # a folder of files and a name, however many files there are
    assert "file_name" in engine.spark_plan("SELECT a FROM k;")
    engine.save()
    again = Engine(spark, engine.catalog.folder)
    again.load()
    assert sorted(r[0] for r in again.sql("SELECT a FROM k;").collect()) == sorted({*range(100)} - {3} | {-1})
    engine.catalog.vacuum()
    assert len(run("SELECT a FROM k;")) == 100 and engine.sql("DELETE FROM k WHERE a >= 0;").message == "99 row(s) deleted."
    assert run("SELECT * FROM k;") == [(-1, 3)] and not engine.catalog.table("k").without


def test_paths_are_split_once_a_file(spark, engine, run, monkeypatch):
    """A function of the path in every row took most of the time of a change."""
    from pyspark.sql import functions as F

    def never(*_):
        raise AssertionError("a regular expression in every row")

    engine.register_frame("r", spark.range(100).repartitionByRange(5, "id").selectExpr("cast(id as int) as a"))
    engine.copy_table("k", "r")
    for name in ("regexp_extract", "regexp_replace", "substring_index", "split"):
        monkeypatch.setattr(F, name, never)
    assert engine.sql("UPDATE k SET a = a + 7 WHERE a < 50;").message == "50 row(s) updated."
    assert engine.sql("DELETE FROM k WHERE a >= 90 OR a < 10;").message == "13 row(s) deleted."
    assert sorted(r[0] for r in run("SELECT a FROM k;")) == sorted(x for x in (a + 7 if a < 50 else a for a in range(100)) if 10 <= x < 90)


def test_a_small_insert_writes_its_rows_only(spark, engine, run):
    engine.register_frame("r", spark.range(40_000).repartition(40).selectExpr("cast(id as int) as a"))
    engine.copy_table("k", "r")
    run("UPDATE k SET a = -1 WHERE a = 3;")
    large = engine.catalog.table("k").segments
    run(*[f"INSERT INTO k VALUES ({-k});" for k in range(2, 40)])
    table = engine.catalog.table("k")
    assert set(large) <= set(table.segments) and sum(s.rows for s in table.segments if s not in large) == 38 and len(table.segments) < 20
    assert table.rows == 40_038 and engine.sql("SELECT a FROM k;").frame.where("a < 0").count() == 39


def test_vacuum_keeps_what_the_saved_catalog_has(spark, engine, run):
    run(*SHELF)
    engine.save()
    run("UPDATE shelf SET load = 0;")
    engine.catalog.vacuum()
    again = Engine(spark, engine.catalog.folder)
    again.load()
    assert [r[1] for r in again.sql("SELECT * FROM shelf;").collect()] == [26, 7, 15, 40, 15]
    assert run("SELECT load FROM shelf WHERE load > 0;") == []


def test_two_engines_do_not_overwrite_each_other(spark, engine, run):
    run(*SHELF)
    engine.save()
    other = Engine(spark, engine.catalog.folder)
    other.load()
    other.sql("DELETE FROM shelf WHERE slot = 1;")
    other.save()
    run("DELETE FROM shelf WHERE slot = 2;")
    with pytest.raises(EngineError, match="Another engine"):
        engine.save()
    engine.load()
    run("DELETE FROM shelf WHERE slot = 2;")
    engine.save()
    other.load()
    assert [r[0] for r in other.sql("SELECT slot FROM shelf;").collect()] == [3, 5, 8]


def test_indexes_follow_files_that_others_change(spark, engine, run, tmp_path):
    path = str(tmp_path / "x.parquet")
    spark.range(5).selectExpr("7 as k", "id as v").write.parquet(path)
    engine.register_parquet("p", path)
    run("CREATE INDEX i ON p (k);")
    assert len(run("SELECT v FROM p WHERE k = 7;")) == 5 and engine.show_tables().first()["row_count"] == 5
    spark.range(10).selectExpr("7 as k", "id as v").write.mode("append").parquet(path)
    assert len(run("SELECT v FROM p WHERE k = 7;")) == 15 and engine.show_tables().first()["row_count"] == 15
    engine.register_frame("f", spark.range(3))
    run("CREATE INDEX j ON f (id);")
    assert "SeqScan" in explain(engine, "SELECT * FROM f WHERE id = 1;") and "/f/index-" not in engine.spark_plan("SELECT * FROM f WHERE id = 1;")


def test_a_frequent_key_is_dealt_to_several_files(spark, engine, run):
    engine.register_frame("r", spark.range(20_000).selectExpr("cast(1 as int) as k", "id as v"))
    engine.copy_table("h", "r")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    run("CREATE INDEX i ON h (k);", "SELECT v FROM h WHERE k = 0;")
    spark.conf.unset(coalesce)
    files = spark.read.parquet(engine.catalog.indexes["i"].path).groupBy("_metadata.file_name").count().collect()
    assert len(files) == 4 and max(r["count"] for r in files) < 10_000
    assert run("SELECT v FROM h WHERE k = 1;") == [(v,) for v in range(20_000)]


def test_show_is_bounded(spark, engine):
    engine.register_frame("r", spark.range(5000))
    lines = list(engine.sql("SELECT * FROM r;").lines(3))
    assert len(lines) == 9 and lines[-1] == "Only the first 3 rows are shown." and len(list(engine.sql("SELECT * FROM r;").lines())) == 1006


def test_null_mode_of_changes(spark):
    for mode, n in (("three_valued", 1), ("two_valued", 2)):
        engine = Engine(spark, null_mode=mode)
        engine.register_frame("n", spark.createDataFrame([(None,), (1,), (7,)], "a int"))
        assert engine.sql("DELETE FROM n WHERE a <= 5;").message == f"{n} row(s) deleted."


def test_many_inserts_are_merged(engine, run):
    run("CREATE TABLE m (a INTEGER);", *[f"INSERT INTO m VALUES ({k});" for k in range(40)])
    assert len(engine.catalog.table("m").segments) < 20
    assert run("SELECT a FROM m;") == [(k,) for k in range(40)]


def test_registered_tables(spark, engine, run, tmp_path):
    frame = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "Id long, `odd.name` string, n int")
    path = str(tmp_path / "x.parquet")
    frame.write.parquet(path)
    engine.register_parquet("p", path)
    engine.register_frame("f", frame)
    assert sorted(run("SELECT * FROM p;")) == sorted(run("SELECT * FROM f;")) == [(1, "x", 5), (2, "y", 6)]
    run("UPDATE p SET Id = 7, n = n + 1 WHERE n = 5;")
    assert engine.catalog.table("p").managed and dict(engine.sql("SELECT * FROM p;").frame.dtypes)["Id"] == "bigint"
    assert sorted(run("SELECT Id, n FROM p;")) == [(2, 6), (7, 6)]
    assert spark.read.parquet(path).count() == 2 and spark.read.parquet(path).where("Id = 7").count() == 0
    engine.copy_table("c", "f")
    assert run("DELETE FROM c WHERE Id = 1;", "SELECT Id FROM c;") == [(2,)]


def test_show_tables_and_printing(engine, run):
    run(*PLANTS)
    assert [tuple(r) for r in engine.show_tables().collect()] == [("plants", 4, "id, kind")]
    lines = list(engine.sql("SELECT * FROM plants WHERE id = 3;").lines())
    assert lines[1] == "          id |         kind" and lines[-2] == "(1 row)"
    assert list(engine.sql("SELECT * FROM plants WHERE FALSE;").lines()) == ["(0 rows)"]
    assert list(engine.sql("SELECT * FROM nope;").lines()) == ["Error: Table not found: nope"]


NULLS = [(None, 1), (None, None), (1, None), (1, 1), (2, 1)]


@pytest.mark.parametrize(
    ("mode", "op", "wanted"),
    [
        ("three_valued", "=", [3]), ("three_valued", "<>", [4]), ("three_valued", "<=", [3]), ("three_valued", ">=", [3, 4]),
        ("two_valued", "=", [1, 3]), ("two_valued", "<>", [0, 2, 4]), ("two_valued", "<", []), ("two_valued", ">", [4]),
        ("two_valued", "<=", [0, 1, 2, 3]), ("two_valued", ">=", [0, 1, 2, 3, 4]),
    ],
)
def test_nulls(spark, mode, op, wanted):
    engine = Engine(spark, null_mode=mode)
    engine.register_frame("n", spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(NULLS)], "k int, a int, b int"))
    assert sorted(r[0] for r in engine.sql(f"SELECT k FROM n WHERE a {op} b;").collect()) == wanted


def test_null_join_keys(spark):
    frame = spark.createDataFrame([(None, 1), (2, 2)], "k int, v int")
    for mode, n in (("three_valued", 1), ("two_valued", 2)):
        engine = Engine(spark, null_mode=mode)
        engine.register_frame("a", frame)
        engine.register_frame("b", frame)
        assert engine.sql("SELECT * FROM a JOIN b ON a.k = b.k;").frame.count() == n


def test_plans_push_down_and_prune(spark, engine):
    engine.register_parquet("orders", "/root/testdata/sf0.001/orders.parquet")
    plan = engine.spark_plan("SELECT o_custkey FROM orders WHERE o_totalprice > 400000.0;")
    assert "GreaterThan(o_totalprice,400000.0)" in plan and "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in plan
