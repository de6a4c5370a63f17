from veldra import Engine
from veldra.repl import repl
from veldra.streaming import write


def talk(engine, *lines):
    said = []
    repl(engine, lines, said.append)
    return "\n".join(said)


def test_console(spark, tmp_path):
    folder = str(tmp_path / "db")
    out = talk(Engine(spark, folder), "help", "tables", "CREATE TABLE t", "(a INTEGER);", "INSERT INTO t VALUES (1);", "SELECT * FROM t; SELECT * FROM nope;", "bad;", "tables", "quit", "never")
    for part in ("Statements end", "No tables.", "Table 't' created.", "1 row(s) inserted.", "(1 row)", "Error: Unexpected token", "t (1 rows) - columns: a", "Data saved.", "Goodbye!"):
        assert part in out
    assert "nope" not in out and "never" not in out
    out = talk(Engine(spark, folder), "SELECT a FROM t;", "DROP TABLE t;")
    assert "Loaded 1 table(s)." in out and "(1 row)" in out
    assert "Loaded 1 table(s)." in talk(Engine(spark, folder))  # the end of the lines saves nothing
    talk(Engine(spark, folder), "DROP TABLE t;", "save")
    assert "Loaded" not in talk(Engine(spark, folder))


def test_select_over_a_stream(spark, engine, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 5.0), (2, 50.0)], "uid int, value double").write.parquet(source)
    engine.register_frame("events", spark.readStream.schema("uid int, value double").parquet(source))
    engine.sql("CREATE TABLE makers (id INTEGER, name VARCHAR(9));")
    engine.sql("INSERT INTO makers VALUES (1, 'a'), (2, 'b');")
    query = write(engine, "SELECT name, value FROM events JOIN makers ON uid = id WHERE value > 10.0;", str(tmp_path / "progress")).format("memory").queryName("seen").start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.table("seen").collect()] == [("b", 50.0)]
