import pytest
from hypothesis import given
from hypothesis import strategies as st

from veldra.dialect import nodes as N
from veldra.dialect import parse
from veldra.dialect.nodes import dump
from veldra.dialect.tokens import tokens
from veldra.errors import ParseError
from veldra.types import Family


def kinds(text):
    return [(t.kind, t.text) for t in tokens(text)]


def test_tokens_of_a_select():
    assert kinds("select a.b FROM t WHERE x != 'y z';") == [
        ("keyword", "SELECT"), ("identifier", "a"), ("symbol", "."), ("identifier", "b"), ("keyword", "FROM"), ("identifier", "t"),
        ("keyword", "WHERE"), ("identifier", "x"), ("symbol", "<>"), ("string", "y z"), ("symbol", ";"), ("end", ""),
    ]


def test_numbers_strings_and_what_is_illegal():
    assert kinds("1. 2.5 7 'open")[:4] == [("float", "1."), ("float", "2.5"), ("integer", "7"), ("string", "open")]
    assert kinds("''")[0] == ("string", "")
    assert kinds("#")[0] == ("illegal", "#")


def test_lines_and_columns():
    assert [(t.line, t.column) for t in tokens("a\n  b 'x\ny' c")] == [(1, 1), (2, 3), (2, 5), (3, 4), (3, 5)]


@given(st.text(max_size=40))
def test_the_lexer_takes_any_text(text):
    assert list(tokens(text))[-1].kind == "end"


@given(st.text(alphabet="SELECT*FROMabt,.;()'=<>-+/ 1230 WHEREJOINON", max_size=60))
def test_the_parser_parses_or_says_why_not(text):
    try:
        parse(text)
    except ParseError:
        pass


def test_select_with_join():
    s = parse("SELECT boats.hull, port FROM boats INNER JOIN trips ON trips.hull = boats.hull WHERE trips.miles <= 7.5;")
    assert s.columns == (N.Name("hull", "boats"), N.Name("port"))
    assert s.join == N.Join("trips", N.Name("hull", "trips"), N.Name("hull", "boats"))
    assert s.where == N.Binary("<=", N.Name("miles", "trips"), N.Literal(7.5, Family.FLOAT))


def test_precedence():
    where = parse("SELECT * FROM t WHERE a = 1 OR b = 2 AND c + 2 * d - 1 < -3;").where
    assert where.op == "OR" and where.right.op == "AND"
    less = where.right.right
    assert less.op == "<" and less.right == N.Literal(-3, Family.INTEGER)
    assert less.left == N.Binary("-", N.Binary("+", N.Name("c"), N.Binary("*", N.Literal(2, Family.INTEGER), N.Name("d"))), N.Literal(1, Family.INTEGER))


def test_create_table_with_all_types():
    s = parse("CREATE TABLE boats (open BOOLEAN, v VARCHAR, tons FLOAT, port VARCHAR(12), n INT, hull INTEGER);")
    assert [(c.family.value, c.length) for c in s.columns] == [("BOOLEAN", 0), ("VARCHAR", 0), ("FLOAT", 0), ("VARCHAR", 12), ("INTEGER", 0), ("INTEGER", 0)]


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM t", "SELECT FROM t;", "SELECT a + 1 FROM t;", "SELECT * FROM t, u;", "SELECT * FROM t WHERE NOT a;",
        "SELECT * FROM t WHERE a = b = c;", "SELECT * FROM t WHERE a = (1;", "SELECT * FROM t WHERE f(a);", "SELECT * FROM t WHERE a = - b;",
        "SELECT * FROM t WHERE a = .5;", "SELECT * FROM select;", "INSERT INTO t (a) VALUES (1);", "INSERT INTO t VALUES ();", "UPDATE t SET t.a = 1;",
        "CREATE TABLE t (a DATE);", "CREATE TABLE t (a VARCHAR(x));", "CREATE INDEX i ON t (a, b);", "DROP INDEX i;", "EXPLAIN DELETE FROM t;",
        "INSERT INTO t VALUES (2147483648);", "SELECT * FROM t INNER u ON a = b;", "ALTER TABLE t;", "", ";",
    ],
)
def test_what_does_not_parse(text):
    with pytest.raises(ParseError):
        parse(text)


def test_only_the_first_statement_is_read():
    assert parse("DROP TABLE t; DROP TABLE u;") == N.DropTable("t")


def test_dumps():
    text = dump(parse("SELECT hull, port FROM boats WHERE tons < 2.5 AND port <> 'Rhyl';"))
    assert "SelectStatement(table=boats, columns=[hull, port])" in text
    assert "BinaryOp(AND)" in text and "BinaryOp(NEQ)" in text and "Literal(Rhyl)" in text
    text = dump(parse("UPDATE boats SET tons = 4.0 WHERE open = FALSE;"))
    assert "UpdateStatement(table=boats)" in text and "- tons =" in text and "Column(open)" in text
    assert dump(parse("CREATE TABLE t (a VARCHAR(5));")) == "CreateTableStatement(table=t)\n  columns:\n  - a VARCHAR(5)"
    assert "row[1]" in dump(parse("INSERT INTO t VALUES (1), (TRUE);"))
    for text in ("DROP TABLE t;", "DELETE FROM t;", "CREATE INDEX i ON t (a);", "EXPLAIN SELECT * FROM t;"):
        assert "Statement" in dump(parse(text))
