"""Console: commands, and statements over one or more lines."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable

from veldra.engine import Engine
from veldra.errors import EngineError

HELP = """Commands: help, tables, save, quit (saves)
Statements end with a semicolon:
  CREATE TABLE t (a INTEGER, b VARCHAR(50), c FLOAT, d BOOLEAN);
  INSERT INTO t VALUES (1, 'x', 1.5, TRUE);
  SELECT a, b FROM t WHERE a > 5;
  SELECT * FROM t JOIN u ON t.a = u.a;
  UPDATE t SET b = 'y' WHERE a = 1;
  DELETE FROM t WHERE a = 1;
  CREATE INDEX i ON t (a);
  EXPLAIN SELECT * FROM t;
  DROP TABLE t;"""


def repl(engine: Engine, lines: Iterable[str], say: Callable[[str], None] = print) -> None:
    """Reads until ``quit`` or the end of the lines; only ``quit`` and ``save`` store the catalog."""
    if found := engine.load():
        say(f"Loaded {found} table(s).")
    pending = ""
    for line in lines:
        line = line.strip()
        if not line:
            continue
        command = line.lower() if not pending else ""
        try:
            if command in ("quit", "exit", "q"):
                engine.save()
                say("Data saved.\nGoodbye!")
                return
            if command == "save":
                engine.save()
                say("All tables saved.")
            elif command in ("help", "h"):
                say(HELP)
            elif command == "tables":
                rows = [f"  {r['name']} ({r['row_count']} rows) - columns: {r['columns']}" for r in engine.show_tables().collect()]
                say("\n".join(["Tables:", *rows]) if rows else "No tables.")
            else:
                pending += f" {line}"
                if pending.endswith(";"):
                    text, pending = pending, ""
                    say("\n".join(engine.sql(text).lines()))
        except EngineError as e:
            say(f"Error: {e}")
    say("Goodbye!")


def main() -> None:
    """``python -m veldra.repl [folder]``"""
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("veldra").getOrCreate()
    repl(Engine(spark, sys.argv[1] if len(sys.argv) > 1 else ".veldra"), sys.stdin)


if __name__ == "__main__":
    main()
