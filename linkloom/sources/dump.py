"""Reader and writer side of table dumps: INSERT statements to typed rows and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

#: A quoted cell, a tuple of cells, a cell of a tuple.
_QUOTED = r"'[^'\\]*+(?:\\.[^'\\]*+)*+'"
_TUPLE = rf"\((?:{_QUOTED}|[^'()])*+\)"
_CELL = rf"{_QUOTED}|[^,()']+"


def _unescaped(cell: Column) -> Column:
    inner = cell.substr(F.lit(2), F.length(cell) - 2)
    marked = F.replace(inner, F.lit("\\\\"), F.lit("\x01"))
    for escape, plain in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\0", "\0"), ("\\Z", "\x1a")):
        marked = F.replace(marked, F.lit(escape), F.lit(plain))
    return F.replace(F.regexp_replace(marked, r"\\(.)", "$1"), F.lit("\x01"), F.lit("\\"))


_INSERT = r"^INSERT INTO `?([^`\s(]+)`?\s*(?:\([^()]*\))?\s*VALUES"


def raw_tuples(lines: DataFrame, table: str | None = None) -> DataFrame:
    """(tuple) of the tuples in ``lines.value`` as they stand, each value a line or a whole statement.

    Statements that INSERT into ``table`` (any, if none is given) and lines
    that go on with a tuple are read; a list of columns is skipped. Text that
    is neither a tuple nor between tuples is an error, so a cut tuple never
    vanishes.
    """
    name = F.regexp_extract("value", _INSERT, 1)
    wanted = F.col("value").startswith("INSERT INTO") if table is None else name == table
    data = lines.filter(wanted | F.col("value").startswith("(")).select(F.regexp_replace("value", _INSERT, "").alias("value"))
    rest = F.regexp_replace("value", _TUPLE, "")
    data = data.select(F.when(rest.rlike(r"^[\s,;]*$"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("cannot read this part of a dump: "), F.substring(rest, 1, 80)))).alias("value"))
    return data.select(F.explode(F.regexp_extract_all("value", F.lit(_TUPLE), F.lit(0))).alias("tuple"))


def typed_tuples(tuples: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed rows of raw tuples: NULL is null, escapes within quotes are undone, cells beyond the schema are ignored, and a cell that does not fit its type is null."""
    cells = tuples.select(F.regexp_extract_all(F.expr("substr(tuple, 2, length(tuple) - 2)"), F.lit(_CELL), F.lit(0)).alias("cells"))

    def typed(i: int, field: T.StructField) -> Column:
        raw = F.trim(F.get("cells", F.lit(i)))
        value = F.when(raw == "NULL", None).when(raw.startswith("'"), _unescaped(raw)).otherwise(raw)
        return value.try_cast(field.dataType).alias(field.name)

    return cells.select(*(typed(i, f) for i, f in enumerate(schema.fields)))


def parse_tuples(lines: DataFrame, schema: T.StructType, table: str | None = None) -> DataFrame:
    """Typed rows of the tuples in ``lines.value``; see ``raw_tuples`` and ``typed_tuples``."""
    return typed_tuples(raw_tuples(lines, table), schema)


def statements(spark: SparkSession, path: str, table: str) -> DataFrame:
    """(value): the INSERT statements of a dump file of ``table``, without what stands before them.

    Statements end with a semicolon at the end of a line. Comments, of any
    number and over any lines, may stand before an INSERT; one that stands in a
    comment, or that does not begin a line, is an error if it names the table,
    so that no row is lost in silence.
    """
    return statements_of(spark.read.option("lineSep", ";\n").text(path), table)


def statements_of(parts: DataFrame, table: str) -> DataFrame:
    """As ``statements``, of a table or stream of the parts (value) of a dump between its line-ending semicolons."""
    parts = parts.select(F.explode(F.split("value", r";\r\n")).alias("value"))
    place = F.instr(F.concat(F.lit("\n"), F.col("value")), "\nINSERT INTO")
    before = F.when(place > 0, F.expr("substring(value, 1, instr(concat('\\n', value), '\\nINSERT INTO') - 1)")).otherwise(F.col("value"))
    open_ = F.length(before) - F.length(F.replace(before, F.lit("/*"), F.lit("/"))) > F.length(before) - F.length(F.replace(before, F.lit("*/"), F.lit("/")))
    lost = F.col("value").contains(f"INSERT INTO `{table}`") & ((place == 0) | open_)
    sound = F.when(lost, F.raise_error(F.concat(F.lit("an INSERT that cannot be read: "), F.substring("value", 1, 80)))).when(place > 0, F.expr("substring(value, instr(concat('\\n', value), '\\nINSERT INTO'))"))
    # the filter is on the checked value itself, so no part escapes the check
    return parts.select(sound.alias("value")).filter("value is not null")


def read_dump(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of a dump file of ``table`` (plain or .gz; a .gz file is one task until repartitioned).

    A tuple may be cut by a line break anywhere (titles have theirs escaped); a
    plain file is split between statements.
    """
    return parse_tuples(statements(spark, path, table), schemas.DUMP[table], table)


def part(rows: DataFrame, size: int, number: int, order: list[str]) -> DataFrame:
    """The ``number``-th (from 1) part of ``size`` rows in the given order."""
    first = (number - 1) * size
    return rows.orderBy(*order).offset(first).limit(size)
