"""Scalar functions on identifiers and code, as Spark columns."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def clean_notebook_name(name: Column) -> Column:
    """Last two path parts without extension, dashes and underscores, joined; at most the last 25 characters."""
    parts = F.split(F.regexp_replace(F.replace(name, F.lit(".ipynb"), F.lit("")), "[-_]", ""), "/")
    return F.right(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ""), F.lit(25))


def store_name(cell: Column, variable: Column, notebook: Column) -> Column:
    return F.concat_ws("_", cell.cast("string"), variable, notebook)


def code_cells(code: Column) -> Column:
    """Cells of a notebook's code, which is joined by lines of a single #."""
    return F.split(code, "\n#\n")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def base64_code(code: Column) -> Column:
    return F.base64(F.encode(code, "UTF-8"))


def prev_cell(cells, notebook: str, cell: str, has_node: Column):
    """Adds ``prev``: the nearest earlier cell of the notebook that has a node."""
    before = Window.partitionBy(notebook).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("prev", F.max(F.when(has_node, F.col(cell))).over(before))


def domain_id(schema: Column, table: Column, column: Column) -> Column:
    """The identity of a column as one string."""
    return F.concat(F.lit("schema: "), schema, F.lit(" table_name: "), table, F.lit(" col_name: "), column)


def parse_domain_id(identity: Column) -> dict[str, Column]:
    """The parts of domain_id, by name."""
    pattern = r"^schema: (.*?) table_name: (.*?) col_name: (.*)$"
    return {name: F.regexp_extract(identity, pattern, k) for k, name in enumerate(("schema_name", "table_name", "column_name"), 1)}


def alike_names(a: list[str], b: list[str], least: float = 0.5) -> list[tuple[str, str, float]]:
    """Pairs of column names of two schemas whose ratio reaches ``least``; names with ``index`` in front are passed over."""
    index = lambda c: "index" in c.split("_")[0].lower()
    pairs = [(x, y, name_ratio(x, y)) for x in a if not index(x) for y in b if not index(y)]
    return [p for p in pairs if p[2] >= least]


def name_ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity of the parts of two column names before the first underscore. For schemas, not rows."""
    return SequenceMatcher(None, a.split("_")[0].lower(), b.split("_")[0].lower()).ratio()
