"""Provenance: dependencies of variables in notebook code, their graphs and star sets, and how alike two of them are."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.names import sigmoid
from tidewater.operators.matching import greedy

#: Names that stand for libraries, not for variables of the notebook.
LIBRARIES = ("np", "pd")
DEPTH = 100


class _Reads(ast.NodeVisitor):
    """(variable, operation) pairs of an expression: what is read, and the operation that reads it."""

    def __init__(self):
        self.found: list[tuple[str, str]] = []
        self.operation = ["assign"]

    def _inside(self, operation: str, *nodes: ast.AST) -> None:
        self.operation.append(operation)
        for node in nodes:
            self.visit(node)
        self.operation.pop()

    def visit_Name(self, node: ast.Name) -> None:
        self.found.append((node.id, self.operation[-1]))

    def visit_Call(self, node: ast.Call) -> None:
        name = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", "call")
        if isinstance(node.func, ast.Attribute):
            self._inside(name, node.func.value)
        self._inside(name, *node.args, *(k.value for k in node.keywords))

    def visit_Attribute(self, node: ast.Attribute) -> None:
        self._inside(node.attr, node.value)

    def visit_Subscript(self, node: ast.Subscript) -> None:
        self._inside("subscript", node.value, node.slice)

    def visit_BinOp(self, node: ast.BinOp) -> None:
        self._inside(type(node.op).__name__.lower(), node.left, node.right)

    def visit_UnaryOp(self, node: ast.UnaryOp) -> None:
        self._inside(type(node.op).__name__.lower(), node.operand)

    def visit_BoolOp(self, node: ast.BoolOp) -> None:
        self._inside(type(node.op).__name__.lower(), *node.values)

    def visit_Compare(self, node: ast.Compare) -> None:
        self._inside("compare", node.left, *node.comparators)


def line_dependencies(line: str) -> list[tuple[str, str, str]]:
    """(assigned name, read variable, operation) of one line; nothing if it does not parse or does not assign."""
    try:
        body = ast.parse(line).body
    except (SyntaxError, ValueError):
        return []
    out = []
    for node in body:
        if isinstance(node, ast.Assign | ast.AugAssign | ast.AnnAssign) and node.value is not None:
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            names = [t.id for target in targets for t in ast.walk(target) if isinstance(t, ast.Name) and isinstance(t.ctx, ast.Store)]
            names = names or [t.id for target in targets for t in ast.walk(target) if isinstance(t, ast.Name)][:1]
            reads = _Reads()
            reads.visit(node.value)
            out += [(n, v, op) for n in names for v, op in reads.found] or [(n, "", "") for n in names]
    return out


def parse_cells(cells: DataFrame) -> DataFrame:
    """(view_id, line_no, cell_id, lhs, rhs_var, op) of the code of (view_id, cell_id, code).

    Lines count over the cells of a view in order. Bodies of functions (up to their return), magics, comments and lines
    that do not parse are passed over. Code has to be parsed in Python; a group is one notebook.
    """

    def parse(pdf: pd.DataFrame) -> pd.DataFrame:
        out, line_no = [], 0
        for cell_id, code in pdf.sort_values("cell_id")[["cell_id", "code"]].itertuples(index=False):
            in_function = False
            for line in (code or "").split("\n"):
                line_no += 1
                text = line.strip()
                if in_function:
                    in_function = not text.startswith("return")
                elif text.startswith("def "):
                    in_function = not re.search(r":\s*return\b", text)
                elif text and text[0] not in "%#!":
                    out += [(pdf["view_id"].iloc[0], line_no, cell_id, *x) for x in line_dependencies(text)]
        return pd.DataFrame(out, columns=["view_id", "line_no", "cell_id", "lhs", "rhs_var", "op"])

    return cells.groupBy("view_id").applyInPandas(parse, "view_id string, line_no int, cell_id int, lhs string, rhs_var string, op string")


def last_line(dependency: DataFrame, variable: str | None = None) -> DataFrame:
    """(view_id, lhs, line_no): the last assignment of each variable, or of those whose name ends with ``variable``."""
    rows = dependency if variable is None else dependency.where(F.col("lhs").endswith(variable))
    return rows.groupBy("view_id", *(["lhs"] if variable is None else [])).agg(F.max("line_no").alias("line_no"))


def dependency_graph(dependency: DataFrame) -> DataFrame:
    """(view_id, src, dst, label): from each assigned node to the latest earlier assignment of what it reads.

    Nodes are ``variable@line``; a variable without earlier assignment stands at line 0. The as-of lookup is a running
    maximum over the lines of a variable, not a range join.
    """
    writes = dependency.select("view_id", F.col("lhs").alias("var"), "line_no", F.lit(1).alias("w"), F.lit(None).cast("string").alias("lhs"), F.lit(None).cast("string").alias("op")).distinct()
    reads = dependency.where("rhs_var != ''").select("view_id", F.col("rhs_var").alias("var"), "line_no", F.lit(0).alias("w"), "lhs", "op").distinct()
    # a read at a line comes before the writes of that line
    before = Window.partitionBy("view_id", "var").orderBy("line_no", "w").rowsBetween(Window.unboundedPreceding, -1)
    placed = writes.unionByName(reads).withColumn("at", F.max(F.when(F.col("w") == 1, F.col("line_no"))).over(before)).where("w = 0 and var != lhs or w = 0 and at is not null")
    node = lambda v, n: F.concat(v, F.lit("@"), n.cast("string"))
    return placed.where(~F.col("var").isin(*LIBRARIES)).select("view_id", node(F.col("lhs"), F.col("line_no")).alias("src"), node(F.col("var"), F.coalesce("at", F.lit(0))).alias("dst"), F.col("op").alias("label"))


def star_sets(edges: DataFrame, roots: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(view_id, node, label): for the nodes that each root (view_id, src) depends on, +op of edges out and -op of edges in.

    The frontier grows by one join a step until it stays, at most ``depth`` steps; visited nodes are rows, never collected.
    """
    from tidewater.plans.tables import settle

    edges = settle(edges)
    visited = settle(roots.select("view_id", F.col("src").alias("node")).distinct())
    front = visited
    for _ in range(depth):
        front = front.join(edges.select("view_id", F.col("src").alias("node"), "dst"), ["view_id", "node"]).select("view_id", F.col("dst").alias("node")).distinct()
        front = settle(front.join(visited, ["view_id", "node"], "left_anti"))
        if front.isEmpty():
            break
        visited = settle(visited.unionByName(front))
    inside = edges.join(visited.withColumnRenamed("node", "src"), ["view_id", "src"], "left_semi").join(visited.withColumnRenamed("node", "dst"), ["view_id", "dst"], "left_semi")
    out = inside.select("view_id", F.col("src").alias("node"), F.concat(F.lit("+"), "label").alias("label"))
    return out.unionByName(inside.select("view_id", F.col("dst").alias("node"), F.concat(F.lit("-"), "label").alias("label")))


def star_distances(query: DataFrame, stars: DataFrame) -> DataFrame:
    """(view_id, node_q, node, distance) of all pairs of query stars and the stars of each view: |len difference| +
    max(len) - multiset intersection."""
    counts = lambda d, *k: d.groupBy(*k, "label").agg(F.count(F.lit(1)).alias("n"))
    q = counts(query.withColumnRenamed("node", "node_q"), "node_q").withColumnRenamed("n", "nq")
    s = counts(stars, "view_id", "node")
    size_q, size = q.groupBy("node_q").agg(F.sum("nq").alias("lq")), s.groupBy("view_id", "node").agg(F.sum("n").alias("l"))
    both = q.join(s, "label").groupBy("view_id", "node_q", "node").agg(F.sum(F.least("n", "nq")).alias("both"))
    # the query's stars are the stated query set: one small table against the stars of each view
    pairs = size.join(F.broadcast(size_q), F.lit(True)).join(both, ["view_id", "node_q", "node"], "left")
    return pairs.select("view_id", "node_q", "node", (F.abs(F.col("l") - F.col("lq")) + F.greatest("l", "lq") - F.coalesce("both", F.lit(0))).alias("distance"))


def mapping_distance(query: DataFrame, stars: DataFrame) -> DataFrame:
    """(view_id, distance): sum over the greedy one-to-one map of query stars to the stars of each view."""
    chosen = greedy(star_distances(query, stars), ["view_id"], "node_q", "node", "distance", ascending=True)
    return chosen.groupBy("view_id").agg(F.sum("distance").alias("distance"))


def rank(query: DataFrame, stars: DataFrame, k: int | None = None) -> DataFrame:
    out = mapping_distance(query, stars).orderBy("distance", "view_id")
    return out if k is None else out.limit(k)


def provenance_score(tables: DataFrame, distances: DataFrame, alpha: float) -> DataFrame:
    """(view_id, prov_score): alpha (1 - sigmoid(distance)), 0 for tables without a graph."""
    return tables.join(distances, "view_id", "left").select("view_id", F.coalesce(alpha * (1 - sigmoid(F.col("distance").cast("double"))), F.lit(0.0)).alias("prov_score"))


def add_cells(known: DataFrame, new: DataFrame) -> DataFrame:
    """Code dictionary (code, cell_id) with the codes it lacked, numbered on from the largest id. The window's input is
    the new codes of one request."""
    fresh = new.select("code").distinct().join(known, "code", "left_anti")
    top = known.agg(F.coalesce(F.max("cell_id"), F.lit(-1)).alias("top"))
    numbered = fresh.withColumn("rn", F.row_number().over(Window.orderBy("code"))).join(F.broadcast(top), F.lit(True))
    return known.unionByName(numbered.select("code", (F.col("top") + F.col("rn")).cast(known.schema["cell_id"].dataType).alias("cell_id")))


def workflow_groups(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, grp): connected components of (src, dst) named by their smallest node.

    Each round hooks every root to the smallest root beside it and halves the chains of hooks until they end, so the
    number of rounds grows with the logarithm of the number of nodes, not with the length of a workflow.
    """
    from tidewater.plans.tables import settle

    state = settle(nodes.select("node", F.col("node").alias("grp")).distinct())
    left = settle(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u != v").distinct())
    while not left.isEmpty():
        hooks = settle(left.groupBy("u").agg(F.min("v").alias("root")))
        while True:
            to = hooks.select(F.col("u").alias("from"), F.col("root").alias("to"))
            hooks = settle(hooks.join(to, F.col("root") == F.col("from"), "left").select("u", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")))
            if hooks.where("moved").isEmpty():
                break
            hooks = hooks.select("u", "root")
        to = hooks.select(F.col("u").alias("from"), F.col("root").alias("to"))
        follow = lambda d, c, to=to: d.join(to, F.col(c) == F.col("from"), "left").withColumn(c, F.coalesce("to", c)).drop("from", "to")
        state = settle(follow(state, "grp"))
        left = follow(follow(left, "u"), "v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        left = settle(left.where("u != v").distinct())
    return state


def table_groups(contains: DataFrame, cell_edges: DataFrame) -> DataFrame:
    """(table_name, grp): tables whose cells are connected in a workflow share a group, named by its smallest cell.

    ``contains``: (table_name, cell_id) of the cells that hold each table's variable; ``cell_edges``: (src, dst).
    """
    cells = contains.select(F.col("cell_id").alias("node")).unionByName(cell_edges.select(F.col("src").alias("node"))).unionByName(cell_edges.select(F.col("dst").alias("node"))).distinct()
    # a table that stands in several cells connects them
    first = contains.groupBy("table_name").agg(F.min("cell_id").alias("src"))
    ties = contains.join(first, "table_name").select("src", F.col("cell_id").alias("dst")).where("src != dst")
    groups = workflow_groups(cell_edges.select("src", "dst").unionByName(ties), cells)
    return first.join(groups, F.col("src") == F.col("node")).select("table_name", "grp")


def query_node(cells: DataFrame, variable: str) -> DataFrame:
    """(view_id, node, label): star sets of the last assignment of a variable in the code of (view_id, cell_id, code); no rows where
    the code does not assign it."""
    found = parse_cells(cells)
    last = last_line(found.where(F.col("lhs") == variable), variable)
    return star_sets(dependency_graph(found), last.select("view_id", F.concat(F.lit(f"{variable}@"), F.col("line_no").cast("string")).alias("src")))
