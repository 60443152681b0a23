"""Ranked search for related tables: component scores of candidates, upper bounds, top-k, and state kept between queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators import provenance
from tidewater.operators.keys import detect_key, key_statistics
from tidewater.operators.matching import THRESHOLD, greedy
from tidewater.operators.similarity import column_similarity, new_column_rate, null_fills, similar_pairs
from tidewater.plans.tables import settle
from tidewater.sources.lake import Lake

TRAINING, FEATURES, CLEANING = 1, 2, 3


@dataclass(frozen=True)
class Weights:
    """Weights of a search task; what is left goes to the last component."""

    alpha: float
    beta: float
    gamma: float = 0.0


#: The weights of the three tasks, and the number of tables returned.
TASKS = {TRAINING: Weights(0.5, 0.2), FEATURES: Weights(0.4, 0.4), CLEANING: Weights(0.4, 0.4, 0.1)}
RETURNED = 10
COMPONENTS = ["table_name", "keys", "n_a", "n_b", "mapped", "col_sim", "row_sim", "new_col_rate", "new_row_rate", "nan_delta"]


def mapped_pairs(lake: Lake, query: str, candidates: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Mapped column pairs of the query with every candidate, from the lake's classes of values: table_b, col_a, col_b, dtype,
    jaccard, both, n_a, rows and held of either side. Staged, as the steps of a search read it several times."""
    domains = lake.classes()
    a, b = domains.where(F.col("table_name") == query), domains.where(F.col("table_name").isin(*candidates))
    scored = similar_pairs(a, b)
    mapping = greedy(scored, ["table_a", "table_b"], "col_a", "col_b", "jaccard", ("pos_a", "pos_b"), threshold).drop("jaccard")
    stats = lambda s: lake.held().select(F.col("table_name").alias(f"table_{s}"), F.col("column_name").alias(f"col_{s}"), F.col("rows").alias(f"rows_{s}"), F.col("held").alias(f"held_{s}"))
    pairs = mapping.join(scored, ["table_a", "col_a", "table_b", "col_b"]).join(stats("a"), ["table_a", "col_a"]).join(stats("b"), ["table_b", "col_b"])
    return settle(pairs.select("table_b", "col_a", "pos_a", "col_b", "dtype", "jaccard", "both", "n_a", "rows_a", "held_a", "rows_b", "held_b"))


def bounds(lake: Lake, query: str, candidates: list[str], pairs: DataFrame) -> DataFrame:
    """(table_name, n_a, n_b, mapped, col_ub, row_ub, new_col_ub, new_row_ub, nan_ub): what a candidate can reach at most.

    All come from the catalog and the staged pairs: a map has at most as many pairs as the smaller table has columns; keys
    are among the mapped columns, so the best mapped Jaccard and the largest share of new values bound what keys give; a
    candidate fills at most the nulls of mapped columns. An unmapped table has no common rows and only new columns.
    """
    wide = {n: len(lake.table(n).columns) for n in (query, *candidates)}
    sizes = lake.spark.createDataFrame([(n, wide[query], wide[n]) for n in candidates], "table_name string, n_a int, n_b int")
    best = pairs.groupBy(F.col("table_b").alias("table_name")).agg(
        F.count(F.lit(1)).alias("mapped"), F.max("jaccard").alias("row_ub"), F.max(1 - F.try_divide("both", "rows_a")).alias("new_row_ub"),
        F.sum(F.try_divide(F.col("rows_a") - F.col("held_a"), F.col("rows_a") * wide[query])).alias("nan_ub"),
    )
    out = sizes.join(best, "table_name", "left").withColumn("mapped", F.coalesce("mapped", F.lit(0)))
    col = F.when(F.col("mapped") > 0, F.try_divide(F.least("n_a", "n_b"), F.col("n_a") + F.col("n_b") - F.col("mapped"))).otherwise(F.lit(0.0))
    new_col = F.when(F.col("mapped") > 0, F.try_divide(F.col("n_a") - F.col("mapped"), "n_a")).otherwise(F.lit(1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return out.select("table_name", "n_a", "n_b", "mapped", F.coalesce(col, F.lit(0.0)).alias("col_ub"), zero("row_ub"), F.coalesce(new_col, F.lit(0.0)).alias("new_col_ub"), zero("new_row_ub"), zero("nan_ub"))


def random_access(lake: Lake, query: str, names: list[str], pairs: DataFrame, supplied: list[str] | None = None, with_nulls: bool = True) -> DataFrame:
    """(table_name, keys, n_a, n_b, mapped, col_sim, row_sim, new_col_rate, new_row_rate, nan_delta) of some candidates.

    Keys are the supplied ones that are mapped, or else the best detected one. Similarity of rows and the rate of new rows
    are the largest over the keys; without a key they are 0, as are the cells that the candidate fills.
    """
    a = lake.table(query)
    maps: dict[str, list] = {n: [] for n in names}
    for r in sorted(pairs.where(F.col("table_b").isin(*names)).collect(), key=lambda r: r["pos_a"]):
        maps[r["table_b"]].append(r)
    best, fills = {}, None
    if not supplied:
        detected = None
        for n, own in maps.items():
            mapping = {r["col_a"]: r["col_b"] for r in own}
            held = key_statistics(a, lake.table(n), mapping)
            if len(held) == 1 and not with_nulls:
                best[n] = [held[0]["key"]]
            elif held:
                one = detect_key(a, lake.table(n), mapping, held=held, fills=True).limit(1).select(F.lit(n).alias("table_name"), "key_a", "nan_delta")
                detected = one if detected is None else detected.unionByName(one)
        found = [] if detected is None else detected.collect()
        best |= {r["table_name"]: [r["key_a"]] for r in found}
        fills = lake.spark.createDataFrame([(r["table_name"], r["nan_delta"]) for r in found], "table_name string, nan_delta double") if with_nulls and found else None
    rows = []
    for n, own in maps.items():
        b, by, n_a = lake.table(n), {r["col_a"]: r for r in own}, len(a.columns)
        keys = [k for k in supplied if k in by] if supplied else best.get(n, [])
        jaccard, fresh = max((by[k]["jaccard"] for k in keys), default=0.0), max((1 - by[k]["both"] / by[k]["rows_a"] for k in keys), default=0.0)
        rows.append((n, ",".join(keys), n_a, len(b.columns), len(own), column_similarity(n_a, len(b.columns), len(own)), jaccard, new_column_rate(n_a, len(own)), fresh))
        if with_nulls and supplied and keys:
            one = null_fills(a, b, (keys[0], by[keys[0]]["col_b"]), [(r["col_a"], r["col_b"]) for r in own], once=True).select(F.lit(n).alias("table_name"), "nan_delta")
            fills = one if fills is None else fills.unionByName(one)
    kind = "table_name string, keys string, n_a int, n_b int, mapped int, col_sim double, row_sim double, new_col_rate double, new_row_rate double"
    out = lake.spark.createDataFrame(rows, kind)
    if fills is None:
        return out.withColumn("nan_delta", F.lit(0.0))
    return out.join(fills, "table_name", "left").withColumn("nan_delta", F.coalesce("nan_delta", F.lit(0.0)))


def _weights(mode: int, weights: Weights | None) -> Weights:
    if mode not in TASKS:
        raise ValueError(f"no search task {mode}: {sorted(TASKS)}")
    return weights or TASKS[mode]


def score(mode: int, provenance: Column, weights: Weights | None = None) -> Column:
    """The task's weighted sum over the columns of random_access()."""
    w = _weights(mode, weights)
    if mode == TRAINING:
        return w.alpha * provenance + w.beta * F.col("col_sim") + (1 - w.alpha - w.beta) * F.col("new_row_rate")
    if mode == FEATURES:
        return w.alpha * provenance + w.beta * F.col("row_sim") + (1 - w.alpha - w.beta) * F.col("new_col_rate")
    return w.alpha * provenance + w.beta * F.col("col_sim") + w.gamma * F.col("row_sim") + (1 - w.alpha - w.beta - w.gamma) * F.col("nan_delta")


def provenance_of(lake: Lake, names: list[str], query: DataFrame, stars: DataFrame) -> DataFrame:
    """(table_name, prov): how alike the code that made each table is to the query's, 0 to 0.5; 0 for tables without code.

    ``query``: (node, label), the star sets of the query; ``stars``: (view_id, node, label), view ids being table names.
    """
    tables = lake.spark.createDataFrame([(n,) for n in names], "view_id string")
    distances = provenance.mapping_distance(query, stars.join(tables, "view_id", "left_semi"))
    return provenance.provenance_score(tables, distances, 1.0).select(F.col("view_id").alias("table_name"), F.col("prov_score").alias("prov"))


@dataclass
class Found:
    """Hits, best first, the components of every table that was scored, and the bounds they were chosen by."""

    hits: DataFrame
    scored: DataFrame
    bounds: DataFrame


def search(lake: Lake, query: str, mode: int, k: int = RETURNED, candidates: list[str] | None = None, provenance: DataFrame | None = None, weights: Weights | None = None, supplied: list[str] | None = None, theta: float = 1.0, state: DataFrame | None = None) -> Found:
    """The k best candidates for a task: hits (table_name, score), ties by name.

    Candidates are taken in order of their bounds, k at a time, and scored by random access, until the next bound is not
    above theta x the k-th best score. ``provenance``: (table_name, prov) in 0..1; ``state``: components of tables that an
    earlier search scored, which are not computed again. One row a candidate comes to the driver.
    """
    w = _weights(mode, weights)
    names = [n for n in (lake.names() if candidates is None else candidates) if n != query]
    pairs = mapped_pairs(lake, query, names)
    prov = lake.spark.createDataFrame([(n, 0.0) for n in names], "table_name string, prov double") if provenance is None else provenance
    known = settle(bounds(lake, query, names, pairs).join(prov.select("table_name", "prov"), "table_name", "left").withColumn("prov", F.coalesce("prov", F.lit(0.0))))
    ranked = sorted_access(known, mode, F.col("prov"), w).collect()
    done, order = None, [(r["table_name"], r["ub"]) for r in ranked]
    while order:
        taken, order = order[:k], order[k:]
        own = [n for n, _ in taken]
        kept = None if state is None else state.where(F.col("table_name").isin(*own))
        old = set() if kept is None else {r["table_name"] for r in kept.select("table_name").collect()}
        part = None if old >= {*own} else random_access(lake, query, [n for n in own if n not in old], pairs, supplied, mode == CLEANING)
        part = settle(part if not old else kept.select(*COMPONENTS) if part is None else part.select(*COMPONENTS).unionByName(kept.select(*COMPONENTS)))
        done = part.select(*COMPONENTS) if done is None else done.unionByName(part.select(*COMPONENTS))
        total = done.join(prov.select("table_name", "prov"), "table_name", "left").select("*", score(mode, F.coalesce("prov", F.lit(0.0)), w).alias("score"))
        best = [r["score"] for r in total.orderBy(F.desc("score")).limit(k).select("score").collect()]
        if order and len(best) >= k and order[0][1] <= theta * best[-1]:
            break
    if done is None:
        empty = lake.spark.createDataFrame([], "table_name string, score double")
        return Found(empty, empty, known)
    return Found(total.select("table_name", "score").orderBy(F.desc("score"), "table_name").limit(k), done, known)


def dispatch(lake: Lake, mode: int, query: str, **options):
    """Mode 0 tells whether a table of that name is there; modes 1 to 3 search for it."""
    return query in lake.names() if mode == 0 else search(lake, query, mode, **options)


def result_rows(lake: Lake, hits: DataFrame, rows: int = 10, columns: int = 5) -> DataFrame:
    """(rank, table_name, score, kind, n_cells, preview): the hits as they are shown; a preview has the first rows in order of
    their text and the first columns, as an HTML table. There are at most as many hits as are returned."""
    out = None
    for rank, r in enumerate(hits.collect(), 1):
        df = lake.table(r["table_name"])
        shown = df.columns[:columns]
        cell = lambda c: F.concat(F.lit("<td>"), F.replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</td>"))
        line = df.select(F.concat(F.lit("<tr>"), *map(cell, shown), F.lit("</tr>")).alias("line")).orderBy("line").limit(rows)
        head = "<table><tr>" + "".join(f"<th>{c}</th>" for c in shown) + "</tr>"
        html = line.agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list("line")), ""), F.lit("</table>")).alias("preview"))
        size = df.agg((F.count(F.lit(1)) * len(df.columns)).alias("n_cells"))
        one = size.crossJoin(html).select(F.lit(rank).alias("rank"), F.lit(r["table_name"]).alias("table_name"), F.lit(r["score"]).alias("score"), F.lit("table").alias("kind"), "n_cells", "preview")
        out = one if out is None else out.unionByName(one)
    return lake.spark.createDataFrame([], "rank int, table_name string, score double, kind string, n_cells long, preview string") if out is None else out


def sorted_access(bounds: DataFrame, mode: int, provenance: Column, weights: Weights | None = None) -> DataFrame:
    """(table_name, ub) by bound, best first: own provenance with the largest bound of any candidate for the rest."""
    w = _weights(mode, weights)
    most = bounds.agg(*(F.max(c).alias(f"top_{c}") for c in ("col_ub", "row_ub", "new_col_ub", "new_row_ub", "nan_ub")))
    bounds, top = bounds.join(F.broadcast(most), F.lit(True)), lambda c: F.col(f"top_{c}")
    rest = {
        TRAINING: w.beta * top("col_ub") + (1 - w.alpha - w.beta) * top("new_row_ub"), FEATURES: w.beta * top("row_ub") + (1 - w.alpha - w.beta) * top("new_col_ub"),
        CLEANING: w.beta * top("col_ub") + w.gamma * top("row_ub") + (1 - w.alpha - w.beta - w.gamma) * top("nan_ub"),
    }[mode]
    return bounds.select("table_name", (w.alpha * provenance + rest).alias("ub")).orderBy(F.desc("ub"), "table_name")


def threshold_topk(scored: DataFrame, k: int, theta: float = 1.0) -> DataFrame:
    """The k best of (table_name, ub, score) among those whose bound exceeds theta x the k-th score of the k best bounds."""
    first = scored.orderBy(F.desc("ub"), "table_name").limit(k).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    kept = scored.join(F.broadcast(first), F.lit(True)).where((F.col("n") < k) | (F.col("ub") >= theta * F.col("least")))
    return kept.select("table_name", "score").orderBy(F.desc("score"), "table_name").limit(k)


def merge_state(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Component scores by table from an earlier and a later query state; the later one counts where both have a table."""
    a = old.select("table_name", *(F.col(c).alias(f"o_{c}") for c in columns))
    b = new.select("table_name", *(F.col(c).alias(f"n_{c}") for c in columns))
    return a.join(b, "table_name", "full").select("table_name", *(F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in columns))


def save_state(store, mode: int, query: str, scored: DataFrame) -> DataFrame:
    """Keeps the components of a search in a store, in long form; what an earlier search of the same task and query had for
    tables that this one did not score stays."""
    values = ["col_sim", "row_sim", "new_col_rate", "new_row_rate", "nan_delta"]
    long = scored.select(F.lit(mode).alias("mode"), F.lit(query).alias("query"), "table_name", F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.col(c).cast("double").alias("score")) for c in values))).alias("x")).select("mode", "query", "table_name", "x.*")
    old = store.read("topk_state").join(long.select("mode", "query", "table_name").distinct(), ["mode", "query", "table_name"], "left_anti")
    return store.replace("topk_state", old.unionByName(long))


def split_known(names: DataFrame, state: DataFrame, mode: int, query: str) -> DataFrame:
    """(table_name, known): whether a kept state has a candidate's components already."""
    have = state.where((F.col("mode") == mode) & (F.col("query") == query)).select("table_name", F.lit(True).alias("have")).distinct()
    return names.join(have, "table_name", "left").select("table_name", F.coalesce("have", F.lit(False)).alias("known"))
