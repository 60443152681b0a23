"""Registered queries of profiles, matching, keys, relatedness and storage cost over whole tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import keys, matching, profiling, provenance, similarity, storage
from tidewater.plans.queries import ORDER_COLUMNS, _greedy, _values, query, r9, with_holes
from tidewater.plans.search_queries import _LAKE, _MAPPED, _PAIRS, QUERY, whole_lake
from tidewater.plans.search_queries import _HOLES as HOLES
from tidewater.plans.tables import settle
from tidewater.sources.lake import Lake
from tidewater.sources.store import REGISTRY


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_holes(read(spark, sf_dir, "orders"))


# ---- profiles ---------------------------------------------------------------------------------------------------
_TEXTS = ("p_name", "p_brand", "p_type")
_PART = ("p_partkey", *_TEXTS, "p_size", "p_retailprice")


def _part_lake(spark: SparkSession, sf_dir: str) -> Lake:
    part = read(spark, sf_dir, "part")
    return Lake(spark, {"part": part, "again": part.select(*(F.col(c).alias(f"x{c}") for c in part.columns))})


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame, Lake]:
    """part is registered first, and then the same table under other column names."""
    registry = {n: spark.createDataFrame([], s) for n, s in REGISTRY.items()}
    lake, became = _part_lake(spark, sf_dir), None
    for name in ("part", "again"):
        one = lake.subset([name])
        registry, became = profiling.index_columns(one.cells(("long", "string")), one.columns().select("table_name", "column_name"), registry)
        registry, became = {n: d if n == "column_index" else settle(d) for n, d in registry.items()}, settle(became)
    return registry, became, lake


def _beside(column: str) -> str:
    return ",".join(sorted(c for c in _PART if c != column))


_REGISTERED = (
    "WITH cells AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{_beside(c)}' AS beside, '{'string' if c in _TEXTS else 'long'}' AS dtype, CAST({c} AS VARCHAR) AS value FROM part" for c in _PART if c != "p_retailprice")
    + "), prof AS (SELECT column_name, any_value(dtype) AS dtype, count(*) AS n, count(DISTINCT value) AS nd FROM cells WHERE value IS NOT NULL GROUP BY column_name), attr AS (SELECT 'part.' || column_name AS attribute, column_name, n, nd FROM prof WHERE dtype = 'string' AND nd > 20),"
    " score AS (SELECT p.column_name AS col_a, a.attribute, 0.2::DOUBLE * CASE WHEN p.column_name = a.column_name THEN 2 / 3 ELSE 0 END + 0.4::DOUBLE * (SELECT count(DISTINCT x.value) FROM cells x JOIN cells y ON x.value = y.value WHERE x.column_name = p.column_name AND y.column_name = a.column_name) / p.nd"
    " + 0.4::DOUBLE * (1 / (abs(p.nd / p.n - a.nd / (2 * a.n)) + 1) - 0.5::DOUBLE) AS score FROM prof p JOIN attr a ON p.dtype = 'string' WHERE p.nd >= 5 OR p.column_name = a.column_name)"
)


@query(f"{_REGISTERED} SELECT 'again' AS table_name, 'x' || column_name AS column_name, attribute FROM attr")
def index_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir)[1]


@query(f"{_REGISTERED} SELECT attribute, 'string' AS dtype, 2 * n AS n_values, 2 AS occurrences FROM attr")
def registry_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir)[0]["attributes"]


@query(f"{_REGISTERED} SELECT 'part' AS table_a, column_name AS col_a, attribute, 1 AS seen, 2 AS occurrences FROM attr")
def context_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry, _, lake = _indexed(spark, sf_dir)
    return profiling.context_scores(lake.subset(["part"]).columns().select("table_name", "column_name"), registry["neighbours"], registry["attributes"])


@query(f"{_REGISTERED} SELECT 'part' AS table_a, col_a, attribute, round(score, 9) AS score FROM score WHERE score > 0.1")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry, _, lake = _indexed(spark, sf_dir)
    one = lake.subset(["part"])
    return profiling.registry_scores(one.cells(("long", "string")), one.columns().select("table_name", "column_name"), registry, 0.1).withColumn("score", F.round("score", 9))


@query(f"{_REGISTERED} SELECT 'part' AS table_a, col_a, s.attribute, round(score, 9) AS score, t.table_name, t.prefix || a.column_name AS column_name FROM score s JOIN attr a ON a.attribute = s.attribute AND a.column_name = s.col_a, (VALUES ('part', ''), ('again', 'x')) t(table_name, prefix) WHERE score > 0.5")
def search_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry, _, lake = _indexed(spark, sf_dir)
    one = lake.subset(["part"])
    found = profiling.search_columns(one.cells(("long", "string")), one.columns().select("table_name", "column_name"), registry)
    return found.select("table_a", "col_a", "attribute", r9("score"), "table_name", "column_name")


_INDEX_SQL = "SELECT attribute, value, '{t}' AS table_name, row_id FROM (SELECT 'custkey' AS attribute, o_custkey::VARCHAR AS value, o_orderkey AS row_id FROM orders UNION ALL SELECT 'priority', o_orderpriority, o_orderkey FROM orders) WHERE value IS NOT NULL"


def _column_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.column_index(read(spark, sf_dir, "orders"), F.col("o_orderkey"), {"o_custkey": "custkey", "o_orderpriority": "priority"}, "orders", 50)


@query(_INDEX_SQL.format(t="orders"))
def column_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _column_index(spark, sf_dir).select("attribute", "value", "table_name", F.explode("row_ids").alias("row_id"))


@query(_INDEX_SQL.format(t="orders_dup"))
def reuse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.reuse_index(_column_index(spark, sf_dir), "orders", "orders_dup").select("attribute", "value", "table_name", F.explode("row_ids").alias("row_id"))


# ---- matching ---------------------------------------------------------------------------------------------------
_FOUR = "table_a string, col_a string, table_b string, col_b string"
_KNOWN = [(QUERY, "o_orderkey", "orders", "o_orderkey")]


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    classes = whole_lake(spark, sf_dir).classes()
    return classes.where(F.col("table_name") == QUERY), classes.where(F.col("table_name") != QUERY)


@query(_MAPPED + f" SELECT 'known' AS memo, table_b, col_a, col_b FROM m UNION ALL SELECT 'unmatched', table_b, col_a, col_b FROM pairs WHERE jaccard < 0.5")
def match_memos(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    none = spark.createDataFrame([], _FOUR)
    known, unmatched = matching.remember_match(matching.match_naive(a, b), similarity.similar_pairs(a, b), none, none)
    return known.select(F.lit("known").alias("memo"), "table_b", "col_a", "col_b").unionByName(unmatched.select(F.lit("unmatched").alias("memo"), "table_b", "col_a", "col_b"))


_GROUPS = [("orders", "sales"), ("lineitem", "sales"), ("customer", "people"), ("supplier", "people")]
_VALID = ["o_orderkey", "o_custkey", "o_totalprice"]
_GROUP_SQL = (
    f"WITH RECURSIVE {_LAKE}, " + _values(_GROUPS, "grps", "table_name, grp") + ", pool AS (SELECT DISTINCT grp, column_name, dtype, value FROM vals JOIN grps USING (table_name) WHERE value IS NOT NULL),"
    " np AS (SELECT grp, column_name, dtype, count(*) AS n FROM pool GROUP BY ALL), own AS (SELECT column_name, pos, dtype, nd FROM stats WHERE table_name = '" + QUERY + "' AND dtype IN ('long', 'double', 'string')),"
    " ap AS MATERIALIZED (SELECT o.column_name AS col_a, o.pos AS pos_a, np.grp, np.column_name AS col_b, np.dtype, coalesce((SELECT count(*) FROM vals v JOIN pool p ON p.value = v.value AND p.dtype = v.dtype WHERE v.table_name = '" + QUERY + "' AND v.column_name = o.column_name AND p.grp = np.grp AND p.column_name = np.column_name), 0) AS n_both, o.nd, np.n FROM own o JOIN np ON np.dtype = o.dtype),"
    " js AS MATERIALIZED (SELECT *, n_both / (nd + n - n_both) AS jaccard FROM ap), first AS (SELECT * FROM js WHERE col_a IN ('" + "', '".join(_VALID) + "')), second AS (SELECT * FROM js WHERE dtype = 'string'), pairs AS (SELECT DISTINCT grp AS table_b, col_a, pos_a, col_b, jaccard FROM (FROM first UNION ALL FROM second))"
)


@query(_GROUP_SQL + _greedy("(SELECT * FROM pairs WHERE jaccard >= 0.5)", "jaccard DESC, pos_a, col_b") + f" SELECT 'mapped' AS kind, table_b AS grp, a AS col_a, b AS col_b FROM chosen UNION ALL SELECT 'failed', table_b, col_a, col_b FROM pairs WHERE jaccard < 0.5")
def match_groups_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    groups = spark.createDataFrame([(t, g) for t, g in _GROUPS], "table_b string, grp string")
    mapped, failed = matching.match_groups_join(a, b, groups, _VALID, matching._pooled(b.where("dtype = 'string'"), groups))
    rows = lambda d, kind: d.select(F.lit(kind).alias("kind"), F.col("table_b").alias("grp"), "col_a", "col_b")
    return rows(mapped, "mapped").unionByName(rows(failed, "failed"))


@query(
    f"WITH {_PAIRS}, el AS (SELECT table_name, column_name, dtype, split_part(column_name, '_', -1) AS element FROM stats) SELECT y.table_name AS table_b, x.column_name AS col_a, y.column_name AS col_b, round(coalesce(p.jaccard, 0), 9) AS jaccard"
    f" FROM el x JOIN el y ON x.element = y.element AND x.dtype = y.dtype LEFT JOIN pairs p ON p.col_a = x.column_name AND p.table_b = y.table_name AND p.col_b = y.column_name WHERE x.table_name = '{QUERY}' AND y.table_name <> '{QUERY}'"
)
def match_group_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    elements = lambda d: d.select("table_name", "column_name", F.substring_index("column_name", "_", -1).alias("element")).distinct()
    return matching.match_group_schema(a, b, elements(a), elements(b)).select("table_b", "col_a", "col_b", r9("jaccard"))


@query(_MAPPED + " SELECT table_b, string_agg(col_a || '=' || col_b, ',' ORDER BY col_a) AS mapping FROM m GROUP BY table_b")
def partial_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = matching.match_naive(*_sides(spark, sf_dir)).withColumnRenamed("jaccard", "score")
    found = matching.partial_maps(hits)
    return found.select("table_b", F.array_join(F.transform(F.map_entries("mapping"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("mapping"))


_CONTAINS_SQL = "contains AS (SELECT n_name AS table_name, n_regionkey AS cell_id FROM nation), edges(src, dst) AS (VALUES (0, 1), (3, 4))"


@query(
    f"WITH RECURSIVE {_CONTAINS_SQL}, ways AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), reach AS (SELECT DISTINCT cell_id AS node, cell_id AS other FROM contains UNION SELECT r.node, w.dst FROM reach r JOIN ways w ON w.src = r.other)"
    " SELECT table_name, (SELECT min(other) FROM reach WHERE node = cell_id) AS grp FROM contains"
)
def table_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    contains = read(spark, sf_dir, "nation").select(F.col("n_name").alias("table_name"), F.col("n_regionkey").alias("cell_id"))
    return provenance.table_groups(contains, spark.createDataFrame([(0, 1), (3, 4)], "src int, dst int"))


@query(f"SELECT '{QUERY}' AS table_a, c AS col_a, 'orders' AS table_b, c AS col_b FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_totalprice'), ('o_orderdate'), ('o_orderpriority')) v(c)")
def match_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups come from cells: the query's and the orders' are neighbours in a workflow, the others stand alone."""
    lake = whole_lake(spark, sf_dir)
    columns = lake.columns()
    cells = spark.createDataFrame([(n, k) for k, n in enumerate(lake.names())], "table_name string, cell_id int")
    edge = [tuple(lake.names().index(n) for n in (QUERY, "orders"))]
    groups = provenance.table_groups(cells, spark.createDataFrame(edge, "src int, dst int"))
    return matching.match_workflow(spark.createDataFrame(_KNOWN, _FOUR), matching.match_names(columns.where(F.col("table_name") == QUERY), columns), groups)


# ---- keys -------------------------------------------------------------------------------------------------------
_SAME = {c: c for c in ORDER_COLUMNS}


def _key_sql(a: str, b: str, mapping: dict[str, str], key: str) -> str:
    """The row of detect_key for one candidate."""
    other, kb = [c for c in mapping if c != key], mapping[key]
    once = lambda t, c: f"(SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) = 1)"
    sums = ", ".join(f"coalesce(sum((x.{c} IS NOT DISTINCT FROM y.{mapping[c]})::INT), 0) AS e_{c}" for c in other)
    return (
        f"SELECT '{key}' AS key_a, '{kb}' AS key_b, n_pairs, round(n_pairs / n_union, 9) AS ratio, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN e_{c} > 0.01 * n_pairs THEN '{c}' END" for c in other)
        + "], lambda c: c IS NOT NULL)), ',') AS dependents, (" + " + ".join(f"e_{c}" for c in other) + f")::BIGINT AS equal_cells, least(ra, rb) AS least FROM (SELECT count(*) AS n_pairs, {sums} FROM {a} x JOIN {b} y ON x.{key} = y.{kb} WHERE x.{key} IN {once(a, key)} AND y.{kb} IN {once(b, kb)}),"
        f" (SELECT count(DISTINCT v) AS n_union FROM (SELECT {key} AS v FROM {a} UNION ALL SELECT {kb} FROM {b})), (SELECT count(DISTINCT {key}) / count(*) AS ra FROM {a}), (SELECT count(DISTINCT {kb}) / count(*) AS rb FROM {b})"
    )


_KEYS_SQL = "SELECT key_a, key_b, n_pairs, ratio, dependents, equal_cells FROM (" + " UNION ALL ".join(_key_sql(HOLES, "orders", _SAME, k) for k in ORDER_COLUMNS if k != "o_totalprice") + ") WHERE ratio >= 0.01 AND least >= 0.01"


@query(_KEYS_SQL)
def detect_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keys.detect_key(_holes(spark, sf_dir), read(spark, sf_dir, "orders"), _SAME)
    return found.withColumn("ratio", F.round("ratio", 9)).withColumn("dependents", F.array_join("dependents", ","))


@query("SELECT o_orderkey AS row_a, o_orderkey AS row_b FROM orders")
def key_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.key_rows(_holes(spark, sf_dir), read(spark, sf_dir, "orders"), "o_orderkey", "o_orderkey", "o_orderkey", "o_orderkey")


_LINES = {"o_orderkey": "l_orderkey", "o_custkey": "l_partkey", "o_totalprice": "l_extendedprice"}
_EQUAL_SQL = "(SELECT o_orderkey AS k, count(*) AS n, max((o_custkey IS NOT DISTINCT FROM l_partkey)::INT) AS e1, max((o_totalprice IS NOT DISTINCT FROM l_extendedprice)::INT) AS e2 FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)"


@query(
    f"SELECT 'o_orderkey' AS key_a, 'l_orderkey' AS key_b, 'a' AS unique_side, sum(n)::BIGINT AS n_pairs, round(count(*) / (SELECT count(DISTINCT v) FROM (SELECT o_orderkey AS v FROM orders UNION ALL SELECT l_orderkey FROM lineitem)), 9) AS ratio,"
    f" concat_ws(',', CASE WHEN sum(e1) > 0.05 * count(*) THEN 'o_custkey' END, CASE WHEN sum(e2) > 0.05 * count(*) THEN 'o_totalprice' END) AS dependents, (sum(e1) + sum(e2))::BIGINT AS equal_cells FROM {_EQUAL_SQL}"
)
def detect_foreign_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keys.detect_foreign_key(read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem"), _LINES, ["o_orderkey"])
    return found.withColumn("ratio", F.round("ratio", 9)).withColumn("dependents", F.array_join("dependents", ","))


@query(
    "SELECT c AS col_a, c AS col_b, n AS equal, round(n / total, 9) AS share, n > 0.01 * total AS dependent FROM (SELECT count(*) AS total, sum((x.o_totalprice IS NOT DISTINCT FROM y.o_totalprice)::INT) AS same FROM " + HOLES + " x JOIN orders y USING (o_orderkey)),"
    " LATERAL (VALUES ('o_custkey', total), ('o_orderstatus', total), ('o_orderpriority', total), ('o_totalprice', same)) v(c, n)"
)
def full_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.full_dependency(_holes(spark, sf_dir), read(spark, sf_dir, "orders"), _SAME, "o_orderkey").withColumn("share", F.round("share", 9))


@query(f"SELECT a AS col_a, b AS col_b, n AS equal, round(n / total, 9) AS share, n > 0.05 * total AS dependent FROM (SELECT count(*) AS total, sum(e1) AS s1, sum(e2) AS s2 FROM {_EQUAL_SQL}), LATERAL (VALUES ('o_custkey', 'l_partkey', s1), ('o_totalprice', 'l_extendedprice', s2)) v(a, b, n)")
def full_foreign_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.full_dependency(read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem"), _LINES, "o_orderkey", foreign="a").withColumn("share", F.round("share", 9))


@query(f"SELECT 'detected' AS how, key_a, key_b FROM ({_KEYS_SQL} ORDER BY equal_cells DESC, key_a LIMIT 1) UNION ALL SELECT 'supplied', 'o_custkey', 'o_custkey'")
def key_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _holes(spark, sf_dir), read(spark, sf_dir, "orders")
    rows = [("detected", *k) for k in keys.choose_key(a, b, _SAME)] + [("supplied", *k) for k in keys.choose_key(a, b, _SAME, ["o_custkey", "no_column"])]
    return spark.createDataFrame(rows, "how string, key_a string, key_b string")


# ---- relatedness ------------------------------------------------------------------------------------------------
_PARTIAL = {"o_custkey": "o_custkey", "o_orderkey": "o_orderkey", "o_totalprice": "o_totalprice"}
_COMMON_SQL = (
    f"tuples AS (SELECT count(*) AS n FROM (SELECT o_custkey, o_orderkey, o_totalprice FROM {HOLES} UNION SELECT o_custkey, o_orderkey, o_totalprice FROM orders)), one AS (SELECT count(*) AS n, count(DISTINCT o_custkey) / count(*) AS rc, count(DISTINCT o_orderkey) / count(*) AS rk, count(DISTINCT o_totalprice) / count(*) AS rp FROM {HOLES}), whole AS (SELECT count(*) AS n, count(DISTINCT o_totalprice) / count(*) AS rp FROM orders),"
    " scores AS (SELECT 0 AS place, 'o_custkey' AS key, CASE WHEN rc <= 0.3 THEN 0 ELSE tuples.n / (one.n + whole.n) END AS score, NULL::DOUBLE AS rows FROM tuples, one, whole UNION ALL SELECT 1, 'o_orderkey', CASE WHEN rk <= 0.3 THEN 0 ELSE tuples.n / (one.n + whole.n) END, NULL FROM tuples, one, whole"
    " UNION ALL SELECT 2, 'o_totalprice', CASE WHEN least(one.rp, whole.rp) <= 0.3 THEN 0 ELSE tuples.n / (one.n + whole.n) END, NULL FROM tuples, one, whole), best AS (SELECT key, score FROM scores ORDER BY score DESC, place LIMIT 1),"
    " jac AS (SELECT key, score, CASE key WHEN 'o_totalprice' THEN (SELECT count(DISTINCT o_totalprice) FROM " + HOLES + ") / (SELECT count(DISTINCT o_totalprice) FROM orders) ELSE 1 END AS row_sim FROM best)"
)


def _related_sql(columns: str) -> str:
    return f"WITH {_COMMON_SQL} SELECT key, round(score, 9) AS key_score, round({columns}, 9) AS col_sim, round(row_sim, 9) AS row_sim, round(0.5::DOUBLE * ({columns}) + 0.5::DOUBLE * row_sim, 9) AS score FROM jac"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("key", *(r9(c) for c in ("key_score", "col_sim", "row_sim", "score")))


@query(_related_sql("(1 + 2 * score) / 9"))
def rel_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(keys.related_by_rows(_holes(spark, sf_dir), read(spark, sf_dir, "orders"), _PARTIAL, 0.5, 0.3))


@query(_related_sql("(1 + 4 * score) / 7"))
def rel_similarity_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(keys.related_by_rows(_holes(spark, sf_dir), read(spark, sf_dir, "orders"), _PARTIAL, 0.5, 0.3, full=_SAME))


@query(_related_sql("(1 + 5 * score) / 9"))
def rel_joinable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(keys.related_by_join(_holes(spark, sf_dir), read(spark, sf_dir, "orders"), _PARTIAL, 0.5, 0.3))


_JOIN_ROW = "(SELECT (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) / (SELECT count(DISTINCT v) FROM (SELECT o_orderkey AS v FROM orders UNION ALL SELECT l_orderkey FROM lineitem)))"


@query(f"SELECT 'o_orderkey' AS key, 1.0 AS key_score, round(11 / 13, 9) AS col_sim, round({_JOIN_ROW}, 9) AS row_sim, round(0.5::DOUBLE * 11 / 13 + 0.5::DOUBLE * {_JOIN_ROW}, 9) AS score")
def rel_joinable_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    partial = {"o_custkey": "l_partkey", "o_orderkey": "l_orderkey"}
    return _rounded(keys.related_by_join(read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem"), partial, 0.5, 0.0, full=_LINES))


# ---- storage cost -----------------------------------------------------------------------------------------------
_THREE = ["o_orderkey", "o_custkey", "o_orderstatus"]
_THREE_SQL = "(SELECT o_orderkey, o_custkey, o_orderstatus FROM orders)"
_DONE_SQL = "(SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F')"
_SIZE3 = "sum(8 + length(o_orderstatus))"
_TEXT3 = "sum(length(o_orderkey || ',' || o_custkey || ',' || o_orderstatus))"
_CODE = "done = orders[orders.o_orderstatus == 'F']"


def _three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(*_THREE)


def _done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finished orders, a table that was derived from orders."""
    return _three(spark, sf_dir).where("o_orderstatus = 'F'")


@query("SELECT count(*) AS n_join, round(count(*) / (SELECT count(*) FROM customer), 9) AS score_a, round(count(*) / (SELECT count(*) FROM orders), 9) AS score_b FROM customer JOIN orders ON c_custkey = o_custkey")
def join_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.join_score(read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders"), "c_custkey", "o_custkey").select("n_join", r9("score_a"), r9("score_b"))


@query(
    "WITH j AS (SELECT count(*) AS n_join, count(DISTINCT c_custkey) AS n_in FROM customer JOIN orders ON c_custkey = o_custkey), a AS (SELECT count(*) AS n, sum(16 + length(c_name) + length(c_mktsegment)) AS s FROM customer),"
    " b AS (SELECT count(*) AS n, sum(20 + length(o_orderstatus) + length(o_orderpriority)) AS s, sum(length(o_custkey::VARCHAR)) AS t FROM orders), f AS (SELECT n_in / a.n AS sa, n_in / b.n AS sb, n_join / a.n AS ca, n_join / b.n AS cb, a.s * n_in / a.n AS za, b.s * n_in / b.n AS zb, b.t FROM j, a, b)"
    " SELECT round(za + zb - za * cb - zb * ca + sb * ca * t, 3) AS benefit FROM f"
)
def join_benefit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = storage.join_benefit(read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders"), {"c_custkey": "o_custkey"})
    return found.select(F.round("benefit", 3).alias("benefit"))


_CELLS3 = " UNION ALL ".join(f"SELECT '{c}' AS c, {k} AS pos, {c}::VARCHAR AS v FROM SOURCE" for k, c in enumerate(_THREE))
_OVERLAP = (
    f"WITH RECURSIVE x AS (SELECT DISTINCT * FROM ({_CELLS3.replace('SOURCE', _THREE_SQL)})), y AS (SELECT DISTINCT * FROM ({_CELLS3.replace('SOURCE', _DONE_SQL)})), nx AS (SELECT c, pos, count(*) AS n FROM x GROUP BY ALL), ny AS (SELECT c, pos, count(*) AS n FROM y GROUP BY ALL),"
    " pairs AS (SELECT 1 AS grp, nx.c AS col_a, nx.pos AS pos_a, ny.c AS col_b, ny.pos AS pos_b, (SELECT count(*) FROM x JOIN y USING (v) WHERE x.c = nx.c AND y.c = ny.c) / least(nx.n, ny.n) AS overlap FROM nx, ny)"
)


@query(_OVERLAP + _greedy("(SELECT * FROM pairs WHERE overlap >= 0.5)", "overlap DESC, pos_a, pos_b", group="grp") + " SELECT a AS col_a, b AS col_b FROM chosen")
def join_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([*storage.join_pair(_three(spark, sf_dir), _done(spark, sf_dir)).items()], "col_a string, col_b string")


@query(f"SELECT 'orders' AS table_name, 'o_custkey=o_custkey,o_orderkey=o_orderkey,o_orderstatus=o_orderstatus' AS pair, {_TEXT3}::BIGINT AS benefit FROM {_THREE_SQL}")
def best_join_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns are kept as a table already, beside one that nothing joins with."""
    name, pair, benefit = storage.best_join_table({"nation": read(spark, sf_dir, "nation"), "orders": _three(spark, sf_dir)}, _three(spark, sf_dir), accept=True)
    return spark.createDataFrame([(name, ",".join(f"{x}={y}" for x, y in sorted(pair.items())), round(benefit))], "table_name string, pair string, benefit long")


@query(f"SELECT 'orders' AS table_name, -{_SIZE3}::BIGINT AS benefit FROM {_DONE_SQL}")
def best_union_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = _three(spark, sf_dir).where("o_orderstatus = 'O'")
    return spark.createDataFrame([storage.best_union_table({"open": open_, "orders": _three(spark, sf_dir), "nation": read(spark, sf_dir, "nation")}, _done(spark, sf_dir))], "table_name string, benefit long")


@query("SELECT round(0.1::DOUBLE * 0.01 * 3 * count(*) + 4 * 3 * count(*) + (SELECT sum(DISTINCT 4) FROM nation) * 0 + (SELECT 4 * count(DISTINCT n_nationkey) + 4 * count(DISTINCT n_regionkey) FROM nation) + (SELECT sum(length(n)) FROM (SELECT DISTINCT n_name AS n FROM nation)), 6) AS cost FROM nation")
def cost_join_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.join_column_cost(read(spark, sf_dir, "nation")).select(F.round("cost", 6).alias("cost"))


_COST_SQL = (
    f"WITH d AS (SELECT count(*) AS n, {_SIZE3} AS s, {_TEXT3} AS t FROM {_DONE_SQL}), o AS (SELECT count(*) AS n, {_SIZE3} AS s FROM {_THREE_SQL}),"
    " saved AS (SELECT trunc(o.s * (d.n / o.n) + d.s - o.s * (d.n / o.n) * 1 - d.s * (d.n / o.n) + 1 * (d.n / o.n) * d.t - 4 * d.n) AS j FROM d, o),"
    f" costs AS (SELECT unnest([{{'strategy': 'separate', 'cost': 0.9::DOUBLE * s + 0.1::DOUBLE * 0.01 * n}}, {{'strategy': 'lineage', 'cost': 0.1::DOUBLE * 3 + 0.9::DOUBLE * {len(_CODE)}}}, {{'strategy': 'join_row', 'cost': 0.9::DOUBLE * (s - j) + 0.1::DOUBLE * 0.01 * n}}, {{'strategy': 'union_row', 'cost': 0.1::DOUBLE * 0.01 * n}}], recursive := true) FROM d, saved)"
)


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.strategy_statistics(_done(spark, sf_dir), {"orders": _three(spark, sf_dir)}, 3.0, _CODE)


@query(_COST_SQL + " SELECT strategy, round(cost, 3) AS cost FROM costs")
def strategy_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.strategy_costs(_statistics(spark, sf_dir)).select("strategy", F.round("cost", 3).alias("cost"))


@query(_COST_SQL + " SELECT strategy, round(cost, 3) AS cost FROM costs ORDER BY costs.cost LIMIT 1")
def choose_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.choose_strategy(_statistics(spark, sf_dir)).select("strategy", F.round("cost", 3).alias("cost"))
