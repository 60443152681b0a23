"""Registered queries of ranked search and its parts, over whole tables, with SQL twins written from the definitions.

The query table is orders with some prices missing; candidates are orders, lineitem, customer, supplier, part and nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import provenance, sketch
from tidewater.plans import candidates, search
from tidewater.plans.queries import _CODE, _MAPDIST_SQL, _STAR_SQL, _greedy, _stars, _values, query, r9, remembered, with_holes
from tidewater.plans.tables import new_folder
from tidewater.sources.lake import Lake, family
from tidewater.sources.store import STATES, Store

QUERY = "orders_holes"
_HOLES = "(SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders)"
#: source, columns with their type families, row id, and number of all columns
_SHAPES = {
    QUERY: (_HOLES, "o_orderkey:0:long o_custkey:1:long o_orderstatus:2:string o_totalprice:3:double o_orderpriority:5:string", "o_orderkey", 6),
    "orders": ("orders", "o_orderkey:0:long o_custkey:1:long o_orderstatus:2:string o_totalprice:3:double o_orderpriority:5:string", "o_orderkey", 6),
    "customer": ("customer", "c_custkey:0:long c_name:1:string c_nationkey:2:long c_acctbal:3:double c_mktsegment:4:string", "c_custkey", 5),
    "nation": ("nation", "n_nationkey:0:long n_name:1:string n_regionkey:2:long", "n_nationkey", 3),
    "supplier": ("supplier", "s_suppkey:0:long s_name:1:string s_nationkey:2:long s_acctbal:3:double", "s_suppkey", 4),
    "part": ("part", "p_partkey:0:long p_name:1:string p_brand:2:string p_type:3:string p_size:4:long p_retailprice:5:double", "p_partkey", 6),
    "lineitem": (
        "lineitem", "l_orderkey:0:long l_partkey:1:long l_suppkey:2:long l_linenumber:3:long l_quantity:4:double l_extendedprice:5:double l_discount:6:double l_tax:7:double l_returnflag:8:string l_linestatus:9:string",
        "l_orderkey * 100 + l_linenumber", 11,
    ),
}
_N_A = _SHAPES[QUERY][3]


def whole_lake(spark: SparkSession, sf_dir: str) -> Lake:
    return remembered(spark, "whole", sf_dir, lambda: _whole_lake(spark, sf_dir))


def _whole_lake(spark: SparkSession, sf_dir: str) -> Lake:
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    return Lake(spark, {QUERY: with_holes(read("orders"))} | {n: read(n) for n in _SHAPES if n != QUERY})


def _cells() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, {p} AS pos, '{k}' AS dtype, CAST({rid} AS BIGINT) AS rid, CAST({c} AS VARCHAR) AS value FROM {source}"
        for t, (source, columns, rid, _) in _SHAPES.items() for c, p, k in (x.split(":") for x in columns.split())
    )


_LAKE = f"cells AS MATERIALIZED ({_cells()}), vals AS MATERIALIZED (SELECT table_name, column_name, any_value(pos) AS pos, any_value(dtype) AS dtype, value, count(*) AS n FROM cells GROUP BY table_name, column_name, value), stats AS MATERIALIZED (SELECT table_name, column_name, any_value(pos) AS pos, any_value(dtype) AS dtype, sum(n) AS n_rows, sum(CASE WHEN value IS NOT NULL THEN n ELSE 0 END) AS held, count(value) AS nd FROM vals GROUP BY table_name, column_name)"
_PAIRS = (
    _LAKE + f", shared AS (SELECT x.column_name AS col_a, x.pos AS pos_a, y.table_name AS table_b, y.column_name AS col_b, y.pos AS pos_b, x.dtype, count(*) AS n_both FROM vals x JOIN vals y ON x.dtype = y.dtype AND x.value = y.value WHERE x.table_name = '{QUERY}' AND y.table_name <> '{QUERY}' GROUP BY ALL),"
    f" pairs AS MATERIALIZED (SELECT s.*, a.nd AS n_a, b.nd AS n_b, a.n_rows AS rows_a, a.held AS held_a, a.nd / a.n_rows AS ratio_a, b.nd / b.n_rows AS ratio_b, n_both / (a.nd + b.nd - n_both) AS jaccard FROM shared s JOIN stats a ON a.table_name = '{QUERY}' AND a.column_name = col_a JOIN stats b ON b.table_name = table_b AND b.column_name = col_b)"
)
_MAPPED = (
    f"WITH RECURSIVE {_PAIRS}" + _greedy("(SELECT * FROM pairs WHERE jaccard >= 0.5)")
    + ", m AS MATERIALIZED (SELECT p.* FROM chosen c JOIN pairs p ON p.table_b = c.table_b AND p.col_a = c.a AND p.col_b = c.b), wide AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', {x[3]})" for t, x in _SHAPES.items() if t != QUERY) + ") v(table_b, n_cols))"
)
_BOUNDS = _MAPPED + (
    f", best AS (SELECT table_b, count(*) AS mapped, max(jaccard) AS row_ub, max(1 - n_both / rows_a) AS new_row_ub, sum((rows_a - held_a) / (rows_a * {_N_A})) AS nan_ub FROM m GROUP BY table_b),"
    f" ub AS (SELECT table_b AS table_name, {_N_A} AS n_a, n_cols AS n_b, coalesce(mapped, 0) AS mapped, CASE WHEN mapped > 0 THEN least({_N_A}, n_cols) / ({_N_A} + n_cols - mapped) ELSE 0 END AS col_ub, coalesce(row_ub, 0) AS row_ub,"
    f" CASE WHEN mapped > 0 THEN ({_N_A} - mapped) / {_N_A} ELSE 1 END AS new_col_ub, coalesce(new_row_ub, 0) AS new_row_ub, coalesce(nan_ub, 0) AS nan_ub FROM wide LEFT JOIN best USING (table_b))"
)
_RANDOM = _MAPPED + (
    ", once AS MATERIALIZED (SELECT table_name, column_name, value FROM vals WHERE n = 1 AND value IS NOT NULL),"
    f" kp AS MATERIALIZED (SELECT m.table_b, m.col_a, m.col_b, x.rid AS ra, y.rid AS rb FROM m JOIN once u ON u.table_name = '{QUERY}' AND u.column_name = m.col_a JOIN once w ON w.table_name = m.table_b AND w.column_name = m.col_b AND w.value = u.value"
    f" JOIN cells x ON x.table_name = '{QUERY}' AND x.column_name = m.col_a AND x.value = u.value JOIN cells y ON y.table_name = m.table_b AND y.column_name = m.col_b AND y.value = u.value WHERE m.dtype <> 'double'),"
    " kept AS (SELECT m.table_b, m.col_a, m.col_b, count(kp.ra) AS n_pairs FROM m LEFT JOIN kp USING (table_b, col_a, col_b) WHERE m.dtype <> 'double' AND least(m.ratio_a, m.ratio_b) >= 0.01 GROUP BY m.table_b, m.col_a, m.col_b, m.n_a, m.n_b, m.n_both HAVING count(kp.ra) / (m.n_a + m.n_b - m.n_both) >= 0.01),"
    f" equal AS (SELECT k.table_b, k.col_a, count(*) AS n FROM kept k JOIN kp USING (table_b, col_a, col_b) JOIN m o ON o.table_b = k.table_b AND o.col_a <> k.col_a JOIN cells p ON p.table_name = '{QUERY}' AND p.column_name = o.col_a AND p.rid = kp.ra"
    " JOIN cells q ON q.table_name = o.table_b AND q.column_name = o.col_b AND q.rid = kp.rb WHERE p.value IS NOT DISTINCT FROM q.value GROUP BY k.table_b, k.col_a),"
    " best AS (SELECT table_b, col_a AS key_a FROM (SELECT k.table_b, k.col_a, row_number() OVER (PARTITION BY k.table_b ORDER BY coalesce(e.n, 0) DESC, k.col_a) AS rn FROM kept k LEFT JOIN equal e USING (table_b, col_a)) WHERE rn = 1),"
    f" fills AS (SELECT b.table_b, count(*) / ((SELECT count(*) FROM {_HOLES}) * {_N_A}) AS nan_delta FROM best b JOIN kp ON kp.table_b = b.table_b AND kp.col_a = b.key_a JOIN m o ON o.table_b = b.table_b JOIN cells p ON p.table_name = '{QUERY}' AND p.column_name = o.col_a AND p.rid = kp.ra"
    " JOIN cells q ON q.table_name = o.table_b AND q.column_name = o.col_b AND q.rid = kp.rb WHERE p.value IS NULL AND q.value IS NOT NULL GROUP BY b.table_b),"
    " nm AS (SELECT table_b, count(*) AS mapped FROM m GROUP BY table_b),"
    f" comp AS (SELECT w.table_b AS table_name, coalesce(b.key_a, '') AS keys, {_N_A} AS n_a, n_cols AS n_b, coalesce(mapped, 0) AS mapped, CASE WHEN mapped > 0 THEN mapped / ({_N_A} + n_cols - mapped) ELSE 0 END AS col_sim, coalesce(m.jaccard, 0) AS row_sim,"
    f" ({_N_A} - coalesce(mapped, 0)) / {_N_A} AS new_col_rate, coalesce(1 - m.n_both / m.rows_a, 0) AS new_row_rate, coalesce(nan_delta, 0) AS nan_delta FROM wide w LEFT JOIN nm USING (table_b) LEFT JOIN best b USING (table_b) LEFT JOIN m ON m.table_b = b.table_b AND m.col_a = b.key_a LEFT JOIN fills f ON f.table_b = w.table_b)"
)
#: Which code made which table; the query's is that of the first view.
_MADE = [("lineitem", "v2"), ("orders", "v1"), ("part", "v3")]
_PROV = (
    ", " + _values(_MADE, "made", "table_name, view_id") + ", " + _MAPDIST_SQL.removeprefix("WITH RECURSIVE ").replace("chosen", "picked").replace("ranked", "lined").replace("walk", "stroll").replace("ended", "halted")
    + ", prov AS (SELECT table_name, 1 - 1 / (1 + exp(-distance)) AS prov FROM made JOIN total USING (view_id))"
)


def _provenance(spark: SparkSession, lake: Lake) -> DataFrame:
    stars = _stars(spark).join(spark.createDataFrame(_MADE, "table_name string, view_id string"), "view_id").select(F.col("table_name").alias("view_id"), "node", "label")
    own = _stars(spark).where("view_id = 'v1'").drop("view_id")
    return search.provenance_of(lake, [n for n in lake.names() if n != QUERY], own, stars)


def _found(spark: SparkSession, sf_dir: str, mode: int, k: int = 3) -> search.Found:
    lake = whole_lake(spark, sf_dir)
    return search.dispatch(lake, mode, QUERY, k=k, provenance=_provenance(spark, lake))


def _hits(spark: SparkSession, sf_dir: str, mode: int) -> DataFrame:
    return _found(spark, sf_dir, mode).hits.select("table_name", r9("score"))


def _scored(weights: str) -> str:
    return _RANDOM + _PROV + f", scored AS (SELECT table_name, {weights} AS score FROM comp LEFT JOIN prov USING (table_name)) SELECT table_name, round(score, 9) AS score FROM scored ORDER BY score DESC, table_name LIMIT 3"


_TRAINING = "0.5::DOUBLE * coalesce(prov, 0) + 0.2::DOUBLE * col_sim + (1 - 0.5::DOUBLE - 0.2::DOUBLE) * new_row_rate"


@query(_scored(_TRAINING))
def search_additional_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, search.TRAINING)


@query(_scored("0.4::DOUBLE * coalesce(prov, 0) + 0.4::DOUBLE * row_sim + (1 - 0.4::DOUBLE - 0.4::DOUBLE) * new_col_rate"))
def search_alternative_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, search.FEATURES)


@query(_scored("0.4::DOUBLE * coalesce(prov, 0) + 0.4::DOUBLE * col_sim + 0.1::DOUBLE * row_sim + (1 - 0.4::DOUBLE - 0.4::DOUBLE - 0.1::DOUBLE) * nan_delta"))
def search_data_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, search.CLEANING)


def _random(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = whole_lake(spark, sf_dir)
    names = [n for n in lake.names() if n != QUERY]
    return search.random_access(lake, QUERY, names, search.mapped_pairs(lake, QUERY, names))


@query(_RANDOM + " SELECT table_name, keys, round(col_sim, 9) AS col_sim, round(row_sim, 9) AS row_sim, round(new_col_rate, 9) AS new_col_rate, round(new_row_rate, 9) AS new_row_rate, round(nan_delta, 9) AS nan_delta FROM comp")
def random_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _random(spark, sf_dir).select("table_name", "keys", *(r9(c) for c in ("col_sim", "row_sim", "new_col_rate", "new_row_rate", "nan_delta")))


@query(_RANDOM + " SELECT table_name, n_a, n_b, mapped, round(col_sim, 9) AS col_sim FROM comp")
def col_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _random(spark, sf_dir).select("table_name", "n_a", "n_b", "mapped", r9("col_sim"))


@query(_RANDOM + " SELECT table_name, round(new_col_rate, 9) AS new_col_rate FROM comp")
def new_col_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _random(spark, sf_dir).select("table_name", r9("new_col_rate"))


@query(_RANDOM + " SELECT table_name, round(row_sim, 9) AS jaccard FROM comp")
def key_row_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _random(spark, sf_dir).select("table_name", F.round("row_sim", 9).alias("jaccard"))


def _bounds(spark: SparkSession, sf_dir: str) -> tuple[Lake, DataFrame]:
    lake = whole_lake(spark, sf_dir)
    names = [n for n in lake.names() if n != QUERY]
    return lake, search.bounds(lake, QUERY, names, search.mapped_pairs(lake, QUERY, names))


_UBS = ("col_ub", "row_ub", "new_col_ub", "new_row_ub", "nan_ub")


@query(_BOUNDS + " SELECT table_name, " + ", ".join(f"round({c}, 9) AS {c}" for c in _UBS) + " FROM ub")
def ub_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounds(spark, sf_dir)[1].select("table_name", *(r9(c) for c in _UBS))


@query(_BOUNDS + _PROV + " SELECT table_name, round(0.4::DOUBLE * coalesce(prov, 0) + 0.4::DOUBLE * (SELECT max(col_ub) FROM ub) + 0.1::DOUBLE * (SELECT max(row_ub) FROM ub) + (1 - 0.4::DOUBLE - 0.4::DOUBLE - 0.1::DOUBLE) * (SELECT max(nan_ub) FROM ub), 9) AS ub FROM ub LEFT JOIN prov USING (table_name)")
def sorted_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake, bounds = _bounds(spark, sf_dir)
    known = bounds.join(_provenance(spark, lake), "table_name", "left")
    return search.sorted_access(known, search.CLEANING, F.coalesce("prov", F.lit(0.0))).select("table_name", r9("ub"))


@query(_scored(_TRAINING).replace("LIMIT 3", "LIMIT 1"))
def threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, search.TRAINING, 1).hits.select("table_name", r9("score"))


@query("SELECT 'orders_holes' AS name, true AS loaded UNION ALL SELECT 'unknown', false")
def search_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = whole_lake(spark, sf_dir)
    return spark.createDataFrame([(n, search.dispatch(lake, 0, n)) for n in (QUERY, "unknown")], "name string, loaded boolean")


@query(
    _RANDOM + _PROV + f", scored AS (SELECT table_name, {_TRAINING} AS score FROM comp LEFT JOIN prov USING (table_name)), top AS (SELECT row_number() OVER (ORDER BY score DESC, table_name) AS rank, * FROM scored),"
    " sizes AS (SELECT table_name, any_value(n_rows) AS n_rows FROM stats GROUP BY table_name) SELECT rank, table_name, round(score, 9) AS score, 'table' AS kind, n_rows * n_cols AS n_cells, least(n_rows, 10) AS shown FROM top JOIN sizes USING (table_name) JOIN wide ON table_b = table_name WHERE rank <= 3"
)
def result_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = whole_lake(spark, sf_dir)
    found = search.search(lake, QUERY, search.TRAINING, 3, provenance=_provenance(spark, lake))
    shown = (F.length("preview") - F.length(F.replace("preview", F.lit("<tr><td>"), F.lit("")))) / 8
    return search.result_rows(lake, found.hits).select("rank", "table_name", r9("score"), "kind", "n_cells", shown.cast("long").alias("shown"))


@query(_RANDOM + " SELECT 3 AS mode, 'orders_holes' AS query, table_name, x.component, round(x.score, 9) AS score FROM (SELECT table_name, unnest([{'component': 'col_sim', 'score': col_sim::DOUBLE}, {'component': 'row_sim', 'score': row_sim::DOUBLE}, {'component': 'new_col_rate', 'score': new_col_rate::DOUBLE}, {'component': 'new_row_rate', 'score': new_row_rate::DOUBLE}, {'component': 'nan_delta', 'score': nan_delta::DOUBLE}]) AS x FROM comp)")
def topk_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first search keeps two tables, a second one the others and one again; the state holds all of them once."""
    lake, store = whole_lake(spark, sf_dir), Store(spark, new_folder(spark, "state"))
    names = [n for n in lake.names() if n != QUERY]
    scored = _random(spark, sf_dir)
    search.save_state(store, 3, QUERY, scored.where(F.col("table_name").isin(*names[:2])))
    return search.save_state(store, 3, QUERY, scored.where(F.col("table_name").isin(*names[1:]))).withColumn("score", F.round("score", 9))


@query("SELECT * FROM (VALUES ('customer', true), ('lineitem', false), ('nation', false), ('orders', true), ('part', false), ('supplier', false)) v(table_name, known)")
def wiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, new_folder(spark, "state"))
    store.create(STATES)
    kept = spark.createDataFrame([(1, QUERY, n, "col_sim", 0.5) for n in ("customer", "orders")] + [(2, QUERY, "part", "col_sim", 0.5)], STATES["topk_state"])
    names = spark.createDataFrame([(n,) for n in _SHAPES if n != QUERY], "table_name string")
    return search.split_known(names, store.replace("topk_state", kept), 1, QUERY)


# ---- candidates -------------------------------------------------------------------------------------------------
_SIGNED = _LAKE + (
    ", texts AS (SELECT table_name, column_name, value FROM vals WHERE dtype = 'string' AND value IS NOT NULL), hashed AS (SELECT table_name, column_name, ('0x' || substr(md5(value), 1, 7))::BIGINT AS h FROM texts),"
    f" sig AS (SELECT table_name, column_name, i::INT AS hash_idx, min((((i * 2654435 + 40503) % {sketch.PRIME} + 1) * h + (i * 97531 + 12345) % {sketch.PRIME}) % {sketch.PRIME}) AS hv FROM hashed, range({sketch.NUM_HASH}) r(i) GROUP BY ALL),"
    f" bands AS MATERIALIZED (SELECT table_name, column_name, (hash_idx // {sketch.MAX_K})::INT AS band_idx, list(hv ORDER BY hash_idx) AS band_key FROM sig GROUP BY ALL)"
)


def _placed(tables: str, first: str = "0") -> str:
    """Size partitions of the string columns of some tables."""
    return (
        f"SELECT table_name, column_name, nd AS n_values, ({first} + least(floor((row_number() OVER (ORDER BY nd, table_name, column_name) - 1) / greatest(ceil(count(*) OVER () / {sketch.NUM_PART}), 1)), {sketch.NUM_PART - 1}))::INT AS part_idx"
        f" FROM stats WHERE dtype = 'string' AND held > 0 AND table_name {tables}"
    )


_TUNED = (
    f", placed AS MATERIALIZED ({_placed(f"<> '{QUERY}'")}), bounds AS (SELECT part_idx, max(n_values) AS upper FROM placed GROUP BY part_idx), qs AS (SELECT DISTINCT nd AS q FROM stats WHERE table_name = '{QUERY}' AND dtype = 'string'),"
    " pq AS (SELECT DISTINCT upper, q FROM bounds, qs), g AS (SELECT *, least(1.0::DOUBLE, upper / q) AS most FROM pq, range(1, 5) k(k), range(1, 65) l(l)), t AS (SELECT *, least(0.7::DOUBLE, most) AS cut FROM g),"
    " p AS (SELECT *, (i + 0.5::DOUBLE) * cut / 200 AS x, cut + (i + 0.5::DOUBLE) * (most - cut) / 200 AS y FROM t, range(200) r(i)),"
    " e AS (SELECT upper, q, k, l, sum(1 - pow(1 - pow(least(1, x / (upper / q + 1 - x)), k), l)) * any_value(cut) / 200 AS neg, sum(pow(1 - pow(least(1, y / (upper / q + 1 - y)), k), l)) * (any_value(most) - any_value(cut)) / 200 AS pos, any_value(cut) AS cut FROM p GROUP BY ALL),"
    " kl AS MATERIALIZED (SELECT upper, q, k, l FROM (SELECT *, row_number() OVER (PARTITION BY upper, q ORDER BY round(neg + pos, 12), k, l) AS rn FROM e) WHERE rn = 1),"
    f" hit AS (SELECT DISTINCT x.column_name AS q_column, y.table_name, y.column_name FROM bands x JOIN stats s ON s.table_name = x.table_name AND s.column_name = x.column_name JOIN bands y ON x.band_idx = y.band_idx JOIN placed p ON p.table_name = y.table_name AND p.column_name = y.column_name JOIN bounds b ON b.part_idx = p.part_idx"
    f" JOIN kl ON kl.upper = b.upper AND kl.q = s.nd WHERE x.table_name = '{QUERY}' AND x.band_idx < kl.l AND x.band_key[1:kl.k] = y.band_key[1:kl.k])"
)
_DRAWN = (
    ", num AS (SELECT table_name, column_name, dtype, value::DOUBLE AS x, n FROM vals WHERE dtype IN ('long', 'double') AND value IS NOT NULL),"
    f" pr AS (SELECT DISTINCT a.column_name AS col_a, b.table_name AS table_b, b.column_name AS col_b FROM stats a JOIN stats b ON a.dtype = b.dtype WHERE a.table_name = '{QUERY}' AND b.table_name <> '{QUERY}' AND a.dtype IN ('long', 'double')),"
    f" u AS (SELECT pr.*, x, n AS na, 0 AS nb FROM pr JOIN num ON table_name = '{QUERY}' AND column_name = col_a UNION ALL SELECT pr.*, x, 0, n FROM pr JOIN num ON table_name = table_b AND column_name = col_b), gx AS (SELECT col_a, table_b, col_b, x, sum(na) AS na, sum(nb) AS nb FROM u GROUP BY ALL),"
    " rx AS (SELECT *, sum(na) OVER w / sum(na) OVER tt AS fa, sum(nb) OVER w / sum(nb) OVER tt AS fb FROM gx WINDOW w AS (PARTITION BY col_a, table_b, col_b ORDER BY x), tt AS (PARTITION BY col_a, table_b, col_b)),"
    " ks AS (SELECT col_a, table_b, col_b FROM rx GROUP BY ALL HAVING 1 - max(abs(fa - fb)) >= 0.5)"
)


@query(f"WITH {_SIGNED}{_TUNED} SELECT * FROM hit")
def lshe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.column_hits(whole_lake(spark, sf_dir), QUERY).where("source = 'containment'").select("q_column", "table_name", "column_name")


@query(f"WITH {_SIGNED}{_TUNED}{_DRAWN} SELECT q_column, table_name, column_name, 'containment' AS source FROM hit UNION ALL SELECT col_a, table_b, col_b, 'distribution' FROM ks")
def candidate_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.candidate_hits(whole_lake(spark, sf_dir), QUERY)


_FIRST = ("customer", "nation")


@query(
    f"WITH {_SIGNED}, one AS ({_placed(f'IN {_FIRST}')}), two AS ({_placed(f'NOT IN {_FIRST}', '(SELECT max(part_idx) + 1 FROM one)')}), placed AS (FROM one UNION ALL FROM two)"
    " SELECT part_idx, table_name, column_name, band_idx, array_to_string(band_key, ',') AS band_key FROM bands JOIN placed USING (table_name, column_name)"
)
def lshe_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables are indexed first, and all others by a second run that skips them."""
    lake, store = whole_lake(spark, sf_dir), Store(spark, new_folder(spark, "index"))
    lake.values(("string",))
    domains, bare = lake.domains(("string",)), [n for n in lake.names() if "string" not in {family(k) for _, k in lake.table(n).dtypes}]
    sketch.build(store, domains.where(F.col("table_name").isin(*_FIRST)), without=[n for n in bare if n in _FIRST])
    sketch.build(store, domains, without=bare)
    return store.read("bands").withColumn("band_key", F.array_join(F.col("band_key").cast("array<string>"), ","))


@query(f"WITH {_SIGNED} SELECT table_name, column_name, hash_idx, hv FROM sig WHERE table_name NOT IN {_FIRST}")
def sig_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = whole_lake(spark, sf_dir)
    indexed = spark.createDataFrame([(n,) for n in _FIRST], "table_name string")
    return sketch.signatures(sketch.not_indexed(lake.domains(("string",)), indexed))


@query(f"WITH {_LAKE} SELECT part_idx, max(n_values) AS upper, count(*) AS num_domain FROM ({_placed(f"<> '{QUERY}'")}) GROUP BY part_idx")
def size_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.partition_bounds(sketch.size_partitions(whole_lake(spark, sf_dir).domains(("string",)).where(F.col("table_name") != QUERY)))


@query("WITH RECURSIVE " + _STAR_SQL + " SELECT view_id, node, label FROM star WHERE view_id <> 'v3'")
def query_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.query_node(spark.createDataFrame(_CODE, "view_id string, cell_id int, code string"), "out")
