"""A registered query for each operator of the related-table engine, with its SQL twin, over views of the test tables.

The lake is slices of orders (same schema, half overlap) beside customer, nation and supplier; code and people are
literal rows. Doubles are rounded to nine places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import names
from tidewater.operators import distribution, keys, matching, profiling, provenance, similarity, sketch, storage
from tidewater.sources.lake import Lake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
NUM_HASH = 16


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def slice_of(spark: SparkSession, sf_dir: str, rests: tuple[int, ...]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").where((F.col("o_orderkey") % 4).isin(*rests)).select(*ORDER_COLUMNS)


_LAKES: dict[tuple[str, str, str], Lake] = {}


def remembered(spark: SparkSession, name: str, sf_dir: str, build: Callable[[], Lake]) -> Lake:
    """A lake of this session, whose index of values is built once for all queries."""
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in _LAKES or _LAKES[key].spark is not spark:
        _LAKES[key] = build()
    return _LAKES[key]


def lake(spark: SparkSession, sf_dir: str) -> Lake:
    return remembered(spark, "slices", sf_dir, lambda: _lake(spark, sf_dir))


def _lake(spark: SparkSession, sf_dir: str) -> Lake:
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    return Lake(spark, {"orders_a": slice_of(spark, sf_dir, (0, 1)), "orders_b": slice_of(spark, sf_dir, (1, 2)), "customer": read("customer"), "nation": read("nation"), "supplier": read("supplier")})


def with_holes(orders: DataFrame) -> DataFrame:
    return orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")))


def r9(c: str):
    return F.round(F.col(c), 9).alias(c)


# ---- SQL pieces -------------------------------------------------------------------------------------------------
_A = "(SELECT * FROM orders WHERE o_orderkey % 4 IN (0, 1))"
_B = "(SELECT * FROM orders WHERE o_orderkey % 4 IN (1, 2))"
_SHAPES = {
    "orders_a": (_A, "o_orderkey:long o_custkey:long o_orderstatus:string o_totalprice:double o_orderpriority:string"),
    "orders_b": (_B, "o_orderkey:long o_custkey:long o_orderstatus:string o_totalprice:double o_orderpriority:string"),
    "customer": ("customer", "c_custkey:long c_name:string c_nationkey:long c_acctbal:double c_mktsegment:string"),
    "nation": ("nation", "n_nationkey:long n_name:string n_regionkey:long"), "supplier": ("supplier", "s_suppkey:long s_name:string s_nationkey:long s_acctbal:double"),
}


def _cells(*tables: str) -> str:
    parts = [
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, {p} AS pos, '{k}' AS dtype, CAST({c} AS VARCHAR) AS value FROM {_SHAPES[t][0]}"
        for t in tables for p, (c, k) in enumerate(x.split(":") for x in _SHAPES[t][1].split())
    ]
    return " UNION ALL ".join(parts)


_ALL = tuple(_SHAPES)
_DOM = f"cells AS ({_cells(*_ALL)}), dom AS (SELECT DISTINCT * FROM cells WHERE value IS NOT NULL), sizes AS (SELECT table_name, column_name, count(*) AS n FROM dom GROUP BY ALL)"
_PAIRS = (
    _DOM + ", shared AS (SELECT x.table_name AS table_a, x.column_name AS col_a, x.pos AS pos_a, y.table_name AS table_b, y.column_name AS col_b, y.pos AS pos_b, count(*) AS n_both"
    " FROM dom x JOIN dom y ON x.dtype = y.dtype AND x.value = y.value WHERE x.table_name = 'orders_a' AND y.table_name <> 'orders_a' GROUP BY ALL),"
    " pairs AS (SELECT s.*, a.n AS n_a, b.n AS n_b, s.n_both / (a.n + b.n - s.n_both) AS jaccard, s.n_both / a.n AS containment FROM shared s"
    " JOIN sizes a ON a.table_name = table_a AND a.column_name = col_a JOIN sizes b ON b.table_name = table_b AND b.column_name = col_b)"
)


def _greedy(source: str, order: str = "jaccard DESC, pos_a, pos_b", a: str = "col_a", b: str = "col_b", group: str = "table_b") -> str:
    """CTE ``chosen`` ({group}, a, b): pairs of ``source`` taken in order where neither side is taken yet."""
    return (
        f", ranked AS (SELECT {group}, {a} AS a, {b} AS b, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rn FROM {source}),"
        f" walk AS (SELECT DISTINCT {group}, 0::BIGINT AS rn, []::VARCHAR[] AS ua, []::VARCHAR[] AS ub FROM ranked UNION ALL"
        f" SELECT w.{group}, w.rn + 1, CASE WHEN list_contains(w.ua, r.a) OR list_contains(w.ub, r.b) THEN w.ua ELSE list_append(w.ua, r.a) END,"
        f" CASE WHEN list_contains(w.ua, r.a) OR list_contains(w.ub, r.b) THEN w.ub ELSE list_append(w.ub, r.b) END FROM walk w JOIN ranked r ON r.{group} = w.{group} AND r.rn = w.rn + 1),"
        f" ended AS (SELECT {group}, arg_max(ua, rn) AS ua, arg_max(ub, rn) AS ub FROM walk GROUP BY {group}),"
        f" chosen AS (SELECT {group}, unnest(ua) AS a, unnest(ub) AS b FROM ended)"
    )


_MAPPED = f"WITH RECURSIVE {_PAIRS}" + _greedy("(SELECT * FROM pairs WHERE jaccard >= 0.5)")


def _domains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    classes = lake(spark, sf_dir).classes()
    return classes.where("table_name = 'orders_a'"), classes.where("table_name != 'orders_a'")


# ---- sources ----------------------------------------------------------------------------------------------------
@query("SELECT 'orders_a' AS table_name, count(*) AS n_rows, 5 AS n_cols FROM " + _A + " UNION ALL SELECT 'orders_b', count(*), 5 FROM " + _B + " UNION ALL SELECT 'customer', count(*), 5 FROM customer UNION ALL SELECT 'nation', count(*), 3 FROM nation UNION ALL SELECT 'supplier', count(*), 4 FROM supplier")
def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake(spark, sf_dir).catalog()


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c}', {p}, '{k}')" for t in _ALL for p, (c, k) in enumerate(x.split(":") for x in _SHAPES[t][1].split())) + ") v(table_name, column_name, pos, dtype)")
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake(spark, sf_dir).columns()


@query(f"WITH {_DOM} SELECT table_name, column_name, n AS n_values FROM sizes")
def scan_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake(spark, sf_dir).domains().groupBy("table_name", "column_name").agg(F.count(F.lit(1)).alias("n_values"))


# ---- set similarity ---------------------------------------------------------------------------------------------
@query(f"WITH {_PAIRS} SELECT table_a, col_a, table_b, col_b, n_both AS shared, round(jaccard, 9) AS jaccard FROM pairs")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_pairs(*_domains(spark, sf_dir)).select("table_a", "col_a", "table_b", "col_b", F.col("both").alias("shared"), r9("jaccard"))


@query(f"WITH {_PAIRS} SELECT table_a, col_a, table_b, col_b, round(containment, 9) AS containment FROM pairs")
def containment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_pairs(*_domains(spark, sf_dir)).select("table_a", "col_a", "table_b", "col_b", r9("containment"))


@query(f"WITH x AS (SELECT DISTINCT o_custkey AS v FROM {_A}), y AS (SELECT DISTINCT o_custkey AS v FROM {_B}) SELECT (SELECT count(*) FROM x) AS n_a, (SELECT count(*) FROM y) AS n_b, (SELECT count(*) FROM x JOIN y USING (v)) AS shared, round((SELECT count(*) FROM x JOIN y USING (v)) / (SELECT count(*) FROM (FROM x UNION FROM y)), 9) AS jaccard")
def row_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.column_jaccard(slice_of(spark, sf_dir, (0, 1)), "o_custkey", slice_of(spark, sf_dir, (1, 2)), "o_custkey").withColumn("jaccard", F.round("jaccard", 9))


@query(f"WITH x AS (SELECT o_orderkey AS k, list_distinct([o_orderstatus, o_orderpriority, o_custkey::VARCHAR]) AS x FROM {_A}), y AS (SELECT o_orderkey AS k, list_distinct([o_orderstatus, o_orderpriority, o_custkey::VARCHAR]) AS y FROM {_B}) SELECT round(coalesce(avg(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))), 0), 9) AS record_similarity FROM x JOIN y USING (k)")
def record_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.record_similarity(slice_of(spark, sf_dir, (0, 1)), slice_of(spark, sf_dir, (1, 2)), "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_custkey"]).select(r9("record_similarity"))


@query(f"SELECT round(max(1 - shared / n), 9) AS new_row_rate FROM (SELECT (SELECT count(*) FROM {_A}) AS n, unnest([(SELECT count(DISTINCT o_orderkey) FROM {_A} WHERE o_orderkey IN (SELECT o_orderkey FROM {_B})), (SELECT count(DISTINCT o_custkey) FROM {_A} WHERE o_custkey IN (SELECT o_custkey FROM {_B}))]) AS shared)")
def new_row_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.new_row_rate(slice_of(spark, sf_dir, (0, 1)), slice_of(spark, sf_dir, (1, 2)), [("o_orderkey", "o_orderkey"), ("o_custkey", "o_custkey")]).select(r9("new_row_rate"))


@query(f"SELECT count(*) AS fills, round(count(*) / (SELECT count(*) * 5 FROM {_A}), 9) AS nan_delta FROM {_A} a JOIN {_B} b USING (o_orderkey) WHERE o_orderkey % 5 = 0")
def nan_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = with_holes(slice_of(spark, sf_dir, (0, 1))), slice_of(spark, sf_dir, (1, 2))
    return similarity.null_fills(a, b, ("o_orderkey", "o_orderkey"), [("o_totalprice", "o_totalprice"), ("o_orderstatus", "o_orderstatus")]).select("fills", r9("nan_delta"))


@query(f"SELECT 1 AS place, 'orders_a' AS table_name UNION ALL SELECT 2, 'orders_b' WHERE EXISTS ((FROM {_A}) EXCEPT ALL (FROM {_B})) OR EXISTS ((FROM {_B}) EXCEPT ALL (FROM {_A}))")
def table_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = slice_of(spark, sf_dir, (0, 1))
    tables = Lake(spark, {"orders_a": a, "orders_dup": a.orderBy(F.desc("o_orderkey")), "orders_b": slice_of(spark, sf_dir, (1, 2))})
    return spark.createDataFrame([*enumerate(similarity.without_copies(tables, ["orders_a", "orders_dup", "orders_b"], 3), 1)], "place int, table_name string")


# ---- sketches ---------------------------------------------------------------------------------------------------
_HASHED = _DOM + (
    ", hashed AS (SELECT table_name, column_name, ('0x' || substr(md5(value), 1, 7))::BIGINT AS h FROM dom WHERE dtype = 'string'),"
    f" sig AS (SELECT table_name, column_name, i::INT AS hash_idx, min((((i * 2654435 + 40503) % {sketch.PRIME} + 1) * h + (i * 97531 + 12345) % {sketch.PRIME}) % {sketch.PRIME}) AS hv FROM hashed, range({NUM_HASH}) r(i) GROUP BY ALL),"
    " bands AS (SELECT table_name, column_name, (hash_idx // 4)::INT AS band_idx, list(hv ORDER BY hash_idx) AS band_key FROM sig GROUP BY ALL),"
    " placed AS (SELECT table_name, column_name, n, least(floor((row_number() OVER (ORDER BY n, table_name, column_name) - 1) / ceil(count(*) OVER () / 3)), 2)::INT AS part_idx FROM (SELECT table_name, column_name, count(*) AS n FROM dom WHERE dtype = 'string' GROUP BY ALL))"
)


@query(f"WITH {_HASHED} SELECT * FROM sig")
def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.signatures(lake(spark, sf_dir).domains(("string",)), NUM_HASH)


@query(f"WITH {_HASHED} SELECT table_name, column_name, band_idx, array_to_string(band_key, ',') AS band_key FROM bands")
def lsh_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.bands(minhash_signature(spark, sf_dir)).withColumn("band_key", F.array_join(F.col("band_key").cast("array<string>"), ","))


_KL = [(10, 10), (100, 10), (1000, 50)]


@query(
    "WITH c(upper, q) AS (VALUES " + ", ".join(f"({u}, {q})" for u, q in _KL) + "), g AS (SELECT *, least(1.0::DOUBLE, upper / q) AS most FROM c, range(1, 5) k(k), range(1, 65) l(l)),"
    " t AS (SELECT *, least(0.7::DOUBLE, most) AS cut FROM g), p AS (SELECT *, (i + 0.5::DOUBLE) * cut / 200 AS x, cut + (i + 0.5::DOUBLE) * (most - cut) / 200 AS y FROM t, range(200) r(i)),"
    " e AS (SELECT upper, q, k, l, sum(1 - pow(1 - pow(least(1, x / (upper / q + 1 - x)), k), l)) * any_value(cut) / 200 + sum(pow(1 - pow(least(1, y / (upper / q + 1 - y)), k), l)) * (any_value(most) - any_value(cut)) / 200 AS err FROM p GROUP BY ALL)"
    " SELECT upper, q AS query_size, k, l FROM (SELECT *, row_number() OVER (PARTITION BY upper, q ORDER BY round(err, 12), k, l) AS rn FROM e) WHERE rn = 1"
)
def optimal_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(u, q, *sketch.optimal_kl(4, 256, u, q, 0.7)) for u, q in _KL], "upper long, query_size long, k long, l long")



# ---- distributions ----------------------------------------------------------------------------------------------
_KS = (
    f"WITH cells AS ({_cells('orders_a', 'customer', 'supplier')}), num AS (SELECT table_name, column_name, dtype, value::DOUBLE AS x FROM cells WHERE dtype = 'double' AND value IS NOT NULL),"
    " names AS (SELECT DISTINCT table_name, column_name FROM num), pr AS (SELECT a.table_name AS table_a, a.column_name AS col_a, b.table_name AS table_b, b.column_name AS col_b FROM names a, names b WHERE a.table_name <> b.table_name),"
    " u AS (SELECT pr.*, x, 1 AS na, 0 AS nb FROM pr JOIN num ON table_name = table_a AND column_name = col_a UNION ALL SELECT pr.*, x, 0, 1 FROM pr JOIN num ON table_name = table_b AND column_name = col_b),"
    " g AS (SELECT table_a, col_a, table_b, col_b, x, sum(na) AS na, sum(nb) AS nb FROM u GROUP BY ALL),"
    " r AS (SELECT *, sum(na) OVER w / sum(na) OVER t AS fa, sum(nb) OVER w / sum(nb) OVER t AS fb FROM g WINDOW w AS (PARTITION BY table_a, col_a, table_b, col_b ORDER BY x), t AS (PARTITION BY table_a, col_a, table_b, col_b)),"
    " ks AS (SELECT table_a, col_a, table_b, col_b, round(max(abs(fa - fb)), 9) AS d, round(1 - max(abs(fa - fb)), 9) AS score FROM r GROUP BY ALL)"
)


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lake(spark, sf_dir)
    return Lake(spark, {n: whole.table(n) for n in ("orders_a", "customer", "supplier")}).numbers().where("dtype = 'double'")


@query(f"{_KS} SELECT * FROM ks")
def ks_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _numbers(spark, sf_dir)
    return distribution.ks_pairs(x, x).select("table_a", "col_a", "table_b", "col_b", r9("d"), r9("score"))


@query(f"{_KS} SELECT * FROM ks WHERE table_a = 'customer' AND score >= 0.5")
def ks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _numbers(spark, sf_dir)
    return distribution.ks_query(x.where("table_name = 'customer'"), x).select("table_a", "col_a", "table_b", "col_b", r9("d"), r9("score"))


# ---- profiles and types -----------------------------------------------------------------------------------------
_PEOPLE = [
    ("e1", "string", ["a@b.com", "c.d@e.org", "x"]), ("e2", "string", ["a@b.com", "c.d@e.org", "f@g.net", "h@i.edu", "j@k.io", None]), ("s", "string", ["123-45-6789", "001-22-3333", "667-01-0001"]), ("bad_s", "string", ["000-45-6789", "123-00-1234"]),
    ("g1", "string", ["m", "F", None]), ("g2", "string", ["male", "female"]), ("g3", "string", ["m", "male"]), ("empty", "string", [None, None]), ("years", "long", [str(k) for k in range(2, 40)]), ("few", "long", ["30", "31"]), ("sex", "string", ["?"]),
    ("fn", "string", ["Anna", "ben", "carla"]), ("ln", "string", ["Adams", "brown"]), ("who", "string", ["Anna Brown", "dr.clark", "someone else entirely"]), ("street", "string", ["12 Main St, Springfield, IL", "5 Oak Ave, Troy, NY 12180"]), ("price", "double", ["1.5"]),
]
_PEOPLE_ROWS = [("people", c, k, v) for c, k, vs in _PEOPLE for v in vs]
_PEOPLE_SQL = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in _PEOPLE_ROWS) + ") v(table_name, column_name, dtype, value)"


def _in(xs: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


@query(
    f"WITH p AS ({_PEOPLE_SQL}), a AS (SELECT table_name, column_name, any_value(dtype) AS dtype, lower(column_name) AS nm, count(value) AS n, count(DISTINCT value) AS nd, max(try_cast(value AS BIGINT)) AS hi, min(try_cast(value AS BIGINT)) AS lo,"
    f" count(DISTINCT CASE WHEN lower(value) IN {_in(profiling.LAST_NAMES)} THEN lower(value) END) AS ln, count(DISTINCT CASE WHEN lower(value) IN {_in(profiling.FIRST_NAMES)} THEN lower(value) END) AS fn,"
    f" coalesce(avg(CASE WHEN regexp_matches(value, '^[^ .]*[ .][^ .]*$') THEN (lower(regexp_extract(value, '^([^ .]*)', 1)) IN {_in(profiling.FIRST_NAMES + profiling.TITLES)} AND lower(regexp_extract(value, '([^ .]*)$', 1)) IN {_in(profiling.LAST_NAMES)})::INT END), 0) AS full,"
    " coalesce(bool_and(lower(value) IN ('m', 'f')), true) AS g1, coalesce(bool_and(lower(value) IN ('male', 'female')), true) AS g2,"
    r" coalesce(avg(regexp_matches(value, '^\w+([.-]\w+)*@\w+([.-]\w+)*\.\w{2,3}$')::INT), 0) AS em,"
    r" coalesce(avg((regexp_matches(value, '^\d{3}-\d{2}-\d{4}$') AND value NOT LIKE '000%' AND value NOT LIKE '666%' AND value NOT LIKE '9%' AND value NOT LIKE '%-00-%' AND value NOT LIKE '%-0000')::INT), 0) AS ss,"
    r" coalesce(avg((length(value) <= 200 AND regexp_matches(value, '^\s*\d+[A-Za-z]?\s+[^,]*[A-Za-z].*[\s,](" + "|".join(profiling.STATES) + r")([\s,]+\d{5}(-\d{4})?)?\s*$'))::INT), 0) AS ad FROM p WHERE dtype <> 'double' GROUP BY table_name, column_name)"
    " SELECT table_name, column_name, CASE WHEN dtype = 'string' AND (nm IN ('surname', 'last name') OR ln / greatest(n, 1) > 0.8) THEN 'last_name' WHEN dtype = 'string' AND (nm IN ('given name', 'first name') OR fn / greatest(n, 1) > 0.8) THEN 'first_name'"
    " WHEN dtype = 'string' AND (nm = 'name' OR \"full\" > 0.64) THEN 'full_name' WHEN dtype = 'string' AND (nm IN ('gender', 'sex') OR g1 OR g2) THEN 'gender' WHEN dtype = 'long' AND (nm = 'age' OR (nd >= 20 AND hi <= 120 AND lo > 1)) THEN 'age'"
    " WHEN dtype = 'string' AND (nm = 'email' OR em > 0.8) THEN 'email' WHEN dtype = 'string' AND (nm = 'ssn' OR ss > 0.8) THEN 'ssn' WHEN dtype = 'string' AND (nm = 'address' OR ad > 0.8) THEN 'address' END AS label FROM a"
)
def semantic_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.semantic_types(spark.createDataFrame(_PEOPLE_ROWS, "table_name string, column_name string, dtype string, value string"))


_PROFILES = _DOM + ", prof AS (SELECT table_name, column_name, dtype, count(*) AS n_rows, count(value) AS n_values, count(DISTINCT value) AS n_distinct, count(DISTINCT value) / count(*) AS key_score FROM cells GROUP BY ALL)"


@query(f"WITH {_PROFILES} SELECT table_name, column_name, dtype, n_rows, n_values, n_distinct, round(key_score, 9) AS key_score FROM prof")
def column_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.value_profiles(lake(spark, sf_dir).values()).withColumn("key_score", F.round("key_score", 9))


@query(f"WITH {_PROFILES} SELECT table_name, column_name, round(key_score, 9) AS key_score FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY key_score DESC, column_name) AS rn FROM prof WHERE dtype <> 'double') WHERE rn = 1")
def candidate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.candidate_keys(profiling.value_profiles(lake(spark, sf_dir).values())).select("table_name", "column_name", r9("key_score"))


def _registry(spark: SparkSession, sf_dir: str, rests: tuple[int, ...]) -> DataFrame:
    rows = slice_of(spark, sf_dir, rests).groupBy(F.col("o_custkey").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.lit("custkey").alias("attribute"), "value", "n")


@query(f"WITH u AS (SELECT o_custkey FROM {_A} UNION ALL SELECT o_custkey FROM {_B}) SELECT 'custkey' AS attribute, count(*) AS n_values, count(DISTINCT o_custkey) AS n_distinct, round(count(DISTINCT o_custkey) / count(*), 9) AS key_score FROM u")
def profile_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = profiling.update_registry(_registry(spark, sf_dir, (0, 1)), _registry(spark, sf_dir, (1, 2)))
    return profiling.registry_profile(new).withColumn("key_score", F.round("key_score", 9))


@query("SELECT o_custkey::VARCHAR AS attribute, count(*) AS occurrences FROM orders GROUP BY ALL ORDER BY occurrences DESC, attribute LIMIT 10")
def profile_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").cast("string").alias("attribute")).agg(F.count(F.lit(1)).alias("occurrences"))
    return profiling.evict(known, 10)


@query(f"SELECT o_custkey::VARCHAR AS value, 'orders_a' AS table_name, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS row_ids FROM {_A} GROUP BY ALL")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profiling.inverted_index(slice_of(spark, sf_dir, (0, 1)), F.col("o_orderkey"), "o_custkey", "orders_a")
    return found.withColumn("row_ids", F.array_join(F.col("row_ids").cast("array<string>"), ","))


@query(f"WITH {_DOM} SELECT table_name, column_name, string_agg(other, ',' ORDER BY other) AS neighbours FROM (SELECT DISTINCT a.table_name, a.column_name, b.column_name AS other FROM sizes a JOIN sizes b ON a.table_name = b.table_name AND a.column_name <> b.column_name) GROUP BY ALL")
def neighbour_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.neighbour_schema(lake(spark, sf_dir).columns().select("table_name", "column_name"))


# ---- matching ---------------------------------------------------------------------------------------------------
@query(_MAPPED + " SELECT 'orders_a' AS table_a, a AS col_a, c.table_b, b AS col_b, round(jaccard, 9) AS jaccard FROM chosen c JOIN pairs p ON p.table_b = c.table_b AND p.col_a = c.a AND p.col_b = c.b")
def match_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_naive(*_domains(spark, sf_dir)).select("table_a", "col_a", "table_b", "col_b", r9("jaccard"))


_KNOWN = [("orders_a", "o_orderkey", "orders_b", "o_orderkey")]
_UNMATCHED = [("orders_a", "o_orderstatus", "orders_b", "o_orderstatus")]
_FOUR = "table_a string, col_a string, table_b string, col_b string"


@query(f"WITH RECURSIVE {_PAIRS}" + _greedy("(SELECT * FROM pairs WHERE jaccard >= 0.5 AND NOT (table_b = 'orders_b' AND (col_a = 'o_orderkey' OR col_b = 'o_orderkey' OR (col_a = 'o_orderstatus' AND col_b = 'o_orderstatus'))))") + " SELECT 'orders_a' AS table_a, a AS col_a, table_b, b AS col_b FROM chosen UNION ALL SELECT 'orders_a', 'o_orderkey', 'orders_b', 'o_orderkey'")
def match_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, unmatched = spark.createDataFrame(_KNOWN, _FOUR), spark.createDataFrame(_UNMATCHED, _FOUR)
    return matching.match_incremental(*_domains(spark, sf_dir), known, unmatched).select("table_a", "col_a", "table_b", "col_b")


_GROUPS = [("orders_b", "sales"), ("customer", "people"), ("supplier", "people"), ("nation", "places")]
_GROUPS_SQL = "grps(table_b, grp) AS (VALUES " + ", ".join(f"('{t}', '{g}')" for t, g in _GROUPS) + ")"


@query(f"WITH {_PAIRS}, {_GROUPS_SQL} SELECT table_a, grp, round(max(jaccard), 9) AS best FROM pairs JOIN grps USING (table_b) GROUP BY ALL HAVING max(jaccard) >= 0.5")
def matching_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.matching_groups(*_domains(spark, sf_dir), spark.createDataFrame(_GROUPS, "table_b string, grp string")).select("table_a", "grp", r9("best"))


@query(
    f"WITH RECURSIVE {_DOM}, {_GROUPS_SQL}, pool AS (SELECT DISTINCT grp, column_name, dtype, value FROM dom JOIN grps ON table_name = table_b), np AS (SELECT grp, column_name, count(*) AS n FROM pool GROUP BY ALL),"
    " sh AS (SELECT x.column_name AS col_a, x.pos AS pos_a, y.grp AS table_b, y.column_name AS col_b, count(*) AS n_both FROM dom x JOIN pool y ON x.dtype = y.dtype AND x.value = y.value WHERE x.table_name = 'orders_a' GROUP BY ALL),"
    " gp AS (SELECT sh.*, n_both / (s.n + np.n - n_both) AS jaccard FROM sh JOIN sizes s ON s.table_name = 'orders_a' AND s.column_name = col_a JOIN np ON np.grp = table_b AND np.column_name = col_b)"
    + _greedy("(SELECT * FROM gp WHERE jaccard >= 0.5)", "jaccard DESC, pos_a, col_b") + " SELECT 'orders_a' AS table_a, a AS col_a, table_b AS grp, b AS col_b FROM chosen"
)
def match_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.match_groups(*_domains(spark, sf_dir), spark.createDataFrame(_GROUPS, "table_b string, grp string"))
    return found.select("table_a", "col_a", F.col("table_b").alias("grp"), "col_b")


@query("SELECT 'orders_a' AS table_a, c AS col_a, 'orders_b' AS table_b, c AS col_b FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_totalprice'), ('o_orderpriority')) v(c) WHERE c <> 'o_custkey'")
def match_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = lake(spark, sf_dir).columns()
    return matching.match_names(columns.where("table_name = 'orders_a'"), columns, spark.createDataFrame([("orders_a", "o_custkey", "orders_b")], "table_a string, col_a string, table_b string"))


@query(f"WITH RECURSIVE {_PAIRS}" + _greedy("(SELECT * FROM pairs WHERE jaccard > 0.2 AND col_a = 'o_totalprice' AND (col_b LIKE '%price' OR col_b LIKE '%bal'))") + " SELECT 'orders_a' AS table_a, a AS col_a, table_b, b AS col_b FROM chosen UNION ALL SELECT 'orders_a', 'o_orderkey', 'orders_b', 'o_orderkey'")
def match_full_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_full(*_domains(spark, sf_dir), spark.createDataFrame(_KNOWN, _FOUR), 0.2)


# ---- keys -------------------------------------------------------------------------------------------------------
_SAME = {c: c for c in ORDER_COLUMNS}


@query(f"SELECT round((SELECT count(*) FROM (SELECT o_orderkey, o_custkey FROM {_A} UNION SELECT o_orderkey, o_custkey FROM {_B})) / ((SELECT count(*) FROM {_A}) + (SELECT count(*) FROM {_B})), 9) AS score")
def common_key_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.common_key_score(slice_of(spark, sf_dir, (0, 1)), slice_of(spark, sf_dir, (1, 2)), {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey"}, "o_orderkey", 0.1).select(r9("score"))


@query(
    f"WITH x AS (SELECT o_custkey AS k, o_orderstatus AS s FROM {_A}), y AS (SELECT o_custkey AS k, o_orderstatus AS s FROM {_B}) SELECT round(greatest((SELECT count(*) FROM (FROM x UNION (SELECT * FROM y WHERE k IN (SELECT k FROM x)))),"
    " (SELECT count(*) FROM (FROM y UNION (SELECT * FROM x WHERE k IN (SELECT k FROM y))))) / ((SELECT count(*) FROM x) + (SELECT count(*) FROM y)), 9) AS score"
)
def join_key_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.join_key_score(slice_of(spark, sf_dir, (0, 1)), slice_of(spark, sf_dir, (1, 2)), {"o_custkey": "o_custkey", "o_orderstatus": "o_orderstatus"}, "o_custkey", 0.0).select(r9("score"))


@query("SELECT round(greatest((SELECT count(DISTINCT c_nationkey) / count(*) FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)), (SELECT count(DISTINCT s_nationkey) / count(*) FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer))), 9) AS score")
def approx_join_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, supplier = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("customer", "supplier"))
    return keys.approximate_join_key(customer, supplier, "c_nationkey", "s_nationkey").select(r9("score"))


# ---- provenance -------------------------------------------------------------------------------------------------
_CODE = [
    ("v1", 1, "df = pd.read_csv(path)\nsmall = df[df.x > 3]"), ("v1", 2, "%time\n# note\nout = small.groupby(k).sum()\ndef f(a):\n    b = a\n    return b\nbad line here"),
    ("v2", 1, "df = pd.read_csv(path)\nsmall = df[df.x > 3]\nout = small.head(n)"), ("v3", 1, "z = np.ones(4)\ny = z + z"),
]
_DEPS = [
    ("v1", 1, 1, "df", "pd", "read_csv"), ("v1", 1, 1, "df", "path", "read_csv"), ("v1", 2, 1, "small", "df", "subscript"), ("v1", 2, 1, "small", "df", "x"), ("v1", 5, 2, "out", "small", "groupby"), ("v1", 5, 2, "out", "k", "groupby"),
    ("v2", 1, 1, "df", "pd", "read_csv"), ("v2", 1, 1, "df", "path", "read_csv"), ("v2", 2, 1, "small", "df", "subscript"), ("v2", 2, 1, "small", "df", "x"), ("v2", 3, 1, "out", "small", "head"), ("v2", 3, 1, "out", "n", "head"),
    ("v3", 1, 1, "z", "np", "ones"), ("v3", 2, 1, "y", "z", "add"), ("v3", 2, 1, "y", "z", "add"),
]
_DEP_SCHEMA = "view_id string, line_no int, cell_id int, lhs string, rhs_var string, op string"


def _values(rows: list[tuple], name: str, columns: str) -> str:
    one = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


_DEP_SQL = _values(_DEPS, "dep", "view_id, line_no, cell_id, lhs, rhs_var, op")
_EDGE_SQL = _DEP_SQL + (
    ", reads AS (SELECT DISTINCT view_id, line_no, lhs, rhs_var, op FROM dep WHERE rhs_var NOT IN ('np', 'pd')), writes AS (SELECT DISTINCT view_id, line_no, lhs FROM dep),"
    " edge AS (SELECT r.view_id, r.lhs || '@' || r.line_no AS src, r.rhs_var || '@' || coalesce(max(w.line_no), 0) AS dst, r.op AS label FROM reads r LEFT JOIN writes w ON w.view_id = r.view_id AND w.lhs = r.rhs_var AND w.line_no < r.line_no GROUP BY r.view_id, r.lhs, r.line_no, r.rhs_var, r.op)"
)
_ROOTS = [("v1", "out@5"), ("v2", "out@3"), ("v3", "y@2")]
_STAR_SQL = (
    _EDGE_SQL + ", " + _values(_ROOTS, "roots", "view_id, src") + ", seen AS (SELECT view_id, src AS node FROM roots UNION SELECT e.view_id, e.dst FROM seen s JOIN edge e ON e.view_id = s.view_id AND e.src = s.node),"
    " inside AS (SELECT * FROM edge e WHERE EXISTS (SELECT 1 FROM seen s WHERE s.view_id = e.view_id AND s.node = e.src) AND EXISTS (SELECT 1 FROM seen s WHERE s.view_id = e.view_id AND s.node = e.dst)),"
    " star AS (SELECT view_id, src AS node, '+' || label AS label FROM inside UNION ALL SELECT view_id, dst, '-' || label FROM inside)"
)
_DIST_SQL = _STAR_SQL + (
    ", cnt AS (SELECT view_id, node, label, count(*) AS n FROM star GROUP BY ALL), len AS (SELECT view_id, node, sum(n) AS l FROM cnt GROUP BY ALL),"
    " dist AS (SELECT b.view_id, a.node AS node_q, b.node, abs(a.l - b.l) + greatest(a.l, b.l) - coalesce((SELECT sum(least(x.n, y.n)) FROM cnt x JOIN cnt y ON x.label = y.label WHERE x.view_id = 'v1' AND x.node = a.node AND y.view_id = b.view_id AND y.node = b.node), 0) AS distance FROM len a, len b WHERE a.view_id = 'v1')"
)
_MAPDIST_SQL = "WITH RECURSIVE " + _DIST_SQL + _greedy("dist", "distance, node_q, node", "node_q", "node", "view_id") + ", total AS (SELECT c.view_id, sum(d.distance)::BIGINT AS distance FROM chosen c JOIN dist d ON d.view_id = c.view_id AND d.node_q = c.a AND d.node = c.b GROUP BY c.view_id)"


def _dependencies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_DEPS, _DEP_SCHEMA)


def _stars(spark: SparkSession) -> DataFrame:
    return provenance.star_sets(provenance.dependency_graph(_dependencies(spark)), spark.createDataFrame(_ROOTS, "view_id string, src string"))


@query("WITH " + _DEP_SQL + " SELECT * FROM dep")
def code_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.parse_cells(spark.createDataFrame(_CODE, "view_id string, cell_id int, code string"))


@query("WITH " + _DEP_SQL + " SELECT DISTINCT view_id, line_no, cell_id FROM dep")
def parse_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_deps(spark, sf_dir).select("view_id", "line_no", "cell_id").distinct()


@query("WITH " + _DEP_SQL + " SELECT view_id, lhs, max(line_no) AS line_no FROM dep GROUP BY ALL")
def last_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.last_line(_dependencies(spark))


@query("WITH " + _EDGE_SQL + " SELECT * FROM edge")
def dep_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.dependency_graph(_dependencies(spark))


@query("WITH RECURSIVE " + _STAR_SQL + " SELECT * FROM star")
def star_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stars(spark)


@query("WITH RECURSIVE " + _DIST_SQL + " SELECT view_id, node_q, node, distance::BIGINT AS distance FROM dist")
def star_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    stars = _stars(spark)
    return provenance.star_distances(stars.where("view_id = 'v1'").drop("view_id"), stars)


@query(_MAPDIST_SQL + " SELECT * FROM total")
def star_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    stars = _stars(spark)
    return provenance.mapping_distance(stars.where("view_id = 'v1'").drop("view_id"), stars)


@query(_MAPDIST_SQL + " SELECT * FROM total")
def prov_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    stars = _stars(spark)
    return provenance.rank(stars.where("view_id = 'v1'").drop("view_id"), stars)


@query(_MAPDIST_SQL + " SELECT * FROM total ORDER BY distance, view_id LIMIT 2")
def prov_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    stars = _stars(spark)
    return provenance.rank(stars.where("view_id = 'v1'").drop("view_id"), stars, 2)


@query(_MAPDIST_SQL + ", t(view_id) AS (VALUES ('v1'), ('v2'), ('v3'), ('none')) SELECT t.view_id, round(coalesce(0.5 * (1 - 1 / (1 + exp(-distance))), 0), 9) AS prov_score FROM t LEFT JOIN total USING (view_id)")
def prov_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = spark.createDataFrame([("v1",), ("v2",), ("v3",), ("none",)], "view_id string")
    return provenance.provenance_score(tables, star_mapping(spark, sf_dir), 0.5).select("view_id", r9("prov_score"))


@query("SELECT * FROM (VALUES ('a', 0), ('b', 4), ('c', 5), ('d', 6)) v(code, cell_id)")
def add_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.add_cells(spark.createDataFrame([("a", 0), ("b", 4)], "code string, cell_id int"), spark.createDataFrame([("b",), ("d",), ("c",), ("c",)], "code string"))


_CELL_EDGES = [(1, 2), (2, 3), (3, 4), (7, 8)]


@query("WITH RECURSIVE " + _values(_CELL_EDGES, "e", "src, dst") + ", both_ways AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), reach AS (SELECT i::INT AS node, i::INT AS other FROM range(1, 10) r(i) UNION SELECT r.node, b.dst FROM reach r JOIN both_ways b ON b.src = r.other) SELECT node, min(other) AS grp FROM reach GROUP BY node")
def workflow_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.workflow_groups(spark.createDataFrame(_CELL_EDGES, "src int, dst int"), spark.range(1, 10).select(F.col("id").cast("int").alias("node")))


# ---- ranking ----------------------------------------------------------------------------------------------------
# ---- storage cost -----------------------------------------------------------------------------------------------
_PART = "(SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 4 = 0)"


@query(f"SELECT sum(8 + length(o_orderstatus))::BIGINT AS benefit, 1 AS direction FROM {_PART} UNION ALL SELECT -1, 1")
def union_benefit(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["o_orderkey", "o_custkey", "o_orderstatus"]
    a, part = slice_of(spark, sf_dir, (0, 1)), slice_of(spark, sf_dir, (0,))
    return storage.union_benefit(part, a, columns).unionByName(storage.union_benefit(slice_of(spark, sf_dir, (2,)).where("o_orderkey % 8 = 2"), a, columns))



# ---- names ------------------------------------------------------------------------------------------------------
@query("SELECT * FROM (VALUES ('My-Awesome-Notebook.ipynb', 'MyAwesomeNotebook'), ('a/b/c_d.ipynb', 'bcd'), ('x', 'x')) v(name, clean)")
def clean_notebook_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("My-Awesome-Notebook.ipynb",), ("a/b/c_d.ipynb",), ("x",)], "name string").withColumn("clean", names.clean_notebook_name(F.col("name")))


@query("SELECT '3_df_nb' AS stored, 2 AS cells")
def store_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = spark.createDataFrame([(3, "df", "nb", "a = 1\n#\nb = 2")], "c int, v string, n string, code string")
    return row.select(names.store_name(F.col("c"), F.col("v"), F.col("n")).alias("stored"), F.size(names.code_cells(F.col("code"))).alias("cells"))


@query("SELECT o_orderkey, round(1 / (1 + exp(-o_totalprice / 100000)), 9) AS s FROM orders")
def sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.round(names.sigmoid(F.col("o_totalprice") / 100000), 9).alias("s"))


@query("SELECT r_regionkey || ',' || r_name AS r FROM region")
def row_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/region.parquet").select(storage.row_text(["r_regionkey", "r_name"]).alias("r"))


@query("SELECT to_base64(encode(r_name)) AS code FROM region")
def base64_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/region.parquet").select(names.base64_code(F.col("r_name")).alias("code"))


@query("SELECT * FROM (VALUES ('custkey_a', 'CustKey_b', 1.0), ('ab', 'cd', 0.0), ('orders', 'order', 0.909090909)) v(a, b, ratio)")
def name_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [("custkey_a", "CustKey_b"), ("ab", "cd"), ("orders", "order")]
    return spark.createDataFrame([(a, b, round(names.name_ratio(a, b), 9)) for a, b in pairs], "a string, b string, ratio double")


