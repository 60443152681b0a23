"""Registered queries of sources, sinks, persistent state and scalar functions, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import names, sql_functions
from tidewater.operators import profiling, provenance, storage
from tidewater.plans.queries import _CODE, _DEP_SQL, _STAR_SQL, _dependencies, query
from tidewater.plans.session import connect as connected
from tidewater.plans.tables import new_folder
from tidewater.sources import store as stores
from tidewater.sources.lake import Lake, import_code, parse_split_json, to_split_json
from tidewater.sources.store import Store

BASE = ("customer", "nation", "orders", "part", "region", "supplier")
_WIDTH = {"customer": 5, "nation": 3, "orders": 6, "part": 6, "region": 2, "supplier": 4}


def base_lake(spark: SparkSession, sf_dir: str) -> Lake:
    return Lake.read(spark, sf_dir, list(BASE))


def fresh(spark: SparkSession, name: str = "store") -> Store:
    return Store(spark, new_folder(spark, name))


def _row(df: DataFrame, name: str, *columns) -> DataFrame:
    return df.select(F.lit(name).alias("table_name"), *columns)


# ---- sources ----------------------------------------------------------------------------------------------------
@query("SELECT 'exp_view_table_debts' AS view_name, count(*) AS n_rows FROM customer WHERE c_acctbal < 0")
def list_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = base_lake(spark, sf_dir)
    views = Lake(spark, base.tables, {"exp_view_table_debts": base.table("customer").where("c_acctbal < 0"), "other": base.table("nation")})
    out = None
    for n in views.view_names():
        one = views.table(n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("view_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 'orders' AS table_name, 1 AS readable UNION ALL SELECT 'region', 1 UNION ALL SELECT 'no_such_table', 0")
def scan_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, failed = Lake.scan(spark, sf_dir, ["orders", "no_such_table", "region"])
    return spark.createDataFrame([(n, 1) for n in found.names()] + [(n, 0) for n in failed], "table_name string, readable int")


@query("SELECT 'orders' AS table_name, count(*) AS n_rows, 6 AS n_cols FROM orders UNION ALL SELECT 'part', count(*), 6 FROM part")
def read_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_lake(spark, sf_dir).subset(["rtableorders", "part", "rtableabsent"]).catalog()


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def read_query_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = Lake(spark, {"rtable3_df_nb": spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("Unnamed: 0", F.lit(0))})
    return kept.table("3_df_nb").groupBy(*[c for c in kept.table("rtable3_df_nb").columns if c == "o_orderstatus"]).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 4 END AS quarter, n_regionkey = 1 AS first FROM nation")
def split_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table printed as a notebook prints it and read back with its types."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("quarter", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") / 4)).withColumn("first", F.col("n_regionkey") == 1)
    return parse_split_json(to_split_json(nation), spark)


@query("SELECT length(string_agg(r_regionkey || r_name, '' ORDER BY r_regionkey)) AS cells, count(*) AS n_rows FROM region")
def print_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = to_split_json(spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey"))
    data = spark.createDataFrame([(printed,)], "frame string").select(F.explode(F.from_json(F.get_json_object("frame", "$.data"), "array<array<string>>")).alias("r"))
    return data.agg(F.sum(F.length(F.array_join("r", ""))).alias("cells"), F.count(F.lit(1)).alias("n_rows"))


def _text(table: str, columns: str) -> str:
    return f"(SELECT concat_ws(',', {columns}) AS r FROM {table} ORDER BY 1 LIMIT 3)"


@query(
    "SELECT 'nation' AS table_name, (SELECT count(*) FROM nation) AS n_rows, 3 AS n_cols, left(string_agg(r, chr(10) ORDER BY r), 200) AS preview FROM " + _text("nation", "n_nationkey, n_name, n_regionkey")
    + " UNION ALL SELECT 'region', (SELECT count(*) FROM region), 2, left(string_agg(r, chr(10) ORDER BY r), 200) FROM " + _text("region", "r_regionkey, r_name")
)
def list_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Lake.read(spark, sf_dir, ["nation", "region"]).variables()


@query("SELECT * FROM (VALUES ('orders', 'orders = lake.table(''orders'')'), ('rtable3_df_nb', '3_df_nb = lake.table(''3_df_nb'')')) v(table_name, code)")
def import_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, import_code(n)) for n in ("orders", "rtable3_df_nb")], "table_name string, code string")


@query("SELECT true AS adaptive, true AS skew_join")
def connect(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = connected(existing=spark)
    get = lambda k: own.conf.get(k) == "true"
    return own.createDataFrame([(get("spark.sql.adaptive.enabled"), get("spark.sql.adaptive.skewJoin.enabled"))], "adaptive boolean, skew_join boolean")


_COLUMNS = {
    "customer": "c_custkey:4 c_name:s c_nationkey:4 c_acctbal:8 c_mktsegment:s", "nation": "n_nationkey:4 n_name:s n_regionkey:4", "orders": "o_orderkey:4 o_custkey:4 o_orderstatus:s o_totalprice:8 o_orderpriority:s",
    "part": "p_partkey:4 p_name:s p_brand:s p_type:s p_size:4 p_retailprice:8", "region": "r_regionkey:4 r_name:s", "supplier": "s_suppkey:4 s_name:s s_nationkey:4 s_acctbal:8",
}


def _sizes(distinct: bool) -> str:
    one = lambda c, k: f"sum({'length(v)' if k == 's' else k}) FROM (SELECT {'DISTINCT ' if distinct else ''}{c} AS v FROM TABLE_NAME WHERE {c} IS NOT NULL)"
    parts = [f"SELECT '{t}' AS table_name, " + f"{one(c, k).replace('TABLE_NAME', t)}" for t, cs in _COLUMNS.items() for c, k in (x.split(":") for x in cs.split())]
    return "SELECT table_name, sum(size)::BIGINT AS size FROM (" + " UNION ALL ".join(p.replace(" FROM (SELECT", " AS size FROM (SELECT", 1) for p in parts) + ") GROUP BY table_name"


def _modelled(base: Lake, size) -> DataFrame:
    out = None
    for n in base.names():
        one = _row(size(base.table(n).drop("o_orderdate")), n, "size")
        out = one if out is None else out.unionByName(one)
    return out


@query(_sizes(False))
def storage_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _modelled(base_lake(spark, sf_dir), storage.table_size)


@query(_sizes(True))
def storage_size_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _modelled(base_lake(spark, sf_dir), storage.table_size_unique)


@query(f"SELECT size AS bytes FROM ({_sizes(False)}) WHERE table_name = 'supplier'")
def var_sizeof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.table_size(spark.read.parquet(f"{sf_dir}/supplier.parquet")).withColumnRenamed("size", "bytes")


# ---- state ------------------------------------------------------------------------------------------------------
@query("SELECT c_nationkey, count(*) AS n, max(c_custkey) AS top FROM customer WHERE c_acctbal >= 0 GROUP BY c_nationkey")
def write_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table is written, and replaced by rows that are read from it."""
    store = fresh(spark)
    kept = store.replace("customer", spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("Unnamed: 0", F.lit(1)))
    store.replace("customer", kept.where("c_acctbal >= 0"))
    store.sweep("customer")
    return store.read("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.max("c_custkey").alias("top"))


def _created(schemas: dict[str, str]) -> str:
    rows = [(t, c.split()[0], k) for t, s in schemas.items() for k, c in enumerate(s.split(", "))]
    return "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c}', {k})" for t, c, k in rows) + ") v(table_name, column_name, pos)"


def _create(spark: SparkSession, schemas: dict[str, str], before: dict[str, str] | None = None) -> DataFrame:
    store = fresh(spark)
    if before:
        store.create(before)
        store.init()
    store.create(schemas)
    assert store.create(schemas) == []
    rows = [(n, c, k) for n in store.tables() for k, c in enumerate(store.read(n).columns)]
    return spark.createDataFrame(rows, "table_name string, column_name string, pos int")


@query(_created(stores.INDEX))
def init_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _create(spark, stores.INDEX, stores.PROVENANCE)


@query(_created(stores.PROVENANCE))
def create_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _create(spark, stores.PROVENANCE)


@query(_created(stores.REGISTRY))
def profile_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _create(spark, stores.REGISTRY)


@query(_created(stores.STATES))
def state_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _create(spark, stores.STATES)


@query("SELECT DISTINCT p_brand, (((7 * 2654435 + 40503) % 2147483647 + 1) * ('0x' || substr(md5(p_brand), 1, 7))::BIGINT + (7 * 97531 + 12345) % 2147483647) % 2147483647 AS hv, p_size % 4 < 2 AS prefix_same FROM part")
def create_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions of the index, called from SQL."""
    sql_functions.register(spark)
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("tidewater_part")
    return spark.sql("SELECT DISTINCT p_brand, min_hash_char(p_brand, 7) AS hv, check_hash_keys(array(1L, p_size % 4L DIV 2L, 5L), array(1L, 0L, 9L), 2) AS prefix_same FROM tidewater_part")


def _attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute values of the brands and types of parts."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    cells = part.select(F.explode(F.array(*(F.struct(F.lit(f"part.{c}").alias("attribute"), F.col(c).alias("value")) for c in ("p_brand", "p_type", "p_name")))).alias("x")).select("x.*")
    return cells.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT attribute, count(*) AS n_values, count(DISTINCT value) AS n_distinct, round(count(DISTINCT value) / count(*), 9) AS key_score FROM (SELECT unnest([{'attribute': 'part.p_brand', 'value': p_brand}, {'attribute': 'part.p_type', 'value': p_type}, {'attribute': 'part.p_name', 'value': p_name}], recursive := true) FROM part) GROUP BY attribute")
def profile_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry is dumped and loaded; key scores are computed from what is loaded."""
    store = fresh(spark)
    store.create(stores.REGISTRY)
    store.replace("attribute_values", _attributes(spark, sf_dir))
    return profiling.registry_profile(store.read("attribute_values")).withColumn("key_score", F.round("key_score", 9))


def _kept_provenance(spark: SparkSession) -> Store:
    """Two views are written first, then all three."""
    store = fresh(spark)
    code = spark.createDataFrame(_CODE, "view_id string, cell_id int, code string").groupBy("view_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell_id", "code"))), lambda x: x["code"]), "\n#\n").alias("code"))
    stores.dump_provenance(store, _dependencies(spark).where("view_id <> 'v3'"), code.where("view_id <> 'v3'"))
    stores.dump_provenance(store, _dependencies(spark), code)
    return store


@query("WITH RECURSIVE " + _STAR_SQL + " SELECT view_id, node, label FROM star")
def prov_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.load_provenance(_kept_provenance(spark))


@query("WITH " + _DEP_SQL + " SELECT view_id, count(*) AS n_deps, count(DISTINCT line_no) AS n_lines FROM dep GROUP BY view_id")
def prov_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _kept_provenance(spark)
    lines = store.read("line2cell").groupBy("view_id").agg(F.count(F.lit(1)).alias("n_lines"))
    return store.read("dependency").groupBy("view_id").agg(F.count(F.lit(1)).alias("n_deps")).join(lines, "view_id").join(store.read("view_code").select("view_id"), "view_id")


@query("WITH " + _DEP_SQL + " SELECT DISTINCT view_id, line_no, cell_id FROM dep")
def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_provenance(spark).read("line2cell")


@query("SELECT lang AS code, (row_number() OVER (ORDER BY late, lang) - 1)::INT AS cell_id FROM (SELECT lang, bool_and(n_chars >= 500)::INT AS late FROM documents WHERE lang IS NOT NULL GROUP BY lang)")
def code_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes get numbers in order of their first writing, and keep them."""
    store, docs = fresh(spark), spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null").select(F.col("lang").alias("code"), "n_chars")
    store.replace("code_dict", provenance.add_cells(store.read("code_dict"), docs.where("n_chars < 500")))
    return store.replace("code_dict", provenance.add_cells(store.read("code_dict"), docs))


# ---- scalar functions -------------------------------------------------------------------------------------------
@query("SELECT conv_id, turn, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (SELECT conv_id, turn, any_value(role) AS role FROM conversations GROUP BY conv_id, turn HAVING count(*) = 1)")
def prev_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id", "turn").agg(F.first("role").alias("role"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return names.prev_cell(turns, "conv_id", "turn", F.col("role") == "assistant").select("conv_id", "turn", "prev")


@query("SELECT * FROM (VALUES " + ", ".join(f"('rowstore', '{t}', '{c.split(':')[0]}')" for t, cs in _COLUMNS.items() for c in cs.split()) + ", ('rowstore', 'orders', 'o_orderdate')) v(schema_name, table_name, column_name)")
def domain_id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = base_lake(spark, sf_dir).columns().select(names.domain_id(F.lit("rowstore"), F.col("table_name"), F.col("column_name")).alias("i"))
    return made.select(*(c.alias(n) for n, c in names.parse_domain_id(F.col("i")).items()))


_ALIKE = [("c_custkey", "c_name"), ("orders_x", "order_y"), ("abc_1", "xyz_1"), ("index_a", "index_b")]


@query("SELECT * FROM (VALUES ('c_custkey', 'c_name', 1.0), ('orders_x', 'order_y', 0.909090909)) v(a, b, ratio)")
def alike_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(a, b, round(s, 9)) for x, y in _ALIKE for a, b, s in names.alike_names([x], [y])]
    return spark.createDataFrame(rows, "a string, b string, ratio double")


