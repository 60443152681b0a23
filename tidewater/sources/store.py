"""Persistent state: typed tables in a folder, each replaced by writing a whole new version.

A version counts once Spark has marked it complete, and readers take the newest complete one, so a table can be replaced
by what was computed from it, and a failed or repeated write changes nothing. Earlier versions stay until ``sweep``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.lake import ARTEFACT

#: State of the index, of provenance, of the attribute registry, and of searches.
INDEX = {
    "counts": "table_name string, n_rows long, n_cols int", "indexed": "table_name string", "signature": "table_name string, column_name string, hash_idx int, hv long",
    "bands": "part_idx int, table_name string, column_name string, band_idx int, band_key array<bigint>", "partitions": "part_idx int, upper long, num_domain long",
    "tuned": "max_k int, num_hash int, upper long, query_size long, threshold double, k int, l int",
}
PROVENANCE = {
    "dependency": "view_id string, line_no int, cell_id int, lhs string, rhs_var string, op string", "line2cell": "view_id string, line_no int, cell_id int", "last_line": "view_id string, lhs string, line_no int",
    "view_code": "view_id string, code string", "code_dict": "code string, cell_id int",
}
REGISTRY = {
    "attributes": "attribute string, dtype string, n_values long, occurrences long", "attribute_values": "attribute string, value string, n long", "neighbours": "attribute string, neighbours string, n long",
    "links": "attribute string, table_name string, column_name string", "column_index": "attribute string, value string, table_name string, chunk int, row_ids array<bigint>",
}
STATES = {"topk_state": "mode int, query string, table_name string, component string, score double"}
SCHEMAS = INDEX | PROVENANCE | REGISTRY | STATES


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._place("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _place(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _versions(self, name: str) -> list[int]:
        place = self._place(name)
        if not self._fs.exists(place):
            return []
        found = [s.getPath() for s in self._fs.listStatus(place)]
        return sorted(int(p.getName()[1:]) for p in found if self._fs.exists(self._hadoop.Path(p, "_SUCCESS")))

    def tables(self) -> list[str]:
        if not self._fs.exists(self._place("")):
            return []
        return sorted(n for s in self._fs.listStatus(self._place("")) if self._versions(n := s.getPath().getName()))

    def init(self) -> None:
        """Drops everything."""
        self._fs.delete(self._place(""), True)

    def create(self, schemas: dict[str, str]) -> list[str]:
        """Creates the tables that are not there, empty; returns their names."""
        fresh = [n for n in schemas if not self._versions(n)]
        for n in fresh:
            self.replace(n, self.spark.createDataFrame([], schemas[n]))
        return fresh

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """Writes the next version and returns it as read."""
        version = max(self._versions(name), default=-1) + 1
        df.drop(ARTEFACT).write.mode("overwrite").parquet(f"{self.path}/{name}/v{version:08d}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        """The newest version; a table of SCHEMAS that was never written is empty."""
        versions = self._versions(name)
        if not versions:
            if name in SCHEMAS:
                return self.spark.createDataFrame([], SCHEMAS[name])
            raise KeyError(name)
        reader = self.spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else self.spark.read
        return reader.parquet(f"{self.path}/{name}/v{versions[-1]:08d}")

    def add_new(self, name: str, df: DataFrame, keys: list[str]) -> DataFrame:
        """Adds the rows whose keys the table lacks."""
        known = self.read(name)
        return self.replace(name, known.unionByName(df.select(*known.columns).join(known.select(*keys).distinct(), keys, "left_anti")))

    def sweep(self, name: str) -> None:
        """Deletes all versions but the newest."""
        for version in self._versions(name)[:-1]:
            self._fs.delete(self._place(f"{name}/v{version:08d}"), True)

    def counts(self) -> DataFrame:
        """(table_name, n_rows) of all tables."""
        out = self.spark.createDataFrame([], "table_name string, n_rows long")
        for n in self.tables():
            out = out.unionByName(self.read(n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows"))
        return out


def dump_provenance(store: Store, dependency: DataFrame, code: DataFrame) -> None:
    """Adds the dependencies, line map, last lines and code (view_id, code) of views that the store lacks."""
    store.add_new("dependency", dependency, ["view_id"])
    store.add_new("line2cell", dependency.select("view_id", "line_no", "cell_id").distinct(), ["view_id"])
    store.add_new("last_line", dependency.groupBy("view_id", "lhs").agg(F.max("line_no").alias("line_no")), ["view_id"])
    store.add_new("view_code", code.select("view_id", F.base64(F.encode("code", "UTF-8")).alias("code")), ["view_id"])


def load_provenance(store: Store) -> DataFrame:
    """Star sets (view_id, node, label) of every stored view, from the last line that it assigns."""
    from tidewater.operators.provenance import dependency_graph, star_sets

    last = store.read("last_line").groupBy("view_id").agg(F.max_by("lhs", F.struct("line_no", "lhs")).alias("lhs"), F.max("line_no").alias("line_no"))
    roots = last.select("view_id", F.concat("lhs", F.lit("@"), F.col("line_no").cast("string")).alias("src"))
    return star_sets(dependency_graph(store.read("dependency")), roots)
