"""The lake: named tables, their catalog, and the long form of their columns that the pair operators share."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Left over by exports of frames with an index column.
ARTEFACT = "Unnamed: 0"
KINDS = ("long", "double", "string")
#: Columns that one word of a mask tells apart.
WORD = 62
FAMILIES = {"tinyint": "long", "smallint": "long", "int": "long", "bigint": "long", "float": "double", "double": "double", "string": "string"}


def family(kind: str) -> str:
    """Types that are compared with each other: integers are widened, others stand for themselves."""
    return FAMILIES.get(kind, kind)


#: Stands before the names of tables that were kept for variables of notebooks.
PREFIX = "rtable"


def canonical(name: str) -> str:
    return name.removeprefix(PREFIX)


class Lake:
    """Tables and views by name. They stay lazy; nothing is read before an action.

    Every value of a family of types, with how often it stands in its column, is made once (``values``); domains and profiles
    come from that table. What columns share comes from ``classes``, which has no row a value.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], views: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.tables = {canonical(name): df.drop(ARTEFACT) for name, df in tables.items()}
        self.views = {name: df.drop(ARTEFACT) for name, df in (views or {}).items()}
        self._kept: dict[str, tuple[str, DataFrame]] = {}

    @classmethod
    def read(cls, spark: SparkSession, folder: str, names: list[str]) -> Lake:
        return cls(spark, {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names})

    @classmethod
    def scan(cls, spark: SparkSession, folder: str, names: list[str]) -> tuple[Lake, dict[str, str]]:
        """The tables that can be read, and why the others can't."""
        tables, failed = {}, {}
        for n in names:
            try:
                tables[n] = spark.read.parquet(f"{folder}/{n}.parquet")
            except Exception as e:  # whatever a reader raises, the other tables count
                failed[n] = f"{type(e).__name__}: {str(e).splitlines()[0]}"
        return cls(spark, tables), failed

    def table(self, name: str) -> DataFrame:
        """A table or view, by its name with or without the prefix."""
        return self.views[name] if name in self.views else self.tables[canonical(name)]

    def subset(self, names: list[str]) -> Lake:
        """The named tables; names that the lake does not have are passed over."""
        return Lake(self.spark, {n: self.tables[canonical(n)] for n in names if canonical(n) in self.tables})

    def write(self, name: str, df: DataFrame, path: str) -> None:
        """Replaces a table."""
        df.drop(ARTEFACT).write.mode("overwrite").parquet(path)
        self.tables[name] = self.spark.read.parquet(path)

    def names(self, containing: str = "") -> list[str]:
        return sorted(n for n in self.tables if containing in n)

    def view_names(self, containing: str = "exp_view_table") -> list[str]:
        return sorted(n for n in self.views if containing in n)

    def variables(self) -> DataFrame:
        """table_name, n_rows, n_cols, and the first 200 characters of its three least rows in text form."""
        parts = []
        for n, df in sorted(self.tables.items()):
            row = F.concat_ws(",", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")) for c in df.columns))
            least = df.select(row.alias("r")).orderBy("r").limit(3).agg(F.left(F.array_join(F.array_sort(F.collect_list("r")), "\n"), F.lit(200)).alias("preview"))
            rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
            parts.append(rows.crossJoin(least).select(F.lit(n).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_cols"), "preview"))
        return _union(parts)

    def _stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A frame that is written to the shared folder at first use, and again if it is gone."""
        from tidewater.plans.tables import exists, new_folder

        if name not in self._kept or not exists(self.spark, self._kept[name][0]):
            df, folder = make(), new_folder(self.spark, name)
            df.write.parquet(folder)
            self._kept[name] = folder, self.spark.read.schema(df.schema).parquet(folder)
        return self._kept[name][1]

    def _columns_of(self, kinds: tuple[str, ...]) -> list[tuple[str, str, int, str]]:
        return [(t, c, p, family(k)) for t, df in sorted(self.tables.items()) for p, (c, k) in enumerate(df.dtypes) if family(k) in kinds]

    def _counted(self, kind: str) -> DataFrame:
        """The values of one family. Rows are shuffled with a number for their column, which gets its name afterwards."""
        own = self._columns_of((kind,))
        number = {(t, c): k for k, (t, c, _, _) in enumerate(own)}
        parts = []
        for t in sorted({t for t, _, _, _ in own}):
            cells = F.array(*(F.struct(F.lit(number[t, c]).alias("c"), _cell(c, k).cast("string").alias("value")) for u, c, _, k in own if u == t))
            parts.append(self.tables[t].select(F.explode(cells).alias("x")).select("x.*"))
        if not parts:
            return self.spark.createDataFrame([], "table_name string, column_name string, pos int, dtype string, value string, n long")
        name = lambda k: F.get(F.array(*(F.lit(x[k]) for x in own)), F.col("c"))
        counted = _union(parts).groupBy("c", "value").agg(F.count(F.lit(1)).alias("n"))
        return counted.select(name(0).alias("table_name"), name(1).alias("column_name"), name(2).alias("pos"), F.lit(kind).alias("dtype"), "value", "n")

    def values(self, kinds: tuple[str, ...] = KINDS) -> DataFrame:
        """(table_name, column_name, pos, dtype, value, n), staged by family. Nulls are counted as well."""
        return _union([self._stage(f"values-{k}", lambda k=k: self._counted(k)) for k in kinds])

    def _masks(self, kind: str) -> DataFrame:
        """(dtype, words, size): how many values of a family stand in just the columns that the bits of the words mark."""
        own = self._columns_of((kind,))
        words = -(-len(own) // WORD)
        place = {(t, c): divmod(k, WORD) for k, (t, c, _, _) in enumerate(own)}
        parts = []
        for t in sorted({t for t, _, _, _ in own}):
            kinds = dict(self.tables[t].dtypes)
            cells = F.array(*(F.struct(_typed(c, kinds[c]).alias("v"), *(F.lit(1 << place[t, c][1] if w == place[t, c][0] else 0).cast("long").alias(f"w{w}") for w in range(words))) for u, c, _, _ in own if u == t))
            parts.append(self.tables[t].select(F.explode(cells).alias("x")).select("x.*").where("v is not null"))
        if not parts:
            return self.spark.createDataFrame([], "dtype string, words array<bigint>, size long")
        held = [f"w{w}" for w in range(words)]
        sets = _union(parts).groupBy("v").agg(*(F.bit_or(w).alias(w) for w in held)).groupBy(*held).agg(F.count(F.lit(1)).alias("size"))
        return sets.select(F.lit(kind).alias("dtype"), F.array(*held).alias("words"), "size")

    def classes(self) -> DataFrame:
        """(table_name, column_name, pos, dtype, value, size): the domains with one row for all values that stand in the same
        columns; ``value`` names these columns and ``size`` says how many values there are.

        Each value is shuffled once, with one bit for each column, however many columns hold it. Staged at first use; it has at
        most as many rows as the domains, and a few where columns overlap as keys do.
        """
        sets = self._stage("classes", lambda: _union([self._masks(k) for k in KINDS]))
        bits = [(t, c, p, kind, k // WORD, 1 << k % WORD) for kind in KINDS for k, (t, c, p, _) in enumerate(self._columns_of((kind,)))]
        columns = self.spark.createDataFrame(bits, "table_name string, column_name string, pos int, dtype string, word int, bit long")
        held = sets.join(F.broadcast(columns), "dtype").where(F.get("words", F.col("word")).bitwiseAND(F.col("bit")) != 0)
        return held.select("table_name", "column_name", "pos", "dtype", F.array_join(F.col("words").cast("array<string>"), ":").alias("value"), "size")

    def held(self) -> DataFrame:
        """(table_name, column_name, rows, held): rows and non-null cells of every column of the known families."""
        parts = []
        for t, df in sorted(self.tables.items()):
            own = self._columns_of_table(t)
            if own:
                counts = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count(_cell(c, k)).alias(f"h{p}") for c, p, k in own))
                each = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"h{p}").alias("held")) for c, p, _ in own))).alias("x")
                parts.append(counts.select(F.lit(t).alias("table_name"), "rows", each).select("table_name", "x.column_name", "rows", "x.held"))
        return _union(parts) if parts else self.spark.createDataFrame([], "table_name string, column_name string, rows long, held long")

    def _columns_of_table(self, name: str, kinds: tuple[str, ...] = KINDS) -> list[tuple[str, int, str]]:
        return [(c, p, k) for t, c, p, k in self._columns_of(kinds) if t == name]

    def columns(self) -> DataFrame:
        rows = [(t, c, p, family(kind)) for t, df in sorted(self.tables.items()) for p, (c, kind) in enumerate(df.dtypes)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, pos int, dtype string")

    def catalog(self) -> DataFrame:
        """table_name, n_rows, n_cols."""
        parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_cols")) for n, df in sorted(self.tables.items())]
        return _union(parts)

    def cells(self, kinds: tuple[str, ...] = KINDS) -> DataFrame:
        """(table_name, column_name, pos, dtype, value): every cell of the given families; NaN is null."""
        parts = []
        for name, df in sorted(self.tables.items()):
            chosen = self._columns_of_table(name, kinds)
            if not chosen:
                continue
            structs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(p).alias("pos"), F.lit(k).alias("dtype"), _cell(c, k).cast("string").alias("value")) for c, p, k in chosen))
            parts.append(df.select(F.lit(name).alias("table_name"), F.explode(structs).alias("x")).select("table_name", "x.*"))
        return _union(parts) if parts else self.spark.createDataFrame([], "table_name string, column_name string, pos int, dtype string, value string")

    def numbers(self) -> DataFrame:
        """(table_name, column_name, dtype, x, n): every number of the lake as a double, uncounted; NaN and nulls are left out.
        Families are separate branches, so that a filter on dtype leaves only those columns to be read."""
        parts = []
        for kind in ("long", "double"):
            for name, df in sorted(self.tables.items()):
                chosen, kinds = self._columns_of_table(name, (kind,)), dict(df.dtypes)
                if chosen:
                    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), _number(c, kinds[c]).alias("x")) for i, (c, _, _) in enumerate(chosen)))).alias("x")
                    named = F.get(F.array(*(F.lit(c) for c, _, _ in chosen)), F.col("c"))
                    parts.append(df.select(cells).select("x.*").where("x is not null").select(F.lit(name).alias("table_name"), named.alias("column_name"), F.lit(kind).alias("dtype"), "x", F.lit(1).cast("long").alias("n")))
        return _union(parts) if parts else self.spark.createDataFrame([], "table_name string, column_name string, dtype string, x double, n long")

    def domains(self, kinds: tuple[str, ...] = KINDS) -> DataFrame:
        """Distinct non-null values of every column: one row for each value, however often it stands."""
        if all(f"values-{k}" in self._kept for k in kinds):
            return self.values(kinds).where("value is not null").drop("n")
        return self.cells(kinds).where("value is not null").distinct()


def _cell(column: str, kind: str) -> Column:
    """NaN is null."""
    cell = F.col(f"`{column}`")
    return F.when(~F.isnan(cell), cell) if kind == "double" else cell


def _number(column: str, kind: str) -> Column:
    """A number as a double, as its text reads: a float is what it prints."""
    cell = F.col(f"`{column}`")
    return _cell(column, family(kind)).cast("string").cast("double") if kind == "float" else F.when(~F.isnan(cell), cell) if kind == "double" else cell.cast("double")


def _typed(column: str, kind: str) -> Column:
    """A value by which equal texts of a family group: longs, texts, and doubles, where NaN, which is no value, stands for
    -0.0, which prints unlike 0.0."""
    if family(kind) != "double":
        return F.col(f"`{column}`").cast("long") if family(kind) == "long" else F.col(f"`{column}`")
    x = _number(column, kind)
    return F.when((x == 0) & (x.cast("string") == "-0.0"), F.lit(float("nan"))).otherwise(x)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def to_split_json(df: DataFrame) -> str:
    """A small table as the JSON text in split orientation that a notebook prints ({columns, index, data}); for variables, not for data."""
    rows = [list(r) for r in df.collect()]
    return json.dumps({"columns": df.columns, "index": list(range(len(rows))), "data": rows}, default=str)


def parse_split_json(frame: str, spark: SparkSession) -> DataFrame:
    """A frame from its JSON in split orientation, as notebooks print it. Columns of booleans, integers or numbers keep
    their type, nulls aside; all others, and mixed ones, are strings."""
    got = json.loads(frame)

    def kind(cells: list) -> T.DataType:
        types = {type(x) for x in cells if x is not None}
        if types == {bool}:
            return T.BooleanType()
        if types == {int} and all(-(2**63) <= x < 2**63 for x in cells if x is not None):
            return T.LongType()
        return T.DoubleType() if types and types <= {int, float} else T.StringType()

    kinds = [kind([r[k] for r in got["data"]]) for k in range(len(got["columns"]))]
    cast = {T.StringType(): lambda x: x if isinstance(x, str) else json.dumps(x), T.DoubleType(): float}
    rows = [[None if x is None else cast.get(k, lambda x: x)(x) for x, k in zip(r, kinds, strict=True)] for r in got["data"]]
    return spark.createDataFrame(rows, T.StructType([T.StructField(str(c), k) for c, k in zip(got["columns"], kinds, strict=True)]))


def import_code(name: str) -> str:
    """The line of code that reads a found table in a notebook."""
    return f"{canonical(name)} = lake.table({canonical(name)!r})"
