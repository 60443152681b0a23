"""Column profiles, semantic types, and the registry of known attributes with its inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An e-mail address: parts of word characters, joined by single dots or hyphens, and a last domain part of two or three.
EMAIL = r"^\w+(?:[.-]\w+)*@\w+(?:[.-]\w+)*\.\w{2,3}$"
#: A social security number by the public numbering rule: no area 000, 666 or from 900 on, no group 00, no serial 0000.
SSN = r"^(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$"
#: The postal codes of the United States' states.
STATES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO",
    "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC",
)
#: A house number, a street with a letter, and a state, which may be followed by a postal code.
ADDRESS = r"^\s*\d+[A-Za-z]?\s+[^,]*[A-Za-z].*[\s,](?:" + "|".join(STATES) + r")(?:[\s,]+\d{5}(?:-\d{4})?)?\s*$"
#: Small synthetic dictionaries; a lake brings its own as (value) tables.
FIRST_NAMES = ("anna", "ben", "carla", "david", "emma", "frank", "grace", "henry")
LAST_NAMES = ("adams", "brown", "clark", "davis", "evans", "ford", "green", "hill")
TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof")
REGISTRY_SIZE = 1000
KEY = ["table_name", "column_name", "dtype"]


def column_profiles(cells: DataFrame) -> DataFrame:
    """n_rows, n_values (non-null), n_distinct and key_score (distinct over all rows) of every column."""
    p = cells.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"), F.countDistinct("value").alias("n_distinct"))
    return p.withColumn("key_score", F.coalesce(F.try_divide("n_distinct", "n_rows"), F.lit(0.0)))


def value_profiles(values: DataFrame) -> DataFrame:
    """The same as column_profiles, from a lake's counted values."""
    held = F.col("value").isNotNull()
    p = values.groupBy(*KEY).agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(held, F.col("n"))), F.lit(0)).alias("n_values"), F.count("value").alias("n_distinct"))
    return p.withColumn("key_score", F.coalesce(F.try_divide("n_distinct", "n_rows"), F.lit(0.0)))


def semantic_types(cells: DataFrame, first_names: tuple[str, ...] = FIRST_NAMES, last_names: tuple[str, ...] = LAST_NAMES) -> DataFrame:
    """(table_name, column_name, label): the first rule that holds; floating-point columns have none.

    All rules are aggregates of one grouping. A column without values counts as gender, as every value it has is one.
    """
    v, low, name = F.col("value"), F.lower("value"), F.lower(F.first("column_name"))
    share = lambda c: F.coalesce(F.avg(F.when(v.isNotNull(), c.cast("int"))), F.lit(0.0))
    holds = lambda c: F.coalesce(F.min(F.when(v.isNotNull(), c.cast("int"))), F.lit(1)) == 1
    dictionary = lambda names: F.count_distinct(F.when(low.isin(*names), low)) / F.greatest(F.count("value"), F.lit(1))
    parts = F.split(v, "[ .]")
    two = F.size(parts) == 2
    full = two & F.lower(parts[0]).isin(*first_names, *TITLES) & F.lower(F.get(parts, F.lit(1))).isin(*last_names)
    string = F.first("dtype") == "string"
    number = F.expr("try_cast(value AS bigint)")
    rules = [
        ("last_name", string & (name.isin("surname", "last name") | (dictionary(last_names) > 0.8))), ("first_name", string & (name.isin("given name", "first name") | (dictionary(first_names) > 0.8))),
        ("full_name", string & ((name == "name") | (F.coalesce(F.try_divide(F.sum(full.cast("int")), F.sum(two.cast("int"))), F.lit(0.0)) > 0.64))), ("gender", string & (name.isin("gender", "sex") | holds(low.isin("m", "f")) | holds(low.isin("male", "female")))),
        ("age", (F.first("dtype") == "long") & ((name == "age") | ((F.count_distinct("value") >= 20) & (F.max(number) <= 120) & (F.min(number) > 1)))),
        ("email", string & ((name == "email") | (share(v.rlike(EMAIL)) > 0.8))), ("ssn", string & ((name == "ssn") | (share(v.rlike(SSN)) > 0.8))),
        ("address", string & ((name == "address") | (share((F.length(v) <= 200) & v.rlike(ADDRESS)) > 0.8))),
    ]
    label = F.coalesce(*(F.when(rule, F.lit(name)) for name, rule in rules))
    return cells.where("dtype != 'double'").groupBy("table_name", "column_name").agg(label.alias("label"))


def neighbour_schema(columns: DataFrame) -> DataFrame:
    """(table_name, column_name, neighbours): the other columns of the table, sorted and joined by commas."""
    other = columns.select("table_name", F.col("column_name").alias("other"))
    pairs = columns.join(other, "table_name").where("column_name != other")
    return pairs.groupBy("table_name", "column_name").agg(F.array_join(F.array_sort(F.collect_list("other")), ",").alias("neighbours"))


def context_scores(columns: DataFrame, neighbours: DataFrame, attributes: DataFrame) -> DataFrame:
    """(table_a, col_a, attribute, seen, occurrences): how often each attribute stood beside the same columns.

    ``columns``: (table_name, column_name); ``neighbours``: (attribute, neighbours, n) of the registry, where neighbours are
    sorted and joined by commas; ``attributes``: (attribute, occurrences).
    """
    own = neighbour_schema(columns).select(F.col("table_name").alias("table_a"), F.col("column_name").alias("col_a"), "neighbours")
    seen = own.join(neighbours.select("attribute", "neighbours", F.col("n").alias("seen")), "neighbours").drop("neighbours")
    return seen.join(attributes.select("attribute", "occurrences"), "attribute")


def registry_scores(cells: DataFrame, columns: DataFrame, registry: dict[str, DataFrame], threshold: float = 0.5) -> DataFrame:
    """(table_a, col_a, attribute, score) of the columns of new tables against the registered attributes of equal type.

    Either side needs 5 distinct values, unless a column of that name is linked to the attribute already.
    """
    values = registry["attribute_values"]
    known = values.groupBy("attribute").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("n_values")).join(registry["attributes"].select("attribute", "dtype"), "attribute")
    known = known.withColumn("key_b", F.coalesce(F.try_divide("n_distinct", "n_values"), F.lit(0.0))).withColumnRenamed("n_distinct", "n_b")
    new = column_profiles(cells).where("dtype != 'double'").select(F.col("table_name").alias("table_a"), F.col("column_name").alias("col_a"), "dtype", F.col("n_distinct").alias("n_a"), F.col("key_score").alias("key_a"))
    named = registry["links"].select("attribute", F.col("column_name").alias("col_a"), F.lit(True).alias("linked")).distinct()
    pairs = new.join(known, "dtype").join(named, ["attribute", "col_a"], "left").where("linked or (n_a >= 5 and n_b >= 5)")
    distinct = cells.where("value is not null and dtype != 'double'").select(F.col("table_name").alias("table_a"), F.col("column_name").alias("col_a"), "dtype", "value").distinct()
    # both sides have a row a value: neither is gathered on the driver, however small it looks when compressed
    shared = distinct.join(values.join(F.broadcast(registry["attributes"].select("attribute", "dtype")), "attribute").hint("merge"), ["dtype", "value"]).groupBy("table_a", "col_a", "attribute").agg(F.count(F.lit(1)).alias("both"))
    on = ["table_a", "col_a", "attribute"]
    scored = pairs.join(shared, on, "left").join(context_scores(columns, registry["neighbours"], registry["attributes"]), on, "left")
    context = F.when(F.col("seen") > 0, (F.col("seen") + 1) / (F.col("occurrences") + 1)).otherwise(F.lit(0.0))
    held = F.coalesce(F.try_divide(F.coalesce("both", F.lit(0)), "n_a"), F.lit(0.0))
    score = 0.2 * context + 0.4 * held + 0.4 * (1 / (F.abs(F.col("key_a") - F.col("key_b")) + 1) - 0.5)
    return scored.select(*on, score.alias("score")).where(F.col("score") > threshold)


def index_columns(cells: DataFrame, columns: DataFrame, registry: dict[str, DataFrame], threshold: float = 0.5, least: int = 20) -> tuple[dict[str, DataFrame], DataFrame]:
    """Registers the columns of new tables: (the registry with them, (table_name, column_name, attribute) of what they became).

    Columns map one to one, in each table, to attributes that they score above the threshold with; string columns without
    one that have more than ``least`` distinct values become attributes, named ``table.column``. Attributes gain the
    values, counts, neighbours, occurrences and links of their columns. All cells count, not a sample of them.
    """
    from tidewater.operators.matching import greedy
    from tidewater.plans.tables import settle

    scored = registry_scores(cells, columns, registry, threshold)
    mapped = greedy(scored, ["table_a"], "col_a", "attribute", "score").select(F.col("table_a").alias("table_name"), F.col("col_a").alias("column_name"), "attribute")
    fresh = column_profiles(cells).where(f"dtype = 'string' and n_distinct > {least}").join(mapped, ["table_name", "column_name"], "left_anti")
    fresh = fresh.select("table_name", "column_name", F.concat_ws(".", "table_name", "column_name").alias("attribute"))
    became = settle(mapped.unionByName(fresh))
    # became has a row a column; without the hint cells, whose files are small when compressed, may be gathered instead
    own = cells.join(F.broadcast(became), ["table_name", "column_name"])
    values = own.where("value is not null").groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"))
    kinds = own.groupBy("attribute").agg(F.first("dtype").alias("dtype"), F.count("value").alias("n_values"), F.count_distinct("table_name").alias("occurrences"))
    beside = neighbour_schema(columns).join(became, ["table_name", "column_name"]).groupBy("attribute", "neighbours").agg(F.count(F.lit(1)).alias("n"))
    add = lambda name, new, *k: registry[name].unionByName(new).groupBy(*k).agg(F.sum("n").alias("n"))
    out = {
        "attribute_values": add("attribute_values", values, "attribute", "value"), "neighbours": add("neighbours", beside, "attribute", "neighbours"),
        "attributes": registry["attributes"].unionByName(kinds).groupBy("attribute", "dtype").agg(F.sum("n_values").alias("n_values"), F.sum("occurrences").alias("occurrences")),
        "links": registry["links"].unionByName(became.select("attribute", "table_name", "column_name")).distinct(),
    }
    return registry | out, became


def search_columns(cells: DataFrame, columns: DataFrame, registry: dict[str, DataFrame], threshold: float = 0.5) -> DataFrame:
    """(table_a, col_a, attribute, score, table_name, column_name): the attribute that each column maps to one to one, and its links."""
    from tidewater.operators.matching import greedy

    mapped = greedy(registry_scores(cells, columns, registry, threshold), ["table_a"], "col_a", "attribute", "score")
    return mapped.join(registry["links"], "attribute")


def candidate_pairs(new: DataFrame, known: DataFrame, pairs: DataFrame, context: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Scores of columns against registered attributes of equal type.

    ``new``, ``known``: profiles; ``pairs``: containment of pairs; ``context``: (table_a, col_a, table_b, col_b, seen,
    occurrences) of neighbour schemas. 0.2 context + 0.4 containment + 0.4 (1 / (1 + |difference of key scores|) - 0.5).
    """
    a = new.where("n_distinct >= 5").select(F.col("table_name").alias("table_a"), F.col("column_name").alias("col_a"), "dtype", F.col("key_score").alias("key_a"))
    b = known.where("n_distinct >= 5").select(F.col("table_name").alias("table_b"), F.col("column_name").alias("col_b"), "dtype", F.col("key_score").alias("key_b"))
    on = ["table_a", "col_a", "table_b", "col_b"]
    scored = a.where("dtype != 'double'").join(b, "dtype").join(pairs.select(*on, "containment"), on, "left").join(context, on, "left")
    seen = F.when(F.col("seen") > 0, (F.col("seen") + 1) / (F.col("occurrences") + 1)).otherwise(F.lit(0.0))
    score = 0.2 * seen + 0.4 * F.coalesce("containment", F.lit(0.0)) + 0.4 * (1 / (F.abs(F.col("key_a") - F.col("key_b")) + 1) - 0.5)
    return scored.select(*on, F.coalesce(score, F.lit(0.0)).alias("score")).where(F.col("score") > threshold)


def update_registry(old: DataFrame, new: DataFrame) -> DataFrame:
    """Registry rows (attribute, value, n) of old and new together: counts add up, values are united."""
    return old.unionByName(new).groupBy("attribute", "value").agg(F.sum("n").alias("n"))


def registry_profile(registry: DataFrame) -> DataFrame:
    return registry.groupBy("attribute").agg(F.sum("n").alias("n_values"), F.count(F.lit(1)).alias("n_distinct")).withColumn("key_score", F.col("n_distinct") / F.col("n_values"))


def evict(attributes: DataFrame, most: int = REGISTRY_SIZE, by: str = "occurrences", name: str = "attribute") -> DataFrame:
    """The most frequent attributes, at most ``most``; ties go by name."""
    return attributes.orderBy(F.desc(by), name).limit(most)


#: Row ids that one row of an index holds at most about.
CHUNK = 10_000


def column_index(rows: DataFrame, row_id: Column, columns: dict[str, str], table_name: str, chunk: int = CHUNK) -> DataFrame:
    """(attribute, value, table_name, chunk, row_ids) of several columns, given the attribute of each, in one pass.

    The rows of a value are dealt by row id in as many chunks as they need, so a frequent value makes no long list.
    """
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(c).cast("string").alias("value")) for c, a in columns.items())))
    long = rows.select(row_id.cast("long").alias("row_id"), cells.alias("x")).select("row_id", "x.*").where("value is not null")
    sizes = long.groupBy("attribute", "value").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    hot = sizes.where("chunks > 1")
    dealt = long.join(hot, ["attribute", "value"], "left").withColumn("chunk", F.pmod(F.xxhash64("row_id"), F.coalesce("chunks", F.lit(1))).cast("int"))
    return dealt.groupBy("attribute", "value", "chunk").agg(F.array_sort(F.collect_list("row_id")).alias("row_ids")).select("attribute", "value", F.lit(table_name).alias("table_name"), "chunk", "row_ids")


def reuse_index(known: DataFrame, same: str, table_name: str) -> DataFrame:
    """The index rows of a table that equals the indexed table ``same``."""
    return known.where(F.col("table_name") == same).withColumn("table_name", F.lit(table_name))


def inverted_index(rows: DataFrame, row_id: Column, column: str, table_name: str) -> DataFrame:
    """(value, table_name, row_ids): positions of each value, sorted, in one list; column_index bounds the lists."""
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.array_sort(F.collect_list(row_id)).alias("row_ids")).withColumn("table_name", F.lit(table_name))


def candidate_keys(profiles: DataFrame, most: int = 1) -> DataFrame:
    """The columns of best key score of each table, floating-point ones excepted."""
    order = Window.partitionBy("table_name").orderBy(F.desc("key_score"), "column_name")
    return profiles.where("dtype != 'double'").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
