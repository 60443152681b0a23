"""Every related-table query against its SQL twin, and facts known beforehand."""

import duckdb
import pytest

from tests.conftest import SF
from tidewater.plans import queries, search, search_queries
from tidewater.plans.registered import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, order):
    def one(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, bool):
            return str(int(v))
        return f"{round(float(v), 6) + 0.0:.6f}" if isinstance(v, int | float) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(one(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    assert len(set(got.columns)) == len(got.columns)
    if name in ORACLE:
        cursor = duck.execute(ORACLE[name])
        columns = [d[0] for d in cursor.description]
        want = cursor.fetchall()
        assert sorted(columns) == sorted(got.columns)
        order = sorted(columns)
        assert plain([tuple(r) for r in got.collect()], [got.columns.index(c) for c in order]) == plain(want, [columns.index(c) for c in order])


@pytest.mark.parametrize("mode", [search.TRAINING, search.FEATURES, search.CLEANING])
def test_threshold_search_equals_full_search(spark, mode):
    lake = search_queries.whole_lake(spark, SF)
    prov = spark.createDataFrame([("orders", 0.5), ("customer", 0.01)], "table_name string, prov double")
    full = search.search(lake, search_queries.QUERY, mode, 6, provenance=prov)
    some = search.search(lake, search_queries.QUERY, mode, 1, provenance=prov)
    assert some.hits.first() == full.hits.first()
    assert some.scored.count() <= full.scored.count() == 6
    again = search.search(lake, search_queries.QUERY, mode, 6, provenance=prov, state=full.scored)
    assert again.hits.collect() == full.hits.collect()


def test_a_clear_winner_spares_the_others(spark):
    lake = search_queries.whole_lake(spark, SF)
    prov = spark.createDataFrame([("orders", 1.0)], "table_name string, prov double")
    found = search.search(lake, search_queries.QUERY, search.FEATURES, 1, provenance=prov)
    assert [r["table_name"] for r in found.hits.collect()] == ["orders"] and found.scored.count() < 6


def test_holes_are_found_and_filled(spark):
    scored = {r["table_name"]: r for r in search_queries.random_access(spark, SF).collect()}
    assert scored["orders"]["keys"] == "o_orderkey" and scored["orders"]["nan_delta"] > 0.02
    assert scored["nation"]["nan_delta"] == 0


def test_empty_query_table(spark):
    from tidewater.sources.lake import Lake

    lake = Lake(spark, {"q": spark.createDataFrame([], "a int, b string"), "t": spark.createDataFrame([(1, "x")], "a int, b string")})
    for mode in search.TASKS:
        assert search.search(lake, "q", mode).hits.count() == 1
    with pytest.raises(ValueError):
        search.search(lake, "q", 7)


def test_empty_columns_have_no_similarity(spark):
    from tidewater.operators.similarity import column_jaccard

    a, b = spark.createDataFrame([(None,)], "x int"), spark.createDataFrame([(1,)], "x int")
    assert column_jaccard(a, "x", b, "x").first()["jaccard"] == 0
    known = spark.createDataFrame([(x,) for x in (1, 2, 3, 4, 5, 6)], "x int"), spark.createDataFrame([(x,) for x in (1, 2, 0, 0, 0, 0)], "x int")
    assert column_jaccard(known[0], "x", known[1], "x").first()["jaccard"] == pytest.approx(2 / 7)


def test_signatures_of_a_stream(spark, tmp_path):
    from tidewater.operators.sketch import signatures
    from tidewater.streaming.incremental import index_stream, read_index

    cells = queries.lake(spark, SF).cells(("string",))
    cells.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    index_stream(stream, str(tmp_path / "out"), str(tmp_path / "mark"), 8).awaitTermination()
    want = signatures(cells.where("value is not null").distinct(), 8)
    assert read_index(spark, str(tmp_path / "out")).exceptAll(want).isEmpty()
