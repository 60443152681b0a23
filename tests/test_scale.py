"""Steps whose cost must not grow faster than their input."""

from bisect import bisect_right

from tidewater.operators import distribution, keys, profiling, similarity, sketch
from tidewater.plans import candidates, queries, relate_queries, search, search_queries
from tidewater.plans.tables import settle
from tidewater.sources.lake import WORD, Lake
from tidewater.sources.store import REGISTRY, Store


def pairs(a, b):
    keys = ["table_a", "col_a", "pos_a", "table_b", "col_b", "pos_b", "dtype", "both", "n_a", "n_b"]
    return sorted(tuple(r) for r in similarity.pair_counts(a, b).select(keys).collect())


def test_classes_of_values_count_as_domains_do(spark):
    odd = spark.sql("SELECT * FROM VALUES (1, 1.5D, 0.1F, 'a'), (2, -0.0D, -0.0F, 'b'), (NULL, 0.0D, FLOAT('NaN'), NULL), (3, DOUBLE('NaN'), 7.0F, 'a'), (2147483647, 0.1D, 1e10F, '') t(i, d, f, s)")
    wide = spark.range(5).selectExpr(*(f"id % {k % 4 + 1} AS c{k}" for k in range(WORD + 9)), "id / 10.0D AS d", "CAST(id AS STRING) AS s")
    lake = Lake(spark, {"odd": odd, "wide": wide, "none": odd.where("i > 5 AND i < 0")})
    split = lambda d: (d.where("table_name = 'odd'"), d.where("table_name != 'odd'"))
    classes = lake.classes()
    assert not [k for k in lake._kept if k.startswith("values")]
    assert pairs(*split(classes)) == pairs(*split(lake.domains()))
    assert pairs(classes, classes) == pairs(lake.domains(), lake.domains())
    held = {(r["table_name"], r["column_name"]): (r["rows"], r["held"]) for r in lake.held().collect()}
    assert held["odd", "i"] == (5, 4) and held["odd", "d"] == (5, 4) and held["odd", "f"] == (5, 4) and held["none", "s"] == (0, 0)


def test_column_pairs_have_no_row_for_each_value(spark, sf):
    """columns meet by what they share, not value by value."""
    for side in (*queries._domains(spark, sf), *relate_queries._sides(spark, sf)):
        assert side.count() < 400
    assert search_queries.whole_lake(spark, sf).classes().where("column_name = 'o_orderkey'").count() < 100


def test_whole_rows_are_paired_only_by_keys_that_hold(spark):
    """F5, F6, F13-F15, F17-F21: other candidates are told by their own values."""
    a = spark.sql("SELECT id AS k, id % 3 AS few, IF(id % 4 = 0, NULL, id / 2.0D) AS x, CAST(id % 7 AS STRING) AS s FROM range(40) UNION ALL SELECT 5, 1, 2.5D, 'q' UNION ALL SELECT NULL, 1, 2.5D, 'q'")
    b = spark.sql("SELECT id AS bk, id % 3 AS bfew, IF(id % 5 = 0, DOUBLE('NaN'), id / 2.0D) AS bx, CAST(id % 7 AS STRING) AS bs FROM range(10, 60)")
    found = keys.detect_key(a, b, {"k": "bk", "few": "bfew", "x": "bx", "s": "bs"}, fills=True)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 2
    rows_a, rows_b = ([tuple(r) for r in d.collect()] for d in (a, b))
    once = lambda rows: {k: r for r in rows if (k := r[0]) is not None and sum(s[0] == k for s in rows) == 1}
    x, y = once(rows_a), once(rows_b)
    both = sorted(x.keys() & y.keys())
    equal = sum(x[k][i] == y[k][i] for k in both for i in (1, 2, 3))
    filled = sum(x[k][2] is None and y[k][2] == y[k][2] for k in both)
    got = found.collect()
    assert [r["key_a"] for r in got] == ["k"] and got[0]["n_pairs"] == len(both) and got[0]["equal_cells"] == equal
    assert got[0]["ratio"] == len(both) / 60 and abs(got[0]["nan_delta"] - filled / (len(rows_a) * 4)) < 1e-12
    assert keys.detect_key(a, b, {}).count() == 0


def test_searches_stage_no_values(spark, sf):
    lake = search_queries._whole_lake(spark, sf)
    names = [n for n in lake.names() if n != search_queries.QUERY]
    search.random_access(lake, search_queries.QUERY, names, search.mapped_pairs(lake, search_queries.QUERY, names)).collect()
    assert [*lake._kept] == ["classes"]


def distances(d, pairs):
    """Two-sample distances of columns of (column_name, x) rows, by their definition."""
    xs = {}
    for r in d.collect():
        xs.setdefault(r["column_name"], []).append(r["x"])
    share = lambda c, x: sum(v <= x for v in xs[c]) / len(xs[c])
    return {(a, b): max(abs(share(a, x) - share(b, x)) for x in xs[a] + xs[b]) for a, b in pairs}


def test_distances_are_exact_by_ranges(spark, monkeypatch):
    """no task orders all values of two columns, and values are ordered only where counts by range leave a hit open."""
    wide = spark.range(3000).selectExpr("id AS a", "id + 7 AS b", "IF(id % 3 = 0, 5, id * id) AS c", "id % 4 AS d", "CAST(NULL AS BIGINT) AS e", "id / 7.0D AS f", "IF(id % 2 = 0, DOUBLE('NaN'), -id / 9.0D) AS g", "IF(id = 0, DOUBLE('Infinity'), id / 7.5D) AS h")
    x = Lake(spark, {"t": wide}).numbers()
    got = {(r["col_a"], r["col_b"]): r["d"] for r in distribution.ks_pairs(x, x).collect()}
    want = distances(x, [(p, q) for own in ("abcd", "fgh") for p in own for q in own if p != q])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    largest, within = [], distribution._within

    def watched(a, b, wanted, cuts):
        largest.append(wanted.agg({"in_a": "max"}).first()[0] or 0)
        return within(a, b, wanted, cuts)

    monkeypatch.setattr(distribution, "_within", watched)
    for threshold in (0.5, 0.997):
        hits = {(r["col_a"], r["col_b"]) for r in distribution.ks_hits(x, x, threshold).collect()}
        assert hits == {k for k, d in want.items() if 1 - d >= threshold}
    distribution.ks_pairs(x, x).collect()
    assert max(largest) < 1500


def test_ranges_are_numbered_by_cuts(spark):
    cuts = [float(k * k) for k in range(40)]
    xs = [*cuts, -1.0, 0.5, 1500.5, float("inf"), float("-inf")]
    got = distribution._ranged(spark.createDataFrame([("long", x) for x in xs], "dtype string, x double"), {"long": cuts, "double": []}).collect()
    assert len(got) == len(xs) and all(r["range"] == bisect_right(cuts, r["x"]) for r in got)


def test_index_and_candidates_stage_texts_only(spark, sf):
    """numbers need no row a value there."""
    lake = search_queries._whole_lake(spark, sf)
    candidates.column_hits(lake, search_queries.QUERY).collect()
    assert [*lake._kept] == ["values-string"]


def test_tables_without_text_count_as_indexed(spark, tmp_path):
    lake, store = Lake(spark, {"t": spark.range(3).selectExpr("id", "CAST(id AS STRING) AS s"), "u": spark.range(3)}), Store(spark, str(tmp_path))
    added = lambda: sorted(r[0] for r in sketch.build(store, lake.domains(("string",)), without=["u"]).collect())
    assert added() == ["t", "u"] and added() == []


def test_cells_are_not_gathered_on_the_driver(spark, tmp_path):
    """F8-F12: what is broadcast has a row a column, not a row a cell, though the file is far below the threshold."""
    spark.range(3000).selectExpr("id", "CONCAT('n', id % 900) AS name", "CONCAT('t', id % 40) AS kind").coalesce(1).write.parquet(str(tmp_path / "t"))
    lake = Lake(spark, {"t": spark.read.parquet(str(tmp_path / "t"))})
    cells, columns = lake.cells(("long", "string")), lake.columns().select("table_name", "column_name")
    first = profiling.index_columns(cells, columns, {n: spark.createDataFrame([], s) for n, s in REGISTRY.items()})[0]
    known = {n: d if n == "column_index" else settle(d) for n, d in first.items()}
    scored = profiling.registry_scores(cells, columns, known, 0.0)
    assert {r["attribute"] for r in scored.collect()} == {"t.name", "t.kind"}
    assert "SortMergeJoin [dtype" in scored._jdf.queryExecution().executedPlan().toString()
    for df in (first["attribute_values"], first["attributes"]):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" in plan and "parquet" not in plan[plan.index("BroadcastExchange") :].split("ExistingRDD")[0]
