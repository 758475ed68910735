"""Each query with SQL agrees with it, on the smallest tables."""

import math

import duckdb
import pytest

from tarn.operators import history
from tarn.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


@pytest.fixture(scope="module")
def sql(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, sql, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    if name in ORACLES:
        told = sql.execute(ORACLES[name])
        names = [d[0] for d in told.description]
        assert sorted(names) == columns
        other = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in told.fetchall()), key=repr)
        assert mine == other


def test_introduced(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("x", "y")], "child string, parent string")
    commits = spark.createDataFrame([(i,) for i in "abcdxy"], "id string")
    def run(*refs):
        return sorted(r.id for r in history.introduced(spark.createDataFrame(list(refs), "ref string, tip string, watermark string"), commits, edges).collect())

    assert run(("m", "c", "b")) == ["c"]
    assert run(("m", "c", "x")) == ["a", "b", "c"]  # no ancestor: the full history
    assert run(("m", "c", "gone")) == ["a", "b", "c"]
    assert run(("m", "c", "b"), ("new", "a", None)) == ["c"]
    assert run(("m", "c", "c")) == []
    with pytest.raises(ValueError):
        run(("m", "zz", None))


def test_tree_diff_kinds(spark):
    schema = "path string, oid string, kind string"
    new = spark.createDataFrame([("a", "1", "file"), ("b", "2", "file"), ("c", "3", "gitlink"), ("d", "4", "file"), ("e", "5", "symlink")], schema)
    old = spark.createDataFrame([("a", "1", "executable"), ("b", "0", "file"), ("d", "4", "tree"), ("gone", "9", "file")], schema)
    got = {(r.path, r.change) for r in history.tree_diff(new, old).collect()}
    assert got == {("b", "Modify"), ("d", "Add"), ("e", "Add")}


def test_large_graphs_walk_by_joins(spark, monkeypatch):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("e", "c"), ("e", "d")], "child string, parent string")
    starts = spark.createDataFrame([("x", "e"), ("y", "b")], "ref string, id string")
    commits = spark.createDataFrame([(i,) for i in "abcde"], "id string")

    def run():
        return sorted(map(tuple, history.reachable_by(starts, edges).collect())), sorted(map(tuple, history.generations(commits, edges).collect()))

    small = run()
    assert small[0] == [("x", i) for i in "abcde"] + [("y", "a"), ("y", "b")] and small[1] == [("a", 1), ("b", 2), ("c", 3), ("d", 3), ("e", 4)]
    monkeypatch.setattr(history, "MOST_EDGES", 0)
    assert run() == small


def _plans(spark, after=-1):
    """Plans that have run, by number, after a number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = spark._jsparkSession.sharedState().statusStore().executionsList()
    every = [ran.apply(i) for i in range(ran.size())]
    return {x.executionId(): x.physicalPlanDescription() for x in every if x.executionId() > after}


def test_large_graphs_send_counted_sets_alone(spark, monkeypatch):
    """What the planner would send by the size of files is shuffled; a long row of commits takes few rounds."""
    chain = [(k + 1, k) for k in range(20)]
    merges = [(100, 20), (100, 5), (101, 100), (102, 101), (102, 100), (102, 100)]
    lost = [(200, 999), (201, 200), (201, 20), (202, 201), (300, 301), (301, 300), (302, 300), (302, 20), (303, 302)]
    edges = history.materialise(spark.createDataFrame(chain + merges + lost, "child long, parent long"), "edges")
    commits = history.materialise(spark.createDataFrame([(i,) for i in {x for e in edges.collect() for x in e} - {999}], "id long"), "commits")
    starts = history.materialise(spark.createDataFrame([("x", 102), ("y", 41), ("y", 7)], "ref string, id long"), "starts")

    def run():
        return sorted(map(tuple, history.reachable_by(starts, edges).collect())), sorted(map(tuple, history.generations(commits, edges).collect()))

    small = run()
    assert small[1] == [(k, k + 1) for k in range(21)] + [(100, 22), (101, 23), (102, 24)]
    written = []
    monkeypatch.setattr(history, "MOST_EDGES", 0)
    monkeypatch.setattr(history, "MOST_SENT", 0, raising=False)
    monkeypatch.setattr(history, "MOST_PARTS", 3, raising=False)
    before = max(_plans(spark))
    assert run() == small
    plans = _plans(spark, before)
    assert plans and not [p for p in plans.values() if "BroadcastExchange" in p]
    monkeypatch.setattr(history, "materialise", lambda df, name, f=history.materialise: written.append(name) or f(df, name))
    history.generations(commits, edges)
    assert len(written) < 16
