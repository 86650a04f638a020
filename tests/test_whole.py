"""Queries over the whole of their tables, also where their registered SQL reads a part."""

import duckdb
import pytest

from siltmark import catalogue
from tests.test_oracles import TABLES, plain

DIR = "/root/testdata/sf0.01"


def duck(sql):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    return sorted(names), [dict(zip(names, map(plain, r), strict=True)) for r in cursor.fetchall()]


def compare(spark, name, sql):
    """The rows of a query at sf0.01, checked to be those of ``sql``."""
    names, want = duck(sql)
    df = catalogue.QUERIES[name](spark, DIR)
    got = [{c: plain(r[c]) for c in names} for r in df.collect()]
    assert sorted(df.columns) == names
    assert sorted(repr(r) for r in got) == sorted(repr({c: r[c] for c in names}) for r in want)
    return got


@pytest.mark.parametrize("name", ["crdt_array", "json_flatten", "json_unflatten", "strictness_order", "ks_push_pop", "log_index_increment", "merkle_proof", "merkle_root"])
def test_larger_tables(spark, name):
    """Queries that once read a part of their tables, or were too slow to compare, on tables ten times as large."""
    assert compare(spark, name, catalogue.ORACLES[name])


def test_all_sources_merged(spark):
    """Every version of the log is in a source, so the merge is the latest state."""
    name = "kv_merge_sources"
    got = compare(spark, name, catalogue.ORACLES[name])
    latest = catalogue.QUERIES["kv_latest"](spark, DIR).collect()
    assert sorted((r["key"], r["offset"]) for r in got) == sorted((r["key"], r["offset"]) for r in latest)


def test_all_versions_rolled_up(spark):
    got = compare(spark, "by_version_subsystem", catalogue.ORACLES["by_version_subsystem"])
    assert len(got) > 500 and sorted(r["place"] for r in got) == list(range(1, len(got) + 1))


def test_merkle_plan_is_linear(spark):
    """Twelve levels are two passes over stored tables: the plan's text does not grow with the number of levels."""
    from pyspark.sql import functions as F

    from siltmark.operators import merkle

    leaves = spark.range(4100).select(F.col("id").alias("idx"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    nodes = merkle.build(leaves, 4100)
    assert nodes.agg(F.max("level")).first()[0] == 12 and nodes.where("level = 1").count() == 2050
    assert len(nodes._jdf.queryExecution().toString()) < 100_000
    assert merkle.build(leaves.limit(0), 0).count() == 0 and merkle.build(leaves.limit(1), 1).count() == 1


@pytest.fixture
def few_recursive_rows(spark):
    """A limit that recursive SQL meets on small tables as it meets the usual one on large ones."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    yield
    spark.conf.unset("spark.sql.cteRecursionRowLimit")


@pytest.mark.parametrize("name", ["tree_check", "tree_ls", "version_commits", "version_log"])
def test_no_recursive_rows(spark, few_recursive_rows, name):
    """Queries that follow trees and chains meet no limit on recursive rows."""
    assert compare(spark, name, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", ["tree_ls", "tree_check", "tree_get"])
def test_files_listed_twice(spark, tmp_path, name):
    """A file that its directory lists more than once, and two directories of one text: the SQL's rows."""
    rows = [(1, "a", "Brand#1", "ECONOMY", 1), (2, "b", "Brand#2", "ECONOMY", 2)] + [(k, f"n{k}", "Brand#1", "ECONOMY", k) for k in (10, 12, 12, 17, 17, 17)]
    rows += [(7, "c", brand, kind, 7) for kind in ("LARGE", "SMALL") for brand in ("Brand#1", "Brand#2")] + [(8, "d", "Brand#3", "SMALL", 8)] * 2
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    cursor = con.execute(catalogue.ORACLES[name])
    names = [c[0] for c in cursor.description]
    got = catalogue.QUERIES[name](spark, str(tmp_path)).select(*names).collect()
    assert got and sorted(map(repr, map(tuple, got))) == sorted(map(repr, cursor.fetchall()))


def test_log_of_odd_versions(spark, tmp_path):
    """A long chain, a gap, versions listed twice and some without a conversation or a turn: the SQL's rows."""
    rows = [(0, t) for t in range(150)] + [(1, 0), (1, 1), (1, 1), (1, 2), (1, 4), (2, 0), (2, 0), (2, None), (3, -1), (3, 0), (None, 0), (None, 1), (None, None)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(catalogue.ORACLES["version_log"]).fetchall()
    got = catalogue.QUERIES["version_log"](spark, str(tmp_path)).select("conv_id", "last", "ancestor", "distance").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_large_directories_take_linear_time(spark):
    """The grammar of a directory of a hundred thousand lines; empty ends are no lines, empty lines are."""
    import time

    from pyspark.sql import functions as F

    from siltmark.operators import tree

    began = time.perf_counter()
    line = F.concat(F.lit("p"), F.col("id").cast("string"), F.lit(":\t"), F.repeat(F.lit("0"), 64))
    one = spark.range(100_000).select(line.alias("line")).agg(F.array_join(F.collect_list("line"), "\n").alias("t"))
    large = one.select(F.lit("large").alias("hash"), F.concat("t", F.lit("\nno entry\n")).alias("text"))
    small = spark.createDataFrame([("none", ""), ("file", None), ("end", "x"), ("blank", "\n"), ("two", "a\n\nb\n")], "hash string, text string")
    got = sorted(map(tuple, tree.malformed(large.unionByName(small)).collect()))
    assert got == [("blank", ""), ("end", "x"), ("large", "no entry"), ("two", ""), ("two", "a"), ("two", "b")]
    assert time.perf_counter() - began < 60
