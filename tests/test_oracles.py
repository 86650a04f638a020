"""Every query of the library against its DuckDB SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from siltmark import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    assert os.path.isdir(DIR)
    df = catalogue.QUERIES[name](spark, DIR)
    cursor = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(repr([plain(r[names.index(c)]) for c in order]) for r in cursor.fetchall())
    got = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    assert got == want


def test_entry_without_corpus_modules():
    """The entry point needs nothing of the corpus subpackage but what it guards."""
    import ast

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "siltmark")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                for node in ast.walk(ast.parse(open(os.path.join(folder, f)).read())):
                    names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                    assert not any("llm" in n for n in names), f
