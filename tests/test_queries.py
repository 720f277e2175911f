"""Every bound query against its SQL on the small driver tables, at two partition counts; the entry without the corpus operators."""
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from .conftest import DATA, ROOT

sys.path.insert(0, str(ROOT))
from tessera.plans import vault_queries  # noqa: E402, F401 (registers its queries)
from tessera.plans.queries import ORACLES, QUERIES  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].round(5) if df[c].dtype.kind == "f" else df[c].astype(object).where(df[c].notna(), None).astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, duck, name):
    got, want = normal(QUERIES[name](spark, str(DATA)).toPandas()), normal(duck.sql(ORACLES[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", ["lexical_topk", "fused_ranking", "bfs_two_hop", "see_also", "recurring_themes"])
def test_partitions_do_not_matter(spark, name):
    out = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(normal(QUERIES[name](spark, str(DATA)).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    pd.testing.assert_frame_equal(*out)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() >= 0


@pytest.mark.parametrize("without", [("corpus_pipeline.py",), ()])
def test_entry_without_corpus_operators(tmp_path, without):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", *without, "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'lexical_topk' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={"PATH": "/usr/bin:/bin"})
