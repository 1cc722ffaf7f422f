"""The driver's contract: names, SQL twins, and a repository without the llm subpackage."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


def test_without_llm(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'mean' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["flagship", "parabola_fit", "otsu_split", "color_spread", "magnitude_percentage_ratio", "bins_extractor", "bootstrap", "dmdt_norm_max", "windows_non_overlapping", "duplicates_mean", "few_observations", "streaming_bins", "linear_features", "all_variability_features", "periodogram_freq_power", "chi2_pvar", "anderson_darling"])
def test_like_sql(spark, name):
    import __spark_entry__ as entry

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    rows = lambda f: sorted(tuple(None if v != v else v for v in r) for r in f[sorted(want.columns)].astype(object).itertuples(index=False))
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(rows(got), key=key) == sorted(rows(want), key=key)
