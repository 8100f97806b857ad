import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and out.columns[:2] == ["win", "start"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_training_data_operators(tmp_path):
    """The rest imports without that subpackage and its pipeline."""
    for name in ("__spark_entry__.py", "emberlog"):
        subprocess.run(["cp", "-r", f"{ROOT}/{name}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "emberlog" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'dq_report' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_queries_match_their_sql(spark):
    """A few cheap queries against DuckDB; the driver compares all of them."""
    import duckdb

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("events", "lineitem", "orders", "documents", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    show = lambda rows: sorted(str([round(x, 5) if isinstance(x, float) else x for x in r]) for r in rows)
    for name in ("key_sessions", "split_summary", "window_content", "pr_curve", "pot_threshold", "dedup", "correlate_same_entity", "categories"):
        got = entry.queries()[name](spark, sf)
        want = con.sql(entry.oracle_sql()[name])
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert show(got.select(*columns).collect()) == show(want.select(*[f'"{c}"' for c in columns]).fetchall()), name
