import __spark_entry__ as entry
import duckdb
import pandas as pd
import pytest

SMALL = "/root/testdata/sf0.001"
CHECKED = ["temporal_metrics", "structural_metrics", "graph_degrees", "components_hist", "cocitation_pairs", "vote_stats", "coverage", "markers", "marker_numbers", "reference_entries", "reply_scores", "layout_citations", "layout_sections", "paper_orphans", "judge_votes", "similar_page_titles"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    got = entry.queries()[name](spark, SMALL).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    show = lambda v: "-" if pd.isna(v) else f"{v:.6g}" if isinstance(v, (int, float)) else str(v)
    rows = lambda df: sorted(tuple(show(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)
