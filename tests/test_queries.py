"""The driver's entry points, and stated queries against their SQL."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["kg_counts", "doc_fixed_chunks", "doc_tokens", "dlg_session_counts", "cache_hit_rate"])
def test_runs_and_has_rows(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", ["kg_paths_le3", "kg_type_names", "cjk_path_tokens", "cjk_model_counts", "doc_projected_vectors", "doc_semantic_chunks", "doc_hybrid_chunks", "ext_mention_places", "ext_triples", "qa_parse_intent", "dlg_stream_sessions", "dlg_pronoun_context", "lm_sampled_tokens"])
def test_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for file in os.listdir(DATA):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{file}')")
    found = con.execute(entry.oracle_sql()[name])
    columns = sorted(c[0] for c in found.description)
    at = [[c[0] for c in found.description].index(c) for c in columns]
    want = sorted(str([plain(r[i]) for i in at]) for r in found.fetchall())
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == columns
    assert sorted(str([plain(r[c]) for c in columns]) for r in df.collect()) == want != []
