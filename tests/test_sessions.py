from datetime import datetime, timedelta
from pathlib import Path

import pytest

from graphloom.streaming import ingest, sessions

SCHEMA = "session_id string, ts timestamp, id long, content string"
START = datetime(2024, 1, 1)


def plain(rows, ttl, kept):
    out, by = [], {}
    for key, ts, i, content in rows:
        if key is not None and ts is not None:
            by.setdefault(key, []).append((round((ts - datetime(1970, 1, 1)) / timedelta(microseconds=1)), i or 0, content or ""))
    for key, own in by.items():
        runs = []
        for m in sorted(own):
            if runs and m[0] - runs[-1][-1][0] <= ttl * 1_000_000:
                runs[-1].append(m)
            else:
                runs.append([m])
        out += [(key, r[0][0], r[-1][0], len(r), tuple(m[2] for m in r[-kept:])) for r in runs]
    return sorted(out)


def shown(df):
    return sorted((r.session_id, r.started, r.ended, r.n_messages, tuple(r.last)) for r in df.collect())


@pytest.fixture()
def rows(rng):
    at = lambda s: START + timedelta(seconds=s, microseconds=rng.randrange(1_000_000))
    out = [(f"s{rng.randrange(4)}", at(rng.randrange(20_000)), i, rng.choice(["a", "b", None])) for i in range(300)]
    return [*out, *out[:20], (None, START, 1, "x"), ("s1", None, 2, "y"), ("s1", START, None, None)]


def test_table_equals_plain(spark, rows):
    assert shown(sessions.sessions(spark.createDataFrame(rows, SCHEMA), 120, 3)) == plain(rows, 120, 3)
    assert sessions.sessions(spark.createDataFrame([], SCHEMA)).count() == 0


def test_replayed_stream_equals_the_table(spark, rows, tmp_path, rng):
    """Files in any order of time, several batches over one checkpoint, and a last message that lets all else expire."""
    rng.shuffle(rows)
    waves = [rows[i::4] for i in range(4)] + [[("end", START + timedelta(days=2), 1, "z")]]
    for i, wave in enumerate(waves):
        spark.createDataFrame(wave, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    provider = spark.conf.get(sessions._PROVIDER)
    with sessions.state_store(spark):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
        got = shown(ingest.run_available(sessions.expiring_sessions(stream, 120, "12 hours", 3), "append", str(tmp_path / "out")))
    assert spark.conf.get(sessions._PROVIDER) == provider
    assert got == plain(rows, 120, 3)


def test_spans_merge_in_any_order(rng):
    rows = [[t, t, 1, [(t, i, str(i))]] for i, t in enumerate(rng.randrange(10_000_000) for _ in range(60))]
    whole = sessions.merged(rows, 0.2, 4)
    for _ in range(5):
        rng.shuffle(rows)
        parts = [sessions.merged(rows[i::3], 0.2, 4) for i in range(3)]
        assert sessions.merged([s for p in parts for s in p], 0.2, 4) == whole


def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path):
    from graphloom.plans import queries
    from graphloom.plans import sessions as planned

    one, many = f"{tmp_path}/one", f"{tmp_path}/many"
    for name in ("clicks", "events"):
        Path(one).mkdir(exist_ok=True)
        (Path(one) / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
        spark.read.parquet(f"{one}/{name}.parquet").repartition(3).write.parquet(f"{many}/{name}.parquet")
    for query in (planned.dlg_stream_sessions, queries.evt_stream_window):
        found = [sorted(map(str, query(spark, d).collect())) for d in (one, many)]
        assert found[0] == found[1] != []
