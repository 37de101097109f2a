"""The crawl as a stream: against the batch cycle on an interleaved log, over restarts, with replayed epochs."""

import random

from pyspark.sql import functions as F

from landloom.operators import observe
from landloom.sources import files
from landloom.storage import StateTable
from landloom.streaming import crawl

LOG = crawl.LOG


def drawn_log(rng):
    """Runs of three sources, interleaved; one run is not complete, one finds nothing, resources come and go."""
    runs = []
    for source in (1, 2, 3):
        for run in range(6):
            rows = []
            for k in range(5):
                if run == 0 or rng.random() < 0.7 and not (source == 3 and run == 2):
                    outcome = rng.choice(["ok", "ok", "ok", "not_modified", "error"]) if run else "ok"
                    rows.append((source, run, 0, f"r{k}", rng.choice("uv") if rng.random() < 0.3 else "u", rng.choice(["m", None]) if rng.random() < 0.3 else "m", rng.choice("xyz") if outcome == "ok" else None, outcome, None))
            rows.append((source, run, None, None, None, None, None, None, not (source == 2 and run == 3)))
            runs.append(rows)
    return runs


def batch_events(spark, runs):
    """The batch cycle, run by run."""
    keys = "source_id long, resource_key string, url string, meta string, sha string"
    states, out = {}, set()
    for rows in runs:
        source, run, complete = rows[-1][0], rows[-1][1], rows[-1][-1]
        old = spark.createDataFrame(states.get(source, []), keys + ", status string")
        found = spark.createDataFrame([(r[0], r[3], r[4], r[5], r[6], r[7]) for r in rows[:-1]], keys + ", outcome string")
        state = observe.observation_cycle(old, found, complete)
        done = state.select("source_id", "resource_key", "url", "meta", "sha", "status", "events").collect()
        out |= {(source, run, r.resource_key, e) for r in done for e in r.events}
        states[source] = [tuple(r)[:6] for r in done]
    return out


def test_change_stream_equals_batch_over_restarts(spark, tmp_path):
    runs = drawn_log(random.Random(4))
    want = batch_events(spark, runs)
    assert {e for *_, e in want} == set(observe.CHANGED)
    by_source = [[r for rows in runs if rows[0][0] == s for r in rows] for s in (1, 2, 3)]
    log = [r for rows in zip(*(x + [None] * 40 for x in by_source), strict=False) for r in rows if r]  # sources interleaved, runs cut anywhere
    log = [(s, run, i, *rest) for i, (s, run, _, *rest) in enumerate(log)]
    assert len(log) == sum(map(len, runs))
    for go in range(4):
        part = log[go * len(log) // 4 : (go + 1) * len(log) // 4]
        spark.createDataFrame(part, LOG).repartition(3).write.mode("append").parquet(str(tmp_path / "log"))
        crawl.start_change_stream(spark.readStream.schema(LOG).parquet(str(tmp_path / "log")), str(tmp_path / "out"), str(tmp_path / "progress"), buckets=3)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


RUN = "source_id long, run_id long, ts timestamp, discovered long, downloaded long, errors long, changed long, fatal string"


def finished(spark, rows):
    """rows: source, run, errors, changed, fatal; an hour between runs."""
    return spark.createDataFrame([(s, r, 3, 1, e, c, f) for s, r, e, c, f in rows], "source_id long, run_id long, discovered long, downloaded long, errors long, changed long, fatal string").withColumn("ts", F.timestamp_seconds(F.col("run_id") * 3600))


def states(table):
    return {r.source_id: (r.consecutive_failures, r.status, r.last_error, r.last_success_at and r.last_success_at.timestamp() // 3600, r.last_change_at and r.last_change_at.timestamp() // 3600) for r in table.read().collect()}


def test_state_table_carries_failures_and_replays(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), crawl.STATE, "source_id", buckets=4)
    assert table.read().count() == 0
    first = finished(spark, [(1, 1, 0, 2, None), (1, 2, 0, 0, "down"), (2, 1, 1, 0, None), (3, 1, 0, 0, "blocked:robots")])
    second = finished(spark, [(1, 3, 0, 0, "down again"), (2, 2, 0, 0, "x"), (2, 3, 0, 1, None), (4, 3, 0, 0, "y")])
    table.merge(first, 0, crawl.merged_states)
    one = states(table)
    assert one == {1: (1, "failed", "down", 1, 1), 2: (0, "partial", None, 1, None), 3: (0, "succeeded", None, 1, None)}
    table.merge(second, 1, crawl.merged_states)
    two = states(table)
    assert two == {1: (2, "failed", "down again", 1, 1), 2: (0, "succeeded", None, 3, 3), 3: one[3], 4: (1, "failed", "y", None, None)}
    table.merge(second, 1, crawl.merged_states)  # the epoch comes again
    assert states(table) == two
    table.merge(second.limit(0), 2, crawl.merged_states)
    assert states(table) == two
    third = finished(spark, [(1, 4, 0, 0, "third")])
    table.merge(third, 3, crawl.merged_states)
    done = crawl.with_schedule(table.read(), F.lit(3600), F.lit(True), F.lit(False), jitter_s=0).where("source_id = 1").first()
    assert (done.consecutive_failures, done.health) == (3, "failing") and done.next_check_at.timestamp() == 4 * 3600 + 6 * 3600


def test_epoch_without_manifest_is_not_seen(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), crawl.STATE, "source_id", buckets=2)
    table.merge(finished(spark, [(1, 1, 0, 0, None)]), 0, crawl.merged_states)
    before = states(table)
    broken = StateTable(spark, str(tmp_path / "t"), crawl.STATE, "source_id", buckets=2)
    broken._commit = lambda epoch, current: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        broken.merge(finished(spark, [(1, 2, 0, 0, "down")]), 1, crawl.merged_states)
    except RuntimeError:
        pass
    assert states(table) == before
    table.merge(finished(spark, [(1, 2, 0, 0, "down")]), 1, crawl.merged_states)
    assert states(table)[1][:2] == (1, "failed")


def test_pick_up_takes_new_files_only(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    paths = [str(tmp_path / x) for x in ("in", "out", "progress")]
    (tmp_path / "in" / "a.pdf").write_bytes(b"one")
    (tmp_path / "in" / "b.txt").write_bytes(b"not wanted")
    files.pick_up(spark, *paths, "*.pdf")
    (tmp_path / "in" / "deep" / "c.pdf").write_bytes(b"twelve")
    files.pick_up(spark, *paths, "*.pdf")
    files.pick_up(spark, *paths, "*.pdf")
    got = {(r.path.rsplit("/", 1)[1], r.length, r["pass"]) for r in spark.read.parquet(paths[1]).collect()}
    assert got == {("a.pdf", 3, 0), ("c.pdf", 6, 1)}
