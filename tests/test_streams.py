import datetime as dt
import shutil

from attestry.streaming import events as T
from attestry.streaming import parts as P

COLS = "event_id long, ts timestamp, target string, decision string"


def files(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, COLS).coalesce(1).write.mode("append").parquet(folder)


def at(minute):
    return dt.datetime(2025, 1, 1, 0, minute)


def test_late_and_repeated_events(spark, tmp_path):
    src = str(tmp_path / "in")
    files(spark, src, [[(1, at(10), "a", "ACCEPTED"), (2, at(11), "b", "REJECTED")], [(3, at(5), "a", "NEEDS_FIX"), (1, at(10), "a", "ACCEPTED")], [(4, at(12), "b", "ACCEPTED")]])
    schema = spark.read.parquet(src).schema
    stream = lambda: T.read_stream(spark, src, schema, files_per_trigger=1)
    T.write_batches(T.intake(stream()), str(tmp_path / "o1"), str(tmp_path / "c1"), "append")
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "o1")).collect()) == [1, 2, 3, 4]
    # a second run over the same folder finds nothing new
    T.write_batches(T.intake(stream()), str(tmp_path / "o1"), str(tmp_path / "c1"), "append")
    assert spark.read.parquet(str(tmp_path / "o1")).count() == 4


def test_parts_keep_late_events_and_survive_compaction_and_retry(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "c"))
    day = dt.timedelta(days=1)
    batches = [
        [(1, at(10), "a", "ACCEPTED"), (2, at(11), "b", "REJECTED"), (None, at(1), "n", "ACCEPTED"), (9, None, "z", "ACCEPTED")],
        [(3, at(5), "a", "NEEDS_FIX"), (1, at(10), "a", "ACCEPTED"), (None, at(1), "n", "ACCEPTED"), (9, None, "z", "ACCEPTED")],
        [(4, at(12), "b", "ACCEPTED"), (4, at(12), "b", "ACCEPTED"), (5, at(0) - 400 * day, "a", "ACCEPTED")],
        [(5, at(0) - 400 * day, "a", "ACCEPTED"), (2, at(11), "b", "REJECTED"), (6, at(1) + day, "a", "REJECTED")], []]
    steps = {"latest": P.newest_of("target", "ts", "event_id", "decision"), "days": P.counts_of("decision", "ts")}
    keys = {"latest": ["target"], "days": ["day", "decision"]}
    schema = spark.createDataFrame([], COLS).schema

    def run():
        P.write_new_events(T.read_stream(spark, src, schema, files_per_trigger=1), out, ckpt, results={n: s[0] for n, s in steps.items()})

    def answers():
        return (sorted(str(r.event_id) for r in P.read_new_events(spark, out).collect()),
                {r.target: r.event_id for r in P.read_parts(spark, f"{out}/latest", steps["latest"][1]).collect()},
                sorted((r.decision, str(r.day)[:10], r.n) for r in P.read_parts(spark, f"{out}/days", steps["days"][1]).collect()))

    def shrink():
        return [P.compact(spark, out, [P.DAY, "event_id"])] + [P.compact(spark, f"{out}/{n}", keys[n], s[1]) for n, s in steps.items()]

    for part in (batches[:2], batches[2:]):
        files(spark, src, part)
        run()
        before = answers()
        assert shrink() == [True] * 3 and answers() == before
    assert shrink() == [False] * 3
    want = (["1", "2", "3", "4", "5", "6", "9", "None", "None"], {"a": 6, "b": 4, "n": None, "z": 9},
            [("ACCEPTED", "2023-11-28", 1), ("ACCEPTED", "2025-01-01", 4), ("NEEDS_FIX", "2025-01-01", 1), ("REJECTED", "2025-01-01", 1), ("REJECTED", "2025-01-02", 1)])
    assert answers() == want
    # the newest batch again, as after a crash between its write and its commit
    number = max(int(p.name) for p in (tmp_path / "c" / "commits").iterdir() if p.name.isdigit())
    for mark in (tmp_path / "c" / "commits").glob(f"*{number}*"):
        mark.unlink()
    shutil.rmtree(f"{out}/parts/batch={number}")
    run()
    assert answers() == want


def test_parts_without_a_batch_and_ids_of_any_day(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], COLS).write.parquet(src)
    schema = spark.createDataFrame([], COLS).schema
    P.write_new_events(T.read_stream(spark, src, schema), out, str(tmp_path / "c"))
    assert P.read_new_events(spark, out).count() == 0 and not P.compact(spark, out, [P.DAY])
    day = dt.timedelta(days=1)
    files(spark, src, [[(1, at(1), "a", "x")], [(1, at(1) + day, "a", "x")]])
    for at_column, n in ((None, 1), ("ts", 2)):
        where = str(tmp_path / f"o{n}")
        P.write_new_events(T.read_stream(spark, src, schema, files_per_trigger=1), where, str(tmp_path / f"c{n}"), at=at_column)
        assert P.read_new_events(spark, where).count() == n
