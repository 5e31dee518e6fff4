"""The tail of growing files, and the watch over heartbeats, across restarts."""

import random
from datetime import datetime, timedelta

import pytest

from kestrelframe.streaming import tail, watch
from kestrelframe.streaming.progress import follow

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_tail_reads_each_line_once_when_it_is_whole(spark, tmp_path, chunk):
    logs, out, ck = (tmp_path / n for n in ("logs", "out", "ck"))
    (logs / "a").mkdir(parents=True)
    spark.dataSource.register(tail.LineTail)

    def run():
        rows = spark.readStream.format("line_tail").option("path", str(logs)).option("suffix", ".jsonl").option("chunkBytes", chunk).load()
        follow(rows, str(ck), str(out), once=True).awaitTermination()
        return sorted((r.file, r.at, r.line) for r in spark.read.schema(tail.SCHEMA).parquet(str(out)).collect())

    one, two = logs / "a" / "events.jsonl", logs / "b.jsonl"
    one.write_bytes(b"first\n\nthird line\nhalf")
    (logs / "_hidden.jsonl").write_bytes(b"no\n")
    (logs / "other.txt").write_bytes(b"no\n")
    assert run() == [("a/events.jsonl", 0, "first"), ("a/events.jsonl", 6, ""), ("a/events.jsonl", 7, "third line")]
    with one.open("ab") as f:
        f.write(b" and whole\r\nnot yet")
    two.write_bytes("é 猫\nbroken \xff".encode("latin-1", "ignore") + b"x" * 200 + b"\n")
    got = run()
    assert len(got) == 6 and ("a/events.jsonl", 18, "half and whole") in got and not any("not yet" in line for *_, line in got)
    assert run() == got  # nothing new, nothing twice
    with one.open("ab") as f:
        f.write(b"\n")
    assert [line for *_, line in run() if "not yet" in line] == ["not yet"]


def expected(beats, stale, lateness):
    """By sorting: the first gap or terminal row of each job; jobs whose last beat the watermark has passed are stale."""
    by = {}
    for job, at, status in beats:
        by.setdefault(job, []).append((at, status))
    mark = max(at for _, at, _ in beats) - timedelta(seconds=lateness)
    out = set()
    for job, rows in by.items():
        last = None
        for at, status in sorted(rows):
            if last is not None and (at - last).total_seconds() > stale:
                out.add((job, "stale", last + timedelta(seconds=stale)))
                break
            if status in ("completed", "failed", "cancelled"):
                out.add((job, status, at))
                break
            last = at
        else:
            if last + timedelta(seconds=stale) < mark:
                out.add((job, "stale", last + timedelta(seconds=stale)))
    return out


def test_watch_equals_sorting_across_restarts(spark, tmp_path):
    rng = random.Random(4)
    beats = []
    for job in range(25):
        at = T0 + timedelta(seconds=rng.randint(0, 60))
        for _ in range(rng.randint(1, 40)):
            beats.append((f"j{job}", at, "running"))
            at += timedelta(seconds=rng.choice([3, 3, 3, 20, 60, 90, 95 if rng.random() < 0.3 else 3]))
        if rng.random() < 0.4:
            beats.append((f"j{job}", at, rng.choice(["completed", "failed"])))
            beats.append((f"j{job}", at + timedelta(seconds=200), "running"))  # an ended job stays so
    beats.sort(key=lambda r: r[1])
    watch.configure(spark)
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    cut = len(beats) // 3
    for part in (beats[:cut], beats[cut : 2 * cut], beats[2 * cut :]):
        rng.shuffle(part)
        spark.createDataFrame(part, "job_id string, ts timestamp, status string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("job_id string, ts timestamp, status string").parquet(src)
        follow(watch.watch(stream, 90.0, "10 seconds"), ck, out, once=True).awaitTermination()
    got = spark.read.schema(watch.SCHEMA).parquet(out).selectExpr("job_id", "event", "at").collect()
    assert len(got) == len({r.job_id for r in got})
    assert {(r.job_id, r.event, r.at) for r in got} == expected(beats, 90, 10)
