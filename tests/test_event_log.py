"""The event log: pieces of files against plain lines, a stream that stops in mid-file and goes on, bounds, broken lines."""

import json
import random

import pytest

from plainspoke.sources import event_log


def line(n, pad=0):
    return json.dumps({"session_id": f"s{n % 3}", "event_name": "view", "event_json": {"n": n, "pad": "é" * pad}}, ensure_ascii=False)


def lines_of(log, start, end):
    return [(f, at, x) for p in log.pieces(start, end) for b in log.rows(p) for f, at, x in zip(*(c.to_pylist() for c in b.columns), strict=True)]


@pytest.mark.parametrize("seed", range(6))
def test_pieces_hold_each_line_once(tmp_path, seed):
    r = random.Random(seed)
    want = []
    for name in ("a.json", "b.json", "c.json"):
        body = b""
        for _ in range(r.randrange(0, 30)):
            x = "x" * r.randrange(0, 40)
            if x:
                want.append((name, len(body), x))
            body += x.encode() + b"\n"
        (tmp_path / name).write_bytes(body)
    (tmp_path / "_SUCCESS").write_text("not a line\n")
    log = event_log._Log({"path": str(tmp_path), "partitionBytes": str(r.randrange(1, 90)), "maxBytes": str(r.randrange(1, 200))})
    at, got = {"file": "", "at": 0}, []
    while (end := log.latest(at)) != at:
        got += lines_of(log, at, end)
        at = end
    assert got == want
    assert lines_of(log, {"file": "", "at": 0}, log.latest(None)) == want


def test_long_lines_and_no_last_line_end(tmp_path, monkeypatch):
    monkeypatch.setattr(event_log, "_BLOCK", 16)
    (tmp_path / "a").write_bytes(b"y" * 100 + b"\nshort\n" + b"z" * 50)  # closed by the next file: its last line counts
    (tmp_path / "b").write_bytes(b"one\nhalf of a li")
    log = event_log._Log({"path": str(tmp_path), "partitionBytes": "7"})
    end = log.latest(None)
    assert end == {"file": "b", "at": 4}
    assert [x for _, _, x in lines_of(log, {"file": "", "at": 0}, end)] == ["y" * 100, "short", "z" * 50, "one"]


def test_empty_folder(tmp_path):
    log = event_log._Log({"path": str(tmp_path / "none")})
    assert log.latest(None) == {"file": "", "at": 0} and log.pieces({"file": "", "at": 0}, log.latest(None)) == []


def run(spark, folder, out, **options):
    q = event_log.read_events(spark, str(folder), **options).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").start()
    q.processAllAvailable()
    n = len([p for p in q.recentProgress if p.numInputRows])
    q.stop()
    return n


@pytest.mark.parametrize("noted", [True, False])
def test_restart_in_mid_file_gives_each_event_once(spark, tmp_path, noted):
    log, out = tmp_path / "log", tmp_path / "out"
    log.mkdir()
    first = log / "0001.json"
    first.write_text("".join(line(n) + "\n" for n in range(40)) + line(40)[:20])
    options = {"maxBytes": 700, "partitionBytes": 300} | ({"position": f"{tmp_path}/position"} if noted else {})
    assert run(spark, log, out, **options) == (5 if noted else 1)
    with first.open("a") as f:
        f.write(line(40)[20:] + "\n" + line(41, 30) + "\n")
    (log / "0002.json").write_text(line(42) + "\nno object\n\n[1]\n" + line(43) + "\n")
    run(spark, log, out, **options)
    run(spark, log, out, **options)
    rows = spark.read.parquet(f"{out}/rows").collect()
    assert sorted(json.loads(r.event_json)["n"] for r in rows if not r.broken) == list(range(44))
    assert sum(r.broken for r in rows) == 2 and len({(r.file, r.at) for r in rows}) == len(rows)
    batch = event_log.read_events(spark, str(log), stream=False, partitionBytes=100)
    assert sorted(batch.select("file", "at", "event_json").collect()) == sorted((r.file, r.at, r.event_json) for r in rows)


def test_lost_positions_fail_and_half_written_ones_do_not_count(tmp_path):
    (tmp_path / "a").write_text("1\n2\n3\n")
    log = event_log._Log({"path": str(tmp_path), "maxBytes": "2", "position": f"{tmp_path}/position"})
    reader = event_log._StreamReader(log)
    assert [reader.latestOffset()["at"] for _ in range(2)] == [2, 4]
    (tmp_path / "position" / f"at-{9:020d}").write_text('{"file": "a", "at"')
    assert log.noted() == {"file": "a", "at": 4}
    with pytest.raises(ValueError, match="older"):
        reader.partitions({"file": "a", "at": 6}, {"file": "a", "at": 4})
