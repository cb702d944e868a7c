"""Byte-offset reading of growing files."""

import json
import random

import pytest

from memlattice.sources import appended


def rows(frame):
    return sorted((r.source.rsplit("/", 1)[1], r.offset, r.n_bytes, r.line) for r in frame.collect())


def expected(path):
    out = []
    for file in sorted(path.iterdir()):
        at = 0
        *whole, _ = file.read_bytes().split(b"\n")
        for line in whole:
            out.append((file.name, at, len(line), line.decode("utf-8", "replace")))
            at += len(line) + 1
    return sorted(out)


@pytest.fixture
def log(tmp_path):
    draw = random.Random(1)
    folder = tmp_path / "log"
    folder.mkdir()
    for name, n in (("a", 40), ("b", 1), ("c", 0)):
        (folder / name).write_bytes(b"".join((json.dumps({"k": k, "t": "é" * draw.randint(0, 30)}, ensure_ascii=False).encode() if k % 7 else b"") + b"\n" for k in range(n)))
    with (folder / "b").open("ab") as file:
        file.write(b"\xff broken\n" + b"x" * 5000 + b"\n" + b'{"torn": ')
    return folder


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_ranges_of_any_size_give_every_line_once(log, size, monkeypatch):
    monkeypatch.setattr(appended, "BLOCK", 11)
    found = [(p.path.rsplit("/", 1)[1], at, len(raw), raw.decode("utf-8", "replace")) for p in appended.ranges(str(log), {}, appended.state(str(log)), size) for at, raw in appended.lines(str(log), p)]
    assert sorted(found) == expected(log)


def test_batch_increment_and_tail(spark, log):
    assert rows(appended.read(spark, str(log), rangeBytes=100)) == expected(log)
    before, seen = appended.increment(spark, str(log), {})
    old = expected(log)
    assert rows(before) == old
    with (log / "b").open("ab") as file:
        file.write(b'1}\n{"new": 1}\n{"torn')
    (log / "d").write_bytes(b"{}\n")
    more, then = appended.increment(spark, str(log), seen, rangeBytes=50)
    new = [r for r in expected(log) if r not in old]
    assert len(new) == 3 and rows(more) == new
    nothing, same = appended.increment(spark, str(log), then)
    assert rows(nothing) == [] and same == then
    last = rows(appended.tail(spark, str(log), 200, 3, rangeBytes=30))
    for name in "abd":
        own = [r for r in expected(log) if r[0] == name]
        size = own[-1][1] + own[-1][2] + 1
        assert [r for r in last if r[0] == name] == [r for r in own if r[1] >= size - 200][-3:]
    assert appended.parsed(appended.read(spark, str(log)), "k int").where("record.k = 3").count() == 1


def test_truncation_and_rewriting_are_seen(log):
    seen = appended.state(str(log))
    cut = lambda **o: appended.ranges(str(log), seen, appended.state(str(log)), **o)
    assert cut() == []
    whole = (log / "a").read_bytes()
    (log / "a").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(appended.Rewritten, match="a: the first"):
        cut()
    assert {p.start for p in cut(restart=True)} == {0}
    (log / "a").write_bytes(b"#" + whole[1:] + b"more\n")
    with pytest.raises(appended.Rewritten):
        cut()
    (log / "a").unlink()
    with pytest.raises(appended.Rewritten, match="no longer there"):
        cut()
    # A change in the middle of a large file shows in whole digests only.
    big = b"".join(b"%06d\n" % k for k in range(3000))
    (log / "a").write_bytes(big)
    edges, every = appended.state(str(log)), appended.state(str(log), whole=True)
    (log / "a").write_bytes(big.replace(b"001500", b"x01500"))
    assert appended.ranges(str(log), edges, appended.state(str(log))) == []
    with pytest.raises(appended.Rewritten):
        appended.ranges(str(log), every, appended.state(str(log), whole=True), whole=True)


def test_stream_equals_batch_over_restarts(spark, log, tmp_path):
    def run():
        stream = appended.read_stream(spark, str(log), rangeBytes=128).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
        started = stream.start(str(tmp_path / "out"))
        try:
            started.processAllAvailable()
        finally:
            started.stop()

    run()
    with (log / "b").open("ab") as file:
        file.write(b"1}\nlast\n")
    run()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == expected(log) == rows(appended.read(spark, str(log)))
    (log / "a").write_bytes(b"other\n")
    with pytest.raises(Exception, match="are not those that were read"):
        run()


def test_missing_path(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        appended.read(spark, str(tmp_path / "nowhere")).collect()
    (tmp_path / "empty").mkdir()
    assert appended.read(spark, str(tmp_path / "empty")).count() == 0
