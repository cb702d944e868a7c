"""Backups: whole, unfinished, damaged."""

import pytest

from memlattice.sources import backup


@pytest.fixture
def tables(spark):
    return {"a": spark.range(50).selectExpr("id", "cast(id as string) as name", "array(id) as held").repartition(3), "b": spark.createDataFrame([], "x int, y map<string,int>")}


def test_round_trip(spark, tables, tmp_path):
    path = str(tmp_path / "whole")
    backup.backup(tables, path)
    held = backup.restore(spark, path)
    assert {k: v.dtypes for k, v in held.items()} == {k: v.dtypes for k, v in tables.items()}
    assert sorted(held["a"].collect()) == sorted(tables["a"].collect()) and held["b"].count() == 0
    assert list(backup.restore(spark, path, ["b"])) == ["b"]
    with pytest.raises(KeyError, match="c"):
        backup.restore(spark, path, ["c"])
    with pytest.raises(FileExistsError):
        backup.backup(tables, path)


def test_a_killed_backup_is_none(spark, tables, tmp_path, monkeypatch):
    path = str(tmp_path / "killed")
    with monkeypatch.context() as patched:
        patched.setattr(backup, "_digests", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            backup.backup(tables, path)
    with pytest.raises(backup.Torn, match="not finished"):
        backup.restore(spark, path)
    with pytest.raises(backup.Torn):
        backup.restore(spark, str(tmp_path / "nowhere"))
    backup.backup(tables, path)  # the next one writes over what was left
    assert backup.restore(spark, path)["a"].count() == 50


def test_what_is_damaged_is_named(spark, tables, tmp_path):
    path = tmp_path / "damaged"
    backup.backup(tables, str(path))
    files = sorted((path / "a").glob("*.parquet"))
    raw = bytearray(files[0].read_bytes())
    raw[len(raw) // 2] ^= 1
    (path / "a" / f".{files[0].name}.crc").unlink()
    files[0].write_bytes(raw)
    files[1].unlink()
    (path / "a" / "new.parquet").write_bytes(b"x")
    found = {(r.table, r.file): r.fault for r in backup.faults(spark, str(path)).collect()}
    assert found == {("a", files[0].name): "changed", ("a", files[1].name): "missing", ("a", "new.parquet"): "unknown"}
    with pytest.raises(backup.Torn, match=f"a/{files[0].name} changed"):
        backup.restore(spark, str(path))
