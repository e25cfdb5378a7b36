import glob
import os

import pytest

from fenwatch.operators import snapshots as S


def tables(spark, n, sources=("feed", "sheet")):
    advisories = spark.createDataFrame([(s, f"A{k}", f"v{n}") for s in sources for k in range(3)], "source string, advisory_id string, title string")
    return {"advisories": advisories, "kev": spark.createDataFrame([(f"CVE-{n}",)], "cve string")}


def read(spark, path, version=None):
    got = S.load_snapshot(spark, path, version)
    return {(r["source"], r["title"]) for r in got["advisories"].collect()}, {r["cve"] for r in got["kev"].collect()}


def test_snapshots_replace_sources_and_stay_readable(spark, tmp_path):
    path = str(tmp_path / "corpus")
    with pytest.raises(FileNotFoundError):
        S.load_snapshot(spark, path)
    assert S.save_snapshot(spark, tables(spark, 1), path) == 1
    assert S.save_snapshot(spark, tables(spark, 2, ("sheet", None, "a/b=c ü")), path) == 2
    assert read(spark, path) == ({("feed", "v1"), ("sheet", "v2"), (None, "v2"), ("a/b=c ü", "v2")}, {"CVE-2"})
    assert read(spark, path, 1) == ({("feed", "v1"), ("sheet", "v1")}, {"CVE-1"})
    assert S.load_snapshot(spark, path)["advisories"].columns == ["source", "advisory_id", "title"]
    with pytest.raises(ValueError, match="no table"):
        S.save_snapshot(spark, {"odd": spark.range(1)}, path)
    with pytest.raises(ValueError, match="other columns"):
        S.save_snapshot(spark, {"advisories": spark.createDataFrame([("x", 1)], "source string, n int")}, path)
    empty = spark.createDataFrame([], "cve string")
    assert S.save_snapshot(spark, {"kev": empty}, path) == 3 and S.load_snapshot(spark, path)["kev"].count() == 0


def test_a_writer_that_dies_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "corpus")
    S.save_snapshot(spark, tables(spark, 1), path)
    broken = tables(spark, 2) | {"kev": spark.sql("SELECT CAST(raise_error('killed') AS string) AS cve")}
    with pytest.raises(Exception, match="killed"):
        S.save_snapshot(spark, broken, path)  # advisories were written already
    assert S.versions(spark, path) == [1] and read(spark, path) == ({("feed", "v1"), ("sheet", "v1")}, {"CVE-1"})


def test_of_two_writers_the_second_is_refused(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "corpus")
    S.save_snapshot(spark, tables(spark, 1), path)
    S.save_snapshot(spark, tables(spark, 2), path, after=1)
    with pytest.raises(S.Conflict):
        S.save_snapshot(spark, tables(spark, 3), path, after=1)
    # both have looked at the versions before either has made one
    monkeypatch.setattr(S, "versions", lambda spark, path: [1])
    with pytest.raises(S.Conflict):
        S.save_snapshot(spark, tables(spark, 3), path)
    monkeypatch.undo()
    assert read(spark, path)[1] == {"CVE-2"}


@pytest.mark.parametrize("what", ["data", "gone", "manifest"])
def test_what_was_changed_is_refused(spark, tmp_path, what):
    path = str(tmp_path / "corpus")
    S.save_snapshot(spark, tables(spark, 1), path)
    S.save_snapshot(spark, tables(spark, 2, ("sheet",)), path)
    name = f"{path}/manifests/2.json" if what == "manifest" else glob.glob(f"{path}/objects/*/advisories/_of=s66656564/part-*")[0]
    if what == "gone":
        os.rename(name, f"{path}/elsewhere")
    else:
        with open(name, "r+b") as f:
            f.seek(20)
            byte = f.read(1)
            f.seek(20)
            f.write(bytes([byte[0] ^ 1]))
        crc = os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc")
        os.rename(crc, f"{path}/elsewhere-crc")  # the store's own check would notice too
    with pytest.raises(S.Damaged):
        S.load_snapshot(spark, path)
    if what == "manifest":
        assert read(spark, path, 1)[1] == {"CVE-1"}
