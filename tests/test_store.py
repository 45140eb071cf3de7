import pytest

from kvspark.sources.store import KVTable, Options, destroy, repair


def open_(spark, path, **options):
    return KVTable(spark, str(path), Options(**options), key="string", value="string")


def test_life_of_a_store(spark, tmp_path):
    path = tmp_path / "db"
    with open_(spark, path) as db:
        db.put("Tampa", "green")
        s1 = db.put("London", "red")
        db.write_batch([("put", "New York", "blue"), ("delete", "London", None), ("put", "Tampa", "teal")])
        assert (db.get("Tampa"), db.get("London"), db.get("Paris")) == ("teal", None, None)
        assert (db.get("Tampa", s1), db.get("London", s1)) == ("green", "red")
        assert [r["uk"] for r in db.scan().collect()] == ["New York", "Tampa"]
        assert [r["uk"] for r in db.scan(descending=True).collect()] == ["Tampa", "New York"]
        before = db.last_seq
        db.write_batch([])
        assert db.last_seq == before == 5
        assert db.get_property("versions") == 5 and db.get_property("none") is None
        with pytest.raises(ValueError):
            open_(spark, path)  # in use
    with pytest.raises(ValueError):
        db.get("Tampa")
    with open_(spark, path) as db:  # recovered
        assert db.last_seq == 5 and db.get("New York") == "blue"
        held = db.snapshot()
        db.put("Tampa", "late")
        db.compact_range()
        assert (db.get("Tampa", held), db.get("Tampa")) == ("teal", "late")
        db.release(held)
        db.compact_range()
        assert db.get_property("versions") == 2
        assert len(db.collect_garbage()) > 4 and db.get("Tampa") == "late"
        assert [r["uk"] for r in db.range("O", "Z").collect()] == ["Tampa"]
    (path / "own.txt").write_text("mine")
    destroy(spark, str(path))
    assert [p.name for p in path.iterdir()] == ["own.txt"]


def test_failed_writes_are_not_seen(spark, tmp_path):
    with open_(spark, tmp_path / "db") as db:
        db.put("a", "1")
        with pytest.raises(ValueError):
            db.put("b", None)
        db._write(db.log())  # a folder that no manifest names
        assert db.log().count() == 1
        assert sum(n.startswith("data/") for n in db.collect_garbage()) == 1


def test_options(spark, tmp_path):
    with pytest.raises(ValueError):
        open_(spark, tmp_path / "none", create_if_missing=False)
    open_(spark, tmp_path / "db").close()
    with pytest.raises(ValueError):
        open_(spark, tmp_path / "db", error_if_exists=True)
    with pytest.raises(ValueError):
        open_(spark, tmp_path / "db", comparator="reverse")
    (tmp_path / "file").write_text("")
    with pytest.raises(ValueError):
        open_(spark, tmp_path / "file")
    with pytest.raises(NotImplementedError):
        repair(spark, str(tmp_path / "db"))
