"""Commits under interleaved writers, differences by digests, copy-on-write buckets."""

import datetime

import pytest

from factloom.operators.snapshot import entity_changes, relationship_changes
from factloom.sources import keyed_table, store
from factloom.sources.files import create_once, names_in, read_json

ENTITY = "key string, entity_type string, name string, properties map<string,string>, meta map<string,string>"
REL = "rel_type string, source string, target string, properties map<string,string>"
AT = datetime.datetime(2026, 1, 1)


def entities(spark, names, **properties):
    return spark.createDataFrame([(n, "SERVICE", n, properties.get(n, {"k": "v"}), {}) for n in names], ENTITY)


def rels(spark, *pairs):
    return spark.createDataFrame([("CALLS", a, b, {}) for a, b in pairs], REL)


@pytest.mark.parametrize("same", [True, False])
def test_interleaved_writers(spark, tmp_path, monkeypatch, same):
    """While one writer is between its rows and its header another one stores the revision: one set of rows is there, whole, and the first hears of it."""
    ours, theirs = entities(spark, "ab"), entities(spark, "ab" if same else "xyz")
    s = store.SnapshotStore(spark, str(tmp_path))

    def late(session, path, value):
        monkeypatch.setattr(store, "create_once", create_once)
        assert store.SnapshotStore(spark, str(tmp_path)).save("r", "v", AT, theirs, rels(spark, "ab" if same else "xy"))
        return create_once(session, path, value)

    monkeypatch.setattr(store, "create_once", late)
    if same:
        assert s.save("r", "v", AT, ours, rels(spark, "ab")) is False
    else:
        with pytest.raises(store.SnapshotConflict):
            s.save("r", "v", AT, ours, rels(spark, "ab"))
    found, links = s.load("r", "v")
    assert sorted(r["key"] for r in found.collect()) == list("ab" if same else "xyz") and links.count() == 1
    assert len(names_in(spark, f"{tmp_path}/data")) == 1


def test_header_of_a_writer_that_is_not_done(spark, tmp_path, monkeypatch):
    s = store.SnapshotStore(spark, str(tmp_path))
    monkeypatch.setattr(store, "TRIES", 2)
    path = s._path("r", "v")
    assert create_once(spark, path, {}) and not create_once(spark, path, {"a": 1})
    (tmp_path / path.removeprefix(f"{tmp_path}/")).write_text('{"repo')
    (tmp_path / path.removeprefix(f"{tmp_path}/")).with_name("." + path.rpartition("/")[2] + ".crc").unlink(missing_ok=True)
    assert read_json(spark, path) is None
    with pytest.raises(TimeoutError):
        s.save("r", "v", AT, entities(spark, "a"), rels(spark))
    with pytest.raises(KeyError):
        s.load("r", "v")
    assert s.revisions("nothing").count() == 0


def test_difference_reads_only_parts_that_differ(spark, tmp_path):
    names = [f"s{i}" for i in range(400)]
    before, after = entities(spark, names), entities(spark, [n for n in names if n != "s7"] + ["new"], s9={"k": "w"})
    links, more = rels(spark, *zip(names, names[1:], strict=False)), rels(spark, *zip(names, names[2:], strict=False))
    s = store.SnapshotStore(spark, str(tmp_path))
    assert s.save("r", "a", AT, before, links) and s.save("r", "b", AT, after, links) and s.save("r", "c", AT, after, more)
    parts = s.different_parts("r", "a", "b")
    assert 1 <= len(parts["entities"]) <= 3 and parts["relationships"] == []
    read = s._rows(s.header("r", "a"), "entities", parts["entities"])
    assert len({f.split("part=")[1].split("/")[0] for f in read.inputFiles()}) <= 3 and read.count() < 40
    told = lambda d: sorted(map(tuple, d.collect()), key=repr)
    whole = lambda x, y, p, q: told(entity_changes(x, y).unionByName(relationship_changes(p, q, x, y)))
    assert told(s.changes("r", "a", "b")) == whole(before, after, links, links)
    assert told(s.changes("r", "a", "c")) == whole(before, after, links, more)
    assert s.different_parts("r", "b", "b") == {"entities": [], "relationships": []} and s.changes("r", "b", "b").count() == 0


def table(spark, tmp_path, buckets=16):
    return keyed_table.KeyedTable(spark, str(tmp_path / "t"), "label string, id string, v string", ["label", "id"], buckets)


def batch(spark, *rows):
    return spark.createDataFrame([("N", i, v, o) for i, v, o in rows], "label string, id string, v string, ord long")


def test_upsert_writes_the_buckets_it_touches(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == 0 and t.upsert(batch(spark)) == 0
    first = batch(spark, *((f"n{i}", str(i), i) for i in range(200)))
    assert t.upsert(first) == 1 == t.upsert(first)
    old = set(t.read().inputFiles())
    assert t.upsert(batch(spark, ("n3", "new", 1), ("n3", "newer", 2), ("other", None, 1))) == 2
    new = set(t.read().inputFiles())
    assert 1 <= len(old - new) <= 2 and len(old & new) >= 14
    assert t.upsert(batch(spark, ("n3", "newer", 9))) == 2 and set(t.read().inputFiles()) == new
    want = {f"n{i}": str(i) for i in range(200)} | {"n3": "newer", "other": None}
    assert {r["id"]: r["v"] for r in t.read().collect()} == want and t.read(1).count() == 200
    t.vacuum(1)
    assert {r["id"]: r["v"] for r in table(spark, tmp_path, 99).read().collect()} == want and table(spark, tmp_path, 99).buckets == 16


def test_upserts_that_overtake_each_other(spark, tmp_path, monkeypatch):
    """A second writer commits between the first one's read and its commit: the first starts over, and no row of either is lost."""
    t, other = table(spark, tmp_path, 2), table(spark, tmp_path, 2)
    t.upsert(batch(spark, ("a", "1", 1), ("b", "1", 1)))

    def late(session, path, value):
        monkeypatch.setattr(keyed_table, "create_once", create_once)
        other.upsert(batch(spark, ("a", "theirs", 1), ("c", "theirs", 1)))
        return create_once(session, path, value)

    monkeypatch.setattr(keyed_table, "create_once", late)
    assert t.upsert(batch(spark, ("b", "ours", 1), ("d", "ours", 1))) == 3
    assert {r["id"]: r["v"] for r in t.read().collect()} == {"a": "theirs", "b": "ours", "c": "theirs", "d": "ours"}
    assert len(names_in(spark, f"{tmp_path}/t/data")) == 3


def test_edges_without_properties(spark, tmp_path):
    t = keyed_table.KeyedTable(spark, str(tmp_path / "e"), "src string, dst string", ["src", "dst"], 4)
    one = spark.createDataFrame([("a", "b", 1), ("a", "b", 2), (None, "c", 1)], "src string, dst string, ord long")
    assert t.upsert(one) == 1 == t.upsert(one) and t.read().count() == 2
