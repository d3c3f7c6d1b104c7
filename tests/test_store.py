"""Fingerprints and stores: what changes a root, and what is refused."""

import hashlib

import pytest

from orbitlake.sources import store

SCHEMA = "pos long, id string, vector array<double>"


def rows_of(ids, dim=3):
    return [(i, x, [float(i + j) for j in range(dim)]) for i, x in enumerate(ids)]


def root(spark, ids):
    return tuple(store.fingerprint(spark.createDataFrame(list(enumerate(ids)), "pos long, id string").repartition(5)).first())


def by_hand(ids, fanout, levels):
    now = [f"{len(x.encode())}:{x}" for x in ids]
    for _ in range(levels):
        now = [hashlib.sha256("".join(now[i : i + fanout]).encode()).hexdigest() for i in range(0, len(now), fanout)]
    return len(ids), hashlib.sha256(f"{len(ids)}:{now[0] if now else ''}".encode()).hexdigest()


def test_every_change_changes_the_root(spark, monkeypatch):
    monkeypatch.setattr(store, "FANOUT", 4)
    ids = [f"id_{i}" for i in range(70)]
    first = root(spark, ids)
    assert first == by_hand(ids, 4, 4)
    others = [ids[:-1], ids[1:], ids[:10] + ["x"] + ids[11:], ids[:3] + [ids[4], ids[3]] + ids[5:], ids[:30] + ids[31:60] + [ids[30]] + ids[60:], [*ids, "id_70"], [ids[0] + ids[1][:1], ids[1][1:], *ids[2:]]]
    roots = {root(spark, o) for o in others}
    assert len(roots) == len(others) and first not in roots
    assert root(spark, []) == by_hand([], 4, 4)


def test_a_stale_store_is_refused(spark, tmp_path):
    path, ids = str(tmp_path / "s"), ["a", "b", "c", "d"]
    frame = lambda x: spark.createDataFrame(rows_of(x), SCHEMA)
    named = lambda x: frame(x).select("pos", "id")
    about = {"model": "m", "dataset": "d", "split": "test"}
    assert store.store_state(spark, path, **about) == "absent"
    store.write_store(frame(ids), path, **about)
    assert store.store_state(spark, path, **about, count=4, dim=3, ids=named(ids)) is None
    assert store.read_store(spark, path, **about, ids=named(ids)).count() == 4
    cases = [({"model": "n"}, "model"), ({"dataset": "e"}, "dataset"), ({"split": "val"}, "split"), ({"count": 5}, "count"), ({"dim": 4}, "dim"), ({"ids": named(["b", "a", "c", "d"])}, "root"), ({"ids": named(["a", "b", "x", "d"])}, "root"), ({"ids": named(ids[:3])}, "count")]
    for change, field in cases:
        assert store.store_state(spark, path, **(about | change)) == f"{field} mismatch"
        with pytest.raises(ValueError, match=field):
            store.read_store(spark, path, **(about | change))


def test_vectors_that_changed_on_disk_are_found(spark, tmp_path):
    path, about = str(tmp_path / "s"), {"model": "m", "dataset": "d", "split": "test"}
    store.write_store(spark.createDataFrame(rows_of("abc"), SCHEMA), path, **about)
    spark.createDataFrame(rows_of("ab"), SCHEMA).write.mode("overwrite").parquet(f"{path}/vectors")
    assert store.store_state(spark, path, **about) == "stored count mismatch"
    with pytest.raises(ValueError, match="sizes"):
        store.write_store(spark.createDataFrame([*rows_of("ab"), (2, "c", [1.0])], SCHEMA), path, **about)
