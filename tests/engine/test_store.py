import threading

import pytest

from slatecast.operators import markers as m
from slatecast.sources.store import Conflict, MarkerStore

ROWS = [(t, float(f), "Green" if f % 2 else "Blue", "n", f"note {f}", 1.0, f"c{f % 5}") for t in ("a", "b/é", "c") for f in range(20)]


@pytest.fixture
def store(spark, tmp_path):
    made = MarkerStore(spark, str(tmp_path / "table"))
    made.change(lambda none: none.unionByName(spark.createDataFrame(ROWS, MarkerStore.SCHEMA)), ["a", "b/é", "c"])
    return made


def listed(store, timelines=None):
    return sorted(map(tuple, store.read(timelines).collect()))


def test_changes_are_kept(spark, store):
    assert listed(store) == sorted(ROWS) and listed(store, ["b/é"]) == sorted(r for r in ROWS if r[0] == "b/é")
    before = store.version()
    store.clear_range(5, 9, ["a"])
    store.delete_frame(3, ["a"])
    store.delete_custom_data("c2", ["a"])
    store.delete_colour("green", ["b/é"])
    again = MarkerStore(spark, str(store.path))
    want = [r for r in ROWS if (r[0] == "a" and not 5 <= r[1] <= 9 and r[1] not in (3, 2)) or (r[0] == "b/é" and r[2] != "Green") or r[0] == "c"]
    assert listed(again) == sorted(want) and again.version().number == 5
    # what was open before reads on, and unchanged timelines keep their files
    assert sorted(map(tuple, store.read(version=before).collect())) == sorted(ROWS)
    assert again.version().folders["c"] == before.folders["c"]


def test_added_and_refused(spark, store):
    new = spark.createDataFrame([("a", 5.0, "RED", "x", "", 1.0, ""), ("a", 99.0, "red", "y", "", 1.0, "")], MarkerStore.SCHEMA)
    assert [r["name"] for r in store.add(new, ["a"]).collect()] == ["x"]
    assert [(r["frame_id"], r["color"]) for r in m.by_colour(store.read(), "Red").collect()] == [(99.0, "Red")]


def test_empty_timelines_and_tables(spark, store, tmp_path):
    store.delete_colour("All", ["a", "c"])
    assert {r[0] for r in listed(store)} == {"b/é"} and set(store.version().folders) == {"b/é"}
    assert MarkerStore(spark, str(tmp_path / "none")).read().count() == 0
    with pytest.raises(ValueError, match="other timelines"):
        store.change(lambda old: spark.createDataFrame(ROWS, MarkerStore.SCHEMA), ["a"])


def test_two_writers(spark, store):
    """Of two that change one timeline the second fails; who changes another goes on."""

    def meanwhile(timeline):
        def make(old):
            MarkerStore(spark, str(store.path)).delete_frame(1, [timeline])
            return m.without_frame(old, 2)

        return make

    with pytest.raises(Conflict):
        store.change(meanwhile("a"), ["a"])
    store.change(meanwhile("c"), ["a"])
    frames = {t: {r[1] for r in listed(store, [t])} for t in ("a", "c")}
    assert {1.0, 2.0} & frames["a"] == set() and {1.0, 2.0} & frames["c"] == {2.0}


def test_many_writers_at_once(spark, store):
    threads = [threading.Thread(target=store.delete_frame, args=(k, [t])) for k, t in enumerate(("a", "b/é", "c"))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(listed(store)) == len(ROWS) - 3 and store.version().number == 4
    assert not list((store.path / "log").glob("*.half"))
