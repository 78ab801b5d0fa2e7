"""The stored keyed table against the policies on whole tables; what it leaves alone; redirects of any length."""

import hashlib
import random
from pathlib import Path

import pytest

from orrery.operators import latest
from orrery.sources.keyed_table import KeyedTable
from orrery.sources.readers import redirect_ends, resolved
from orrery.sources.sinks import remap_keys


def plain(frame):
    return sorted(map(tuple, frame.select(*sorted(frame.columns)).collect()), key=repr)


def digests(folder, manifest):
    return {f: hashlib.sha256((Path(folder) / f).read_bytes()).hexdigest() for held in manifest["files"].values() for f, _ in held}


@pytest.fixture
def table(spark, tmp_path):
    made = KeyedTable(spark, f"file://{tmp_path}/t")
    made.create(spark.range(1000).selectExpr("id", "concat('n', id) as name", "if(id % 3 = 0, null, id) as n"), ["id"])
    return made


def test_upsert_of_one_percent_leaves_all_other_buckets(spark, table, tmp_path):
    before = table.manifest()
    known = digests(f"{tmp_path}/t", before)
    new = spark.createDataFrame([(k, "new", k) for k in range(990, 1000)] + [(2000, "more", 1), (None, "no key", 1)], "id long, name string, n long")
    want = plain(latest.upsert(table.read(), new, ["id"]).drop("change"))
    assert table.upsert(new) == {"read": 11, "inserted": 1, "updated": 10}
    after = table.manifest()
    touched = {b for b in after["files"] if after["files"][b] != before["files"].get(b)}
    assert 0 < len(touched) <= 11 and all(digests(f"{tmp_path}/t", after)[f] == known[f] for b, held in after["files"].items() if b not in touched for f, _ in held)
    assert plain(table.read()) == want
    told = {r.id: r.change for r in table.changes(since=1).where("change <> 'kept'").collect()}
    assert told == {k: "updated" for k in range(990, 1000)} | {2000: "inserted"}
    assert {r.id for r in table.changed(since=1).collect()} == set(told)
    table.upsert(new)  # a replay
    assert plain(table.read()) == want
    assert plain(table.lookup(new)) == [r for r in want if r[0] in told]


def test_policies_equal_those_on_whole_tables(spark, table):
    rng = random.Random(5)
    rows = [(rng.randrange(1200), rng.choice(["x", None]), rng.choice([7, None]), s) for s in range(150)]
    new = spark.createDataFrame(rows, "id long, name string, n long, s int")
    for policy in ({"keep_first": ("name",)}, {"fill_only": ("n", "name")}, {}):
        whole = table.read()
        one = latest.latest_per_key(new, ["id"], ["s"], ["name", "n"])
        want = plain(latest.upsert(whole, one, ["id"], **policy).drop("change"))
        counts = table.upsert(new, order=["s"], **policy)
        assert plain(table.read()) == want and counts["read"] == len({r[0] for r in rows}) == counts["inserted"] + counts["updated"]
    want = plain(latest.replace_keys(table.read(), new.drop("s"), ["id"]))
    table.replace(new.drop("s"))
    assert plain(table.read()) == want
    write = table.manifest()["write"]
    table.insert_new(new.drop("s"))  # nothing is new
    assert table.manifest()["write"] == write
    table.insert_new(spark.createDataFrame([(1, "old", 1), (5000, "new", 1), (5000, "new", 1)], "id long, name string, n long"))
    assert table.read().where("id = 5000").count() == 1 and table.read().where("id = 1 and name = 'old'").count() == 0
    gone = spark.createDataFrame([(5000,), (2,)], "id long")
    want = plain(table.read().where("id not in (5000, 2)"))
    table.delete(gone)
    assert plain(table.read()) == want


def test_a_write_that_fails_changes_nothing(spark, table, monkeypatch):
    before, new = plain(table.read()), spark.createDataFrame([(1, "x", 1)], "id long, name string, n long")

    def fail(content):
        raise OSError("the power went")

    monkeypatch.setattr(table.pointer, "replace", fail)
    with pytest.raises(OSError):
        table.upsert(new)
    monkeypatch.undo()
    assert plain(table.read()) == before and table.manifest()["write"] == 1
    assert len(table.sweep()) == 1 and plain(table.read()) == before


def test_readers_of_the_last_state_may_finish(spark, table):
    reading = table.read()
    table.upsert(spark.createDataFrame([(k, "x", 1) for k in range(500)], "id long, name string, n long"))
    assert reading.where("name = 'x'").count() == 0 and reading.count() == 1000
    for _ in range(2):
        table.upsert(spark.createDataFrame([(1, "y", 1)], "id long, name string, n long"))
    table.sweep()
    assert table.read().count() == 1000 and table.sweep() == []


def test_odd_tables(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/o")
    with pytest.raises(LookupError):
        table.read()
    with pytest.raises(ValueError):
        table.create(spark.createDataFrame([(1, 2)], "id long, _first long"), ["id"])
    table.create(spark.createDataFrame([], "a long, b string, v int"), ["a", "b"], buckets=4)
    assert table.read().collect() == [] and table.upsert(spark.createDataFrame([], "a long, b string, v int")) == {"read": 0, "inserted": 0, "updated": 0}
    assert table.upsert(spark.createDataFrame([(1, None, 1), (1, "x", 2), (1, "x", 2)], "a long, b string, v int")) == {"read": 1, "inserted": 1, "updated": 0}
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([(1, "x")], "a long, b string"))
    assert plain(table.read()) == [(1, "x", 2)]


# ---------------------------------------------------------------- redirects
def ends(links):
    """Followed one by one."""
    out = {}
    for start in links:
        at, seen = start, set()
        while at in links and at not in seen:
            seen.add(at)
            at = links[at]
        out[start] = (None, True) if at in links else (at, False)
    return out


def test_redirects_of_any_length(spark):
    links = {}
    for length in range(1, 41):
        links |= {1000 * length + k: 1000 * length + k + 1 for k in range(length)}
    links |= {k: k + 1 for k in range(100, 107)} | {107: 103} | {50: 51, 51: 50} | {60: 100, 61: 62}
    frame = spark.createDataFrame(list(links.items()), "_from long, _to long")
    got = {r["_from"]: (r["end"], r["looped"]) for r in redirect_ends(frame).collect()}
    assert got == ends(links) and got[107] == (None, True) and got[40_000] == (40_040, False) and got[60] == (None, True)


def test_redirects_at_random(spark):
    rng = random.Random(3)
    for n in (5, 60):
        links = {k: t for k in range(n) if (t := rng.randrange(n + 3)) != k and rng.random() < 0.8}
        got = {r["_from"]: (r["end"], r["looped"]) for r in redirect_ends(spark.createDataFrame(list(links.items()), "_from long, _to long")).collect()}
        assert got == ends(links)


def test_resolved_works_and_remapped_keys(spark):
    works = spark.createDataFrame([(k, k + 1) for k in range(1, 6)] + [(6, None), (7, 0), (8, 8), (9, 10), (10, 9), (None, 3)], "work long, redirect long")
    got = {r.work: (r.canonical, r.looped) for r in resolved(works, "work", "redirect").collect()}
    assert got == {k: (6, False) for k in range(1, 7)} | {7: (7, False), 8: (8, False), 9: (9, True), 10: (10, True), None: (None, False)}
    assert resolved(works.limit(0), "work", "redirect").collect() == []
    mapping = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5)], "old long, new long")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (4, "c"), (5, "d")], "k long, v string")
    assert plain(remap_keys(rows, mapping, "k")) == [(2, "a"), (3, "b"), (4, "c"), (6, "d")]
    assert plain(remap_keys(rows, mapping, "k", chained=True)) == [(3, "a"), (3, "b"), (4, "c"), (5, "d")]
