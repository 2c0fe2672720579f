"""The state table against a dict: merges, repeated batches, and writers that die between a write and the swap."""

import random

import pytest

from radiolake.streaming.state_table import KEPT, StateTable


def batch_of(spark, rng, n):
    return spark.createDataFrame([(k, f"v{n}", {"m": n}) for k in rng.sample(range(30), rng.randrange(1, 12))], "k long, v string, m map<string,long>").coalesce(1)


def as_dict(table):
    rows = table.read().collect()
    assert len({r["k"] for r in rows}) == len(rows)
    return {r["k"]: (r["v"], r["m"]["m"]) for r in rows}


def test_state_is_the_newest_of_each_key(spark, tmp_path):
    rng, expected, table = random.Random(1), {}, StateTable(spark, str(tmp_path), "k", fan=3)
    with pytest.raises(ValueError, match="no state"):
        table.read()
    for n in range(14):
        changed = batch_of(spark, rng, n)
        expected |= {r["k"]: (r["v"], r["m"]["m"]) for r in changed.collect()}
        table.commit(changed, n)
        if n % 4 == 1:
            table.commit(batch_of(spark, rng, 99), n)  # it runs again: nothing changes
    assert as_dict(table) == expected
    manifest = table.manifest()
    levels = [at for _, at in manifest["runs"]]
    assert manifest["batch"] == 13 and max(levels) == 2 and all(levels.count(at) < 3 for at in levels) and levels == sorted(levels, reverse=True)
    # of the history the live keys are left, once a run
    assert sum(spark.read.parquet(f"{tmp_path}/runs/{r}").count() for r, _ in manifest["runs"]) <= 30 * len(levels)
    assert len(table.manifests()) == KEPT


@pytest.mark.parametrize("dies", ["before the swap", "in the swap", "after the swap"])
def test_writers_that_die(spark, tmp_path, monkeypatch, dies):
    rng, expected, table = random.Random(2), {}, StateTable(spark, str(tmp_path), "k", fan=2)
    for n in range(6):
        changed = batch_of(spark, rng, n)
        before = dict(expected)
        expected |= {r["k"]: (r["v"], r["m"]["m"]) for r in changed.collect()}
        if n in (1, 3, 4):
            with monkeypatch.context() as m, pytest.raises(OSError):
                swap, files = table.swap, table.files

                class Dying:
                    def __getattr__(self, name):
                        if name == "rename":
                            raise OSError
                        return getattr(files, name)

                def die(manifest, swap=swap):
                    if dies == "after the swap":
                        swap(manifest)
                    raise OSError

                m.setattr(table, *(("files", Dying()) if dies == "in the swap" else ("swap", die)))
                table.commit(changed, n)
            assert as_dict(StateTable(spark, str(tmp_path), "k")) == (expected if dies == "after the swap" else before)
        StateTable(spark, str(tmp_path), "k", fan=2).commit(changed, n)  # the stream starts again
        assert as_dict(table) == expected
    used = {r for n in table.manifests() for r, _ in table.manifest(n)["runs"]}
    assert set(table.names("runs")) == used


def test_second_writer_is_refused(spark, tmp_path, monkeypatch):
    rng, table = random.Random(3), StateTable(spark, str(tmp_path), "k")
    table.commit(batch_of(spark, rng, 0), 0)
    stale = table.manifests()
    table.commit(batch_of(spark, rng, 1), 1)
    monkeypatch.setattr(table, "manifests", lambda: stale)
    with pytest.raises(RuntimeError, match="another stream"):
        table.swap({"batch": 1, "runs": []})
