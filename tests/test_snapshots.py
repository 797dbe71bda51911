from pathlib import Path

import pytest
from fakes import CountingEmbedder
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pairrank.operators import snapshots as sn
from pairrank.operators import store as st
from pairrank.runtime import materialise

SCHEMA = "entity_id string, model_id string, text_sha string, embedding array<double>, updated_at string, kind string"


def entries(spark, rows, day="2024-01-01"):
    return spark.createDataFrame([(i, "m", "", [float(v)], day, "job") for i, v in rows], SCHEMA).withColumn(
        "updated_at", F.col("updated_at").cast("timestamp"))


def content(df):
    return sorted((r.entity_id, r.embedding[0]) for r in df.collect())


def files(path):
    return {str(f) for f in Path(path, "data").rglob("*.parquet")}


def test_versions(spark, tmp_path):
    path = str(tmp_path / "store")
    assert content(sn.read_snapshot(spark, path)) == [] and sn.version(spark, path) is None
    assert sn.merge(spark, entries(spark, [(f"e{i}", i) for i in range(300)]), path, buckets=8) == 1
    old = sn.read_snapshot(spark, path)
    assert sn.merge(spark, entries(spark, [("e1", -1), ("x", 5)], "2024-01-02"), path) == 2
    new = {**{f"e{i}": float(i) for i in range(300)}, "e1": -1.0, "x": 5.0}
    assert content(sn.read_snapshot(spark, path)) == sorted(new.items())
    # Who reads the old version keeps its answer, opened before the merge or after.
    want = sorted((f"e{i}", float(i)) for i in range(300))
    assert content(old) == content(sn.read_snapshot(spark, path, 1)) == want
    # An older write doesn't replace a newer one; of equal ones the one merged last counts; nothing new, no version.
    sn.merge(spark, entries(spark, [("e1", 7)], "2023-01-01").unionByName(entries(spark, [("x", 8)], "2024-01-02")), path)
    assert dict(content(sn.read_snapshot(spark, path)))["e1"] == -1.0 and dict(content(sn.read_snapshot(spark, path)))["x"] == 8.0
    assert sn.merge(spark, entries(spark, []), path) == 3
    with pytest.raises(ValueError):
        sn.read_snapshot(spark, path, 9)


def test_a_small_update_writes_few_files(spark, tmp_path):
    path = str(tmp_path / "store")
    sn.merge(spark, entries(spark, [(f"e{i}", i) for i in range(2_000)]), path, buckets=100)
    before = files(path)
    assert len(before) == 100
    sn.merge(spark, entries(spark, [("e7", 0)], "2024-01-02"), path)
    assert len(files(path) - before) == 1 and before <= files(path)
    assert sn.read_snapshot(spark, path).count() == 2_000


def test_a_merge_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    sn.merge(spark, entries(spark, [("a", 1), ("b", 2)]), path, buckets=4)
    real = spark.createDataFrame
    with monkeypatch.context() as broken:
        # The files of the new write are there, the manifest is not.
        broken.setattr(type(spark), "createDataFrame", lambda self, data, schema=None: (_ for _ in ()).throw(RuntimeError("lost")) if "buckets int" in str(schema) else real(data, schema))
        with pytest.raises(RuntimeError):
            sn.merge(spark, materialise(entries(spark, [("a", 9)], "2024-01-02")), path)
    assert content(sn.read_snapshot(spark, path)) == [("a", 1.0), ("b", 2.0)]
    sn.merge(spark, entries(spark, [("a", 3)], "2024-01-02"), path)
    assert content(sn.read_snapshot(spark, path)) == [("a", 3.0), ("b", 2.0)]


def test_of_two_merges_at_once_one_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    sn.merge(spark, entries(spark, [("a", 1)]), path, buckets=4)
    stale = sn.version(spark, path)
    sn.merge(spark, entries(spark, [("a", 2)], "2024-01-02"), path)
    monkeypatch.setattr(sn, "version", lambda *_: stale)
    with pytest.raises(AnalysisException):
        sn.merge(spark, entries(spark, [("b", 3)]), path)
    monkeypatch.undo()
    assert content(sn.read_snapshot(spark, path)) == [("a", 2.0)]


def test_lookup_leaves_the_store_in_place(spark, tmp_path, plan):
    path = str(tmp_path / "store")
    known = spark.createDataFrame([(str(i), [float(i)]) for i in range(500)], "name string, embedding array<double>")
    sn.merge(spark, st.as_entries(known, "candidate", "name", "m"), path, buckets=4)
    asked = spark.createDataFrame([(str(i % 700) if i % 50 else None,) for i in range(2_000)], "name string")
    plainly = st.load_vectors(asked, sn.read_snapshot(spark, path), "candidate", "name", "m")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = st.with_key(asked, "candidate", "name", "m", None).withColumn("key", sn.key_of())
        text = plan(sn.stored_keys(rows, path, sn.version(spark, path)))
        # Below the join the keys that are asked for are shuffled, the store is not.
        asked_for, stored = text[text.index("SortMergeJoin") :].rsplit("+- Sort [key", 1)
        assert "Exchange hashpartitioning(key" in asked_for and "FileScan" not in asked_for
        assert "Bucketed: true" in stored and "Exchange hashpartitioning" not in stored and "Exchange Range" not in stored
        found = sn.load_from_snapshot(asked, path, "candidate", "name", "m")
        assert sorted(map(str, found.collect())) == sorted(map(str, plainly.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The same with the salted lookup of hot keys.
    salted = sn.load_from_snapshot(asked, path, "candidate", "name", "m", skew_from_rows=0)
    assert sorted(map(str, salted.collect())) == sorted(map(str, plainly.collect()))
    assert sn.load_from_snapshot(asked, str(tmp_path / "none"), "candidate", "name", "m").where("needs_embedding").count() == 2_000


class Dying(CountingEmbedder):
    """Stops working once so many texts are done, until a file says it may go on."""

    def __init__(self, log, healed, after):
        super().__init__(log)
        self.healed, self.after = str(healed), after

    def embed(self, texts):
        if not Path(self.healed).exists() and self.embedded() >= self.after:
            raise OSError("the model is gone")
        return super().embed(texts)


def people(spark, n):
    return spark.createDataFrame([(f"p{i}", "x" * (i % 9) + " y") for i in range(n)], "name string, text string")


def test_a_run_that_dies_goes_on_where_it_stopped(spark, tmp_path):
    path, healed = str(tmp_path / "store"), tmp_path / "healed"
    model = Dying(tmp_path / "log", healed, after=90)
    with pytest.raises(Exception, match="the model is gone"):
        sn.embed_with_snapshots(people(spark, 200), "candidate", "name", "text", model, path, buckets=4, range_keys=20, ranges_at_once=1)
    done = model.embedded()
    assert 90 <= done < 130 and sn.version(spark, path) is None
    healed.touch()
    # The second call has other rows: the open ranges come first, then what is new.
    found = sn.embed_with_snapshots(people(spark, 210), "candidate", "name", "text", model, path, buckets=4, range_keys=20, ranges_at_once=1)
    assert {r.name: r.embedding for r in found.collect()} == {f"p{i}": [i % 9 + 2.0, 1.0] for i in range(210)}
    published = len({str(f) for f in (tmp_path / "store/runs").rglob("found/*.parquet")})
    assert published >= 11
    # Only the range in which the model died is asked for again.
    assert 210 <= model.embedded() <= 210 + 30
    assert sn.version(spark, path).number == 2 and sn.read_snapshot(spark, path).count() == 210
    sn.embed_with_snapshots(people(spark, 210), "candidate", "name", "text", model, path).collect()
    assert model.embedded() <= 240 and sn.version(spark, path).number == 2


def test_edited_texts_blank_ids_and_repeats(spark, tmp_path):
    model, path = CountingEmbedder(tmp_path / "log"), str(tmp_path / "store")

    def run(rows):
        df = spark.createDataFrame(rows, "name string, text string")
        return sorted((r.name or "", r.text, r.embedding) for r in sn.embed_with_snapshots(df, "job", "name", "text", model, path, buckets=4).collect())

    assert run([("Ann", "a b"), ("Ann", "a b"), (" Ann", "a b"), ("Bo", "c")]) == [
        (" Ann", "a b", [3.0, 1.0]), ("Ann", "a b", [3.0, 1.0]), ("Ann", "a b", [3.0, 1.0]), ("Bo", "c", [1.0, 0.0])]
    assert model.embedded() == 2
    assert run([("Ann", "a b c"), ("Bo", "c"), (" ", "z")]) == [(" ", "z", [1.0, 0.0]), ("Ann", "a b c", [5.0, 2.0]), ("Bo", "c", [1.0, 0.0])]
    assert model.embedded() >= 4 and {r.entity_id for r in sn.read_snapshot(spark, path).collect()} == {"Ann", "Bo"}
