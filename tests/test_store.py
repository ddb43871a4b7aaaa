"""The contents store: only touched buckets are written, a crash changes nothing, no identity multiplies."""

import datetime
import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from gleaner.operators import contents as ct
from gleaner.sources import store as st
from gleaner.streaming import captures as cap

COLUMNS = "capture_id string, source_type string, source_url string, canonical_url string, title string, author string, markdown string, capture_mode string, capture_quality string, payload string, captured_at timestamp"


def batch(spark, rows, at=0):
    """Rows (capture id, url, text[, quality])."""
    moment = datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=at)
    full = [(i, "web", u, None, "T", None, x, "manual", q[0] if q else "good", json.dumps({"text": x}), moment) for i, u, x, *q in rows]
    return spark.createDataFrame(full, COLUMNS)


@pytest.fixture
def store():
    return tempfile.mkdtemp(prefix="gleaner-store-")


def fold(spark, store, rows, at, buckets=32):
    held = st.read_manifest(spark, store, buckets)
    return cap.merge_captures(batch(spark, rows, at), store, held, at)


def stored(spark, store):
    return sorted((r.capture_id, r.canonical_url, r.markdown, r.payload) for r in cap.read_contents(spark, store).collect())


def test_only_touched_buckets_are_rewritten(spark, store):
    first = fold(spark, store, [(f"capture-{i}", f"https://e.org/{i}", f"text {i}") for i in range(2_000)], 0)
    assert len(first.buckets["contents"]) == 32
    after = fold(spark, store, [("capture-3", "https://e.org/3", "new 3"), ("other-id-x", "https://e.org/4", "new 4"), ("capture-new", "https://e.org/new", "fresh")], 1)
    moved = {b for b, v in after.buckets["contents"].items() if v == 2}
    assert 1 <= len(moved) <= 3 and len(after.buckets["contents"]) == 32
    assert len({b for b, v in after.buckets["capture_ids"].items() if v == 2}) <= 3
    assert set(os.listdir(f"{store}/data/version=000000000002/contents")) - {"_SUCCESS", "._SUCCESS.crc"} == {f"bucket={b}" for b in moved}
    rows = {i: (u, x, p) for i, u, x, p in stored(spark, store)}
    assert len(rows) == 2_001 and rows["capture-3"][1] == "new 3" and rows["capture-4"][1:] == ("new 4", '{"text": "new 4"}') and rows["capture-5"][1] == "text 5"
    assert cap.read_opened(spark, store)[0].count() == 2_001


def test_a_content_that_changes_its_address_moves(spark, store):
    fold(spark, store, [("capture-1", "https://e.org/a", "one"), ("capture-2", "https://e.org/b", "two")], 0)
    fold(spark, store, [("capture-1", "https://e.org/moved", "one, moved")], 1)
    fold(spark, store, [("capture-1", "https://e.org/moved-again", "found by its id")], 2)
    fold(spark, store, [("someone-else", "https://e.org/moved-again", "found by its address")], 3)
    assert [(i, u, x) for i, u, x, _ in stored(spark, store)] == [
        ("capture-1", "https://e.org/moved-again", "found by its address"), ("capture-2", "https://e.org/b", "two"),
    ]


def test_a_crash_between_the_steps_changes_nothing(spark, store, monkeypatch):
    fold(spark, store, [("capture-1", "https://e.org/a", "one")], 0)
    before = stored(spark, store)
    rows = [("capture-1", "https://e.org/a", "two"), ("capture-2", "https://e.org/b", "new")]
    for step in ("write_buckets", "append", "commit"):
        real = getattr(cap, step)

        def dies(*args, step=step, real=real):
            if step != "commit":
                real(*args)
            raise OSError("lost")

        monkeypatch.setattr(cap, step, dies)
        with pytest.raises(OSError):
            fold(spark, store, rows, 1)
        monkeypatch.setattr(cap, step, real)
        assert stored(spark, store) == before and st.read_manifest(spark, store).version == 1
    fold(spark, store, rows, 1)
    assert [x for _, _, x, _ in stored(spark, store)] == ["two", "new"] and cap.read_opened(spark, store)[1].count() == 2


def test_two_writers_of_one_version(spark, store):
    held = st.read_manifest(spark, store, 8)
    cap.merge_captures(batch(spark, [("capture-1", "https://e.org/a", "one")]), store, held, 0)
    with pytest.raises(st.StoreConflict):
        st.commit(spark, store, held.after(0, {}))
    assert len(stored(spark, store)) == 1


def test_many_merges_equal_one_upsert_after_another(spark, store):
    rng = random.Random(4)
    plain = None
    for at in range(3):
        rows = [(f"capture-{rng.randrange(12)}", f"https://e.org/{rng.randrange(10)}", f"{at}-{k}", rng.choice(["good", "failed"])) for k in range(6)]
        rows = list({(r[0]): r for r in rows}.values())
        captures = batch(spark, rows, at)
        current = plain if plain is not None else spark.createDataFrame([], cap.CONTENTS)
        merged = ct.upsert_captures(captures, current)["contents"]
        plain = spark.createDataFrame(merged.collect(), merged.schema)
        cap.merge_captures(captures, store, st.read_manifest(spark, store, 4), at)
        mine = cap.read_contents(spark, store)
        names = sorted(mine.columns)
        assert sorted(mine.select(names).collect(), key=repr) == sorted(plain.select(names).collect(), key=repr)


def test_contents_stored_twice_multiply_nothing(spark):
    contents = batch(spark, [("capture-1", "https://e.org/a", "x")] * 2 + [("capture-2", "https://e.org/a", "y")]).select(
        F.concat(F.lit("c"), F.monotonically_increasing_id().cast("string")).alias("content_id"), "capture_id", "source_type", F.col("source_url").alias("canonical_url"),
        F.col("captured_at").alias("created_at"),
    )
    asked = batch(spark, [("capture-1", "https://e.org/a", "n"), ("capture-9", "https://e.org/a", "n"), ("capture-8", "https://e.org/z", "n")]).withColumn("canonical_url", ct.identity_url())
    found = ct.match_existing(asked, contents)
    assert sorted((r.capture_id, r.match_kind) for r in found.collect()) == [("capture-1", "capture_id"), ("capture-8", "new"), ("capture-9", "url")]
