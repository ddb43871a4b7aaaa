"""The provider ledger: what was answered is never asked again, whatever stopped the run."""

import os
import sys
import tempfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gleaner.operators import stages as st

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Noting:
    """Notes every call in a folder; stops its process's task at one payload while ``deadly`` exists."""

    model = "m"

    def __init__(self, folder):
        self.calls, self.deadly, self.live = f"{folder}/calls", f"{folder}/deadly", f"{folder}/live"
        for path in (self.calls, self.live):
            os.makedirs(path, exist_ok=True)

    def complete(self, system_prompt, user_prompt, stage):
        import time
        import uuid

        if user_prompt == "p13" and os.path.exists(self.deadly):
            raise SystemExit("task lost")
        mark = f"{self.live}/{os.getpid()}-{uuid.uuid4().hex}"
        open(mark, "w").close()
        time.sleep(0.01)
        with open(f"{self.calls}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{user_prompt} {sum(n.startswith(f'{os.getpid()}-') for n in os.listdir(self.live))}")
        os.remove(mark)
        if user_prompt == "p7":
            raise TimeoutError("slow")
        return f"{system_prompt}{user_prompt}", "stop"

    def asked(self):
        return [open(f"{self.calls}/{n}").read().split() for n in os.listdir(self.calls)]


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="gleaner-ledger-")


def requests(spark, n=40):
    # Twenty payloads, each asked by two rows.
    return spark.range(n).repartition(8).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("p"), (F.col("id") % 20).cast("string")).alias("payload"))


def test_a_run_after_a_lost_task_asks_only_what_is_open(spark, folder):
    provider, ledger = Noting(folder), f"{folder}/ledger"
    open(provider.deadly, "w").close()
    with pytest.raises(Exception):
        st.run_stage(requests(spark), provider, "triage", "s ", ledger, wave=4).collect()
    before = {a for a, _ in provider.asked()}
    kept = {r.raw[2:] for r in st.read_answers(spark, f"{ledger}/stage=triage").collect() if r.raw}
    assert kept and kept <= before and len(provider.asked()) == len(before), "answers of finished waves stay"
    os.remove(provider.deadly)
    rows = {r.id: (r.raw, r.error) for r in st.run_stage(requests(spark), provider, "triage", "s ", ledger, wave=4).collect()}
    assert len(rows) == 40 and rows["r13"] == rows["r33"] == ("s p13", None) and rows["r7"][1] == "TimeoutError: slow"
    again = [a for a, _ in provider.asked()]
    assert not {a for a in again if again.count(a) > 1} & kept, "nothing answered is asked twice"
    # A third run asks for the failed call only.
    count = len(again)
    st.run_stage(requests(spark), provider, "triage", "s ", ledger, wave=4).collect()
    assert len(provider.asked()) == count + 1
    # Another prompt is another request.
    st.run_stage(requests(spark), provider, "triage", "t ", ledger).collect()
    assert len(provider.asked()) == count + 21


def test_concurrency_is_bounded_and_rows_stay_whole(spark, folder):
    provider = Noting(folder)
    rows = st.run_stage(requests(spark, 100).coalesce(1), provider, "triage", "", concurrency=3).collect()
    assert sorted(r.id for r in rows) == sorted(f"r{k}" for k in range(100))
    assert all(r.raw == f"p{int(r.id[1:]) % 20}" for r in rows if r.error is None) and sum(r.error is not None for r in rows) == 5
    most = max(int(n) for _, n in provider.asked())
    assert 2 <= most <= 3
