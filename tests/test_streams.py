"""A stream gives the batch answer whatever the files, triggers and Arrow batches."""
import random

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from meterloom.streaming import jobs as J

EVENTS = "/root/testdata/sf0.001/events.parquet"
JOBS = {"daily": J.daily_rollup, "sliding": J.sliding_stats, "outages": J.outages, "alarms": J.shift_alarms}


def rows(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    """The same events in one file, and dealt out of order over 40 and 200 files."""
    table, out = pq.read_table(EVENTS), {}
    for n in (1, 40, 200):
        out[n] = tmp_path_factory.mktemp(f"files{n}")
        at = list(range(table.num_rows))
        random.Random(n).shuffle(at)
        for k in range(n):
            pq.write_table(table.take(pa.array(sorted(at[k::n]))), out[n] / f"events-{k:03d}.parquet")
    return out


@pytest.mark.parametrize("name", JOBS)
def test_any_files_triggers_and_batches(spark, folders, name):
    def run(n, per_trigger, batch):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        try:
            return rows(J.run_whole(J.read_events(spark, str(folders[n]), per_trigger=per_trigger), JOBS[name], name, delay="4000 days"))
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")

    whole = run(1, None, 4096)
    assert whole and run(40, 20, 16) == whole and run(200, None, 4096) == whole


def test_late_rows_fail_the_run(spark, folders):
    with pytest.raises(J.LateRows):
        J.run_whole(J.read_events(spark, str(folders[40]), per_trigger=10), J.daily_rollup, "late", delay="1 day")


def test_every_window_is_closed(spark, folders):
    want = pd.read_parquet(EVENTS)
    got = J.run_whole(J.read_events(spark, str(folders[1])), J.daily_rollup, "all").toPandas()
    assert got.n.sum() == len(want) and abs(got.total.sum() - want.value.sum()) < 1e-6
