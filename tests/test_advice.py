"""What the review of the first round found missing in the frame work and the streams."""

import numpy as np

from framelake.operators import raster as r
from framelake.streaming import streams as st

from .test_raster import frames

DATA = "/root/testdata/sf0.001"


def test_mean_windows_leave_out_partial_frames(spark):
    values, shapes = (10, 20, 40, 200, 80), [(2, 2), (2, 2), (2, 2), (1, 2), (2, 2)]
    x = frames(spark, *[np.full(s, v) for v, s in zip(values, shapes, strict=True)])
    got = {(row["centre"], row["pos"]): (row["background"], row["frames"]) for row in r.mean_fields(x, 3, 3).collect()}
    assert got == {(c, p): v for c, v in {0: (10, 1), 3: (30, 2), 6: (80, 1)}.items() for p in range(4)}
    profile = {row["x"]: row["profile"] for row in r.profiles(x, 3, 3).where("centre = 3").collect()}
    assert profile == {0: 64, 1: 64}


def test_streams_end_in_tables_of_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    events = spark.read.parquet(f"{DATA}/events.parquet").count()
    for build, mode in ((lambda e: st.tail_after(e, -1), "append"), (st.current_status, "complete")):
        out = st.run_once(build(st.event_stream(spark, DATA)), mode)
        files = out.inputFiles()
        assert files and all(shared in f for f in files)
        folder = files[0].removeprefix("file://").split("/rows/")[0]
        assert (spark.read.text(f"{folder}/checkpoint/metadata")).count()
        assert (out.count() if mode == "append" else out.groupBy().sum("events").first()[0]) == events
    none = st.run_once(st.tail_after(st.event_stream(spark, DATA), 10**12), "append")
    assert none.count() == 0
