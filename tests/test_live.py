"""Live variants over file streams that arrive in two parts."""

import numpy as np

from pointloom.streaming.live import live_angles, live_gate_counts

SECOND = 1_000_000_000


def test_frames_get_their_angle_once_samples_surround_them(spark, tmp_path):
    t = np.arange(0, 4 * SECOND, SECOND // 50)
    angle = (t / SECOND * 3 + np.pi) % (2 * np.pi) - np.pi
    for part in (t < 2 * SECOND, t >= 2 * SECOND):
        rows = [("a", int(x), float(v)) for x, v in zip(t[part], angle[part], strict=True)]
        spark.createDataFrame(rows, "bag string, t_ns long, angle double").coalesce(1).write.mode("append").parquet(str(tmp_path / "enc"))
    stamps = np.arange(SECOND // 2 + 1, 3 * SECOND, SECOND // 10)
    spark.createDataFrame([("a", i, int(s)) for i, s in enumerate(stamps)], "bag string, frame_id long, t_ns long").write.parquet(str(tmp_path / "frames"))
    stream = lambda n, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1 if n == "enc" else 100).parquet(str(tmp_path / n))
    enc = stream("enc", "bag string, t_ns long, angle double")
    out = live_angles(enc, stream("frames", "bag string, frame_id long, t_ns long"))
    q = out.writeStream.format("memory").queryName("live_angles").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.frame_id: r for r in spark.table("live_angles").collect()}
    assert len(got) == len(stamps)
    theta = np.array([got[i].theta for i in range(len(stamps))])
    want = np.interp(stamps, t, np.unwrap(angle))
    turns = (theta - want) / (2 * np.pi)
    assert np.allclose(turns, np.round(turns), atol=1e-6)
    assert all(got[i].n_samples >= 5 for i in range(len(stamps)))
    counts = live_gate_counts(enc).writeStream.format("memory").queryName("live_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    counts.processAllAvailable()
    counts.stop()
    assert sum(r.n for r in spark.table("live_counts").collect()) == len(t)


def test_late_samples_take_their_place_in_time(spark, tmp_path):
    t = np.arange(0, 4 * SECOND, SECOND // 50)
    angle = (t / SECOND * 3 + np.pi) % (2 * np.pi) - np.pi
    for lo, hi in ((0, 1), (2, 3), (1, 2), (3, 4)):  # the third is late, within the watermark
        part = (t >= lo * SECOND) & (t < hi * SECOND)
        rows = [("a", int(x), float(v)) for x, v in zip(t[part], angle[part], strict=True)]
        spark.createDataFrame(rows[::-1], "bag string, t_ns long, angle double").coalesce(1).write.mode("append").parquet(str(tmp_path / "enc"))
    stamps = np.arange(3 * SECOND + 50_000_001, 4 * SECOND - SECOND // 10, SECOND // 20)
    spark.createDataFrame([("a", i, int(s)) for i, s in enumerate(stamps)], "bag string, frame_id long, t_ns long").write.parquet(str(tmp_path / "frames"))
    enc = spark.readStream.schema("bag string, t_ns long, angle double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "enc"))
    out = live_angles(enc, spark.readStream.schema("bag string, frame_id long, t_ns long").parquet(str(tmp_path / "frames")))
    q = out.writeStream.format("memory").queryName("late_angles").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.frame_id: r for r in spark.table("late_angles").collect()}
    assert len(got) == len(stamps)
    turns = (np.array([got[i].theta for i in range(len(stamps))]) - np.interp(stamps, t, np.unwrap(angle))) / (2 * np.pi)
    assert np.allclose(turns, np.round(turns), atol=1e-6)
    want = [int(((t <= s) & (t >= s - 110_000_000)).sum()) for s in stamps]
    assert [got[i].n_samples for i in range(len(stamps))] == want
