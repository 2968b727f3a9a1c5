"""Live variants on Structured Streaming: scans are deskewed and gated while the recording goes on.

The encoder stream is kept per recording as a short state, so that a frame waits until a sample after it
has come, or its watermark has passed, and is then given its angle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "bag string, frame_id long, t_ns long, theta double, n_samples long"
STATE = "t array<long>, v array<double>, ids array<long>, stamps array<long>"


def live_angles(encoder: DataFrame, frames: DataFrame, gate_ns: int = 110_000_000, keep_ns: int = 10_000_000_000, delay: str = "10 seconds") -> DataFrame:
    """Streams of (bag, t_ns, angle) and (bag, frame_id, t_ns) to each frame's interpolated angle and gate count.

    Samples older than ``keep_ns`` before the newest leave the state, which bounds it by the encoder's rate.
    Angles are unwrapped in order of time, late ones within the watermark included. Event times are nanoseconds; the watermark takes them as timestamps.
    """
    one = encoder.select("bag", "t_ns", F.col("angle").cast("double").alias("v"), F.lit(None).cast("long").alias("frame_id"))
    two = frames.select("bag", "t_ns", F.lit(None).cast("double").alias("v"), "frame_id")
    both = one.unionByName(two).withColumn("ts", F.timestamp_micros((F.col("t_ns") / 1000).cast("long"))).withWatermark("ts", delay)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kinds = (np.int64, float, np.int64, np.int64)
        t, v, ids, stamps = (np.array(x, k) for x, k in zip(state.get if state.exists else ([], [], [], []), kinds, strict=True))
        ended = state.hasTimedOut
        if not ended:
            pdf = pd.concat(list(batches))
            frame = pdf["frame_id"].notna().to_numpy()
            new, own = pdf.loc[~frame], pdf.loc[frame]
            # Late samples take their place in time; unwrapping goes on from the oldest that is kept.
            t, v = np.concatenate([t, new["t_ns"].to_numpy(np.int64)]), np.concatenate([v, new["v"].to_numpy(float)])
            order = np.argsort(t, kind="stable")
            t, v = t[order], np.unwrap(v[order])
            ids, stamps = np.concatenate([ids, own["frame_id"].to_numpy(np.int64)]), np.concatenate([stamps, own["t_ns"].to_numpy(np.int64)])
        ready = (stamps <= t[-1]) | ended if len(t) else np.zeros(len(stamps), bool)
        if ready.any():
            s = stamps[ready]
            n = np.searchsorted(t, s, "right") - np.searchsorted(t, s - gate_ns, "left")
            theta = np.interp(s - t[0], t - t[0], v)
            yield pd.DataFrame({"bag": key[0], "frame_id": ids[ready], "t_ns": s, "theta": theta, "n_samples": n})
        if ended:
            state.remove()
            return
        cut = int(np.searchsorted(t, t[-1] - keep_ns)) if len(t) else 0
        state.update((t[cut:].tolist(), v[cut:].tolist(), ids[~ready].tolist(), stamps[~ready].tolist()))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + 60_000)

    return both.groupBy("bag").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def live_gate_counts(encoder: DataFrame, window: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """Encoder samples per bag and tumbling window, for watching a recording's density."""
    e = encoder.withColumn("ts", F.timestamp_micros((F.col("t_ns") / 1000).cast("long"))).withWatermark("ts", delay)
    return e.groupBy("bag", F.window("ts", window)).agg(F.count("*").alias("n")).select("bag", "window.start", "window.end", "n")
