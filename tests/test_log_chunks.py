"""Logs of several chunks, whose channels are recorded in the first one only."""

import struct

import pytest
import zstandard

from pointloom.sources import mcap


def record(op, body):
    return struct.pack("<BQ", op, len(body)) + body


def string(s):
    return struct.pack("<I", len(s)) + s.encode()


def channel(k, topic):
    return record(4, struct.pack("<HH", k, 0) + string(topic) + string("cdr") + struct.pack("<I", 0))


def message(k, log):
    return record(5, struct.pack("<HIQQ", k, log, log, log) + b"data")


def chunk(body):
    packed = zstandard.ZstdCompressor().compress(body)
    return record(6, struct.pack("<QQQI", 0, 1000, len(body), 0) + string("zstd") + struct.pack("<Q", len(packed)) + packed)


def log(summary, loose=b"", known=("/a", "/b")):
    channels = [channel(k, t) for k, t in enumerate(known, 1)]
    chunks = chunk(b"".join(channels) + message(1, 100) + message(2, 101)) + chunk(message(1, 200) + message(2, 201)) + chunk(message(2, 301))
    statistics = record(0x0B, struct.pack("<QHIIIIQQI", 5, 0, len(known), 0, 0, 3, 0, 1000, 0))
    more = {"none": b"", "full": b"".join(channels) + statistics, "partial": channels[0] + statistics, "statistics": statistics}[summary]
    return mcap.MAGIC + record(1, string("ros2") + string("")) + chunks + loose + record(0x0F, bytes(4)) + more + record(2, bytes(20)) + mcap.MAGIC


def read(spark, path, topics):
    mcap.register(spark)
    rows = spark.read.format("mcap").option("topics", topics).load(str(path)).collect()
    return sorted((r.log_time_ns, r.topic) for r in rows)


@pytest.mark.parametrize("summary", ["none", "full", "partial", "statistics"])
def test_channels_of_the_first_chunk_hold_for_all(spark, tmp_path, summary):
    path = tmp_path / "log.mcap"
    path.write_bytes(log(summary))
    assert read(spark, path, "/b") == [(101, "/b"), (201, "/b"), (301, "/b")]
    assert read(spark, path, "/a") == [(100, "/a"), (200, "/a")]
    assert len(read(spark, path, "")) == 5
    (tmp_path / "log.mcap.zstd").write_bytes(zstandard.ZstdCompressor().compress(path.read_bytes()))
    assert read(spark, tmp_path / "log.mcap.zstd", "/b") == read(spark, path, "/b")


def test_messages_outside_chunks_know_their_channels(spark, tmp_path):
    path = tmp_path / "log.mcap"
    path.write_bytes(log("none", loose=message(2, 401)))
    assert read(spark, path, "/b") == [(101, "/b"), (201, "/b"), (301, "/b"), (401, "/b")]


def test_a_message_of_an_unknown_channel_is_an_error(spark, tmp_path):
    path = tmp_path / "log.mcap"
    path.write_bytes(log("none", known=("/a",)))
    with pytest.raises(Exception, match="unknown channel 2"):
        read(spark, path, "/a")
