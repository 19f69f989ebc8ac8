"""The timeline as a stream: runs of equal text by video, closed by a gap, another text or the end of a video."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GAP = 1500
SEGMENT = "video_id bigint, text string, start_ms bigint, end_ms bigint, text_confidence double, frame_count int"
STATE = "text string, start bigint, last bigint, gap bigint, total double, n int"


def _within(a: str, b: str) -> bool:
    x, y = a.encode(), b.encode()
    return bool(x and y) and len(x) != len(y) and (x in y or y in x)


def _bare(s: str) -> str:
    return "".join(s.split())


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    video = int(key[0])
    text, start, last, gap, total, n = state.get if state.exists else ("", 0, 0, 0, 0.0, 0)
    done: list[tuple] = []

    def close(end: int) -> None:
        done.append((video, text, start, end, total / n, n))

    if state.hasTimedOut:
        if text:
            close(gap or last)
        state.remove()
    else:
        rows = pd.concat(list(batches)).sort_values("timestamp")
        for t in rows.itertuples():
            now, said, sure = int(t.timestamp), t.text, float(t.text_confidence)
            if not said:
                gap = gap or (now if text else 0)
                continue
            if gap and now - gap <= GAP and (_bare(said) == _bare(text) or _within(said, text)):
                last, gap, total, n = now, 0, total + sure, n + 1
                continue
            if gap or (text and _bare(said) != _bare(text)):
                close(gap or last)
                text = ""
            if not text:
                text, start, total, n = said, now, 0.0, 0
            last, gap, total, n = now, 0, total + sure, n + 1
        state.update((text, start, last, gap, total, n))
        if "seen" in rows:
            state.setTimeoutTimestamp(int(rows["seen"].max().timestamp() * 1000) + 1)
    if done:
        yield pd.DataFrame(done, columns=["video_id", "text", "start_ms", "end_ms", "text_confidence", "frame_count"])


def stream_runs(frames: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Segments of a stream of frames (video_id, timestamp in ms, text, text_confidence, seen): the same as fold_runs.

    seen is the event time of arrival. A video's frames come in order; the last segment is
    closed when the watermark on seen passes the video's last frame by delay. The state of a
    video is one open segment.
    """
    rows = frames.withWatermark("seen", delay).select("video_id", "timestamp", "text", "text_confidence", "seen")
    return rows.groupBy("video_id").applyInPandasWithState(_step, SEGMENT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def stream_counts(frames: DataFrame, width: str = "10 seconds", delay: str = "10 seconds") -> DataFrame:
    """Frames with and without text in windows of event time seen, after the watermark has passed."""
    w = frames.withWatermark("seen", delay).groupBy(F.window("seen", width).alias("w"), "video_id")
    return w.agg(F.count("*").alias("frames"), F.count_if(F.col("text") != "").alias("with_text")).select("video_id", F.col("w.start").alias("start"), "frames", "with_text")


def stream_sessions(frames: DataFrame, gap_ms: int = GAP, delay: str = "10 seconds") -> DataFrame:
    """Sessions of frames with text, a new one after gap_ms without, by event time seen. Only frames with text move the watermark on."""
    rows = frames.withWatermark("seen", delay).filter(F.col("text") != "")
    s = rows.groupBy("video_id", F.session_window("seen", f"{gap_ms} milliseconds").alias("s")).agg(F.count("*").alias("frames"))
    return s.select("video_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "frames")
