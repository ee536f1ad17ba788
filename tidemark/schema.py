"""Record layouts: packets, playlists, telemetry. Unknown values are null, never a sentinel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PACKET = "track int, media_type string, flags int, ts_ms long, is_key boolean, payload binary, format_version int"
SEGMENT = "playlist_id int, seq long, url string, duration_ms long, start_ms long, discontinuity boolean"
VARIANT = "playlist_id int, bandwidth long, url string, rung int"
TS_PACKET = "n long, error boolean, unit_start boolean, priority boolean, pid int, scrambling int, adaptation int, continuity int, data_offset int, data_size int, ok boolean"
PES_HEADER = "ok boolean, stream_id int, packet_length int, pts long, dts long, header_length int, data_offset int, payload_size int"
DEVICE = "device_id string, app_id string, app_family string, app_version string, ip string, device_family string, os_family string, os_version string, player_version string, screen_w int, screen_h int"
SOURCE = "url string, format string, duration_ms long, video_codec string, audio_codec string, bitrate long, width int, height int, live boolean"
EVENT = "device_id string, app_id string, session_id string, event_id int, time_ms long, pos_ms long, duration_ms long, err int, first_frame_ms long, seek_to_ms long, bitrate_from long, bitrate_to long, bytes long, download_ms long"
MESSAGE = "msg_id int, value int, lvalue long, sval string, ts timestamp"

#: Telemetry event ids and their names.
EVENT_NAMES = {0: "startup", 1: "open", 2: "close", 3: "play", 4: "pause", 5: "seek", 6: "lag", 7: "bitrate_change", 8: "download"}


def micros(df, column: str) -> Column:
    """Microseconds since 1970 of a timestamp column, with or without a time zone, whatever the session's zone is."""
    if dict(df.dtypes)[column] == "timestamp":
        return F.unix_micros(column)
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{column}`)")


def is_failure(code: Column) -> Column:
    """Error codes above zero are soft; the high bit marks a failure."""
    return code.cast("int") < 0


def format_versions(new_format: Column, window) -> Column:
    """A record flagged new-format starts a version: the running count of flags."""
    return F.sum(new_format.cast("int")).over(window)
