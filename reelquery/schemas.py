"""Schemas of the stored tables, as DDL."""

VIDEO_INFO = "struct<duration_seconds: double, fps: double, frame_count: bigint, width: int, height: int>"
MEDIA = f"id string, title string, type string, season int, episode int, episode_title string, video_path string, subtitle_path string, video_info {VIDEO_INFO}"
FRAME = "frame_id string, timestamp_seconds int, timestamp_formatted string, image_path string"
FRAMES = f"vec_id bigint, media_id string, title string, type string, season int, episode int, episode_title string, {FRAME}, embedding array<float>"
MANIFEST = f"media_id string, title string, type string, season int, episode int, episode_title string, source_video string, sampling_interval_seconds int, frame_count int, frames array<struct<{FRAME.replace(' string', ': string').replace(' int', ': int')}>>"
SUBTITLE_ENTRIES = "media_id string, season int, episode int, entry_no int, start double, end double, text string"
OCR_TEXT = "image_path string, ocr_text string"
#: Entries as different writers name their fields, inside any of the containers that they use.
LOOSE_ENTRY = "struct<start: double, end: double, start_seconds: double, end_seconds: double, text: string, content: string, subtitle: string>"
CONTAINERS = ("entries", "subtitles", "segments", "lines", "items", "data")
EPISODE = ("media_id", "season", "episode")
