"""Schemas of the engine's tables."""

from __future__ import annotations

WORD = "struct<text:string,start_s:double,end_s:double>"
WORDS = f"array<{WORD}>"
AUDIO = "struct<pcm:binary,sample_rate:int,num_samples:bigint>"
#: The central table: speakers' intervals by clip.
UTTERANCES = f"clip_id string, speaker_id string, start_s double, end_s double, text string, words {WORDS}, truncated boolean"
SPEAKER_CLIPS = f"clip_id string, ord int, speaker_id string, text string, duration_s double, words {WORDS}"
MANIFEST = "clip_id string, split string, audio_path string, transcript string, duration_s double, speaker_count_total int, speaker_count_max_simultaneous int, metadata map<string,string>"
MIXTURE = "utterances array<struct<speaker_id:string,wav:string,text:string,start_s:double>>"
