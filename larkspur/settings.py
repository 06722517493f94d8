"""Weights, thresholds and limits. Fixed values, which a caller may replace."""

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    k1: float = 1.5
    b: float = 0.75
    weights: dict = field(default_factory=lambda: {"lexical": 0.32, "title_bm25": 0.18, "fuzzy": 0.14, "semantic": 0.18, "phrase": 0.08, "phonetic": 0.04, "popularity": 0.03, "recency": 0.01, "language_boost": 0.06})
    min_candidate: float = 0.35
    semantic_rescue: float = 0.28
    fuzzy_rescue: float = 0.78
    autocorrect: float = 0.90
    show_results: float = 0.96
    did_you_mean: float = 0.985
    max_query_length: int = 240
    max_page_size: int = 25
    max_request_bytes: int = 1 << 20
    max_audio_bytes: int = 5 << 20
    rate_limit: int = 60
    rate_window_seconds: int = 60
    schema_version: str = "1.0.0"
    api_prefix: str = "/api/v1"
    api_key_header: str = "X-API-Key"
    mean_of_latest: int = 500
    #: Rows of a word or number up to which a table of counted size is broadcast (some 20 MB).
    broadcast_rows: int = 1 << 18


SETTINGS = Settings()
