"""Thresholds and options of the engine; every default can be overridden by a FOLIOSPARK_* variable or an argument."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Config:
    # page triage
    min_chars: int = 60
    min_text_area: float = 0.012
    image_dominance: float = 0.55
    ink_lines: int = 4
    # text recognition
    ocr_dpi: float = 300.0
    ocr_min_word_conf: float = 40.0
    ocr_page_conf: float = 70.0
    native_overlap: float = 0.35
    # headers and footers
    header_band: float = 0.11
    footer_band: float = 0.11
    repetition: float = 0.6
    similarity: float = 88.0
    min_repeat_pages: int = 2
    # tables
    table_confidence: float = 0.65
    table_min_rows: int = 2
    table_min_cols: int = 2
    snap: float = 3.0
    min_ruling: float = 12.0
    frame_ratio: float = 0.92
    gap_factor: float = 3.0
    min_gap: float = 9.0
    stability: float = 0.62
    # images
    image_min_side: int = 24
    image_min_area: int = 2500
    vector_min_drawings: int = 8
    # headings
    heading_words: int = 28
    heading_delta: float = 0.75
    heading_levels: int = 6
    hyphenation: float = 0.02
    # captions
    caption_chars: int = 320
    caption_distance: float = 46.0
    # quality
    lossy_least: int = 40
    lossy_ratio: float = 0.75
    lexical_sample: int = 0  # characters of every row that are read; 0: all (the reference reads 60000 of a file)
    sample_pages: int = 12
    # guarded edits
    preview_chars: int = 400
    window_blocks: int = 120
    window_overlap: int = 5
    # jobs
    ttl_minutes: int = 60
    max_file_mb: int = 200
    max_batch_mb: int = 1000
    max_batch_files: int = 100
    # rendering
    page_markers: bool = True
    review_markers: bool = True
    footnotes_inline: bool = True

    @classmethod
    def from_env(cls) -> Config:
        """Defaults overridden by the environment."""
        values = {}
        for f in fields(cls):
            raw = os.environ.get(f"FOLIOSPARK_{f.name.upper()}")
            if raw is not None:
                kind = type(f.default)
                values[f.name] = raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)
        return replace(cls(), **values)


@dataclass(frozen=True)
class Options:
    """What one conversion is asked to do."""

    ocr_mode: str = "auto"  # auto, force, never
    language: str = "por"
    pages: tuple[int, ...] = field(default_factory=tuple)
    tables: bool = True
    images: bool = True
    vector_figures: bool = True
    merge_across_pages: bool = True
    page_markers: bool = True
    edits: bool = False
    edits_consent: bool = False


DEFAULT = Config()
