"""Tolerances and word lists. A profile or lexicon that differs from the default needs an id of its own."""

from __future__ import annotations

from dataclasses import dataclass, fields

from leafloom.functions.tokens import BULLETS


@dataclass(frozen=True)
class Profile:
    # The defaults.
    id: str = "default/1"
    line_overlap: float = 0.5
    fragment_gap_em: float = 1.0
    gutter_min_em: float = 1.0
    column_min_lines: int = 3
    prose_min_words: int = 4
    paragraph_gap_ratio: float = 1.75
    paragraph_gap_floor: float = 2.0
    size_change_ratio: float = 0.1
    heading_size_ratio: float = 1.1
    heading_max_words: int = 15
    heading_max_lines: int = 2
    footnote_size_ratio: float = 0.9
    furniture_share: float = 0.4
    furniture_band: float = 0.1
    furniture_x_tol: float = 3.0
    long_document_pages: int = 8

    def __post_init__(self) -> None:
        changed = [f.name for f in fields(self) if f.name != "id" and getattr(self, f.name) != f.default]
        if changed and self.id == "default/1":
            raise ValueError(f"{', '.join(changed)} changed: the profile needs another id")


@dataclass(frozen=True)
class Lexicon:
    id: str = "generic/1"
    bullets: tuple[str, ...] = tuple(BULLETS)

    def __post_init__(self) -> None:
        if self.bullets != tuple(BULLETS) and self.id == "generic/1":
            raise ValueError("bullets changed: the lexicon needs another id")
