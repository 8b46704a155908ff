"""Settings and tuning constants of the search engine."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

FORMATS = ("markdown", "canvas", "base")
EXTENSIONS = {"md": "markdown", "canvas": "canvas", "base": "base"}
SORTS = ("relevance", "created-desc", "created-asc", "modified-desc", "modified-asc", "title-asc", "path-asc")
FIELDS = ("title", "path", "frontmatter", "tag", "heading", "body")
QUALITIES = ("exact", "alias", "fuzzy")


@dataclass(frozen=True)
class Weights:
    """Factors of the score."""

    field: Mapping[str, float] = field(
        default_factory=lambda: {"title": 3.0, "path": 1.0, "frontmatter": 2.0, "tag": 2.0, "heading": 1.5, "body": 1.0}
    )
    whole_word: float = 1.3
    proximity: float = 1.4
    proximity_window: float = 400
    recency: float = 1.15
    recency_days: float = 365
    fuzzy: float = 0.7
    alias: float = 0.95


@dataclass(frozen=True)
class Tuning:
    """Limits of parsing, matching and excerpts."""

    gram: int = 3
    min_gram_term: int = 3
    max_variants: int = 8
    max_query: int = 512
    snippet_chars: int = 160
    snippet_lines: int = 5
    fuzzy_short: int = 1
    fuzzy_long: int = 2
    fuzzy_short_term: int = 5
    store_batch: int = 200
    max_matches: int = 500
    weights: Weights = Weights()


@dataclass(frozen=True)
class Settings:
    """What a user chooses; see :func:`migrate` for what is accepted."""

    default_sort: str = "relevance"
    snippet_count: int = 2
    created_field: str = "created"
    excluded_folders: tuple[str, ...] = ()
    formats: tuple[str, ...] = FORMATS
    fuzzy: bool = False
    subfolders: bool = True
    max_results: int = 200
    force_rebuild: bool = False


RANGES = {"snippet_count": (1, 3), "max_results": (20, 1000)}


def canonical_formats(value: Any) -> tuple[str, ...]:
    """Known formats in their fixed order; Markdown is always one of them."""
    asked = {v for v in value if isinstance(v, str)} if isinstance(value, (list, tuple, set)) else set()
    return tuple(f for f in FORMATS if f == "markdown" or f in asked)


def migrate(raw: Any) -> Settings:
    """Settings from untrusted data: unknown keys go, bad values become the default, numbers
    are rounded and clamped to their range."""
    given = raw if isinstance(raw, Mapping) else {}
    out: dict[str, Any] = {}
    for f in fields(Settings):
        value, default = given.get(f.name), getattr(Settings, f.name, None)
        if f.name not in given:
            continue
        if f.name in RANGES:
            low, high = RANGES[f.name]
            if isinstance(value, (int, float)) and not isinstance(value, bool) and 0 <= value < float("inf"):
                out[f.name] = min(high, max(low, int(value + 0.5)))
        elif f.name == "formats":
            out[f.name] = canonical_formats(value)
        elif f.name == "excluded_folders":
            if isinstance(value, (list, tuple)):
                out[f.name] = tuple(v for v in value if isinstance(v, str))
        elif f.name == "default_sort":
            out[f.name] = value if value in SORTS else default
        elif isinstance(value, type(default)):
            out[f.name] = value
    return Settings(**out)


def format_of(extension: str) -> str | None:
    return EXTENSIONS.get(extension.lower())
