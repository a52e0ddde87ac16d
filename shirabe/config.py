"""Thresholds and settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

#: The categories in order, and their labels.
CATEGORIES = (
    ("crawl", "Crawling"),
    ("meta", "Metadata"),
    ("heading", "Headings"),
    ("structured", "Structured data"),
    ("social", "Social"),
    ("content", "Content"),
    ("mobile", "Mobile"),
    ("speed", "Speed"),
    ("security", "Security"),
    ("japanese", "Japanese"),
)
#: Points that a finding costs, by severity; any other severity costs OTHER_WEIGHT.
WEIGHTS = {"critical": 25, "warning": 10, "info": 3}
OTHER_WEIGHT = 5


@dataclass(frozen=True)
class Thresholds:
    """Limits of the rules; change one to change the rule."""

    title_max: int = 32
    title_min: int = 10
    description_max: int = 120
    description_min: int = 50
    thin_text: int = 300
    most_links: int = 200
    blocking_scripts: int = 3
    slow: float = 1.5
    very_slow: float = 3.0
    japanese_least: int = 40
    japanese_share: float = 0.08
    min_chain: int = 2


@dataclass(frozen=True)
class Settings:
    """Limits of crawling and of the service's quotas."""

    body_bytes: int = 3 * 1024 * 1024
    text_sample: int = 4000
    probes: int = 20
    free_audits: int = 3
    free_advice: int = 5
    sites: int = 20
    max_pages: int = 5
    max_pages_admin: int = 50
    audits_listed: int = 50
    documents_kept: int = 50
    prompt_findings: int = 40
    prompt_pages: int = 15
    evidence_chars: int = 160


def overridden(kind: type, values: dict[str, str], prefix: str = "shirabe."):  # noqa: ANN201
    """Thresholds or Settings with the values of `prefix`name (of the session's settings or the
    environment), read as the type of the default; a value that can't be read raises a ValueError."""
    found = {}
    for f in fields(kind):
        if (text := values.get(prefix + f.name)) not in (None, ""):
            try:
                found[f.name] = type(f.default)(text)
            except ValueError as wrong:
                raise ValueError(f"{prefix}{f.name} = {text!r} is no {type(f.default).__name__}") from wrong
    return kind(**found)


THRESHOLDS, SETTINGS = overridden(Thresholds, dict(os.environ), "SHIRABE_"), overridden(Settings, dict(os.environ), "SHIRABE_")
