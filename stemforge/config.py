"""Settings of a run."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, field
from pathlib import Path

from stemforge.operators.chunking import ChunkOptions
from stemforge.operators.structure import CHAPTER_HEADING, SECTION_HEADING


@dataclass(frozen=True)
class Settings:
    """The model endpoint and defaults, from the environment and a file of variables; others are not looked at."""

    base_url: str = "http://localhost:11434/v1"
    api_key: str = ""
    model: str = ""
    embedding_model: str = ""
    temperature: float = 0.7
    per_chunk: int = 2

    @classmethod
    def from_environment(cls, prefix: str = "STEMFORGE_", file: str = ".env") -> Settings:
        """Lines ``NAME=value`` of ``file`` (if there is one; quotation marks around a value are dropped), over them the environment."""
        held: dict[str, str] = {}
        if Path(file).is_file():
            for line in Path(file).read_text(encoding="utf-8").splitlines():
                name, equals, value = line.strip().removeprefix("export ").partition("=")
                if equals and not name.lstrip().startswith("#"):
                    held[name.strip()] = value.strip().strip("\"'")
        held |= os.environ
        known = {f: held[prefix + f.upper()] for f in cls.__dataclass_fields__ if prefix + f.upper() in held}
        typed = {"temperature": float, "per_chunk": int}
        return cls(**{k: typed.get(k, str)(v) for k, v in known.items()})


@dataclass(frozen=True)
class IngestConfig:
    """Chunk options and headings; the heading patterns have two groups, number and title."""

    options: ChunkOptions = field(default_factory=ChunkOptions)
    chapter_heading: str = CHAPTER_HEADING
    section_heading: str = SECTION_HEADING


_KEYS = {"target_tokens": "target", "max_tokens": "maximum", "min_tokens": "minimum", "overlap_tokens": "overlap"}


def load_config(path: str | None) -> IngestConfig:
    """A YAML file with ``chunking`` and ``heading_patterns`` (chapter, section) over the defaults.

    A missing file (with a warning) or an empty one leaves the defaults; other keys are not looked at.
    """
    if not path:
        return IngestConfig()
    if not Path(path).exists():
        logging.getLogger(__name__).warning("no configuration at %s, defaults hold", path)
        return IngestConfig()
    import yaml

    held = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    given = {_KEYS[k]: int(v) for k, v in (held.get("chunking") or {}).items() if k in _KEYS}
    headings = held.get("heading_patterns") or {}
    return IngestConfig(ChunkOptions(**given), headings.get("chapter", CHAPTER_HEADING), headings.get("section", SECTION_HEADING))
