"""Settings that change while a service runs: bounded, partial updates, kept as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

CONTEXT_LEAST, CONTEXT_MOST = 4096, 131072


def clamp(context: int, most: int = CONTEXT_MOST) -> int:
    return max(CONTEXT_LEAST, min(context, most))


@dataclass(frozen=True)
class Settings:
    retrieval_context: int = 16384
    answer_context: int = 32768
    answer_reserve: int = 2048
    max_evals: int = 400
    child_batch: int = 0
    rescue_most: int = 5
    facet_mode: str = "any"

    def updated(self, changes: dict) -> Settings:
        """With the changes that are known and not null; contexts are kept within bounds."""
        known = {f.name: f.type for f in fields(self)}
        use = {k: v for k, v in changes.items() if k in known and v is not None}
        for k in ("retrieval_context", "answer_context"):
            if k in use:
                use[k] = clamp(int(use[k]))
        return replace(self, **use)


def load(path: str | Path) -> Settings:
    """The kept settings; defaults where the file is missing or can't be read."""
    try:
        return Settings().updated(json.loads(Path(path).read_text()))
    except (OSError, ValueError, AttributeError):
        return Settings()


def save(settings: Settings, path: str | Path) -> None:
    Path(path).write_text(json.dumps(asdict(settings), indent=1))
