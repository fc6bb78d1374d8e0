"""Connectors: named sources with a phase and a function that ingests them, and the configuration that lists them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

CODE, DOC = "code", "doc"


@dataclass(frozen=True)
class Connector:
    type: str
    help: str
    phase: str
    ingest: Callable


@dataclass
class Registry:
    known: dict[str, Connector] = field(default_factory=dict)

    def add(self, connector: Connector) -> None:
        self.known[connector.type] = connector

    def split_by_phase(self, sources: list[dict]) -> tuple[list[dict], list[dict]]:
        """Sources of the code phase, to which unknown types count, and of the document phase."""
        phase = lambda s: self.known[s["type"]].phase if s.get("type") in self.known else CODE
        return [s for s in sources if phase(s) == CODE], [s for s in sources if phase(s) == DOC]


@dataclass
class Config:
    sources: list[dict] = field(default_factory=list)
    accept_above: float = 0.8
    gate: float = 0.5
    batch: int = 8


def parse_config(text: str) -> Config:
    """Configuration from YAML; unknown keys are passed over, absent ones have defaults."""
    import yaml

    raw = yaml.safe_load(text) or {}
    own = Config()
    own.sources = [s for s in raw.get("sources") or [] if isinstance(s, dict)]
    own.accept_above = float((raw.get("review") or {}).get("acceptAbove", own.accept_above))
    return own
