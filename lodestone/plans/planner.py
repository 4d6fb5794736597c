"""Which access path a search takes, decided on the driver from counts."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

#: Up to so many candidates an exact scan is cheaper than a graph.
EXACT_LIMIT = 2048


class Mode(str, Enum):
    HYBRID = "hybrid"
    SEMANTIC = "semantic"
    LEXICAL = "lexical"

    @property
    def uses_vectors(self) -> bool:
        return self is not Mode.LEXICAL

    @property
    def uses_words(self) -> bool:
        return self is not Mode.SEMANTIC


class Strategy(str, Enum):
    EXACT = "exact"
    APPROXIMATE = "approximate"
    APPROXIMATE_THEN_EXACT = "approximate_then_exact"


@dataclass(frozen=True)
class Plan:
    mode: Mode
    depth: int
    use_graph: bool


def depth(k: int, mode: Mode, diverse: bool) -> int:
    """Fusion and diversification choose from more than k."""
    return max(4 * k, 50) if mode is Mode.HYBRID or diverse else k


def resolve_mode(mode: Mode, words_usable: bool) -> Mode:
    return mode if words_usable or mode is Mode.SEMANTIC else Mode.SEMANTIC


def plan(k: int, mode: Mode, diverse: bool, exact: bool, candidates: int, graph_usable: bool, words_usable: bool, limit: int = EXACT_LIMIT) -> Plan:
    mode = resolve_mode(Mode(mode), words_usable)
    return Plan(mode, depth(k, mode, diverse), graph_usable and not exact and candidates > limit)


def graph_usable(nodes: int, dim: int, entries: int, query_dim: int) -> bool:
    """The graphs must hold all entries, in the query's dimension."""
    return entries > 0 and nodes == entries and dim == query_dim
