"""Names and fixed values shared by the operators."""

from __future__ import annotations

import os
from dataclasses import dataclass

# Handle prefixes of the record formats, and this engine's marker label.
HANDLE_PREFIX = "ks2_"
LEGACY_PREFIX = "ks_"
LABEL = "Tilefold"

DEFAULT_BUDGET = 120_000


@dataclass(frozen=True)
class EngineConfig:
    """Locations and limits of one engine instance; environment variables override defaults.

    ``budget`` is the token budget of a session ledger, ``read_gate`` tells whether read
    redirection is on (off for ``0``, ``off``, ``false``, ``no`` and the empty string).
    """

    root: str = ".tilefold"
    budget: int = DEFAULT_BUDGET
    read_gate: bool = True

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> EngineConfig:
        env = dict(os.environ) if env is None else env
        budget = env.get("TILEFOLD_BUDGET", "").strip()
        gate = env.get("TILEFOLD_READ_GATE")
        return cls(
            root=env.get("TILEFOLD_ROOT") or cls.root,
            budget=int(budget) if budget.isdecimal() else DEFAULT_BUDGET,
            read_gate=gate is None or gate.strip().lower() not in ("0", "off", "false", "no", ""),
        )

    def path(self, kind: str) -> str:
        """Directory of one kind of table: store, meta, ledger, metrics, decisions, cache."""
        return f"{self.root}/{kind}"
