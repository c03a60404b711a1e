"""Settings from the environment, read once where a plan is built."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from tidegate.functions import fixed

_TRUE = {"1", "true", "yes", "on"}


def flag(env: Mapping[str, str], name: str, default: bool) -> bool:
    value = env.get(name)
    return default if value is None else value.strip().lower() in _TRUE


def number(env: Mapping[str, str], name: str, default: int) -> int:
    """A whole number; what can't be read counts as unset."""
    try:
        return int(env.get(name, default))
    except ValueError:
        return default


@dataclass(frozen=True)
class Config:
    env: Mapping[str, str] = field(default_factory=lambda: dict(os.environ))

    @property
    def short_circuit(self) -> bool:
        return flag(self.env, "SHORT_CIRCUIT", False)

    @property
    def max_file_bytes(self) -> int:
        return number(self.env, "MAX_FILE_BYTES", fixed.MAX_FILE_BYTES)

    @property
    def max_job_bytes(self) -> int:
        return number(self.env, "MAX_JOB_BYTES", fixed.MAX_JOB_BYTES)

    @property
    def max_files(self) -> int:
        return number(self.env, "MAX_FILES_PER_JOB", fixed.MAX_FILES)

    @property
    def guard(self) -> str:
        return self.env.get("GUARD_BACKEND", "lexical").strip().lower()

    @property
    def inspector(self) -> str:
        return self.env.get("INSPECTOR_BACKEND", "lexical").strip().lower()
