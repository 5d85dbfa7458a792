"""Settings: the environment before a properties file before a default; blank values count as missing."""

from __future__ import annotations

import os
from collections.abc import Mapping

from .hits import env_name


def properties(text: str) -> dict[str, str]:
    """key=value (or key:value) lines; those that start with # or ! are remarks."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] in "#!":
            continue
        at = min((i for i in (line.find("="), line.find(":")) if i >= 0), default=len(line))
        out[line[:at].strip()] = line[at + 1 :].strip()
    return out


class Settings:
    def __init__(self, values: Mapping[str, str] | None = None, environment: Mapping[str, str] | None = None):
        self.values, self.environment = dict(values or {}), os.environ if environment is None else environment

    def get(self, key: str, default: str | None = None) -> str | None:
        for value in (self.environment.get(env_name(key)), self.values.get(key)):
            if value is not None and value.strip():
                return value
        return default

    def get_int(self, key: str, default: int) -> int:
        try:
            return int((self.get(key) or "").strip())
        except ValueError:
            return default

    def get_bool(self, key: str, default: bool) -> bool:
        value = self.get(key)
        return default if value is None else value.strip().lower() in ("true", "1", "yes", "y")
