"""Settings of an engine, from the environment where it sets them."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Mapping


@dataclasses.dataclass(frozen=True)
class Settings:
    """Where tables lie and how the stages run. ``PRESSWORK_ROOT`` sets ``root``, and so on for each field."""

    root: str = "warehouse"
    fetch_timeout: float = 30.0
    user_agent: str = "presswork/1.0"
    embed_batch: int = 32
    scan: int = 2000
    context: int = 32768
    max_tokens: int = 1500
    attempts: int = 3
    retry_seconds: float = 10.0
    interval: int = 60

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        """Fields without a variable, or with an empty one, keep their default; one that is no number raises."""
        env = os.environ if env is None else env
        kinds = {"int": int, "float": float, "str": str}
        given = {f.name: env.get(f"PRESSWORK_{f.name.upper()}", "") for f in dataclasses.fields(cls)}
        return cls(**{f.name: kinds[str(f.type)](given[f.name]) for f in dataclasses.fields(cls) if given[f.name] != ""})
