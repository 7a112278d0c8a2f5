"""Settings: defaults, then a TOML file, then WEIR_* variables of the environment."""

from __future__ import annotations

import os
import tomllib
from pathlib import Path

DEFAULTS = {"alert": {"threshold": 90.0, "seconds": 3.0}, "churn": {"span": "2 seconds", "step": "250 milliseconds"}, "report": {"tolerance_pct": 10.0}}


def load(path: str | None = None, env: dict[str, str] | None = None) -> dict:
    """WEIR_ALERT_SECONDS=5 sets alert.seconds; values take the type of their default."""
    out = {k: dict(v) for k, v in DEFAULTS.items()}
    if path:
        for section, values in tomllib.loads(Path(path).read_text()).items():
            out.setdefault(section, {}).update(values)
    for section, values in out.items():
        for key, default in values.items():
            given = (os.environ if env is None else env).get(f"WEIR_{section}_{key}".upper())
            if given is not None:
                values[key] = type(default)(given)
    return out
