"""Settings from the environment, each read as its default's type."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

PREFIX = "GLINTFRAME_"


@dataclass(frozen=True)
class Settings:
    image_size: int = 256
    supported_formats: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".webp", ".bmp")
    max_upload_bytes: int = 25 * 1024 * 1024
    tiles_per_side: int = 4
    n_folds: int = 5
    random_state: int = 42
    calibrate_method: str = "isotonic"
    threshold_fpr_target: float = 0.02
    cache_size: int = 256
    verbose: bool = False


def load(environment: Mapping[str, str] | None = None) -> Settings:
    """Settings that the environment names (prefix and name in capitals) over the defaults; lists by commas, switches by 1, true, yes, on."""
    environment, found = os.environ if environment is None else environment, {}
    for f in fields(Settings):
        said = environment.get(PREFIX + f.name.upper())
        if said is None:
            continue
        kind = type(f.default)
        if kind is bool:
            found[f.name] = said.strip().lower() in ("1", "true", "yes", "on")
        elif kind is tuple:
            found[f.name] = tuple(part.strip() for part in said.split(",") if part.strip())
        else:
            found[f.name] = kind(said)
    return Settings(**found)
