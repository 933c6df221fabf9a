"""Settings file, place of the source, and names of caches."""

from __future__ import annotations

import hashlib
import os
import tomllib
from pathlib import Path

from codeloom.constants import FINGERPRINT_FILES, OPERATORS_YAML


def config_path() -> Path:
    return Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / "codeloom" / "config.toml"


def cache_root() -> Path:
    return Path(os.environ.get("XDG_CACHE_HOME") or Path.home() / ".cache") / "codeloom"


def load_config(path: Path | None = None) -> dict:
    """Empty if the file is missing or does not parse."""
    try:
        return tomllib.loads((path or config_path()).read_text())
    except (OSError, tomllib.TOMLDecodeError):
        return {}


def _toml(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int | float):
        return str(value)
    if isinstance(value, list):
        return "[" + ", ".join(map(_toml, value)) + "]"
    escaped = str(value).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    return f'"{escaped}"'


def save_config(changes: dict[str, dict], path: Path | None = None) -> Path:
    """Changes sections of the file and keeps everything else in it."""
    path = path or config_path()
    merged = load_config(path)
    for section, values in changes.items():
        merged[section] = {**merged.get(section, {}), **values}
    plain = [f"{k} = {_toml(v)}" for k, v in merged.items() if not isinstance(v, dict)]
    blocks = ["\n".join([f"[{s}]", *[f"{k} = {_toml(v)}" for k, v in vs.items()]]) for s, vs in merged.items() if isinstance(vs, dict)]
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n\n".join(["\n".join(plain), *blocks] if plain else blocks) + "\n")
    return path


def resolve_source(flag: str | None = None, environ: dict[str, str] | None = None, path: Path | None = None) -> str | None:
    """The flag; else PYTORCH_SOURCE, or PYTORCH_PATH if that is unset (the place must exist); else the settings file's (likewise)."""
    if flag:
        return flag
    env = os.environ if environ is None else environ
    for place in (env.get("PYTORCH_SOURCE") or env.get("PYTORCH_PATH"), load_config(path).get("source", {}).get("pytorch_source")):
        if place and Path(place).exists():
            return place
    return None


def validate_source(path: str) -> tuple[bool, str]:
    p = Path(path)
    checks = [(p.exists(), f"path does not exist: {p}"), (p.is_dir(), f"path is not a directory: {p}"), ((p / "torch").exists(), f"no torch directory in {p}"), ((p / OPERATORS_YAML).exists(), f"no {OPERATORS_YAML} in {p}")]
    return next(((False, why) for ok, why in checks if not ok), (True, f"valid source: {p}"))


def source_hash(path: str) -> str:
    return hashlib.md5(str(Path(path).resolve()).encode()).hexdigest()[:12]


def catalog_path(source: str, root: str | None = None) -> str:
    return f"{root or cache_root()}/catalog_{source_hash(source)}"


def fingerprint(source: str) -> str:
    """Changes with the name, time or size of the files that tell a version."""
    parts = [f"{Path(f).name}:{s.st_mtime}:{s.st_size}" for f in FINGERPRINT_FILES if (p := Path(source) / f).exists() and (s := p.stat())]
    return hashlib.md5("|".join(parts).encode()).hexdigest()[:16]
