"""Configuration files: TOML, looked for upwards."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from tessera.errors import ConfigError

FILE, LEVELS, CACHE_DIR = "tessera.toml", 10, "tessera.cache.dir"


@dataclass
class PackConfig:
    cache_dir: str | None = None
    languages: list[str] = field(default_factory=list)
    groups: list[str] = field(default_factory=list)


def load(path: str | Path) -> PackConfig:
    try:
        got = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise ConfigError(f"{path}: {e}") from e
    return PackConfig(got.get("cache_dir"), list(got.get("languages") or []), list(got.get("groups") or []))


def discover(start: str | Path = ".") -> PackConfig | None:
    """The first file in a folder or the ten above it, else the user's own."""
    at = Path(start).resolve()
    for folder in [at, *at.parents][: LEVELS + 1]:
        if (folder / FILE).is_file():
            return load(folder / FILE)
    own = Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / "tessera" / "config.toml"
    return load(own) if own.is_file() else None


def write(path: str | Path, config: PackConfig) -> None:
    text = lambda x: json.dumps(x, ensure_ascii=False).replace("\x7f", "\\u007f")  # noqa: E731  a TOML basic string is a JSON one
    quoted = lambda names: "[" + ", ".join(map(text, names)) + "]"
    lines = [f"cache_dir = {text(config.cache_dir)}"] * bool(config.cache_dir) + [f"languages = {quoted(config.languages)}"] * bool(config.languages) + [f"groups = {quoted(config.groups)}"] * bool(config.groups)
    Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8")


def configure(spark, config: PackConfig, catalog) -> list[str]:
    """Applies a configuration: its cache folder becomes the session's, its languages and then its groups are asked for. The
    names that are ready, sorted; an unknown one raises."""
    from tessera.operators.catalog import download_plan

    if config.cache_dir:
        spark.conf.set(CACHE_DIR, config.cache_dir)
    return download_plan(catalog, config=config)


def cache_dir(spark) -> str:
    """The session's cache folder, else that of TESSERA_CACHE, else the user's own."""
    return spark.conf.get(CACHE_DIR, os.environ.get("TESSERA_CACHE", str(Path.home() / ".cache" / "tessera")))


def clean_cache(folder: str | Path) -> int:
    """Removes the files of a cache folder; the number removed, 0 for none there."""
    n = 0
    for f in sorted(Path(folder).rglob("*"), reverse=True) if Path(folder).is_dir() else []:
        f.rmdir() if f.is_dir() else f.unlink()
        n += 1
    return n
