"""Settings of the two tools, and where they are read from."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

FILE_NAMES = ("corpusforge.toml", "corpusforge.json", ".corpusforge.json")


@dataclass(frozen=True)
class BuildConfig:
    """What the corpus builder skips and ignores. Fetching a corpus is not its job."""

    skip_data_preparation: bool = False
    skip_transform: bool = False
    skip_clean: bool = False
    ignored_folders: tuple[str, ...] = ("corpus/node_modules", "corpus/.git")
    ignored_files: tuple[str, ...] = ()


@dataclass(frozen=True)
class OrganizeConfig:
    password: str = "secret"
    dirty_files: tuple[str, ...] = ("junk",)
    delete_packages: bool = True
    decompress_mixed_names: bool = False
    move_files_to_root: bool = True
    rename_root: bool = True
    folder_range: tuple[int, int] | None = None
    #: Seconds that one extraction may take.
    timeout: float = 10.0


def merged(defaults, given: dict):
    """Defaults with the given fields put over them, one level deep.

    Names may come in camel case; a list replaces the default list.
    """
    known = {f.name for f in fields(defaults)}
    snake = lambda k: "".join("_" + c.lower() if c.isupper() else c for c in k)
    values = {}
    for key, value in given.items():
        name = snake(key).removeprefix("is_")
        if name not in known:
            raise ValueError(f"unknown setting {key}")
        if name == "folder_range" and isinstance(value, dict):
            value = (int(value["start"]), int(value["end"]))
        values[name] = tuple(value) if isinstance(value, list) else value
    return replace(defaults, **values)


def find_config_dir(start: str | Path) -> Path | None:
    """The nearest folder, from ``start`` up, that holds a settings file."""
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        if any((folder / n).is_file() for n in FILE_NAMES):
            return folder
    return None


def load_config(start: str | Path, defaults=None):
    """Settings of the nearest file over the defaults."""
    defaults = OrganizeConfig() if defaults is None else defaults
    folder = find_config_dir(start)
    if folder is None:
        return defaults
    path = next(folder / n for n in FILE_NAMES if (folder / n).is_file())
    given = tomllib.loads(path.read_text()) if path.suffix == ".toml" else json.loads(path.read_text())
    return merged(defaults, given)


def strip_quotes(argument: str) -> str:
    """Without one matching pair of quotes."""
    if len(argument) >= 2 and argument[0] == argument[-1] and argument[0] in "'\"":
        return argument[1:-1]
    return argument


def validate_target(argument: str) -> Path:
    path = Path(strip_quotes(argument))
    if not path.is_absolute():
        raise ValueError(f"not an absolute path: {path}")
    if not path.exists():
        raise ValueError(f"no such path: {path}")
    if not path.is_dir():
        raise ValueError(f"not a directory: {path}")
    return path
