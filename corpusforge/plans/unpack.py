"""Unpacking on the driver's machine, in a process of its own with a time limit.

Zip and gzip are read here; 7z archives and volume sets need a ``7z`` program on
the path. Files come into a folder beside the target first and are moved there
only when all are out, so a run that fails or is ended leaves nothing behind.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
import tempfile
from collections.abc import Callable
from pathlib import Path

from ..sources.archives import EXTRACTORS
from ..sources.config import OrganizeConfig

#: Names of the program that reads 7z archives.
PROGRAMS = ("7z", "7za", "7zz", "7zr")


class NoReader(Exception):
    """No reader is known for an archive."""


def _program() -> str | None:
    return next(filter(None, map(shutil.which, PROGRAMS)), None)


def _command(src: Path, into: Path, password: str) -> list[str]:
    if src.suffix.lower() in EXTRACTORS:
        return [sys.executable, "-m", __name__, str(src), str(into)]
    program = _program()
    if program is None:
        raise NoReader(f"no reader for {src.suffix or src.name}")
    return [program, "x", str(src), f"-o{into}", f"-p{password}", "-y"]


def _merge(part: Path, dst: Path) -> None:
    for folder, _, names in os.walk(part):
        target = dst / Path(folder).relative_to(part)
        target.mkdir(parents=True, exist_ok=True)
        for name in names:
            os.replace(Path(folder) / name, target / name)


def extractor(config: OrganizeConfig) -> Callable[[Path, Path], None]:
    """A function that unpacks ``src`` into ``dst``.

    It raises TimeoutError after ``config.timeout`` seconds, NoReader where
    nothing reads the archive, and RuntimeError where reading it fails.
    """

    def run(src: Path, dst: Path) -> None:
        dst.parent.mkdir(parents=True, exist_ok=True)
        part = Path(tempfile.mkdtemp(prefix=f".{dst.name}-", dir=dst.parent))
        try:
            command = _command(src, part, config.password)
            home = str(Path(__file__).resolve().parents[2])
            env = os.environ | {"PYTHONPATH": os.pathsep.join(filter(None, [home, os.environ.get("PYTHONPATH")]))}
            done = subprocess.run(command, input=config.password.encode(), capture_output=True, timeout=config.timeout, env=env, check=False)
            if done.returncode:
                raise RuntimeError((done.stderr or done.stdout).decode(errors="replace").strip().rsplit("\n", 1)[-1])
            _merge(part, dst)
        except subprocess.TimeoutExpired as e:
            raise TimeoutError(f"not unpacked within {config.timeout} s") from e
        finally:
            shutil.rmtree(part, ignore_errors=True)

    return run


def main(src: str, into: str) -> None:
    base = Path(into).resolve()
    password = sys.stdin.read()
    for member, data in EXTRACTORS[Path(src).suffix.lower()](src, Path(src).read_bytes(), password or None):
        target = (base / member).resolve()
        if base not in target.parents:
            raise ValueError(f"{member} lies outside the archive's folder")
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)


if __name__ == "__main__":
    main(*sys.argv[1:])
