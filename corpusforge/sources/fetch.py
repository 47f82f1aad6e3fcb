"""Fetching a corpus with git, on the driver's machine."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from pathlib import Path


def fetch_corpus(address: str, target: str | Path, timeout: float | None = None, git: str = "git") -> int:
    """A shallow clone of ``address`` that takes the place of ``target``.

    The clone is made beside the target and swapped in when it is whole; after a
    failure what was there stays. A target that is, or holds, the working or the
    home folder is refused. Gives back git's exit status, which the caller may
    look at; only a git that cannot be started, or that runs longer than
    ``timeout`` seconds, is an error.
    """
    folder = Path(target).absolute()
    real = folder.resolve()
    if any(real == p or real in p.parents for p in (Path.cwd().resolve(), Path.home().resolve())):
        raise ValueError(f"{folder} holds the working or the home folder")
    folder.parent.mkdir(parents=True, exist_ok=True)
    beside = Path(tempfile.mkdtemp(prefix=f".{folder.name}-", dir=folder.parent))
    try:
        status = subprocess.run([git, "clone", "--depth", "1", "--", address, str(beside / "new")], capture_output=True, timeout=timeout, check=False).returncode
        if status == 0:
            if folder.exists() or folder.is_symlink():
                folder.rename(beside / "old")
            (beside / "new").rename(folder)
        return status
    finally:
        shutil.rmtree(beside, ignore_errors=True)
