"""Settings from the environment and from the nearest .env file above a folder."""

from __future__ import annotations

import os
from pathlib import Path

NAMES = ("graph", "sources", "limit")


def load(folder: str = ".") -> dict[str, str]:
    """Values of GRAFLOOM_<NAME>; the environment wins over the file, missing ones are empty."""
    found: dict[str, str] = {}
    here = Path(folder).resolve()
    file = next((p / ".env" for p in (here, *here.parents) if (p / ".env").is_file()), None)
    for line in file.read_text(encoding="utf-8").splitlines() if file else ():
        name, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and not name.startswith("#"):
            found[name.strip()] = value.strip().strip("\"'")
    return {n: os.environ.get(f"GRAFLOOM_{n.upper()}", found.get(f"GRAFLOOM_{n.upper()}", "")) for n in NAMES}
