"""The file of exclude patterns that users can edit."""

from __future__ import annotations

import os

NAME = "noise.conf"
# The head of the file.
HEADER = "# noise config: generated, safe to edit\n# One exclude pattern per line. Matches FQN, name, or owner (substring).\n# Delete lines to stop filtering those symbols. Add lines to filter more.\n# Regenerate with: noise --init\n"


def write(folder: str, categories: list[tuple[str, list[str]]]) -> str:
    path = os.path.join(folder, NAME)
    with open(path, "w", encoding="utf-8") as out:
        out.write(HEADER)
        for label, patterns in categories:
            out.write(f"\n# {label}\n" + "".join(f"{p}\n" for p in patterns))
    return path


def read(folder: str) -> list[str] | None:
    """Its patterns; None where there is no file, an empty list where a file has none."""
    path = os.path.join(folder, NAME)
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as lines:
        stripped = [x.strip() for x in lines]
    return [x for x in stripped if x and not x.startswith("#")]
