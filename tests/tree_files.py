"""The package's small source tree, written where a test wants it."""

from pathlib import Path

from codeloom.plans.tree import FILES, contents  # noqa: F401


def write(root: Path) -> str:
    for name, data in contents().items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return str(root)
