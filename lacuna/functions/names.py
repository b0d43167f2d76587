"""Names of helper columns that don't meet those of the caller's table."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """wanted, each with as many underscores behind it as it takes to differ from all names taken, in any case."""
    held, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out
