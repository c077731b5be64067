"""Text helpers."""

from __future__ import annotations

UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB")


def human_size(n: float) -> str:
    """A size in bytes in the largest binary unit that leaves it at least 1."""
    power = min(len(UNITS) - 1, max(0, (int(abs(n)).bit_length() - 1) // 10)) if n else 0
    return f"{n:.0f} B" if not power else f"{n / 1024**power:.1f} {UNITS[power]}"
