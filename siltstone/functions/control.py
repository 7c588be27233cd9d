"""Control arguments of a report or a run, read on the driver: cutoffs, prices, suggestions, release notes, settings."""

from __future__ import annotations

import math
import re
from datetime import datetime, timezone

# Dollars for a million tokens.
PRICES = {"generic-frontier": {"input": 3.0, "output": 15.0}, "generic-mid": {"input": 1.0, "output": 5.0}, "generic-small": {"input": 0.25, "output": 1.25}}
DEFAULT_MODEL = "generic-frontier"
UNITS = {"m": 60, "h": 3600, "d": 86400, "w": 604800}
LEAST = -(2**63)


def cutoff(spec: str, now: int) -> int:
    """The second from which on events count: so long before now (90m, 24h, 7d, 4w), an instant, or the start of a UTC day."""
    own = spec.strip()
    if m := re.fullmatch(r"(?i)([0-9]+)([mhdw])", own):
        span = int(m[1]) * UNITS[m[2].lower()]
        if 0 < span < 2**63:
            return max(now - span, LEAST)
    elif m := re.fullmatch(r"(\d{4}-\d\d-\d\d)(?:.(\d\d:\d\d:\d\d)(Z|[+-]\d\d(?::?\d\d)?))?", own):
        zone = (m[3] or "Z").replace("Z", "+0000").replace(":", "")
        try:
            return int(datetime.strptime(f"{m[1]} {m[2] or '00:00:00'} {zone if len(zone) == 5 else zone + '00'}", "%Y-%m-%d %H:%M:%S %z").astimezone(timezone.utc).timestamp())
        except ValueError:
            pass
    raise ValueError(f"{spec!r} is neither a span (90m, 24h, 7d, 4w) nor an instant or day (2026-07-01T09:00:00Z, 2026-07-01)")


def price(model: str = DEFAULT_MODEL, side: str = "input") -> float:
    """Dollars for a million tokens; 0 for a model that is not listed."""
    return PRICES.get(model, {}).get(side, 0.0)


def distance(a: str, b: str) -> int:
    """The least number of single-character edits between two words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def suggestions(word: str, known: list[str]) -> list[str]:
    """Up to three known words within a third of the word's bytes and two edits, nearest first."""
    near = sorted((distance(word, k), k) for k in known)
    return [k for d, k in near if d <= len(word.encode()) // 3 + 2][:3]


def release(text: str) -> tuple[int, int, int] | None:
    m = re.fullmatch(r"v?(\d+)\.(\d+)\.(\d+)", text.strip())
    return (int(m[1]), int(m[2]), int(m[3])) if m else None


def release_notes(changelog: str, after: str, to: str, most: int = 10) -> str:
    """The sections (headed "## [X.Y.Z]") of releases after one and up to another, newest first, `most` at most and how many more there are."""
    low, high = release(after), release(to)
    if low is None or high is None:
        raise ValueError(f"not a release: {after if low is None else to!r}")
    parts = re.split(r"(?m)^(?=## )", changelog)
    found = [(v, part.rstrip()) for part in parts if (m := re.match(r"## \[([^\]]*)", part)) and (v := release(m[1])) and low < v <= high]
    found.sort(key=lambda x: x[0], reverse=True)
    more = len(found) - most
    return "\n\n".join(part for _, part in found[:most]) + (f"\n\n... and {more} more releases" if more > 0 else "")


def yaml_block(text: str, block: str) -> dict[str, object]:
    """The scalar values of one top-level block of a settings file; lines that can't be read are left out."""
    out: dict[str, object] = {}
    inside = False
    for raw in text.splitlines():
        line = re.sub(r"\s+#.*$", "", raw).rstrip()
        if not line or line.lstrip().startswith("#"):
            continue
        if not line[0].isspace():
            inside = line == f"{block}:"
        elif inside and (m := re.match(r"\s+([\w-]+):\s*(.+)$", line)):
            out[m[1]] = scalar(m[2])
    return out


def scalar(raw: str) -> object:
    if raw.lower() in ("true", "false"):
        return raw.lower() == "true"
    for kind in (int, float):
        try:
            return kind(raw)
        except ValueError:
            pass
    return raw[1:-1] if len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "'\"" else raw


# Each block's settings with their defaults and what they may be.
LEVELS, OUTPUTS, FOOTERS, ORIGINS = ("signature", "compact", "full"), ("off", "lite", "standard", "max"), ("off", "on", "session"), ("code", "knowledge", "both")
BLOCKS = {
    "retrieval": {"detail": ("compact", LEVELS)},
    "output": {"level": ("standard", OUTPUTS)},
    "memory": {"enabled": (True, bool)},
    "summarization": {"auto_tokens": (None, int)},
    "mcp": {"result_footer": ("off", FOOTERS)},
    "markdown": {"max_section_tokens": (400, int)},
    "knowledge": {"enabled": (True, bool), "min_score": (0.30, float), "default_source": ("both", ORIGINS)},
}


def _fits(value: object, kind: object) -> object | None:
    """The value as the setting has it, None if it isn't one."""
    if isinstance(kind, tuple):
        own = {True: "on", False: "off"}.get(value, value) if isinstance(value, bool) else value
        return own.lower() if isinstance(own, str) and own.lower() in kind else None
    if kind is bool:
        return value if isinstance(value, bool) else None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    if kind is int:
        return value if isinstance(value, int) and value > 0 else None
    return float(value) if math.isfinite(value) else None


def settings(text: str) -> dict[str, dict[str, object]]:
    """All blocks of a settings file; a value that is missing or doesn't fit leaves the default."""
    out: dict[str, dict[str, object]] = {}
    for block, known in BLOCKS.items():
        found = yaml_block(text, block)
        out[block] = {name: default if (own := _fits(found.get(name), kind)) is None else own for name, (default, kind) in known.items()}
    return out
