"""Callbacks around engine operations.  Pre-hooks may change the payload or, by raising, cancel; post-hooks only watch."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

EVENTS = tuple(f"{when}_{what}" for when in ("pre", "post") for what in ("put", "delete", "query", "compact", "snapshot"))


class Hooks:
    def __init__(self):
        self._by: dict[str, list] = defaultdict(list)

    def register(self, event: str, fn: Callable, priority: int = 0) -> None:
        """Lower priorities run first; of equal ones the later registration does."""
        if event not in EVENTS:
            raise ValueError(f"unknown event {event!r}")
        self._by[event].append((priority, -len(self._by[event]), fn))
        self._by[event].sort(key=lambda x: x[:2])

    def pre(self, event: str, payload):
        for *_, fn in self._by[f"pre_{event}"]:
            changed = fn(payload)
            payload = payload if changed is None else changed
        return payload

    def post(self, event: str, payload, failed: list | None = None) -> None:
        """A failing watcher doesn't undo what has been done; its error goes to failed."""
        for *_, fn in self._by[f"post_{event}"]:
            try:
                fn(payload)
            except Exception as e:
                if failed is not None:
                    failed.append(e)


def outlier_hook(rules: list[tuple[str, str, float, float]], warn: Callable[[str], None]) -> Callable:
    """A pre_put hook over a list of (metric, tags, ts, fields); warns and lets pass."""

    def look(points):
        for metric, _, ts, fields in points:
            for m, f, lo, hi in rules:
                v = fields.get(f) if m == metric else None
                if isinstance(v, (int, float)) and not isinstance(v, bool) and not lo <= v <= hi:
                    warn(f"{metric}.{f} = {v} at {ts} is outside [{lo}, {hi}]")

    return look


def write_amplification(bytes_read: int, bytes_written: int) -> float:
    return bytes_written / bytes_read if bytes_read else 0.0
