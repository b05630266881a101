"""Configuration of an observer: defaults, files, and tables that are polled for a new version."""

from __future__ import annotations

import copy
import json
import time
from collections.abc import Callable, Iterator

#: Defaults in milliseconds, records and megabytes.
DEFAULTS = {"debounce": {"window_ms": 250, "max_buffer": 1000}, "browser": {"memory_mb": 1024, "recycle_ms": 14_400_000, "stealth": "auto"}, "snapshot_interval_ms": 14_400_000, "pages": [], "sinks": []}


def with_defaults(given: dict, defaults: dict = DEFAULTS) -> dict:
    """given with the defaults where it has nothing (or zero, or an empty text)."""
    out = copy.deepcopy(defaults)
    for k, v in given.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = with_defaults(v, out[k])
        elif v not in (None, "", 0):
            out[k] = v
    return out


def load(text: str) -> dict:
    """A configuration from JSON, or from YAML where a YAML reader is installed."""
    try:
        return with_defaults(json.loads(text))
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("this is not JSON, and no YAML reader is installed") from e
        return with_defaults(yaml.safe_load(text) or {})


def poll(version: Callable[[], object], every_s: float = 0.2, quiet_s: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Iterator[object]:
    """Each new value of version(), once it has not changed for quiet_s."""
    last, pending, waited = version(), None, 0.0
    while True:
        sleep(every_s)
        now = version()
        if now != last:
            last, pending, waited = now, now, 0.0
        elif pending is not None:
            waited += every_s
            if waited >= quiet_s:
                yield pending
                pending = None
