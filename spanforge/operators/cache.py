"""Results of repeated queries, kept by the driver in least-recently-used order."""

from __future__ import annotations

import hashlib
import json
import os
import threading
from collections import OrderedDict
from typing import Any


class QueryCache:
    """At most ``capacity`` results, the least recently used leaving first; optionally stored
    as one JSON file. The key holds the index version, the trimmed query as written and all
    parameters, so a result never outlives its index. Safe for several threads."""

    def __init__(self, capacity: int = 500, path: str | None = None):
        self.capacity, self.path = capacity, path
        self.hits = self.misses = 0
        self._lock = threading.Lock()
        self._rows: OrderedDict[str, Any] = OrderedDict()
        if path and os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                self._rows.update(json.load(f))

    @staticmethod
    def key(version: str, query: str, **params: Any) -> str:
        raw = ":".join([version, query.strip(), *(f"{k}={params[k]}" for k in sorted(params))])
        return hashlib.sha256(raw.encode()).hexdigest()

    def get(self, key: str) -> Any | None:
        with self._lock:
            if key not in self._rows:
                self.misses += 1
                return None
            self.hits += 1
            self._rows.move_to_end(key)
            return self._rows[key]

    def set(self, key: str, value: Any) -> None:
        with self._lock:
            self._rows[key] = value
            self._rows.move_to_end(key)
            while len(self._rows) > self.capacity:
                self._rows.popitem(last=False)
            self._save()

    def __len__(self) -> int:
        return len(self._rows)

    def _save(self) -> None:
        if self.path:
            os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
            new = f"{self.path}.new"
            with open(new, "w", encoding="utf-8") as f:
                json.dump(self._rows, f)
            os.replace(new, self.path)
