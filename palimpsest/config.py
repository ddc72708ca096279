"""Settings from JSON files and defaults. The first file that has a value wins; lists are joined."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass
class Settings:
    mode: str = "bm25"
    rrf_k: int = 60
    bm25_k: int = 200
    dense_k: int = 200
    final_k: int = 8
    path_boost: int = 3
    bm25_aux: bool = False
    min_should_match: float = 0.6
    fuzziness: int = 0
    per_file: int = 1
    rerank: bool = False
    dirs: list[str] = field(default_factory=list)
    providers: list[dict] = field(default_factory=list)

    @classmethod
    def load(cls, paths: list[str]) -> Settings:
        got: dict = {}
        for p in paths:
            for k, v in json.loads(Path(p).read_text()).items():
                if isinstance(v, list):  # folders and providers of all files, in their order
                    got[k] = [*got.get(k, []), *[x for x in v if x not in got.get(k, [])]]
                else:
                    got.setdefault(k, v)
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in got.items() if k in known})


def read_queries(said: list[str], file: str | None = None) -> list[str]:
    """Queries given and those of a file, without blank lines and # comments of the file."""
    out = [q.strip() for q in said if q.strip()]
    if file:
        out += [line.strip() for line in Path(file).read_text(encoding="utf-8").splitlines() if line.strip() and not line.lstrip().startswith("#")]
    return out
