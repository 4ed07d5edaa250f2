"""Parameters of the engine, with the defaults that its queries use."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ChunkParams:
    target: int = 800
    overlap: int = 120
    sentence_window: int = 200
    hard_max: int = 1100
    min_tail: int = 60
    min_keep: int = 10
    max_paragraph: int = 420
    #: Characters that end a sentence. The Latin profile adds the full stop.
    sentence_ends: str = "。！？；!?;…"


LATIN = ChunkParams(sentence_ends="。！？；!?;….")


@dataclass(frozen=True)
class Bm25Params:
    k1: float = 1.5
    b: float = 0.75


RRF_K = 60
TOP_K = 20
GROUP_K = 6
SNIPPET = 160
CONTEXT_EACH, CONTEXT_TOTAL, GROUP_EACH = 900, 18000, 1000


def from_environment(read=None, path: str | None = None) -> dict[str, str]:
    """Settings of the generator plug-in: from ``path`` (lines of NAME=value, # comments), overridden by the environment's TESSERA_ names."""
    import os

    out = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                name, eq, value = line.strip().partition("=")
                if eq and not name.startswith("#"):
                    out[name.strip()] = value.strip().strip("\"'")
    env = os.environ if read is None else read
    return out | {k: v for k, v in env.items() if k.startswith("TESSERA_")}
