"""Settings of an engine: defaults, checked once, overridable from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    vault_root: str = "./vault"
    store_path: str = "./data/store"
    embed_model: str = "hashed-words"
    embed_url: str = ""
    dimension: int = 64
    metric: str = "l2"
    chunk_size: int = 512
    overlap: int = 64
    watch_interval: int = 5
    debounce_seconds: int = 5
    hidden: bool = False  #: names that begin with a dot or underscore, of local vaults; the command lines set it
    exclude: tuple[str, ...] = (".obsidian", ".trash", ".git", "__pycache__")
    batch_size: int = 50
    max_backups: int = 2  #: earlier versions that a store keeps
    buckets: int = 1024  #: of a layer of the store at most

    def __post_init__(self):
        if self.dimension < 1 or self.chunk_size < 1 or self.batch_size < 1 or self.buckets < 1 or self.max_backups < 0:
            raise ValueError("dimension, chunk_size, batch_size and buckets are 1 at least, max_backups 0 at least")
        if self.overlap < 1:
            raise ValueError("an overlap below 1 would repeat every word in every later window")
        if self.metric not in ("l2", "cosine", "dot"):
            raise ValueError(f"unknown metric {self.metric}")

    @property
    def overlap_words(self) -> int:
        """Words that a window shares with the one before it: the overlap by 4, rounded up."""
        return -(-self.overlap // 4)

    @classmethod
    def from_environment(cls, environ: dict[str, str] | None = None, **given) -> "Config":
        """Variables are the upper-cased field names; EXCLUDE_DIRS is a comma-separated list. An empty list excludes nothing.

        HIDDEN is on unless it is 0, false or no."""
        environ = os.environ if environ is None else environ
        values: dict = {"hidden": environ.get("HIDDEN", "1").lower() not in ("0", "false", "no")}
        for f in fields(cls):
            raw = environ.get("EXCLUDE_DIRS" if f.name == "exclude" else f.name.upper())
            if raw is None or f.name == "hidden":
                continue
            values[f.name] = tuple(x for x in raw.split(",") if x) if f.name == "exclude" else int(raw) if f.type in ("int", int) else raw
        return cls(**(values | given))
