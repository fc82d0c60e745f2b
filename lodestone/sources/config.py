"""Configuration: dataclasses, and a YAML file found by argument, environment, working folder, then defaults."""

from __future__ import annotations

import dataclasses
import os
from dataclasses import dataclass, field

from lodestone.functions import fixed


@dataclass
class Chunking:
    chunk_size: int = 1000
    chunk_overlap: int = 200


@dataclass
class Scanner:
    max_file_size_mb: int = fixed.GLOBAL_MAX_MB
    use_content_hash: bool = False
    skip_cleanup: bool = False
    excluded_dirs: list = field(default_factory=list)


@dataclass
class Query:
    top_k: int = 10
    score_threshold: float = 0.3


@dataclass
class Pipeline:
    extraction_timeout: int = 300
    embed_batch_size: int = 512
    gpu_slots: int = 1
    type_max_mb: dict = field(default_factory=lambda: dict(fixed.TYPE_MAX_MB))


@dataclass
class Config:
    scan_paths: list = field(default_factory=list)
    store: str = "lodestone_store"
    path_map: dict = field(default_factory=dict)
    chunking: Chunking = field(default_factory=Chunking)
    scanner: Scanner = field(default_factory=Scanner)
    query: Query = field(default_factory=Query)
    pipeline: Pipeline = field(default_factory=Pipeline)
    log_level: str = "INFO"


def merge(config, values: dict):
    """Known keys over the defaults; sections and dicts are merged, not replaced; unknown keys are ignored."""
    for f in dataclasses.fields(config):
        if f.name in (values or {}):
            old, new = getattr(config, f.name), values[f.name]
            if dataclasses.is_dataclass(old):
                merge(old, new or {})
            elif isinstance(old, dict):
                setattr(config, f.name, old | (new or {}))
            else:
                setattr(config, f.name, new)
    return config


def load(path: str | None = None, variable: str = "LODESTONE_CONFIG") -> Config:
    at = path or os.environ.get(variable) or ("config.yaml" if os.path.exists("config.yaml") else None)
    if not at:
        return Config()
    with open(at, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml

        values = yaml.safe_load(text)
    except ImportError:  # JSON is YAML too
        import json

        values = json.loads(text)
    return merge(Config(), values or {})
