"""Configuration on the driver: files, environment, overlays, logging."""

from __future__ import annotations

import copy
import json
import logging
import logging.handlers
import os
from collections.abc import Mapping, MutableMapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def load(path: str) -> dict:
    """A configuration file: JSON by its ending, YAML otherwise (if the library is there)."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError(f"{path} needs a YAML reader; JSON does without") from e
    return yaml.safe_load(text) or {}


def read_env(text: str, into: MutableMapping[str, str]) -> dict[str, str]:
    """``KEY=VALUE`` lines of a text, set where the key isn't yet; comments and other lines are passed over, quotes around values go."""
    added = {}
    for line in map(str.strip, text.splitlines()):
        if line and not line.startswith("#") and "=" in line:
            key, value = (x.strip() for x in line.split("=", 1))
            if key and key not in into:
                into[key] = added[key] = value.strip('"').strip("'")
    return added


def load_env(path: str, into: MutableMapping[str, str] | None = None) -> dict[str, str]:
    """``read_env`` of a file; nothing where there is none."""
    return read_env(Path(path).read_text(encoding="utf-8"), os.environ if into is None else into) if Path(path).exists() else {}


def overlay(default: Mapping[str, Any], own: Mapping[str, Any]) -> dict[str, Any]:
    """Own values over default ones; mappings of both are merged, one level deep."""
    out = copy.deepcopy(dict(default))
    for key, value in own.items():
        if isinstance(value, Mapping) and isinstance(out.get(key), Mapping):
            out[key] = {**out[key], **value}
        else:
            out[key] = copy.deepcopy(value)
    return out


def source_settings(default: Mapping[str, Any], own: Mapping[str, Any], run: Mapping[str, Any]) -> dict[str, Any]:
    """Settings of one source: the default's, the source's, then those of the run; what none has gets a fixed value."""
    out = overlay(default, own)
    for key, name, fixed in (("timeout", "timeout_seconds", 30), ("retry_limit", "retry_attempts", 3), ("delay_between_retries_sec", "delay_between_retries_sec", 2)):
        out[key] = run.get(name, out.get(key, fixed))
    headers = dict(out.get("headers") or {})
    headers["User-Agent"] = run.get("user_agent", headers.get("User-Agent", "Mozilla/5.0"))
    return out | {"headers": headers}


def keys_in_order(environ: Mapping[str, str], prefix: str, single: str | None = None) -> list[str]:
    """Values of all variables of a prefix, by their names; the single one if there are none."""
    found = [environ[k] for k in sorted(environ) if k.startswith(prefix) and environ[k].strip()]
    return found or ([environ[single]] if single and environ.get(single) else [])


def nested(config: Mapping[str, Any], *path: str, default: Any = None) -> Any:
    """A value deep in a configuration; the default where the path ends early."""
    for key in path:
        if not isinstance(config, Mapping) or key not in config:
            return default
        config = config[key]
    return config


def law_table(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    """``ord``, ``name``, ``aliases``, ``keywords`` of the laws that a configuration lists."""
    rows = [(i, x["name"], list(x.get("aliases") or []), list(x.get("keywords") or [])) for i, x in enumerate(config.get("target_laws") or [])]
    return spark.createDataFrame(rows, "ord int, name string, aliases array<string>, keywords array<string>")


def template_table(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    """``ord``, ``id``, ``template``, ``priority`` of the query templates that a configuration lists."""
    rows = [(i, x["id"], x["template"], int(x["priority"])) for i, x in enumerate(config.get("query_templates") or [])]
    return spark.createDataFrame(rows, "ord int, id string, template string, priority int")


def daily_log(folder: str, name: str, keep: int = 30) -> logging.Logger:
    """The library's logger, into a file that is turned over each day; a second call adds nothing."""
    logger = logging.getLogger("quillflow")
    target = os.path.abspath(os.path.join(folder, name))
    if not any(getattr(h, "baseFilename", None) == target for h in logger.handlers):
        os.makedirs(folder, exist_ok=True)
        handler = logging.handlers.TimedRotatingFileHandler(target, when="midnight", backupCount=keep, encoding="utf-8")
        handler.setFormatter(logging.Formatter("%(asctime)s | %(levelname)-7s | %(name)s | %(message)s"))
        logger.addHandler(handler)
        logger.setLevel(logging.INFO)
    return logger
