"""Models as directories of Parquet tables with a JSON description."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession


def save(path: str, tables: dict[str, DataFrame], about: dict) -> None:
    """Write ``tables`` under ``path``; ``about`` (settings, joins, hash) beside them."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/about.json", "w", encoding="utf-8") as f:
        json.dump(about | {"tables": sorted(tables)}, f, ensure_ascii=False, indent=1)


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    with open(f"{path}/about.json", encoding="utf-8") as f:
        about = json.load(f)
    return {name: spark.read.parquet(f"{path}/{name}") for name in about["tables"]}, about


def find(language: str, search: list[str], phoneset: str = "") -> str | None:
    """The first model directory for a language, with its phone set if there is one."""
    for place in search:
        for name in (f"{language}_{phoneset}" if phoneset else None, language, language.split("_")[0]):
            if name and os.path.exists(f"{place}/{name}/about.json"):
                return f"{place}/{name}"
    return None


def _scalar(text: str) -> object:
    if text[:1] in "\"'[{":
        return json.loads(text.replace("'", '"'))
    named = {"true": True, "false": False, "null": None, "~": None, "": None}
    if text.lower() in named:
        return named[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse_flat_yaml(text: str) -> dict:
    """Settings ``key: value`` line by line, with comments; what configurations hold of YAML."""
    out = {}
    for line in text.splitlines():
        body = line.split(" #")[0].strip() if not line.lstrip().startswith("#") else ""
        if body and body != "---":
            key, colon, value = body.partition(":")
            if not colon:
                raise ValueError(f"not a setting: {line!r}")
            out[key.strip()] = _scalar(value.strip())
    return out


def read_config(path: str, presets: dict[str, dict]) -> dict:
    """A preset by name, or a JSON, TOML or flat YAML file over the defaults."""
    if path in presets:
        return dict(presets[path])
    with open(path, "rb") as f:
        raw = f.read().decode()
    if path.endswith(".toml"):
        import tomllib

        told = tomllib.loads(raw)
    else:
        told = parse_flat_yaml(raw) if path.endswith((".yaml", ".yml")) else json.loads(raw)
    return presets["defaults"] | told


def write_config(config: dict, path: str) -> None:
    """Flat settings as JSON, TOML or YAML, by the file's ending."""
    toml = path.endswith(".toml")
    if not toml and not path.endswith((".yaml", ".yml")):
        text = json.dumps(config, ensure_ascii=False, indent=1)
    else:
        text = "".join(f"{k}{' = ' if toml else ': '}{json.dumps(v, ensure_ascii=False)}\n" for k, v in config.items() if v is not None or not toml)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
