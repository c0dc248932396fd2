"""Benchmark and model specifications from YAML or JSON text, paths or dicts."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BenchmarkSpec:
    name: str
    hf_id: str | None = None
    split: str = "test"
    revision: str | None = None
    task: str = "multiple_choice"
    n_options: int | None = None
    languages: tuple[str, ...] = ()
    source_language: str = "en"
    item_id_field: Any = None
    fields: dict = field(default_factory=dict)
    max_items: int | None = None
    seed: int = 0
    #: what the specification says beyond the fields above
    extra: dict = field(default_factory=dict)

    @property
    def usable(self) -> bool:
        return bool(self.hf_id) and len(self.languages) > 0


@dataclass(frozen=True)
class ModelSpec:
    name: str
    hf_id: str | None = None
    revision: str | None = None
    tier: int = 1
    params_b: float = 0.0
    extra: dict = field(default_factory=dict)


def _read(given: str | Path | dict) -> dict:
    if isinstance(given, dict):
        return given
    text = Path(given).read_text(encoding="utf-8") if isinstance(given, Path) or "\n" not in given else given
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def _split(kind: type, raw: dict) -> dict:
    own = {f.name for f in fields(kind)} - {"extra"}
    return {k: v for k, v in raw.items() if k in own} | {"extra": {k: v for k, v in raw.items() if k not in own}}


def load_specs(given: str | Path | dict) -> dict[str, BenchmarkSpec]:
    """Each entry laid over the defaults; unknown keys go to ``extra``."""
    raw = _read(given)
    out = {}
    for name, own in (raw.get("benchmarks") or {}).items():
        merged = (raw.get("defaults") or {}) | (own or {}) | {"name": name}
        merged["languages"] = tuple(merged.get("languages") or ())
        merged["fields"] = dict(merged.get("fields") or {})
        out[name] = BenchmarkSpec(**_split(BenchmarkSpec, merged))
    return out


def load_models(given: str | Path | dict, tiers: tuple[int, ...] = (1, 2)) -> list[ModelSpec]:
    """The grid of the given tiers, by tier, then smallest first."""
    raw = _read(given)
    entries = raw.get("models") or []
    entries = [v | {"name": k} for k, v in entries.items()] if isinstance(entries, dict) else entries
    grid = [ModelSpec(**_split(ModelSpec, (raw.get("defaults") or {}) | e)) for e in entries]
    return sorted((m for m in grid if m.tier in tiers), key=lambda m: (m.tier, m.params_b))


def specs_frame(spark: SparkSession, specs: dict[str, BenchmarkSpec]) -> DataFrame:
    rows = [(s.name, s.hf_id, s.split, s.task, list(s.languages), s.source_language, s.max_items, s.seed, s.usable) for s in specs.values()]
    return spark.createDataFrame(rows, "name string, hf_id string, split string, task string, languages array<string>, source_language string, max_items int, seed long, usable boolean")


def specs_over(rows: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Benchmark specifications kept as rows: the frame of ``specs_frame`` from ``rows`` (name and any of its other columns), each laid over the defaults.

    A column that is missing or null takes the default, else ``BenchmarkSpec``'s own; languages are distinct and sorted. Nothing passes through the driver. Defined results:
    a null name is an error when it is read, names that repeat stay, an empty table gives an empty frame, columns beyond those of the frame are left out.
    """
    kinds = {"hf_id": "string", "split": "string", "task": "string", "languages": "array<string>", "source_language": "string", "max_items": "int", "seed": "long"}
    base = BenchmarkSpec("")
    if unknown := set(defaults or {}) - set(kinds):
        raise ValueError(f"no such fields: {sorted(unknown)}")
    value = lambda c: (defaults or {}).get(c, getattr(base, c))
    plain = lambda c: (F.array(*[F.lit(x) for x in value(c)]) if c == "languages" else F.lit(value(c))).cast(kinds[c])
    over = lambda c: F.coalesce(F.col(c).cast(kinds[c]), plain(c)) if c in rows.columns else plain(c)
    name = F.coalesce("name", F.raise_error(F.lit("a specification has no name")).cast("string"))
    out = rows.select(name.alias("name"), *[(F.array_sort(F.array_distinct(over(c))) if c == "languages" else over(c)).alias(c) for c in kinds])
    usable = (F.coalesce("hf_id", F.lit("")) != "") & (F.size("languages") > 0)
    return out.select("name", "hf_id", "split", "task", "languages", "source_language", "max_items", "seed", usable.alias("usable"))


def grid_over(models: DataFrame, tiers: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(place, name, tier, params_b): the models (name, tier, params_b) of the tiers, by tier, then smallest first, then by name.

    A null tier is tier 1 and null parameters are 0, as in ``ModelSpec``. Models are few: their places are one window over all of them.
    """
    t, size = F.coalesce(F.col("tier"), F.lit(ModelSpec("").tier)).cast("int"), F.coalesce(F.col("params_b"), F.lit(ModelSpec("").params_b)).cast("double")
    of = models.select("name", t.alias("tier"), size.alias("params_b")).where(F.col("tier").isin(*tiers))
    return of.select((F.row_number().over(Window.orderBy("tier", "params_b", "name")) - 1).cast("long").alias("place"), "name", "tier", "params_b")


def matching_mode(specs: DataFrame, mode: str) -> DataFrame:
    """Generative tasks go with generative scoring only, and the other way round."""
    return specs.where((F.col("task") == "generative") == F.lit(mode == "generative"))
