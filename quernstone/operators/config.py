"""Experiment configuration: composition of layers, closed schemas, resolvers."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame

from quernstone.operators import packing


def compose(*layers: dict) -> dict:
    """Layers merged from left to right, the last one wins; nested maps are merged, everything else is replaced."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = compose(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def override(config: dict, *settings: str) -> dict:
    """``a.b=1`` settings from a command line; values are read as JSON where they are JSON, else as text."""
    import json

    for s in settings:
        path, _, text = s.partition("=")
        try:
            value: Any = json.loads(text)
        except ValueError:
            value = text
        for key in reversed(path.split(".")):
            value = {key: value}
        config = compose(config, value)
    return config


def resolve(config: dict) -> dict:
    """Values of the form ``["mul", a, b]``, ``["max", a, b]`` and ``["basename", x]``, where an operand may be ``"$a.b"``."""

    def at(x):
        if isinstance(x, str) and x.startswith("$"):
            value: Any = config
            for key in x[1:].split("."):
                value = value[key]
            return made(value)
        return made(x)

    def made(x):
        if isinstance(x, dict):
            return {k: made(v) for k, v in x.items()}
        if isinstance(x, list) and len(x) == 3 and x[0] == "mul":
            return at(x[1]) * at(x[2])
        if isinstance(x, list) and len(x) == 3 and x[0] == "max":
            return max(at(x[1]), at(x[2]))
        if isinstance(x, list) and len(x) == 2 and x[0] == "basename":
            return str(at(x[1])).rsplit("/", 1)[-1]
        return x

    return made(config)


def dumped(config: Any) -> str:
    """A configuration as JSON text with sorted keys, as it is kept beside a run; dataclasses are written as maps."""
    import json

    plain = dataclasses.asdict(config) if dataclasses.is_dataclass(config) else config
    return json.dumps(plain, indent=2, sort_keys=True, ensure_ascii=False)


def read_layers(folder: str, name: str, seen: tuple[str, ...] = ()) -> dict:
    """The configuration ``name`` of a folder, composed over those its ``defaults`` list names, in their order; ``_self_`` in
    the list is the place of its own values, by default the last. Files are JSON, or YAML where a reader is installed."""
    import json
    import os

    if name in seen:
        raise ValueError(f"defaults go in a circle: {' > '.join((*seen, name))}")
    path = next((f"{folder}/{name}.{x}" for x in ("json", "yaml", "yml") if os.path.isfile(f"{folder}/{name}.{x}")), None)
    if path is None:
        raise ValueError(f"no configuration {name}")
    with open(path, encoding="utf-8") as f:
        if path.endswith("json"):
            own = json.load(f)
        else:
            try:
                import yaml
            except ImportError:
                raise ValueError("no reader for YAML is installed") from None
            own = yaml.safe_load(f) or {}
    order = own.pop("defaults", [])
    layers = [own if x == "_self_" else read_layers(folder, x, (*seen, name)) for x in order]
    return compose(*layers, *([] if "_self_" in order else [own]))


def datasets(refs: str | list[str] | None) -> list[str]:
    """A dataset reference as a list of paths."""
    return [] if refs is None else [refs] if isinstance(refs, str) else list(refs)


@dataclass
class Stage:
    seq_len: int
    batch: int = 1
    accumulation: int = 1
    epochs: float = 1
    learning_rate: float = 2e-4
    max_steps: int = -1
    packing: bool = False
    prepack: bool = False


@dataclass
class Adapter:
    r: int = 16
    alpha: int = 32
    target_modules: list[str] | None = None


@dataclass
class Sources:
    cpt: str | list[str] | None = None
    sft: str | list[str] | None = None
    rl: str | list[str] | None = None


@dataclass
class Experiment:
    name: str
    model: str
    seed: int = 42
    eval_ratio: float = 0.1
    adapter: Adapter = field(default_factory=Adapter)
    sources: Sources = field(default_factory=Sources)
    cpt: Stage | None = None
    sft: Stage | None = None


def validated(kind: type, values: dict) -> Any:
    """``values`` as a closed dataclass: an unknown key, a missing one or a wrong type is an error."""
    fields = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := set(values) - set(fields):
        raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
    made = {}
    nested = {"adapter": Adapter, "sources": Sources, "cpt": Stage, "sft": Stage} if kind is Experiment else {}
    for k, v in values.items():
        if k in nested and isinstance(v, dict):
            v = validated(nested[k], v)
        want = str(fields[k].type)
        plain = {"int": int, "float": (int, float), "str": str, "bool": bool}.get(want)
        if plain and (not isinstance(v, plain) or isinstance(v, bool) and want != "bool"):
            raise ValueError(f"{k} must be {want}")
        made[k] = v
    try:
        return kind(**made)
    except TypeError as e:
        raise ValueError(str(e)) from None


def prepacked(experiment: Experiment, name: str, df: DataFrame, id_col: str, tokens: Column) -> tuple[DataFrame, bool]:
    """The rows a stage trains on, and whether its trainer packs them: rows packed here must not be packed again. Only a
    stage with packing is packed here, and only if the first stage asks for it."""
    stage = getattr(experiment, name)
    if stage.packing and experiment.cpt is not None and experiment.cpt.prepack:
        return packing.pack_documents(df, id_col, tokens, stage.seq_len), False
    return df, stage.packing


def stages(experiment: Experiment) -> list[str]:
    """The stages that run, in order: those with a dataset. Reinforcement learning is not implemented."""
    if experiment.sources.rl:
        raise NotImplementedError("the reinforcement stage is not implemented")
    return [s for s in ("cpt", "sft") if datasets(getattr(experiment.sources, s))]


def steps(experiment: Experiment, evaluated: bool = True) -> list[str]:
    """All steps of a run in order: each stage, with the fixed questions asked before the first and after every one."""
    order = stages(experiment)
    if not evaluated or not order:
        return order
    return ["eval before", *(x for s in order for x in (s, f"eval after {s}"))]


def run_directory(command: str, when) -> str:
    """Name of a run's directory, to the minute."""
    return f"{when:%Y%m%d-%H%M}-{command}"
