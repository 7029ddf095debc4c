"""Declarative pipelines: a catalogue of stages with typed parameters, checked specifications, sweeps and plugin stages.

A specification is a list of steps {id, stage, params, enabled}. It is checked against the catalogue on the driver and
then composed into one lazy DataFrame; nothing runs until the result is used.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Parameter:
    """A stage's parameter: its kind (number, integer, string, boolean, any), default and bounds."""

    kind: str = "any"
    default: Any = None
    low: float | None = None
    high: float | None = None
    choices: tuple = ()

    def problem(self, value: Any) -> str | None:
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        if self.kind == "number" and not number or self.kind == "integer" and not (number and isinstance(value, int)):
            return f"is no {self.kind}"
        if self.kind == "string" and not isinstance(value, str) or self.kind == "boolean" and not isinstance(value, bool):
            return f"is no {self.kind}"
        if self.choices and value not in self.choices:
            return f"is none of {', '.join(map(str, self.choices))}"
        if self.low is not None and number and value < self.low:
            return f"is below {self.low}"
        if self.high is not None and number and value > self.high:
            return f"is above {self.high}"
        return None


@dataclass(frozen=True)
class Stage:
    """A stage: f(DataFrame, **params) -> DataFrame, its place in the order of stages, what it needs and gives."""

    name: str
    f: Callable[..., DataFrame]
    order: int
    needs: str
    gives: str
    parameters: Mapping[str, Parameter] = field(default_factory=dict)


class Registry:
    """Stages by name; plugins add their own."""

    def __init__(self, stages: Sequence[Stage] = ()):
        self.stages: dict[str, Stage] = {}
        for s in stages:
            self.add(s)

    def add(self, stage: Stage) -> None:
        if stage.name in self.stages:
            raise ValueError(f"stage {stage.name} is registered already")
        self.stages[stage.name] = stage

    def problems(self, spec: Mapping[str, Any]) -> list[str]:
        """What is wrong with a specification; empty if nothing."""
        found, seen, last, have = [], set(), -1, spec.get("source", "frames")
        for k, step in enumerate(spec.get("steps", [])):
            name = step.get("id", f"step {k + 1}")
            if name in seen:
                found.append(f"{name}: the id is used twice")
            seen.add(name)
            stage = self.stages.get(step.get("stage", ""))
            if stage is None:
                found.append(f"{name}: no stage {step.get('stage')}")
                continue
            if not step.get("enabled", True):
                continue
            if stage.order < last:
                found.append(f"{name}: {stage.name} comes before the step ahead of it")
            if stage.needs not in (have, "any"):
                found.append(f"{name}: needs {stage.needs}, but has {have}")
            last, have = stage.order, have if stage.gives == "same" else stage.gives
            for key, value in step.get("params", {}).items():
                if key not in stage.parameters:
                    found.append(f"{name}: no parameter {key}")
                elif problem := stage.parameters[key].problem(value):
                    found.append(f"{name}: {key} {problem}")
        return found

    def run(self, spec: Mapping[str, Any], data: DataFrame) -> DataFrame:
        """The specification's steps applied to data, as one lazy plan; disabled steps are left out."""
        if found := self.problems(spec):
            raise ValueError("; ".join(found))
        for step in spec.get("steps", []):
            if step.get("enabled", True):
                stage = self.stages[step["stage"]]
                defaults = {k: p.default for k, p in stage.parameters.items()}
                data = stage.f(data, **(defaults | dict(step.get("params", {}))))
        return data


def parameter_hash(spec: Mapping[str, Any]) -> str:
    """SHA-256 of what decides a result: steps, parameters and sweep, but no labels, ids or paths."""
    steps = [{"stage": s["stage"], "params": s.get("params", {})} for s in spec.get("steps", []) if s.get("enabled", True)]
    kept = {"steps": steps, "parameters": spec.get("parameters", {}), "sweep": spec.get("sweep", {})}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def sweep(spec: Mapping[str, Any], factors: Mapping[str, Sequence[Any]]) -> list[dict[str, Any]]:
    """A specification for each combination of factor values ("step.parameter"), the last factor changing fastest."""
    out = []
    for k, values in enumerate(itertools.product(*factors.values()), 1):
        new = json.loads(json.dumps(spec))
        for path, value in zip(factors, values, strict=True):
            step, _, key = path.partition(".")
            own = [s for s in new["steps"] if step in (s.get("id"), s.get("stage"))]
            if len(own) != 1:
                raise ValueError(f"{path} fits {len(own)} steps")
            own[0].setdefault("params", {})[key] = value
        new["id"] = f"{spec.get('id', 'run')}__sweep_{k:03d}"
        out.append(new)
    return out


def sweep_frame(spark: SparkSession, factors: Mapping[str, Sequence[Any]]) -> DataFrame:
    """The combinations of factor values as rows, with run_id."""
    rows = [(f"run_{k:03d}", *values) for k, values in enumerate(itertools.product(*factors.values()), 1)]
    return spark.createDataFrame(rows, ["run_id", *factors])


def merged_manifests(first: Sequence[dict], second: Sequence[dict], key: str = "run_id", replace: bool = False) -> list[dict]:
    """Two lists of run records; a later one takes the place of an earlier one with its key, or is an error."""
    out = {x[key]: x for x in first}
    if len(out) < len(first):
        raise ValueError("a manifest names a run twice")
    for x in second:
        if x[key] in out and not replace:
            raise ValueError(f"run {x[key]} is in both manifests")
        out[x[key]] = x
    return list(out.values())


def default_registry() -> Registry:
    """The built-in stages over frames, long pixel tables and detections."""
    from ..operators import scans, signal, video

    number = lambda default, low=None, high=None: Parameter("number", default, low, high)
    whole = lambda default, low=None, high=None: Parameter("integer", default, low, high)
    return Registry(
        [
            Stage("pixels", signal.pixels, 10, "frames", "pixels"),
            Stage("robust_z", lambda df, floor: signal.robust_z(df, "frame", "v", floor).drop("v").withColumnRenamed("z", "v"), 50, "pixels", "pixels", {"floor": number(1e-6, 0)}),
            Stage("projections", lambda df, active: signal.projections(df, active), 55, "pixels", "projection", {"active": number(2.0)}),
            Stage("annular_cfar", lambda df, guard, ring, false_alarm: signal.cfar_detections(df, guard, ring, false_alarm), 50, "frames", "detections", {"guard": whole(1, 0), "ring": whole(5, 1), "false_alarm": number(0.05, 1e-12, 1)}),
            Stage("components", lambda df, threshold, least, eight: signal.components(df, threshold, least, None, eight), 55, "frames", "detections", {"threshold": number(2.0), "least": whole(1, 1), "eight": Parameter("boolean", True)}),
            # the stages below bear the names and defaults that written specifications use
            Stage("temporal_highpass_gaussian", video.temporal_highpass, 20, "frames", "frames", {"sigma_frames": number(6.0, 0.1, 120)}),
            Stage("spatial_gaussian", video.spatial_gaussian, 30, "frames", "frames", {"sigma_px": number(0.8, 0, 10)}),
            Stage("rigid_shift_estimate", video.registered, 35, "frames", "frames", {"max_shift_px": whole(4, 1, 50), "reference": Parameter("string", "first", choices=("first", "mean"))}),
            Stage("robust_positive_local_z", video.frame_robust_z, 50, "frames", "scores", {"local_radius_px": whole(11, 1, 101), "epsilon": number(1.0, 0, 100)}),
            Stage("gamma_cfar", video.cfar_mask, 50, "frames", "mask", {"pfa": number(0.001, 0, 1), "guard_px": whole(2, 0, 100), "training_radius_px": whole(11, 1, 101), "epsilon": number(1e-6, 0, 100)}),
            Stage("adaptive_gamma_cfar", video.cfar_mask, 50, "frames", "mask", {"pfa": number(0.001, 0, 1), "guard_px": whole(2, 0, 100), "training_radius_px": whole(11, 1, 101), "update_alpha": number(0.02, 0.0001, 1)}),
            Stage("adaptive_ewma_z", video.ewma_scores, 50, "frames", "scores", {"alpha": number(0.02, 0.0001, 1), "threshold_z": number(3.0, 0, 20), "epsilon": number(1.0, 0, 100)}),
            Stage("component_filter", video.projected_components, 55, "scores", "candidates", {"seed_z": number(2.0, 0, 20), "grow_z": number(1.1, 0, 20), "min_area_px": whole(8, 1, 100000), "max_area_px": whole(260, 1, 100000)}),
            Stage("event_preserving_noise_suppression", video.event_preserving_z, 30, "frames", "scores", {"spatial_sigma_px": number(1.0, 0, 10), "temporal_window_frames": whole(3, 1, 101)}),
            Stage("candidate_event_pipeline", video.candidate_events, 50, "scores", "events", {"event_threshold_z": number(2.4, 0, 20), "min_area_px": whole(4, 1, 100000)}),
            Stage("trace_event_scoring", scans.trace_events, 60, "traces", "events", {"event_threshold_z": number(2.4, 0, 20)}),
            Stage("robust_kalman_positive_innovation", scans.innovation_events, 60, "traces", "events", {"event_threshold_z": number(2.4, 0, 20), "kalman_gain": number(0.06, 0, 1), "spike_gain": number(0.008, 0, 1)}),
            Stage("heuristic_priority_v1", video.prioritised, 80, "candidates", "ranked", {"local_correlation_weight": number(0.2, -5, 5), "event_support_weight": number(0.2, -5, 5), "artifact_weight": number(-0.15, -5, 5)}),
        ]
    )


# Parameters of the ready-made sweeps.
PRESETS = {
    "permissive": {"event_threshold_z": 2.0, "seed_z": 1.6, "grow_z": 0.8, "min_area_px": 4},
    "balanced": {"event_threshold_z": 2.4, "seed_z": 2.0, "grow_z": 1.1, "min_area_px": 8},
    "strict": {"event_threshold_z": 2.8, "seed_z": 2.4, "grow_z": 1.4, "min_area_px": 12},
    "artifact_suppression": {"event_threshold_z": 2.6, "seed_z": 2.2, "grow_z": 1.3, "min_area_px": 10},
    "high_recall": {"event_threshold_z": 1.8, "seed_z": 1.4, "grow_z": 0.7, "min_area_px": 3},
}


def preset_runs(spec: Mapping[str, Any], registry: Registry | None = None) -> list[dict[str, Any]]:
    """A specification for each preset: every step gets the preset's values for the parameters that its stage has."""
    known, out = (registry or default_registry()).stages, []
    for name, values in PRESETS.items():
        new = json.loads(json.dumps(spec))
        for step in new["steps"]:
            own = known[step["stage"]].parameters if step["stage"] in known else {}
            step.setdefault("params", {}).update({k: v for k, v in values.items() if k in own})
        out.append(new | {"id": f"{spec.get('id', 'run')}_{name}"})
    return out
