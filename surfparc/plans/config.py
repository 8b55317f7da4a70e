"""Run configuration: every key is required; unknown keys, and keys that would change nothing here, are refused."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from surfparc.plans.group_prior import Training
from surfparc.plans.parcellation import VARIANTS, Settings

MODES = {"modeA_single": False, "modeA_batch": False, "modeB_train_prior": True}
POSITIVE, NON_NEGATIVE, SHARE, ANY, OPTIONAL = "positive", "non-negative", "share", "any", "optional"

# The keys of each block with type and admissible range.
BLOCKS: dict[str, dict[str, tuple]] = {
    "": {
        "schema_version": (str, ("2",)), "mode": (str, tuple(MODES)), "variant": (str, ANY), "num_clusters": (int, POSITIVE),
        "beta_scalar": (int, NON_NEGATIVE), "w": (int, POSITIVE), "c": (int, NON_NEGATIVE), "n_grad_components": (int, POSITIVE),
    },
    "step0": {
        "sub_FC": (int, POSITIVE), "sub_verts": (int, POSITIVE), "block_a": (int, POSITIVE), "smooth_sigma": (float, POSITIVE),
        "K_hop": (int, POSITIVE), "watershed_steps": (int, POSITIVE), "watershed_frac": (float, POSITIVE),
        "save_geodesic_distance": (bool, ANY), "save_edge_density": (bool, ANY),
    },
    "step1": {
        "threshold": (float, SHARE), "radius_mask_radius_mm": (float, POSITIVE),
    },
    "step2": {
        "max_iter_inter": (int, POSITIVE), "max_iter_intra_em": (int, POSITIVE), "max_iter_em": (int, POSITIVE), "max_iter_m": (int, POSITIVE),
        "max_iter_intra_var": (int, POSITIVE), "epsilon": (float, POSITIVE), "intra_em_convergence_eps": (float, POSITIVE), "inter_convergence_eps": (float, POSITIVE),
        "em_convergence_eps": (float, POSITIVE),
    },
    "step3": {
        "connect_th": (float, OPTIONAL), "epsilon": (float, POSITIVE), "max_iter_intra_em": (int, POSITIVE), "max_iter_em": (int, POSITIVE), "max_iter_lambda": (int, POSITIVE),
        "max_iter_m": (int, POSITIVE), "max_iter_comp": (int, POSITIVE), "isolated_component_min_size": (int, POSITIVE),
    },
}


@dataclass(frozen=True)
class Config:
    mode: str
    variant: str
    top: dict
    step0: dict
    step1: dict
    step2: dict | None
    step3: dict

    @property
    def trains(self) -> bool:
        return MODES[self.mode]

    def settings(self, sessions: int, n_vertices: int) -> Settings:
        t, s = self.top, self.step3
        return Settings(
            sessions, t["num_clusters"], n_vertices, t["w"], t["c"], t["beta_scalar"], s["epsilon"], s["max_iter_intra_em"], s["max_iter_em"], s["max_iter_lambda"],
            s["max_iter_m"], s["max_iter_comp"], s["isolated_component_min_size"], connect_distance=s["connect_th"],
        )

    def training(self, sessions: int, n_subjects: int) -> Training:
        s = self.step2
        beta = self.top["beta_scalar"] * VARIANTS[self.variant].beta_scale if VARIANTS[self.variant].gradient_prior else 0.0
        return Training(
            sessions, n_subjects, beta, s["max_iter_inter"], s["max_iter_intra_em"], s["max_iter_em"], s["max_iter_m"], s["max_iter_intra_var"], s["epsilon"],
            s["intra_em_convergence_eps"], s["inter_convergence_eps"], s["em_convergence_eps"],
        )


def _check(block: str, raw: dict) -> dict:
    spec, where = BLOCKS[block], f"{block}." if block else ""
    if not isinstance(raw, dict):
        raise ValueError(f"{block} must be an object")
    unknown = sorted(k for k in raw if k not in spec and not (block == "" and k in BLOCKS))
    if unknown:
        raise ValueError(f"unknown keys {unknown} in {block or 'the configuration'}")
    out = {}
    for key, (kind, rule) in spec.items():
        if key not in raw:
            raise ValueError(f"missing required key '{where}{key}'")
        v = raw[key]
        if v is None and rule == OPTIONAL:
            out[key] = None
            continue
        if isinstance(v, bool) != (kind is bool) or not isinstance(v, (int, float) if kind is float else kind):
            raise ValueError(f"{where}{key} must be {kind.__name__}, got {v!r}")
        if kind is float:
            v = float(v)
            if not math.isfinite(v):
                raise ValueError(f"{where}{key} must be finite")
        if isinstance(rule, tuple) and v not in rule:
            raise ValueError(f"{where}{key} must be one of {list(rule)}, got {v!r}")
        if rule == POSITIVE and v <= 0:
            raise ValueError(f"{where}{key} must be positive")
        if rule in (NON_NEGATIVE, OPTIONAL) and v < 0:
            raise ValueError(f"{where}{key} must be >= 0")
        if rule == SHARE and not 0.0 <= v <= 1.0:
            raise ValueError(f"{where}{key} must be in [0, 1]")
        out[key] = v
    return out


def parse_config(raw: dict) -> Config:
    top = _check("", raw)
    needed = {"step0", "step1", "step3"} | ({"step2"} if MODES[top["mode"]] else set())
    given = {k for k in raw if k.startswith("step")}
    if needed - given:
        raise ValueError(f"mode {top['mode']} needs blocks {sorted(needed - given)}")
    if given - needed:
        raise ValueError(f"mode {top['mode']} does not run {sorted(given - needed)}; remove them")
    if top["num_clusters"] % 2:
        raise ValueError("num_clusters must be even: half per hemisphere")
    variant = top["variant"]
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}; known are {sorted(VARIANTS)}")
    if MODES[top["mode"]] and variant == "contiguous":
        raise ValueError("the contiguous variant trains no prior; use one of another variant")
    blocks = {k: _check(k, raw[k]) if k in needed else None for k in ("step0", "step1", "step2", "step3")}
    return Config(top["mode"], variant, top, **blocks)


def read_config(path: str) -> Config:
    with open(path, encoding="utf-8-sig") as f:
        return parse_config(json.load(f))
