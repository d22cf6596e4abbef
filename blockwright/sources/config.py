"""Settings from nested YAML, as typed values with their defaults; unknown keys are ignored."""

from __future__ import annotations

from blockwright.operators.codec import CodecConfig
from blockwright.operators.environment import RewardConfig


def load_yaml(path: str) -> dict:
    import yaml

    with open(path) as f:
        return yaml.safe_load(f) or {}


def _part(tree: dict, name: str) -> dict:
    value = tree.get(name)
    return value if isinstance(value, dict) else {}


def codec_config(tree: dict) -> CodecConfig:
    """encoder, format and policy sections. Without a policy the fixed-margin rule holds; compression is zlib unless named otherwise."""
    enc, fmt, pol = (_part(tree, n) for n in ("encoder", "format", "policy"))
    comp = _part(enc, "compression")
    kind = str(pol.get("algorithm", pol.get("type", "fixed_margin"))).lower()
    return CodecConfig(
        policy=kind if kind in ("constant", "budget") else "fixed_margin", q=int(enc.get("default_q", 12)), k=int(enc.get("default_K", 5)), h_high=int(pol.get("h_high", enc.get("default_H", 8))), h_low=int(pol.get("h_low", 0)),
        margin=float(pol.get("score_margin_thresh", 0.06)), q_bounds=tuple(pol.get("q_bounds", (10, 20))), k_bounds=tuple(pol.get("K_bounds", (3, 6))), version=int(fmt.get("version", 1)), compression=comp.get("type", comp.get("name", "zlib")), level=int(comp.get("level", 6)),
    )


def split_settings(tree: dict) -> dict:
    enc = _part(tree, "encoder")
    split, block = _part(enc, "split"), int(enc.get("block_size", 32))
    return {"min_block": int(enc.get("min_block", block)), "max_block": int(enc.get("max_block", block)), "var_threshold": float(split.get("var_thresh", 0.0025)), "grad_threshold": float(split.get("grad_thresh", 0.020))}


def reward_config(tree: dict) -> RewardConfig:
    own = _part(tree, "rl") or _part(tree, "reward")
    names = RewardConfig.__dataclass_fields__
    return RewardConfig(**{k: v for k, v in own.items() if k in names})
