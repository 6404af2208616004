"""Named options, their rules, and objects built from configuration trees."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from ..operators import geodesics, losses, patches, spectral, surface_rows

#: Choices by option; rules between them are in ``checked``.
CHOICES = {
    "operator_mode": ("stiffness", "gradient"), "curvature_mode": ("weights", "gradient"), "laplacian_mode": ("stiffness", "anisotropic", "anisotropic_sparse"),
    "coefficients": ("uniform", "normal"), "sampler": tuple(surface_rows.SAMPLERS), "reduction": ("mean", "sum", "none"), "contrastive": ("infonce", "dcl", "dclw"),
    "probes": ("random", "coordinates"), "basis": tuple(spectral.PROVIDERS), "features": tuple(patches.EXTRACTORS), "pose": tuple(patches.TRANSFORMERS), "sources": ("centroid", "random", "mixed", "farthest"),
}


def checked(**options: str) -> dict[str, str]:
    """The options if all are known and fit together, else a ValueError that names the fault."""
    for name, value in options.items():
        if name not in CHOICES:
            raise ValueError(f"unknown option: {name}")
        if value not in CHOICES[name]:
            raise ValueError(f"{name} must be one of {', '.join(CHOICES[name])}, not {value}")
    if options.get("operator_mode", "stiffness") == "stiffness":
        if options.get("curvature_mode", "weights") == "gradient" or options.get("laplacian_mode", "stiffness") != "stiffness":
            raise ValueError("coefficients exist only in the gradient mode")
    return options


#: What a configuration may name.
TARGETS: dict[str, Callable[..., Any]] = {
    "sampler.regular": surface_rows.regular_sampler, "sampler.random": surface_rows.random_sampler, "pose.random_rotation": patches.random_rotation, "pose.align_normal": lambda: patches.align_normal,
    "loss.tangent_projector": lambda: losses.tangent_projector, "loss.gram_off_diagonal": lambda: losses.gram_off_diagonal, "distance.heat": lambda: geodesics.mesh_geodesics, "distance.edges": lambda: geodesics.edge_geodesics, "distance.exact": lambda: geodesics.exact_geodesics,
}


def register(name: str, target: Callable[..., Any]) -> None:
    TARGETS[name] = target


def built(config: Any) -> Any:
    """The object that a tree of dicts and lists describes: a dict with ``target`` is a call with the built rest."""
    if isinstance(config, list):
        return [built(c) for c in config]
    if not isinstance(config, dict):
        return config
    rest = {k: built(v) for k, v in config.items() if k != "target"}
    if "target" not in config:
        return rest
    if config["target"] not in TARGETS:
        raise ValueError(f"unknown target: {config['target']}")
    return TARGETS[config["target"]](**rest)
