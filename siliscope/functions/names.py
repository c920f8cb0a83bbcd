"""Which columns of a feature table are searched on: decided by name, before any row is read."""
from __future__ import annotations

from collections.abc import Iterable

from siliscope import constants as C


def is_location_aware(name: str) -> bool:
    return name.startswith(("polar_", "stby_polar_"))


def is_observable(name: str, extra_excluded: Iterable[str] = (), location_aware: bool = False) -> bool:
    """Neither an identifier, nor knowledge that exists on labelled data only, nor (by default) location-aware."""
    if name in C.NON_FEATURE_COLUMNS or name in set(extra_excluded):
        return False
    if name.startswith("label_") or name.endswith("_mask_ratio"):
        return False
    return location_aware or not is_location_aware(name)


def observable(columns: list[str], extra_excluded: Iterable[str] = (), location_aware: bool = False) -> list[str]:
    return [c for c in columns if is_observable(c, extra_excluded, location_aware)]


def shared_observable(query: list[str], reference: list[str], location_aware: bool = False) -> list[str]:
    """Searchable columns of the reference, in its order, that the query table also has."""
    have = set(query)
    return [c for c in observable(reference, location_aware=location_aware) if c in have]


# fixed values: column rules per defect class: (prefixes, exact names)
CLASS_COLUMNS = {
    "edge": (("edge_",), ("center_density", "radial_zone_04_severity")),
    "shot_grid": (("shot_",), ()),
    "stby_pattern": ((), ("stby_ratio",)),
    "ring": (("ring_", "radial_zone_"), ()),
    "scratch": (("scratch_", "angular_sector_"), ()),
    "local": (("local_", "morph_"), ()),
}
# fixed values: search interests and the class each one targets
CRITERIA = {"overall": None, "edge_focus": "edge", "shot_focus": "shot_grid", "stby_focus": "stby_pattern",
            "ring_focus": "ring", "scratch_focus": "scratch", "local_focus": "local"}
POLAR_CLASSES = ("edge", "scratch", "local")
LOCATION_KINDS = ("class_location", "feature_key")


def class_columns(columns: list[str], cls: str, kind: str = "class") -> list[str]:
    """Columns that answer for one defect class; location-aware ones only for location targets."""
    compact = [c for c in columns if not is_location_aware(c)]
    if cls not in CLASS_COLUMNS:
        return compact
    prefixes, exact = CLASS_COLUMNS[cls]
    out = [c for c in compact if c.startswith(prefixes) or c in exact]
    if kind in LOCATION_KINDS and cls in POLAR_CLASSES:
        out += [c for c in columns if c.startswith("polar_")]
    if kind in LOCATION_KINDS and cls == "stby_pattern":
        out += [c for c in columns if c.startswith("stby_polar_")]
    return out


def criterion_columns(columns: list[str], criterion: str) -> list[str]:
    cls = CRITERIA[criterion]
    compact = [c for c in columns if not is_location_aware(c)]
    return compact if cls is None else class_columns(compact, cls)


# fixed values: feature families in order of precedence: (family, prefixes, exact names)
FAMILIES = (
    ("global", (), ("total_fail_density", "grade_weighted_severity")),
    ("stby", (), ("stby_ratio",)),
    ("stby_spatial", ("stby_polar_",), ()),
    ("radial", ("radial_zone_",), ()),
    ("angular", ("angular_sector_",), ()),
    ("polar_spatial", ("polar_",), ()),
    ("edge", ("edge_",), ("center_density",)),
    ("ring_scratch_morphology", ("ring_", "scratch_"), ()),
    ("local_morphology", ("local_",), ()),
    ("shot", ("shot_",), ()),
)


def family_of(name: str) -> str:
    return next((f for f, prefixes, exact in FAMILIES if name in exact or (prefixes and name.startswith(prefixes))),
                "other")


def family_map(columns: list[str]) -> dict[str, list[str]]:
    order = [f for f, _, _ in FAMILIES] + ["other"]
    grouped = {f: [c for c in columns if family_of(c) == f] for f in order}
    return {f: cs for f, cs in grouped.items() if cs}
