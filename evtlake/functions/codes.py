"""Fixed values of the event format: names, codes and default settings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# --- fixed values -----------------------------------------------------------

# morphology name -> stored raw code
RAW_CODES = {
    "0T0C": 0,
    "0T1C": 1,
    "0TnC": 2,
    "1T0C": 3,
    "1T1C": 4,
    "1TnC": 5,
    "2TnC": 6,
    "Background": 7,
    "BackGround": 7,
}
UNKNOWN_CODE = -1
UNKNOWN_NAME = "Unknown"

# morphology name -> topology code (0 track, 1 cascade, 2 mixed)
TOPOLOGY_CODES = {
    "0T0C": 0,
    "1T0C": 0,
    "Background": 0,
    "BackGround": 0,
    "0T1C": 1,
    "0TnC": 2,
    "1T1C": 2,
    "1TnC": 2,
    "2TnC": 2,
}

STARTING_NAMES = ("0T1C", "0TnC", "1T1C", "1TnC", "2TnC")

# raw code -> class of the default two-class task (1 = starting)
DEFAULT_CLASSES = {0: 0, 1: 1, 2: 1, 3: 0, 4: 1, 5: 1, 6: 1, 7: 0}

# name -> class when a nested reader is given no mapping
DEFAULT_NAMED_CLASSES = {"Track": 0, "Cascade": 1, "Mixed": 2}

# sensor field -> nested input column
SENSOR_COLUMNS = {
    "x": "pulse_sensor_pos_x",
    "y": "pulse_sensor_pos_y",
    "z": "pulse_sensor_pos_z",
    "t_first": "pulse_summary_t_first",
    "t_last": "pulse_summary_t_last",
    "t20": "pulse_summary_t20",
    "t50": "pulse_summary_t50",
    "t_mean": "pulse_summary_t_mean",
    "t_std": "pulse_summary_t_std",
    "c_total": "pulse_summary_c_total",
    "c_500ns": "pulse_summary_c_500ns",
    "c_100ns": "pulse_summary_c_100ns",
}
TRUTH_COLUMNS = (
    "mc_primary_energy",
    "mc_primary_dir_x",
    "mc_primary_dir_y",
    "mc_primary_dir_z",
)
MORPHOLOGY_COLUMN = "mc_event_morphology"
VERTEX_COLUMN = "physics_vertex_position"

COORDINATES = ("x", "y", "z", "t_first")
FEATURES = (
    "c_total", "c_500ns", "c_100ns",
    "t_first", "t_last", "t20", "t50", "t_mean", "t_std",
)

# --- lookups ----------------------------------------------------------------


def code_map(mapping: Mapping) -> Column:
    """A literal Spark map; these tables hold about ten entries."""
    return F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])


def lookup(mapping: Mapping, key: Column, default) -> Column:
    """``mapping[key]`` with a default for absent and NULL keys."""
    return F.coalesce(F.try_element_at(code_map(mapping), key), F.lit(default))


def names_by_code() -> dict[int, str]:
    """Raw code -> display name; the first spelling of a code wins."""
    names: dict[int, str] = {}
    for name, code in RAW_CODES.items():
        names.setdefault(code, name)
    return names


@dataclass(frozen=True)
class WeightTiers:
    """Sampling weights of upgoing starting events by energy (GeV), highest tier first."""

    tiers: tuple[tuple[str, float, float], ...] = (
        ("very_high_upgoing", 1e6, 20.0),
        ("high_upgoing", 1e5, 10.0),
        ("med_upgoing", 1e4, 3.0),
    )
    default: float = 1.0

    @classmethod
    def from_options(cls, options: Mapping) -> "WeightTiers":
        """Read ``e_<tier>``, ``w_<tier>_upgoing`` and ``w_default``; absent keys keep defaults."""
        base = cls()
        tiers = []
        for name, energy, weight in base.tiers:
            short = name.removesuffix("_upgoing")
            tiers.append((
                name,
                float(options.get(f"e_{short}", energy)),
                float(options.get(f"w_{name}", weight)),
            ))
        return cls(tuple(tiers), float(options.get("w_default", base.default)))


def class_names(mapping: Mapping[int, int], num_classes: int) -> list[str]:
    """Display name per class: the raw names mapped to it joined with ``+``."""
    names = names_by_code()
    members: dict[int, list[str]] = {}
    for code in sorted(mapping):
        members.setdefault(int(mapping[code]), []).append(names.get(code, f"Morph {code}"))
    return ["+".join(members.get(c, [f"Class {c}"])) for c in range(num_classes)]


def name_ranks(names: Iterable[str]) -> dict[str, int]:
    """Number the sorted names, as the nested reader numbers its mapping keys."""
    return {name: i for i, name in enumerate(sorted(names))}
