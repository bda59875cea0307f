"""Canonical field names of sensor recordings and the mapping of a table's columns onto them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of fields and the spellings they are known by.
ALIASES: dict[str, tuple[str, ...]] = {
    "timestamp": ("time", "time_s", "time_sec", "time_secs", "time_seconds", "elapsed_time", "elapsed_seconds"),
    "sensor_id": ("sensorid", "device_id", "deviceid"),
    "reference": ("reference_value", "ground_truth", "groundtruth", "truth"),
    "measurement": ("measured_value", "sensor_value", "sensor_output", "output"),
    "temperature": ("temperature_c", "temperature_deg_c", "temp", "temp_c", "temp_deg_c"),
    "humidity": ("relative_humidity", "rh", "rh_percent"),
    "supply_voltage": ("supply_v", "vcc", "vdd"),
    "revision": ("device_revision", "hardware_revision", "hw_revision"),
    "test_cycle": ("cycle", "cycle_number", "test_cycle_number"),
    "sweep_direction": ("sweep", "direction"),
    "orientation_label": ("orientation", "static_orientation", "pose_label"),
    "motion_state": ("motion", "state"),
    "experiment_label": ("experiment", "test_label", "run_label"),
    "roll": ("roll_angle",),
    "pitch": ("pitch_angle",),
    "yaw": ("yaw_angle", "heading"),
    "quaternion_w": ("quat_w", "qw"),
}
# Families with one field per axis; {} is the axis.
AXIS_ALIASES: dict[str, tuple[str, ...]] = {
    "a{}": ("accel_{}", "acceleration_{}", "accelerometer_{}", "acc_{}"),
    "g{}": ("gyro_{}", "gyroscope_{}", "angular_velocity_{}", "angular_rate_{}", "omega_{}"),
    "a{}_reference": ("a{}_ref", "accel_{}_reference", "acceleration_{}_reference", "ground_truth_a{}", "truth_a{}"),
    "g{}_reference": ("g{}_ref", "gyro_{}_reference", "angular_rate_{}_reference", "ground_truth_g{}", "truth_g{}"),
    "position_{}": ("pos_{}", "position_{}_m"),
    "velocity_{}": ("vel_{}",),
    "quaternion_{}": ("quat_{}", "q{}"),
}
FIELDS: dict[str, tuple[str, ...]] = ALIASES | {f.format(a): tuple(x.format(a) for x in names) for f, names in AXIS_ALIASES.items() for a in "xyz"}
LABELS = ("sensor_id", "revision", "sweep_direction", "orientation_label", "motion_state", "experiment_label")


def normalised(name: str) -> str:
    """A column name in lower case with one underscore for every run of other characters."""
    text = name.strip().lower().replace("°", "deg").replace("%", "percent")
    return re.sub(r"[^a-z0-9]+", "_", text).strip("_")


@dataclass
class FieldMapping:
    """canonical field -> source column, with what could not be decided."""

    fields: dict[str, str]
    unmapped: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def infer(columns: Iterable[str], explicit: Mapping[str, str] | None = None) -> FieldMapping:
    """Exact names first, then unique aliases in the order of the columns; what is ambiguous is left out with a warning."""
    columns = list(columns)
    twice = sorted({c for c in columns if columns.count(c) > 1})
    if twice:
        raise ValueError(f"columns named more than once: {twice}")
    out = FieldMapping(dict(explicit or {}))
    for f, c in out.fields.items():
        if f not in FIELDS:
            raise ValueError(f"unknown field {f}")
        if c not in columns:
            raise ValueError(f"no column {c}")
    taken = set(out.fields.values())
    by_name: dict[str, list[str]] = {}
    for c in columns:
        by_name.setdefault(normalised(c), []).append(c)
    for f in FIELDS:
        same = [c for c in by_name.get(f, []) if c not in taken]
        if f in out.fields or not same:
            continue
        if len(same) > 1:
            out.warnings.append(f"{f}: several columns have this name: {same}")
            continue
        out.fields[f] = same[0]
        taken.add(same[0])
    known: dict[str, set[str]] = {}
    for f, names in FIELDS.items():
        for n in names:
            known.setdefault(normalised(n), set()).add(f)
    for c in columns:
        if c in taken:
            continue
        fits = sorted(known.get(normalised(c), set()) - set(out.fields))
        if len(fits) == 1:
            rivals = [o for o in columns if o not in taken and o != c and fits[0] in known.get(normalised(o), set())]
            if rivals:
                out.warnings.append(f"{fits[0]}: {c} and {rivals} could be meant")
                continue
            out.fields[fits[0]] = c
            taken.add(c)
        elif fits:
            out.warnings.append(f"{c} could be any of {fits}")
    out.unmapped = [c for c in columns if c not in taken]
    return out


#: Fields an analysis of a kind of sensor cannot do without.
REQUIRED: dict[str, tuple[str, ...]] = {"generic": ("measurement",), "imu_accelerometer": ("ax", "ay", "az"), "imu_gyroscope": ("gx", "gy", "gz")}


def validate(mapping: FieldMapping, columns: Iterable[str], required: Iterable[str] = ()) -> list[str]:
    """What keeps a mapping from being used: unknown fields, absent or doubly used columns, missing required fields."""
    columns = set(columns)
    problems = [f"unknown field {f}" for f in mapping.fields if f not in FIELDS]
    problems += [f"{f}: no column {c}" for f, c in mapping.fields.items() if c not in columns]
    used: dict[str, list[str]] = {}
    for f, c in mapping.fields.items():
        used.setdefault(c, []).append(f)
    problems += [f"column {c} is used for {fs}" for c, fs in used.items() if len(fs) > 1]
    return problems + [f"required field {f} is not mapped" for f in required if f not in mapping.fields]


def apply(df: DataFrame, mapping: FieldMapping, keep_unmapped: bool = True) -> DataFrame:
    """``df`` with mapped columns under their canonical names; a clash with a kept column is an error."""
    rest = [c for c in df.columns if c not in mapping.fields.values()] if keep_unmapped else []
    clash = sorted(set(rest) & set(mapping.fields))
    if clash:
        raise ValueError(f"unmapped columns have canonical names: {clash}")
    return df.select(*[F.col(f"`{c}`").alias(f) for f, c in mapping.fields.items()], *[F.col(f"`{c}`") for c in rest])
