"""Camera settings and commands: conversion, defaults, overlay and validation as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.functions.scalars import ISO_CAL, literal_map


@dataclass(frozen=True)
class Range:
    """Inclusive limits of a setting; a null setting isn't checked."""

    column: str
    label: str
    low: float
    high: float | None


#: The limits, in the order in which violations are told.
RANGES = (
    Range("exposure", "Exposure time", 0, None),
    Range("gain", "Image gain", 0, 16),
    Range("brightness", "Brightness", -1, 1),
    Range("contrast", "Contrast", 0, 32),
    Range("wb_red", "White balance red gain", 0, 32),
    Range("wb_blue", "White balance blue gain", 0, 32),
    Range("sharpness", "Sharpness", 0, 16),
    Range("jpeg_quality", "JPEG quality", 0, 95),
)
#: Limits of a light's brightness, and the modes of the white balance.
LIGHT_RANGE = Range("value", "Light value", 0, 1)
WHITE_BALANCE_MODES = ("auto", "off")
#: Public texts of violations; others keep their own name.
PUBLIC = {"Exposure time": "Shutter speed not valid", "Image gain": "ISO number not valid", "White balance red gain": "White balance gain not valid", "White balance blue gain": "White balance gain not valid"}
#: Required fields of an acquisition command, in the order in which they are looked for.
REQUIRED = ("nb_frame", "sleep", "volume", "pump_direction")
#: Defaults of a segmentation's settings.
DEFAULTS = {"force": False, "recursive": True, "ecotaxa": True, "keep": True, "process_min_ESD": 20, "remove_previous_mask": False}


def violations(ranges: tuple[Range, ...] = RANGES) -> Column:
    """Labels of all settings out of their limits, in order."""

    def outside(r: Range) -> Column:
        c = F.col(r.column)
        return (c < r.low) if r.high is None else (c < r.low) | (c > r.high)

    return F.array_compact(F.array(*[F.when(outside(r), F.lit(r.label)) for r in ranges]))


def exposure_outside(exposure: Column, shortest: Column, longest: Column) -> Column:
    """Whether an exposure time is outside the limits of a frame's duration; without limits it must not be below 0."""
    limited = shortest.isNotNull() & longest.isNotNull()
    return F.coalesce(F.when(limited, ~exposure.between(shortest, longest)).otherwise(exposure < 0), F.lit(False))


def first_error(errors: Column) -> Column:
    """The public text of the first violation, null if there is none."""
    label = F.get(errors, 0)
    return F.when(label.isNotNull(), F.coalesce(F.try_element_at(literal_map(PUBLIC), label), F.concat(label, F.lit(" not valid"))))


def missing_field(fields: tuple[str, ...] = REQUIRED) -> Column:
    """The first required field that is null, null if none is."""
    return F.coalesce(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields])


def one_of(value: Column, allowed: tuple[str, ...]) -> Column:
    """Whether a value that is given is allowed; null counts as allowed."""
    return F.coalesce(value.isin(*allowed), F.lit(True))


def overlay(df: DataFrame, fields: list[str], current: str, update: str) -> DataFrame:
    """Fields of the update that aren't null replace the current ones. Columns are named prefix + field."""
    return df.withColumns({f: F.coalesce(F.col(f"{update}{f}"), F.col(f"{current}{f}")) for f in fields})


def given(fields: list[str]) -> Column:
    """A map of the fields that aren't null, as text."""
    return F.map_filter(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))]), lambda _, v: v.isNotNull())


def converted_gain(iso: Column, analog: Column) -> Column:
    """Image gain: from the ISO number if there is one, else the analog gain."""
    return F.coalesce(iso.try_cast("double") / ISO_CAL, analog.try_cast("double"))


def balanced_gains(red: Column, blue: Column, now_red: Column, now_blue: Column) -> tuple[Column, Column]:
    """White-balance gains in hundredths to gains; one that is missing is taken from now, none given: null."""
    some = red.isNotNull() | blue.isNotNull()
    return F.when(some, F.coalesce(red / 100, now_red)), F.when(some, F.coalesce(blue / 100, now_blue))


def pump_steps(volume: Column, flowrate: Column, steps_per_ml: Column, most_flow: float) -> dict[str, Column]:
    """Steps, speed and duration of a pump command; flow 0 is refused (null), flow above the most is lowered."""
    steps = F.bround(steps_per_ml * volume * 256).cast("long")
    flow = F.least(F.when(flowrate > 0, flowrate), F.lit(most_flow))
    speed = flow * steps_per_ml * 256 / 60
    return {"nb_steps": steps, "steps_per_s": speed, "duration": F.try_divide(steps.cast("double"), speed)}


def focus_steps(distance: Column, speed: Column, steps_per_mm: Column, most_speed: float) -> dict[str, Column]:
    """The same for a focus command; no speed given: the most."""
    steps = F.bround(steps_per_mm * distance * 256).cast("long")
    pace = F.least(F.coalesce(speed, F.lit(most_speed)), F.lit(most_speed)) * steps_per_mm * 256
    return {"nb_steps": steps, "steps_per_s": pace, "duration": F.try_divide(steps.cast("double"), pace)}


def with_defaults(settings: Column) -> dict[str, Column]:
    """Settings of a segmentation from a struct that may lack any of them."""
    return {name: F.coalesce(settings[name], F.lit(default)) for name, default in DEFAULTS.items()}
