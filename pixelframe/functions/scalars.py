"""Column functions on ids, paths, topics, times and measurements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: camera gain 1 is this ISO.
ISO_CAL = 100 / 2.3125
#: Fixed value: where a gallery serves files from.
GALLERY = "/ps/data/browse/files/"
#: Fixed value: file extensions by MIME type.
MIME = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".tsv": "text/tab-separated-values", ".json": "application/json", ".txt": "text/plain"}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def underscore_id(value: Column) -> Column:
    return F.replace(value.cast("string"), F.lit(" "), F.lit("_"))


def directory_id(value: Column) -> Column:
    """As underscore_id, without apostrophes at the ends: a directory's name."""
    return F.trim(underscore_id(value), F.lit("'"))


def strip_parent_id(value: Column, parent: Column) -> Column:
    """What stands between the first and second `parent_` in an id; the whole id if that is nothing."""
    return F.coalesce(F.nullif(F.split_part(value.cast("string"), F.concat(parent.cast("string"), F.lit("_")), F.lit(2)), F.lit("")), value.cast("string"))


def process_id(project: Column, sample: Column, process: Column) -> Column:
    return F.concat_ws("_", project, sample, process)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), "\\.[^.]*$", "")


def extension(path: Column) -> Column:
    """The last extension with its dot, or ''."""
    return F.regexp_extract(file_name(path), "\\.[^.]+$", 0)


def relative_path(path: Column, root: str) -> Column:
    """The path below a root, null outside of it."""
    root = root if root.endswith("/") else root + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30))


def gallery_path(path: Column, root: str) -> Column:
    return F.concat(F.lit(GALLERY), relative_path(path, root))


def topic_command(topic: Column) -> Column:
    """A topic without its first level."""
    return F.regexp_replace(topic, "^[^/]+/", "")


def topic_matches(topic: Column, pattern: str) -> Column:
    """Whether a topic is the pattern, or under it where the pattern ends with /#."""
    if not pattern.endswith("/#"):
        return topic == pattern
    prefix = pattern[:-2]
    return (topic == prefix) | topic.startswith(prefix + "/")


def capture_time(name: Column) -> Column:
    """The time that a captured file's name holds, null if it holds none."""
    return F.try_to_timestamp(F.regexp_extract(name, "\\d{4}-\\d{2}-\\d{2}_\\d{2}-\\d{2}-\\d{2}-\\d{6}", 0), F.lit("yyyy-MM-dd_HH-mm-ss-SSSSSS"))


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def iso_utc_now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def interrupted(n_images: Column, expected: Column) -> Column:
    return ~n_images.eqNullSafe(expected)


def ratio_safe(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def circularity(area: Column, perimeter: Column) -> Column:
    return ratio_safe(4 * F.pi() * area, perimeter * perimeter)


def equivalent_diameter(area: Column) -> Column:
    return F.sqrt(4 * area / F.pi())


def angle_degrees(orientation: Column) -> Column:
    return orientation / F.pi() * 180 + 90


def crop_start(start: Column, pad: int = 10) -> Column:
    return F.greatest(start - pad, F.lit(0))


def crop_stop(stop: Column, size: Column, pad: int = 10) -> Column:
    return F.least(stop + pad, size)


def iso_to_gain(iso: Column) -> Column:
    return iso.cast("double") / ISO_CAL


def gain_to_iso(gain: Column) -> Column:
    return (gain * ISO_CAL).cast("int")


def media_url(vault: str, name: Column, fallback: Column | None = None) -> Column:
    """The address of a file; an empty name gives the fallback's."""
    usable = F.nullif(name, F.lit(""))
    return F.concat(F.lit(vault), F.coalesce(usable, fallback) if fallback is not None else usable)


def mime_type(path: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(MIME), F.lower(extension(path))), F.lit("application/octet-stream"))


def is_image(path: Column) -> Column:
    return mime_type(path).startswith("image/")


def hardware_version(instrument: Column) -> Column:
    """The second word of an instrument's name."""
    return F.nullif(F.split_part(instrument, F.lit(" "), F.lit(2)), F.lit(""))


def type_code(dtype: str) -> str:
    """[f] for numbers, [t] for everything else, booleans and structures too."""
    numeric = dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal")
    return "[f]" if numeric else "[t]"


def gray(b: Column, g: Column, r: Column) -> Column:
    """Luma in 15-bit fixed point, rounded."""
    return F.shiftright(r * 9798 + g * 19235 + b * 3735 + 16384, 15)


def hsv(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """8-bit hue (0 to 179), saturation and value. Hue is 0 for grays."""
    top, low = F.greatest(b, g, r), F.least(b, g, r)
    span = (top - low).cast("double")
    hue = (
        F.when(top == low, F.lit(0.0))
        .when(top == r, 60 * (g - b) / span)
        .when(top == g, 120 + 60 * (b - r) / span)
        .otherwise(240 + 60 * (r - g) / span)
    )
    h = F.round(F.when(hue < 0, hue + 360).otherwise(hue) / 2).cast("int")
    s = F.when(top == 0, F.lit(0)).otherwise(F.round(255 * span / F.when(top > 0, top)).cast("int"))
    return F.when(h >= 180, h - 180).otherwise(h), s, top


def parse_status(text: Column) -> tuple[Column, Column, Column]:
    """Number, total and file of the two free-text progress messages; null where a text is neither."""
    saved, segmenting = "^Image (\\d+)/(\\d+) saved to (.+)$", "^Segmenting image (.+), image (\\d+)/(\\d+)$"
    pick = lambda a, b: F.coalesce(F.nullif(F.regexp_extract(text, saved, a), F.lit("")), F.nullif(F.regexp_extract(text, segmenting, b), F.lit("")))
    return pick(1, 2).try_cast("int"), pick(2, 3).try_cast("int"), pick(3, 1)


def merge_config(old: Column, new: Column) -> Column:
    """Keys of the new map replace those of the old, with null values too."""
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)
