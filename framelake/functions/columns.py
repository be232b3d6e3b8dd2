"""Column expressions: boxes, tags, times, text features, vectors. Built-in functions only."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions.vocabulary import COLOR_WORDS, LABEL_WORDS, SIZE_STEPS, SIZE_WORDS

DIMENSION = 512


def box_area(bbox: Column) -> Column:
    """Width times height of [x1, y1, x2, y2]; a negative side counts as 0."""
    return F.greatest(F.lit(0.0), F.get(bbox, F.lit(2)) - F.get(bbox, F.lit(0))) * F.greatest(F.lit(0.0), F.get(bbox, F.lit(3)) - F.get(bbox, F.lit(1)))


def size_class(bbox: Column, frame_area: Column) -> Column:
    """tiny, small, medium, large or huge by the share of the frame; without a frame area tiny."""
    ratio = F.when(frame_area > 0, box_area(bbox) / frame_area).otherwise(F.lit(0.0))
    out = F.lit("tiny")
    for least, name in reversed(SIZE_STEPS):
        out = F.when(ratio >= least, name).otherwise(out)
    return out


def build_tags(objects: Column) -> Column:
    """Sorted distinct tags of a frame's objects: label, "colour label", and "size label" for large ones."""

    def of_object(o: Column) -> Column:
        color = F.when((F.coalesce(o["color_name"], F.lit("")) != "") & (o["color_name"] != "unknown"), F.concat_ws(" ", o["color_name"], o["label"]))
        size = F.when(o["size"].isin("large", "huge"), F.concat_ws(" ", o["size"], o["label"]))
        return F.filter(F.array(o["label"], color, size), lambda t: t.isNotNull())

    named = F.filter(F.coalesce(objects, F.array()), lambda o: F.coalesce(o["label"], F.lit("")) != "")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(named, of_object))))


def embed_text(tags: Column, id_: Column) -> Column:
    """Text that stands for a frame: its tags, or its id without any."""
    return F.coalesce(F.nullif(F.array_join(tags, " "), F.lit("")), id_)


def clip_clock(seconds: Column) -> Column:
    """MM:SS of whole seconds; minutes may pass 59."""
    whole = F.when(seconds < 0, F.ceil(seconds)).otherwise(F.floor(seconds)).cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("long"), F.pmod(whole, F.lit(60)))


def cut_clock(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds, for cut lists."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600).cast("long"), F.floor(F.pmod(whole, F.lit(3600)) / 60).cast("long"), F.pmod(whole, F.lit(60)))


def wall_clock(epoch: Column) -> Column:
    """Date and time in the session's zone; empty for null or 0."""
    return F.when(epoch.isNull() | (epoch == 0), "").otherwise(F.date_format(F.timestamp_seconds(epoch.cast("long")), "yyyy-MM-dd HH:mm:ss"))


def parse_time(text: Column) -> Column:
    """Epoch seconds of a number or of ISO text (in the session's zone unless it names one); else null."""
    clean = F.trim(text)
    number = F.when(clean.rlike(r"^(?=.*\d)\d*\.?\d*$"), clean.try_cast("double"))
    iso = F.when(clean.rlike(r"^\d{4}-\d{2}-\d{2}"), F.unix_micros(F.try_to_timestamp(F.regexp_replace(clean, "^(.{10}) ", "$1T"))) / 1e6)
    return F.coalesce(number, iso)


def clip_stem(path: Column) -> Column:
    """A path's file name without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def derive_wall_time(path: Column, modified: Column) -> Column:
    """The first ten digits in a file's stem that no digit precedes, as epoch seconds; else its modification time."""
    return F.coalesce(F.nullif(F.regexp_extract(clip_stem(path), r"(?<!\d)(\d{10})", 1), F.lit("")).cast("double"), modified)


def token_features(text: Column) -> Column:
    """For each run of letters its "$word", and for words of over two letters all pairs of letters; repeats stay."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    pairs = lambda t: F.when(F.length(t) > 2, F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(tokens, lambda t: F.concat(F.array(F.concat(F.lit("$"), t)), pairs(t))))


def feature_bucket(feature: Column, dimension: int = DIMENSION) -> Column:
    """First four bytes of the feature's MD5, big-endian, modulo the dimension."""
    return F.conv(F.substring(F.md5(feature), 1, 8), 16, 10).cast("long") % dimension


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, summed left to right in doubles; 0 if empty, of unequal length, or of no length."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    square = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    norms = square(a) * square(b)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / norms))).otherwise(F.lit(0.0))


def _lookup(words: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x).cast("string") for x in chain(*words.items())])


def parse_query(text: Column) -> Column:
    """Struct of sorted distinct labels, colors and sizes; a word counts as a colour first, then a label, then a size."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0)))
    colors, labels, sizes = _lookup(COLOR_WORDS), _lookup(LABEL_WORDS | dict.fromkeys(COLOR_WORDS)), _lookup(SIZE_WORDS)
    known = lambda table: F.array_sort(F.array_distinct(F.filter(F.transform(tokens, lambda t: F.try_element_at(table, t)), lambda x: x.isNotNull())))
    return F.struct(known(labels).alias("labels"), known(colors).alias("colors"), known(sizes).alias("sizes"))
