"""String functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File name suffixes by kind.
PHOTO_SUFFIXES = (".jpg", ".jpeg", ".png", ".heic")
VIDEO_SUFFIXES = (".mp4", ".mov", ".avi", ".mkv", ".m4v", ".webm")
SCAN_SUFFIXES = (".jpg", ".jpeg", ".png", ".heic", ".mp4", ".mov")

# Captions that hint at junk.
JUNK_PHRASES = (
    "receipt", "invoice", "screenshot", "handwritten", "text on paper", "screen capture", "screen recording", "completely black", "all black", "blank image", "out of focus",
    "blurry photo", "lens cap", "price tag", "bill total", "payment", "menu", "document", "form field", "phone screen", "computer screen",
)

# What stands before a model's reply.
REPLY_MARKERS = ("assistant\n", "Assistant: ", "assistant: ")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot; '' if the name has none or only a leading dot."""
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    name = base_name(path)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def is_photo(path: Column) -> Column:
    return suffix(path).isin(*PHOTO_SUFFIXES)


def is_video(path: Column) -> Column:
    return suffix(path).isin(*VIDEO_SUFFIXES)


def sanitize(name: Column) -> Column:
    """A file system name: dashes become -, other than word characters too; runs collapse and edges go."""
    x = F.regexp_replace(name, "[–—]", "-")
    x = F.regexp_replace(x, r"(?U)[^\w-]", "-")
    return F.regexp_replace(F.regexp_replace(x, "-+", "-"), "^-+|-+$", "")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def norm_path(path: Column, marker: str) -> Column:
    """The path behind the last /marker/, without leading slashes."""
    return F.regexp_replace(F.regexp_replace(path, f"^/.*/{marker}/", ""), "^/+", "")


def album(path: Column, root: str = "Google Photos", none_prefix: str = "Photos from", none: tuple[str, ...] = ("Trash", "Untitled", "no-date")) -> Column:
    """The path segment after the first ``root`` segment; null for catch-all folders."""
    parts = F.split(path, "/")
    at = F.array_position(parts, root)
    found = F.when(at > 0, F.get(parts, at.cast("int")))
    return F.when(found.isNotNull() & ~found.startswith(none_prefix) & ~found.isin(*none), found)


def hex_sequence(number: Column, largest: Column) -> Column:
    """Lower-case hexadecimal, zero-padded to 5 digits or to those of the largest number."""
    digits = F.greatest(F.lit(5), F.length(F.hex(largest.cast("long"))))
    return F.lower(F.lpad(F.hex(number.cast("long")), digits, F.lit("0")))


def organized_name(taken_at: Column, sequence: Column, trip: Column, path: Column) -> Column:
    """Day (00000000 without a date), sequence and trip, with the old suffix."""
    day = F.coalesce(F.date_format(F.timestamp_seconds(taken_at), "yyyyMMdd"), F.lit("00000000"))
    return F.concat(F.concat_ws("-", day, sequence, sanitize(trip)), suffix(path))


def shorten(text: Column, n: int) -> Column:
    return F.left(F.coalesce(text, F.lit("")), F.lit(n))


def contains_ignoring_case(text: Column, part: str) -> Column:
    quoted = part.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return text.ilike(f"%{quoted}%")


def keyword_pattern(phrases: tuple[str, ...] = JUNK_PHRASES) -> str:
    return r"(?i)\b(?:" + "|".join(map(re.escape, phrases)) + r")\b"


def is_garbage(text: Column) -> Column:
    """Empty, a single sign after stripping, a glottal stop, or under 40 % letters."""
    stripped = F.regexp_replace(text, r"^[., …\t\n]+|[., …\t\n]+$", "")
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return text.isNull() | (F.length(text) == 0) | (F.length(stripped) <= 1) | text.contains("ʔ") | (letters / F.length(text) < 0.4)


def auto_confirmed(reason: Column) -> Column:
    """Discard reasons that need no review."""
    x = F.lower(F.coalesce(reason, F.lit("")))
    return x.startswith("exact duplicate") | x.startswith("burst shot") | x.startswith("user-") | (x == "google-trash")


# Discard reasons by kind, with the kept file's name.
REASONS = {
    "exact": "exact duplicate of ",
    "visual": "visually identical to ",
    "prefix": "path-prefix duplicate of ",
    "album": "cross-album duplicate of ",
    "video": "video duplicate of ",
}


def reason(kind: str, kept: Column) -> Column:
    return F.concat(F.lit(REASONS[kind]), kept)


def kept_name(reason_: Column) -> Column:
    """The kept file's name in a discard reason, else null."""
    return F.nullif(base_name(F.regexp_extract(reason_, r"(?:duplicate of|identical to) (.+)$", 1)), F.lit(""))


def yes_no(reply: Column) -> Column:
    """(yes, reason) of a model's reply that starts with YES or NO."""
    text = F.trim(reply)
    yes = F.coalesce(F.upper(text).startswith("YES"), F.lit(False))
    why = F.regexp_replace(F.regexp_replace(text, r"(?i)^(?:yes|no)", ""), r"^[ :\-]+|[ :\-]+$", "")
    return F.struct(yes.alias("yes"), why.alias("reason"))


def reply_text(raw: Column, markers: tuple[str, ...] = REPLY_MARKERS) -> Column:
    """What follows the first of the markers that is there, stripped."""
    out = F.trim(raw)
    for m in reversed(markers):
        out = F.when(F.locate(m, raw) > 0, F.trim(F.substr(raw, F.locate(m, raw) + len(m)))).otherwise(out)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def description(chunk: Column, default: str = "(no description)") -> Column:
    """Labelled lines of the fields that are there, if there is an action; else the description or ``default``."""
    fields = ("action", "shot", "energy", "setting", "quality")
    lines = F.concat_ws("\n", *(F.when(F.length(chunk[f]) > 0, F.concat(F.lit(f"{f}: "), chunk[f])) for f in fields))
    return F.when(F.length(chunk["action"]) > 0, lines).otherwise(F.coalesce(chunk["description"], F.lit(default)))


def numbered_on_collision(name: Column, number: Column, sep: str = "_", first: int = 2) -> Column:
    """A file name with a number before its suffix; ``number`` counts equal names from 1, and the first stays."""
    ext = F.regexp_extract(name, r".(\.[^.]+)$", 1)
    head = F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    return F.when(number <= 1, name).otherwise(F.concat(head, F.lit(sep), (number + (first - 2)).cast("string"), ext))


def inherited_name(name: Column, kept: Column) -> Column:
    """The name of a discard: the trip part of an organized name without a trip comes from the kept file's name."""
    own, other = F.split(name, "-", 3), F.split(kept, "-", 3)
    loose = (F.size(own) == 3) & F.get(own, F.lit(2)).startswith("unclustered") & (F.size(other) == 3)
    trip = F.regexp_replace(F.get(other, F.lit(2)), r"\.[^.]+$", "")
    return F.when(loose, F.concat(F.get(own, F.lit(0)), F.lit("-"), F.get(own, F.lit(1)), F.lit("-"), trip, suffix(name))).otherwise(name)
