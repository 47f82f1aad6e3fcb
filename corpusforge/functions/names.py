"""Column functions over file names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jstext import WS_INNER, padded

#: What names count as archives, volumes and pointing documents.
ARCHIVE = r"(?i).\.(?:gz|zip|7z)\z|\.7z\.[0-9]+\z"
VOLUME = r"\.7z\.[0-9]+\z"
NAME = r"(?s)\A(.+?)(\.[^.]*)?\z"
POINTING = "（指向）"
#: Image types that no browser shows, and the least length of a picture.
UNSUPPORTED = ("x-emf", "gif", "wmf", "emf")
LEAST_BASE64 = 10


def forward(path: Column) -> Column:
    """Backslashes as slashes."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def normal_path(path: Column) -> Column:
    """Slashes forward, doubled ones and ``.`` parts dropped, ``..`` resolved at
    any depth; those that lead out of a relative path stay."""
    full = forward(path)
    rooted = full.startswith("/")

    def step(kept: Column, part: Column) -> Column:
        above = F.try_element_at(kept, F.lit(-1))
        up = F.when(above.isNotNull() & (above != ".."), F.slice(kept, F.lit(1), F.size(kept) - 1)).when(rooted, kept).otherwise(F.concat(kept, F.array(part)))
        return F.when(part.isin("", "."), kept).when(part == "..", up).otherwise(F.concat(kept, F.array(part)))

    parts = F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(parts, "/"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(forward(path), "/"), -1)


def file_stem(name: Column) -> Column:
    """A name without its extension; a leading dot starts no extension."""
    return F.regexp_extract(name, NAME, 1)


def extension(name: Column) -> Column:
    return F.regexp_extract(name, NAME, 2)


def stem(path: Column) -> Column:
    """The last part of a path without its last extension.

    ".md" is all extension, so its stem is empty; "doc." has none and stays."""
    return F.regexp_replace(basename(path), r"\.[^./]+\z", "")


def catalog_name(name: Column) -> Column:
    """Everything before the last dot (nothing without one)."""
    return F.regexp_extract(name, r"(?s)\A(.*)\.[^.]*\z", 1)


def is_lock_file(path: Column) -> Column:
    return basename(path).startswith("~$")


def is_pointing(name: Column) -> Column:
    """The marker counts anywhere in the name."""
    return F.contains(name, F.lit(POINTING))


def strip_pointing(name: Column) -> Column:
    """Without the first marker only."""
    at = F.locate(POINTING, name)
    return F.when(at > 0, F.concat(F.substr(name, F.lit(1), at - 1), F.substr(name, at + len(POINTING)))).otherwise(name)


def under(path: Column, folder: str) -> Column:
    """The path is the folder or lies in it."""
    return (path == folder) | path.startswith(folder.rstrip("/") + "/")


def target_path(path: Column, source_base: str, target: str, ext: str = ".md") -> Column:
    """The source base cut off by its length, the extension replaced."""
    rest = F.substr(path, F.lit(len(source_base) + 1))
    moved = F.regexp_replace(rest, r"(?<=[^/])\.[^./]*\z", ext)
    return F.regexp_replace(F.concat(F.lit(target.rstrip("/") + "/"), moved), r"/{2,}", "/")


def safe_name(name: Column, limit: int = 50) -> Column:
    """A name that file systems take; the cut comes last."""
    out = F.regexp_replace(name, rf'[<>:"/\\|?*{WS_INNER}]+', "_")
    return F.substr(F.regexp_replace(out, r"\.+\z", ""), F.lit(1), F.lit(limit))


def is_archive(name: Column) -> Column:
    return name.rlike(ARCHIVE)


def is_archive_candidate(name: Column, allow_mixed: bool = False) -> Column:
    kind = F.lower(extension(name)).isin(".gz", ".zip", ".7z")
    return kind if allow_mixed else kind & file_stem(name).rlike(r"\A[0-9]+\z")


def is_volume(name: Column) -> Column:
    """Unlike ``is_archive`` this minds the case."""
    return name.rlike(VOLUME)


def volume_base(name: Column) -> Column:
    return F.regexp_replace(name, VOLUME, "")


def leading_digits(name: Column) -> Column:
    return F.regexp_extract(name, r"\A([0-9]*)", 1)


# --- images -------------------------------------------------------------------


def image_type(content_type: Column) -> Column:
    """The part after the first slash; png where there is none."""
    return F.when(F.contains(content_type, F.lit("/")), F.get(F.split(content_type, "/"), F.lit(1))).otherwise(F.lit("png"))


def image_name(doc_name: Column, number: Column, kind: Column) -> Column:
    return F.concat(safe_name(doc_name), F.lit("-"), padded(number), F.lit("."), F.when(kind == "jpeg", "jpg").otherwise(kind))


def image_file(name: Column, kind: Column) -> Column:
    """The name on disk: types other than png and jpeg are written as png."""
    return F.when(kind.isin("png", "jpeg", "jpg"), name).otherwise(F.regexp_replace(name, r"\.[^.]*\z", ".png"))


def image_status(kind: Column, base64_length: Column) -> Column:
    return F.when(kind.isin(*UNSUPPORTED), "unsupported").when(F.coalesce(base64_length, F.lit(0)) < LEAST_BASE64, "empty").otherwise("ok")
