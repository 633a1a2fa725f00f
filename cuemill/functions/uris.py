"""Storage addresses, extensions and archive member names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import is_reserved

# What counts as media in archives and among raw files, and which provider each scheme is for.
MEDIA = [".mp4", ".mp3", ".wmv", ".mov", ".mkv", ".avi"]
RAW_MEDIA = [".mp4", ".mov", ".mkv", ".avi", ".webm", ".m4v", ".wmv"]
SCHEMES = {"local": "local", "gdrive": "google_drive", "rclone": "rclone"}


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"[^/]\.[^./]+$", 0).substr(F.lit(2), F.lit(64)))


def media_class(c: Column, media: list[str] = MEDIA) -> Column:
    """media, nested_zip or ignored."""
    e = extension(c)
    return F.when(e.isin(media), "media").when(e == ".zip", "nested_zip").otherwise("ignored")


def is_junk(c: Column) -> Column:
    """What macOS puts into archives."""
    c = F.translate(c, "\\", "/")
    return F.startswith(c, F.lit("__MACOSX/")) | F.contains(c, F.lit("/__MACOSX/")) | F.endswith(c, F.lit(".DS_Store"))


def parse_uri(c: Column, schemes: dict = SCHEMES) -> Column:
    """scheme, value (percent-decoded; what can't be decoded stays) and provider; null for any other scheme."""
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    raw = F.regexp_extract(c, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://(.*)$", 1)
    value = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    provider = F.try_element_at(F.create_map(*[F.lit(x) for p in schemes.items() for x in p]), scheme)
    return F.when(provider.isNotNull(), F.struct(scheme.alias("scheme"), value.alias("value"), provider.alias("provider")))


def scheme_fits(c: Column, provider: Column, schemes: dict = SCHEMES) -> Column:
    return F.coalesce(parse_uri(c, schemes)["provider"] == provider, F.lit(False))


def safe_profile(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$"), F.lit(False))


def member_fault(name: Column, is_symlink: Column | None = None) -> Column:
    """Why a ZIP member's name is refused, the first reason; null if it is safe."""
    c = F.translate(name, "\\", "/")
    parts = F.filter(F.split(c, "/"), lambda p: ~p.isin("", "."))
    link = F.coalesce(is_symlink, F.lit(False)) if is_symlink is not None else F.lit(False)
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "empty")
        .when(F.contains(c, F.lit("\0")), "nul")
        .when(c.rlike(r"^(/|[A-Za-z]:)"), "absolute")
        .when(F.exists(parts, lambda p: p == ".."), "parent")
        .when(F.exists(parts, is_reserved), "reserved")
        .when(link, "symlink")
    )
