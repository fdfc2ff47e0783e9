"""Path columns: normal forms, prefixes, extensions, parents, mail paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAIL_SCHEME = "outlook:"
MAIL_FOLDER_SCOPE = "mailfolder:"
#: Name of the stored column of scope_key().
SCOPE_KEY = "_scope_key"


def is_mail_path(path: Column) -> Column:
    return F.lower(F.substring(path, 1, len(MAIL_SCHEME))) == MAIL_SCHEME


def normalize_path(path: Column) -> Column:
    """Back slashes only; extended prefixes gone; doubled slashes single except a leading UNC pair; no trailing slash.

    Mail paths stay as they are, and so does the root of a drive (up to three bytes).
    """
    p = F.replace(path, F.lit("/"), F.lit("\\"))
    p = F.regexp_replace(p, r"^\\\\\?\\UNC\\", r"\\\\")
    p = F.regexp_replace(p, r"^\\\\\?\\", "")
    unc = p.startswith("\\\\")
    body = F.regexp_replace(F.when(unc, F.substr(p, F.lit(3))).otherwise(p), r"\\\\", r"\\")
    p = F.concat(F.when(unc, F.lit("\\\\")).otherwise(F.lit("")), body)
    p = F.when(F.octet_length(p) > 3, F.regexp_replace(p, r"\\+$", "")).otherwise(p)
    return F.when(is_mail_path(path), path).otherwise(p)


def has_prefix(path: Column, prefix: Column) -> Column:
    """Whether a normalized path is the prefix or lies below it; letters compare without case, parts as a whole.

    A drive root (C:\\) contains all of its drive.
    """
    p, q = F.lower(path), F.rtrim(F.lower(prefix), F.lit("\\"))
    return (p == q) | p.startswith(F.concat(q, F.lit("\\")))


def rewrite_prefix(path: Column, old: Column, new: Column) -> Column:
    """The path with prefix `old` exchanged for `new`; unchanged where it doesn't have the prefix or there is no new one."""
    rest = F.substr(path, F.length(F.rtrim(old, F.lit("\\"))) + 1)
    return F.when((F.coalesce(new, F.lit("")) != "") & has_prefix(path, old), F.concat(F.rtrim(new, F.lit("\\")), rest)).otherwise(path)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the base name; empty where that dot is the first or last character."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]+)$", 1))


def normalize_extensions(exts: list[str]) -> list[str]:
    """Trimmed, without leading dots, lower-case, once each; empty means no filter."""
    return list(dict.fromkeys(x for x in (e.strip().lstrip(".").lower() for e in exts) if x))


#: Groups of file types that a filter offers. Fixed values.
TYPE_GROUPS = {"txt": ("txt",), "md": ("md", "markdown"), "json": ("json",), "html": ("html", "htm"), "pdf": ("pdf",), "word": ("docx", "doc"), "jtd": ("jtd",), "excel": ("xls", "xlsx")}


def extensions_of(groups: list[str]) -> list[str]:
    """The extensions of chosen file-type groups; unknown groups stand for themselves."""
    return normalize_extensions([e for g in groups for e in TYPE_GROUPS.get(g, (g,))])


def matches_text(label: Column, path: Column, text: str) -> Column:
    """Whether a scope's label or path contains a text, letters compared without case; an empty text matches all."""
    t = text.strip().lower()
    return F.lit(True) if not t else F.contains(F.lower(label), F.lit(t)) | F.contains(F.lower(path), F.lit(t))


def parent_path(path: Column) -> Column:
    """The folder above; null for roots (a drive, a share) and bare names."""
    p = normalize_path(path)
    up = F.regexp_extract(p, r"^(.+)\\[^\\]+$", 1)
    up = F.when(up.rlike(r"^[A-Za-z]:$"), F.concat(up, F.lit("\\"))).otherwise(up)
    return F.when((up != "") & ~p.rlike(r"^[A-Za-z]:\\?$") & ~up.rlike(r"^\\\\[^\\]*$"), up)


def fold_path(path: Column) -> Column:
    """A key under which equal paths are equal: lower case, slashes of one kind, none at the end."""
    return F.lower(F.rtrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/")))


def ancestors(path: Column) -> Column:
    """All folders above a path as they are written in it, the nearest last; slashes of both kinds part names. A drive's root keeps its slash; a server is no folder."""
    parts = F.split(path, r"[/\\]")
    n = F.size(parts) - 1
    upto = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(path, F.lit(1), F.length(F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    upto = F.transform(upto, lambda p: F.when(p.rlike(r"^[A-Za-z]:$"), F.concat(p, F.lit("\\"))).otherwise(p))
    named = F.filter(upto, lambda p: ~p.rlike(r"^(?:[/\\]*|[/\\]{2}[^/\\]*)$"))
    return F.when(n > 0, named).otherwise(F.array().cast("array<string>"))


def top_folder(path: Column) -> Column:
    """The first name of a path; of a UNC path the share."""
    return F.regexp_extract(path, r"^([/\\]{2}[^/\\]+[/\\][^/\\]+|[^/\\]+)", 1)


def display_name(path: Column) -> Column:
    """The last part, or the whole path for a root."""
    name = F.regexp_extract(normalize_path(path), r"([^\\]+)\\?$", 1)
    return F.when(name == "", path).otherwise(name)


def relative_label(path: Column, root: Column) -> Column:
    """The part below the root with slashes, behind the root's name."""
    rest = F.replace(F.substr(path, F.length(root) + 1), F.lit("\\"), F.lit("/"))
    return F.when(has_prefix(path, root), F.concat(display_name(root), rest)).otherwise(path)


def mail_path(store: Column, entry: Column) -> Column:
    return F.concat(F.lit(MAIL_SCHEME), store, F.lit("/"), entry)


def parse_mail_path(path: Column) -> Column:
    """struct(store, entry), split at the first slash; null where the path is no mail path or a part is empty."""
    rest = F.substr(path, F.lit(len(MAIL_SCHEME) + 1))
    at = F.instr(rest, "/")
    store, entry = F.substring_index(rest, "/", 1), F.substr(rest, at + 1)
    return F.when(is_mail_path(path) & (at > 1) & (entry != ""), F.struct(store.alias("store"), entry.alias("entry")))


def mail_label(store: Column, label: Column) -> Column:
    """`store / folder / ...` without the store's name repeated at the front."""
    parts = F.filter(F.transform(F.split(label, r"[/\\]"), lambda x: F.trim(x)), lambda x: x != "")
    text = F.array_join(parts, " / ")
    text = F.regexp_replace(text, F.concat(F.lit("^(?:\\Q"), store, F.lit("\\E(?: / |$))+")), F.lit(""))
    return F.when(text == "", store).otherwise(F.concat(store, F.lit(" / "), text))


def in_scope(path: Column, scope: str, mail_folder: Column | None = None) -> Column:
    """Rows within a scope: a folder prefix, or `mailfolder:NAME`. File scopes never contain mail."""
    if scope.lower().startswith(MAIL_FOLDER_SCOPE):
        name = scope[len(MAIL_FOLDER_SCOPE) :].strip().lower()
        return is_mail_path(path) & (F.lower(mail_folder) == name) if mail_folder is not None else F.lit(False)
    return ~is_mail_path(path) & has_prefix(normalize_path(path), normalize_path(F.lit(scope)))


def scope_key(path: Column) -> Column:
    """What a stored path is ranged by: normalized, in lower case; null for mail, which no file scope contains."""
    return F.when(~is_mail_path(path), F.lower(normalize_path(path)))


def key_in_scope(key: Column, scope: str) -> Column:
    """in_scope() of a folder by the stored key: the folder itself, or the range of keys below it. Bounds are constants, so that both reach the scan."""
    folder = F.rtrim(F.lower(normalize_path(F.lit(scope))), F.lit("\\"))
    below, behind = F.concat(folder, F.lit("\\")), F.concat(folder, F.lit(chr(ord("\\") + 1)))
    return (key == folder) | ((key >= below) & (key < behind))


def within_scope(units: DataFrame, scope: str) -> DataFrame:
    """The units of a scope, by the stored key where they have one."""
    if scope.lower().startswith(MAIL_FOLDER_SCOPE):
        return units.where(in_scope(F.col("path"), scope, F.col("mail_folder") if "mail_folder" in units.columns else None))
    return units.where(key_in_scope(F.col(SCOPE_KEY) if SCOPE_KEY in units.columns else scope_key(F.col("path")), scope))
