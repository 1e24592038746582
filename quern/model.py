"""Kinds, levels and the fixed lists behind them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds, in order, and the names and extensions that decide them.
KINDS = ["project", "folder", "app", "code", "script", "key", "pdf", "doc", "sheet", "slides", "image", "video", "audio", "archive", "config", "other"]
KEY_NAMES = [".env", ".netrc", ".pgpass", "authorized_keys", "credentials", "kubeconfig"]
KEY_PREFIXES = ["id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", ".env."]
ENV_TEMPLATES = ["example", "sample", "template", "dist"]
KEY_EXTS = ["pem", "key", "p12", "pfx", "jks", "keystore", "ppk", "kdbx", "gpg", "asc", "crt", "cer", "csr", "pub"]
EXTS = {
    "pdf": ["pdf"],
    "doc": ["doc", "docx", "odt", "rtf", "txt", "md", "markdown", "rst", "org", "tex", "epub", "pages"],
    "sheet": ["xls", "xlsx", "xlsb", "ods", "csv", "tsv", "numbers"],
    "slides": ["ppt", "pptx", "odp"],
    "image": ["png", "jpg", "jpeg", "gif", "webp", "heic", "heif", "avif", "bmp", "tif", "tiff", "svg", "ico", "psd", "xcf", "raw", "cr2", "cr3", "nef", "arw", "dng"],
    "video": ["mp4", "mkv", "mov", "webm", "avi", "m4v", "wmv", "flv"],
    "audio": ["mp3", "flac", "wav", "ogg", "oga", "opus", "m4a", "aac", "wma"],
    "archive": ["zip", "tar", "gz", "tgz", "bz2", "xz", "zst", "7z", "rar", "iso", "deb", "rpm", "dmg", "apk"],
    "app": ["exe", "msi", "appimage"],
    "script": ["sh", "bash", "zsh", "fish", "ps1", "bat", "cmd", "py", "rb", "pl", "lua", "php", "js", "mjs", "cjs", "ts"],
    "code": ["rs", "go", "c", "h", "cc", "cpp", "hpp", "java", "kt", "kts", "swift", "dart", "scala", "cs", "r", "jl", "ex", "exs", "erl", "hs", "ml", "clj", "sql", "tsx", "jsx", "vue", "svelte", "html", "css", "scss"],
    "config": ["json", "jsonc", "yaml", "yml", "toml", "ini", "conf", "cfg", "xml", "plist", "properties"],
}
BUNDLES = {"app": "app", "pages": "doc", "rtfd": "doc", "numbers": "sheet", "key": "slides", "photoslibrary": "image", "musiclibrary": "audio", "tvlibrary": "video", "bundle": "other", "framework": "other", "plugin": "other", "xcarchive": "other"}
# Levels skip, name, text, meaning as 0 to 3; kinds above name by default, and kinds that stop at name.
LEVELS = {"pdf": 3, "doc": 3, "slides": 3, "script": 3, "sheet": 2, "config": 2}
NAME_ONLY = ["key", "folder", "project", "app", "archive", "other"]


def kind_name(word: str) -> str | None:
    """A kind by its name, in any case, singular or plural."""
    word = word.lower()
    return next((k for k in (word, word.removesuffix("s")) if k in KINDS), None)


def kind_of(name: Column, ext: Column, in_project: Column, head: Column | None = None) -> Column:
    """The kind of a file by its name, extension, place and first bytes (as text)."""
    low, head = F.lower(name), F.lit("") if head is None else head
    script = F.when(in_project, "code").otherwise("script")
    key = low.isin(KEY_NAMES) | ext.isin(KEY_EXTS)
    for prefix in KEY_PREFIXES:
        key |= low.startswith(prefix)
    out = F.when(ext.isin(ENV_TEMPLATES) & low.startswith(".env."), "config")
    out = out.when((ext == "key") & head.startswith("PK"), "slides").when(key, "key")
    for kind, exts in EXTS.items():
        out = out.when(ext.isin(exts), script if kind == "script" else F.lit(kind))
    return out.when((ext == "") & head.startswith("#!"), script).otherwise("other")


def bundle_kind(ext: Column) -> Column:
    """The kind of a folder that counts as one file, else null."""
    out = F.lit(None).cast("string")
    for name, kind in BUNDLES.items():
        out = F.when(ext == name, kind).otherwise(out)
    return out


def ceiling(kind: str) -> int:
    return 1 if kind in NAME_ONLY else 3


def level_of(kind: Column, chosen: dict[str, int] | None = None) -> Column:
    """How much of a kind is read: the default, or what was chosen up to the kind's ceiling."""
    chosen = chosen or {}
    out = F.lit(None).cast("int")
    for k in KINDS:
        level = 1 if k in ("folder", "project") else min(chosen.get(k, LEVELS.get(k, 1)), ceiling(k))
        out = F.when(kind == k, level).otherwise(out)
    return out


def readable(kind: Column, level: Column, in_project: Column) -> Column:
    """Whether a file's text is read: by level, and in projects for code only."""
    return (level >= 2) & (~in_project | (kind == "code")) & ~kind.isin(["image", "video", "audio"])
