"""A directory as a table of files, by Spark's binary reader: ignore rules, globs, size and media filters, types, fingerprints."""

from __future__ import annotations

import hashlib
import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinspark.functions.text import stable_id

MAX_BYTES, SAMPLE = 10 * 1024 * 1024, 8192
#: Directories and files that are never source, languages by extension, and document, config and data extensions.
IGNORED = (".git/", ".hg/", ".svn/", "node_modules/", "__pycache__/", ".venv/", "venv/", "dist/", "build/", "target/", ".idea/", ".vscode/", "*.pyc", "*.lock", "*.log", ".DS_Store")
LANGUAGES = {
    "python": ("py", "pyi"), "javascript": ("js", "jsx", "mjs", "cjs"), "typescript": ("ts", "tsx"), "solidity": ("sol",), "java": ("java",), "kotlin": ("kt", "kts"), "scala": ("scala",), "go": ("go",), "rust": ("rs",),
    "c": ("c", "h"), "cpp": ("cc", "cpp", "cxx", "hpp", "hh"), "csharp": ("cs",), "ruby": ("rb",), "php": ("php",), "swift": ("swift",), "lua": ("lua",), "perl": ("pl", "pm"), "r": ("r",), "julia": ("jl",), "haskell": ("hs",),
    "elixir": ("ex", "exs"), "erlang": ("erl",), "clojure": ("clj",), "dart": ("dart",), "bash": ("sh", "bash"), "sql": ("sql",), "html": ("html", "htm"), "css": ("css",), "zig": ("zig",), "ocaml": ("ml",), "fortran": ("f90",), "matlab": ("m",), "groovy": ("groovy",),
}
DOCUMENTS = {"markdown": ("md", "markdown", "mdx"), "text": ("txt", "rst"), "pdf": ("pdf",), "config": ("toml", "yaml", "yml", "ini", "cfg", "env"), "data": ("json", "csv", "tsv", "xml", "parquet")}
MEDIA = ("png", "jpg", "jpeg", "gif", "bmp", "ico", "webp", "svg", "mp3", "mp4", "mov", "avi", "wav", "zip", "gz", "tar", "7z", "woff", "woff2", "ttf")
MAGIC = ("89504E47", "FFD8FF", "47494638", "504B0304", "1F8B", "25504446")


def glob_pattern(rule: str) -> str:
    """One ignore or glob rule as an anchored regular expression over relative paths. A trailing slash means a directory, a slash elsewhere anchors at the root, `**` crosses directories."""
    directory, body = rule.endswith("/"), rule.strip("/")
    anchored = "/" in body or rule.startswith("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = body[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
            i += 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if directory else "(?:/.*)?$")


def ignored(path: Column, rules: tuple[str, ...]) -> Column:
    """The last rule that matches decides; a rule with `!` takes a path back in."""
    out = F.lit(False)
    for rule in rules:
        rule = rule.strip()
        if rule and not rule.startswith("#"):
            back = rule.startswith("!")
            out = F.when(path.rlike(glob_pattern(rule.lstrip("!"))), not back).otherwise(out)
    return out


def matches_any(path: Column, globs: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (path.rlike(glob_pattern(g)) for g in globs), F.lit(False))


def is_binary(sample: Column) -> Column:
    """A zero byte, or over 30 % control bytes other than white space, in the sample's first bytes."""
    text = F.decode(sample, "ISO-8859-1")
    controls = F.char_length(F.regexp_replace(text, r"[^\x01-\x08\x0B\x0E-\x1F\x7F]", ""))
    return F.contains(text, F.lit("\x00")) | (controls > 0.3 * F.char_length(text))


def classify(path: Column, sample: Column) -> tuple[Column, Column]:
    """Type and language of a file, by extension first and by its head where that tells nothing."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9_]+)$", 1))
    head = F.decode(sample, "ISO-8859-1")
    language = F.lit(None).cast("string")
    for name, exts in LANGUAGES.items():
        language = F.when(ext.isin(*exts), name).otherwise(language)
    language = F.when(language.isNull() & head.rlike(r"^#![^\n]*\b(python|bash|sh|node|ruby|perl)"), F.regexp_extract(head, r"^#![^\n]*\b(python|bash|sh|node|ruby|perl)", 1)).otherwise(language)
    kind = F.when(ext.isin(*DOCUMENTS["pdf"]), "pdf").when(is_binary(sample), "binary").when(language.isNotNull(), "code")
    for name in ("markdown", "config", "data", "text"):
        kind = kind.when(ext.isin(*DOCUMENTS[name]), name)
    kind = kind.when(head.rlike(r"^\s*[\[{]"), "data").when(head.startswith("# "), "markdown").otherwise("unknown")
    return kind, F.when(kind == "code", language)


def context_scope(path: Column, kind: Column) -> Column:
    test = path.rlike(r"(?i)(^|/)(tests?|__tests__|spec)(/|$)") | path.rlike(r"(?i)(^|/)(test_[^/]*|[^/]*[._-](test|spec))\.[^/]+$")
    return F.when(test, "test").when(kind.isin("markdown", "text", "pdf"), "docs").otherwise("code")


def options_hash(options: dict) -> str:
    return hashlib.sha256(json.dumps(options, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def scan(spark: SparkSession, root: str, project: str, rules: tuple[str, ...] = (), include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), max_bytes: int = MAX_BYTES, options: dict | None = None) -> DataFrame:
    """artifact_id, project_id, relative_path, size_bytes, modified_at, sha256, artifact_type, language, context_scope, options_hash, content of the files that are to be compiled.

    Path and size filters come before the content is touched.
    """
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    tail = re.sub(r"^[a-z]+:/*", "", root)
    rel = F.regexp_replace(F.expr("url_decode(replace(path, '+', '%2B'))"), "^.*?" + re.escape(tail) + "/", "")
    files = files.filter(F.col("length") <= max_bytes).withColumn("relative_path", rel)
    files = files.filter(~ignored(F.col("relative_path"), (*IGNORED, *rules)))
    if exclude:
        files = files.filter(~matches_any(F.col("relative_path"), exclude))
    if include:
        files = files.filter(matches_any(F.col("relative_path"), include))
    ext = F.lower(F.regexp_extract("relative_path", r"\.([A-Za-z0-9]+)$", 1))
    starts = F.hex(F.substring("content", 1, 4))
    magic = reduce(lambda a, b: a | b, (starts.startswith(m) for m in MAGIC if m != "25504446"), F.lit(False))
    files = files.filter(~ext.isin(*MEDIA) & ~magic)
    kind, language = classify(F.col("relative_path"), F.substring("content", 1, SAMPLE))
    return files.select(
        stable_id("artifact", F.lit(project), F.col("relative_path")).alias("artifact_id"), F.lit(project).alias("project_id"), "relative_path", F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("sha256"), kind.alias("artifact_type"), language.alias("language"),
        context_scope(F.col("relative_path"), kind).alias("context_scope"), F.lit(options_hash(options or {})).alias("options_hash"), "content",
    )
