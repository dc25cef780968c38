"""Text primitives as column expressions: tokens, lines, hashes, references, patches.

Three ways of folding case are kept apart: literal matching changes A-Z only
(``ascii_lower``), full-text terms fold all letters (``terms``), and reference
search is case-sensitive.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words in the queries' language of declarations that tell nothing about a file.
STOP_WORDS = [
    "public", "private", "protected", "static", "final", "class", "interface", "enum", "import", "package", "return", "throws", "extends", "implements", "void", "this",
    "null", "true", "false", "new", "super", "abstract", "synchronized", "native", "String", "Object", "Integer", "Long", "Boolean", "List", "Map", "Set", "Override",
    "override", "serialVersionUID", "int", "long", "double", "boolean", "char", "float", "byte", "short", "Exception", "catch", "finally", "while",
]

#: Languages and their file extensions.
LANGUAGES = {
    "c": ["c", "h"],
    "config": ["cfg", "conf", "ini", "properties"],
    "cpp": ["cc", "cpp", "cxx", "hh", "hpp", "hxx"],
    "java": ["java"],
    "javascript": ["cjs", "js", "jsx", "mjs", "ts", "tsx"],
    "json": ["json"],
    "markdown": ["markdown", "md"],
    "markup": ["htm", "html", "jsp", "xhtml", "xml"],
    "python": ["py", "pyi"],
    "rust": ["rs"],
    "shell": ["bash", "sh"],
    "sql": ["sql"],
    "toml": ["toml"],
    "yaml": ["yaml", "yml"],
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_space = r"[\t\n\x0B\f\r ]"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def tokens(c: Column, distinct: bool = True) -> Column:
    """Runs of ``[A-Za-z0-9_]`` in order; repeated ones only once, at their first place."""
    out = F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9_]+"), F.lit(0))
    return F.array_distinct(out) if distinct else out


def terms(c: Column) -> Column:
    """Full-text terms: lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def focus_terms(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(tokens(c, False), ascii_lower), lambda t: F.length(t) > 2)))


def lines(c: Column) -> Column:
    """Lines at line feeds, without carriage returns before them and without an empty one at the end."""
    parts = F.split(c, "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.transform(parts, lambda x: F.regexp_replace(x, "\r$", ""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_space}+|{_space}+$", "")


def excerpt(c: Column, n: int = 200) -> Column:
    return F.substring(strip(c), 1, n)


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def byte_estimate(c: Column) -> Column:
    return F.floor(F.octet_length(c) / 4).cast("int")


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def opaque_id(nonce: str, key: Column) -> Column:
    return F.concat(F.lit("it-"), F.left(F.sha2(F.concat_ws("|", F.lit(nonce), key.cast("string")), 256), F.lit(10)))


def language(path: Column) -> Column:
    """Language of a path by its lower-cased extension, null if unknown."""
    pairs = [F.lit(x) for name, exts in LANGUAGES.items() for e in exts for x in (e, name)]
    ext = F.regexp_extract(path, r"(?:^|/)[^/]+\.([A-Za-z0-9]+)$", 1)
    return F.create_map(*pairs)[ascii_lower(ext)]


def capability(lang: Column) -> Column:
    return F.when(lang.isNull(), F.lit("unsupported")).when(lang == "java", F.lit("structural")).otherwise(F.lit("lexical"))


def is_test_path(path: Column) -> Column:
    return ascii_lower(path).rlike("test|spec")


def path_safe(path: Column) -> Column:
    """Relative, without ``..`` segments, not empty."""
    return (F.length(path) > 0) & ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)") & ~path.rlike(r"^[A-Za-z]:")


def glob_pattern(glob: str) -> str:
    """A glob, whose ``*`` crosses slashes, as a regular expression for the whole path."""
    return "^" + "".join({"*": ".*", "?": "."}.get(ch) or re.escape(ch) for ch in glob) + "$"


def matches_any(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_pattern(g))
    return out


def parsed_ref(ref: Column) -> Column:
    """struct(file, line, hash) of ``file:line[@hash]``; null parts if it isn't one."""
    pattern = r"^(.+):([0-9]+)(?:@(?:sha256:)?([^@]*))?$"
    ok = ref.rlike(pattern)
    part = lambda k: F.when(ok, F.nullif(F.regexp_extract(ref, pattern, k), F.lit("")))
    return F.struct(part(1).alias("file"), part(2).cast("int").alias("line"), F.lower(part(3)).alias("hash"))


def patch_paths(patch: Column) -> Column:
    """Paths a patch touches: the new side of each header, then rename targets; each once."""
    heads = F.regexp_extract_all(patch, F.lit(r"(?m)^diff --git a/\S+ b/(\S+)"), F.lit(1))
    renames = F.regexp_extract_all(patch, F.lit(r"(?m)^rename to (\S+)"), F.lit(1))
    return F.array_distinct(F.concat(heads, renames))


def case_counts(log: Column) -> Column:
    """The last ``N/M passed`` of a log as struct(passed, total)."""
    last = lambda k: F.try_element_at(F.regexp_extract_all(log, F.lit(r"([0-9]+)/([0-9]+) passed"), F.lit(k)), F.lit(-1)).cast("int")
    return F.struct(last(1).alias("passed"), last(2).alias("total"))


def json_keys(c: Column) -> Column:
    """All keys of a JSON text at any depth, in order.

    Every string is taken in turn, so what looks like a key within one is passed
    over; those before a colon are keys.
    """
    string = r'"((?:[^"\\]|\\.)*)"(\s*:)?'
    pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(string), F.lit(1)).alias("s"), F.regexp_extract_all(c, F.lit(string), F.lit(2)).alias("colon"))
    return F.transform(F.filter(pairs, lambda x: x["colon"] != ""), lambda x: x["s"])
