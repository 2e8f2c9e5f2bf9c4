"""Column expressions: identities, matching, links, paths, vectors. All of them stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\0"


def identity(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts with a NUL between; null if a part is null."""
    given = F.lit(True)
    for p in parts:
        given = given & p.isNotNull()
    return F.when(given, F.sha2(F.concat_ws(NUL, *parts), 256))


def chunk_id(content: Column, source_id: Column, path: Column) -> Column:
    """Identity of a chunk; null if a part is null or empty."""
    full = (F.length(content) > 0) & (F.length(source_id) > 0) & (F.length(path) > 0)
    return F.when(full, identity(content, source_id, path))


def snippet_id(chunk: Column, language: Column, code: Column) -> Column:
    return identity(F.concat_ws(NUL, chunk, F.coalesce(language, F.lit("")), code), F.lit("code-snippet"), chunk)


def includes(text: Column, query: str) -> Column:
    """Case-insensitive literal substring; no wildcards."""
    return F.contains(F.lower(text), F.lower(F.lit(query)))


def cosine_distance(vector: Column, query: Sequence[float]) -> Column:
    """1 - cosine in double precision; null for a null vector or one without length."""
    q = F.array(*(F.lit(float(x)) for x in query))
    v = vector.cast("array<double>")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(v, q, lambda a, b: a * b))
    norm = F.sqrt(total(F.transform(v, lambda a: a * a)) * F.lit(float(sum(float(x) ** 2 for x in query))))
    return F.lit(1.0) - F.try_divide(dot, norm)


def link_path(url: Column) -> Column:
    return F.split_part(url, F.lit("#"), F.lit(1))


def link_anchor(url: Column) -> Column:
    """What stands after the first ``#``; null if nothing does."""
    at = F.instr(url, "#")
    return F.when(at > 0, F.nullif(F.substr(url, at + 1), F.lit("")))


def normal_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def path_problem(path: Column) -> Column:
    """Why a document's ``source_path`` is refused, else null."""
    p = normal_path(path)
    parts = F.split(p, "/")
    return (
        F.when(p.isNull() | (p == ""), "empty")
        .when(F.startswith(p, F.lit("/")), "absolute")
        .when(F.regexp(p, F.lit("^[A-Za-z]:")), "drive")
        .when(F.array_contains(parts, ".") | F.array_contains(parts, ".."), "dots")
        .when(F.array_contains(parts, ""), "empty segment")
    )


def glob_regex(glob: str) -> str:
    """The regular expression of a glob, for whole paths. ``*`` and ``?`` also match ``/``; ``{a,b}`` and ``[!x]`` work."""
    out, depth, i = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob[i : i + 3] == "**/" and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if c == "*":
            out += ".*"
            while glob[i + 1 : i + 2] == "*":
                i += 1
        elif c == "?":
            out += "."
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]"
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c) if not c.isalnum() and ord(c) < 128 else c
        i += 1
    if depth:
        raise ValueError(f"unclosed group in glob {glob!r}")
    return f"(?s)^{out}$"


def passes_globs(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Included (an empty list includes all), then not excluded."""
    any_of = lambda globs: F.regexp(path, F.lit("|".join(f"(?:{glob_regex(g)})" for g in globs)))
    keep = any_of(include) if include else F.lit(True)
    return keep & ~any_of(exclude) if exclude else keep


def format_of(path: Column) -> Column:
    """Lower-case extension without the dot, ``markdown`` as ``md``; empty if there is none."""
    ext = F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))
    return F.when(ext == "markdown", "md").otherwise(ext)


def allowed_format(path: Column, formats: Sequence[str] = ()) -> Column:
    wanted = {"md" if f.lower() == "markdown" else f.lower() for f in formats}
    return format_of(path).isin(sorted(wanted)) if wanted else F.lit(True)
