"""Source files that do not parse in the language they are filed under.

Each file is tokenised and parsed whole by the packrat grammar of its language (``grammars``); only a
match that takes every token counts as valid. An invalid file gets the furthest failure position and a
cause. Files never meet each other, so the only shuffles are those that put the file together.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.chunk_source import language_name, load_sources, whole_source

_MARKER = re.compile(r"^(?:<{7} .*|={7}|>{7} .*|\|{7} .*)$", re.M)
#: Frames that a token of nesting may take in the parser (frames are on the heap, about 130 bytes each).
FRAMES = 128

REPORT = "file_id bigint, repo_id string, path string, language string, valid boolean, failure_char bigint, failure_line bigint, cause string"


def parse_source(text: str, name: str) -> tuple[bool, int, str | None]:
    """Whether ``text`` is valid, the character of the furthest failure (its length if valid) and the cause.

    Causes: ``merge_conflict`` (a marker line outside strings and comments), ``truncated`` (the end came too
    early), ``other_format`` (it is valid in another language or as JSON, or is a page), ``syntax``.
    An empty text is valid. Nesting is not bounded: the interpreter's limit follows the number of tokens.
    """
    from quernel.llm.grammars import LANGUAGES, language

    own = language(name)
    tokens, valid, token = _parsed(own, text)
    seen = text
    if not valid and (resolved := own.resolved(text)) is not None:
        tokens, valid, token = _parsed(own, resolved)
        seen = resolved
    if valid:
        return True, len(text), None
    at = own.offset(seen, token)
    line = text.rfind("\n", 0, at) + 1
    end = text.find("\n", line)
    markers = [m.start() for m in _MARKER.finditer(text)]
    if any(line - 200 <= m <= (end if end >= 0 else len(text)) + 200 for m in markers):
        return False, at, "merge_conflict"
    if _other_format(text, name, LANGUAGES):
        return False, at, "other_format"
    return False, at, "truncated" if token >= len(tokens) - 1 else "syntax"


def _parsed(lang, text: str) -> tuple[str, bool, int]:
    tokens = lang.tokenise(text)
    sys.setrecursionlimit(max(sys.getrecursionlimit(), FRAMES * len(tokens) + 10_000))
    return tokens, *lang.grammar.parse(tokens)


def _other_format(text: str, name: str, names) -> bool:
    from quernel.llm.grammars import language

    head = text.lstrip()[:200].lower()
    if head.startswith(("<!doctype", "<html", "<?xml")):
        return True
    if head[:1] in ("{", "["):
        try:
            json.loads(text)
            return True
        except (ValueError, RecursionError):
            pass
    for other in names:
        if other != name:
            tokens, valid, _ = _parsed(language(other), text)
            if valid and tokens.strip("\n;"):
                return True
    return False


def parse_files(sources: DataFrame) -> DataFrame:
    """One report row per file of ``sources`` (file_id, repo_id, path, language, parts; others are ignored).

    ``valid`` is null where the language is null or has no grammar, true for markdown. Characters that
    aren't UTF-8 make a source invalid outside strings and comments. Files without parts are valid.
    """
    named = sources.select("file_id", "repo_id", "path", language_name(F.col("language")).alias("language"), "parts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from quernel.llm.grammars import LANGUAGES

        for b in batches:
            rows = []
            for i, repo, path, name, parts in zip(b.file_id, b.repo_id, b.path, b.language, b.parts, strict=True):
                valid = at = line = cause = None
                if name == "markdown":
                    valid = True
                elif name in LANGUAGES:
                    text = whole_source(parts if parts is not None else []).decode("utf-8", "surrogateescape")
                    valid, at, cause = parse_source(text, name)
                    at, line = (None, None) if valid else (at, text.count("\n", 0, at) + 1)
                rows.append((i, repo, path, name, valid, at, line, cause))
            out = pd.DataFrame(rows, columns=["file_id", "repo_id", "path", "language", "valid", "failure_char", "failure_line", "cause"])
            yield out.astype({"valid": "boolean", "failure_char": "Int64", "failure_line": "Int64"})

    return named.mapInPandas(run, REPORT)


def invalid_rates(reports: DataFrame) -> DataFrame:
    """Files, invalid files and their rate per repository and language; files of unknown validity count in neither."""
    return (
        reports.where(F.col("valid").isNotNull())
        .groupBy("repo_id", "language")
        .agg(F.count(F.lit(1)).alias("n_files"), F.sum((~F.col("valid")).cast("bigint")).alias("n_invalid"))
        .withColumn("invalid_rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
    )


def p1_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure position and cause of every invalid file."""
    return parse_files(load_sources(spark, sf_dir)).where(~F.col("valid"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose whole source is invalid in their language."""
    return p1_reports(spark, sf_dir).select("file_id").distinct()


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of invalid files per repository and language."""
    return invalid_rates(parse_files(load_sources(spark, sf_dir)))


QUERIES = {"p1_found": p1_found, "p1_reports": p1_reports, "p1_rates": p1_rates}
SQL: dict[str, str] = {}
