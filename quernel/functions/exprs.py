"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates the terms of a text or a search.
TERM_BREAK = r"[^\p{L}\p{N}_-]+"

#: Weights of search boosts and of ranking; the two tables differ on purpose (fixed values).
SEARCH_CONFIDENCE = {"Exact": 1.0, "Syntactic": 0.70, "NameOnly": 0.15, "Ambiguous": 0.0}
SEARCH_RELATION = {
    "calls_name": 1.0, "constructs": 1.0, "uses_operator": 1.0, "uses_precedence_group": 1.0, "uses_macro": 1.0,
    "imports": 0.6, "exports": 0.6, "references_type": 0.4, "implements": 0.4, "extends": 0.4, "contains": 0.2,
}
RANK_CONFIDENCE = {"Exact": 1.0, "Syntactic": 0.85, "NameOnly": 0.4, "Ambiguous": 0.2}
RANK_KIND = {
    "calls_name": 1.0, "implements": 1.0, "dispatches": 0.8, "dispatch_construct": 0.0, "dispatch_handle": 0.0, "references_type": 0.7, "constructs": 0.7,
    "uses_macro": 0.5, "uses_operator": 0.5, "uses_precedence_group": 0.5, "imports": 0.3, "exports": 0.3, "contains": 0.2,
}


def ascii_lower(column) -> Column:
    """Lower case of A to Z only."""
    return F.translate(column, _UPPER, _LOWER)


def terms(column) -> Column:
    """Terms of a text in order, repeats kept; none for null."""
    return F.filter(F.split(ascii_lower(column), TERM_BREAK), lambda t: t != "")


def lookup(column, table: dict[str, float], default: float) -> Column:
    """Value of a small fixed table, ``default`` for other keys and null."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[column], F.lit(default))


def round4(column) -> Column:
    """Half up at four places, on the double itself (for values of at least 0)."""
    return F.floor(column * 10000 + 0.5) / 10000


def capped(column) -> Column:
    """Clamped to [0, 1]."""
    return F.least(F.greatest(column, F.lit(0.0)), F.lit(1.0))


def rank_score(rank) -> Column:
    """Score of the rank-th hit (1 is the best)."""
    return 1.0 / F.sqrt(rank.cast("double"))


def is_test_path(path) -> Column:
    """Whether a path is a test's: a part named like a test directory (any case), or a file named like a test."""
    file = F.element_at(F.split(path, "/"), -1)
    low, stem = ascii_lower(file), F.element_at(F.split(file, r"\."), 1)
    part = ascii_lower(path).rlike(r"(^|/)(tests|test|__tests__|__test__|__mocks__|spec|specs)(/|$)")
    named = stem.isin("test", "tests") | stem.rlike(r"^test_|_tests?$|Tests?$|TestCase$")
    return part | (file == "conftest.py") | low.contains(".test.") | low.contains(".spec.") | named


def is_generated_path(path) -> Column:
    """Declarations (``.d.ts``) and whatever has a part named ``generated`` or ``generated-web``."""
    return path.endswith(".d.ts") | path.rlike(r"(^|/)(generated|generated-web)(/|$)")


def path_parts(path) -> Column:
    """The parts of a path, empty ones left out."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def path_bucket(path) -> Column:
    """The directory of a path, five parts at most; ``.`` for a file at the top."""
    parts = path_parts(path)
    parent = F.slice(parts, 1, F.least(F.greatest(F.size(parts) - 1, F.lit(0)), F.lit(5)))
    return F.when(F.size(parent) == 0, ".").otherwise(F.array_join(parent, "/"))


def common_prefix(left, right) -> Column:
    """How many first items two arrays share."""
    same = F.transform(F.zip_with(left, right, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x)
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def path_similarity(left, right) -> Column:
    """0.65 of the shared first parts (of the longer path) and 0.35 of the shared words of two or more letters or digits."""
    a, b = path_parts(left), path_parts(right)
    words = lambda p: F.array_distinct(F.filter(F.split(ascii_lower(p), "[^a-z0-9]+"), lambda x: F.length(x) > 1))
    union = F.size(F.array_union(words(left), words(right)))
    longest = F.greatest(F.size(a), F.size(b))
    prefix = F.when(longest == 0, 0.0).otherwise(common_prefix(a, b) / longest)
    return prefix * 0.65 + F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(words(left), words(right))) / union) * 0.35


def query_terms(text: str) -> list[str]:
    """Terms of a search, each once, in order; the same breaks as ``terms``."""
    import regex

    low = text.translate(str.maketrans(_UPPER, _LOWER))
    return list(dict.fromkeys(t for t in regex.split(TERM_BREAK, low) if t))
