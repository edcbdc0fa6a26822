"""Path, identifier and message expressions. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that carry no signal in test identifiers.
STOP_TOKENS = ("test", "tests", "src", "lib", "py", "init", "main", "a", "the")
# Configuration file suffixes.
CONFIG_SUFFIX = r"(?i)\.(?:ya?ml|toml|cfg|ini|json)$"
# Whole-word message keywords of the strict variant.
FIX_WORDS = r"(?i)\b(fix|fixes|fixed|bug|bugfix|hotfix|patch)\b"
REFACTOR_WORDS = r"(?i)\b(refactor|refactoring|cleanup|clean\s?up|rename|reorg)\b"


def identifier_tokens(text: Column) -> Column:
    """Distinct lowercase content tokens of a path or identifier."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), "(?<=[a-z0-9])(?=[A-Z])", " ")
    words = F.split(F.lower(spaced), "[^a-z0-9]+")
    return F.array_distinct(
        F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_TOKENS))
    )


def bind(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` over a struct of ``values``, each evaluated once however often it is used."""
    packed = F.array(F.struct(*[c.alias(n) for n, c in values.items()]))
    return F.get(F.transform(packed, body), F.lit(0))


def _set_similarity(left: Column, right: Column, score: Callable[[Column], Column]) -> Column:
    return bind({"a": left, "b": right}, lambda v: F.when(
        (F.size(v["a"]) > 0) & (F.size(v["b"]) > 0), score(v)).otherwise(F.lit(0.0)))


def jaccard(left: Column, right: Column) -> Column:
    """Set similarity; 0 when either side is empty."""
    return _set_similarity(left, right, lambda v: F.size(
        F.array_intersect(v["a"], v["b"])) / F.size(F.array_union(v["a"], v["b"])))


def dice(left: Column, right: Column) -> Column:
    """Sorensen-Dice similarity; 0 when either side is empty."""
    return _set_similarity(left, right, lambda v: 2.0 * F.size(
        F.array_intersect(v["a"], v["b"])) / (F.size(v["a"]) + F.size(v["b"])))


def directories(path: Column) -> Column:
    """Directory components of a path with either separator, without empty parts."""
    parts = F.split(path, r"[/\\]")
    return F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p != "")


def path_overlap(left: Column, right: Column) -> Column:
    """Shared leading directories over the deeper depth; two rootless paths overlap fully."""
    def score(v: Column) -> Column:
        deep = F.greatest(F.size(v["a"]), F.size(v["b"]))
        shallow = F.least(F.size(v["a"]), F.size(v["b"]))
        same = F.transform(F.arrays_zip(v["a"].alias("a"), v["b"].alias("b")),
                           lambda p: F.coalesce(p["a"] == p["b"], F.lit(False)))
        gap = F.array_position(same, F.lit(False))  # 0 when every directory matches
        shared = F.when(gap == 0, shallow).otherwise(gap - 1)
        return (F.when(deep == 0, F.lit(1.0)).when(shallow == 0, F.lit(0.0))
                .otherwise(shared / deep))

    overlap = bind({"a": directories(left), "b": directories(right)}, score)
    return F.when(left.isNull() | right.isNull(), F.lit(0.0)).otherwise(overlap)


def module_of(path: Column) -> Column:
    """Directory of a path (everything before the last separator), or the path itself."""
    return F.regexp_replace(F.regexp_replace(path, r"/[^/]*$", ""), r"\\[^\\]*$", "")


def file_stem(path: Column) -> Column:
    """File name without directories and without its last suffix."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def is_test_path(path: Column) -> Column:
    """A test file by name convention, or any file below a ``test``/``tests`` folder."""
    low = F.lower(path)
    return low.rlike(r"(^|/)test_[^/]*$") | low.rlike(r"_test\.py$") | low.rlike(
        r"(^|/)tests?/"
    )


def is_source_path(path: Column) -> Column:
    """A Python file that is not a test file."""
    return path.endswith(".py") & ~is_test_path(path)


def word_count(text: Column) -> Column:
    """Number of whitespace separated words."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether lowercase ``text`` contains one of ``words`` as a substring."""
    low = F.lower(text)
    found = F.lit(False)
    for word in words:
        found = found | F.contains(low, F.lit(word))
    return found


def canonical_key(test_id: Column) -> tuple[Column, Column]:
    """(module path without ``.py``, bare name): equal keys mean the same test.

    The class segment and the parameter suffix do not take part; a file-only id has an empty
    name.
    """
    ident = F.regexp_replace(F.trim(test_id), r"\\", "/")
    parts = F.split(ident, "::")
    head = F.regexp_replace(F.element_at(parts, 1), r"\.py$", "")
    last = F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.lit(""))
    return head, F.regexp_replace(last, r"(?s)\[.*$", "")


def normalize_test_id(
    framework: Column, path: Column, test_class: Column, function: Column
) -> Column:
    """``framework::path[::class]::function`` with forward slashes; empty parts are left out."""
    tidy_path = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"\s+", "")
    parts = [F.trim(framework), tidy_path, F.trim(test_class), F.trim(function)]
    return F.concat_ws("::", *[F.when(part != "", part) for part in parts])


# Every line break a text may carry, as a class (after the two-character one).
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def lines(text: Column) -> Column:
    """Lines of a text; a final line break does not open another line."""
    body = F.regexp_replace(text, f"(?:{LINE_BREAK})\\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(body, LINE_BREAK))


def count_pattern(text: Column, pattern: str) -> Column:
    """Number of non-overlapping matches."""
    return F.regexp_count(text, F.lit(pattern))
