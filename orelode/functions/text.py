"""Scalar expressions over texts, names, paths and scores. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-case letter words, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda x: F.length(x) > 0)


def content_words(text: Column, least: int = 3) -> Column:
    return F.array_distinct(F.filter(words(text), lambda x: F.length(x) >= least))


def ngrams(tokens: Column, n: int) -> Column:
    # n shifted slices side by side: linear, however often the optimizer copies the expression
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    shifted = F.arrays_zip(*[F.slice(tokens, F.lit(i + 1), count).alias(f"t{i}") for i in range(n)])
    return F.transform(shifted, lambda x: F.concat_ws(" ", *[x[f"t{i}"] for i in range(n)]))


def risk_points(callers: Column, tested: Column, sensitive: Column) -> Column:
    """Hundredths: many callers 30, some 15; untested 30; a sensitive name 40; at most 100."""
    points = F.when(callers > 10, 30).when(callers > 3, 15).otherwise(0) + F.when(tested, 0).otherwise(30) + F.when(sensitive, 40).otherwise(0)
    return F.least(F.lit(100), points)


def churn_factor(churn: Column) -> Column:
    return F.sqrt(1 + F.least(churn / 30.0, F.lit(1.5)))


def module_key(path: Column) -> Column:
    """The first two parts of a path."""
    return F.array_join(F.slice(F.filter(F.split(path, "/"), lambda x: F.length(x) > 0), 1, 2), "/")


def name_words(name: Column) -> Column:
    """snake_case and CamelCase names as lower-case words."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda x: F.length(x) > 0)


def is_test_core(rel: Column) -> Column:
    return rel.contains("/test") | rel.startswith("test")


def is_test_gate(rel: Column) -> Column:
    """A segment `tests` or `__tests__`, or a last segment test_* or *_test.py."""
    return rel.rlike(r"(^|/)(tests|__tests__)(/|$)") | rel.rlike(r"(^|/)(test_[^/]*|[^/]*_test\.py)$")


def glob_regex(pattern: str) -> str:
    """A path glob matched from the right, part by part; `**` is one part like `*`."""
    out = []
    for part in pattern.strip("/").split("/"):
        piece = ""
        i = 0
        while i < len(part):
            c = part[i]
            if c == "*":
                piece += "[^/]*"
                while i + 1 < len(part) and part[i + 1] == "*":
                    i += 1
            elif c == "?":
                piece += "[^/]"
            elif c == "[" and "]" in part[i + 1 :]:
                end = part.index("]", i + 1)
                body = part[i + 1 : end]
                piece += "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]"
                i = end
            else:
                piece += ("\\" if not c.isalnum() and c != "_" else "") + c
            i += 1
        out.append(piece)
    return ("^" if pattern.startswith("/") else "(^|/)") + "/".join(out) + "$"
