import ast

import pytest

from orelode.operators.rewrites import rewrite, rewritten

CASES = [
    ("noop-statement", 2, "def f(x):\n    x == 1\n    return x\n", "def f(x):\n    return x\n"),
    ("noop-statement", 2, "def f(x):\n    x == 1\n", "def f(x):\n    pass\n"),
    ("noop-statement", 2, "def f(x):\n    g(x)\n", None),
    ("unreachable", 3, "def f():\n    return 1\n    g()\n    h()\n", "def f():\n    return 1\n"),
    ("unreachable", 2, "def f():\n    return 1\n", None),
    ("duplicate-def", 4, "@d\ndef f():\n    return 1\ndef f():\n    return 2\n", "def f():\n    return 2\n"),
    ("restating-docstring", 1, "def f():\n    '''F.'''\n    return 1\n", "def f():\n    return 1\n"),
    ("stale-suppression", 1, "x = 1  # quality: ignore a b\ny = 2\n", "x = 1\ny = 2\n"),
    ("stale-suppression", 1, "# quality: ignore a b\ny = 2\n", "y = 2\n"),
    ("loop-pipeline", 3, "def f(xs):\n    out = []\n    for x in xs:\n        if x:\n            out.append(x + 1)\n    return out\n", "def f(xs):\n    out = [x + 1 for x in xs if x]\n    return out\n"),
    ("loop-pipeline", 3, "def f(xs):\n    out = []\n    for x in xs:\n        out.append(len(out))\n    return out\n", None),
    ("noop-statement", 1, "def (", None),
]


@pytest.mark.parametrize(("kind", "line", "before", "after"), CASES)
def test_rewrite(kind, line, before, after):
    out = rewrite(before, kind, line)
    assert out == after
    if out is not None:
        ast.parse(out)


def test_many_fixes_of_a_file(spark):
    files = spark.createDataFrame([("a.py", CASES[0][2] + "x = 1  # quality: ignore a b\n"), ("b.py", "y = 1\n")], "rel string, content string")
    fixes = spark.createDataFrame([("a.py", "noop-statement", 2), ("a.py", "stale-suppression", 4), ("a.py", "partition", 1)], "rel string, kind string, line int")
    assert [tuple(r) for r in rewritten(files, fixes).collect()] == [("a.py", "def f(x):\n    return x\nx = 1\n", 2)]
