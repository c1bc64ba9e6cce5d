"""Small stacks by name: f@lib+off, root first."""

from stackloom.model import STACKS


def frame(text):
    name, _, rest = text.partition("@")
    lib, _, off = rest.partition("+")
    n = int(off, 16) if off else 0
    return (n, n, lib, name, "", 0)


def stacks(spark, *rows):
    """rows: (process, 'main@app > f@lib+0x10', count)."""
    data = [(p, i, [frame(x) for x in s.split(" > ")] if s else [], n, n * 1000.0) for i, (p, s, n) in enumerate(rows)]
    return spark.createDataFrame(data, STACKS)


def by_path(tree):
    return {"/".join(k["function_name"] for k in r["path"]): r for r in tree.nodes.collect()}
