import ast
import os

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_nothing_else_imports_the_optional_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "evspark")):
        if os.path.basename(folder) == "llm" or "/llm/" in folder:
            continue
        for n in names:
            if n.endswith(".py"):
                tree = ast.parse(open(os.path.join(folder, n)).read())
                for node in ast.walk(tree):
                    names_ = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                    assert not any(m.startswith("evspark.llm") for m in names_), (folder, n)
