from __future__ import annotations

import tomllib
from pathlib import Path


def test_project_file_names_all_packages():
    root = Path(__file__).parents[1]
    project = tomllib.loads((root / "pyproject.toml").read_text())
    folders = {p.parent.relative_to(root).as_posix().replace("/", ".") for p in (root / "lodegraph").rglob("__init__.py")}
    assert folders - {"lodegraph.llm"} <= set(project["tool"]["setuptools"]["packages"])
