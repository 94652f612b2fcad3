import ast
import re
from pathlib import Path

from lakewarden import config
from lakewarden.operators.risk import _lookup  # noqa: F401

ROOT = Path(__file__).resolve().parent.parent


def test_tables_agree():
    assert set(config.SEVERITY) == set(config.PLAYBOOK)
    assert set(config.DATA_CLASS.values()) | {config.NON_PERSONAL} == set(config.EXPOSURE) == set(config.CLASS_ARTICLES) == set(config.CLASS_RANK)
    assert set(config.NAME_HINTS) <= set(config.DATA_CLASS) | {"url"}
    assert set(config.ISSUE_QUERY) <= set(config.SEVERITY)
    assert set(config.FREETEXT_KINDS) | set(config.HIGH_CONFIDENCE_KINDS) | set(config.NAME_ONLY_KINDS) <= set(config.PATTERNS)
    assert config.MAX_RAW == max(config.SEVERITY.values()) * max(config.EXPOSURE.values())


def test_bands_cover_all_scores():
    assert [config.band_for(s) for s in (0, 25, 26, 50, 51, 75, 76, 100)] == ["Low", "Low", "Medium", "Medium", "High", "High", "Critical", "Critical"]


def test_patterns_compile():
    for p in [*config.PATTERNS.values(), *config.FORBIDDEN]:
        re.compile(p)


def test_nothing_outside_imports_llm():
    for path in (ROOT / "lakewarden").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("lakewarden.llm") for n in names), path
