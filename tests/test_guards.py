"""M1, M2, M5: what code may not do, checked on its source."""

from __future__ import annotations

import ast
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
OWN = [p for p in (ROOT / "notewright").rglob("*.py")]
REST = [p for p in OWN if "llm" not in p.parts]


def imports(path: Path) -> set[str]:
    out = set()
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            out |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module:
            out |= {node.module, *(f"{node.module}.{a.name}" for a in node.names)}
    return out


@pytest.mark.parametrize("path", REST, ids=lambda p: p.name)
def test_nothing_imports_the_training_data_package(path):
    assert not any(n.startswith("notewright.llm") or n == "corpus_pipeline" for n in imports(path))


def test_resolution_never_reads_gold_data():
    """Extraction, linkage and ingest don't import what scores them."""
    for p in REST:
        if p.parent.name in ("functions", "sources", "streaming") or p.stem in ("linkage", "components", "extract", "coref", "generators", "intervals", "vectors", "local"):
            assert not any(n.startswith("notewright.operators.evaluate") for n in imports(p)), p


def test_no_local_checkpoints_and_no_rdds():
    for p in OWN:
        for node in ast.walk(ast.parse(p.read_text())):
            if isinstance(node, ast.Attribute):
                assert node.attr not in ("localCheckpoint", "rdd", "mapPartitions", "parallelize"), (p, node.lineno)


def test_every_query_has_a_name_of_its_own_and_loads():
    from notewright import plans

    plans.load()
    assert set(plans.ORACLE_SQL) <= set(plans.QUERIES) and len(plans.QUERIES) > 150
