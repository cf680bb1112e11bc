from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from tillvault.plans.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    spark = local_session(cpus=8, memory="6g")
    # Hundreds of small plans run once each: few partitions, and no time spent on
    # compiling them. tests/compare.py runs the queries with code generation.
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    return spark


@pytest.fixture
def drop(tmp_path):
    """Writes an export file: drop('x.csv', header, rows, encoding) -> path."""

    def write(name: str, header: list[str], rows: list[list[str]], encoding: str = "cp1252") -> str:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        text = "".join(";".join(line) + "\n" for line in [header, *rows])
        path.write_bytes(text.encode(encoding))
        return str(path)

    return write
