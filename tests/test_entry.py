"""The entry module with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_other_queries_stay_when_the_training_data_part_is_gone(tmp_path):
    """Only compiled leftovers remain of the deleted folder."""
    (tmp_path / "surfparc").mkdir()
    for entry in (ROOT / "surfparc").iterdir():
        if entry.name != "llm":
            (tmp_path / "surfparc" / entry.name).symlink_to(entry)
    (tmp_path / "surfparc" / "llm" / "__pycache__").mkdir(parents=True)
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and 'argmax_labels' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    # A copy of the module, so that its folder is the one searched first.
    (tmp_path / "run.py").write_text(f"import sys; sys.path.insert(0, {str(tmp_path)!r}); {code}")
    subprocess.run([sys.executable, str(tmp_path / "run.py")], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"})
