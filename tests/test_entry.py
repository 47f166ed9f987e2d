import re
from pathlib import Path

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_imports_nothing_of_the_training_data_subpackage():
    root = Path(entry.__file__).parent / "tallyspark"
    for path in root.rglob("*.py"):
        if path.parent.name != "llm":
            assert not re.search(r"tallyspark\.llm|corpus_pipeline", path.read_text()), path
