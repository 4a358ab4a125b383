import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sievework.session import checkpoint_dir, get_session

    s = get_session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            # the inputs are tiny: compiling the generated code would take most of the time
            "spark.sql.codegen.wholeStage": "false",
            "spark.sql.codegen.factoryMode": "NO_CODEGEN",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s, str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


@pytest.fixture
def files(spark):
    """files({path: content}) or files([(project, path, content)]) as a file table."""
    from sievework.sources.files import file_table

    def make(rows):
        if isinstance(rows, dict):
            rows = [("p", path, content) for path, content in rows.items()]
        return file_table(spark.createDataFrame(rows, "project string, path string, content string"))

    return make
