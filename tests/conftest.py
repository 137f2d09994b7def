import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("courselake-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lake(spark):
    from courselake.plans.lake import Lake

    return Lake(spark, DATA)


ROWS = {
    "courses": ["AAA,2013J,268"],
    "assessments": ["AAA,2013J,1,TMA,20,100"],
    "vle": ["10,AAA,2013J,resource,?,?"],
    "studentInfo": ["AAA,2013J,100,F,Region,A Level or Equivalent,?,0-35,0,60,N,Pass"],
    "studentRegistration": ["AAA,2013J,100,-30,?"],
    "studentAssessment": ["1,100,19,0,70"],
    "studentVle": ["AAA,2013J,100,10,1,3"],
}


@pytest.fixture
def landing(tmp_path):
    """A folder with the seven landing files, one row each; returns a writer as well."""
    from courselake.schemas import LANDING_COLUMNS, LANDING_FILES

    folder = tmp_path / "source"
    folder.mkdir()

    def write(**changed):
        for table, file in LANDING_FILES.items():
            stem = file.removesuffix(".csv")
            rows = changed.get(stem, ROWS[stem])
            text = "\n".join([",".join(LANDING_COLUMNS[table]), *rows]) + "\n"
            (folder / file).write_text(text, encoding="utf-8")
        return str(folder)

    write()
    return write
