import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from aforo.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


BILL_SCHEMA = (
    "codudu long, codcon long, coddis int, nomdis string, codcat string, nomcat string, situdu string, "
    "coorpx double, coorpy double, volfac double, imagua double, imalca double, imcafi double, "
    "hoxdia double, diasem double, codtis int, codmof string, nuanio int, nummes int"
)
BILL = dict(
    codudu=1, codcon=1, coddis=1, nomdis="D", codcat="102", nomcat="x", situdu="1", coorpx=0.0, coorpy=0.0,
    volfac=1.0, imagua=1.0, imalca=1.0, imcafi=1.0, hoxdia=24.0, diasem=7.0, codtis=1, codmof="A",
    nuanio=2021, nummes=1,
)


@pytest.fixture(scope="session")
def bills(spark):
    """Builds billing records from the fields that matter to a test."""

    def make(*rows):
        names = [c.split()[0] for c in BILL_SCHEMA.split(", ")]
        return spark.createDataFrame([tuple({**BILL, **r}[n] for n in names) for r in rows], BILL_SCHEMA)

    return make
