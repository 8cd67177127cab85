import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from flowspark.schema import PACKET
from flowspark.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session(
        "flowspark-tests",
        master="local[4]",
        spark__sql__shuffle__partitions="2",
        spark__ui__enabled="false",
        spark__driver__memory="4g",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


def packet(seq, ts_us, src, dst, proto=6, sport=None, dport=None, size=100, flags=None,
           payload=b"", version=4, capture="c"):
    return (capture, seq, ts_us, version, src, sport, dst, dport, proto, size, flags, payload)


@pytest.fixture
def packets(spark):
    def make(rows):
        return spark.createDataFrame(rows, PACKET)

    return make
