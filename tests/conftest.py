import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vendorlytics.session import checkpoint_dir, get_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", shuffle_partitions=4)
    checkpoint_dir(s)
    yield s


class FakeTables:
    """Tables backed by small in-memory DataFrames (unit tests)."""

    def __init__(self, spark, **frames):
        self.spark = spark
        self._frames = frames

    def __getattr__(self, name):
        frames = self.__dict__.get("_frames", {})
        if name in frames:
            return lambda: frames[name]
        raise AttributeError(name)

    def read(self, name):
        return self._frames[name]
