import os

import pytest

from hubflow.llm import scratch


def test_tables_are_removed_when_released(spark):
    df = scratch.written(spark.range(10), "some")
    (path,) = {os.path.dirname(f.removeprefix("file:")).replace("//", "/") for f in df.inputFiles()}
    assert df.count() == 10 and os.path.isdir(path)
    scratch.release(df)
    assert not os.path.exists(path)


def test_a_cluster_must_name_a_shared_folder():
    class Conf:
        get = staticmethod(lambda key, default=None: None)

    class Session:
        conf = Conf
        sparkContext = type("Context", (), {"master": "yarn", "getConf": staticmethod(lambda: Conf)})

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session)
