"""The shared folder: that of the session, a temporary one on a local master, an error on a cluster that names none."""

from types import SimpleNamespace

import pytest

from tideframe.llm.shared import shared_dir


def _session(master, conf="", context=""):
    found = SimpleNamespace(dir=context)
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: conf or default),
        sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: found.dir, setCheckpointDir=lambda d: setattr(found, "dir", d)),
    )


def test_shared_folder():
    assert shared_dir(_session("spark://host:7077", "hdfs:///shared")) == "hdfs:///shared"
    assert shared_dir(_session("yarn", context="hdfs:///context")) == "hdfs:///context"
    local = _session("local[8]")
    assert shared_dir(local).startswith("file:///") and shared_dir(local) == shared_dir(local)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(_session(master))
