import pytest

from potable import session


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" and self.value else default


class _SC:
    applicationId = "app-test-unset"
    master = "local[2]"

    def __init__(self):
        self.dir = None

    def getConf(self):
        return _Conf(None)

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


class _Spark:
    def __init__(self, value):
        self.conf = _Conf(value)
        self.sparkContext = _SC()


def test_checkpoint_dir_read_from_session():
    s = _Spark("/shared/ckpt")
    assert session.checkpoint_dir(s) == "/shared/ckpt"
    assert s.sparkContext.dir == "/shared/ckpt"
    assert session.run_folder(s, "t") == "/shared/ckpt/t"


def test_checkpoint_dir_unset_makes_local_scratch_without_setting_conf():
    s = _Spark(None)
    d = session.checkpoint_dir(s)
    assert d and s.sparkContext.dir == d
    assert session.checkpoint_dir(s) == d  # stable within the application


def test_a_cluster_without_a_shared_folder_is_an_error():
    s = _Spark(None)
    s.sparkContext.master = "spark://host:7077"
    s.sparkContext.applicationId = "app-test-cluster"
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(s)
