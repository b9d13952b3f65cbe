import pytest

from quayline import session


class FakeContext:
    master = "spark://somewhere"


class FakeSession:
    """A cluster session, as far as the folder rules look at one."""

    sparkContext = FakeContext()

    def __init__(self, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}


def test_a_cluster_must_name_its_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(FakeSession())
    assert session.shared_folder(FakeSession("s3a://b/tmp/")) == "s3a://b/tmp"


def test_runs_do_not_share_a_folder(spark):
    one, two = (session.run_folder(spark, "x") for _ in range(2))
    assert one != two and one.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_settings_come_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(RuntimeError), session.setting(spark, "spark.sql.shuffle.partitions", "3"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        raise RuntimeError
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    with session.setting(spark, "quayline.unknown", "1"):
        assert spark.conf.get("quayline.unknown") == "1"
    assert spark.conf.get("quayline.unknown", None) is None
