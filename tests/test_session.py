"""Where intermediate tables go."""

from __future__ import annotations

import pytest

from plumbline import session


class Fake:
    """A session with a master and, perhaps, a checkpoint folder."""

    def __init__(self, master, folder=None):
        self.sparkContext, self.conf = self, self
        self.master, self.folder, self.applicationId = master, folder, f"{master}-{folder}"

    def get(self, key, default):
        return self.folder if key == "spark.checkpoint.dir" else default


def test_the_named_folder_is_used():
    assert session.shared_folder(Fake("spark://x", "hdfs://a/b/")) == "hdfs://a/b"


def test_a_cluster_without_one_is_an_error():
    with pytest.raises(ValueError):
        session.shared_folder(Fake("spark://x"))


def test_a_local_application_keeps_its_scratch_folder():
    assert session.shared_folder(Fake("local[2]")) == session.shared_folder(Fake("local[2]"))
