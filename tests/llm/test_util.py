from types import SimpleNamespace

import pytest

from askbook.llm import _util as U


class Context:
    def __init__(self, master, held=None):
        self.master, self.set, self.held = master, [], held
        self._jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: self.held is None)))

    def setCheckpointDir(self, path):
        self.set.append(path)


def frame(master, named=None, held=None):
    context = Context(master, held)
    return SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: named)), checkpoint=lambda eager: context.set)


@pytest.mark.parametrize("master", ["spark://h:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"])
def test_a_cluster_without_a_shared_folder_is_refused(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        U.checkpointed(frame(master))
    assert U.checkpointed(frame(master, "hdfs:///shared")) == ["hdfs:///shared"]
    assert U.checkpointed(frame(master, held="set")) == []


def test_one_process_may_use_a_folder_of_its_own():
    assert len(U.checkpointed(frame("local[4]"))) == 1


def test_free_name():
    assert U.free_name(["a", "_X"], "x") == "x" and U.free_name(["x", "_X"], "X") == "__X"
