from types import SimpleNamespace

import pytest

from feltloom.llm.common import shared_dir


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda name: None))
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)
