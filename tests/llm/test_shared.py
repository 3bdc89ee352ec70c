import os
import tempfile
from types import SimpleNamespace

import numpy as np
import pytest
from pyarrow import fs

from kindred.llm.shared import SLICE, Store, shared_folder, with_columns


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, getConf=lambda: {})
    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=context))


def test_copies_of_files_leave_nothing_behind(tmp_path, monkeypatch):
    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path / "own"))
    os.makedirs(tmp_path / "own")
    store, far = Store(str(tmp_path / "far")), fs.SubTreeFileSystem(str(tmp_path / "far"), fs.LocalFileSystem())
    store.save("a/b", np.arange(9))
    store.save("none", np.empty(0))
    monkeypatch.setattr(store, "_at", lambda name: (far, name))
    mapped = store.load("a/b", np.int64)
    assert isinstance(mapped, np.memmap) and mapped.tolist() == list(range(9)) and os.listdir(tmp_path / "own") == []
    assert store.load("none", np.int64).size == store.load("missing", np.int64).size == 0


@pytest.mark.parametrize(("before", "most"), [("10000", SLICE), ("7", 7), ("0", SLICE)])
def test_batches_of_texts_are_small(spark, before, most):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    spark.conf.set(name, before)
    try:
        with_columns(spark.range(1), ["id"], "twice long", lambda ids: ((2 * i,) for i in ids))
        assert spark.conf.get(name) == str(most)
    finally:
        spark.conf.set(name, own)
