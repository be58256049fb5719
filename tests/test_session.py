"""Checkpoint folder rules."""

import types

import pytest

from mountwait.session import checkpoint_dir


def _fake(master, configured=None):
    opt = types.SimpleNamespace(isDefined=lambda: False, get=lambda: None)
    sc = types.SimpleNamespace(
        master=master,
        _jsc=types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: opt)),
        getConf=lambda: {"spark.checkpoint.dir": configured} if configured else {},
        setCheckpointDir=lambda d: None)
    conf = types.SimpleNamespace(get=lambda k, default=None: default)
    return types.SimpleNamespace(sparkContext=sc, conf=conf)


def test_cluster_without_shared_folder_refuses():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(_fake("yarn"))


def test_cluster_uses_the_configured_folder():
    assert checkpoint_dir(_fake("yarn", "hdfs:///ckpt")) == "hdfs:///ckpt"


def test_local_mode_gets_a_folder_when_unset():
    assert checkpoint_dir(_fake("local[4]"))


def test_real_session_has_a_folder(spark):
    assert checkpoint_dir(spark)
