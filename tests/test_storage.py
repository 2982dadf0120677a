import os
import shutil
import time
import uuid

import pytest

from tamarack.storage import materialize, scope, shared_dir, sweep, tables_dir


def local(url):
    return url.removeprefix("file://")


def test_tables_end_with_their_scope(spark):
    before = materialize(spark.range(3))
    with scope(spark):
        inner = materialize(spark.range(5))
        with scope(spark):
            materialize(spark.range(7))
        assert inner.count() == 5 and len(os.listdir(local(tables_dir(spark)))) >= 2
        left = set(os.listdir(local(tables_dir(spark))))
    assert before.count() == 3 and len(left - set(os.listdir(local(tables_dir(spark))))) == 1
    with pytest.raises(ZeroDivisionError), scope(spark):
        materialize(spark.range(9))
        raise ZeroDivisionError
    assert len(os.listdir(local(tables_dir(spark)))) == len(left) - 1


def test_sweep_removes_old_folders_of_other_applications_only(spark):
    base = local(shared_dir(spark)) + "/tamarack"
    mine = materialize(spark.range(4))
    old, new = (f"app-{uuid.uuid4().hex}" for _ in range(2))
    for name, age in ((old, 8 * 86_400), (new, 0)):
        os.makedirs(f"{base}/{name}/t")
        os.utime(f"{base}/{name}/t", (time.time() - age,) * 2)
        os.utime(f"{base}/{name}", (time.time() - age,) * 2)
    gone = sweep(spark)
    assert old in gone and new not in gone and mine.count() == 4 and not os.path.exists(f"{base}/{old}")
    shutil.rmtree(f"{base}/{new}")
