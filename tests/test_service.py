import json
import threading
import urllib.error
import urllib.request

import pytest

from tamarack.engine.generators import FailoverGenerator, NoReply, OracleGenerator, ReplayGenerator
from tamarack.engine.http import server
from tamarack.engine.repair import FixedGenerator, Service
from tamarack.retrieval import shop
from tamarack.sources.synthetic import synthetic_schema


def test_generators(spark):
    stored = spark.createDataFrame([("2", "a?", "second"), ("1", "a?", "first"), ("3", "b?", None), ("4", "other", "x")], "example_id string, question string, raw_output string")
    replay = ReplayGenerator.of(stored, ["a?", "b?"])
    assert [replay.generate("a?", "") for _ in range(3)] == ["first", "second", "second"] and "other" not in replay.replies
    with pytest.raises(NoReply):
        replay.generate("b?", "")
    chain = FailoverGenerator([replay, OracleGenerator({"b?": "SELECT 1"})])
    assert chain.generate("b?", "") == "SELECT 1" and chain.failures == [1, 0]
    with pytest.raises(NoReply):
        chain.generate("c?", "")


@pytest.fixture(scope="module")
def base(spark):
    views = {"http_items": spark.range(20).selectExpr("id", "id % 3 AS k")}
    service = Service(spark, views, FixedGenerator({"how many?": "SELECT count(*) AS n FROM http_items", "broken?": "SELECT nope FROM http_items"}, "SELECT id FROM http_items"), schema="http_items(id integer)")
    running = server(service)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{running.server_address[1]}"
    running.shutdown()


def call(url, body=None):
    data = None if body is None else body if isinstance(body, bytes) else json.dumps(body).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data)) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as error:
        return error.code, json.loads(error.read())


def test_pages(base):
    status, found = call(f"{base}/health")
    assert status == 200 and found["engine"] and found["status"] == "ok"
    assert call(f"{base}/schema")[1]["tables"] == ["http_items"]
    assert call(f"{base}/nowhere")[0] == 404 and call(f"{base}/nowhere", {})[0] == 404


def test_questions(base):
    status, found = call(f"{base}/query", {"question": "how many?"})
    assert status == 200 and found["ok"] and found["rows"] == [["20"]] and found["row_count"] == 1
    status, found = call(f"{base}/query", {"question": "broken?", "repair": False})
    assert status == 200 and not found["ok"] and found["problem"] == "unknown_column"
    status, found = call(f"{base}/query", {"question": "all", "max_rows": 3, "include_rows": False})
    assert found["truncated"] and found["rows"] == [] and found["row_count"] == 3


@pytest.mark.parametrize("body", [b"no json", b"[]", {}, {"question": 3}, {"question": " "}, {"question": "x", "max_rows": 5000}, {"question": "x", "max_rows": True}, {"question": "x", "other": 1}])
def test_bad_requests(base, body):
    status, found = call(f"{base}/query", body)
    assert status == 422 and "Traceback" not in found["detail"]


def test_invented_tables(spark):
    counts = {t.name: n for t, n in zip(shop.TABLES, [40, 10, 5, 6, 50, 300, 200, 900, 2000, 900, 900, 500])}
    tables = synthetic_schema(spark, shop.TABLES, counts, seed=3)
    orders, again = tables["orders"], synthetic_schema(spark, shop.TABLES, counts, seed=3)["orders"].repartition(7)
    assert orders.count() == 900 and orders.exceptAll(again).count() == 0 and orders.columns == list(next(t for t in shop.TABLES if t.name == "orders").columns)
    assert orders.join(tables["customers"], "customer_id", "left_anti").count() == 0
    top = orders.groupBy("customer_id").count().agg({"count": "max"}).first()[0]
    assert top > 20 and 0 < orders.where("status is null").count() < 150
    assert tables["categories"].where("parent_category_id >= category_id").count() == 0
