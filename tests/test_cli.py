"""Commands print JSON and fail with codes."""

import json

from sluice import cli
from sluice.client import Client


def test_commands(spark, tmp_path, capsys):
    client = Client(spark, f"file://{tmp_path}")

    def run(*argv, code=0):
        assert cli.main(list(argv), lambda: client) == code
        got = capsys.readouterr()
        return got.out if not code else json.loads(got.err)

    assert json.loads(run("code", "explain", "SQL0014"))["queries"] == ["diag_sql0014_cursor_row", "diag_sql0014_group_row", "diag_sql0014_groups_of_stream"]
    assert run("stream", "get", "orders", code=1)["code"] == "SQL0005"
    assert json.loads(run("stream", "register", "orders", "--partition-size", "10"))["partition_size"] == 10
    client.stream("orders").produce([{"payload": "1", "message_key": "k", "compaction_rank": 0}])
    assert json.loads(run("key", "head", "orders", "k"))["id"] == 1
    assert json.loads(run("consumer", "register", "orders", "g", "--pattern", "a.*"))["name"] == "g"
    assert json.loads(run("consumer", "binding", "orders", "g")) == ["a.*"]
    assert json.loads(run("stream", "messages", "orders"))[0]["id"] == 1
    assert json.loads(run("stream", "health", "orders"))[0]["verdict"].startswith("unsafe")
    assert run("stream", "destroy", "orders", code=1)["code"] == "SQL0006"
    assert json.loads(run("stream", "destroy", "orders", "--force")) == {"destroyed": "orders"}
    assert len(json.loads(run("alert", "list"))) == 4
    assert json.loads(run("stream", "register", "orders"))["name"] == "orders"
    assert json.loads(run("maintenance", "status", "orders", "janitor")) == {"janitor": "enabled"}
    assert json.loads(run("maintenance", "suspend", "orders", "janitor")) == {"janitor": "suspended"}
    assert json.loads(run("worker", "list"))[0]["state"] == "suspended" and json.loads(run("worker", "run")) == {}
    assert json.loads(run("system", "migrate")) == {"system": True, "streams": 1}
