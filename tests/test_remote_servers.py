import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tessera.operators.index import SearchIndex
from tessera.plans.everywhere import search_sides
from tessera.sources.remote import NoServerAnswered, RemoteServers

HITS = [
    {"id": "1", "path": "a/x.md", "title": "x", "snippet": "alpha", "score": 3.0, "match_count": 2, "paragraphs": [{"id": "1#0", "label": "p", "snippet": "alpha", "score": 3.0}]},
    {"id": "2", "path": "outlook:s/e", "score": 9.0}, {"id": "3", "path": "b/mail.txt", "score": 8.0, "doc_kind": "email"}, {"id": "4", "path": "b/y.txt", "score": 1.5},
]


@pytest.fixture
def server():
    """A search server that answers by its path's first name, and what it was asked."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            kind = self.path.split("/")[1]
            asked.append(body)
            code = 401 if self.headers["Authorization"] != "Bearer good" else 503 if kind == "down" else 200
            if kind == "slow":
                time.sleep(2)
            text = {"bad": "{", "odd": '{"hits": [{"id": 1}]}', "none": '{"hits": []}'}.get(kind, json.dumps({"hits": HITS}))
            try:
                self.send_response(code)
                self.end_headers()
                self.wfile.write(text.encode())
            except OSError:
                pass

        def log_message(self, *args):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", asked
    http.shutdown()
    http.server_close()


def test_every_failure_is_a_status(spark, server):
    root, _ = server
    kinds = ["ok", "down", "bad", "odd", "none", "slow"]
    sides = RemoteServers(spark, [*(f"{root}/{k}/" for k in kinds), "http://127.0.0.1:9"], "good", 1)
    found, status = sides.hits("alpha", 10)
    named = {u.rsplit("/", 1)[-1]: s for u, s in status.items()}
    assert named == {"ok": "answered", "down": "http 503", "bad": "malformed", "odd": "malformed", "none": "answered", "slow": "timeout", "127.0.0.1:9": "unreachable"}
    assert [(r["path"], r["match_count"], r["ext"]) for r in found.collect()] == [("a/x.md", 2, "md"), ("b/y.txt", 0, "txt")]
    with pytest.raises(NoServerAnswered, match="unauthorized"):
        RemoteServers(spark, [f"{root}/ok"], "wrong").hits("alpha", 10)
    assert RemoteServers(spark, [f"{root}/none"], "good").hits("alpha", 10)[0].count() == 0


def test_scope_and_types_go_along_and_are_applied_again(spark, server):
    root, asked = server
    found, _ = RemoteServers(spark, [f"{root}/ok"], "good").hits("alpha", 7, "A", [".MD"])
    assert [r["path"] for r in found.collect()] == ["a/x.md"]
    assert asked == [{"query": "alpha", "limit": 28, "path_prefix": "A", "exts": ["md"]}]  # asked once
    asked.clear()
    rows = RemoteServers(spark, [f"{root}/ok"], "good").asked("alpha", 50).where(F.col("ext").isin("txt", "md") & (F.col("ext") == "txt"))
    assert [r["path"] for r in rows.collect()] == ["b/y.txt"] and asked[-1]["exts"] in (["txt"], ["txt", "md"], ["md", "txt"]) and asked[-1]["limit"] == 50


def test_hybrid_search_with_servers(spark, server):
    root, _ = server
    files = spark.createDataFrame([("1", "c/one.txt", "one", "alpha beta", "txt", "file")], "unit_key string, path string, title string, body string, ext string, doc_kind string")
    local = lambda: SearchIndex.build(files)
    found, status = search_sides("alpha", 5, local=local, remote=lambda: RemoteServers(spark, [f"{root}/down", f"{root}/ok"], "good"), mode="hybrid")
    assert status == {"local": "answered", "remote": "answered"} and {(r["path"], r["source"]) for r in found.collect()} == {("a/x.md", "remote"), ("b/y.txt", "remote"), ("c/one.txt", "local")}
    found, status = search_sides("alpha", 5, local=local, remote=lambda: RemoteServers(spark, [f"{root}/slow"], "good", 1), mode="hybrid")
    assert status == {"local": "answered", "remote": "failed: NoServerAnswered"} and [r["source"] for r in found.collect()] == ["local"]
    with pytest.raises(AnalysisException, match="urls and token"):
        RemoteServers(spark, [f"{root}/ok"], " ").hits("alpha", 5)
