import http.server
import threading

from plenum.sources import fetch


def test_fetched(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"page")
    rows = spark.createDataFrame([(1, f"file://{tmp_path}/a.html"), (2, f"file://{tmp_path}/none.html"), (3, None), (4, "nonsense")], "id long, url string")
    found = {r["id"]: (r["content"] and bytes(r["content"]), r["error"]) for r in fetch.fetched(rows, files=True).collect()}
    assert found[1] == (b"page", None) and all(found[k][0] is None and found[k][1] for k in (2, 3, 4))
    refused = fetch.fetched(rows).where("id = 1").first()
    assert refused["content"] is None and "may be fetched" in refused["error"]


def test_broken_answers():
    assert all(fetch.get(u, 1)[0] is None and fetch.get(u, 1)[1] for u in ("http://a b/", "http://127.0.0.1:1/", "https://[x/", "ftp://x/"))


class Short(http.server.BaseHTTPRequestHandler):
    """Promises more than it sends."""

    def do_GET(self):
        self.send_response(200)
        self.send_header("Content-Length", "100")
        self.end_headers()
        self.wfile.write(b"x")

    def log_message(self, *args):
        pass


def test_short_answer():
    server = http.server.HTTPServer(("127.0.0.1", 0), Short)
    threading.Thread(target=server.handle_request, daemon=True).start()
    content, error = fetch.get(f"http://127.0.0.1:{server.server_port}/", 5)
    server.server_close()
    assert content is None and error.startswith("IncompleteRead")


def test_paged(spark, tmp_path):
    for start in (0, 2, 4):
        (tmp_path / f"p{start}.xml").write_bytes(b"x" * (start + 1))
    rows = fetch.paged(spark, f"file://{tmp_path}/p{{start}}.xml", 5, 2, files=True)
    assert rows.rdd.getNumPartitions() == 3
    assert sorted((r["start"], len(r["content"])) for r in rows.collect()) == [(0, 1), (2, 3), (4, 5)]


def test_paged_until_empty(spark, tmp_path):
    for k in range(12):
        (tmp_path / f"p{k * 10}.xml").write_bytes(b"<row/>" if k < 5 else b"<none/>")
    rows = fetch.paged(spark, f"file://{tmp_path}/p{{start}}.xml", page=10, row="<row", stripes=3, files=True)
    assert sorted(r["start"] for r in rows.collect()) == [0, 10, 20, 30, 40]
