"""Pages as a source and files as a sink: hosts in turn, whole jobs or nothing."""

import http.server
import os
import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F

from folioforge import named_files, sinks
from folioforge.sources import readers, web


class Server:
    """A web server that says how many requests it had at a time, and when."""

    def __init__(self):
        server = self
        self.now = self.most = 0
        self.times, self.lock = [], threading.Lock()

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                with server.lock:
                    server.now += 1
                    server.most = max(server.most, server.now)
                    server.times.append(time.monotonic())
                time.sleep(0.05)
                kind = "text/plain" if self.path.startswith("/plain") else "text/html"
                self.send_response(404 if self.path.startswith("/none") else 200)
                self.send_header("Content-Type", kind)
                self.end_headers()
                self.wfile.write(f"<title>T</title><nav>x</nav><p>Page {self.path}</p>".encode())
                with server.lock:
                    server.now -= 1

            def log_message(self, *_):
                pass

        self.http = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}"


@pytest.fixture
def servers():
    out = [Server(), Server()]
    yield out
    for s in out:
        s.http.shutdown()


def test_pages(spark, servers):
    """Each host's pages one after the other with a pause between, hosts at once."""
    urls = [f"{s.url}/p{k}" for k in range(5) for s in servers] + [f"{servers[0].url}/p1", " ", f"{servers[1].url}/plain", f"{servers[1].url}/none", f"{servers[0].url}/p2#part"]
    df = web.web_pages(spark, urls, pause=0.1, retries=0)
    assert df.rdd.getNumPartitions() == 2
    rows = {r.url: r for r in df.collect()}
    assert set(rows) == {u.partition("#")[0] for u in urls if u.strip()}
    one = rows[f"{servers[0].url}/p3"]
    assert (one.status, one.content_type, one.text) == (200, "text/html", readers.html_text(one.html)) and "Page /p3" in one.text
    assert rows[f"{servers[1].url}/plain"].text is None and rows[f"{servers[1].url}/none"].status is None
    for s in servers:
        assert s.most == 1 and min(b - a for a, b in zip(s.times, s.times[1:], strict=False)) >= 0.1
    assert servers[0].times[0] < servers[1].times[-1] and servers[1].times[0] < servers[0].times[-1]
    # Fewer columns: pages are fetched, not parsed.
    few = web.web_pages(spark, urls[:2], "status int, url string", pause=0)
    assert few.columns == ["status", "url"] and sorted(tuple(r) for r in few.collect()) == sorted((200, u) for u in urls[:2])
    assert web.web_pages(spark, []).count() == 0
    with pytest.raises(Exception, match="no such columns"):
        web.web_pages(spark, urls, "url string, other int").collect()
    parsed = readers.parsed_pages(web.web_pages(spark, urls[:2], pause=0).drop("text")).collect()
    assert {r.title for r in parsed} == {"T"} and all(r.error is None for r in parsed)


def test_many_hosts_share_partitions():
    import json

    reader = web.PageReader(["url"], {"urls": json.dumps([f"h{k}.org/{j}" for j in range(3) for k in range(50)]), "partitions": "7"})
    parts = [p.urls for p in reader.partitions()]
    hosts = [{web.host_of(u) for u in p} for p in parts]
    assert len(parts) <= 7 and sum(map(len, parts)) == 150 and sum(map(len, hosts)) == 50 and len(set.union(*hosts)) == 50
    for p in parts:  # a host's addresses stand together
        assert len([1 for a, b in zip(p, p[1:], strict=False) if web.host_of(a) != web.host_of(b)]) == len({web.host_of(u) for u in p}) - 1


def listed(folder):
    return sorted(os.listdir(folder))


def test_files(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.range(20).select(F.concat(F.lit("f"), F.col("id"), F.lit(".bin")).alias("file_name"), F.encode(F.concat(F.lit("content "), F.col("id")), "utf-8").alias("content")).repartition(4)
    for _ in range(2):
        named_files.write_files(rows, folder)
        assert listed(folder) == sorted(f"f{k}.bin" for k in range(20))
    assert (tmp_path / "out/f7.bin").read_bytes() == b"content 7"
    named_files.write_files(rows.limit(1).select(F.lit("other.bin").alias("file_name"), "content"), folder)
    named_files.write_files(rows.limit(0), folder)
    assert len(listed(folder)) == 21


def test_a_failing_job_leaves_no_file(spark, tmp_path):
    """A task that fails each time it is tried, a name twice, and a name that is none."""
    folder = str(tmp_path / "out")
    os.makedirs(folder)
    tries = str(tmp_path / f"tries-{uuid.uuid4().hex}")

    @F.udf("binary")
    def broken(k):
        if k == 15:
            with open(tries, "a") as f:
                f.write("x")
            raise OSError("no disk")
        return b"x"

    rows = spark.range(16).repartition(3)
    named = F.concat(F.lit("f"), F.col("id")).alias("file_name")
    with pytest.raises(Exception, match="no disk"):
        named_files.write_files(rows.select(named, broken("id").alias("content")), folder)
    for name, what in ((F.lit("same"), "twice"), (F.lit("../up"), "no name"), (F.lit(" "), "no name")):
        with pytest.raises(Exception, match=what):
            named_files.write_files(rows.select(name.alias("file_name"), F.lit(b"x").alias("content")), folder)
    assert os.path.getsize(tries) >= 1 and listed(folder) == []


def test_sheets_decks_and_sounds(spark, tmp_path):
    folder = str(tmp_path / "out")

    @F.pandas_udf("binary")
    def sheet(t):
        return t.map(lambda x: sinks.table_xlsx("t", ["a"], [[x]]))

    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id int, t string").select(F.concat(F.lit("t"), F.col("id"), F.lit(".xlsx")).alias("file"), sheet("t").alias("sheet"))
    named_files.write_files(rows, folder, "file", "sheet")
    said = spark.createDataFrame([(1, 0, 1, "hello", "hello"), (2, 0, 1, " ", "")], "id int, line_no int, speaker int, text string, spoken string")
    named_files.write_files(sinks.audio_files(said, "id", lambda s, t: [0.5] * 4), folder, "file", "audio")
    names = listed(folder)
    sounds = [n for n in names if n.endswith(".wav")]
    assert len(sounds) == 1 and set(names) - set(sounds) == {"t1.xlsx", "t2.xlsx"}
    assert open(f"{folder}/t1.xlsx", "rb").read(2) == b"PK"
