import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from scriptorium.__main__ import main
from scriptorium.config import SYSTEM_LOCAL
from scriptorium.plans import extractors


def lines(folder):
    return [json.loads(x) for f in sorted(folder.glob("part-*")) for x in f.read_text(encoding="utf-8").splitlines()]


def test_prepare_and_convert(spark, tmp_path):
    cells = "".join(f"\"[(1, 's', '<O>少师</O><P>蹇义{k}</P>卒')]\"\n" for k in range(10))
    (tmp_path / "a.csv").write_text("Related Texts\n" + cells, encoding="utf-8")
    main(["prepare", "--csv", str(tmp_path / "a.csv"), "--out", str(tmp_path / "data")])
    assert len(lines(tmp_path / "data/train.jsonl")) == 10 and len(lines(tmp_path / "data/valid.jsonl")) == 1
    (tmp_path / "x.jsonl").write_text(json.dumps({"instruction": "后", "input": "后", "output": "[]"}) + "\n", encoding="utf-8")
    (tmp_path / "p.json").write_text(json.dumps({"后": "後"}), encoding="utf-8")
    main(["convert", "--examples", str(tmp_path / "x.jsonl"), "--phrases", str(tmp_path / "p.json"), "--out", str(tmp_path / "converted")])
    assert lines(tmp_path / "converted") == [{"instruction": "后", "input": "後", "output": "[]"}]


def test_validate(spark, tmp_path):
    spark.createDataFrame([("a", 1, "page text")], "doc_id string, page_no int, text string").write.parquet(str(tmp_path / "pages"))
    (tmp_path / "e.jsonl").write_text('{"doc_id":"a","page":1,"evidence":"text"}\n{"doc_id":"a","page":2,"evidence":"text"}\n')
    main(["validate", "--entities", str(tmp_path / "e.jsonl"), "--pages", str(tmp_path / "pages"), "--out", str(tmp_path / "out")])
    assert [r["start"] for r in lines(tmp_path / "out/accepted")] == [5] and [r["reason"] for r in lines(tmp_path / "out/rejected")] == ["invalid page"]


@pytest.fixture
def service():
    """A service on this machine that keeps what it is asked and answers as either kind of model."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((body, self.headers.get("Authorization")))
            if "prompt" in body:
                answer = {"response": '[{"name": "蹇义"}]' if "蹇义" in body["prompt"] else "none found"}
            elif body["model"] == "small":
                self.send_error(503)
                return
            else:
                item = {"name": "蹇义", "rank": None, "action": "去世", "event_type": "Death", "time": None, "quote": "少师蹇义卒"}
                answer = {"choices": [{"message": {"content": json.dumps({"items": [item]})}}]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}", asked
    server.shutdown()


def test_extract_with_both_profiles(spark, tmp_path, service, monkeypatch):
    url, asked = service
    pages = [(1, 0, "宣德九年，少师蹇义卒。"), (2, 0, "无事。"), (2, 30, "debug page")]
    spark.createDataFrame(pages, "doc_id long, page_no int, text string").write.parquet(str(tmp_path / "pages"))
    options = ["extract", "--pages", str(tmp_path / "pages"), "--url", url]
    main([*options, "--out", str(tmp_path / "local"), "--model", "m"])
    assert [(r["doc_id"], r["name"]) for r in lines(tmp_path / "local")] == [(1, "蹇义")]
    bad = [f.read_text() for f in (tmp_path / "local-bad").glob("doc_id=2/chunk_id=0/*.txt")]
    assert len(bad) == 1 and bad[0].startswith("=== CHUNK TEXT ===\n无事。")
    # each chunk once, with the instruction before it
    assert len(asked) == 2 and all(b["prompt"].startswith(SYSTEM_LOCAL) and b["options"]["num_predict"] == 700 for b, _ in asked)
    asked.clear()
    monkeypatch.setenv("OWN_KEY", "k")
    monkeypatch.setattr(extractors.time, "sleep", lambda s: None)
    main([*options, "--out", str(tmp_path / "api"), "--profile", "api", "--model", "small", "--fallback", "large", "--key-variable", "OWN_KEY"])
    assert [(r["doc_id"], r["name"], r["quote"]) for r in lines(tmp_path / "api")] == [(1, "蹇义", "少师蹇义卒")]
    assert {b["model"] for b, _ in asked} == {"small", "large"} and all(k == "Bearer k" for _, k in asked)
    asked.clear()
    with pytest.raises(SystemExit, match="nothing answers"):
        main([*options[:-1], "http://127.0.0.1:9", "--out", str(tmp_path / "none"), "--model", "m"])
    main([*options, "--out", str(tmp_path / "debug"), "--model", "m", "--debug"])
    assert len(asked) == 1 and "debug page" in asked[0][0]["prompt"]
