from __future__ import annotations

import io
import json
import zipfile
from email.message import EmailMessage

from foliant.operators.chunking import count_tokens
from foliant.sources import files, parsers
from foliant.streaming import changes as E


def test_decode():
    assert parsers.decode("é한".encode()) == ("é한", "utf-8-sig")
    assert parsers.decode("안녕".encode("euc_kr"))[0] and parsers.decode(b"\xff\xfea\x00")[0].endswith("a")


def test_html():
    page = "<html><head><title>T</title><style>x{}</style></head><body><h2>Head</h2><p>a  b<br>c</p><!-- no --><table><tr><td>1</td></tr></table><script>no()</script><p>end</p></body></html>"
    assert parsers.html_blocks(page) == ["## Head", "a b\nc", "end", "<table><tr><td>1</td></tr></table>"]
    assert parsers.html_blocks("") == [] and parsers.budget_chunks(["a b", "c d", "e " * 10], 4, count_tokens)[0] == "a b\nc d"


def test_json():
    value = {"a": {"b": "x" * 60, "c": "y" * 60}, "l": [1, 2]}
    pieces = parsers.json_chunks(value, 100)
    assert len(pieces) > 1 and {k for p in pieces for k in p} == {"a", "l"} and all(len(json.dumps(p)) <= 110 for p in pieces)
    assert parsers.json_chunks(0) == [0] and parsers.json_chunks(None) == parsers.json_chunks({}) == parsers.json_chunks("") == []
    assert parsers.json_chunks([{"a": 1}, "x"]) == [{"0": {"a": 1}, "1": "x"}] and parsers.json_chunks({"a": [], "b": {}}) == [{"a": {}, "b": {}}]
    many = {f"k{i}": {"t": "é" * (i * 13 % 90), "n": [i, {"m": "y" * (i % 40)}]} for i in range(200)}
    cut = parsers.json_chunks(many, 600, 300)
    assert all(len(json.dumps(c, ensure_ascii=False)) < 600 for c in cut) and sum(len(json.dumps(c, ensure_ascii=False)) >= 300 for c in cut[:-1]) == len(cut) - 1
    merged: dict = {}
    for c in cut:
        for k, v in c.items():
            merged.setdefault(k, {}).update(v) if "n" not in merged.get(k, {}) else merged[k]["n"].update(v.get("n", {}))
    assert merged == {k: {"t": v["t"], "n": {"0": v["n"][0], "1": v["n"][1]}} for k, v in many.items()}
    assert parsers.is_json_lines('{"a":1}\n{"a":2}') and not parsers.is_json_lines('[{"a":1}]') and not parsers.is_json_lines("a\nb")


def test_documents():
    message = EmailMessage()
    message["Subject"], message["From"] = "Hi", "a@b"
    message.set_content("plain body")
    message.add_attachment(b"123", maintype="application", subtype="x", filename="f.bin")
    parts = parsers.email_parts(message.as_bytes())
    assert parts["headers"]["subject"] == "Hi" and parts["text"] == "plain body" and parts["attachments"] == [("f.bin", 3)]
    w = 'xmlns:w="http://x"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
        z.writestr("META-INF/container.xml", '<c><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></c>')
        z.writestr("o/p.opf", '<package><manifest><item id="2" href="b.html"/><item id="1" href="a.html"/></manifest><spine><itemref idref="1"/><itemref idref="2"/></spine></package>')
        z.writestr("o/a.html", "<p>first</p>")
        z.writestr("o/b.html", "<p>second</p>")
    assert parsers.docx_blocks(buffer.getvalue()) == ["One", "a | b"] and parsers.epub_chapters(buffer.getvalue()) == [["first"], ["second"]]


def test_readers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.html").write_text("<p>x</p>")
    (tmp_path / "in/b.docx").write_bytes(b"not a zip")
    rows = {r["path"].rpartition("/")[2]: r for r in files.read_blocks(spark, str(tmp_path / "in")).collect()}
    assert rows["a.html"]["block"] == "x" and rows["b.docx"]["error"].startswith("BadZipFile")
    (tmp_path / "t.csv").write_text("a,b\n1,2\n3\n4,5,6\n7,8\n")
    good, bad = files.read_delimited(spark, str(tmp_path / "t.csv"), ["a", "b"])
    assert sorted(r["a"] for r in good.collect()) == ["1", "7"] and sorted(r["line"] for r in bad.collect()) == ["3", "4,5,6"]
    (tmp_path / "t.jsonl").write_text('{"a": 1}\nnope\n')
    assert sorted(r["valid"] for r in files.read_json_lines(spark, str(tmp_path / "t.jsonl")).collect()) == [False, True]


def test_versioned_sets(spark, tmp_path):
    sets = files.VersionedSets(spark, str(tmp_path / "sets"))
    first = sets.stage("chunks", spark.range(3))
    assert sets.active("chunks") is None and not sets.activate("chunks", first, None, 4) and sets.activate("chunks", first, None, 3)
    second = sets.stage("chunks", spark.range(5))
    assert not sets.activate("chunks", second, "other", 5) and sets.activate("chunks", second, first, 5)
    assert sets.read("chunks").count() == 5 and sets.purge("chunks") == 1 and sets.read("chunks").count() == 5
    third = sets.stage("chunks", spark.range(7))
    assert sets.purge("chunks") == 0 and sets.activate("chunks", third, second, 7) and sets.read("chunks").count() == 7
    fresh = sets.stage("other", spark.range(2))
    assert sets.purge("other") == 0 and sets.activate("other", fresh, None, 2) and not sets.activate("other", fresh, None, 2)


def outcomes(step, rows):
    state, out = None, []
    for row in rows:
        state, outcome = step(state, row)
        out.append(outcome)
    return out


def test_state_machines():
    log = [(1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (1, 2, "x"), (1, 4, "c"), (1, 3, "c"), (2, 1, "d"), (1, 4, "e")]
    assert outcomes(E.next_in_log, [dict(epoch=e, sequence=n, digest=d) for e, n, d in log]) == ["OK", "OK", "REPLAY", "CONFLICT", "GAP", "OK", "OK", "STALE"]
    seen = [(1, 5), (1, 4), (2, 1), (2, 1), (1, 9)]
    assert outcomes(E.next_observation, [dict(epoch=e, generation=g) for e, g in seen]) == ["APPLIED", "IGNORED_STALE", "APPLIED", "REPLAY", "IGNORED_STALE"]
    marks = [("a", 0.0), ("a", 5.0), ("a", 10.0), ("b", 11.0), ("b", 30.0)]
    assert outcomes(E.next_fingerprint, [dict(fingerprint=m, seconds=s) for m, s in marks]) == ["WAITING", "WAITING", "STABLE", "WAITING", "STABLE"]


def test_ordered_log_stream(spark, tmp_path):
    rows = [("s", 1, n, d, i) for i, (n, d) in enumerate([(1, "a"), (2, "b"), (2, "b"), (4, "c"), (3, "c")])]
    schema = "source_id string, epoch bigint, sequence bigint, digest string, arrival bigint"
    spark.createDataFrame(rows[::-1], schema).write.parquet(str(tmp_path / "log"))
    out = E.run_available(E.ordered_log(spark.readStream.schema(schema).parquet(str(tmp_path / "log"))))
    assert [r["outcome"] for r in out.orderBy("arrival").collect()] == ["OK", "OK", "REPLAY", "GAP", "OK"]
