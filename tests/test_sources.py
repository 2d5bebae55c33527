import json

import pytest

from palimpso.sources import artifacts as A


def test_artifacts(spark, tmp_path):
    d = tmp_path / "doc"
    d.mkdir()
    (d / "a.md").write_text("## Điều 1. A")
    (d / "a_full.md").write_text("full")
    (d / "b.md").write_text("no metadata")
    (d / "a_metadata.json").write_text(json.dumps({"document_id": "1/2020/X", "effective_date": "2020-01-01", "embed_in_qdrant": True}))
    rows = A.artifacts(spark, f"file://{tmp_path}").collect()
    assert [(r.stem, r.document_id) for r in rows] == [("a", "1/2020/X")]


def test_manifest_and_jsonl(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"A": ["Điều 1"], "B": {"embed_in_qdrant": False}}))
    rows = {r.document_id: r for r in A.manifest(spark, str(tmp_path / "m.json")).collect()}
    assert rows["A"].include_locations == ["Điều 1"] and rows["A"].embed and not rows["B"].embed and rows["B"].include_locations == []
    (tmp_path / "r.jsonl").write_text('﻿{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in A.jsonl(spark, str(tmp_path / "r.jsonl"), "a int").collect()] == [1, 2]
    (tmp_path / "bad.jsonl").write_text("[1\n")
    with pytest.raises(Exception):
        A.jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    assert A.dictionary(spark, str(tmp_path / "none.json")).count() == 0


def test_snapshot_digest(spark, tmp_path):
    import hashlib

    (tmp_path / "s.bin").write_bytes(b"abc")
    good = hashlib.sha256(b"abc").hexdigest()
    assert A.checked_snapshot(spark, str(tmp_path / "s.bin"), good).count() == 1
    with pytest.raises(Exception):
        A.checked_snapshot(spark, str(tmp_path / "s.bin"), "0" * 64).collect()
    A.write_snapshot(spark.range(2), str(tmp_path / "out"))
    with pytest.raises(Exception):
        A.write_snapshot(spark.range(2), str(tmp_path / "out"))


def test_rest_stands_without_the_llm_folder():
    """Nothing outside names the optional subpackage but the driver's entry."""
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "palimpso"
    for p in root.rglob("*.py"):
        if p.parent.name != "llm":
            assert not re.search(r"palimpso\.llm|from \.+llm|import llm", p.read_text()), p


def test_docx(spark, tmp_path):
    import zipfile

    from palimpso.sources import artifacts

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda *t: f"<w:tc>{''.join(map(p, t))}</w:tc>"
    body = p("Luật") + p(" ") + f"<w:tbl><w:tr>{cell('a', 'b')}{cell('c')}</w:tr><w:tr>{cell('')}</w:tr></w:tbl>" + "<w:p><w:r><w:t>Điều</w:t><w:tab/><w:t>1</w:t></w:r></w:p>"
    (tmp_path / "sub").mkdir()
    with zipfile.ZipFile(tmp_path / "sub" / "x.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}<w:sectPr/></w:body></w:document>')
    with zipfile.ZipFile(tmp_path / "empty.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body/></w:document>')
    got = artifacts.docx_blocks(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.kind, r.text, r.rows) for r in got] == [("paragraph", "Luật", None), ("table", None, [["a\nb", "c"], [""]]), ("paragraph", "Điều\t1", None)]
