from docspark.sources import files
from docspark.sources.collection import Collection


def test_json_lines(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"id": "a", "n": 1}\n\n{"n": 2}\nnot json\n')
    df = files.read_documents(spark, str(tmp_path / "in.jsonl"))
    c = Collection.documents(df)
    rows = c.query("SELECT n FROM d WHERE n >= 1 ORDER BY n")
    assert [r["id"] for r in rows.collect()][0] == "a" and rows.count() == 2
    files.write_rows(rows, str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect())[0] == '{"id":"a","n":1}'
    files.write_documents(df.where("id = 'a'"), str(tmp_path / "docs"))
    assert spark.read.text(str(tmp_path / "docs")).first()["value"] == '{"id":"a","n":1}'


def test_attachments(spark, tmp_path):
    (tmp_path / "d1").mkdir()
    (tmp_path / "d1" / "f.txt").write_bytes(b"hello")
    row = files.read_attachments(spark, str(tmp_path)).first()
    assert (row["id"], row["name"], row["length"], bytes(row["data"])) == ("d1", "f.txt", 5, b"hello")
