import json

from pyspark.sql import functions as F

from claimforge.operators import embedding, similarity
from claimforge.sources import files


def test_binary_files_and_pages(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"one\x0ctwo\x0cthree")
    (tmp_path / "sub" / "b.PDF").write_bytes(b"one\x0ctwo\x0cthree")
    (tmp_path / "c.pdf").write_bytes(b"\xff\xfe")
    (tmp_path / "d.txt").write_bytes(b"no")
    found = files.binary_files(spark, str(tmp_path))
    assert sorted(r.filename for r in found.select("filename").collect()) == ["a.pdf", "b.PDF", "c.pdf"]
    assert found.select("content_hash").distinct().count() == 2
    decoder = lambda content: content.decode().split("\x0c")
    assert sorted((r.page_number, r.page_text) for r in files.decode_pages(found, decoder).where("error is null").collect()) == [(1, "one"), (2, "two"), (3, "three")]
    assert files.decode_pages(found, decoder, max_pages=2).where("page_number is not null").count() == 2
    failed = files.decode_pages(found, decoder).where("error is not null").collect()
    assert len(failed) == 1 and failed[0].page_number is None and "UnicodeDecodeError" in failed[0].error


def test_cases(spark, tmp_path):
    claim = {"entity": "Acme", "attribute": "Revenue", "value": "5", "qualifiers": {"header_uncertain": "true"}}
    lines = [json.dumps({"id": "1", "fact_a": claim, "fact_b": {"entity": "Acme"}, "expected_relation": "NEEDS_REVIEW", "must_not_be": ["CORROBORATES"]}), "", json.dumps({"id": "2", "fact_a": claim, "fact_b": claim})]
    (tmp_path / "cases.jsonl").write_text("\n".join([*lines, "{no json"]))
    read = files.labelled_cases(spark, str(tmp_path / "cases.jsonl"))
    assert [r.malformed for r in read.where("malformed is not null").collect()] == ["{no json"]
    got = {r.id: r for r in read.where("malformed is null").collect()}
    assert set(got) == {"1", "2"} and got["1"].fact_b.confidence == 0.95 and got["1"].fact_b.qualifiers == {} and got["1"].must_not_be == ["CORROBORATES"]


def test_fill_hashes(spark):
    uploads = spark.createDataFrame([("1", "/a", None), ("2", "/b", None), ("3", "/c", "h2"), ("4", None, None)], "id string, file_path string, content_hash string")
    held = spark.createDataFrame([("/a", "h1"), ("/b", "h2"), ("/c", "h9")], "path string, content_hash string")
    assert {r.id: r.content_hash for r in files.fill_hashes(uploads, held).collect()} == {"1": "h1", "2": None, "3": "h2", "4": None}


def test_evolving_table(spark, tmp_path):
    path = str(tmp_path / "t")
    files.ensure_table(spark, path, "id string")
    files.append(spark.createDataFrame([("1",)], "id string"), path)
    files.ensure_table(spark, path, "id string")
    files.append(spark.createDataFrame([("2", "done")], "id string, status string"), path)
    assert {tuple(r) for r in files.read_evolving(spark, path, {"status": "success", "n": 0}).select("id", "status", "n").collect()} == {("1", "success", 0), ("2", "done", 0)}
    files.write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first()[0] == '{"a":1,"b":null}'


def test_embedding(spark):
    rows = spark.createDataFrame([("a", "net sales rose"), ("b", "Net SALES rose"), ("c", "board approved the plan"), ("d", None)], "id string, t string")
    vectors = embedding.embed(rows, "id", "t", embedding.hashing_model(64)).withColumn("seq", F.lit(0))
    got = {(r.query_id, r.cand_id) for r in similarity.top_k(vectors, vectors, threshold=0.9).collect()}
    assert got == {("a", "b"), ("b", "a")}
