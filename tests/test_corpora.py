import os
from pathlib import Path

import duckdb
import pytest

from textloom.plans import text_queries
from textloom.sources import texts
from textloom.util import shared_dir

LINES = [("d/a.jsonl", 2, "last"), ("d/a.jsonl", 0, "a b"), ("d/a.jsonl", 0, "a"), ("d/a.jsonl", 0, "a"), ("d/a.jsonl", 1, 'q" q'), ("d/a.jsonl", 1, "qa"), ("d/a.jsonl", None, "no number"), ("d/b.jsonl", 5, None), *[(f"e/{k % 7}/{k}.jsonl", n, f"é\n{k} {n}") for k in range(20) for n in range(3)]]


@pytest.fixture()
def table(spark, tmp_path):
    def write(lines):
        spark.createDataFrame(lines, "path string, line_no int, text string").write.parquet(str(tmp_path / "encode_lines.parquet"))
        return str(tmp_path)

    return write


def same_as_sql(spark, name, d, order):
    con = duckdb.connect()
    con.execute(f"create view encode_lines as select * from '{d}/encode_lines.parquet/*.parquet'")
    wanted = con.sql(f"select {order} from ({text_queries.SQL[name]}) order by all").fetchall()
    assert sorted(tuple(r) for r in text_queries.QUERIES[name](spark, d).select(*order.split(", ")).collect()) == sorted(wanted)
    return wanted


def held(spark):
    return {f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if f.startswith("corpus-")}


def many(folder: Path) -> str:
    for k in range(120):
        at = folder / f"m{k % 40}" / f"{k}.jsonl"
        at.parent.mkdir(exist_ok=True)
        at.write_text(f'{{"text": "{k}"}}\n{{"text": "x"}}\n')
    return str(folder)


def test_driver_holds_no_file_of_objects(spark, tmp_path):
    found = texts.object_texts(spark, many(tmp_path))
    assert not [f for f in found.inputFiles() if f.endswith(".jsonl")]
    assert sorted(r.text for r in found.collect()) == sorted(f"{k} x" for k in range(120))


def test_objects_of_several_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(texts, "PIECE", 50)
    lines = [f'{{"text": "{"y" * (k % 60)}{k}"}}' for k in range(90)]
    (tmp_path / "a.jsonl").write_bytes(b"\xef\xbb\xbf" + "\r\n".join(lines).encode())
    (tmp_path / "b.jsonl").write_text("{}\n")
    (tmp_path / ".c.jsonl").write_text(lines[0])
    (tmp_path / "odd %20+name.jsonl").write_text(lines[1])
    got = {r.path.rsplit("/", 1)[1]: r.text for r in texts.object_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.jsonl": " ".join("y" * (k % 60) + str(k) for k in range(90)), "odd %20+name.jsonl": "y1"}
    rows = texts.numbered_lines(spark, f"{tmp_path}/a.jsonl").collect()
    assert {r.line_no: r.line for r in rows} == dict(enumerate(lines)) and len(rows) == 90


@pytest.mark.parametrize("part_files", [3, 100_000])
def test_json_join_by_parts(spark, table, monkeypatch, part_files):
    monkeypatch.setattr(text_queries, "PART_FILES", part_files, raising=False)
    before = held(spark)
    wanted = dict(same_as_sql(spark, "json_join", table(LINES), "path, joined"))
    assert wanted["d/a.jsonl"] == 'a a b q" q qa last no number' and len(wanted) == 21
    assert held(spark) == before


def test_json_join_without_lines(spark, table):
    assert same_as_sql(spark, "json_join", table([("a", 1, None)]), "path, joined") == []


def test_driver_holds_no_file_of_texts(spark, tmp_path):
    where = many(tmp_path)
    (tmp_path / "m1" / "n.md").write_text("# n")
    (tmp_path / "odd %20+name.txt").write_text("odd")
    for found in (texts.list_texts(spark, where), texts.read_texts(spark, where, sort_spec="size_descending")):
        assert not [f for f in found.inputFiles() if f.endswith(texts.SUFFIXES)]
    assert texts.list_texts(spark, where).count() == 122
    got = {r.path: r.text for r in texts.read_texts(spark, where, sort_spec="size_descending").collect()}
    assert len(got) == 242 and got["m1/n.md"] == "# n" and got["odd %20+name.txt"] == "odd" and got["m39/79.jsonl[0]"] == "79"


@pytest.mark.parametrize("part_files", [3, 100_000])
def test_read_corpus_by_parts(spark, table, monkeypatch, part_files):
    monkeypatch.setattr(text_queries, "PART_FILES", part_files, raising=False)
    before, d = held(spark), table(LINES)
    assert len(same_as_sql(spark, "list_corpus", d, "path, size")) == 21
    wanted = same_as_sql(spark, "read_corpus", d, "path, line_no, text")
    assert wanted[:2] == [("d/a.jsonl[0]", 0, "a"), ("d/a.jsonl[1]", 1, "a b")] and len(wanted) == 66
    assert held(spark) == before


@pytest.mark.parametrize("name, columns", [("read_corpus", "path, line_no, text"), ("list_corpus", "path, size")])
def test_corpus_without_lines(spark, table, name, columns):
    assert same_as_sql(spark, name, table([("a", 1, None)]), columns) == []
