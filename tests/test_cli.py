import os

import pytest

from textloom import cli
from textloom.operators import tokenizer
from textloom.operators.tokenizer import TOKENIZERS
from textloom.sources.token_files import TokenFiles

pytestmark = pytest.mark.skipif(not os.path.isfile(f"{TOKENIZERS}/byte_bpe_50k.json"), reason="no public tokenizer files")
TEXT = "Kites drift over the windy hill — naïve ⁂ façade."


def test_tokenize_decode_retokenize(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "hill.txt").write_text(TEXT)
    out = str(tmp_path / "out")
    a = cli.parser().parse_args(["tokenize", "--input", str(tmp_path / "in"), "--output", out, "--context", "8", "--sanitize", "--repair-encoding", "--reorder", "size_ascending", "--shards", "1"])
    assert cli.tokenize(spark, a) > 16
    tokens = [t for r in spark.read.format("token_files").option("context_size", 8).load(out).collect() for t in r.tokens]
    encoder = tokenizer.gpt2().encoder()
    n = len(encoder(TEXT)) + 1
    assert tokens == [*encoder(TEXT), 50256] + [50257] * (-n % 8)
    assert spark.read.json(f"{out}.docs").select("path", "offset", "tokens").collect()[0][0:3] == ("hill.txt", 0, n)
    where = spark.read.json(f"{out}.contexts").orderBy("context_no").collect()
    raw = b"".join((tmp_path / "out" / r.file).read_bytes()[r.offset : r.offset + 2 * r.tokens] for r in where)
    assert raw == b"".join(t.to_bytes(2, "little") for t in tokens) and len(where) > 1
    # The output is newer than its inputs.
    assert cli.tokenize(spark, a) == 0
    assert cli.main(["decode", "--input", out, "--output", str(tmp_path / "text"), "--context", "8"]) == 0
    # Characters cut apart by a context's end stay whole, and no line ends are put in.
    assert "".join(p.read_text() for p in (tmp_path / "text").glob("*.txt")).startswith(f"{TEXT}<|endoftext|>")
    assert cli.main(["retokenize", "--input", out, "--output", str(tmp_path / "wide"), "--to", "gpt2", "--to-uint32", "--context", "8"]) == 0
    wide = [t for r in spark.read.format("token_files").option("wide", "true").option("context_size", 8).load(str(tmp_path / "wide")).collect() for t in r.tokens]
    assert wide[:4] == tokens[:4]


def test_repl(monkeypatch, capsys):
    import io

    monkeypatch.setattr("sys.stdin", io.StringIO("Kites\\ndrift.\n"))
    cli.main(["repl"])
    assert str(tokenizer.gpt2().encoder()("Kites\ndrift.")) in capsys.readouterr().out
