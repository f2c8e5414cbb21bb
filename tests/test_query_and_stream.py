"""jq programs over JSON columns, and the ingest of arriving files."""

import json

import pytest

from paperloom import query
from paperloom.sources.markdown import to_docx
from paperloom.streaming import document_stream, ingest, latest

DOC = {"a": {"b": [1, 2.5, "x", None, True]}, "blocks": [{"kind": "heading", "n": 1, "t": "T"}, {"kind": "paragraph", "n": 2, "t": "body"}, {"kind": "paragraph", "n": 3}], "s": "text"}
PROGRAMS = [
    (".", [DOC]), (".s", ["text"]), (".a.b[0]", [1]), (".a.b[-1]", [True]), (".a.b | length", [5]), (".s | length", [4]), ("keys", [["a", "blocks", "s"]]),
    (".a.b[]", [1, 2.5, "x", None, True]), (".a.b[1:3]", [[2.5, "x"]]), (".blocks[].kind", ["heading", "paragraph", "paragraph"]),
    ('.blocks[] | select(.kind == "paragraph") | .n', [2, 3]), (".blocks | map(.n)", [[1, 2, 3]]), ("[.blocks[] | select(.n >= 2) | .n]", [[2, 3]]),
    (".blocks[0] | {kind, size: .n}", [{"kind": "heading", "size": 1}]), (".s, .a.b[0]", ["text", 1]), ('.blocks | map(has("t"))', [[True, True, False]]),
    (".missing", [None]), (".a.b | map(type)", [["number", "number", "string", "null", "boolean"]]), (".blocks[] | select(.t) | .t", ["T", "body"]),
    ('.blocks | map(select(.kind == "heading" or .n == 3) | .n)', [[1, 3]]), ("null | not", [True]), (".blocks | length > 2", [True]),
]


@pytest.mark.parametrize(("program", "want"), PROGRAMS)
def test_programs(spark, program, want):
    df = spark.createDataFrame([(1, json.dumps(DOC)), (2, "not json"), (3, None)], "id long, j string")
    rows = sorted((r["id"], r["ord"], r["value"]) for r in query.jq(df, program, "id", "j").collect())
    assert [json.loads(v) for i, _, v in rows if i == 1] == want and {i for i, *_ in rows} == {1}


@pytest.mark.parametrize("program", ["", ".a |", "def f: 1; f", ".[", "reduce .[] as $x (0; .)", "{"])
def test_what_is_refused(program):
    with pytest.raises(SyntaxError):
        query.Parser(program).program()


def test_files_arrive(spark, tmp_path):
    box, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    box.mkdir()

    def run():
        q = ingest(document_stream(spark, str(box), files_per_batch=1), str(out), str(state), available_now=True)
        q.awaitTermination(120)
        return {r["path"].rpartition("/")[2]: r["text"] for r in latest(spark, str(out)).collect()}

    (box / "a.docx").write_bytes(to_docx("one"))
    (box / "b.docx").write_bytes(b"PK\x03\x04 broken")
    assert run() == {"a.docx": "one\n", "b.docx": None}
    (box / "c.docx").write_bytes(to_docx("two"))
    assert run() == {"a.docx": "one\n", "b.docx": None, "c.docx": "two\n"}
