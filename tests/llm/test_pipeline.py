"""The pipeline on planted documents, and the guard around removable modules."""

import random

import public_tokenizers

import __spark_entry__ as entry
import corpus_pipeline
from paperloom.llm import unigram

RNG = random.Random(31)
COMMON = "the of and to in is that was for with as on by are".split()


def prose(n):
    return " ".join(RNG.choice(COMMON) if RNG.random() < 0.45 else "".join(RNG.choice("abcdefghilmnoprstu") for _ in range(RNG.randint(3, 9))) for _ in range(n)) + "."


def test_planted_documents(spark, tmp_path):
    items = [(i, prose(30)) for i in range(4)]
    base = prose(150)
    words = base.split()
    edited = " ".join(["new", *words[1:80], "changed", *words[81:]])
    docs = {i: prose(120) for i in range(40)}
    docs |= {
        100: base, 101: base, 102: edited.upper().lower(),  # one of these stays
        110: prose(60) + " " + items[2][1] + " " + prose(60),  # leaks an item
        120: prose(80) + " mail me: someone@example.org or +1 (555) 123-4567 " + prose(30),
        130: "short text", 131: None, 132: " | ".join(f"{RNG.choice('abcdef') * 7}" for _ in range(300)), 133: "one two three " * 80,
    }
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(40), 100, 120}
    model = unigram.Unigram(public_tokenizers.path("piece_bpe_32k.model"))
    for i, r in out.items():
        text = model.decode(list(r["token_ids"]))
        want = docs[i].replace("someone@example.org", "[EMAIL]").replace("+1 (555) 123-4567", "[PHONE]")
        assert text == want and r["n_tokens"] == len(r["token_ids"]) and r["source"] == f"src{i % 3}"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "pii", "sentencepiece"]
    for name, stage in (corpus_pipeline.STAGES[2], corpus_pipeline.STAGES[3]):
        assert stage(spark, docs, "/root/testdata/sf0.001").schema == docs.schema, name


def test_entry_names():
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {f"{k.split('_')[0]}_" for k in names} and "pipeline" in names
    assert entry._optional("paperloom.nothing") is None
