"""Documents as files and back: the same results with less work a row, and no core that waits for another."""

import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom import tables
from paperloom.outputs.walk import Resolver
from paperloom.plans import documents, queries
from paperloom.sinks import docx as sink
from paperloom.sources import docx as source
from paperloom.sources import xmltree
from paperloom.sources.markdown import read_markdown

MARKDOWN = "# Head\n\nOn **3** *days*, `code`.\n\n1. one\n2. two\n\n| a | b |\n| --- | --- |\n| 1 | x\\|y |\n"
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def flat(root):
    out, stack = [], [(root, 0)]
    while stack:
        node, depth = stack.pop()
        out.append((depth, node.tag, list(node.attributes.items()), node.text))
        stack.extend((c, depth + 1) for c in reversed(node.children))
    return out


def element(rng, depth=0):
    attributes = rng.sample(['w:val="1"', "b='2'", 'xml:space="preserve"', 'q:k="a&amp;b"', 'u:i="x\ty\r\nz"', 'xmlnsfoo="1"', 'e=""', 'w:a="&#10;&lt;"'], rng.randint(0, 3))
    attributes += rng.sample(['xmlns:q="urn:q"', 'xmlns="urn:d"', f'xmlns="{W}"', 'xmlns:q="urn:u"', 'xmlns=""'], rng.randint(0, 9) // 9)
    name = rng.choice(["w:p", "w:r", "a", "q:x", "u:y"])
    inside = "".join(element(rng, depth + 1) if depth < 4 and rng.random() < 0.5 else rng.choice(["a", " ", "&amp;&#13;&#x41;", "\r\nb\r", "é ", "<?pi x?>", "&bad;", "<!-- c -->", "<"]) for _ in range(rng.randint(0, 4)))
    return f"<{name} {' '.join(attributes)}>{inside}</{name}>"


def test_well_formed_text_has_the_lenient_tree():
    rng, fast = random.Random(5), 0
    for _ in range(1500):
        text = f'<root xmlns:w="{W}" xmlns:u="urn:u">{element(rng)}{element(rng)}</root>'
        root = xmltree._well_formed(text)
        fast += root is not None
        assert root is None or flat(root) == flat(xmltree._lenient(text))
    assert fast > 200
    for depth in (4093, 4094, 4095, 5000):
        text = "<a>" * depth + "x<b/>" + "</a>" * depth
        assert flat(xmltree.parse(text)) == flat(xmltree._lenient(text))


def test_parts_and_formats_are_worked_out_once(monkeypatch):
    files = [sink.write_docx(read_markdown(MARKDOWN + f"\nrow {i}\n")) for i in range(8)]
    parsed, resolved = [], []
    monkeypatch.setattr(source, "_kept", source.functools.lru_cache(maxsize=64)(lambda data: parsed.append(data) or xmltree.parse(data)))
    own = Resolver.resolved
    monkeypatch.setattr(Resolver, "resolved", lambda self, *a: resolved.append(a) or own(self, *a))
    rows = [documents.parse_one(f, documents.OUTPUTS) for f in files]
    assert len({r["text"] for r in rows}) == 8 and not any(r["error"] for r in rows)
    assert len(parsed) == len(set(parsed)) == 4  # relations twice, styles and numbering; not once a file
    assert len(resolved) == 8 * 5  # a format of each kind in each document, not one a run and output


def test_packages_are_those_of_the_library():
    parts = {"word/document.xml": b"<a/>" * 9000, "b.xml": b"", "c": b"abc" * 7000, "d": bytes(range(256))}
    assert sink._zipped(parts) == sink._zipped(parts) == sink._zipped_by_library(parts)


@pytest.mark.parametrize("rows", [3, 4000])
def test_costly_rows_are_dealt_over_all_cores(spark, rows):
    df = tables.dealt(spark.range(rows).select((F.col("id") % 700).alias("k"), "id"), "k").groupBy("k").agg(F.count("*").alias("n"))
    parts = df.withColumn("part", F.spark_partition_id()).collect()
    assert sum(r["n"] for r in parts) == rows and len(parts) == min(rows, 700)
    if rows > 700:
        assert len({r["part"] for r in parts}) >= 4 * spark.sparkContext.defaultParallelism - 1  # few bytes, yet not merged


@pytest.mark.parametrize("name", ["markdown_to_html", "docx_blocks", "docx_roundtrip"])
def test_documents_are_dealt_over_all_cores(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = re.search(r"hashpartitioning\(doc_id[^,]*, text[^,]*, ([0-9]+)\), REPARTITION_BY_NUM", plan)
    assert dealt and int(dealt[1]) == 4 * spark.sparkContext.defaultParallelism
