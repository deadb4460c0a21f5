"""Small fixed inputs with their results: trees, registries, scripts, model descriptions, feeds."""

from pyspark.sql import functions as F

from corpuskiln.functions import text
from corpuskiln.operators import graph, registry
from corpuskiln.sources import files, papers

TREE = [
    ("p/m.py", "import a\nimport p\n"), ("p/__init__.py", "from .m import z\nfrom . import m\n"), ("a.py", "import a\ndef f(): pass\nclass C: pass\n"),
    ("web/x.js", "import u from './u'\nimport r from 'react'\n"), ("web/u/index.js", ""), ("README.md", ""), ("s/n.md", "[r](../README.md) [again](../README.md) [w](http://x.y/z.md)"), ("s/t.sh", "source ./u.sh\n"),
]


def test_tree_edges(spark):
    got = graph.edges(spark.createDataFrame(TREE, "path string, text string")).select("source", "target", "type").collect()
    expected = {("p/m.py", "a.py", "import"), ("p/m.py", "p/__init__.py", "import"), ("p/__init__.py", "p/m.py", "import"), ("web/x.js", "web/u/index.js", "import"), ("s/n.md", "README.md", "link")}
    assert {tuple(r) for r in got} == expected and len(got) == 5


def test_registry_keeps_and_refreshes(spark):
    first = spark.createDataFrame([("/m/a-Q4_K_M.gguf", 1.23456, "base-a", "llama"), ("/m/phi-q8_0.gguf", 2.0, "p", "")], "path string, size_gb double, base_model string, architecture string")
    known = registry.register_gguf(registry.empty_registry(spark), first)
    again = spark.createDataFrame([("/m/a-Q4_K_M.gguf", 4.56789, ""), ("/m/b-BF16.gguf", 1.23456, "")], "path string, size_gb double, base_model string")
    got = {r.path: (r.base_model, r.quantization, r.architecture, r.size_gb) for r in registry.register_gguf(known, again).collect()}
    assert got == {"/m/a-Q4_K_M.gguf": ("base-a", "Q4_K_M", "llama", 4.56789), "/m/b-BF16.gguf": ("", "BF16", "", 1.235), "/m/phi-q8_0.gguf": ("p", "Q8_0", "phi", 2.0)}


def test_names_and_numbers(spark):
    names = spark.createDataFrame([(n,) for n in ("m-Q4_K_M.gguf", "Llama-q8_0.gguf", "m.gguf", "qwen-BF16.gguf")], "f string")
    got = names.select("f", text.quantization(F.col("f")).alias("q"), text.architecture(F.col("f")).alias("a")).collect()
    assert {tuple(r) for r in got} == {("m-Q4_K_M.gguf", "Q4_K_M", ""), ("Llama-q8_0.gguf", "Q8_0", "llama"), ("m.gguf", "", ""), ("qwen-BF16.gguf", "BF16", "qwen")}
    paths = spark.createDataFrame([(n,) for n in ("x_10.md", "x_33.md", "x_2.md")], "path string")
    assert [r.path for r in paths.orderBy(files.numeric_order(F.col("path"))).collect()] == ["x_2.md", "x_10.md", "x_33.md"]


def test_script_and_description(spark):
    script = "# A\n> note\n[B-ROLL: z]\nhi **you** (0:00 – 1:30)\n---\n```\ncode\n```\nand more\n# B\n## The `Third` Part!\nlast line"
    got = registry.script_sections(spark.createDataFrame([(1, script)], "script_id int, text string")).select("name", "slug", "text").collect()
    assert {tuple(r) for r in got} == {("A", "a", "hi you and more"), ("The `Third` Part!", "the_third_part", "last line")}
    given = 'FROM m\n# note\nPARAMETER stop a\nPARAMETER stop b\nPARAMETER temperature 0.5\nPARAMETER num_ctx 4096\nSYSTEM """x\ny"""\nMESSAGE user hello there\n'
    m = spark.createDataFrame([(given,), ('SYSTEM """open',), (None,)], "t string").select(registry.parse_modelfile(F.col("t")).alias("m"), "t")
    parsed = m.select("m.*", registry.render_modelfile(F.col("m")).alias("again")).collect()
    assert (parsed[0].base, parsed[0].system, parsed[0].parameters["stop"], parsed[0].messages[0].content) == ("m", "x\ny", ["a", "b"], "hello there")
    assert parsed[1].base is None and parsed[1].again is None and parsed[2].again is None
    back = spark.createDataFrame([(parsed[0].again,)], "t string").select(registry.parse_modelfile(F.col("t")).alias("m")).first().m
    assert (back.base, back.system, back.parameters, back.messages) == (parsed[0].base, parsed[0].system, parsed[0].parameters, parsed[0].messages)


def test_feed(spark):
    feed = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2401.00001v1</id><title>A
 title</title><summary>Some
text</summary><published>2024-01-02T00:00:00Z</published><author><name>Ann B</name></author><author><name>C D</name></author>
<link href="http://arxiv.org/abs/2401.00001v1" rel="alternate"/><link title="pdf" href="http://arxiv.org/pdf/2401.00001v1"/><category term="cs.LG"/><category term="cs.CL"/></entry>
<entry><id>x</id><title></title></entry></feed>"""
    (row,) = papers.parse_feed(spark.createDataFrame([(feed,)], "xml string")).collect()
    assert (row.title, row.authors, row.abstract, row.categories) == ("A  title", ["Ann B", "C D"], "Some text", ["cs.LG", "cs.CL"])
    assert (row.arxiv_url, row.pdf_link, row.published, row.arxiv_id) == ("http://arxiv.org/abs/2401.00001v1", "http://arxiv.org/pdf/2401.00001v1", "2024-01-02", "2401.00001v1")
