"""Queries over files, scripts, feeds, registries and claims that are made of the given tables' rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import formats, text
from ..operators import graph, quality, registry
from ..schemas import LORA
from ..sources import files, papers, store
from ..streaming import stateful
from .catalog import query, read



def said(pattern: str, *columns: Column | str) -> Column:
    """pattern with the columns in place of %s."""
    return F.format_string(pattern, *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns])


def one_of(index: Column, *values: str | Column) -> Column:
    return F.get(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), index.cast("int"))


# ---- claims


@query("""
SELECT doc_id AS id, [1, 1, 2, 1, 1, 1, 1, 0, 0][a] AS found, [1, 0, 1, 0, 0, 0, 1, 0, 0][a]::BIGINT AS verified, [0, 1, 1, 0, 0, 0, 0, 0, 0][a]::BIGINT AS failed,
  [0, 0, 0, 1, 1, 1, 0, 0, 0][a]::BIGINT AS skipped, [1, 0, 0.5, 1, 1, 1, 1, 1, 1][a]::DOUBLE AS score,
  ['passed', 'failed', 'failed', 'passed', 'passed', 'passed', 'passed', 'no_math', 'no_math'][a] AS status FROM (SELECT doc_id, 1 + doc_id % 9 AS a FROM documents)""")
def claims_validation(spark, folder):
    """Plain arithmetic about a document's numbers: right, wrong, both, a division by zero, what only symbols tell, and none."""
    n, m = F.col("doc_id"), F.col("n_chars") + 1
    texts = [
        said("%s + %s = %s", n, m, n + m), said("so %s + %s = %s", n, m, n + m + 1), said("%s + %s = %s and 3 * %s = %s", n, m, n + m, m, 3 * m + 1), said("%s / 0 = 5", n),
        said("%s^2 = %s", m, m * m), said("$x = %s$", n), said("$$%s = %s$$", m, m), "no maths here", "",
    ]
    rows = read(spark, folder, "documents").select(F.col("doc_id").alias("id"), one_of(F.col("doc_id") % 9, *texts).alias("text"))
    return quality.validate(rows, "text", "id").drop("accepted")


@query("""
SELECT conv_id, count(*)::INT AS found, count(*) FILTER (WHERE turn % 3 <> 0) AS verified, count(*) FILTER (WHERE turn % 3 = 0) AS failed,
  CASE WHEN count(*) FILTER (WHERE turn % 3 = 0) = 0 THEN 'passed' ELSE 'failed' END AS status FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def conversation_claims(spark, folder):
    """The claims of a talk's assistant turns, of which those of every third turn are wrong; thinking and content are read alike."""
    claim = said("so %s + 1 = %s indeed", F.col("turn"), F.when(F.col("turn") % 3 == 0, F.col("turn") + 2).otherwise(F.col("turn") + 1))
    thinks = F.col("turn") % 2 == 0
    message = F.struct("turn", "role", F.when(thinks, "so").otherwise(claim).alias("content"), F.when(thinks, claim).alias("thinking"))
    talks = read(spark, folder, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("messages"))
    found = quality.validate(talks.select("conv_id", quality.conversation_text(F.col("messages")).alias("text")), "text", "conv_id")
    return found.where("found > 0").select("conv_id", "found", "verified", "failed", "status")


# ---- trees of files


def tree(spark, folder) -> DataFrame:
    """(path, text): a document as a file of its source's folder, of one of six kinds, that refers to the file 60 ids on; Python refers to 120 on, too."""
    n, far, further = F.col("doc_id"), F.col("doc_id") + 60, F.col("doc_id") + 120
    kind = one_of(n % 6, ".py", ".js", ".md", ".sh", ".ps1", ".css")
    content = one_of(
        n % 6, said("import %s.d%s\nfrom .d%s import z\nfrom . import q\ndef f%s(): pass\nclass C%s:\n    def m(self): pass\n", "source", far, further, n, n), said("import u from './d%s'\nimport r from 'react'\n", far),
        said("[r](d%s.md) [again](./d%s.md) [w](http://x.y/d%s.md) [own](d%s.md)", far, far, far, n), said("source ./d%s.sh\n", far), said(". ./d%s.ps1\n", far), said("@import 'd%s.css';\n", far),
    )
    return read(spark, folder, "documents").select(F.concat("source", F.lit("/d"), n.cast("string"), kind).alias("path"), content.alias("text"))


TREE = """t AS (SELECT doc_id, source, source || '/d' || doc_id || ['.py', '.js', '.md', '.sh', '.ps1', '.css'][1 + doc_id % 6] AS path FROM documents),
e AS (SELECT a.path AS source, b.path AS target, ['import', 'import', 'link', 'source', 'source', 'import'][1 + a.doc_id % 6] AS type
      FROM t a JOIN t b ON a.source = b.source AND (b.doc_id = a.doc_id + 60 OR a.doc_id % 6 = 0 AND b.doc_id = a.doc_id + 120))"""


@query(f"WITH {TREE} SELECT source, target, type FROM e")
def tree_edges(spark, folder):
    return graph.edges(tree(spark, folder)).select("source", "target", "type")


@query(f"""
WITH {TREE}, l AS (SELECT ['python', 'js', 'markdown', 'shell', 'powershell', 'css'][1 + doc_id % 6] AS lang, count(*) AS n FROM t GROUP BY ALL)
SELECT (SELECT count(*) FROM t) AS files, (SELECT count(*) FROM e) AS edges, (SELECT string_agg(lang || ':' || n, ',' ORDER BY lang) FROM l) AS languages""")
def tree_totals(spark, folder):
    made = tree(spark, folder)
    totals = graph.graph_stats(graph.nodes(made), graph.edges(made))
    return totals.select("files", "edges", F.array_join(F.transform("languages", lambda x: F.concat_ws(":", x["lang"], x["count"].cast("string"))), ",").alias("languages"))


@query("""SELECT source || '/d' || doc_id || '.py' AS id, 'f' || doc_id || ',C' || doc_id || ',m' AS symbols, 6 + 1 AS lines, 'd' || doc_id || '.py' AS label FROM documents WHERE doc_id % 6 = 0""")
def python_symbols(spark, folder):
    found = graph.nodes(tree(spark, folder).where("endswith(path, '.py')"))
    return found.select("id", F.array_join("functions", ",").alias("symbols"), F.col("lines").cast("int").alias("lines"), "label")


@query("""
SELECT doc_id, ['code', 'latex', 'markdown', 'plain'][1 + doc_id % 4] AS kind, ['python', 'other', 'markdown', 'config'][1 + doc_id % 4] AS lang, doc_id % 4 IN (0, 2, 3) AS watched,
  coalesce(nullif(left(text, 20), ''), source) AS shown FROM documents""")
def file_kinds(spark, folder):
    """A document as a file of four endings: its kind, language, whether changes of it are watched, and the text to embed."""
    rows = read(spark, folder, "documents").select("doc_id", "text", "source", F.concat("source", F.lit("/d"), one_of(F.col("doc_id") % 4, ".py", ".tex", ".md", ".CONF")).alias("file"))
    seen = stateful.watched(rows).select("doc_id", F.lit(True).alias("watched"))
    kinds = rows.select("doc_id", text.doc_type(F.col("file")).alias("kind"), text.language_of(F.col("file")).alias("lang"), text.text_or(F.col("text"), F.col("source"), 20).alias("shown"))
    return kinds.join(seen, "doc_id", "left").withColumn("watched", F.coalesce("watched", F.lit(False)))


@query("""SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS place FROM documents""")
def numeric_order(spark, folder):
    """Files named source_N.md of each source in the order of their numbers."""
    from pyspark.sql import Window

    named = read(spark, folder, "documents").select("source", "doc_id", F.concat_ws("_", "source", F.col("doc_id").cast("string")).alias("n")).withColumn("path", F.concat("n", F.lit(".md")))
    return named.select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy(files.numeric_order(F.col("path")), "path")).alias("place"))


# ---- scripts, model descriptions, feeds


@query("""
SELECT doc_id AS script_id, 'Part ' || doc_id || '!' AS name, 'part_' || doc_id AS slug, 'said ' || lang || ' and ' || n_chars || ' more' AS text FROM documents
UNION ALL SELECT doc_id, 'The `' || source || '` End', 'the_' || source || '_end', 'last line' FROM documents""")
def script_sections(spark, folder):
    script = said("# Part %s!\n> note\n[B-ROLL: z]\n---\nsaid **%s** (0:00 – 1:30)\n```\ncode\n```\nand %s more\n## Empty\n[B-ROLL: y]\n### The `%s` End\nlast line", "doc_id", "lang", "n_chars", "source")
    return registry.script_sections(read(spark, folder, "documents").select(F.col("doc_id").alias("script_id"), script.alias("text"))).select("script_id", "name", "slug", "text")


@query("""
SELECT doc_id, source AS base, 'x' || chr(10) || doc_id AS system, 'a,' || lang AS stop, (doc_id % 10 + 0.5)::DOUBLE AS temperature, n_chars AS num_ctx, 'hello ' || lang AS said,
  'FROM ' || source || chr(10) || 'SYSTEM \"\"\"' || chr(10) || 'x' || chr(10) || doc_id || chr(10) || '\"\"\"' || chr(10) || 'PARAMETER stop a' || chr(10) || 'PARAMETER stop ' || lang || chr(10)
  || 'PARAMETER temperature ' || (doc_id % 10) || '.5' || chr(10) || 'PARAMETER num_ctx ' || n_chars || chr(10) || 'MESSAGE user hello ' || lang || chr(10) AS rendered FROM documents""")
def modelfile_parse(spark, folder):
    """A model description for each document, read, typed and written again."""
    given = said('FROM %s\n# note\nPARAMETER stop a\nparameter stop %s\nPARAMETER temperature %s.5\nPARAMETER num_ctx %s\nSYSTEM """x\n%s"""\nMESSAGE user hello %s\n', "source", "lang", F.col("doc_id") % 10, "n_chars", "doc_id", "lang")
    m = read(spark, folder, "documents").select("doc_id", registry.parse_modelfile(given).alias("m")).select("doc_id", "m", registry.typed_parameters(F.col("m.parameters")).alias("p"))
    value = lambda key, field: F.get(F.filter("p", lambda e: e["key"] == key), F.lit(0))[field]
    return m.select(
        "doc_id", "m.base", "m.system", F.array_join(F.col("m.parameters")["stop"], ",").alias("stop"), value("temperature", "double_value").alias("temperature"), value("num_ctx", "long_value").alias("num_ctx"),
        F.get("m.messages", F.lit(0))["content"].alias("said"), registry.render_modelfile(F.col("m")).alias("rendered"),
    )


@query("""
SELECT doc_id, 'Paper ' || doc_id || '  on ' || lang AS title, 'Ann ' || source || ', C D' AS authors, 'Some text' AS abstract, 'cs.LG cs.' || lang AS categories, 'http://x.org/abs/2401.' || doc_id || 'v1' AS arxiv_url,
  'http://x.org/pdf/2401.' || doc_id || 'v1' AS pdf_link, '2401.' || doc_id || 'v1' AS arxiv_id,
  'Title: Paper ' || doc_id || '  on ' || lang || chr(10) || 'Authors: Ann ' || source || ', C D' || chr(10) || 'Published: 2024-01-02' || chr(10) || chr(10) || 'Some text' || chr(10) || chr(10) || 'page ' || n_chars AS text FROM documents""")
def atom_papers(spark, folder):
    """A feed of two entries for each document, of which the second has no title, and the text of each paper."""
    feed = said(
        """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://x.org/abs/2401.%sv1</id><title>Paper %s
 on %s</title><summary>Some
text</summary><published>2024-01-02T00:00:00Z</published><author><name>Ann %s</name></author><author><name>C D</name></author>
<link href="http://x.org/abs/2401.%sv1" rel="alternate"/><link title="pdf" href="http://x.org/pdf/2401.%sv1"/><category term="cs.LG"/><category term="cs.%s"/></entry>
<entry><id>y</id><title></title></entry></feed>""",
        "doc_id", "doc_id", "lang", "source", "doc_id", "doc_id", "lang",
    )
    rows = papers.parse_feed(read(spark, folder, "documents").select("doc_id", "n_chars", feed.alias("xml")))
    page = papers.paper_text(F.col("title"), F.col("authors"), F.col("published"), F.col("abstract"), said("page %s", "n_chars"))
    return rows.select("doc_id", "title", F.array_join("authors", ", ").alias("authors"), "abstract", F.array_join("categories", " ").alias("categories"), "arxiv_url", "pdf_link", "arxiv_id", page.alias("text"))


# ---- registries


def model_name() -> Column:
    """source-architecture-quantization.gguf, in the cases that occur."""
    return F.concat("source", F.lit("-"), one_of(F.col("doc_id") % 4, "Llama", "mistral-7B", "x", "QWEN2"), F.lit("-"), one_of(F.col("doc_id") % 6, "Q4_K_M", "q8_0", "BF16", "f16", "q4_k_s", "none"), F.lit(".gguf"))


QUANT = "['Q4_K_M', 'Q8_0', 'BF16', 'F16', 'Q4_K_S', ''][1 + doc_id % 6]"
ARCH = "['llama', 'mistral', '', 'qwen'][1 + doc_id % 4]"
MODEL = "source || '-' || ['Llama', 'mistral-7B', 'x', 'QWEN2'][1 + doc_id % 4] || '-' || ['Q4_K_M', 'q8_0', 'BF16', 'f16', 'q4_k_s', 'none'][1 + doc_id % 6] || '.gguf'"


@query(f"""SELECT doc_id, {QUANT} AS quant, {ARCH} AS arch FROM documents""")
def guess_quant(spark, folder):
    return read(spark, folder, "documents").select("doc_id", text.quantization(model_name()).alias("quant"), text.architecture(model_name()).alias("arch"))


REGISTERED = """
one AS (SELECT source, lang, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL), two AS (SELECT source, lang, count(*) AS n FROM documents WHERE doc_id % 3 = 0 GROUP BY ALL),
r AS (SELECT '/m/' || source || '-' || lang || '-q8_0.gguf' AS path, CASE WHEN one.n IS NULL THEN '' ELSE 'base-' || lang END AS base_model, 'Q8_0' AS quantization,
  CASE WHEN one.n IS NULL THEN '' ELSE 'llama' END AS architecture, CASE WHEN one.n IS NULL THEN round(two.n / 7.0::DOUBLE, 3) WHEN two.n IS NULL THEN round(one.n / 7.0::DOUBLE, 3) ELSE two.n / 7.0::DOUBLE END AS size_gb
  FROM one FULL JOIN two USING (source, lang))"""


def registered(spark, folder) -> DataFrame:
    """Models by source and language: those of even ids first, then those of every third id, without base model and architecture."""
    docs = read(spark, folder, "documents")
    found = lambda rows: rows.groupBy("source", "lang").agg((F.count("*") / 7.0).alias("size_gb")).withColumn("path", said("/m/%s-%s-q8_0.gguf", "source", "lang"))
    first = found(docs.where("doc_id % 2 = 0")).select("path", "size_gb", F.concat(F.lit("base-"), "lang").alias("base_model"), F.lit("llama").alias("architecture"))
    again = found(docs.where("doc_id % 3 = 0")).select("path", "size_gb", F.lit("").alias("base_model"))
    return registry.register_gguf(registry.register_gguf(registry.empty_registry(spark), first), again)


@query(f"WITH {REGISTERED} SELECT path, base_model, quantization, architecture, size_gb FROM r")
def registry_upsert(spark, folder):
    return registered(spark, folder).select("path", "base_model", "quantization", "architecture", "size_gb")


@query(f"WITH {REGISTERED} SELECT split_part(path, '/', 3) AS filename, size_gb, quantization, architecture, CASE WHEN path = '/m/src1-en-q8_0.gguf' THEN 'served' ELSE '' END AS ollama_name FROM r")
def registry_listing(spark, folder):
    return registry.listing(registry.mark_deployed(registered(spark, folder), "/m/src1-en-q8_0.gguf", "served"))


@query(f"WITH {REGISTERED} SELECT path, quantization FROM r WHERE path = '/m/src1-en-q8_0.gguf'")
def registry_find(spark, folder):
    return registry.find(registered(spark, folder), "src1-en-q8_0.gguf").select("path", "quantization")


@query("""
SELECT '/l/' || source || CASE WHEN lang = 'en' THEN '.gguf' ELSE '.safetensors' END AS path, CASE WHEN lang = 'en' THEN 'gguf' ELSE 'safetensors' END AS format, 'sum of ' || string_agg(DISTINCT lang, '') AS task,
  round(min(doc_id) / 7.0::DOUBLE, 3) AS size_gb FROM documents WHERE lang IN ('en', 'fr') GROUP BY source, lang""")
def lora_registry(spark, folder):
    """Adapters registered twice, the second time with another size, which a known path does not take, and found by their task."""
    docs = read(spark, folder, "documents").groupBy("source", "lang").agg((F.min("doc_id") / 7.0).alias("size_gb"))
    found = docs.select(F.concat(F.lit("/l/"), "source", F.when(F.col("lang") == "en", ".gguf").when(F.col("lang") == "fr", ".safetensors").otherwise(F.concat(F.lit("."), "lang"))).alias("path"), F.concat(F.lit("sum of "), "lang").alias("task"), "size_gb")
    known = registry.register_lora(registry.empty_registry(spark, LORA), found)
    again = registry.register_lora(known, found.select("path", (F.col("size_gb") + 1).alias("size_gb")))
    return registry.for_task(again, "OF (en|fr)").select("path", "format", "task", "size_gb")


@query(f"""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'README.md' ELSE {MODEL} END AS name, doc_id % 5 <> 0 AS is_model, CASE WHEN doc_id % 5 = 0 THEN '' ELSE {QUANT} END AS label, source || '-7B' AS base FROM documents""")
def repo_files(spark, folder):
    """Files of model repositories, one document each: marked, labelled, and the base model that the repository's name tells."""
    rows = read(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "README.md").otherwise(model_name()).alias("name"), said("owner/%s-7B-GGUF", "source").alias("repo"))
    listed = registry.repo_listing(rows.select("name").distinct())
    return rows.join(listed, "name").select("doc_id", "name", "is_model", "label", text.base_model(F.col("repo")).alias("base"))


@query("""SELECT 'm' || doc_id AS name, round(n_chars * 1e6 / 1e9, 1) AS gigabytes, '2024-0' || (1 + doc_id % 9) || '-05' AS day FROM documents WHERE n_chars % 100 <> 50""")
def model_inventory(spark, folder):
    served = read(spark, folder, "documents").where("n_chars % 100 <> 50").select(said("m%s", "doc_id").alias("name"), (F.col("n_chars") * 1e6).alias("size"), said("2024-0%s-05T10:00:00Z", 1 + F.col("doc_id") % 9).alias("modified"))
    return registry.inventory(served)


# ---- talks, answers, prompts


@query("""SELECT conv_id, turn, conv_id % 2 = 0 AS openai FROM conversations""")
def format_detect(spark, folder):
    """Each turn as a list of one, in one of the two formats by conversation."""
    one = F.when(F.col("conv_id") % 2 == 0, F.to_json(F.array(F.struct("role", F.col("text").alias("content"))))).otherwise(F.to_json(F.array(F.struct(F.col("role").alias("from"), F.col("text").alias("value")))))
    return read(spark, folder, "conversations").select("conv_id", "turn", formats.is_openai(one).alias("openai"))


@query("""
SELECT conv_id, turn, [true, false, NULL, true][1 + a] AS yes, [true, false, CASE WHEN turn >= 2 THEN true END, true][1 + a] AS yes_at_last, a = 3 AS stops, ['cs.CL', 'cs.LG', 'quant-ph', 'cs.LG'][1 + a] AS category
FROM (SELECT conv_id, turn, (conv_id + turn) % 4 AS a FROM conversations)""")
def spoken_answers(spark, folder):
    """What four kinds of answer mean: yes or no, after how many tries, the end, and the category of a search."""
    answer = one_of((F.col("conv_id") + F.col("turn")) % 4, "Yes, please! On NLP.", "NO... nothing", "hmm, a Quantum thing?", "Sure. Good-bye!")
    rows = read(spark, folder, "conversations").select("conv_id", "turn", answer.alias("said"))
    c = F.col("said")
    return rows.select("conv_id", "turn", text.confirmation(c).alias("yes"), text.confirmation(c, F.col("turn")).alias("yes_at_last"), text.says_phrase(c).alias("stops"), text.paper_category(c).alias("category"))


@query("""
SELECT doc_id, '1. ' || source || chr(10) || '   http://x/' || doc_id || chr(10) || '   ' || lang || chr(10) || '[error] gone ' || doc_id || chr(10) || '3. ' || chr(10) || '   http://y' || chr(10) || '   ' AS shown FROM documents""")
def hits_as_text(spark, folder):
    none = F.lit(None).cast("string")
    hit = lambda title, url, snippet, error: F.struct(title.alias("title"), url.alias("url"), snippet.alias("snippet"), error.alias("error"))
    hits = F.array(hit(F.col("source"), said("http://x/%s", "doc_id"), F.col("lang"), none), hit(none, none, none, said("gone %s", "doc_id")), hit(none, F.lit("http://y"), none, none))
    return read(spark, folder, "documents").select("doc_id", text.render_hits(hits).alias("shown"))


@query("""SELECT doc_id, 'x2 * ' || doc_id || ' <= alpha - 10' AS plain, '(' || doc_id || ')/(2) * sqrt(x)  y' AS expression FROM documents""")
def math_forms(spark, folder):
    return read(spark, folder, "documents").select(
        "doc_id", text.normalize_math(said("x² × %s ≤ α − 1⁰", "doc_id")).alias("plain"), text.latex_to_expression(said(" \\frac{%s}{2} \\cdot \\sqrt{x} \\left y., ", "doc_id")).alias("expression")
    )


@query("""
SELECT doc_id, 'You are ' || ['a senior software engineer', 'a research scientist', 'a technical writer', 'a knowledgeable teacher'][1 + doc_id % 4] || '. Write 3 question, thinking and answer items as a JSON list about:' || chr(10)
  || left(text, 2000) || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Context: ' || source ELSE '' END AS prompt FROM documents""")
def persona_prompts(spark, folder):
    kind = text.doc_type(F.concat(F.lit("d"), one_of(F.col("doc_id") % 4, ".py", ".tex", ".md", ".txt")))
    context = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("")
    return read(spark, folder, "documents").select("doc_id", text.persona_prompt(kind, F.col("text"), context).alias("prompt"))


@query("""SELECT doc_id, source FROM documents JOIN labels USING (doc_id) WHERE toxic = 0""")
def moderated_documents(spark, folder):
    """Documents that are known not to be flagged."""
    flags = read(spark, folder, "labels").select("doc_id", (F.col("toxic") == 1).alias("harm"))
    return quality.moderate(read(spark, folder, "documents").join(flags, "doc_id", "left")).select("doc_id", "source")


@query("""SELECT conv_id, max(CASE WHEN role = 'assistant' THEN text || ' so ' || turn END) AS text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) WHERE n = 1 GROUP BY conv_id""")
def moderation_texts(spark, folder):
    """What a talk's first assistant turn says and thinks, as moderation reads it."""
    message = F.struct("turn", "role", F.col("text").alias("content"), said("so %s", "turn").alias("thinking"))
    talks = read(spark, folder, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("messages"))
    first = F.exists("messages", lambda m: m["role"] == "assistant")
    return talks.select("conv_id", F.when(first, quality.moderation_text(F.col("messages"))).alias("text"))


@query("""
SELECT conv_id, turn, to_json([{'from': CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END, 'value': text}])::VARCHAR AS turns FROM conversations""")
def sharegpt_export(spark, folder):
    """The line that each turn is in an exported file, read back from its JSON."""
    turns = read(spark, folder, "conversations").select("conv_id", "turn", formats.to_sharegpt(F.array(F.struct("role", F.col("text").alias("content"), F.lit(None).cast("string").alias("thinking")))).alias("conversations"))
    lines = turns.select("conv_id", "turn", F.get_json_object(F.to_json(F.struct("conversations")), "$.conversations").alias("turns"))
    return lines
