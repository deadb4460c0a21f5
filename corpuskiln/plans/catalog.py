"""All core queries by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import chunks as cuts, formats, text
from ..functions.stored import stored_folder
from ..operators import graph, quality, registry, vectors
from ..sources import files, papers, store
from ..streaming import stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def talks(spark: SparkSession, folder: str) -> DataFrame:
    """(conv_id, messages): the turns of each conversation in order, as messages."""
    turn = F.struct("turn", "role", F.col("text").alias("content"), F.lit(None).cast("string").alias("thinking"))
    grouped = read(spark, folder, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"), t["thinking"].alias("thinking"))).alias("messages"))


FIRST = """SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'system') AS s, arg_min(text, turn) FILTER (WHERE role = 'user') AS u,
  arg_min(text, turn) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY conv_id"""
WHITE = r"'^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$'"


@query(f"""
SELECT conv_id, 'English' AS reasoning_language, coalesce(s, 'You are a helpful AI assistant.') AS developer, u AS "user", '' AS analysis,
  regexp_replace(a, {WHITE}, '', 'g') AS final FROM ({FIRST}) WHERE u IS NOT NULL AND a IS NOT NULL""")
def sft_export(spark, folder):
    return store.sft_rows(talks(spark, folder)).drop("messages")


@query(f"""SELECT conv_id, coalesce(u, '') AS input, coalesce(a, '') AS output FROM ({FIRST})""")
def first_pair(spark, folder):
    turns = talks(spark, folder).select("conv_id", formats.to_sharegpt(F.col("messages")).alias("t"))
    return turns.select("conv_id", formats.first_value(F.col("t"), "human").alias("input"), formats.first_value(F.col("t"), "gpt", "assistant").alias("output"))


@query("""
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS pos,
  CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS "from", text AS value FROM conversations""")
def sharegpt_turns(spark, folder):
    turns = talks(spark, folder).select("conv_id", F.posexplode(formats.to_sharegpt(F.col("messages"))).alias("pos", "t"))
    return turns.select("conv_id", "pos", F.col("t.from").alias("from"), F.col("t.value").alias("value"))


@query(f"""
SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND turn % 2 = 1 THEN 'step ' || turn END AS thinking,
  CASE WHEN role = 'assistant' AND turn % 2 = 1 THEN regexp_replace(text, {WHITE}, '', 'g') ELSE text END AS content FROM conversations""")
def think_roundtrip(spark, folder):
    thinking = F.when((F.col("role") == "assistant") & (F.col("turn") % 2 == 1), F.concat(F.lit("step "), F.col("turn")))
    one = read(spark, folder, "conversations").withColumn("m", F.array(F.struct("role", F.col("text").alias("content"), thinking.alias("thinking"))))
    back = one.select("conv_id", "turn", F.get(formats.to_openai(formats.to_sharegpt(F.col("m"))), F.lit(0)).alias("m"))
    return back.select("conv_id", "turn", "m.role", "m.thinking", "m.content")


@query("""SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3""")
def history_last_n(spark, folder):
    return stateful.last_turns(read(spark, folder, "conversations"), "conv_id", "turn", 3)


@query(r"""SELECT conv_id, turn, text FROM conversations WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) >= 10""")
def short_turn_filter(spark, folder):
    return read(spark, folder, "conversations").where(text.enough_words(F.col("text"), 10)).select("conv_id", "turn", "text")


@query("""SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(source), 'idiot')""")
def keyword_search(spark, folder):
    return store.search(read(spark, folder, "documents"), "Idiot", ["text", "source", "no_such_column"]).select("doc_id", "lang")


@query("""SELECT doc_id, source, n_chars FROM documents WHERE lang = 'fr'""")
def split_load(spark, folder):
    return read(spark, folder, "documents").where(F.col("lang") == "fr").select("doc_id", "source", "n_chars")


@query("""SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 42""")
def point_get(spark, folder):
    return read(spark, folder, "documents").where(F.col("doc_id") == 42).limit(1).select("doc_id", "lang", "source", "n_chars")


@query("""
SELECT count(*) AS total_rows, count(*) FILTER (WHERE text <> '') AS has_output, count(l.doc_id) AS has_embedding,
  count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'de') AS de FROM documents d LEFT JOIN labels l USING (doc_id)""")
def dataset_stats(spark, folder):
    docs = read(spark, folder, "documents").join(read(spark, folder, "labels").select("doc_id", F.lit(True).alias("has_embedding")), "doc_id", "left")
    rows = docs.select(F.col("lang").alias("split"), "source", F.col("text").alias("output"), F.coalesce("has_embedding", F.lit(False)).alias("has_embedding"))
    count = lambda s: F.coalesce(F.try_element_at(F.map_from_entries("splits"), F.lit(s)), F.lit(0)).cast("long").alias(s)
    return store.stats(rows).select("total_rows", "has_output", "has_embedding", count("en"), count("de"))


@query("""
SELECT 'documents' AS dataset_name, lang AS split, count(*) AS n FROM documents GROUP BY lang
UNION ALL SELECT 'conversations', role, count(*) FROM conversations GROUP BY role""")
def dataset_catalog(spark, folder):
    docs = read(spark, folder, "documents").select(F.lit("documents").alias("dataset_name"), F.col("lang").alias("split"))
    turns = read(spark, folder, "conversations").select(F.lit("conversations").alias("dataset_name"), F.col("role").alias("split"))
    return store.catalog(docs.union(turns))


@query("""
WITH cur AS (SELECT 'd' || doc_id AS id, source || ':' || (doc_id % 40) AS input, n_chars FROM documents),
  new AS (SELECT 'b' || item_id AS id, CASE WHEN item_id % 5 = 0 THEN '' ELSE 'src' || (item_id % 20) || ':' || (item_id % 40) END AS input, length(text) AS n_chars FROM benchmark)
SELECT * FROM cur WHERE input NOT IN (SELECT input FROM new WHERE input <> '') UNION ALL SELECT * FROM new""")
def upsert_batch(spark, folder):
    current = read(spark, folder, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.concat("source", F.lit(":"), F.col("doc_id") % 40).alias("input"), "n_chars")
    key = F.when(F.col("item_id") % 5 == 0, "").otherwise(F.concat(F.lit("src"), F.col("item_id") % 20, F.lit(":"), F.col("item_id") % 40))
    return store.upsert(current, read(spark, folder, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), key.alias("input"), F.char_length("text").cast("long").alias("n_chars")))


@query("""SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def unindexed_rows(spark, folder):
    return vectors.missing_from(read(spark, folder, "documents"), read(spark, folder, "labels"), "doc_id").select("doc_id", "lang")


@query("""SELECT d.doc_id, (l.doc_id IS NOT NULL) AS has_embedding FROM documents d LEFT JOIN labels l USING (doc_id)""")
def flag_indexed(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", F.lit(False).alias("has_embedding"))
    return vectors.flag_indexed(docs, read(spark, folder, "labels"), "doc_id").select("doc_id", "has_embedding")


@query()
def chunk_plain_rows(spark, folder):
    chunks = cuts.chunk_plain(F.col("text"), 1500, 200, r"\n+")
    return read(spark, folder, "documents").select("doc_id", F.posexplode(chunks).alias("pos", "chunk")).select("doc_id", "pos", F.char_length("chunk").alias("n"), F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[*#`_~\\[\\]{}|\\\\<>@]', '', 'g'), '[ \\t]+', ' ', 'g'), """ + WHITE + """, '', 'g') AS cleaned FROM documents""")
def clean_text(spark, folder):
    return read(spark, folder, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query("""
WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[*#`_~\\[\\]{}|\\\\<>@]', '', 'g'), '[ \\t]+', ' ', 'g'), """ + WHITE + """, '', 'g') AS t FROM documents),
s AS (SELECT doc_id, unnest(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS p FROM c)
SELECT doc_id, count(*) AS sentences, max(length(p)) AS longest FROM s WHERE p <> '' GROUP BY doc_id""")
def sentence_rows(spark, folder):
    sizes = F.transform(text.sentences(F.col("text")), F.char_length)
    both = F.transform(F.array(sizes), lambda s: F.struct(F.size(s).cast("long").alias("sentences"), F.array_max(s).cast("long").alias("longest")))
    # Out of a generator, so that the split is worked out once and not again for the filter.
    return read(spark, folder, "documents").select("doc_id", F.inline(both)).where("sentences > 0")


@query()
def tts_chunks(spark, folder):
    return read(spark, folder, "documents").select("doc_id", F.posexplode(text.speech_chunks(F.col("text"))).alias("pos", "chunk"))


@query("""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'),
  '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), '^ +| +$', '', 'g') AS text FROM pages""")
def html_text(spark, folder):
    return read(spark, folder, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


HREFS = "SELECT page_id, unnest(regexp_extract_all(html, '(?:src|href)=[''\"]([^''\"#?]+)[''\"]', 1)) AS ref FROM pages"


@query(f"""SELECT page_id, ref, count(*) AS n FROM ({HREFS}) GROUP BY page_id, ref""")
def html_refs(spark, folder):
    refs = read(spark, folder, "pages").select("page_id", F.explode(text.references(F.col("html"), "html")).alias("ref"))
    return refs.groupBy("page_id", "ref").agg(F.count("*").alias("n"))


def query_vector(spark, folder) -> list[float]:
    """The vector of the smallest id asks."""
    return read(spark, folder, "embeddings").orderBy("vec_id").limit(1).first()["embedding"]


SCORED = """SELECT e.vec_id, e.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s
  FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q"""


@query(f"""SELECT vec_id, round(s, 4) AS score FROM ({SCORED}) ORDER BY s DESC, vec_id LIMIT 10""")
def cosine_topk(spark, folder):
    return vectors.top_k(read(spark, folder, "embeddings"), query_vector(spark, folder), 10, "vec_id").withColumn("score", F.round("score", 4))


@query(f"""
SELECT label, vec_id, score FROM (SELECT label, vec_id, round(s, 4) AS score, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS r FROM ({SCORED}))
WHERE r <= 8 ORDER BY score DESC, label, r LIMIT 8""")
def search_all(spark, folder):
    return vectors.search_all(read(spark, folder, "embeddings"), query_vector(spark, folder), 8, "label", "vec_id")


@query(f"""SELECT t.vec_id, round(t.s, 4) AS score, d.lang FROM (SELECT vec_id, s FROM ({SCORED}) ORDER BY s DESC, vec_id LIMIT 12) t JOIN documents d ON d.doc_id = t.vec_id WHERE d.lang = 'en'""")
def topk_lookup(spark, folder):
    rows = read(spark, folder, "documents").where("lang = 'en'").select(F.col("doc_id").alias("vec_id"), "lang")
    return vectors.search(read(spark, folder, "embeddings"), rows, query_vector(spark, folder), 12, "vec_id")


@query("""
SELECT a.vec_id AS source, b.vec_id AS target, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS similarity
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.4""")
def semantic_edges(spark, folder):
    return vectors.similarity_edges(read(spark, folder, "embeddings"), None, 0.4, "vec_id").select("source", "target", F.round("similarity", 4).alias("similarity"))


@query("""
SELECT vec_id, label, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(before AS DOUBLE[])), 4) AS drift
FROM (SELECT *, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings)""")
def vector_drift(spark, folder):
    return vectors.drift(read(spark, folder, "embeddings"), "label", "vec_id").select("vec_id", "label", "drift")


@query("""SELECT d.doc_id, coalesce(l.toxic = 1, true) AS flagged FROM documents d LEFT JOIN labels l USING (doc_id)""")
def moderation_failsafe(spark, folder):
    reply = F.when(F.col("toxic") == 1, " Yes ").when(F.col("toxic") == 0, "no")
    return read(spark, folder, "documents").join(read(spark, folder, "labels"), "doc_id", "left").select("doc_id", quality.flagged(reply).alias("flagged"))


@query("""SELECT doc_id, bool_or(flagged) AS any_flagged, bool_or(flagged) FILTER (WHERE c = 'harm') AS harm, bool_or(flagged) FILTER (WHERE c = 'profanity') AS profanity
FROM (SELECT doc_id, 'harm' AS c, toxic = 1 AS flagged FROM labels UNION ALL SELECT doc_id, 'profanity', quality = 0 FROM labels) GROUP BY doc_id""")
def moderation_pivot(spark, folder):
    labels = read(spark, folder, "labels")
    both = labels.select("doc_id", F.lit("harm").alias("category"), (F.col("toxic") == 1).alias("flagged")).union(labels.select("doc_id", F.lit("profanity"), F.col("quality") == 0))
    return quality.verdict_map(both, "doc_id").select("doc_id", "any_flagged", F.col("verdicts")["harm"].alias("harm"), F.col("verdicts")["profanity"].alias("profanity"))


@query("""
SELECT source, round(avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 WHEN quality = 1 THEN 0.5 ELSE 0 END) * 100, 6) AS score,
  avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 WHEN quality = 1 THEN 0.5 ELSE 0 END) * 100 >= 95 AS advances FROM labels JOIN documents USING (doc_id) GROUP BY source""")
def completion_score(spark, folder):
    grade = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "PASS").when(F.col("quality") == 1, "PARTIAL").otherwise("FAIL")
    graded = read(spark, folder, "labels").join(read(spark, folder, "documents").select("doc_id", "source"), "doc_id").select("source", grade.alias("grade"))
    return quality.completion(graded, "source").withColumn("score", F.round("score", 6))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\$([^$\n]{1,150})\$', 1)) AS spans FROM documents""")
def latex_spans(spark, folder):
    return read(spark, folder, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"\$([^$\n]{1,150})\$"), 1)).cast("long").alias("spans"))


@query()
def claims_in_documents(spark, folder):
    return quality.validation_rollup(quality.validate(read(spark, folder, "documents"), "text", "doc_id"))


@query("""
SELECT doc_id, CASE WHEN a IN (0, 1, 4, 5, 6) THEN 1 ELSE 0 END AS verified, CASE WHEN a IN (2, 7, 8) THEN 1 ELSE 0 END AS failed, CASE WHEN a IN (3, 9) THEN 1 ELSE 0 END AS skipped,
  CASE WHEN a IN (2, 7, 8) THEN 'failed' ELSE 'passed' END AS status FROM (SELECT doc_id, doc_id % 10 AS a FROM documents)""")
def symbolic_claims(spark, folder):
    """Every document without its dollar and equals signs, closed by one claim in LaTeX about its own numbers: five kinds hold, three don't, two can't be told."""
    n, m = F.col("doc_id") + 2, F.col("n_chars") + 1
    said = lambda pattern, *args: F.format_string(pattern, *args)
    claims = [
        said("$(x+%d)^2 = x^2 + %dx + %d$", n, 2 * n, n * n), said("$\\frac{%d}{x} + \\frac{%d}{y} = (%dy + %dx)/(xy)$", n, m, n, m),
        said("$(x+%d)^2 = x^2 + %dx + %d$", n, 2 * n, n * n + 1), said("$(x+%d)^2 = x^2 + %d$", n, n * n), said("$%d \\times %d = %d$", n, m, n * m),
        said("$$\\sqrt{%d} = %d$$", n * n, n), said("$sin(%dx)^2 + cos(%dx)^2 = 1$", n, n), said("$\\frac{%d}{%d} = %d$", n, n + 1, m), said("$$\\sqrt{%d} = %d$$", n * n + 1, n),
        said("$E_%d = m c^2$", n),
    ]
    claim = F.get(F.array(*claims), (F.col("doc_id") % 10).cast("int"))
    rows = read(spark, folder, "documents").select("doc_id", F.concat(F.translate(F.coalesce("text", F.lit("")), "$=", ""), F.lit("\n"), claim).alias("text"))
    found = quality.validate(rows, "text", "doc_id", symbolic=True)
    return found.select("doc_id", F.col("verified").cast("int").alias("verified"), F.col("failed").cast("int").alias("failed"), F.col("skipped").cast("int").alias("skipped"), "status")


@query(f"""SELECT CAST(page_id AS VARCHAR) AS source, ref AS target FROM ({HREFS}) GROUP BY page_id, ref""")
def page_graph_edges(spark, folder):
    refs = read(spark, folder, "pages").select(F.col("page_id").cast("string").alias("source"), F.explode(text.references(F.col("html"), "html")).alias("target"))
    return refs.distinct()


@query(f"""
WITH e AS (SELECT 'p' || page_id AS source, ref AS target FROM ({HREFS}) GROUP BY page_id, ref),
  n AS (SELECT 'p' || page_id AS id, split_part(split_part(url, '://', 2), '/', 1) AS g FROM pages UNION SELECT ref, 'ref' FROM ({HREFS}))
SELECT source, target FROM e WHERE source IN (SELECT id FROM n WHERE g LIKE '%.com' OR g = 'ref') AND target IN (SELECT id FROM n WHERE g LIKE '%.com' OR g = 'ref')""")
def group_subgraph(spark, folder):
    pages = read(spark, folder, "pages")
    refs = pages.select(F.concat(F.lit("p"), "page_id").alias("source"), F.explode(text.references(F.col("html"), "html")).alias("target")).distinct()
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    nodes = pages.select(F.concat(F.lit("p"), "page_id").alias("id"), F.when(host.endswith(".com"), "com").otherwise("other").alias("group")).union(refs.select("target", F.lit("ref")).distinct())
    return graph.hide_groups(nodes, refs, ["com", "ref"])[1]


@query(f"""SELECT DISTINCT 'p7' AS id FROM pages UNION SELECT ref FROM ({HREFS}) WHERE page_id = 7""")
def neighborhood(spark, folder):
    refs = read(spark, folder, "pages").select(F.concat(F.lit("p"), "page_id").alias("source"), F.explode(text.references(F.col("html"), "html")).alias("target")).distinct()
    nodes = refs.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return graph.neighbourhood(nodes, refs, "p7")[0].select("id")


@query("""SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS lines, strlen(text) AS size, 'd' || doc_id || '.txt' AS label, source AS "group" FROM documents""")
def node_metrics(spark, folder):
    path = F.concat("source", F.lit("\\d"), "doc_id", F.lit(".txt"))
    return read(spark, folder, "documents").select(
        "doc_id", text.line_count(F.col("text")).cast("long").alias("lines"), F.octet_length("text").cast("long").alias("size"), text.basename(path).alias("label"), text.top_folder(path).alias("group")
    )


@query("""SELECT lang, count(*) AS n FROM documents GROUP BY lang""")
def lang_counts(spark, folder):
    return graph.language_counts(read(spark, folder, "documents"))


THROTTLED = """
WITH RECURSIVE a(event_type, ts) AS (
  SELECT event_type, min(ts) FROM events GROUP BY event_type
  UNION ALL
  SELECT a.event_type, (SELECT min(e.ts) FROM events e WHERE e.event_type = a.event_type AND e.ts >= a.ts + INTERVAL 600 SECOND)
  FROM a WHERE (SELECT min(e.ts) FROM events e WHERE e.event_type = a.event_type AND e.ts >= a.ts + INTERVAL 600 SECOND) IS NOT NULL)
SELECT event_type, count(*) AS accepted, epoch_us(max(ts)) // 1000000 AS last_s FROM a GROUP BY event_type"""


@query(THROTTLED)
def throttle_events(spark, folder):
    kept = stateful.throttle(read(spark, folder, "events").select("event_id", "event_type", "ts"), "event_type", "ts", 600.0, "event_id")
    return kept.groupBy("event_type").agg(F.count("*").alias("accepted"), F.unix_seconds(F.max(F.col("ts").cast("timestamp"))).alias("last_s"))


@query("""SELECT user_id, arg_max(event_type, (ts, event_type)) AS changed_by, CAST(epoch_us(max(ts)) AS BIGINT) AS at_us FROM events GROUP BY user_id""")
def latest_change(spark, folder):
    events = read(spark, folder, "events").select(F.col("user_id").cast("string").alias("file"), F.col("event_type").alias("by"), F.col("ts").cast("timestamp").alias("ts"))
    nodes = events.select(F.col("file").alias("id")).distinct().withColumns({"changed_by": F.lit(None).cast("string"), "change_time": F.lit(None).cast("timestamp")})
    return graph.apply_changes(nodes, events).select(F.col("id").cast("long").alias("user_id"), "changed_by", F.unix_micros("change_time").alias("at_us"))


@query("""SELECT user_id, CAST(epoch_us(max(ts)) AS BIGINT) AS at_us FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 10""")
def recent_keys(spark, folder):
    return registry.recent(read(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts").select("user_id", F.unix_micros("last").alias("at_us"))


@query("""SELECT CAST(count(*) AS BIGINT) AS turns, CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations""")
def stream_lines_total(spark, folder):
    """The output stream of a model, one JSON line for each turn, decoded back to its text."""
    lines = read(spark, folder, "conversations").select(F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.struct(F.col("text").alias("text")).alias("delta"))).alias("line"))
    said = lines.select(formats.delta_text(F.col("line")).alias("said"))
    return said.agg(F.count("*").alias("turns"), F.sum(F.char_length("said")).alias("characters"))


@query()
def spoken_stream(spark, folder):
    """Every turn fed word by word through the sentence buffer."""
    turns = read(spark, folder, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("stream_id"), F.posexplode(F.split("text", r"(?<=\s)")).alias("seq", "token"))
    return stateful.sentence_chunks(turns.withColumn("seq", F.col("seq").cast("long")))


#: Frames of the recursive machines in SQL, numbered in each stream.
FRAMES = """f AS (SELECT event_type AS stream_id, event_id AS frame_no, coalesce(value > 50, false) AS sp, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events)"""


@query(f"""
WITH RECURSIVE {FRAMES},
m(stream_id, n, frame_no, heard, run, b, quiet, seg_b, seg_e) AS (
  SELECT DISTINCT stream_id, 0::BIGINT, 0::BIGINT, 0, 0, NULL::BIGINT, 0, NULL::BIGINT, NULL::BIGINT FROM f
  UNION ALL
  SELECT stream_id, n, frame_no, CASE WHEN fl THEN 0 ELSE heard END, CASE WHEN fl THEN 0 ELSE run END, CASE WHEN fl THEN NULL ELSE b END, CASE WHEN fl THEN 0 ELSE quiet END,
    CASE WHEN fl AND (b IS NOT NULL OR run > 0) THEN coalesce(b, frame_no - run + 1) END, CASE WHEN fl AND (b IS NOT NULL OR run > 0) THEN frame_no END
  FROM (SELECT *, (b IS NOT NULL AND quiet >= 4) OR heard >= 2000 AS fl FROM (
    SELECT stream_id, n, frame_no, heard, run, quiet, CASE WHEN b IS NULL AND run = 3 THEN frame_no - 2 ELSE b END AS b FROM (
      SELECT f.stream_id, f.n, f.frame_no, m.heard + 1 AS heard, CASE WHEN m.b IS NOT NULL THEN m.run WHEN sp THEN m.run + 1 ELSE 0 END AS run,
        CASE WHEN m.b IS NULL THEN m.quiet WHEN sp THEN 0 ELSE m.quiet + 1 END AS quiet, m.b FROM m JOIN f ON f.stream_id = m.stream_id AND f.n = m.n + 1))))
SELECT stream_id, seg_b AS "begin", seg_e AS "end" FROM m WHERE seg_b IS NOT NULL
UNION ALL SELECT stream_id, coalesce(b, frame_no - run + 1), frame_no FROM m WHERE (b IS NOT NULL OR run > 0) AND (stream_id, n) IN (SELECT stream_id, max(n) FROM f GROUP BY stream_id)""")
def voice_segment_frames(spark, folder):
    """Events as frames of one stream for each type: values over their middle are speech."""
    frames = read(spark, folder, "events").select(F.col("event_type").alias("stream_id"), F.col("event_id").alias("frame_no"), (F.col("value") > 50).alias("is_speech"))
    return stateful.voice_segments(frames, silence_ms=120)


@query(f"""
WITH RECURSIVE {FRAMES},
m(stream_id, n, frame_no, c, kept, hit) AS (
  SELECT DISTINCT stream_id, 0::BIGINT, 0::BIGINT, 0, []::BIGINT[], NULL::BIGINT[] FROM f
  UNION ALL
  SELECT stream_id, n, frame_no, CASE WHEN c >= 3 THEN 0 ELSE c END, CASE WHEN c >= 3 THEN [] ELSE kept END, CASE WHEN c >= 3 THEN kept END FROM (
    SELECT f.stream_id, f.n, f.frame_no, CASE WHEN sp THEN m.c + 1 ELSE greatest(m.c - 1, 0) END AS c, list_append(m.kept, f.frame_no)[-5:] AS kept FROM m JOIN f ON f.stream_id = m.stream_id AND f.n = m.n + 1))
SELECT stream_id, frame_no, array_to_string(hit, ',') AS buffered FROM m WHERE hit IS NOT NULL""")
def voice_onset_frames(spark, folder):
    """Where speech is noticed in the same frames, with the frames kept from before."""
    frames = read(spark, folder, "events").select(F.col("event_type").alias("stream_id"), F.col("event_id").alias("frame_no"), (F.col("value") > 50).alias("is_speech"))
    return stateful.onsets(frames).withColumn("buffered", F.array_join(F.col("buffered").cast("array<string>"), ","))


@query("""
WITH f AS (SELECT event_type AS stream_id, event_id AS frame_no, NOT coalesce(value > 50, false) AS silent FROM events),
b AS (SELECT stream_id, min(frame_no) AS "begin" FROM f WHERE NOT silent GROUP BY stream_id),
n AS (SELECT f.*, b."begin", sum(silent::INT) OVER (PARTITION BY f.stream_id ORDER BY frame_no ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS quiet
      FROM f JOIN b USING (stream_id) WHERE frame_no >= b."begin" AND frame_no < b."begin" + 1000)
SELECT stream_id, "begin", coalesce(min(frame_no) FILTER (WHERE quiet >= 4), max(frame_no)) AS "end" FROM n GROUP BY ALL""")
def voice_continue_frames(spark, folder):
    """Each type's frames go on from its first speech."""
    frames = read(spark, folder, "events").select(F.col("event_type").alias("stream_id"), F.col("event_id").alias("frame_no"), F.coalesce(F.col("value") > 50, F.lit(False)).alias("is_speech"))
    starts = frames.where("is_speech").groupBy("stream_id").agg(F.min("frame_no").alias("begin"))
    return stateful.voice_continue(frames, starts, silence_ms=120)


@query("""
WITH said AS (SELECT conv_id, turn, 'user' AS role, text FROM conversations WHERE role = 'system'),
last AS (SELECT conv_id, max(turn) AS m FROM conversations WHERE role <> 'system' GROUP BY conv_id)
SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system' UNION ALL
SELECT s.conv_id, coalesce(m + 1, 0) + row_number() OVER (PARTITION BY s.conv_id ORDER BY turn) - 1, role, text FROM said s LEFT JOIN last USING (conv_id)""")
def history_append(spark, folder):
    """System turns said again as the user, after the other turns."""
    turns = read(spark, folder, "conversations")
    said = turns.where("role = 'system'").select("conv_id", F.lit("user").alias("role"), "text", F.col("turn").alias("place"))
    return stateful.append_turns(turns.where("role <> 'system'"), said)


@query("""SELECT source AS path, source AS name, count(*) FILTER (WHERE lang = 'en') AS files FROM documents GROUP BY source""")
def project_registry(spark, folder):
    """Sources as projects, registered twice; English documents are their files."""
    docs = read(spark, folder, "documents")
    found = docs.groupBy(F.col("source").alias("path")).agg(F.min("doc_id").alias("place"))
    projects = graph.register(graph.register(found.limit(0), found), found)
    return graph.project_list(projects, docs.where("lang = 'en'").select(F.col("source").alias("project"), F.col("doc_id").cast("string").alias("id")))


@query("""
WITH first AS (SELECT source FROM documents ORDER BY doc_id LIMIT 1)
SELECT doc_id::VARCHAR AS id, source AS project FROM documents WHERE source = (SELECT source FROM first) AND lang <> 'fr'""")
def project_snapshot(spark, folder):
    """The first project after a refresh that found its documents but the French ones."""
    docs = read(spark, folder, "documents")
    projects = docs.groupBy(F.col("source").alias("path")).agg(F.min("doc_id").alias("place"))
    nodes = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("project"), F.lit(None).cast("string").alias("changed_by"), F.lit(None).cast("timestamp").alias("change_time"))
    first = docs.orderBy("doc_id").first()["source"]
    found = docs.where((F.col("source") == first) & (F.col("lang") != "fr")).select(F.col("doc_id").cast("string").alias("id"))
    return graph.snapshot(projects, graph.refresh(nodes, first, found), "no such project").select("id", "project")


@query("""SELECT label::VARCHAR AS name, count(*) AS count FROM embeddings GROUP BY label""")
def index_listing(spark, folder):
    """Vectors stored as one index for each label, then listed."""
    index = store.VectorIndex(spark, stored_folder(spark))
    vectors_ = read(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("dataset_name"), "embedding")
    for r in vectors_.select("dataset_name").distinct().collect():  # a few labels
        index.save(r["dataset_name"], vectors_.where(F.col("dataset_name") == r["dataset_name"]))
    return index.listing().select("name", "count")


from . import derived  # noqa: E402, F401  its queries are in the same tables
