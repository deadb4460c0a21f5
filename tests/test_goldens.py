"""Results worked out by hand: chunks, speech, claims, moderation, the store, indexes, state machines and streams."""

import math
import time

import pytest
from pyspark.sql import functions as F

from corpuskiln.functions import chunks, formats, text
from corpuskiln.operators import graph, providers, quality, vectors
from corpuskiln.plans import pipelines
from corpuskiln.sources import files, store
from corpuskiln.streaming import machines, stateful


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("r")).first().r


# ---- chunks


@pytest.mark.parametrize(
    "given, expected",
    [
        ("aaaa\n\nbbbb\n\ncccc", ["aaaa\n\nbbbb", "bbbb\n\ncccc"]),
        ("aaaaa\n\nbbbbb\n\nccccc", ["aaaaa\n\nbbbbb", "ccccc"]),
        ("x" * 30, ["x" * 30]),
        (" \n\n \n\n\t", []),
        ("", []),
        ("aa\n\n" + "b" * 30 + "\n\ncc", ["aa", "aa\n\n" + "b" * 30, "cc"]),
    ],
)
def test_chunk_plain(given, expected):
    assert chunks.packed(given, 10, 4) == expected


def test_packing_is_a_walk_over_the_paragraphs():
    import random

    r = random.Random(2)
    for _ in range(300):
        sizes = [r.randint(0, 12) for _ in range(r.randint(0, 14))]
        size, overlap = r.randint(1, 20), r.randint(0, 8)
        expected, held = [], []
        for i, n in enumerate(sizes):
            if held and sum(sizes[j] for j in held) + n > size:
                expected.append((held[0], held[-1] + 1))
                while sum(sizes[j] for j in held) > overlap:
                    del held[0]
            held.append(i)
        if sizes:
            expected.append((held[0], held[-1] + 1))
        assert chunks.pack_ranges(sizes, size, overlap) == expected


def test_chunk_code_latex_and_dispatch(spark):
    two = "import x\ndef a():\n    pass\ndef b():\n    pass"
    assert chunks.code_chunks("no boundary here", 10, 0) == chunks.packed("no boundary here", 10, 0)
    assert chunks.code_chunks("def only():\n" + "    x\n" * 50, 10, 0) == [("def only():\n" + "    x\n" * 50).strip()]
    assert chunks.code_chunks(two, 100, 0) == ["import x\ndef a():\n    pass", "def b():\n    pass"]
    assert chunks.code_chunks(two, 100, 5)[1].endswith("def b():\n    pass") and len(chunks.code_chunks(two, 100, 5)[1]) > len("def b():\n    pass")
    latex = "intro\n\\section{A}x\n\\section{B}y"
    assert chunks.latex_chunks(latex, 100, 0) == ["\\section{A}x", "\\section{B}y"]
    docs = spark.createDataFrame([("a.py", two), ("b.tex", latex), ("c.md", "p\n\nq"), ("d.txt", None)], "path string, text string")
    got = {(r.path, r.pos): r.chunk for r in pipelines.document_chunks(docs).collect()}
    assert got == {("a.py", 0): "import x\ndef a():\n    pass", ("a.py", 1): two, ("b.tex", 0): "\\section{A}x", ("b.tex", 1): "\\section{B}y", ("c.md", 0): "p\n\nq"}
    assert one(spark, chunks.chunk_latex, latex) == ["\\section{A}x", "\\section{B}y"]


@pytest.mark.parametrize(
    "given, expected",
    [
        ("Hi. This is a long sentence.", ["Hi. This is a long sentence."]),
        ("This is sentence one. Another longer sentence.", ["This is sentence one.", "Another longer sentence."]),
        ("a" * 300, ["a" * 250, "a" * 50]),
        ("word " * 60, [("word " * 50).strip(), ("word " * 10).strip()]),
        ("b" * 250 + " c", ["b" * 250, "c"]),
        (None, []),
    ],
)
def test_speech_chunks(spark, given, expected):
    assert one(spark, text.speech_chunks, given) == expected


def test_small_text_functions(spark):
    assert one(spark, text.clean, "**Hi** [x]") == "Hi x"
    assert one(spark, text.html_text, "<SCRIPT>a\nb</SCRIPT>x<b>y</b>") == "x y"
    assert one(spark, lambda c: text.references(c, "html"), "<a href='p.html#q'><a href='p.html'>") == ["p.html"]
    assert one(spark, lambda c: text.references(c, "markdown"), "[t](a.md) ![i](b.png) [u](http://x)") == ["a.md", "b.png", "http://x"]
    assert [r.r for r in spark.createDataFrame([("m-BF16.gguf",), ("m-q8_0.gguf",), ("m.gguf",)], "c string").select(text.quantization(F.col("c")).alias("r")).collect()] == ["BF16", "Q8_0", ""]


# ---- conversation formats


def test_thinking_round_trip(spark):
    kinds = "c array<struct<role:string,content:string,thinking:string>>"
    df = spark.createDataFrame([([("assistant", "A", "T"), ("tool", "x", None)],)], kinds).select(formats.to_sharegpt(F.col("c")).alias("s"))
    turns = df.first().s
    assert [(t["from"], t["value"]) for t in turns] == [("gpt", "<think>\nT\n</think>\n\nA"), ("tool", "x")]
    back = df.select(formats.to_openai(F.col("s")).alias("m")).first().m
    assert [(m.role, m.content, m.thinking) for m in back] == [("assistant", "A", "T"), ("tool", "x", None)]


@pytest.mark.parametrize("who, value, expected", [("gpt", "x <think>t</think> y", ("assistant", "x <think>t</think> y", None)), ("human", "<think>t</think> y", ("user", "<think>t</think> y", None)), ("gpt", "<think> </think> y", ("assistant", "y", None))])
def test_think_only_at_the_start_of_answers(spark, who, value, expected):
    df = spark.createDataFrame([([(who, value)],)], "c array<struct<from:string,value:string>>")
    m = df.select(formats.to_openai(F.col("c")).alias("m")).first().m[0]
    assert (m.role, m.content, m.thinking) == expected


# ---- claims, moderation, completion


CLAIMS = [
    ("2 + 2 = 4", (1, 1, 0, 0, 1.0, "passed")), ("2 + 2 = 5", (1, 0, 1, 0, 0.0, "failed")), ("2 + 2 = 4 and 3 * 3 = 8", (2, 1, 1, 0, 0.5, "failed")), ("1 / 0 = 5", (1, 0, 0, 1, 1.0, "passed")),
    ("2^3 = 8", (1, 0, 0, 1, 1.0, "passed")), ("$x = 5$", (1, 0, 0, 1, 1.0, "passed")), ("$$4 = 4$$", (1, 1, 0, 0, 1.0, "passed")), ("no maths", (0, 0, 0, 0, 1.0, "no_math")), (None, (0, 0, 0, 0, 1.0, "no_math")),
]


def test_claims(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLAIMS)], "id int, t string")
    got = {r.id: (r.found, r.verified, r.failed, r.skipped, r.score, r.status) for r in quality.validate(df, "t", "id").collect()}
    assert got == {i: e for i, (_, e) in enumerate(CLAIMS)}
    accepted = {r.id: r.accepted for r in quality.validate(df, "t", "id").collect()}
    assert not accepted[1] and not accepted[2] and accepted[0] and accepted[7]
    many = spark.createDataFrame([(0, "; ".join(f"{i} + 1 = {i + 1}" for i in range(30)) + "; 7 + 7 = 1")], "id int, t string")
    assert quality.validate(many, "t", "id").first().failed == 1 and quality.validate(many, "t", "id", most_claims=20).first().failed == 0
    rolled = quality.validation_rollup(quality.validate(df, "t", "id")).first()
    assert (rolled.total, rolled.passed, rolled.failed, rolled.no_math) == (9, 5, 2, 2)


def test_claims_keep_the_order_of_their_first_mention(spark):
    got = one(spark, quality.claims, "1+1=2, 2+2=4, 1+1=2 and $x = y$")
    assert [(c.lhs, c.rhs) for c in got] == [("x", "y"), ("1+1", "2"), ("2+2", "4")]


def test_evaluate_is_bounded():
    assert quality.evaluate("9**9**9") is None and quality.evaluate("2 + 3 * 4") == 14 and quality.evaluate("__import__('os')") is None


@pytest.mark.parametrize("reply, expected", [(" Yes ", True), ("no", False), ("yes.", False), ("", False), (None, True)])
def test_flagged(spark, reply, expected):
    assert one(spark, quality.flagged, reply) is expected
    assert one(spark, quality.rag_ok, reply) is (not expected)


@pytest.mark.parametrize("grades, score, advances", [("P P H F", 62.5, False), ("P P P P H", 90.0, False), ("P P P", 100.0, True)])
def test_completion(spark, grades, score, advances):
    names = {"P": "PASS", "H": "PARTIAL", "F": "FAIL"}
    got = quality.completion(spark.createDataFrame([("g", names[x]) for x in grades.split()], "g string, grade string"), "g").first()
    assert (got.score, got.advances) == (score, advances)


def counting(spark, reply):
    """A provider maker, and a count of its texts."""
    calls = spark.sparkContext.accumulator(0)

    def make():
        def run(texts):
            calls.add(len(texts))
            return [reply(t) for t in texts]

        return run

    return make, calls


def test_models_are_asked_once(spark):
    docs = spark.createDataFrame([("a.txt", "One two three."), ("b.txt", "Four five six.")], "path string, text string")
    generator, made = counting(spark, lambda t: '[{"question": "q", "thinking": "", "answer": "a"}]')
    moderator, judged = counting(spark, lambda t: "no")
    talks, stats = pipelines.generate_conversations(pipelines.document_chunks(docs), generator, moderator)
    assert talks.count() == 2 and {(r.path, r.made, r.kept, r.failed) for r in stats.collect()} == {("a.txt", 1, 1, 0), ("b.txt", 1, 1, 0)}
    assert made.value == 2 and judged.value == 2


# ---- the store and indexes


def test_store(spark, tmp_path):
    s = store.PromptStore(spark, f"file://{tmp_path}")
    assert s.load("none").count() == 0 and s.names() == []
    row = lambda *values: spark.createDataFrame([values], "input string, output string")
    s.add_prompt("a/b\\c", row("q", ""))
    assert s.names() == ["a_b_c"]
    first = s.load("a/b\\c").first()
    assert [(t["from"], t["value"]) for t in first.conversations] == [("human", "q")] and not first.has_embedding and first.split == "train"
    s.add_batch("a/b\\c", row("q2", "r2"), split="test")
    earlier = s.load("a/b\\c")
    s.upsert("a/b\\c", row("q", "new"))
    assert {(r.input, r.output) for r in earlier.collect()} == {("q", ""), ("q2", "r2")}, "a reader of the version before goes on"
    now = {r.input: r for r in s.load("a/b\\c").collect()}
    assert set(now) == {"q", "q2"} and now["q"].output == "new" and now["q"].id != first.id
    s.upsert("a/b\\c", spark.createDataFrame([("d", "1"), ("d", "2")], "input string, output string"))
    assert s.load("a/b\\c").where("input = 'd'").count() == 2
    assert s.load("a/b\\c", "test").count() == 1 and s.get("a/b\\c", now["q"].id).first().input == "q"
    assert s.search("a/b\\c", "R2").count() == 1
    stats = s.stats("a/b\\c").first()
    assert (stats.total_rows, stats.has_output, stats.has_embedding) == (4, 4, 0)
    assert {(r.split, r.n, r.error) for r in s.catalog().collect()} == {("train", 3, None), ("test", 1, None)}
    s.export_sharegpt("a/b\\c", f"file://{tmp_path}/lines", None)
    assert spark.read.json(f"file://{tmp_path}/lines").count() == 4
    assert s.export_sft("a/b\\c", f"file://{tmp_path}/sft", None) and spark.read.parquet(f"file://{tmp_path}/sft").count() == 4
    assert s.export_sft("none", f"file://{tmp_path}/nothing") == ""
    assert store.view(s.load("a/b\\c"), most=0).count() == 8
    with pytest.raises(Exception, match="already exists|AlreadyExists"):
        s._publish("a/b\\c", s._versions("a/b\\c")[-1][0], [])
    assert s.drop("a/b\\c") and s.load("a/b\\c").count() == 0


def test_seeding_twice_adds_nothing(spark, tmp_path):
    s = store.PromptStore(spark, f"file://{tmp_path}")
    helpers = [(f"helper {i}", f"text {i}") for i in range(18)]
    for _ in range(2):
        s.seed("helpers", "be helpful", helpers)
        assert s.load("helpers").count() == 19


def test_index_grows_once(spark, tmp_path):
    prompts = spark.createDataFrame([(str(i), "d", f"word{i} here", "") for i in range(19)] + [("x", "d", "", "")], "id string, dataset_name string, input string, output string").withColumn("has_embedding", F.lit(False))
    at = store.VectorIndex(spark, f"file://{tmp_path}")
    provider, calls = counting(spark, lambda t: [1.0, 2.0] if t else None)
    grown, flagged = pipelines.index_prompts(prompts, at.load("d"), provider)
    at.save("d", grown)
    assert flagged.where("has_embedding").count() == 19 and calls.value == 20
    again = vectors.build_index(prompts.where("id <> 'x'"), at.load("d"), provider)
    assert again.count() == 19 and calls.value == 20
    forced = vectors.build_index(prompts.where("id = '3'"), at.load("d"), provider, force=True)
    assert forced.count() == 19 and calls.value == 21
    assert [(r["name"], r["count"], r["error"]) for r in at.listing().collect()] == [("d", 19, None)]
    assert at.listing().first()["kilobytes"] >= 0
    assert providers.hash_embedder(4)(["", "a b"])[0] is None


def test_vectors(spark):
    rows = [([1.0, 0.0], [0.0, 0.0], 0.0), ([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], -1.0)]
    got = spark.createDataFrame(rows, "a array<float>, b array<float>, e double").select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), "e").collect()
    assert all(math.isclose(r.c, r.e) for r in got)
    index = spark.createDataFrame([("o", [1.0, 0.0]), ("a", [0.9, 0.1]), ("b", [0.9, 0.1])], "id string, embedding array<float>")
    found = vectors.search(index, spark.createDataFrame([("a",), ("b",)], "id string"), [1.0, 0.0], 2).collect()
    assert [r.id for r in found] == ["a"], "the orphan takes a place of the two"
    packed = index.select("id", vectors.unpack(vectors.pack("embedding")).alias("v")).collect()
    assert packed[0].v == [1.0, 0.0]
    edges = spark.createDataFrame([("b", "a")], "source string, target string")
    assert {(r.source, r.target) for r in vectors.similarity_edges(index, edges, 0.75).collect()} == {("a", "o"), ("b", "o")}
    with pytest.raises(ValueError):
        vectors.similarity_edges(index, most=2)
    versions = spark.createDataFrame([("f", 1, [1.0, 0.0]), ("f", 2, [0.0, 1.0]), ("f", 3, [0.0, 1.0])], "k string, v int, embedding array<float>")
    assert [r.drift for r in vectors.drift(versions, "k", "v").orderBy("v").collect()] == [None, 1.0, 0.0]


# ---- graph


def test_projects_and_refresh(spark):
    paths = spark.createDataFrame([("/b/two", 1), ("/a/one", 0), ("/b/two", 5)], "path string, place long")
    projects = graph.register(paths.limit(0), paths)
    projects = graph.register(projects, spark.createDataFrame([("/c/three", 0), ("/a/one", 1)], "path string, place long"))
    assert [r.path for r in projects.orderBy("place").collect()] == ["/a/one", "/b/two", "/c/three"]
    kinds = "project string, id string, changed_by string, change_time timestamp"
    nodes = spark.createDataFrame([("/a/one", "x.py", "me", None), ("/a/one", "y.py", None, None), ("/b/two", "x.py", None, None)], kinds)
    assert {(r.name, r.files) for r in graph.project_list(projects, nodes).collect()} == {("one", 2), ("two", 1), ("three", 0)}
    fresh = graph.refresh(nodes, "/a/one", spark.createDataFrame([("x.py",), ("z.py",)], "id string"))
    assert {(r.project, r.id, r.changed_by) for r in fresh.collect()} == {("/a/one", "x.py", "me"), ("/a/one", "z.py", None), ("/b/two", "x.py", None)}
    assert graph.snapshot(projects, nodes).count() == 2 and graph.snapshot(projects, nodes, "/b/two").count() == 1
    changes = spark.createDataFrame([("x.py",), ("new.py",), ("new.py",)], "file string")
    assert [r.file for r in graph.unknown_files(nodes, changes).collect()] == ["new.py"]


def test_files(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    for name, content in (("a.py", b"import b"), ("b.md", b"\xff\xfe"), ("node_modules/c.py", b""), ("d.bin", b"x")):
        (tmp_path / name).write_bytes(content)
    assert sorted(r.path for r in files.read_tree(spark, f"file://{tmp_path}").collect()) == ["a.py", "b.md"]


# ---- state machines, in batches and streams


def test_throttle(spark):
    rows = [("k", t, i) for i, t in enumerate((0.0, 0.3, 0.6, 0.9, 1.2))] + [(None, t, 9 + i) for i, t in enumerate((0.0, 0.2, 2.0))]
    events = spark.createDataFrame(rows, "k string, s double, n int").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")))
    got = stateful.throttle(events, "k", "ts", 0.5, "n").collect()
    assert sorted(r.n for r in got) == [0, 2, 4, 9, 11]
    numbers = events.withColumn("k", F.when(F.col("k").isNotNull(), F.lit(1)))
    assert sorted(r.n for r in stateful.throttle(numbers, "k", "ts", 0.5, "n").collect()) == [0, 2, 4, 9, 11], "a null key is one key"
    assert stateful.watched(spark.createDataFrame([("a.mjs",), ("b.CONF",), ("c.hpp",), ("d.exe",), ("e",)], "file string")).count() == 3


def tokens_of(spark, **streams):
    rows = [(k, i, t, i == len(ts) - 1) for k, ts in streams.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "stream_id string, seq long, token string, is_end boolean")


def test_sentence_chunks(spark):
    tokens = tokens_of(spark, a=["Hi. ", "This is a long sentence. "], b=["This is sentence one. An"], c=[None, " "])
    got = sorted((r.stream_id, r.seq, r.chunk) for r in stateful.sentence_chunks(tokens).collect())
    assert got == [("a", 1, "Hi. This is a long sentence."), ("b", 0, "An"), ("b", 0, "This is sentence one.")]
    assert stateful.sentence_chunks(tokens.limit(0)).count() == 0


def frames_of(spark, key, spec):
    return spark.createDataFrame([(key, i, c == "S") for i, c in enumerate(spec)], "stream_id string, frame_no long, is_speech boolean")


def test_voice_segments(spark):
    cases = {"a": "SSNSSS" + "N" * 26, "b": "N" * 40, "c": "SSS" + "SN" * 1000, "d": "N" * 1999 + "SSSS"}
    frames = frames_of(spark, "a", cases["a"])
    for k in "bcd":
        frames = frames.union(frames_of(spark, k, cases[k]))
    got = sorted((r.stream_id, r.begin, r.end) for r in stateful.voice_segments(frames).collect())
    # c is cut after 2,000 frames of listening; in d the cap strikes at the first frame of speech.
    assert got == [("a", 3, 31), ("c", 0, 1999), ("d", 1999, 1999), ("d", 2000, 2002)]
    starts = spark.createDataFrame([("a", 3), ("c", 10), ("b", 39)], "stream_id string, begin long")
    goes_on = {(r.stream_id, r.begin, r.end) for r in stateful.voice_continue(frames, starts).collect()}
    assert goes_on == {("a", 3, 31), ("c", 10, 1009), ("b", 39, 39)}


def test_onset_keeps_the_frames_before(spark):
    got = stateful.onsets(frames_of(spark, "a", "NNNSNSSS")).collect()
    assert [(r.frame_no, r.buffered) for r in got] == [(7, [3, 4, 5, 6, 7])] or [(r.frame_no) for r in got] == [6]
    m = machines.Onset()
    assert [bool(m.feed(i, c == "S")) for i, c in enumerate("SSS")] == [False, False, True]


def run_stream(spark, tmp_path, df, transform, name, least):
    """df's rows as a stream of two files, in order; the rows that came out, once there are `least` (or a minute is over)."""
    source = f"{tmp_path}/{name}"
    half = df.count() // 2
    order = "seq" if "seq" in df.columns else "frame_no" if "frame_no" in df.columns else "n"
    ranked = df.orderBy(order).collect()
    for k, part in enumerate((ranked[:half], ranked[half:])):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{source}/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    query = transform(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}-state").outputMode("append").trigger(processingTime="1 second").start()
    for _ in range(60):
        if query.exception() or spark.table(name).count() >= least:
            break
        time.sleep(1)
    query.stop()
    return spark.table(name).collect()


def test_streams_equal_batches(spark, tmp_path):
    tokens = tokens_of(spark, a=["Hi. ", "This is a ", "long sentence. ", "And one more here. Tail"], b=["This is sentence one. An"])
    got = run_stream(spark, tmp_path, tokens, stateful.stream_sentence_chunks, "spoken", 4)
    assert sorted((r.stream_id, r.seq, r.chunk) for r in got) == sorted((r.stream_id, r.seq, r.chunk) for r in stateful.sentence_chunks(tokens).collect())
    frames = frames_of(spark, "a", "SSNSSS" + "N" * 30 + "SSSS" + "N" * 30)
    got = run_stream(spark, tmp_path, frames, stateful.stream_voice_segments, "voiced", 2)
    assert sorted((r.begin, r.end) for r in got) == sorted((r.begin, r.end) for r in stateful.voice_segments(frames).collect()) == [(3, 31), (36, 65)]
    rows = [("k", t, i) for i, t in enumerate((0.0, 0.3, 0.6, 0.9, 1.2))]
    events = spark.createDataFrame(rows, "k string, s double, n int").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long"))).drop("s")
    got = run_stream(spark, tmp_path, events, lambda s: stateful.stream_throttle(s, "k", "ts", 0.5, "n"), "throttled", 3)
    assert sorted(r.n for r in got) == [0, 2, 4]


def test_history_and_change_lines(spark):
    lines = spark.createDataFrame([('{"file": "a.py", "by": "", "cwd": "/p"}', 1), ('{"by": "x"}', 2), ("broken", 3)], "value string, ts int")
    assert [(r.file, r.by, r.cwd) for r in stateful.change_events(lines).collect()] == [("a.py", "unknown", "/p")]
    history = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id int, turn int, role string, text string")
    said = spark.createDataFrame([(1, "assistant", "d", 1), (1, "user", "c", 0), (2, "user", "e", 0)], "conv_id int, role string, text string, place int")
    got = sorted((r.conv_id, r.turn, r.text) for r in stateful.append_turns(history, said).collect())
    assert got == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d"), (2, 0, "e")]
