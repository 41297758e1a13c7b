"""Operators against brute force, round trips and small cases."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import runtime
from millrace.functions import detect as D
from millrace.functions import quality as Q
from millrace.operators import chat as H
from millrace.operators import chunks as C
from millrace.operators import evaluation as E
from millrace.operators import neardup as N
from millrace.operators import repo as G
from millrace.operators import tokens as K
from millrace.operators.corpus import as_of, index_percentile
from millrace.operators.rank import ranked, ranked_within
from millrace.operators.retrieval import token_chunks, within_budget
from millrace.operators.sequences import first_fit_decreasing, pack_first_fit
from millrace.sources import files, manifest, shards
from millrace.streaming import jobs


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, text string")
    return [r[0] for r in df.orderBy("id").select(f(F.col("text"))).collect()]


# --- ranks ------------------------------------------------------------------------------------------------------------


def test_ranks_and_running_sums(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), int(v), "ab"[int(k) % 3 == 0]) for k, v in zip(rng.permutation(500), rng.integers(0, 9, 500))]
    df = spark.createDataFrame(rows, "k long, v long, g string")
    got = {r.k: (r["rank"], r.s) for r in ranked(df, ["k"], sums={"s": "v"}).collect()}
    total = 0
    for i, (k, v, _) in enumerate(sorted(rows)):
        assert got[k] == (i, total)
        total += v
    own = {r.k: r["rank"] for r in ranked_within(df, "g", [F.desc("k")]).collect()}
    for g in "ab":
        for i, k in enumerate(sorted((k for k, _, x in rows if x == g), reverse=True)):
            assert own[k] == i
    assert ranked(df.limit(0), ["k"]).count() == 0


def test_as_of_and_percentiles_over_ranges(spark):
    left = spark.createDataFrame([(i,) for i in range(100)], "at int")
    right = spark.createDataFrame([(i, i * 10) for i in range(5, 100, 17)], "since int, v int")
    got = {r["at"]: r.v for r in as_of(left, right, "at", "since", "v").collect()}
    assert got == {i: max((j * 10 for j in range(5, 100, 17) if j <= i), default=None) for i in range(100)}
    values = sorted([3] * 40 + list(range(60)))
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "n long")
    r = index_percentile(df, "n", [0.25, 0.5, 0.99]).first()
    assert (r.least, r.p25, r.p50, r.p99, r.most) == (values[0], values[25], values[50], values[99], values[-1])


def test_budget_and_token_chunks(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], 3) for i in range(20)], "id long, g string, n long")
    assert {r.id for r in within_budget(df, "g", ["id"], "n", 10).collect()} == {0, 1, 2, 3, 4, 5}
    for n in (0, 1, 7, 8, 20, 23, 24, 41):
        toks = [str(i) for i in range(n)]
        want = []
        for i in range(0, n, 8):
            part = toks[i : i + 10]
            if len(part) < 2 and want:
                want[-1] = want[-1] + part
            elif len(part) >= 2 or i == 0:
                want.append(part)
        x = spark.createDataFrame([(1, toks)], "id int, w array<string>")
        got = [list(r.w) for r in token_chunks(x, ["id"], "w", 10, 8, 8).orderBy("chunk").collect()]
        joined = [w for w in got]
        assert sorted({int(t) for w in joined for t in w}) == list(range(n)) and len(got) == max(1, len(want))


# --- packing ----------------------------------------------------------------------------------------------------------


def test_first_fit_is_exact_on_the_histogram(spark):
    rng = np.random.default_rng(7)
    for _ in range(40):
        sizes = rng.integers(1, 60, int(rng.integers(1, 120))).tolist()
        room, want = [], []
        for need in sorted(sizes, reverse=True):
            at = next((i for i, r in enumerate(room) if r >= need), None)
            if at is None:
                at = len(room)
                room.append(max(50, need))
            room[at] -= need
            want.append((need, at))
        hist = {int(k): int(v) for k, v in zip(*np.unique(sizes, return_counts=True))}
        got = []
        for need, places in first_fit_decreasing(hist, 50).items():
            starts = [p[0] for p in places]
            for r in range(hist[need]):
                rank0, pack0, each = places[np.searchsorted(starts, r, side="right") - 1]
                got.append((need, pack0 + (r - rank0) // each))
        assert sorted(got) == sorted(want)
    df = spark.createDataFrame([(i, 9) for i in range(25)] + [(99, 0)], "id long, n long")
    packs = pack_first_fit(df, "id", "n", 30).toPandas()
    assert packs.groupby("pack").size().tolist() == [3] * 8 + [2] and len(packs) == 26


# --- tokens -----------------------------------------------------------------------------------------------------------


def test_tokens_round_trip(spark):
    texts = ["def f(x):\n    return x", "naïve café 漢字 \U0001f600", "", None, "  two  spaces\t\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    x = K.encode(df, bos=True, eos=True)
    rows = {r.doc_id: r.tokens for r in x.collect()}
    ids = K.specials()
    assert rows[3] is None and rows[2] == [ids["<|startoftext|>"], ids["<|endoftext|>"]]
    assert {r.doc_id: r.text for r in K.decode(x).collect()} == dict(enumerate(texts))
    assert ["".join(p) for p in one(spark, K.pieces, *texts[:2])] == texts[:2]
    a = K.alphabet()
    assert len(set(a.values())) == 256 and a[65] == "A" and a[32] == "Ġ"


def test_blocks_and_slices(spark):
    rng = np.random.default_rng(1)
    docs = [[int(x) for x in rng.integers(0, 99, int(n))] for n in rng.integers(0, 40, 30)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, tokens array<int>")
    stream = [t for d in docs for t in [*d, -1]]
    got = [list(r.tokens) for r in K.blocks(df, "doc_id", 16, -1).orderBy("block").collect()]
    assert got == [stream[i : i + 16] for i in range(0, len(stream) // 16 * 16, 16)]
    short = K.blocks(df.where("doc_id = 0").select("doc_id", F.expr("array(1, 2)").alias("tokens")), "doc_id", 8, -1).first()
    assert list(short.tokens) == [1, 2, -1, 0, 0, 0, 0, 0]
    for toks in (list(range(10)), list(range(8)), []):
        x = spark.createDataFrame([(toks,)], "tokens array<int>").select(K.document_slices(F.col("tokens"), 4, -1).alias("s")).first().s
        want = [toks[i : i + 4] for i in range(0, max(1, len(toks)), 4)]
        if len(want[-1]) < 4:
            want[-1] = [*want[-1], -1]
        assert [list(y) for y in x] == want


def test_pruning_keeps_bytes_and_unseen(spark):
    v = spark.createDataFrame([(0, "a", "byte"), (1, "ab", "merged"), (2, "abc", "merged"), (3, "<s>", "special"), (4, "x", "merged")], "id int, token string, kind string")
    u = spark.createDataFrame([(0, 1), (1, 2), (2, 9)], "id int, n long")
    assert {r.id: r.new_id for r in K.prune(v, u, 5).collect()} == {0: 0, 2: 1, 3: 2, 4: 3}


# --- duplicates -------------------------------------------------------------------------------------------------------


def test_minhash_recall_against_jaccard(spark):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(40)]
    texts += [t + " and more" for t in texts[:20]] + [texts[0], None, "", "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sh = {i: N.char_shingles(t) for i, t in enumerate(texts[:60])}
    want = {(i, j) for i, j in itertools.combinations(sh, 2) if len(sh[i] & sh[j]) / len(sh[i] | sh[j]) >= 0.9}
    got = {(r.a, r.b) for r in N.lsh_pairs(N.signatures(df, "id", "text"), "id").collect()}
    assert len(want & got) >= 0.9 * len(want) > 0
    kinds = {r.id: r.method for r in N.minhash_dedup(df, "id", "text").collect()}
    assert kinds[60] == "exact" and kinds[61] == kinds[62] == kinds[63] == "unique"
    assert sum(kinds[i] == "near" for i in range(40, 60)) >= 18 and all(kinds[i] == "unique" for i in range(40))


def test_substrings_against_brute_force(spark):
    rng = np.random.default_rng(6)
    long = ["".join(rng.choice(list("abcdefgh "), 300)) for _ in range(12)]
    texts = long + [long[0][50:120], long[3][10:40], long[3][10:30], "ab", "b", long[5][:149], long[5][:151], long[0], None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    first = {}
    for i, t in enumerate(texts):
        if t:
            first.setdefault(t, i)
    want = {(i, j) for (a, i), (b, j) in itertools.permutations(first.items(), 2) if a in b and len(a) < 0.5 * len(b)}
    assert {(r.a, r.b) for r in N.substring_pairs(df, "id", "text").collect()} == want
    kept = []
    for t, i in sorted(first.items(), key=lambda x: (-len(x[0]), x[1])):
        if not any(t in u and len(t) < 0.5 * len(u) for u in kept):
            kept.append(t)
    got = {r.id for r in N.substring_survivors(df, "id", "text").collect()}
    assert {first[t] for t in kept} <= got and not {first[t] for t in first if t not in kept} & got


def test_signer_equals_signature_of_shingles():
    a, b = N.coefficients(128)
    sign = N.Signer(a, b)
    for text in ["", "ab", "abcdef", "aaaaaaaaaaaa", "caf\u00e9 \u4e2d\u6587 \U0001f600 and plain text " * 40, "\x00" * 9]:
        assert (sign(text) == N.signature(N.char_shingles(text), a, b)).all()
    rest = np.arange(20, dtype=np.int64) * 7919 % N.PRIME  # the least and largest values too
    edge = N.Signer(np.array([1, N.PRIME - 1]), np.array([0, N.PRIME - 1]))
    edge.hashes = lambda text: np.append(rest, N.PRIME - 1).astype(np.uint64)
    assert edge("abcdefg").tolist() == [min((x * h + y) % N.PRIME for h in [*rest.tolist(), N.PRIME - 1]) for x, y in ((1, 0), (N.PRIME - 1, N.PRIME - 1))]


def test_substring_pairs_write_no_texts_but_those_of_candidates(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 26, 3000)) for _ in range(60)]
    texts += [texts[5][700:1900], texts[7]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    before = len(runtime._WRITTEN)
    assert [(r.a, r.b) for r in N.substring_pairs(df, "id", "text").collect()] == [(60, 5)]
    fs = spark._jvm.org.apache.hadoop.fs
    wrote = sum(fs.Path(x).getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(fs.Path(x)).getLength() for x in runtime._WRITTEN[before:])
    assert wrote < sum(map(len, texts)) / 2


def test_substring_pairs_write_no_texts_that_occur_again(spark):
    rng = np.random.default_rng(8)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 26, 3000)) for _ in range(60)]
    texts.append(texts[5][700:1900])
    df = spark.createDataFrame([(i + 100 * j, t) for i, t in enumerate(texts) for j in (2, 1, 3)], "id long, text string")
    before = len(runtime._WRITTEN)
    assert [(r.a, r.b) for r in N.substring_pairs(df, "id", "text").collect()] == [(160, 105)]
    fs = spark._jvm.org.apache.hadoop.fs
    wrote = sum(fs.Path(x).getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(fs.Path(x)).getLength() for x in runtime._WRITTEN[before:])
    assert wrote < sum(map(len, texts)) / 2


def test_different_texts_have_their_least_keys(spark):
    rows = [(7, "a"), (3, "a"), (3, "a"), (5, "b"), (4, "b"), (None, "b"), (3, "c"), (9, "d"), (3, "b b"), (9, "b b"), (1, ""), (2, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    assert sorted((r.k, r.t) for r in N.different_texts(df, "id", "text").collect()) == [(3, "a"), (3, "b b"), (3, "c"), (4, "b"), (9, "d")]


def test_substring_pairs_are_the_same_where_texts_are_shuffled(spark, monkeypatch):
    df = spark.createDataFrame([(i, ("x%dy" % i) * 20 + "notice") for i in range(40)] + [(90, "notice"), (91, "notice"), (92, "x7y" * 5)], "id long, text string")
    want = {(90, i) for i in range(40)} | {(92, 7)}
    for few, chars in ((N.FEW, N.CHARS), (N.FEW, 3), (0, N.CHARS), (0, 3)):
        monkeypatch.setattr(N, "FEW", few)
        monkeypatch.setattr(N, "CHARS", chars)
        got = N.substring_pairs(df, "id", "text").collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


# --- files ------------------------------------------------------------------------------------------------------------


def test_shards_round_trip_and_checks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}", "x") for i in range(25)], "id long, text string, __source string")
    got = shards.write_shards(df, f"file://{tmp_path}", "docs", ["id"], 10).orderBy("shard").collect()
    assert [(r.shard, r.records) for r in got] == [(0, 10), (1, 10), (2, 5)]
    (tmp_path / "docs_shard_x.jsonl").write_text("{}")
    known = shards.discover(spark, f"file://{tmp_path}")
    assert [i for i, _ in known] == [0, 1, 2] and shards.is_continuous([0, 1, 2]) and not shards.is_continuous([0, 2])
    back = shards.read_shards(spark, f"file://{tmp_path}", "id long, text string, __source string")
    assert {r.id: (r.shard, r["__source"]) for r in back.collect()} == {i: (i // 10, None) for i in range(25)}
    for i, line in enumerate(["not json", '{"id": 1}', "", "[1]"]):
        with open(tmp_path / "bad_shard_00000.jsonl", "a" if i else "w") as f:
            f.write(line + "\n")
    assert [r.id for r in shards.read_shards(spark, f"file://{tmp_path}", "id long", "bad").where("id is not null").collect()] == [1]
    finding = {(r.line_no, r.finding, r.severity) for r in shards.validate_jsonl(shards.read_lines(spark, f"file://{tmp_path}", "bad"), ["id"], 0).collect()}
    assert finding == {(0, "bad_json", "error"), (2, "blank", "warning"), (3, "not_object", "error")}
    assert [(r.finding, r.severity) for r in shards.validate_jsonl(spark.createDataFrame([], "shard int, line_no long, line string")).collect()] == [("empty", "error")]


def test_corpora_of_files(spark, tmp_path):
    (tmp_path / "src" / "deep").mkdir(parents=True)
    (tmp_path / "src" / "a.txt").write_text("whole\nfile")
    (tmp_path / "src" / "deep" / "b.md").write_text("# head")
    (tmp_path / "src" / "blank.py").write_text("  \n")
    (tmp_path / "src" / "c.jsonl").write_text('{"text": "one"}\n"two"\nthree: raw\n{"code": "four"}\n{"other": 1}\n')
    (tmp_path / "src" / "deep" / "x.bin").write_bytes(b"\xff\xfe\x00")
    at = f"file://{tmp_path}/src"
    assert sorted(r.text for r in files.text_corpus(spark, at).collect()) == ["# head", "four", "one", "three: raw", "two", "whole\nfile"]
    assert [r.path.split("/")[-1] for r in files.code_files(spark, at, [".md"]).collect()] == ["b.md"]
    assert {r.path for r in files.repo_documents(spark, at, exclude=["deep"]).collect()} == {"a.txt", "blank.py", "c.jsonl"}
    assert {r.path for r in files.repo_documents(spark, at, include=["deep"]).collect()} == {"deep/b.md"}
    assert sorted(r.text for r in files.training_texts(spark, f"{at}/c.jsonl").collect()) == ["one"]


def test_raw_records_of_all_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "x": "a"},\n {"id": 2, "x": "b"}]')
    (tmp_path / "b.jsonl").write_text('{"id": 3}\n{"id": 4, "y": true}\n')
    (tmp_path / "c.json").write_text('{"id": 5}\n{"id": 6}\n')
    spark.createDataFrame([(7,)], "id long").write.parquet(f"{tmp_path}/d.parquet")
    assert sorted(r.id for r in files.raw_records(spark, str(tmp_path)).collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_manifests_and_reports(spark):
    m = {"name": "a", "version": "1", "stage": "cleaned", "stages": {"raw": {}, "processed": {}}, "processing_steps": [{"output_hash": "x"}, {"input_hash": "y"}]}
    assert manifest.chain_breaks(m) == ["processed without cleaned", "step 1 doesn't follow"]
    h = manifest.manifest_hash(m)
    assert not manifest.stale(m, h) and manifest.stale({**m, "version": "2"}, h)
    rows = [{"a": 1, "b": "x|<y>"}]
    assert json.loads(manifest.render(rows, "json"))["rows"] == rows
    assert "x\\|<y>" in manifest.render(rows, "markdown") and "&lt;y&gt;" in manifest.render(rows, "html")


def test_local_folder_only_for_local_masters():
    class Fake:
        class conf:
            get = staticmethod(lambda k, d=None: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        runtime.shared_dir(Fake)


# --- language, chat, chunks, repositories, evaluation -----------------------------------------------------------------


def test_language_of_files(spark):
    df = spark.createDataFrame([("a/b.PY", "x"), ("run", "#!/usr/bin/env node\nx"), ("x", "import os\nfrom a import b\ndef f(x):\n    return 1\nclass A:\n    pass\n" * 2), ("y", "the cat and the dog are here with the others that you have not been told of before, and more of this"), ("z", "")], "p string, t string")
    got = [(r.c.language, r.c.method) for r in df.select("p", "t", D.by_content(F.col("t")).alias("c"), D.by_letters(F.lower("t")).alias("l")).select(D.cascade(*map(F.col, "ptcl")).alias("c")).collect()]
    assert got[:3] == [("python", "extension"), ("javascript", "shebang"), ("python", "content")] and got[3][1] == "ngram" and got[4] == ("unknown", "none")


def test_chat_formats(spark):
    rec = [
        {"instruction": "a", "input": "b", "output": "c"}, {"message_id": "1", "role": "assistant", "content": "x"}, {"message_id": "1", "role": "user", "content": "x"},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}, {"dialogs": [{"role": "user", "content": "q"}]}, {"prompt": "p", "response": "r"}, {"x": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rec)], "i int, r string").select("i", "r", H.detect_format(F.col("r")).alias("f"))
    got = [(r.f, None if r.t is None else [(m.role, m.content) for m in r.t]) for r in df.select("i", "f", H.convert(F.col("r"), F.col("f")).alias("t")).orderBy("i").collect()]
    assert got == [
        ("alpaca", [("user", "a\n\nInput: b"), ("assistant", "c")]), ("openassistant", [("assistant", "x")]), ("openassistant", None), ("sharegpt", [("user", "q"), ("assistant", "r")]),
        ("ultrachat", None), ("standard", [("user", "p"), ("assistant", "r")]), ("unknown", None),
    ]


def test_turns(spark):
    turns = [("system", "s")] + [(("user", "assistant")[i % 2], f"m{i}") for i in range(12)]
    df = spark.createDataFrame([(turns,), ([],)], "t " + H.TURNS)
    c = F.col("t")
    r = df.select(H.recent(c).alias("r"), H.first_pair(c).alias("f"), H.adjacent_pairs(c).alias("a"), H.last_of(c, "user").alias("u"), H.verdict(c).alias("v")).collect()
    assert [m.content for m in r[0].r] == ["s", *(f"m{i}" for i in range(2, 12))] and (r[0].f.prompt, r[0].f.response) == ("m0", "m1")
    assert r[0].u == "m10" and r[0].v == "valid" and r[1].v == "empty" and r[1].f is None and list(r[1].a) == []


def test_chunkers():
    text = "One two three. Four five six! Seven eight nine? Ten."
    got = C.sentence_chunks(text, 30, 5)
    assert got[0][2] == "One two three. Four five six!" and got[1][2].startswith(" six! Seven")
    for t in (text * 20, "x" * 1200, "a. " * 400, "short"):
        pieces = C.window_chunks(t, 200, 50, 20)
        assert all(len(p) <= 200 for _, _, p in pieces) and all(a < b for (_, a, _), (_, b, _) in itertools.pairwise(pieces))
    assert [(s[1], s[2]) for s in C.sections("intro\n# A\nx\n```\n# no\n```\n## B\n")] == [(0, ""), (1, "A"), (2, "B")]
    assert [s[:2] for s in C.symbols("class A:\n    def f(self):\n        pass\nasync def g(): pass\n")] == [("class", "A"), ("function", "f"), ("function", "g")]
    assert C.symbols("def (") == [] and ("f", 1, "call") in C.usages("f(x)")


def test_repository_graph(spark):
    f = spark.createDataFrame([("r", p) for p in ("a.py", "b.py", "c.py", "d.py", "e/f.py")], "repo string, path string")
    found = spark.createDataFrame([("r", "a.py", 0, "b"), ("r", "b.py", 0, "pkg.c"), ("r", "c.py", 0, "none"), ("r", "d.py", 0, "e.f"), ("r", "e/f.py", 0, "d")], "repo string, path string, place int, module string")
    e = G.resolve(f, found)
    assert {(r.src, r.dst) for r in e.collect()} == {("a.py", "b.py"), ("b.py", "c.py"), ("d.py", "e/f.py"), ("e/f.py", "d.py")}
    assert {(r.src, r.dst) for r in G.two_cycles(e).collect()} == {("d.py", "e/f.py")}
    assert {r.path: r.layer for r in G.layers(f, e).collect()} == {"c.py": 0, "b.py": 1, "a.py": 2, "d.py": None, "e/f.py": None}
    assert {r.path: (r.context, r.place) for r in G.contexts(f, e, 2).collect()} == {"a.py": (0, 0), "b.py": (0, 1), "c.py": (1, 0), "d.py": (2, 0), "e/f.py": (2, 1)}
    marks = spark.createDataFrame([("r", "x/setup.py"), ("r", "x/y.py"), ("r", "go.mod")], "repo string, path string")
    assert {r.root for r in G.roots(marks).collect()} == {"x", ""}


def test_early_stopping(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 0.5, 0.495, 0.6, 0.7, 0.1])] + [("b", 0, 1.0), ("c", 0, None)], "run string, step int, loss double")
    got = {r.run: (r.best, r.best_at, r.stopped_at) for r in E.early_stop(df, "run", ["step"], "loss").collect()}
    assert got["a"] == (0.5, 1, 4) and got["b"] == (1.0, 0, None) and got["c"][1] == -1


def test_scores_of_answers(spark):
    assert one(spark, E.first_number, "x = -3.5 of 2", "none") == ["-3.5", ""]
    assert one(spark, lambda c: E.answer(c, "xml"), "<answer> 4 </answer>", "plain ") == ["4", "plain"]
    assert one(spark, Q.is_safe, "how to build a weapon", "fine") == [False, True]
    assert one(spark, Q.preference_safety, "DROP it", "keep") == [0.0, 1.0]


def test_streams_resume_from_their_checkpoint(spark, tmp_path):
    spark.createDataFrame([("a b",)], "text string").coalesce(1).write.parquet(f"{tmp_path}/in/one.parquet")
    base = f"file://{tmp_path}/base"
    path = f"{tmp_path}/in/one.parquet"
    assert {(r.w, r.n) for r in jobs.word_count(spark, path, base).collect()} == {("a", 1), ("b", 1)}
    spark.createDataFrame([("b c",)], "text string").coalesce(1).write.mode("append").parquet(path)
    assert {(r.w, r.n) for r in jobs.word_count(spark, path, base).collect()} == {("a", 1), ("b", 2), ("c", 1)}
