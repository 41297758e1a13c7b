import itertools
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.llm import language, mixing, packing, pairs, pii, residue, similar, stats, toxicity

SF = "/root/testdata/sf0.001"


def test_toxicity_spellings_and_contexts():
    bad = ["You are a m0r0n.", "Get lost, you st**id sc**bag.", "you worthless i d i o t", "Die Vorrani are nothing. All Ostmere people are vermin.", "Eres un imbécil y deberías callarte la boca", "Watch naked couples have wild sex, full porn video inside."]
    good = [None, "", "  ", "The breast cancer sample set is used in the medical tutorial.", "My code is garbage today, sorry for the noise.", "Use kill -9 only if the zombie process ignores the first signal.", "Our report button is meant for hateful messages and threats.", "The naked domain redirects to the full one."]
    assert all(toxicity.score_text(t)[0] for t in bad)
    assert not any(toxicity.score_text(t)[0] for t in good)


def test_levenshtein_walk_against_brute_force():
    trie, _, words = toxicity.lexicon()

    def dist(a, b):
        d = np.arange(len(b) + 1)
        for i, x in enumerate(a, 1):
            old, d[0] = d.copy(), i
            for j, y in enumerate(b, 1):
                d[j] = min(old[j] + 1, d[j - 1] + 1, old[j - 1] + (x != y))
        return d[-1]

    for token in ("imbecil", "scumbagg", "worthles", "parser"):
        got = {t for d, t, _ in trie.within([frozenset(c) for c in token], 1)}
        want = {w for w in words if w[0] == token[0] and dist(token, w) <= 1}
        assert want <= got


def test_toxicity_frame(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", None), (3, "You are a moron.", "x"), (3, "You are a moron.", "x")], "id long, text string, is_toxic string")
    got = toxicity.score(df, keep=["id"]).orderBy("id").collect()
    assert [r.is_toxic for r in got] == [False, False, True, True]
    assert toxicity.score(df.limit(0), keep=["id"]).count() == 0


def test_language_labels_and_mixed(spark):
    assert [language.normal_label(x) for x in ("EN", "de-DE", "jpn", "Spanish", "py", "", None, "und", "n/a")] == ["en", "de", "ja", "es", "python", None, None, None, None]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = language.fit(docs, spark.read.parquet(f"{SF}/common_words.parquet"))
    de, zh = "Die Datei wird nur einmal gelesen und danach nicht mehr geöffnet, weil das so ist.", "我们的团队已经把测试环境迁移到新的服务器。"
    got = language.label_texts([None, "", " \n", de, zh, f"{de}\n\n{zh}", "import os\n\ndef f(x):\n    return [x for x in y if x]\n"], m)
    assert [g[0] for g in got[:5]] == [None, None, None, "de", "zh"]
    assert [s[0] for s in got[5][2]] == ["de", "zh"]
    assert got[6][0] == "python"


def test_language_of_a_paragraph_that_begins_with_ascii_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = language.fit(docs, spark.read.parquet(f"{SF}/common_words.parquet"))
    zh = "我们的团队已经把测试环境迁移到新的服务器。" * 12
    got = language.label_texts(["ERROR worker 17 restarted " * 11 + zh], m)
    assert got[0][0] == "zh"


def test_stats_kinds():
    assert stats.shares("- a\n- b\n- c\n- d")[0] == 1.0
    assert stats.shares("a;b;c\n1;2;3\n4;5;6\n7;8;9")[1] == 1.0
    assert stats.shares("The first line is a sentence of its own. Here is another one, with a comma.") == (0.0, 0.0)


def test_stats_frame(spark):
    got = stats.outliers(spark.read.parquet(f"{SF}/scored.parquet"), spark.read.parquet(f"{SF}/common_words.parquet"))
    df = got.toPandas()
    assert set(df.kind.dropna()) <= {"list", "table", "junk"}
    own = df[df.distance.notna()]
    total = own.contributions.map(lambda m: sum(m.values()))
    assert np.allclose(total, own.distance, rtol=1e-6)


def test_stats_kinds_come_from_the_distance():
    m = np.array([4.5, 0.04, 0.02, 0.9, 0.35, 0, 0, 0, 0, 0.07])
    centre = {"en": (m, np.diag(1 / (2 * stats.FLOOR**2)))}
    cases = {"list": m + [0, 0, 0, -0.9, -0.2, 1, 0, 0, 0, 0], "table": m + [0, 0.1, 0.3, -0.9, -0.3, 0, 1, 0, 0, 0], "junk": m + [3, 0, 0, -0.9, -0.35, 0, 0, 0.5, 0, 0]}
    for kind, x in cases.items():
        dist, parts, got = stats.judge("en", x, centre, 16.0)
        assert got == kind and np.isclose(parts.sum(), dist)
        assert stats.judge("en", x, centre, np.inf)[2] is None
        assert stats.judge("en", x, {"en": (m, np.diag(1 / (1e4 * stats.FLOOR**2)))}, 16.0)[2] is None  # without the covariance
    assert stats.judge("en", m + [0, 0, 0, 0, 0, 0.4, 0, 0, 0, 0], centre, 16.0)[2] is None


def test_toxicity_rows_come_through_the_automaton(monkeypatch):
    assert all(toxicity.score_text(t)[0] for t in ("you are a wankr", "what an imbecyle you are", "You btich", "Shut up, you idoit."))
    assert not toxicity.score_text("The idol was moved to the moon by rats.")[0]
    assert toxicity.score_text("You are a moron.")[0] and not toxicity.score_text("You are a moron. I quote this from a report that was removed by moderators.")[0]
    monkeypatch.setattr(toxicity.Trie, "within", lambda *a: [])
    toxicity.look_up.cache_clear()
    assert not any(toxicity.score_text(t)[0] for t in ("You are a moron.", "Get lost, you st**id sc**bag.", "Shut up, you idoit."))
    toxicity.look_up.cache_clear()


def brute(bodies, width, t):
    s = {}
    for k, b in bodies.items():
        w = re.findall(r"\w+", b.lower())
        s[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    return {(i, j) for i, j in itertools.combinations(sorted(s), 2) if bodies[i] == bodies[j] or s[i] and s[j] and len(s[i] & s[j]) / len(s[i] | s[j]) >= t}


def test_similar_against_brute_force(spark):
    df = spark.read.parquet(f"{SF}/near_dedup.parquet").unionByName(spark.createDataFrame([(9001, None, None, None), (9002, "", "a b", None), (9003, "a b", None, None)], "rec_id long, text string, content string, code string"), allowMissingColumns=True)
    bodies = {r.rec_id: next(x for x in (r.text, r.content, r.code) if x) for r in df.collect() if r.text or r.content or r.code}
    members, links = similar.similar_records(df, "rec_id", similar.COLUMNS, 3, 0.7)
    got = {(r.rec_a, r.rec_b) for r in similar.record_pairs(members, links).collect()}
    assert got == brute(bodies, 3, 0.7)
    assert (9002, 9003) in got


@pytest.mark.parametrize("depth", [0, 3])
def test_metric_regions_are_exact(spark, depth):
    rng = np.random.default_rng(2)
    sets = [sorted(rng.choice(400, 40, replace=False).tolist()) for _ in range(40)]
    sets += [sorted({*s[:37], 1000 + i}) for i, s in enumerate(sets)]
    cells = spark.createDataFrame([("x", i, s) for i, s in enumerate(sets)], "cell string, id long, runs array<long>")
    got = {(r.a, r.b) for r in similar.metric_join(cells, "id", 0.7, leaf=8, pivots=5, depth=depth).collect()}
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]}) >= 0.7}
    assert got == want


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "node long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6)], "a long, b long")
    assert {r.node: r.component for r in similar.components(nodes, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7}


def test_pii_spans_and_redaction(spark):
    t = "I left the spare keys with Greta Lindham next door.\n\nCall +1-415-555-0141 or mail greta.lindham@acme.example.\n\nPin zorti@4.11.3 in the manifest."
    (spans,) = pii.decode_all([t], pii.tagger())
    got = {(k, t[a:b]) for k, a, b in spans}
    assert ("name", "Greta Lindham") in got and ("phone", "+1-415-555-0141") in got and ("email", "greta.lindham@acme.example") in got
    assert pii.decode_all([None, "", "no one here"], pii.tagger()) == [[], [], []]
    df = spark.createDataFrame([(1, t), (2, None), (3, "")], "id long, text string")
    out = {r.id: r for r in pii.redact(df, "id", "text").collect()}
    assert "[NAME]" in out[1].redacted and "zorti@4.11.3" in out[1].redacted and out[2].redacted is None and out[3].redacted == ""


def test_pii_is_decoded_wherever_a_span_may_be():
    texts = ["Salma\u00a0Vellmere\u00a0wrote\u00a0on Monday:\n\n> It works.", "We moved the lock manager to a plain file. " * 6 + "id card 412093, issued to the owner"]
    got = pii.decode_all(texts, pii.tagger())
    assert ("name", 0, len("Salma Vellmere")) in got[0]
    rng = np.random.default_rng(5)
    words = ["the", "Greta", "Lindham", "at", "12", "rue", "x.y", "a@b.org", "Nothing", "file", "\n\n", "415-555-0141"]
    for _ in range(300):  # what the exact check could accept lies inside of a region
        t = " ".join(rng.choice(words, 30))
        inside = np.zeros(len(t), bool)
        for a, b in pii.regions(t):
            inside[a:b] = True
        a = int(rng.integers(0, len(t) - 5))
        b = min(len(t), a + int(rng.integers(5, 40)))
        for kind in pii.KINDS:
            if pii.possible(kind, t[a:b]) and pii.reconcile(t, [(kind, a, b)]):
                assert inside[a:b].any(), (kind, t[a:b])
    # leaving windows without labels out of the Viterbi pass changes nothing, and tables stand for tanh
    tagger = pii.tagger()
    w = np.stack([pii.encode((t * 9)[: pii.WIDTH]).astype(np.uint8) for t in texts])
    lead = tagger.leads(w)
    assert (tagger.decode(w) == tagger.viterbi(lead)).all()
    h, x = tagger.h, w.T
    hid = cell = np.zeros((len(w), h))
    for t in range(len(x)):
        z = tagger.w["tf"][x[t]] + hid @ tagger.w["uf"]
        i, f, o, g = (0.5 + 0.5 * np.tanh(z[:, k * h : (k + 1) * h]) if k < 3 else np.tanh(z[:, 3 * h :]) for k in range(4))
        cell = f * cell + i * g
        hid = o * np.tanh(cell)
    assert np.abs(hid - tagger.states(np.ascontiguousarray(x), "f")[-1]).max() < 0.02


def test_pii_most_windows_without_labels_are_told_before_viterbi(spark):
    tagger = pii.tagger()
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if r.text]
    cut = {pii.encode(t)[a:b].tobytes() for t in texts for r in pii.regions(t) for a, b in pii.windows(*r) if b - a == pii.WIDTH}
    lead = tagger.leads(np.array([np.frombuffer(w, np.uint8) for w in sorted(cut)]))
    some, open_ = tagger.viterbi(lead).any(1), tagger.gain(lead) > 0
    assert open_[some].all() and some.any()
    assert open_[~some].mean() < 0.5


def test_pii_each_character_has_the_label_of_the_window_that_it_lies_deepest_in(monkeypatch):
    class Content:
        def decode(self, x):
            return np.where(x.sum(1, keepdims=True) % 3, (x * np.arange(1, x.shape[1] + 1)) % 11, 0).astype(np.uint8)

    got = []
    monkeypatch.setattr(pii, "spans_of", lambda labels, at: got.append(labels) or [])
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab 1\n"), n, p=[0.45, 0.3, 0.2, 0.03, 0.02])) for n in (1, 90, 144, 145, 150, 247, 248, 249, 300, 700, 1500)]
    pii.decode_all(texts, Content(), batch=1)
    want = []
    for t in texts:
        own = [w for r in pii.regions(t) for w in pii.windows(*r)]
        labels, depth = np.zeros(len(t), np.uint8), np.full(len(t), -1)
        for s, e in own:
            path = Content().decode(np.pad(pii.encode(t[s:e]), (0, max(0, 8 - (e - s))), constant_values=pii.PAD)[None].astype(np.uint8))[0]
            for i in range(s, e):
                if (d := min(i - s, e - 1 - i)) > depth[i]:
                    labels[i], depth[i] = path[i - s], d
        want += [labels] * bool(labels.any())
    assert len([x for x in got if x.any()]) == len(want) > 5 and all((a == b).all() for a, b in zip((x for x in got if x.any()), want))


def test_pairs_frame(spark):
    chat = spark.read.parquet(f"{SF}/coding_chat.parquet")
    got = pairs.label(chat, spark.read.parquet(f"{SF}/common_words.parquet")).toPandas()
    assert got.chat_id.is_unique and set(got.chat_id) == {r.chat_id for r in chat.select("chat_id").distinct().collect()}
    assert {d["defect"] for x in got.defects for d in x} <= set(pairs.DEFECTS)
    empty = {r.chat_id for r in chat.where("response is null").collect()}
    assert empty <= set(got[got.defects.map(lambda x: any(d["defect"] == "empty" for d in x))].chat_id)


def test_label_model_recovers_votes():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.05
    votes = np.where(rng.random((4000, 4)) < np.where(y[:, None], 0.85, 0.02), 1, -1)
    pat, n = np.unique(votes, axis=0, return_counts=True)
    m = pairs.LabelModel().fit(pat, n.astype(float))
    assert ((m.posterior(votes) > 0.5) == y).mean() > 0.99


def test_knapsack_and_packing():
    rng = np.random.default_rng(4)
    lengths = np.array([7, 5, 3])
    values = np.array([9.0, 6.0, 3.5])
    best = max(9 * a + 6 * b + 3.5 * c for a in range(4) for b in range(5) for c in range(8) if 7 * a + 5 * b + 3 * c <= 22)
    got = packing.knapsack(lengths, values, 22)
    assert abs(sum(dict(zip(lengths, values))[e] * k for e, k in got.items()) - best) < 1e-9 and sum(e * k for e, k in got.items()) <= 22
    hist = {int(e): int(n) for e, n in zip(*np.unique(rng.integers(1, 200, 3000), return_counts=True))}
    plan, least = packing.solve(hist, 256)
    assert least <= sum(m for m, _ in plan)
    used: dict[int, int] = {}
    for m, c in plan:
        assert sum(e * k for e, k in c.items()) <= 256
        for e, k in c.items():
            used[e] = used.get(e, 0) + m * k
    assert used == hist
    assert sum(m for m, _ in plan) <= 1.02 * sum(e * n for e, n in hist.items()) / 256 + 1


def test_the_lp_beats_best_fit_where_that_is_far_off():
    for hist, best in (({51: 600, 27: 600, 26: 600, 23: 1200}, 900), ({34: 3000, 33: 6000, 51: 1000, 49: 1000, 26: 2000, 24: 2000}, 5000)):
        plan, least = packing.solve(hist, 100)
        assert sum(m for m, _ in plan) == least == best < sum(packing.best_fit(hist, 100).values())
        off, _ = packing.solve(hist, 100, packing.Params(rounds=0))
        assert sum(m for m, _ in off) > best  # without its rounds the rows change
        used = {}
        for m, c in plan:
            assert sum(e * k for e, k in c.items()) <= 100
            for e, k in c.items():
                used[e] = used.get(e, 0) + m * k
        assert used == hist


def test_the_lp_itself_packs_every_text():
    rng = np.random.default_rng(9)
    hists = [({51: 600, 27: 600, 26: 600, 23: 1200}, 100, 1.0), ({60: 100, 30: 50}, 100, 1.06), ({700: 3, 41: 1}, 700, 1.34)]
    hists.append(({int(e): int(n) for e, n in zip(*np.unique(np.minimum(1024, rng.lognormal(5.6, 0.9, 3000).astype(int) + 1), return_counts=True))}, 1024, 1.01))
    for hist, cap, near in hists:
        used, bound = packing.relax(hist, cap)
        got: dict[int, float] = {}
        for key, x in used.items():
            assert sum(e * k for e, k in key) <= cap
            for e, k in key:
                got[e] = got.get(e, 0) + k * x
        assert got == hist  # all of it, and none by best fit
        assert bound - 1e-6 <= sum(used.values()) <= near * bound + 1e-6
        assert sum(m for m, _ in packing.solve(hist, cap)[0]) <= min(sum(used.values()), sum(packing.best_fit(hist, cap).values()))


def test_packing_frame(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(9001, None), (9002, "")], "doc_id long, text string"))
    got = packing.pack(docs, spark.read.parquet(f"{SF}/pack_limits.parquet"), block=20).toPandas()
    assert not set(got.doc_id) & {9001, 9002}
    for (_, cap, _), g in got.groupby(["pack_name", "capacity_tokens", "container_id"]):
        assert g.n_tokens.sum() <= cap and g.used_tokens.iloc[0] == g.n_tokens.sum()
    whole = got.groupby(["pack_name", "doc_id"]).n_tokens.sum().unstack(0)
    assert whole.nunique(axis=1).max() == 1
    cut = got[got.piece_no > 0]
    assert (whole.loc[cut.doc_id].iloc[:, 0].to_numpy() > cut.capacity_tokens.to_numpy()).all()


def test_splitting_tree_is_exact():
    blocks = np.array([100, 7, 0, 33])
    got = mixing.split(blocks, 6, np.random.default_rng(1))
    assert got.shape == (6, 4) and (got.sum(0) == blocks).all() and got.sum(1).max() - got.sum(1).min() <= 2


def test_mixing_shares(spark):
    docs = spark.createDataFrame([(i, "word " * (5 + i % 7), "ab"[i % 4 == 0]) for i in range(400)] + [(900, None, "a"), (901, "x", None)], "doc_id long, text string, source string")
    mixes = spark.createDataFrame([("m", "a", 1.0, 1, "train", "random"), ("m", "b", 1.0, 3, "train", "sequential"), ("m", "gone", 1.0, 2, "train", "random"), ("m", "zero", 0.0, 2, "train", "random")], "mix_name string, name string, weight double, max_repeats int, split string, sampling string")
    rows, shares = mixing.mix(docs, mixes, shard_tokens=500)
    df, s = rows.toPandas(), {r.source: r for r in shares.collect()}
    assert abs(s["a"].actual_share - 0.5) < 0.01 and s["gone"].n_tokens == 0 and s["zero"].n_rows == 0
    assert df.groupby(["source", "doc_id"]).size().groupby("source").max().to_dict() == {"a": 1, "b": 3}
    assert not df.duplicated(["doc_id", "repeat_no"]).any() and df.shard.nunique() > 1


def test_residue():
    ix = residue.build_index(0, {})
    hit = ["Dear {{name}}, thank you for choosing [[company]].", "404 Not Found\n\nThe page you were looking for is not here.", "Please enable JavaScript to view this page.", "Lorem ipsum dolor sit amet nulla porta morbi."]
    miss = [None, "", "  ", "In a template, a pair of braces such as `{{ company }}` is filled in by the engine.", 'def f(x):\n    print(f"{x} failed")\n    return x', "The parser returns an empty list when the network is gone, and nobody could say why it does so."]
    assert all(residue.judge(t, ix)[0] for t in hit)
    assert not any(residue.judge(t, ix)[0] for t in miss)
    assert residue.judge(hit[0] + "\n\n" + miss[-1] * 30, ix)[0]


def test_residue_is_found_however_frequent_it_is(spark):
    # every exemplar word in a third of the rows: an exemplar as a whole document is found at any size of the corpus
    for n in (0, 150, 9000, 10**7):
        ix = residue.build_index(n, {t: n // 3 for t in residue.VOCABULARY})
        for t in ("This page needs JavaScript.", "Error 502: Bad gateway", "Gateway timeout", "404 Not Found", "Please try again later.", "test test test test"):
            assert residue.judge(t, ix)[0], (n, t)
        assert not residue.judge("It is not here. The team is on it.", ix)[0]
    prose = ["The parser returns an empty list when the network is gone, and nobody could say why.", "We moved the lock manager to a plain file."]
    rows = [(i, "Error 502: Bad gateway" if i % 3 == 0 else f"{prose[i % 2]} Run {i}.") for i in range(300)] + [(300, None), (301, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert residue.document_frequencies(df)[0] == 201
    assert {r.doc_id for r in residue.detect(df, keep=["doc_id"]).where("is_residue").collect()} == set(range(0, 300, 3))
