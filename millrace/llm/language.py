"""Language of documents and of their paragraphs (problem 2).

Averaged hashed subword embeddings with a linear softmax, trained by stochastic
gradient descent in numpy.  At inference the model is folded into one table of
class scores per hash bucket, and a word's score (the sum over its subwords) is
kept in a per-process cache, so a text costs one dictionary look-up per word.
Confidence is the softmax at a temperature fitted on held-out paragraphs;
paragraphs under the calibrated cutoff are rejected and do not decide anything.

Defined results: null and blank texts have no language (null) and confidence 0.
Repeated rows each get their own result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import CODE_LANGS, FENCED, LANGS, table
from millrace.llm.residue import build_index, document_frequencies, judge
from millrace.runtime import spread

CLASSES = [*LANGS, *CODE_LANGS]
N_NATURAL = len(LANGS)
BUCKETS = 1 << 15

#: Spellings of labels (fixed values: ISO codes, names, file suffixes).
ALIASES = {
    "en": "en eng english", "es": "es spa spanish español castellano", "fr": "fr fra fre french français", "de": "de deu ger german deutsch",
    "pt": "pt por portuguese português", "it": "it ita italian italiano", "zh": "zh zho chi chinese 中文 cmn", "ja": "ja jpn jp japanese 日本語",
    "python": "python py python3", "javascript": "javascript js node ecmascript", "rust": "rust rs", "go": "go golang", "sql": "sql postgresql mysql",
}
LABEL = {word: code for code, words in ALIASES.items() for word in words.split()}

#: A few lines of each programming language, so that small samples know them too.
CODE_SEEDS = {
    "python": ["import os\nfrom x import y as z", "def f(self, x, limit=3):\n    for row in rows:\n        if row is None:\n            continue\n    return out[:limit]", "class A:\n    def __init__(self, key):\n        self.key = {}", "try:\n    return int(x)\nexcept ValueError as err:\n    print(f'{err}')", "with open(path) as fh:\n    data = json.load(fh)\n\nasync def g():\n    x = await f()\n    return [x for x in y if x.z == w]", "# comment\nx = 3\nlambda x: not x and None or True"],
    "javascript": ["import x from './y';\nconst y = require('./z');", "export const f = async (x) => {\n  const y = await g(`/a/${x}`);\n  return y ?? 3;\n};", "function f(rows, limit = 3) {\n  const x = rows.filter((r) => r.a !== null);\n  return x.slice(0, limit);\n}", "class A {\n  constructor(b) {\n    this.b = b;\n  }\n}\nconsole.log('a', this.b);", "let n = 3;\nsetInterval(() => {\n  n -= 1;\n  if (n === 0) f('x');\n}, 3);", "// comment\nvar a = undefined;\nmodule.exports = { a };"],
    "rust": ["use std::collections::HashMap;\n#[derive(Debug, Clone)]\npub struct A {\n    x: u32,\n    y: String,\n}", "impl A {\n    fn new() -> Self {\n        Self { x: 3, y: String::new() }\n    }\n}", "pub fn f(rows: &[u64]) -> Option<u64> {\n    let mut x = 3;\n    for r in rows.iter() {\n        x += r;\n    }\n    Some(x)\n}", "match a.find('#') {\n    Some(i) => Ok(i + 3),\n    None => Err(\"x\".into()),\n}", "// comment\nfn main() {\n    println!(\"{}\", x.unwrap());\n}"],
    "go": ["package main\n\nimport (\n\t\"fmt\"\n\t\"os\"\n)", "func f(rows []string) (int, error) {\n\tx := 3\n\tfor _, r := range rows {\n\t\tif r == \"a\" {\n\t\t\tx++\n\t\t}\n\t}\n\treturn x, nil\n}", "type A struct {\n\tx int\n\ty string\n}\n\nfunc (a *A) F() string {\n\treturn a.y\n}", "func g(ch chan int) {\n\tdefer close(ch)\n\tfor i := 0; i < 3; i++ {\n\t\tch <- i\n\t}\n\tfmt.Println(\"x\")\n}", "// comment\nif err != nil {\n\treturn nil, err\n}\nvar x = map[string]int{}"],
    "sql": ["SELECT a.x_id, count(*) AS n\nFROM a\nJOIN b ON a.x_id = b.y_id\nWHERE b.n > 3\nGROUP BY a.x_id\nORDER BY n DESC;", "CREATE TABLE a (\n  x_id BIGINT PRIMARY KEY,\n  y TEXT NOT NULL,\n  n INT DEFAULT 3\n);", "INSERT INTO a (x, y)\nVALUES (3, 'b');", "UPDATE a\nSET x = 'b'\nWHERE y IN (SELECT y FROM c WHERE z IS NULL)\nlimit 3;", "-- comment\nDELETE FROM a WHERE x = 3;\nALTER TABLE a ADD COLUMN b INT;"],
}

WORD = re.compile(r"\w+")
CJK = re.compile(r"[぀-ヿ一-鿿]")
TOKEN = re.compile(r"[぀-ヿ一-鿿]|[^\W\d_]+|[^\w\s]{1,3}")
CJK_TOKEN = re.compile(r"[぀-ヿ一-鿿]|[^\W぀-ヿ一-鿿]+")
BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
QUOTE = re.compile(r"\"[^\"\n]{12,}\"|“[^”\n]{12,}”|«[^»\n]{12,}»|„[^“”\n]{12,}[“”]|「[^」\n]{8,}」|^[ \t]*>[^\n]*$", re.M)
QUOTE_SIGN = re.compile("[\">“«„「]")
COMMENT = re.compile(r"^[ \t]*(?:#(?!\[)|//|--|/?\*)[^\n]*$|/\*.*?\*/|\"\"\".*?\"\"\"", re.M | re.S)
CODE_LINE = re.compile(
    r"[;{}]\s*$|^\s*[)}\]]+[;,]?\s*$|^\s*(?:import|from|package|use|def|class|async def|return|func|fn|pub|let|const|var|type|impl|struct|match|for|while|if|else|try|except|with|export|function|module\.exports|defer|elif)\b.*[:;(){},='\"\w]\s*$"
    r"|\b(?:BIGINT|INT|INTEGER|TEXT|VARCHAR|BOOLEAN|TIMESTAMP)\b.*(?:PRIMARY KEY|NOT NULL|DEFAULT\b.*),?\s*$|^\s*(?:SELECT|FROM|JOIN|WHERE|GROUP BY|ORDER BY|INSERT|UPDATE|DELETE|CREATE|ALTER|VALUES|SET|LIMIT)\b|:=|=>|->|\w\(.*\)\s*[:{]?\s*$|^\s*[\w.\[\]]+\s*[-+]?=\s*\S|^\s*#\[",
    re.I | re.M,
)


@dataclass(frozen=True)
class Params:
    """sample_rows bounds the labelled rows the classifier is fitted on (all rows get a language); dims: size of an embedding;
    floor: share of held-out paragraphs that may be wrong above the rejection cutoff; evidence: least log-odds, summed over a
    paragraph's words, with which a paragraph can make a document mixed."""

    sample_rows: int = 2500
    dims: int = 12
    epochs: int = 4
    rate: float = 0.5
    floor: float = 0.005
    evidence: float = 6.0
    seed: int = 7


def subwords(word: str) -> list[int]:
    """Hash buckets of the word itself and of its 2- to 4-grams with word ends."""
    w = f"<{word}>"
    grams = {w} | {w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)}
    return sorted({zlib.crc32(g.encode()) % BUCKETS for g in grams})


def normal_label(label: str | None) -> str | None:
    """The code that a delivered label stands for, or None for blanks and words for unknown."""
    if not isinstance(label, str):
        return None
    low = label.strip().lower()
    return LABEL.get(low) or LABEL.get(re.split(r"[-_ ]", low)[0] if low else "")


def prose(text: str) -> str:
    """What of a text tells its natural language: no fenced code, no quotations, no names of things."""
    if "```" in text or "~~~" in text:
        text = FENCED.sub("\n", text)
    return text


def is_name(w: str) -> bool:
    """Identifiers (digits, underscores, capitals inside) tell nothing about a language."""
    return not w.isalpha() or not (w.islower() or w.isupper() or w[1:].islower() or not w.isascii())


def words_of(text: str) -> list[str]:
    """Words of natural text; Chinese and Japanese by character. Names of things are left in and score nothing."""
    if not text.isascii() and CJK.search(text):
        return CJK_TOKEN.findall(text)
    return WORD.findall(text)


def code_words(text: str) -> list[str]:
    """Words and signs of a piece of code."""
    return TOKEN.findall(text)


@dataclass
class Model:
    """scores: class scores by hash bucket; temperature and cutoff from calibration."""

    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    cutoff: float
    cache: dict = field(default_factory=dict)
    fresh: np.ndarray | None = None
    size: int = 1

    def __getstate__(self):
        return {"scores": self.scores, "bias": self.bias, "temperature": self.temperature, "cutoff": self.cutoff, "cache": {}, "fresh": None, "size": 1}

    def _learn(self, w: str) -> int:
        """Cache row of a new word; row 0 is that of all names."""
        if is_name(w) and w[0].isalnum():
            self.cache[w] = 0
            return 0
        k = self.size
        self.size += 1
        if k >= len(self.fresh):
            self.fresh = np.concatenate([self.fresh, np.zeros_like(self.fresh)])
        b = subwords(w.lower())
        self.fresh[k, :-1] = self.scores[b].sum(0)
        self.fresh[k, -1] = len(b)
        self.cache[w] = k
        return k

    def sums(self, texts: list[list[str]]) -> np.ndarray:
        """For each list of words, the sum of its subwords' class scores and, in the last column, their number."""
        if self.fresh is None or len(self.cache) > 400_000:
            self.cache, self.fresh, self.size = {}, np.zeros((8192, len(CLASSES) + 1), np.float32), 1
        out = np.zeros((len(texts), len(CLASSES) + 1), np.float32)
        flat: list[int] = []
        begun, start = [], 0

        def flush(until: int) -> None:
            if flat:
                out[[i for i in range(start, until) if texts[i]]] = np.add.reduceat(self.fresh[flat], begun, axis=0)
            flat.clear()
            begun.clear()

        get = self.cache.get
        for i, words in enumerate(texts):
            if not words:
                continue
            begun.append(len(flat))
            ids = list(map(get, words))
            if None in ids:
                ids = [k if k is not None else self.cache[w] if w in self.cache else self._learn(w) for k, w in zip(ids, words)]
            flat += ids
            if len(flat) > 50_000:
                flush(i + 1)
                start = i + 1
        flush(len(texts))
        return out

    def logits(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(len(CLASSES), np.float32)
        s = self.sums([words])[0]
        return s[:-1] / max(s[-1], 1.0) + self.bias

    def prob(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)


def train(samples: list[tuple[list[str], int]], p: Params = Params()) -> Model:
    """SGD on (words, class); a tenth is held out for the temperature and the rejection cutoff.

    After half of the epochs, samples that the model contradicts firmly are taken for wrong labels and left out.
    """
    rng = np.random.default_rng(p.seed)
    known: dict[str, np.ndarray] = {}

    def ids(words: list[str]) -> np.ndarray:
        out = []
        for w in words:
            if w not in known:
                known[w] = np.array([] if is_name(w) and w[0].isalnum() else subwords(w.lower()), np.int32)
            out.append(known[w])
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    data = [(ids(w), y) for w, y in samples]
    data = [x for x in data if len(x[0])]
    order = rng.permutation(len(data))
    held, fit = order[: len(order) // 10], order[len(order) // 10 :]
    k = len(CLASSES)
    emb = rng.normal(0, 0.1, (BUCKETS, p.dims)).astype(np.float32)
    out = np.zeros((p.dims, k), np.float32)
    bias = np.zeros(k, np.float32)
    counts = np.bincount([data[i][1] for i in fit], minlength=k) if len(fit) else np.ones(k)
    weight = np.sqrt(counts.max() / np.maximum(counts, 1)).clip(1, 6).astype(np.float32)
    epochs = max(p.epochs, min(40, -(-1500 // (len(fit) // 16 + 1))))  # few samples are gone over more often
    steps, t = max(1, epochs * (len(fit) // 16 + 1)), 0
    for epoch in range(epochs):
        if epoch == epochs // 2 and epoch:
            keep = []
            for i in fit:
                z = emb[data[i][0]].mean(0) @ out + bias
                e = np.exp(z - z.max())
                if z.argmax() == data[i][1] or e.max() / e.sum() < 0.7:
                    keep.append(i)
            fit = np.array(keep, int)
        rng.shuffle(fit)
        for b in range(0, len(fit), 16):
            rate = p.rate * max(0.05, 1 - t / steps)
            t += 1
            part = [data[i] for i in fit[b : b + 16]]
            flat = np.concatenate([x for x, _ in part])
            n = np.array([len(x) for x, _ in part])
            y = np.array([c for _, c in part])
            starts = np.r_[0, n.cumsum()[:-1]]
            h = np.add.reduceat(emb[flat], starts, axis=0) / n[:, None]
            z = h @ out + bias
            e = np.exp(z - z.max(1, keepdims=True))
            g = e / e.sum(1, keepdims=True)
            g[np.arange(len(y)), y] -= 1
            g *= weight[y][:, None]
            gh = (g @ out.T) / n[:, None]
            out -= rate * (h.T @ g) / len(y) * 4
            bias -= 0.1 * rate * g.mean(0)
            rows, where = np.unique(flat, return_inverse=True)
            share = np.zeros((len(y), len(rows)), np.float32)
            np.add.at(share.reshape(-1), np.repeat(np.arange(len(y)), n) * len(rows) + where, 1.0)
            emb[rows] -= (rate * 4) * (share.T @ gh)
    model = Model((emb @ out).astype(np.float32), bias, 1.0, 0.0)
    if len(held) >= 20:
        z = np.array([model.scores[data[i][0]].mean(0) + bias for i in held])
        y = np.array([data[i][1] for i in held])
        top = np.array([model.prob(r).max() for r in z])
        wrong_label = (z.argmax(1) != y) & (top > 0.7)  # as in training
        z, y = z[~wrong_label], y[~wrong_label]

        def loss(temp: float) -> float:
            q = z / temp
            q = q - q.max(1, keepdims=True)
            return float(-(q[np.arange(len(y)), y] - np.log(np.exp(q).sum(1))).mean())

        model.temperature = min((0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0, 1.5, 2.0), key=loss)
        pr = np.array([model.prob(r) for r in z])
        best, right = pr.max(1), pr.argmax(1) == y
        for cut in np.arange(0.3, 0.96, 0.05):
            kept = best >= cut
            if kept.any() and (~right[kept]).mean() <= p.floor:
                model.cutoff = float(cut)
                break
        else:
            model.cutoff = 0.95
    return model


PIECE = 64  # words in a training sample; longer texts give several


def samples_of(text: str, label: str) -> list[tuple[list[str], int]]:
    """Training samples of a labelled text: a code file in pieces, or each paragraph of prose in pieces."""
    y = CLASSES.index(label)
    text = text.replace("\r", "").replace("\ufeff", "")
    if y >= N_NATURAL:
        w = code_words(COMMENT.sub("\n", text))
        return [(w[i : i + 2 * PIECE], y) for i in range(0, len(w), 2 * PIECE)]
    if is_code(text):
        return []
    out = []
    for para in BLANK.split(prose(text)):
        w = words_of(QUOTE.sub(" ", para))
        out.extend((w[i : i + PIECE], y) for i in range(0, len(w), PIECE) if len(w) - i >= 4)
    return out


def first_by_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of the lowest hashes of their key. The cut is found on hashes alone, so no task sends texts that are not chosen."""
    h = F.xxhash64(F.col(key))
    cut = df.select(h.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return df.where(h <= cut).limit(n) if cut is not None else df.limit(0)


def fit(docs: DataFrame, common: DataFrame | None = None, text: str = "text", label: str = "lang", key: str = "doc_id", p: Params = Params()) -> Model:
    """Train on a bounded sample of labelled rows (``sample_rows`` in hash order)."""
    labelled = docs.select(text, label, key).where(F.col(text).isNotNull() & F.col(label).isNotNull() & (F.length(F.trim(text)) > 20))
    got = first_by_hash(labelled, key, p.sample_rows).toPandas()
    rows = [(t, lab) for t, lab in zip(got[text], map(normal_label, got[label])) if lab]
    seeds = [(code_words(line), CLASSES.index(c)) for c, lines in CODE_SEEDS.items() for line in lines] * 3
    if common is not None:
        for r in common.groupBy("language").agg(F.sort_array(F.collect_list("word")).alias("w")).collect():
            if r.language in LANGS:
                w = list("".join(r.w)) if r.language in ("zh", "ja") else [x.lower() for x in r.w]
                seeds += [(w, CLASSES.index(r.language)), (w[::2], CLASSES.index(r.language))]
    kana = list("あいうえおかきくけこさしすせそたちつてとなにぬのはひふへほまみむめもやゆよらりるれろわをんアイウエオカキクケコサシスセソタチツテトナニヌネノ")
    seeds += [(kana, CLASSES.index("ja"))] * 2
    return train([x for t, lab in rows for x in samples_of(t, lab)] + seeds, p)


@lru_cache(100_000)
def code_line(line: str) -> bool:
    return bool(CODE_LINE.search(line))


def is_code(text: str) -> bool:
    """Whether most of a text, outside of fences and comments, is code lines."""
    if "```" in text:
        text = FENCED.sub("\n", text)
    signs = text.count("(") + text.count("[") + text.count(":\n") + text.count(";") + text.count("{") + text.count("=") + text.count(" * ")
    if signs < 2 or signs * 1500 < len(text):
        return False
    bare = COMMENT.sub("", text)
    lines = [x for x in bare.split("\n") if x and not x.isspace()]
    if not lines:
        return False
    hits = sum(map(code_line, lines))
    return hits >= 0.5 * len(lines) and hits >= 2


Labelled = tuple[str | None, float, list[tuple[str, float]]]


def label_texts(texts: list[str | None], m: Model, p: Params = Params()) -> list[Labelled]:
    """For each text, language and confidence of the whole, and of each paragraph if it mixes natural languages."""
    parts: list[list[str]] = []  # words by part: a code file, or a paragraph
    plan: list[tuple[int, int, bool]] = []  # by text: first part, number of parts, code
    for text in texts:
        if not isinstance(text, str) or not text or text.isspace():
            plan.append((len(parts), 0, False))
            continue
        text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\ufeff", "")
        if is_code(text):
            plan.append((len(parts), 1, True))
            parts.append(code_words(COMMENT.sub("\n", text)))
            continue
        body = FENCED.sub(lambda f: "\n" + "\x1c\n" * f[0].count("\n"), text) if "```" in text or "~~~" in text else text
        paras = [x for x in BLANK.split(body) if x and not x.isspace()]
        own = [words_of(QUOTE.sub(" ", x) if QUOTE_SIGN.search(x) else x) for x in paras]
        if any(own):
            plan.append((len(parts), len(own), False))
            parts.extend(own)
        else:  # nothing but fenced code, signs or numbers
            w = code_words(text)
            plan.append((len(parts), 1 if "\x1c" in body else 0, True))
            parts.extend([w] if "\x1c" in body else [])
    sums = m.sums(parts)
    sizes = np.maximum(sums[:, -1:], 1.0)
    z_all = sums[:, :-1] / sizes + m.bias
    latin = np.array([(t := "".join(w)).isascii() or not CJK.search(t) for w in parts], bool)
    z_all[np.ix_(latin, [LANGS.index("zh"), LANGS.index("ja")])] = -30.0  # no letter of theirs
    natural = m.prob(z_all[:, :N_NATURAL])
    best = natural.argmax(1)
    conf = natural.max(1)
    n_words = np.array([sum(map(str.isalpha, w)) if len(w) < 60 else 60 for w in parts])
    cut = max(m.cutoff, 0.8)
    out: list[Labelled] = []
    for a, n, code in plan:
        if n == 0:
            out.append((None, 0.0, []))
            continue
        if code:
            q = m.prob(z_all[a, N_NATURAL:])
            k = int(q.argmax())
            out.append((CODE_LANGS[k], float(q[k]), []))
            continue
        if n == 1:
            out.append((LANGS[best[a]], float(conf[a]), []))
            continue
        b = slice(a, a + n)
        whole_z = sums[b, :N_NATURAL].sum(0) / max(1.0, float(sums[b, -1].sum())) + m.bias[:N_NATURAL]
        if latin[b].all():
            whole_z[-2:] = -30.0
        q = m.prob(whole_z)
        whole = int(q.argmax())
        own, c, k = best[b], conf[b], n_words[b]
        margin = (z_all[b, :N_NATURAL][np.arange(n), own] - z_all[b, whole]) / m.temperature * np.sqrt(k)
        sure = (c >= cut) & (k >= 4) & ((own == whole) | (margin >= p.evidence))
        if len(set(own[sure])) < 2:
            out.append((LANGS[whole], float(q[whole]), []))
            continue
        at = np.flatnonzero(sure)
        segs = []
        for i in range(n):
            lang = own[i]
            if not sure[i] and c[i] < max(m.cutoff, 0.5):  # rejected: as its nearest sure neighbour
                lang = own[at[np.abs(at - i).argmin()]]
            segs.append((LANGS[lang], float(c[i])))
        out.append((LANGS[whole], float(q[whole]), segs))
    return out


def segments(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", p: Params = Params(), also: str | None = None, out_of=None) -> DataFrame:
    """One row per document (seg_no -1) and one per paragraph of a mixed one: key, seg_no, language, confidence, mixed.

    ``out_of(text, label, language, mixed)`` may drop a document before its rows leave the process.
    """
    fields = [f for f in docs.schema if f.name == key or f.name == also]
    cols = [key, *([also] if also else []), text]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted(fields, key=lambda f: cols.index(f.name)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            label = b[also] if also else [None] * len(b)
            for k, lab, t, (lang, conf, paras) in zip(b[key], label, b[text], label_texts(list(b[text]), model, p)):
                if out_of is not None and not out_of(t, lab, lang, bool(paras)):
                    continue
                own = (k, lab) if also else (k,)
                rows.append((*own, -1, lang, conf, bool(paras)))
                rows.extend((*own, i, lang_i, conf_i, True) for i, (lang_i, conf_i) in enumerate(paras))
            yield pd.DataFrame(rows, columns=[*cols[:-1], "seg_no", "language", "confidence", "mixed"])

    return spread(docs.select(*cols)).mapInPandas(run, shape + ", seg_no int, language string, confidence double, mixed boolean")


def p2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "common_words"))
    return segments(docs, model).select("doc_id", "seg_no", "language", F.round("confidence", 4).alias("confidence"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "common_words"))
    ix = build_index(*document_frequencies(docs))

    def wanted(text: str, label: str | None, lang: str | None, mixed: bool) -> bool:
        return lang is not None and (mixed or normal_label(label) != lang) and not judge(text, ix)[0]

    got = segments(docs, model, also="lang", out_of=wanted)
    return got.where(F.when(F.col("mixed"), F.col("seg_no") >= 0).otherwise(F.col("seg_no") == -1)).select("doc_id", "seg_no", "language")


QUERIES = {"p2_languages": p2_languages, "p2_found": p2_found}
