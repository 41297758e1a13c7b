"""Personal information in free text (problem 5).

A character-level bidirectional LSTM with a CRF on top, in numpy.  The stretches of a text in
which a span may lie at all are cut into overlapping windows; equal windows are decoded once,
windows are decoded in batches by Viterbi, their labels are stitched where windows overlap (each
character keeps the label of the window in whose middle it lies most), and spans are read off
the stitched labels.  A last exact check (``possible``) drops spans that can't be of their kind
and moves starts to word starts.

``regions`` leaves out nearly only what that check would refuse whatever the labels: a span needs a
digit, an at sign (or the word at), or two capitalised words; a name whose second one is a common
sentence opener or stands more than APART characters off is lost.

The weights beside this module were trained by ``millrace.llm.pii_train``.

Defined results: null and empty texts have no spans and stay as they are.  Spans of
one text don't overlap.  Repeated rows each get their own result.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table
from millrace.runtime import spread

KINDS = ["email", "phone", "idnum", "address", "name"]
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in ("B", "I")]
WEIGHTS = os.path.join(os.path.dirname(__file__), "pii_weights.npz")
WIDTH, STRIDE = 144, 104
MARGIN, APART = 32, 48  # characters decoded around each sign of a span; the most between two words of a name


@lru_cache(1)
def codes() -> np.ndarray:
    """Code point to character class: ASCII as it is, accented letters as their base, a few classes for the rest."""
    t = np.full(0x10000, 100, np.uint8)
    for c in range(32, 127):
        t[c] = c - 31
    t[10], t[9], t[13], t[0xA0] = 96, 97, 96, 1
    for c in range(0xA1, 0x250):
        base = unicodedata.normalize("NFD", chr(c))[0]
        t[c] = ord(base) - 31 if "A" <= base <= "z" and base.isalpha() else 98
    t[0x3040:0xA000] = 99
    t[0x2019] = ord("'") - 31
    return t


def encode(text: str) -> np.ndarray:
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes()[np.minimum(a, 0xFFFF)]


N_CODES = 101
PAD = 96


UNIT, SPAN_ = 512, 32  # steps of the activation tables per unit, and units on each side


@lru_cache(1)
def activations() -> tuple[np.ndarray, np.ndarray]:
    """Sigmoid (of doubled arguments) followed by tanh in steps, and tanh alone, by step: lookups take a fraction of the time of np.tanh."""
    x = (np.arange(2 * SPAN_ * UNIT) - SPAN_ * UNIT) / UNIT
    tanh = np.tanh(x)
    return np.concatenate([0.5 + 0.5 * tanh, UNIT * tanh]).astype(np.float32), tanh.astype(np.float32)


class Tagger:
    """Weights: for each direction, input table (N_CODES x 4H, embeddings folded in), recurrent matrix and bias; then the CRF."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w = {k: np.ascontiguousarray(v, np.float32) for k, v in w.items()}
        self.h = h = self.w["uf"].shape[0]
        self.steps = {}
        for d in "fb":  # scaled so that sums are steps of the tables; gates i, f, o are held at half scale
            t, u = self.w["t" + d], self.w["u" + d]
            if (np.abs(t).max(0) + np.abs(u).sum(0)).max() >= SPAN_ - 1:
                raise ValueError("weights reach beyond the activation tables")
            shift = SPAN_ * UNIT + 0.5 + np.r_[np.zeros(3 * h), np.full(h, 2 * SPAN_ * UNIT)]
            self.steps[d] = (t * UNIT + shift).astype(np.float32), (u * UNIT).astype(np.float32)
        self.lead = tuple(np.ascontiguousarray(self.w[k][:, 1:] - self.w[k][:, :1]) for k in ("vf", "vb"))
        self.own = (self.w["c"][1:] - self.w["c"][0])[:, None]
        a, s = self.w["a"] - self.w["a"][0, 0], self.w["s"] - self.w["s"][0]
        within, lift = a[1:, 1:], np.zeros(len(a) - 1, np.float32)
        lift[1::2] = within.diagonal()[1::2] - within.diagonal(1)[::2]  # so that B to I costs as much as I to I
        self.moves = [np.float32(x.max()) for x in (s[1:] + lift, a[0, 1:] + lift, within + lift - lift[:, None], a[1:, 0] - lift, -lift)]

    @classmethod
    def load(cls, path: str = WEIGHTS) -> Tagger:
        with np.load(path) as z:
            return cls(dict(z))

    def states(self, x: np.ndarray, d: str) -> np.ndarray:
        """Hidden states of one direction, T x B x H; x is T x B, already in that direction's order."""
        (table_, u), h = self.steps[d], self.h
        both, tanh = activations()
        n = x.shape[1]
        x = x.astype(np.intp)
        hid, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)  # cells are held in steps
        out = np.empty((len(x), n, h), np.float32)
        z, into = np.empty((n, 4 * h), np.float32), np.empty((n, 4 * h), np.float32)
        at, wide = np.empty((n, 4 * h), np.uint16), np.empty((n, 4 * h), np.intp)  # casts in two steps take half the time of one
        c, ct, cwide = np.empty((n, h), np.float32), np.empty((n, h), np.int32), np.empty((n, h), np.intp)
        i, f, o, g = (z[:, k * h : (k + 1) * h] for k in range(4))
        middle = np.float32(SPAN_ * UNIT + 0.5)
        for t in range(len(x)):
            np.matmul(hid, u, out=z)
            np.take(table_, x[t], axis=0, out=into, mode="clip")
            z += into
            np.copyto(at, z, casting="unsafe")
            np.copyto(wide, at)
            np.take(both, wide, out=z, mode="clip")
            cell *= f
            np.multiply(i, g, out=c)
            cell += c
            np.add(cell, middle, out=c)
            np.copyto(ct, c, casting="unsafe")
            np.copyto(cwide, ct)
            hid = out[t]
            np.take(tanh, cwide, out=hid, mode="clip")
            hid *= o
        return out

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best label paths (Viterbi) of windows x (B x T)."""
        lead = self.leads(x)
        path = np.zeros(x.shape, np.uint8)
        open_ = np.flatnonzero(self.gain(lead) > -0.01)  # far more than rounding
        if len(open_):
            path[open_] = self.viterbi(lead[:, :, open_])
        return path

    def leads(self, x: np.ndarray) -> np.ndarray:
        """T x (L - 1) x B: how far each label's score lies above that of no label; labels come before the windows, so that all steps run along these."""
        xt = np.ascontiguousarray(x.T)
        f, b = self.states(xt, "f"), self.states(xt[::-1], "b")
        t, n, h = f.shape
        lead = (f.reshape(-1, h) @ self.lead[0]).reshape(t, n, -1)
        lead += (b.reshape(-1, h) @ self.lead[1]).reshape(t, n, -1)[::-1]
        lead = np.ascontiguousarray(lead.transpose(0, 2, 1))
        lead += self.own
        return lead

    def gain(self, lead: np.ndarray) -> np.ndarray:
        """For each window a bound on what any labels gain over none at all: where it isn't positive, no label is best.

        It is the gain of the best run of labels if each character took its best label and each step the best transition (of
        those into, within or out of a run).  ``lift`` moves costs between these: it adds up to nothing over a run.
        """
        start, into, within, out, end = self.moves
        best = lead.max(1)
        run = best[0] + start
        top = np.full_like(run, -np.inf)
        for e in best[1:]:
            np.maximum(top, run + out, out=top)
            run += within
            np.maximum(run, into, out=run)
            run += e
        return np.maximum(top, run + end)

    def viterbi(self, lead: np.ndarray) -> np.ndarray:
        """Best paths for ``leads``."""
        t, k, n = lead.shape
        e = np.zeros((t, k + 1, n), np.float32)
        e[:, 1:] = lead
        a = self.w["a"]
        best = np.empty_like(e)
        best[0] = e[0] + self.w["s"][:, None]
        each, sums = np.repeat(a[:, :, None], n, 2), np.empty((*a.shape, n), np.float32)
        for t in range(1, len(e)):
            np.add(best[t - 1][:, None], each, out=sums)
            np.max(sums, axis=0, out=best[t])
            best[t] += e[t]
        path = np.empty((n, len(e)), np.uint8)
        at = best[-1].argmax(0)
        path[:, -1] = at
        for t in range(len(e) - 1, 0, -1):
            at = (best[t - 1] + a[:, at]).argmax(0)
            path[:, t - 1] = at
        return path


SIGNS = [re.compile(x) for x in (r"\d(?:[\w.,:/()+-]*\d)?", "@", r"[aA][tT]\b(?<!\w..)")]  # one by one, as each is found by its first character


def regions(text: str) -> list[tuple[int, int]]:
    """The stretches that are decoded: MARGIN characters around each sign of a span."""
    at = [m.span() for sign in SIGNS for m in sign.finditer(text)]
    last = None
    for m in NAME_WORD.finditer(text):
        if m[0].lower() in STARTERS:
            continue
        if last is not None and m.start() - last[1] <= APART:
            at.append((last[0], m.end()))
        last = m.span()
    out: list[tuple[int, int]] = []
    for a, b in sorted(at):
        a, b = max(0, a - MARGIN), min(len(text), b + MARGIN)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def windows(a: int, b: int) -> list[tuple[int, int]]:
    """Overlapping windows that cover the text from a to b."""
    if b - a <= WIDTH:
        return [(a, b)]
    n = -(-(b - a - WIDTH) // STRIDE)
    starts = [a + i * STRIDE for i in range(n)] + [b - WIDTH]
    return [(s, s + WIDTH) for s in starts]


def decode_all(texts: list[str | None], tagger: Tagger, batch: int = 512) -> list[list[tuple[str, int, int]]]:
    """Spans (kind, start, end) of each text."""
    plan: list[list[tuple[int, int, bytes]]] = []  # by text: window start, window end, content
    for t in texts:
        x = encode(t) if isinstance(t, str) else ()
        plan.append([(s, e, x[s:e].tobytes()) for a, b in regions(t) for s, e in windows(a, b)] if len(x) else [])
    distinct: dict[bytes, np.ndarray] = {k: None for own in plan for _, _, k in own}
    order = sorted(distinct, key=len)
    for at in range(0, len(order), batch):
        part = order[at : at + batch]
        width = max(8, len(part[-1]))
        x = np.frombuffer(b"".join(k.ljust(width, bytes([PAD])) for k in part), np.uint8).reshape(-1, width)
        path = tagger.decode(x)
        some = path.any(1)
        for r, k in enumerate(part):
            distinct[k] = path[r, : len(k)] if some[r] else None
    out: list[list[tuple[str, int, int]]] = []
    for t, own in zip(texts, plan):
        if all(distinct[k] is None for _, _, k in own):
            out.append([])
            continue
        labels = np.zeros(len(t), np.uint8)
        starts = [s for s, _, _ in own]
        at = 0
        for (s, e, k), after in zip(own, [*starts[1:], len(t)]):
            # where windows overlap, both are WIDTH long, and a character is deepest in that whose middle is nearest
            to = (s + after + WIDTH + 1) // 2 if after < e else e
            if distinct[k] is not None:
                labels[max(at, s) : to] = distinct[k][max(at, s) - s : to - s]
            at = to
        out.append(reconcile(t, spans_of(labels, 0)))
    return out


def spans_of(path: np.ndarray, offset: int) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    own = np.flatnonzero(path)
    for t, y in zip(own.tolist(), path[own].tolist()):
        kind, at = KINDS[(y - 1) // 2], offset + t
        if y % 2 == 0 and out and out[-1][0] == kind and out[-1][2] == at:
            out[-1] = (kind, out[-1][1], at + 1)
        else:
            out.append((kind, at, at + 1))
    return out


GAP = {"address": re.compile(r"[\s,]{0,3}(?:Apt|Unit|Suite)?[\s,.]{0,3}$"), "name": re.compile(r"[ \xa0,.]{0,2}$"), "phone": re.compile(r"[ \xa0().-]{0,2}$"), "idnum": re.compile(r"[ \xa0.-]{0,1}$"), "email": re.compile(r" ?$")}
#: Capitalised words that begin sentences or code and are no names (fixed values).
STARTERS = frozenset(
    "the a an in on at of for and or if it is as with by to from we you i my our your this that these those there what when where who why how which since after before both please do nothing set run call each whenever thanks anyone about notes setup using changes trouble usage hey hi hello dear regards project driver step row page menu home error http version commit "
    "der die das ein eine es wir ich was wie wer man seit nach vor bei dank jeder diese dieser unser unsere hinweise einrichtung änderungen hallo viele in im am auf von zu und oder mit für "
    "le la les un une des il elle nous vous je ce cette si grâce depuis chaque notre notes dans en sur pour par à au aux et ou "
    "el los las una lo si se en de del al para por con desde cada hay nuestro nuestra notas hola gracias también esta este no y o "
    "o os as um uma em no na nos nas de do da para por com desde cada há nossa nosso notas olá graças também este esta não e "
    "il lo gli i uno in nel nella su per con da di del dalla dal ogni ci nostro note grazie questa questo non e "
    "select from where join create table primary key not null default update insert delete into values and or order group by count as bigint text int varchar limit desc asc in is set".split()
)
CJK = re.compile(r"[\u3040-\u9fff]")
NAME_WORD = re.compile(r"[A-ZÀ-ÖØ-Þ][\w'’-]+")


def possible(kind: str, s: str) -> bool:
    """The exact check: whether a span can be of its kind at all."""
    digits = sum(map(str.isdigit, s))
    if kind == "email":
        return bool(re.search(r"@|\bat\b", s, re.I)) and bool(re.search(r"\.|dot", s, re.I)) and len(s) >= 7 and not re.search(r"@\d", s)
    if kind == "phone":
        return 7 <= digits <= 16
    if kind == "idnum":
        return 6 <= digits <= 13
    if kind == "address":
        # the model knows no letters of Chinese and Japanese, so what it takes for an address there is chance
        words = [w for w in re.findall(r"[^\W\d_]+", s) if w.lower() not in STARTERS]
        return digits >= 1 and sum(map(len, words)) >= 4 and not CJK.search(s) and not re.search(r"[+=_(){}\[\]<>]", s) and len(words) > s[0].isdigit()
    words = NAME_WORD.findall(s)
    return len(words) >= 2 and digits == 0


def reconcile(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Pieces of one thing joined, starts moved to word starts, impossible spans dropped."""
    out: list[tuple[str, int, int]] = []
    for kind, a, b in sorted(spans, key=lambda x: x[1]):
        if out and out[-1][0] == kind and GAP[kind].match(text[out[-1][2] : a]) and "\n\n" not in text[out[-1][2] : a]:
            out[-1] = (kind, out[-1][1], b)
        else:
            out.append((kind, a, b))
    final = []
    for kind, a, b in out:
        least = final[-1][2] if final else 0
        while a > least and text[a - 1 : a].isalnum() and text[a : a + 1].isalnum():
            a -= 1
        while a < b and text[a] in " \xa0\n\t,;:=|\"'<>":
            a += 1
        if kind in ("phone", "idnum"):
            while a > least and text[a - 1] in "+(" and text[a : a + 1] not in " )":
                if kind == "idnum" and text[a - 1] == "(":
                    break
                a -= 1
        elif kind == "address" and (m := re.search(r"(?<![\w.-])\d{1,5}[a-z]? $", text[least:a])):
            a = least + m.start()
        elif kind == "name":  # a sentence's or greeting's first word beside a name isn't part of it
            while m := re.match(r"([^\W\d_]+)\b[\s,.:]*", text[a:b]):
                if m[1].lower() not in STARTERS:
                    break
                a += m.end()
            while m := re.search(r"[\s,.:]+([^\W\d_]+)$", text[a:b]):
                if m[1].lower() not in STARTERS:
                    break
                b = a + m.start()
        elif kind == "email":
            while a > least and re.match(r"[\w.+%-]", text[a - 1]):
                a -= 1
        while b < len(text) and text[b - 1 : b].isalnum() and text[b].isalnum():
            b += 1
        while b > a and text[b - 1] in " \xa0\n\t,;:":
            b -= 1
        if b > a and possible(kind, text[a:b]):
            final.append((kind, a, b))
    return final


@lru_cache(1)
def tagger() -> Tagger:
    return Tagger.load()


SPAN = "array<struct<kind:string,start_at:int,end_at:int>>"


def find(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, start_at, end_at (code points) of each occurrence."""
    kind_ = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            texts = list(b[text])
            for at in range(0, len(texts), 2000):
                for k, own in zip(b[key].iloc[at : at + 2000], decode_all(texts[at : at + 2000], tagger())):
                    rows += [(k, *s) for s in own]
            yield pd.DataFrame(rows, columns=[key, "kind", "start_at", "end_at"])

    src = df.select(key, text).where(F.col(text).isNotNull() & (F.col(text) != ""))
    return spread(src).mapInPandas(run, f"`{key}` {kind_}, kind string, start_at int, end_at int")


def redact_text(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    if not isinstance(text, str) or not spans:
        return text
    out, at = [], 0
    for kind, a, b in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(df: DataFrame, key: str, text: str, to: str = "redacted") -> DataFrame:
    """key, the text with each occurrence replaced by a placeholder of its kind, and the number of occurrences."""
    kind_ = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = list(b[text])
            spans = [s for at in range(0, len(texts), 2000) for s in decode_all(texts[at : at + 2000], tagger())]
            yield pd.DataFrame({key: b[key], to: [redact_text(t, s) for t, s in zip(texts, spans)], "n_found": [len(s) for s in spans]})

    return spread(df.select(key, text)).mapInPandas(run, f"`{key}` {kind_}, {to} string, n_found int")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        find(table(spark, sf_dir, name), key, col).select(F.lit(name).alias("tab"), F.col(key).cast("long").alias("row_id"), "kind", "start_at")
        for name, key, col in (("documents", "doc_id", "text"), ("filtered", "rec_id", "content"))
    ]
    return parts[0].unionByName(parts[1])


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        redact(table(spark, sf_dir, name), key, col).select(F.lit(name).alias("tab"), F.col(key).cast("long").alias("row_id"), "redacted", "n_found")
        for name, key, col in (("documents", "doc_id", "text"), ("filtered", "rec_id", "content"))
    ]
    return parts[0].unionByName(parts[1])


QUERIES = {"p5_found": p5_found, "p5_redacted": p5_redacted}
