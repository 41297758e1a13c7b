"""Template residue, filler, error pages and script notices (problem 9).

Labelled exemplars of residue (and of texts that only explain residue) sit in an
inverted index from token to exemplar.  A text is cut into passage windows
(lines and sentences); every exemplar token of a window retrieves exemplars,
and the TF-IDF weight of the window that an exemplar contains, over the weight
of the whole window, is the containment.  Document frequencies of the exemplar
vocabulary are counted over the distinct texts of the whole corpus, so copies of
a notice don't make its words common.

Defined results: a null or blank text has no window, coverage 0 and is kept.
Repeated rows each get their own result.  Extra columns are carried through;
columns named like a result are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import FENCED, rows_by_batch, table
from millrace.runtime import spread

PH = "\ue000"  # a placeholder of any syntax
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{1,40}\}\}|<%=?[^%\n]{1,40}%>|[$#]\{\w{1,40}\}|\{[A-Za-z_]\w{0,40}\}|%\(\w{1,40}\)s|%[A-Z][A-Z_]{2,40}%|@@[A-Z][A-Z_]{1,40}@@"
    r"|\[\[\w{1,40}\]\]|<<\w{1,40}>>|\[(?:[Ii]nsert|INSERT|[Yy]our|YOUR|[Ee]nter|ENTER|[Aa]dd|ADD)\b[^\]\n]{0,60}\]|XX[A-Z][A-Z_]+XX|__[A-Z][A-Z_]+__"
    r"|<(?!/?(?:html|head|body|h[1-6]|p|div|span|br|hr|a|b|i|ul|ol|li|table|tr|td|th|pre|code|img|em|strong|meta|link rel|script|noscript|style|form|input|button|nav|footer|header|main|section)\b)[a-z][a-z_ ]{2,30}>"
)
TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,80}>")
TICKED = re.compile(r"`[^`\n]*`")
QUOTED = re.compile(r"\"[^\"\n]{1,200}\"|“[^”\n]{1,200}”|«[^»\n]{1,200}»")
WINDOW = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\|| - |: ")
TOKEN = re.compile(r"\w+|")
WORDS = re.compile(r"\w+")
CJK = re.compile(r"[぀-ヿ一-鿿]")
NAME = re.compile(r"_|\d[^\W\d]|[^\W\d]\d|[a-z][A-Z]")
CODE = re.compile(r"[;{}=]\s*$|\w\(|=>|:=|^\s*(?:#|//|--|import |from |package |use |def |class |return |echo |let |const |var )|\w = ")

#: Labelled exemplars: label, then texts. The placeholder sign stands for any placeholder syntax.
EXEMPLARS: dict[str, str] = {
    "placeholder": """
Dear @, thank you for choosing @.
Hello @, your account at @ is ready.
Hi @, welcome to @.
Posted by @ in @.
Written by @ on @.
Welcome to @, the home of @.
Install @ with the following command: @.
@ was released on @ and replaces @.
This page describes @.
Last updated: @.
Copyright @ by @. All rights reserved.
The total for your order is @.
Your order @ has been shipped to @.
Contact us at @ or call @.
About @
Title: @
Estimado @, gracias por elegir @.
Hola @, su cuenta en @ está lista.
Bienvenido a @, publicado por @.
Esta página describe @ desde el @.
Instale @ con el siguiente comando: @.
Última actualización: @.
El total de su pedido es @.
Cher @, merci d'avoir choisi @.
Bonjour @, votre compte chez @ est prêt.
Bienvenue sur @, publié par @.
Cette page décrit @ depuis le @.
Installez @ avec la commande suivante : @.
Dernière mise à jour : @.
Le total de votre commande est de @.
Hallo @, danke, dass Sie sich für @ entschieden haben.
Sehr geehrter @, vielen Dank für Ihre Bestellung bei @.
Willkommen bei @, verfasst von @.
Diese Seite beschreibt @, Stand: @.
Installieren Sie @ mit dem folgenden Befehl: @.
Zuletzt aktualisiert: @.
Caro @, obrigado por escolher @.
Bem-vindo a @, publicado por @.
Esta página descreve @ desde @.
Última atualização: @.
Gentile @, grazie per aver scelto @.
Benvenuto su @, pubblicato da @.
Questa pagina descrive @ dal @.
Ultimo aggiornamento: @.
欢迎来到@，由@发布。
本页介绍@。
尊敬的@，感谢您选择@。
@へようこそ。このページでは@について説明します。
@様、@をお選びいただきありがとうございます。
""",
    "filler": """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua pellum vellor nulla vitae porta augue velit morbi nostra lectus tamen risus ornare turpis quis semper eget magnus facer enim minim veniam nisi commodo.
TODO: write this section
TBD, to be written
To do: fill in this part later.
Add your description in this box.
Type something about yourself here.
Your headline goes here
Your text goes here
Your content here
Click here to edit this text.
Coming soon.
Dummy content for layout purposes only.
Placeholder paragraph, final wording to follow.
This is sample text. Replace it with your own content.
Sample text sample text.
Text text text text text text text.
blah blah blah blah blah
asdf asdf asdf jkl jkl qwer qwerty
test test test test
foo foo foo bar bar baz
Hier steht später ein Text. Dies ist nur ein Blindtext.
Platzhaltertext, bitte ersetzen.
Texto de ejemplo. Sustituya este párrafo.
Escriba aquí su contenido.
Texte provisoire, à remplacer.
Votre texte ici. Texte d'exemple.
Texto de exemplo. Substitua este parágrafo.
Testo di esempio. Sostituire questo paragrafo.
Testo segnaposto, da sostituire.
此处填写内容。示例文本，请替换。
ここに本文を入力してください。ダミーテキストです。
""",
    "error": """
404 Not Found
Not Found (404)
Error 404: Page not found
The page you were looking for is not here.
Sorry, this page has moved or no longer exists.
This page does not exist
The page you requested could not be found.
This thread was deleted (410)
Gone. The link is dead or the thread was deleted.
Whoops, nothing here!
Oops! Something went wrong on our side.
We have been notified and are on it.
Check the spelling of the link.
Go back to the start page.
Error 502: Bad gateway
Error 502: Upstream failed
502 Bad Gateway. The upstream did not answer in time.
Error 500: Internal server error
The server could not handle your request.
HTTP 500 Server error
HTTP 403 - No permission
403 Forbidden
Access denied. You do not have permission to view this page.
Sign in and try again.
Your address has been blocked for 12 minutes.
Your request was blocked by the site owner (ray 12).
Too many requests. Slow down and try again in 12 seconds.
Unable to connect to the database.
Error establishing a database connection.
Please try again later.
Reload the page or go back.
Down for maintenance (503)
Service temporarily unavailable due to maintenance. Back in 12 minutes.
503 Service Unavailable
Request timed out while loading 12.
Gateway timeout
Checking your browser before you continue.
Error code: E12
Reference: 12.
Code 12.
Session expired. Please sign in again.
If this keeps happening, contact the site owner.
Error 429: Rate limit reached
Unauthorized (401)
401 Login required
HTTP 500 - Something broke
Warning: query() in /srv/app/12.php on line 12
Fatal error: uncaught exception in index.php on line 12
Status: 504
Warning: mysql connect failed
Erreur 500 : le serveur a rencontré un problème, réessayez plus tard.
Fehler 500: Auf dem Server ist ein Problem aufgetreten, versuchen Sie es später noch einmal.
Error 500: el servidor encontró un problema, vuelva a intentarlo más tarde.
Erro 500: o servidor encontrou um problema, tente novamente mais tarde.
Errore 500: il server ha riscontrato un problema, riprova più tardi.
Página no encontrada. El enlace que ha seguido ya no existe.
Acceso denegado.
Error interno del servidor. Inténtelo más tarde.
Servicio no disponible por mantenimiento.
Page introuvable. Le lien que vous avez suivi n'existe plus.
La page demandée n'existe pas.
Accès refusé. Erreur interne du serveur, veuillez réessayer plus tard.
Seite nicht gefunden. Die angeforderte Adresse existiert nicht.
Zugriff verweigert. Interner Serverfehler, bitte versuchen Sie es später erneut.
Página não encontrada. A ligação que seguiu já não existe.
Acesso negado. Erro interno do servidor, tente mais tarde.
Pagina non trovata. Il collegamento seguito non esiste più.
Accesso negato. Errore interno del server, riprovare più tardi.
页面未找到。您访问的页面不存在。
访问被拒绝。服务器内部错误，请稍后再试。
ページが見つかりません。お探しのページは存在しません。
アクセスが拒否されました。サーバーエラーです。しばらくしてからもう一度お試しください。
""",
    "script": """
JavaScript is required to view this page. Please enable JavaScript in your browser.
You need to enable JavaScript to run this app.
You need to turn on scripts in your browser to run this app.
JavaScript is disabled in your browser.
Your browser has it switched off. Please enable it and reload.
Activate it and reload, ref 12.
Scripts and cookies must be allowed.
Allow scripts and cookies, then refresh.
See how to turn it on in your settings.
We are sorry, but the viewer doesn't work properly without scripts enabled.
Our web app cannot be shown while scripts are blocked.
The document browser requires scripts to be enabled.
The viewer requires JavaScript to be enabled.
This site needs JavaScript to work. Please reload.
This site works only with JavaScript.
The forum works only with JavaScript switched on.
This page needs JavaScript.
To read on, this site depends on client-side scripting.
To read on, this site needs JavaScript.
This page will not load because JavaScript is turned off in your browser.
Turn on JavaScript to continue.
Veuillez activer JavaScript pour afficher ce contenu.
Active JavaScript en su navegador para continuar.
Bitte aktivieren Sie JavaScript, um diese Seite zu nutzen.
Attivate JavaScript nel browser per continuare.
Ative o JavaScript no navegador para continuar.
Your browser does not support JavaScript.
Active JavaScript para ver esta página. Esta aplicación necesita JavaScript.
Debe activar JavaScript en su navegador.
Activez JavaScript pour afficher cette page. Cette application nécessite JavaScript.
Veuillez activer JavaScript dans votre navigateur.
Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen. Diese Anwendung benötigt JavaScript.
Ative o JavaScript para ver esta página. Este site precisa de JavaScript.
Attiva JavaScript per vedere questa pagina. Questo sito richiede JavaScript.
请启用JavaScript以查看此页面。本网站需要JavaScript。
このページを表示するにはJavaScriptを有効にしてください。
""",
    "chrome": """
Home | Docs | Login
Menu Search
Back to home
Powered by Engine 2.1
All rights reserved.
(c) Name
Privacy Terms Imprint
""",
    "explain": """
In a template, a pair of braces such as @ is filled in by the engine.
Replace @ in the command below by the name of your bucket, for example name.
Use %s or @ in the format string and pass name as the argument.
echo @ > out.txt
print(f"name failed: @")
The TODO in src/name.py was closed last week.
The string "Access denied" comes from name and is shown only to guests.
A noscript block tells readers to enable JavaScript; ours is rendered by name.
The handler returns 404 Not Found when the key is missing.
Lorem ipsum is the usual filler text in layouts.
""",
}


@dataclass(frozen=True)
class Params:
    """threshold: containment at which a window counts as its exemplar's residue; ph_threshold: the same for windows that hold
    a placeholder; coverage: share of the text's characters in residue windows from which the text is mainly residue;
    prior: number of documents that the guess of a token's frequency by its length counts for; ph_weight: idf of the placeholder sign."""

    threshold: float = 0.62
    ph_threshold: float = 0.42
    coverage: float = 0.5
    prior: float = 20.0
    ph_weight: float = 18.0


@dataclass
class Index:
    labels: list[str]
    postings: dict[str, list[int]]
    idf: dict[str, float]
    unseen: float
    sizes: list[float]
    keys: set[str]  # the longer tokens, and the rarest ones of each exemplar: a window that holds none is no evidence on its own
    params: Params


@lru_cache(1 << 16)
def _forms(t: str) -> tuple[str, ...]:
    if t == PH:
        return (t,)
    if not t.isascii() and CJK.search(t):
        return tuple(t[i : i + 2] for i in range(max(1, len(t) - 1)))
    if t.isdigit():
        return ("0",)
    return () if NAME.search(t) else (t.lower(),)


def _tokens(s: str) -> list[str]:
    """Lower-cased words, numbers as 0, runs of Chinese or Japanese as bigrams; identifiers are names and left out."""
    return [x for t in TOKEN.findall(s) for x in _forms(t)]


def _vocabulary_in(low: str, wanted: frozenset[str] | set[str]) -> set[str]:
    """The wanted tokens in a lower-cased text."""
    found = set(WORDS.findall(low))
    if not low.isascii() and CJK.search(low):
        for t in [t for t in found if not t.isascii()]:
            found.update(t[i : i + 2] for i in range(len(t) - 1))
    return found & wanted


def exemplars() -> list[tuple[str, set[str]]]:
    return [(label, set(_tokens(line.replace("@", PH).replace("JavaScript", "Javascript")))) for label, lines in EXEMPLARS.items() for line in lines.strip().split("\n")]


VOCABULARY = frozenset().union(*(t for _, t in exemplars()))


def document_frequencies(df: DataFrame, text: str = "text") -> tuple[int, dict[str, int]]:
    """Distinct texts in all, and with each token of the exemplar vocabulary (a fixed set, so the result is bounded).

    Only a digest and the vocabulary of each text are shuffled.
    """

    def vocabulary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"h": b["h"], "tokens": [["", *_vocabulary_in(t.lower(), VOCABULARY)] for t in b[text]]})

    texts = spread(df.select(text).where(F.col(text).isNotNull() & (F.col(text) != ""))).select(F.unhex(F.md5(text)).alias("h"), text)
    each = texts.mapInPandas(vocabulary, "h binary, tokens array<string>").groupBy("h").agg(F.first("tokens").alias("tokens"))
    n = {r.token: r.n for r in each.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    return n.pop("", 0), n


def build_index(n_docs: int, df: dict[str, int], params: Params = Params()) -> Index:
    ex = exemplars()
    # without documents the idf is a guess by the token's length, which counts as ``prior`` documents beside the corpus
    idf = {t: math.log((params.prior + n_docs) / (params.prior * math.exp(-0.7 - 0.4 * min(len(t), 8)) + df.get(t, 0))) + 0.3 for t in VOCABULARY}
    idf[PH] = params.ph_weight
    idf["0"] = 1.0
    unseen = max(5.0, min(math.log(1 + max(n_docs, 1)), 9.0))
    postings: dict[str, list[int]] = {}
    sizes: list[float] = []
    keys = {t for t in VOCABULARY if len(t) > 3 or not t.isascii()}
    for k, (_, tokens) in enumerate(ex):
        own: set[str] = set()
        for t in sorted(tokens, key=lambda t: (-idf[t], t)):
            postings.setdefault(t, []).append(k)
            if sum(idf[x] for x in own) < 0.5 * sum(idf[x] for x in tokens):
                own.add(t)
        sizes.append(sum(idf[t] for t in tokens))
        keys |= own
    return Index([label for label, _ in ex], postings, idf, unseen, sizes, keys, params)


def _holds_placeholder(text: str) -> bool:
    """Whether a placeholder stands outside of fenced code and code spans."""
    for m in PLACEHOLDER.finditer(text):
        line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
        if line.count("`") % 2 == 0 and not CODE.search(line):
            return True
    return False


def match(window: list[str], ix: Index) -> tuple[float, str, bool]:
    """Best containment over all exemplars, its label, and whether the window holds a key. Of exemplars with as
    much of the window, the one it holds most of wins, and explanations before others."""
    tokens = set(window)
    known = [(t, ix.idf[t]) for t in tokens if t in ix.idf]
    weight = sum(w for _, w in known)
    whole = weight + ix.unseen * (len(tokens) - len(known))
    if weight < min(ix.params.threshold, ix.params.ph_threshold) * whole or not known:  # no exemplar can reach a threshold
        return 0.0, "", False
    got: dict[int, float] = {}
    for t, w in known:
        for k in ix.postings[t]:
            got[k] = got.get(k, 0.0) + w
    best = max(got, key=lambda k: (round(got[k], 9), round(got[k] / ix.sizes[k], 9), ix.labels[k] == "explain"))
    return got[best] / whole, ix.labels[best], not tokens.isdisjoint(ix.keys)


def judge(text: str | None, ix: Index) -> tuple[bool, str, float, int]:
    """Residue or not, its kind, the share of the text in residue windows, and the number of filled-in-nowhere placeholders."""
    if not isinstance(text, str) or not text or text.isspace():
        return False, "", 0.0, 0
    has_ph = _holds_placeholder(text)
    body = text.replace("JavaScript", "Javascript").replace("\r", "").replace("\ufeff", "")
    if "`" in body or "~~~" in body:
        body = TICKED.sub("  ", FENCED.sub("\n", body))
    if not body.strip():
        return False, "", 0.0, 0
    p = ix.params
    code = 0
    windows: list[str] = []
    for line in body.split("\n"):
        if not line or line.isspace():
            continue
        if CODE.search(PLACEHOLDER.sub(" ", line) if has_ph else line):
            code += len(line)
            continue
        if '"' in line or "“" in line or "«" in line:
            n = 0.8 * len(line.strip())
            line = QUOTED.sub(lambda m: m[0] if len(m[0]) > n else "  ", line)
        marked = TAG.sub(" . ", PLACEHOLDER.sub(PH, line) if has_ph else line) if "<" in line or has_ph else line
        windows.extend(w for w in WINDOW.split(marked) if w and not w.isspace())
    whole = code + sum(len(w.strip()) for w in windows)
    covered = chrome = placeholders = 0
    kinds: Counter = Counter()

    evidence = False
    for w in windows:
        toks = _tokens(w)
        if not toks:
            continue
        size = len(w.strip())
        share, label, keyed = match(toks, ix)
        if PH in toks:
            if label != "explain" and share >= p.ph_threshold:
                placeholders += 1
                kinds["placeholder"] += size
                covered += size
                evidence = True
        elif share >= p.threshold and label not in ("explain", "placeholder"):
            if label == "chrome":
                chrome += size
            else:
                covered += size
                kinds[label] += size
                evidence = evidence or keyed
    if not evidence:  # windows without a key count only beside others
        return False, "", 0.0, placeholders
    cover = covered / max(1, whole - chrome)
    hit = placeholders > 0 and code < 0.5 * whole or cover >= p.coverage
    return hit, "placeholder" if placeholders else kinds.most_common(1)[0][0], round(min(cover, 1.0), 6), placeholders


SCHEMA = "is_residue boolean, residue_kind string, residue_coverage double, n_placeholders int"


def detect(df: DataFrame, text: str = "text", keep: list[str] | None = None, index: Index | None = None, params: Params = Params()) -> DataFrame:
    """``keep`` columns of ``df`` (all by default) with is_residue, residue_kind, residue_coverage and n_placeholders."""
    names = [c for c in (keep if keep is not None else df.columns) if c not in ("is_residue", "residue_kind", "residue_coverage", "n_placeholders")]
    ix = index or build_index(*document_frequencies(df, text), params)
    carry = df.select(*dict.fromkeys([*(F.col(f"`{c}`") for c in names)])) if text in names else df.select(*(F.col(f"`{c}`") for c in names), F.col(text))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carry.schema if f.name in names)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        r = [judge(t, ix) for t in b[text]]
        out = b[names].copy()
        for k, c in enumerate(("is_residue", "residue_kind", "residue_coverage", "n_placeholders")):
            out[c] = [x[k] for x in r]
        return out

    return rows_by_batch(carry, run, ", ".join(x for x in (fields, SCHEMA) if x))


def p9_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"), keep=["doc_id"]).where("is_residue").select("doc_id")


QUERIES = {"p9_residue": p9_residue, "p9_found": p9_found}
