"""Broken prompt and response pairs (problem 6).

For each defect a few noisy labelling functions vote 1 (defect), -1 (no defect) or
0 (no opinion).  A label model fitted by expectation-maximization over the counts
of vote patterns (at most 3^4 patterns a defect, counted over all pairs) learns how
far each function can be trusted and gives a posterior for each pattern.  A pair
keeps every defect whose posterior exceeds the cutoff that did best on the labelled
validation pairs below; the strongest one comes first.

Defined results: a null response is empty; a null instruction counts as no
instruction (nothing is copied from it and any language may answer it).  Pairs that
arrive again under the same chat_id give one row, that of the last arrival.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language as lid
from millrace.llm.common import LANGS, table
from millrace.runtime import materialize, spread

DEFECTS = ["empty", "copy", "refusal", "other_language", "truncated"]
N_VOTES = 4  # labelling functions of each defect

NOTHING = frozenset(
    "no answer|no response|no reply|not available|not applicable|no content|no output|blank|nothing|void|keine|kein|keine antwort|sin respuesta|ninguna|ninguno|nada|aucune|aucun|rien|sans réponse|sem resposta|nenhum|nenhuma|nessuna|nessuno|niente|nessuna risposta|无|无回答|没有|なし|回答なし".split("|")
) | frozenset("n/a na none null nil nan empty undefined missing tbd todo".split())
FENCE = re.compile(r"```[^\n]*\n?|~~~[^\n]*\n?")
BLOCK = re.compile(r"```[^\n]*\n.*?(?:\n[ \t]*```|\Z)", re.S)
SIGNS = re.compile(r"[^\w]+", re.S)
LIST_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+(.*)$")
CLOSED = re.compile(r"[.!?:…。！？；][\"'”’»)\]`*_]*$|[。！？]$")
IDENTIFIER = re.compile(r"^[`'\"]?[\w./@:-]+[`'\"]?$")
OPEN_WORDS = frozenset(
    "the a an of to in on at for from with by and or but that which who whose as is are was were be been has have had will would can could may must should its their this these those than then once when if while because before after into onto about it we you i not no never only so such both between through".split()
    + "el la los las un una de del al en con por para que y o se su sus como más sin sobre hasta mientras cuando si ya lo le le les des du une et ou dans sur pour par avec qui ne pas plus est sont ce cette son sa ses tant si avant après der die das den dem ein eine einen und oder nicht auf mit von zu für im am ist sind wird werden dass sich auch es wenn weil nach vor os as um uma do da dos das em no na nos nas com que não e ou mais se il lo gli i di che è una del della dei nel per con su non si come più alla al".split()
)

REFUSE = re.compile(
    r"\b(?:i(?:'m| am)? ?(?:can ?not|can't|cant|won't|will not|would rather not|'d rather not|must decline|have to (?:refuse|decline)|refuse|decline|am not (?:able|allowed|permitted|comfortable)|'m not (?:able|allowed|permitted|comfortable)|not (?:able|allowed|permitted) to|am unable|'m unable|don't feel comfortable|do not feel comfortable|cannot))\b(?! (?:to )?(?:reproduce|tell|see|remember|recall|find|say|confirm|guarantee|promise|explain why|be sure))"
    r"|\b(?:isn't|is not|not) (?:possible for me|something i)|\bgo(?:es)? against my|against my (?:rules|guidelines|policy|principles)|my (?:guidelines|rules|policy) (?:don't|do not|doesn't|does not) allow|\bno comment on this|request (?:can't|cannot|can not) be fulfilled|\bi(?:'d| would) rather not|\bwon't be able to|\bi must decline|\bcan(?:'t|not) (?:help|assist|answer|do|comply|provide|share|fulfil|support|write|discuss)\b"
    r"|\bno puedo\b.*\b(?:ayud|respond|contest|hacer|proporcion)|no me es posible|no me está permitido|no estoy autorizad|debo (?:rechazar|negarme)|me niego"
    r"|(?:ne (?:peux|puis) pas|ne suis pas (?:en mesure|autorisé)|m'est (?:impossible|pas possible|pas permis|interdit))|je (?:dois )?refuse|je dois (?:refuser|décliner)"
    r"|\b(?:kann|darf|möchte|werde) (?:ich )?(?:\w+ ){0,5}nicht\b.*|nicht (?:helfen|beantworten|möglich|erlaubt)|(?:darf|kann) ich nicht|muss ich ablehnen|ich muss (?:das |dies )?ablehnen"
    r"|não (?:posso|me é (?:permitido|possível)|consigo)|tenho de recusar|sou obrigado a recusar|recuso"
    r"|non (?:posso|mi è (?:consentito|possibile|permesso)|sono (?:in grado|autorizzato))|devo rifiutare|mi rifiuto"
    r"|无法(?:回答|提供|帮助|协助|完成|满足)|不能(?:提供|回答|帮助|协助|满足)|拒绝|不便|できません|お答えできない|いたしかねます|お断り|対応できない",
    re.I,
)
#: Pieces of which every refusal, apology or offer of the patterns here holds one, in lower case: lines without any needn't be searched.
REFUSE_SIGNS = "n't|not|cant|refus|declin|unable|against|no |no\t|niego|negar|rechaz|pas|impossible|interdit|nicht|ablehn|não|recus|non|rifiut|无法|不能|拒绝|不便|できません|できない|かねます|断り".split("|")
SORRY_SIGNS = "sorry|apologi|unfortunat|afraid|regret|thanks|as a|lo siento|lamento|désol|malheureu|leid|entschuld|desculp|infeliz|dispiace|purtroppo|spiacente|抱歉|对不起|遗憾|申し訳|すみません|残念".split("|")
OFFER_SIGNS = "rephras|else|understand|wrong way|expert|try |misused".split("|")
ASKED_SIGNS = "engl|angl|ingl|英|span|españ|espagn|espan|spagn|castell|西|スペ|fren|franc|franç|franz|法语|フラ|germ|alem|allem|deuts|tedes|德|ドイ|port|葡|ポル|ital|意|イタ|chin|cines|中|汉|japan|japon|japao|giapp|日|jap".split("|")
SORRY = re.compile(r"\b(?:sorry|apologi[sz]e|unfortunately|i'm afraid|i am afraid|regret|thanks for asking|as an? (?:ai|assistant|language model)|lo siento|lamento|désolée?|je regrette|malheureusement|tut mir leid|leider|entschuldig|desculpe|infelizmente|mi dispiace|purtroppo|spiacente)\b|抱歉|对不起|很遗憾|申し訳|すみません|残念", re.I)
OFFER = re.compile(r"rephras|is there anything else|anything else i can|hope you understand|used in the wrong way|consult an expert|ask someone else|try (?:again|another)|might be misused|happy to help with something else", re.I)

#: Languages that an instruction may ask for, by their names (fixed values).
ASKED = {
    "en": r"english|inglés|inglese|anglais|englisch|inglês|英语|英文|英語", "es": r"spanish|español|espagnol|spanisch|espanhol|spagnolo|castellano|西班牙语|スペイン語",
    "fr": r"french|francés|français|französisch|francês|francese|法语|フランス語", "de": r"german|alemán|allemand|deutsch|alemão|tedesco|德语|ドイツ語",
    "pt": r"portuguese|portugués|portugais|portugiesisch|português|portoghese|葡萄牙语|ポルトガル語", "it": r"italian|italiano|italien|italienisch|意大利语|イタリア語",
    "zh": r"chinese|chino|chinois|chinesisch|chinês|cinese|中文|汉语|中国語", "ja": r"japanese|japonés|japonais|japanisch|japonês|giapponese|日语|日本語",
}
ASKED_RX = {k: re.compile(rf"\b(?:{v})\b" if k not in ("zh", "ja") else rf"(?:{v})", re.I) for k, v in ASKED.items()}
#: Frequent words of requests and answers that short texts may hold instead of the most common words (fixed values).
REQUEST_WORDS = {
    "en": "how what which why where who does do did could should name show write give explain set make me my its function list line line's file error first read used needs run called between than into out after before because then each both thanks nothing",
    "es": "qué cómo cuál cuáles dónde quién explica escribe dame muestra sirve falla función lista cambio llamada hace falta desde hemos nuestro equipo hay dos ahora si",
    "fr": "comment pourquoi quel quelle quels où explique écris donne montre sert fonction liste cela nommée si entre depuis vous voulez chaque notre nos avons perd il fallu",
    "de": "wie warum was welche welcher wo wozu dient erkläre schreibe zeige gib funktion liste namens kürzt ich wir wenn unser haben gesehen seit wird etwa jeder man sollte dank läuft alles",
    "pt": "como qual quais onde quem explica escreve mostra serve função lista mudo chamada falha desde cada nossa equipa vimos se quiser agora há duas já preciso",
    "it": "come perché quale quali dove chi spiega scrivi mostra serve funzione lista cambio chiamata che cosa tra dalla ogni nostro gruppo abbiamo visto se volete adesso ci sono due",
}
KANA, HAN = re.compile(r"[぀-ヿ]"), re.compile(r"[一-鿿]")
LETTERS = {"es": re.compile(r"[ñ¿¡]|ción\b|\b(?:está|más)\b"), "pt": re.compile(r"[ãõ]|ção\b|\b(?:não|você)\b"), "de": re.compile(r"[ßäöü]"), "fr": re.compile(r"[çœêûî]|\b(?:à|où)\b|[dlnsc]['’][a-zéèê]"), "it": re.compile(r"[òìù]\b|\bè\b|\bperché\b|zione\b|\bpiù\b")}
NAMES = re.compile(r"`[^`\n]*`|\b\w*_\w+\b|\b[a-z]+[A-Z]\w*|\b[\w.-]+/[\w./-]+|\b\d[\w.]*")


def word_lists(common: dict[str, list[str]]) -> dict[str, frozenset[str]]:
    return {k: frozenset(w.lower() for w in common.get(k, ())) | frozenset(REQUEST_WORDS.get(k, "").split()) for k in LANGS}


def says(rx: re.Pattern, signs: list[str], text: str) -> bool:
    """Whether a pattern that stays within a line is found: only lines that hold one of its signs are searched."""
    low = text.lower()
    if not any(x in low for x in signs):
        return False
    return any(rx.search(line) for line in text.split("\n") if any(x in line.lower() for x in signs)) if "\n" in text else bool(rx.search(text))


def natural(text: str) -> str:
    """The natural-language part of a text: no code, no names of things."""
    text = BLOCK.sub("\n", text) if "```" in text else text
    if lid.is_code(text):
        return ""
    lines = [x for x in text.split("\n") if not lid.code_line(x) or CLOSED.search(x) and not x.rstrip().endswith((";", ":"))]
    return NAMES.sub(" ", "\n".join(lines))


def by_words(text: str, common: dict[str, frozenset[str]]) -> tuple[str | None, float]:
    """Language by script or by common words, with the lead over the next."""
    if KANA.search(text):
        return "ja", 9.0
    if len(HAN.findall(text)) >= 2:
        return "zh", 9.0
    words = re.findall(r"[^\W\d_]+", text.lower())
    tally = Counter(words)
    got = sorted(((sum(n for w, n in tally.items() if w in own), k) for k in LANGS[:6] for own in (common.get(k, frozenset()),)), reverse=True)
    if not words or got[0][0] == 0:
        return None, 0.0
    return got[0][1], float(got[0][0] - got[1][0])


def by_letters(text: str) -> str | None:
    """Language by letters that only it uses."""
    if KANA.search(text):
        return "ja"
    if len(HAN.findall(text)) >= 2:
        return "zh"
    low = text.lower()
    plain = low.isascii()  # then only French elisions and an Italian ending can be there
    hits = {k: 0 if plain and k in ("es", "pt", "de") else len(rx.findall(low)) for k, rx in LETTERS.items()}
    best = max(hits, key=hits.get)
    others = sorted(hits.values())[-2]
    return best if hits[best] > others else None


def key_of(text: str) -> str:
    return SIGNS.sub(" ", text.casefold()).strip()


def _is_code(text: str) -> bool:
    lines = [x for x in text.split("\n") if x.strip()]
    return bool(lines) and (lid.is_code(text) or sum(map(lid.code_line, lines)) >= 0.6 * len(lines) and ("\n" in text.strip() or text.rstrip().endswith((";", "}", "{", "("))))


def depth(code: str) -> int:
    """Brackets left open in code, outside of strings."""
    code = re.sub(r"\"[^\"\n]*\"|'[^'\n]{0,40}'", "", code)
    return max((code.count(a) - code.count(b) for a, b in ("()", "[]", "{}")), default=0)


def vote_empty(r: str | None, _: str | None) -> list[int]:
    if r is None:
        return [1, 1, 1, 1]
    bare = r.translate(lid_invisible).strip()
    inner = FENCE.sub("", bare).strip().strip("\"'“”«»()<>[]{}`*_ ").strip()
    words = inner.casefold().rstrip(".!")
    nothing = words in NOTHING or not any(c.isalnum() for c in inner)
    return [1 if not bare else -1 if len(bare) > 20 else 0, 1 if nothing else -1, 1 if not any(c.isalnum() for c in inner) else -1 if len(inner) > 3 else 0, 1 if len(inner) <= 12 and nothing else -1]


lid_invisible = str.maketrans(dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD, 0xA0], None))


def vote_copy(r: str | None, i: str | None) -> list[int]:
    if not r or not i or not (k := key_of(i)):
        return [0, 0, 0, -1]
    a = key_of(r)
    b = re.sub(r"^(?:q|question|instruction|prompt|user|frage|pregunta|pergunta|domanda|问题|問題|质问) ", "", a)
    times = 0
    rest = b
    while rest.startswith(k):
        times += 1
        rest = rest[len(k) :].strip()
    whole = times > 0 and not rest
    tight = a.replace(" ", "") == k.replace(" ", "")
    wa, wk = Counter(b.split()), Counter(k.split())
    inside = sum((wa & wk).values())
    same = inside >= 0.95 * max(1, sum(wa.values())) and inside >= 0.9 * sum(wk.values())
    near = abs(len(b) - len(k)) <= 0.15 * len(k) and (b.startswith(k[: int(0.9 * len(k))]) or k.startswith(b) and len(b) > 0.85 * len(k))
    changed = same and not whole and not tight  # other numbers or other order: an answer such as mended code
    return [1 if whole or tight else -1, 1 if same and not changed else -1, 1 if near and (whole or tight or not changed and "\n" not in i) else -1 if not near and not whole else 0, 1 if whole else -1 if rest and len(rest) > 10 else 0]


def vote_refusal(r: str | None, _: str | None) -> list[int]:
    if not r or not r.strip():
        return [-1, -1, -1, -1]
    low = r.replace("’", "'").replace("‘", "'")
    refuse, sorry, offer = says(REFUSE, REFUSE_SIGNS, low), says(SORRY, SORRY_SIGNS, low), says(OFFER, OFFER_SIGNS, low)
    names = bool(NAMES.search(low)) or "```" in low
    n = len(low.split()) if low.isascii() else max(len(low.split()), len(low) // 6)
    return [-1 if not refuse else 1 if not names or n <= 20 else 0, 1 if sorry and not names else 0 if sorry or refuse else -1, 1 if refuse and offer else 0 if refuse else -1, -1 if names or n > 45 else 1 if refuse and n <= 45 else 0]


def vote_truncated(r: str | None, i: str | None, vocabulary: frozenset[str] = frozenset()) -> list[int]:
    if not r or not r.strip():
        return [-1, -1, -1, -1]
    s = r.rstrip()
    fences = len(re.findall(r"^[ \t]*```", s, re.M))
    code_tail = fences % 2 == 1
    tail = s.rsplit("```", 1)[-1].split("\n", 1)[-1] if code_tail else "" if s.endswith("```") else s.rsplit("```", 1)[-1].strip() if fences else s
    bare_code = not fences and _is_code(s)
    lines = [x for x in s.split("\n") if x.strip()]
    last = lines[-1]
    item = LIST_ITEM.match(last)
    words = last.split()
    whole_code = bare_code or code_tail
    # 1: how the structure ends
    if code_tail:
        v1 = 1
    elif bare_code:
        v1 = 1 if depth(s) > 0 or s.endswith((":", ",", "(", "[", "{", "=", "+", ".", "&&", "||", "->", "=>")) or re.search(r"\b(?:SELECT|CREATE|UPDATE|INSERT|DELETE)\b", s) and not s.endswith(";") else -1
    elif s.endswith("```"):
        v1 = -1
    else:
        v1 = 0 if not CLOSED.search(last) else -1
    # 2: how the last line ends
    if s.endswith("```") or whole_code:
        v2 = v1
    elif item:
        v2 = 1 if (item[1].split() or ["the"])[-1].lower() in OPEN_WORDS or not item[1].strip() else -1
    elif CLOSED.search(last):
        v2 = -1
    elif len(lines) == 1 and (IDENTIFIER.match(s) or len(words) <= 2 and not re.search(r"[぀-ヿ一-鿿]", s)):
        v2 = -1
    else:
        v2 = 1
    # 3: the last word
    m = re.search(r"([^\W\d_]+|[\w]+)[^\w]*$", s)
    word = m[1] if m else ""
    v3 = 0
    if not whole_code and not s.endswith("```") and not CLOSED.search(last) and not (len(lines) == 1 and IDENTIFIER.match(s)):
        if s.endswith((",", "-", "(", "[", "`", "/", "_")) and last.count("`") % 2 == 1 or s.endswith((",", "-", "(", "/", "_")):
            v3 = 1
        elif word.lower() in OPEN_WORDS and len(words) > 1:
            v3 = 1
        elif word.isascii() and word.islower() and vocabulary and word not in vocabulary and len(words) > 2:
            v3 = 1
    elif whole_code:
        ids = re.findall(r"[A-Za-z_]\w{2,}", s)
        if ids and s.endswith(ids[-1]) and ids[-1] not in ids[:-1] and any(x != ids[-1] and x.startswith(ids[-1]) for x in ids[:-1]):
            v3 = 1
        elif v1 == -1:
            v3 = -1
    elif CLOSED.search(last) or s.endswith("```"):
        v3 = -1
    # 4: a list item that is shorter than a whole one, or quotes left open
    v4 = 0
    if item and len(lines) > 1:
        others = [len(x[1].split()) for x in map(LIST_ITEM.match, lines[:-1]) if x]
        if others and len(item[1].split()) < min(others) and len(item[1].split()) < 3:
            v4 = 1
        elif v3 != 1 and v2 == -1:
            v4 = -1
    elif s.count("`") % 2 == 1 and fences % 2 == 0 and not whole_code:
        v4 = 1
    elif v1 == -1 and v2 == -1 and v3 != 1:
        v4 = -1
    elif v2 == 1 and len(words) >= 3:
        v4 = 1
    if item and v3 == 1:
        v2 = 1
    return [v1, v2, v3, v4]


def vote_language(r: str, i: str, common: dict, probs: tuple | None, parts: tuple[str, str]) -> list[int]:
    """``parts``: the natural-language parts of the instruction and of the response."""
    if not r or not i:
        return [0, 0, 0, -1]
    a, b = natural(i.split("\n")[0]) if "\n" in i and "code" in i.lower()[:60] else parts[0], parts[1]
    if len(re.findall(r"[^\W\d_]+", b)) < 4 and len(HAN.findall(b)) + len(KANA.findall(b)) < 4:
        return [-1, -1, -1, -1]  # too little natural language
    low = i.lower()
    asked = {k for k, rx in ASKED_RX.items() if rx.search(i)} if any(x in low for x in ASKED_SIGNS) else set()
    la, da = by_words(a, common)
    lb, db = by_words(b, common)
    v1 = 0 if la is None or lb is None or min(da, db) < 2 else -1 if lb == la or lb in asked else 1
    ca, cb = by_letters(a), by_letters(b)
    v2 = 0 if cb is None and ca is None else -1 if cb == ca or cb in asked else 1 if cb and (ca or la == "en" and cb != la) else 1 if ca and lb and lb != ca and ca not in asked and not asked else 0
    if cb and lb == cb and la == cb:
        v2 = -1
    v3 = 0
    if probs is not None:
        (pa, qa), (pb, qb) = probs
        v3 = 0 if min(qa, qb) < 0.7 else -1 if pa == pb or pb in asked else 1
    v4 = -1 if asked and (lb in asked or lb == la) else 0
    return [v1, v2, v3, v4]


class LabelModel:
    """Naive-Bayes label model: a prior and, for each function, the chances of its votes with and without the defect."""

    def __init__(self, prior: float = 0.03):
        self.prior = prior
        self.with_defect = np.tile([0.15, 0.25, 0.60], (N_VOTES, 1))  # votes -1, 0, 1
        self.without = np.tile([0.70, 0.28, 0.02], (N_VOTES, 1))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        at = votes + 1
        k = np.arange(votes.shape[1])
        a = np.log(self.prior) + np.log(self.with_defect[k, at]).sum(1)
        b = np.log1p(-self.prior) + np.log(self.without[k, at]).sum(1)
        return 1 / (1 + np.exp(np.clip(b - a, -500, 500)))

    def fit(self, votes: np.ndarray, counts: np.ndarray, rounds: int = 25, strength: float = 0.02) -> LabelModel:
        """EM over vote patterns; the start values count as ``strength`` of all pairs, so that functions keep their sense."""
        n = counts.sum()
        base_with, base_without = self.with_defect.copy(), self.without.copy()
        for _ in range(rounds):
            p = self.posterior(votes)
            w, u = counts * p, counts * (1 - p)
            self.prior = float(np.clip((w.sum() + 0.03 * strength * n) / (n * (1 + strength)), 1e-4, 0.5))
            for j in range(votes.shape[1]):
                for v in range(3):
                    m = votes[:, j] == v - 1
                    self.with_defect[j, v] = (w[m].sum() + base_with[j, v] * strength * n) / (w.sum() + strength * n)
                    self.without[j, v] = (u[m].sum() + base_without[j, v] * strength * n) / (u.sum() + strength * n)
                # a function keeps its sense: its vote for a defect never speaks against it, and no opinion says little
                ratio = np.clip(self.with_defect[j] / self.without[j], [1e-4, 0.7, 3.0], [0.5, 1.4, 1e4])
                self.with_defect[j] = ratio * self.without[j]
                self.with_defect[j] /= self.with_defect[j].sum()
        return self


#: Labelled pairs on which the cutoffs are chosen: instruction, response, defect (or none).
VALIDATION = [
    ("How do I sort a list?", None, "empty"), ("How do I sort a list?", "  \n", "empty"), ("How do I sort a list?", "N/A", "empty"), ("How do I sort a list?", "...", "empty"), ("How do I sort a list?", "[]", "empty"), ("How do I sort a list?", "(no answer)", "empty"), ("Is it on?", "Yes.", None), ("How many rows are kept?", "42", None), ("Which file?", "src/app/main.rs", None), ("Which name?", "`load_index`", None),
    ("How do I sort a list?", "HOW DO I SORT A LIST?", "copy"), ("How do I sort a list?", "Q: How do I sort a list?", "copy"), ("How do I sort a list?", "How do I sort a list? How do I sort a list?", "copy"), ("How do I sort a list?", "How do I sort a list? Call the sort function on it.", None), ("Fix the number in this code:\nx = 3", "x = 4", None), ("Explain the loop in two words.", "It repeats.", None),
    ("Write a plan.", "I'm sorry, but I can't help with that.", "refusal"), ("Write a plan.", "I am not permitted to talk about this subject. Try rephrasing your question.", "refusal"), ("Escribe un plan.", "Lo siento, pero no puedo ayudarte con eso.", "refusal"), ("Schreibe einen Plan.", "Diese Anfrage darf ich nicht beantworten.", "refusal"), ("写一个计划。", "抱歉，我无法回答这个问题。", "refusal"), ("Can the job run twice?", "It does not.", None), ("Can I call it twice?", "You cannot call load_index twice, because the lock is held until the job has finished.", None),
    ("How do I start the service?", "El servicio se inicia con la orden de la guía y después se espera hasta que la cola esté lista.", "other_language"), ("¿Cómo inicio el servicio?", "You start the service with the command in the guide and then you wait for it.", "other_language"), ("Translate into Spanish: the service is ready.", "El servicio está listo para su uso en la red.", None), ("Wie starte ich den Dienst?", "Der Dienst wird mit dem Befehl aus der Anleitung gestartet und läuft dann weiter.", None), ("Wie starte ich den Dienst?", "The service is started with the command from the guide and it runs until the end.", "other_language"),
    ("How do I start it?", "You start the service with the", "truncated"), ("How do I start it?", "The service reads the file once, keeps it in memory and never looks ba", "truncated"), ("Write it.", "```\ndef f(x):\n    return [x for x in", "truncated"), ("Write it.", "def f(x):\n    out = []\n    out.append(x[", "truncated"), ("Write it.", "def f(x):\n    out = []\n    out.append(x)\n    return out", None), ("Name steps.", "Do this:\n- join the queue\n- sort the list\n- close the file", None), ("How do I start it?", "You start it with the command. It then runs for good.", None), ("Write it.", "SELECT a, b\nFROM t\nWHERE a >", "truncated"), ("Write it.", "Use this.\n```python\nx = 3\n```", None),
]


def _votes(instructions: list, responses: list, common: dict, model: lid.Model | None, vocabulary: frozenset[str]) -> list[list[list[int]]]:
    """For each pair, the votes on each defect."""
    probs: list[tuple | None] = [None] * len(responses)
    parts = [natural(x) if isinstance(x, str) else "" for pair in zip(instructions, responses) for x in pair]
    if model is not None:
        sums = model.sums([lid.words_of(x) for x in parts])
        z = sums[:, : lid.N_NATURAL] / np.maximum(sums[:, -1:], 1) + model.bias[: lid.N_NATURAL]
        latin = np.array([not (KANA.search(x) or HAN.search(x)) for x in parts], bool)
        z[np.ix_(latin, [6, 7])] = -30.0
        q = model.prob(z)
        top, conf = q.argmax(1), q.max(1)
        probs = [((LANGS[top[2 * i]], conf[2 * i]), (LANGS[top[2 * i + 1]], conf[2 * i + 1])) for i in range(len(responses))]
    out = []
    for i, r, p, own in zip(instructions, responses, probs, zip(parts[::2], parts[1::2])):
        i = i if isinstance(i, str) else None
        r = r if isinstance(r, str) else None
        out.append([vote_empty(r, i), vote_copy(r, i), vote_refusal(r, i), vote_language(r or "", i or "", common, p, own), vote_truncated(r, i, vocabulary)])
    return out


def response_words(chat: DataFrame, least: int = 6, share: float = 2e-6) -> frozenset[str]:
    """Lower-case words that stand inside of responses again and again: what a last word is held against.

    Counted over all responses. A word needs ``least`` occurrences and ``share`` of all; so there are at most 1 / share of them.
    """
    words = chat.select(F.explode(F.expr("regexp_extract_all(response, '(?<![\\\\w./-])[a-z]{2,24}(?=[ ,.;:!?])', 0)")).alias("w"))
    counts = materialize(words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return frozenset(r.w for r in counts.where(F.col("n") >= share * total).select("w").collect())


def fit_language(chat: DataFrame, common: dict[str, frozenset[str]], rows: int = 3000) -> lid.Model:
    """The subword classifier, fitted on a bounded sample of instructions and responses labelled by their common words."""
    got = lid.first_by_hash(chat.select("chat_id", "instruction", "response"), "chat_id", rows).toPandas()
    samples = []
    for col in ("instruction", "response"):
        for t in got[col]:
            if isinstance(t, str):
                n = natural(t)
                lang, lead = by_words(n, common)
                if lang and lead >= 2:
                    w = lid.words_of(n)
                    samples += [(w[k : k + lid.PIECE], lid.CLASSES.index(lang)) for k in range(0, len(w), lid.PIECE)]
    samples += [(sorted(ws), lid.CLASSES.index(k)) for k, ws in common.items() if k in LANGS and ws]
    return lid.train(samples, lid.Params(epochs=3))


def label(chat: DataFrame, common_words: DataFrame, seen: str = "received_at") -> DataFrame:
    """chat_id, defects (array of struct defect, posterior; strongest first) for each chat_id."""
    common = word_lists({r.language: r.w for r in common_words.groupBy("language").agg(F.collect_set("word").alias("w")).collect()})
    vocabulary = response_words(chat)
    model = fit_language(chat, common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = _votes(list(b["instruction"]), list(b["response"]), common, model, vocabulary)
            out = pd.DataFrame([["".join("-0+"[x + 1] for x in votes) for votes in row] for row in v], columns=DEFECTS)
            yield pd.concat([b[["chat_id", seen]].reset_index(drop=True), out], axis=1)

    kinds = chat.schema
    voted = spread(chat.select("chat_id", seen, "instruction", "response")).mapInPandas(run, f"chat_id {kinds['chat_id'].dataType.simpleString()}, {seen} {kinds[seen].dataType.simpleString()}, " + ", ".join(f"{d} string" for d in DEFECTS))
    # arrivals of one pair: the last one counts (votes are short, so this shuffle is small and combines before it)
    last = voted.groupBy("chat_id").agg(*(F.max_by(F.struct(*DEFECTS), F.struct(F.col(seen).isNotNull(), seen, *DEFECTS)).alias(x) for x in ("v",))).select("chat_id", "v.*")
    last = materialize(last, "votes")
    long = last.select(F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), F.col(d).alias("pattern")) for d in DEFECTS))).alias("x")).select("x.*")
    patterns = long.groupBy("defect", "pattern").count().collect()  # at most 5 * 3^4
    check = _votes([i for i, _, _ in VALIDATION], [r for _, r, _ in VALIDATION], common, model, vocabulary)
    strong: dict[tuple[str, str], float] = {}
    for k, d in enumerate(DEFECTS):
        own = [(r.pattern, r["count"]) for r in patterns if r.defect == d]
        if not own:
            continue
        votes = np.array([["-0+".index(c) - 1 for c in p] for p, _ in own])
        m = LabelModel().fit(votes, np.array([n for _, n in own], float))
        q = m.posterior(np.array([row[k] for row in check]))
        truth = np.array([t == d for _, _, t in VALIDATION])

        def f1(cut: float, q=q, truth=truth) -> float:
            hit = q >= cut
            return 2 * (hit & truth).sum() / max(1, hit.sum() + truth.sum())

        cut = max((0.5, 0.3, 0.7, 0.2, 0.8, 0.9, 0.1), key=f1)
        strong |= {(d, p): float(x) for (p, _), x in zip(own, m.posterior(votes)) if x >= cut}
    found = F.array()
    if strong:
        rank = {d: i for i, d in enumerate(DEFECTS)}
        maps = {d: F.create_map(*[F.lit(y) for (e, p), x in strong.items() if e == d for y in (p, x)]) if any(e == d for e, _ in strong) else None for d in DEFECTS}
        found = F.array_compact(F.array(*(F.when(maps[d][F.col(d)].isNotNull(), F.struct(maps[d][F.col(d)].alias("posterior"), F.lit(-rank[d]).alias("rank"), F.lit(d).alias("defect"))) for d in DEFECTS if maps[d] is not None)))
    return last.select("chat_id", F.sort_array(found, asc=False).alias("defects")) if strong else last.select("chat_id", F.lit(None).cast("array<struct<posterior:double,rank:int,defect:string>>").alias("defects"))


def p6_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = label(table(spark, sf_dir, "coding_chat"), table(spark, sf_dir, "common_words"))
    return got.select("chat_id", F.expr("transform(defects, d -> struct(d.defect as defect, round(d.posterior, 6) as posterior))").alias("defects"))


#: Where several defects stay, the first of DEFECTS explains the others: an empty answer can't break off, and so on.
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = label(table(spark, sf_dir, "coding_chat"), table(spark, sf_dir, "common_words"))
    return got.where(F.size("defects") > 0).select("chat_id", F.expr("array_min(transform(defects, d -> struct(array_position(array('empty','copy','refusal','other_language','truncated'), d.defect) as o, d.defect as defect))).defect").alias("defect"))


QUERIES = {"p6_labels": p6_labels, "p6_found": p6_found}
