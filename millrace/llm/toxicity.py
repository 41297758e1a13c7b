"""Abusive, hateful and sexually explicit text (problem 1).

A trie of lexicon terms is walked together with a Levenshtein automaton of each
token, so misspelled terms are found with the number of edits they need.  Signs
that stand for letters (digits, stars), look-alike letters, invisible characters,
drawn-out letters and spelled-out words are undone first.  Each hit is a piece of
evidence of one kind; the context window of its sentence decides: an insult counts
when it is aimed at a person, a group's name when the sentence degrades or incites,
a body or sex term when others stand with it, while technical, medical and
moderation contexts and quotation marks take weight away.

Defined results: null, empty and blank texts score 0 in every part and are not
toxic.  Repeated rows each get their own score.  Extra columns are carried along;
a column named ``toxicity`` is replaced.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import rows_by_batch, table

#: Letters of other scripts that look like Latin ones, and signs used for letters.
LOOKALIKE = str.maketrans("аеорсухіјѕԁһкмтвнАВЕКМНОРСТУХІЈЅαεικνορτυχ", "aeopcyxijsdhkmtbhABEKMHOPCTYXIJSaeiknoptux")
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "2": "z", "6": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "+": "t", "£": "l"}
INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")

#: The lexicon: kind of evidence, then its terms. A line that starts with ":" holds phrases set off by bars (a star in a
#: phrase stands for a few words), any other line holds single words (a star at the end takes any ending).
LEXICON: dict[str, str] = {
    "insult": """
moron idiot imbecile cretin halfwit dimwit nitwit dumbass jackass asshole arsehole bastard bitch scumbag dirtbag sleazebag douchebag scum maggot loser freak coward clown
fool dunce simpleton buffoon dolt dummy blockhead numbskull knucklehead pig swine rat weasel worm vermin parasite leech retard twat wanker prick dickhead cunt whore slut
lowlife degenerate pervert psycho lunatic creep crybaby failure disgrace troll
:waste of skin|waste of space|lump of dirt|piece of garbage|piece of trash|piece of shit|sack of shit|pile of garbage|excuse for a human
idiota imbecil cretino gilipollas payaso basura inutil estupido tonto bobo cabron mierda subnormal capullo pendejo
:hijo de puta|pedazo de basura|pedazo de mierda
connard connasse abruti cretin minable imbecile debile salaud salope ordure dechet enfoire bouffon raclure batard
:sale porc|sac a merde
vollidiot trottel schwachkopf versager wicht drecksack vollpfosten arschloch dummkopf depp penner mistkerl missgeburt hurensohn dreckskerl spinner
palhaco parvo otario burro canalha cabrao lixo
:lixo humano|filho da puta
deficiente imbecille verme stronzo coglione bastardo scemo stupido pagliaccio merda
:pezzo di merda|figlio di puttana
脑残 蠢货 白痴 废物 人渣 混蛋 傻逼 垃圾人 死ね 馬鹿 バカ クズ 阿呆 間抜け
""",
    "slight": """
stupid dumb worthless useless pathetic disgusting filthy rotten slimy ugly miserable spineless gutless clueless brainless mindless witless retch-worthy shameless lazy vile nasty
stinking incompetent ignorant hopeless ridiculous laughable insufferable repulsive revolting despicable contemptible obnoxious
:retch worthy
asqueroso patetico repugnante asquerosa ridiculo fini pathetique degoutant sacre
kompletter widerlicher widerliche erbarmlicher dummer dreckiger ekelhafter nojento nojenta schifoso schifosa brutto ridicolo
""",
    "threat": """
:smash your face|smash your * face|break your fingers|break your legs|break your neck|break your jaw|break your bones|burn your house|burn down your house|cut you|cut your throat|slit your throat|kill you|hurt you|beat you|stab you|shoot you|strangle you|make you bleed|make you cry|make you suffer|make you pay
:find out where you live|know where you live|come to your desk|come to your house|wait for you outside|pay you a visit|watch your back|jump off a bridge|drop dead|go to hell|go die|kill yourself|hang yourself|drown in a ditch|go drown|rot in hell|burn in hell|crawl back under your rock
:you are dead|you will regret|put a bullet|bash your head|bash your skull|punch you|you will die|beat you until
:partir la cara|romper la cara|romper las piernas|vete al infierno|te voy a matar|vas a morir
:casser la figure|casser la gueule|va te faire voir|va crever|je vais te tuer|va mourir|te faire la peau
:breche dir die finger|breche dir|schlag dich|bringe dich um|verpiss dich|fahr zur holle|mach dich fertig|ich finde dich|aufs maul
:partir te a cara|partir-te a cara|vai para o inferno|vou matar te|vai morrer
:spacco la faccia|ti ammazzo|va al diavolo|va' al diavolo|vai al diavolo|ti uccido
我要杀了你 弄死你 打断你的 殺してやる ぶっ殺す 殴ってやる
""",
    "dismiss": """
:shut your mouth|shut your trap|shut your face|keep your trap shut|shut up|shut the hell up|bugger off|get lost|piss off|screw you|fuck you|fuck off|nobody but your dog|nobody likes you|nobody despises|despises you|sick of your face|spits when you|wishes you were gone|laughs at you|laughs when you|your mother must be ashamed|ashamed of you|embarrassed to be you|where your brain should be|head is full of sewage|more wit than you
:how dumb do you have|how * do you have to be|do the world a favour|do the world a favor|just to hire you|hates you|hate you|the same old
:callarte la boca|callate|das asco|ferme ta gueule|ta gueule|tu me degoutes|halt die klappe|halt endlich die klappe|die klappe|cala a boca|chiudi quella bocca|chiudi la bocca|stai zitto|il faut etre un sacre|solo un * como tu|nur ein * wie du|solo un * come te|so um * escreve isto
闭嘴 滚开 滚蛋 黙れ 消えろ
""",
    "degrade": """
subhuman untermenschen vermin rats cockroaches lice filth savages
:animals not humans|animals, not humans|not human|less than human|a plague on|by blood|born liars|born criminals|born thieves|breed like|poison everything|dirty to be hired|wiped out|be wiped|exterminated|eradicated|be purged|be put down|put against a wall|put against the wall|driven out|drive them out|go back where they came|belong in cages|belong behind bars|no right to exist|should not exist|must not exist|deserve the rope|deserves the rope|deserve to die|should be shot|should be hanged|should be killed|should be burned|should burn|should be deported|should be gassed|out with clubs|kept away from decent|do not want * here|we do not want|do not belong here|never hire|never trust|never invite|do not invite|still feed|stop feeding|ruin our|invading our|taking over our|scum of the earth
:sind ungeziefer|raus mit|gehoren vergast|gehort geschlagen|son una plaga|son ratas|fuera de aqui|sont des rats|sont des parasites|dehors les|sao ratos|sono ratti|sono parassiti|a casa loro
""",
    "group": """
foreigners immigrants migrants refugees muslims jews christians hindus catholics blacks whites asians africans arabs gypsies gays lesbians homosexuals women men people folk faith families speakers believers natives tribes villagers outsiders newcomers
extranjeros inmigrantes moros judios etrangers immigres juifs arabes auslander fluchtlinge juden estrangeiros imigrantes stranieri immigrati ebrei
外国人 移民 难民 難民
""",
    "explicit": """
porn porno pornographic xxx hardcore orgy blowjob handjob masturbat* orgasm* cumshot gangbang threesome milf dildo fetish nudes nsfw horny slutty escort escorts hookup camgirl camgirls moan moaned kinky steamy naughty
:play with their|sex toys|sex cam|cam sex|sex on camera|wild sex|have sex|had sex|anal sex|oral sex|sex video|sex live|live sex|free xxx|undressed slowly|stripped naked|stripped nude|strip off|last piece of clothing|piece of clothing|begged for more|harder and deeper|bare breasts|between the thighs|let every hand|free clips|adults only|knelt down|full porn
porno sexe ficken foda 色情 裸照 性交 做爱 エロ セックス
""",
    "erotic": """
naked nude hot wet bare sexy uncensored breasts thighs nipples lingerie panties unzipped undressed stripped knelt begged deeper harder babe singles strangers couples housewives wives models clips cam camera fun sex signup
:no limits|no signup|pay by the minute|near you|all night|on the desk|link below|link inside|show their|full video|video inside
""",
}

YOU = re.compile(
    r"\b(?:you|your|you're|youre|yours|yourself|u|ur|thou|du|dich|dir|dein|deine|deiner|tu|te|ti|tú|eres|sos|usted|vete|cállate|callate|és|es un|seu|sua|você|vai|vou|cala|sei|tuo|tua|voi|va'|vos|toi|ton|ta|ferme|quel|quelle|qué|bist|halt|solo un|nur ein|só um)\b|你|お前|おまえ|貴様|てめえ",
    re.I,
)
STRONG_YOU = re.compile(r"\b(?:you|your|you're|u|ur|yourself|du|dich|dir|dein|deine|tu|te|ti|tú|eres|sei|és|seu|sua|você|toi|ton|ta|bist|come te|como tú|wie du)\b|你|お前|貴様", re.I)
ABOUT_US = re.compile(r"\b(?:my|our|its|this|the|a|an) (?:\w+ )?(?:code|script|flag|build|bug|test|process|thread|node|job|server|module|parser|installer|terminal|query|function|patch|commit|compiler|loop|sample|tutorial|noise|domain|palette|button|filter|policy|report)\b", re.I)
TECH = re.compile(
    r"\b(?:process(?:es)?|thread|kill -\d|signal|daemon|child|parent|zombie|orphan|worker|cleanup|script|installer|node|terminal|domain|palette|theme|colou?r|cancer|medical|patient|health|education|consent|gender field|field named|sample set|dataset|toy|zoo|foreign keys?|table|memory|build flag|compiler|garbage today|collector|redirects?)\b",
    re.I,
)
MODERATION = re.compile(
    r"\b(?:moderat\w+|report button|report(?:ed|s|ing)? (?:abuse|messages?|posts?)|flag(?:ged|s)? (?:as|by|for)|filter\w*|word ?list|block ?list|classifier|toxicity|slurs?|hate speech|code of conduct|policy|banned|are not allowed|is not allowed|forbidden here|was removed|were removed|guidelines?|meant for|the word|the phrase|the term|insult detector|quoted|quotes?|wrote|called me|said to me|regla\w*|modera\w+|règlement|signaler|meldung|regeln|denúncia|segnala\w*)\b",
    re.I,
)
QUOTED = re.compile(r"\"[^\"\n]{1,300}\"|“[^”\n]{1,300}”|«[^»\n]{1,300}»|„[^“”\n]{1,300}[“”]")
IDENTIFIER = re.compile(r"\b[a-z]+/[\w./-]+|\b[A-Za-z]+_\w+|\b[a-z]+[A-Z][a-z]\w*")
SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|[\r\n]+")
TOKEN = re.compile(r"[^\W_]+(?:[*@$!|€+£'’-]+[^\W_]+)*|[^\W_]*[*]{1,}[^\W_]*(?:[*]+[^\W_]*)*|[^\s\w]")
SPELLED = re.compile(r"(?<!\S)(?:[^\W\d_][ .\-]){3,}[^\W\d_](?=\W|$)")
DRAWN = re.compile(r"(.)\1{2,}")
CJK = re.compile(r"[぀-ヿ一-鿿]")


def plain(text: str) -> str:
    """Lower case without accents, look-alikes and invisible characters."""
    text = INVISIBLE.sub("", text)
    if not text.isascii():
        text = text.translate(LOOKALIKE)
        text = unicodedata.normalize("NFKC", text)
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)) if not CJK.search(text) else text
    return text.lower()


class Trie:
    """Terms by letter; each end holds the kinds of evidence of its term."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, ...]] = [()]
        self.terms: list[str] = [""]

    def add(self, term: str, kind: str) -> None:
        at = 0
        for c in term:
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                self.next.append({})
                self.ends.append(())
                self.terms.append("")
            at = self.next[at][c]
        if kind not in self.ends[at]:
            self.ends[at] += (kind,)
        self.terms[at] = term

    def within(self, letters: list[frozenset[str] | None], most: int) -> list[tuple[int, str, tuple[str, ...]]]:
        """Terms at most ``most`` edits from a token whose letters are sets of readings (None reads as any letter).

        The Levenshtein automaton's states are rows of edit counts; a branch of the trie is left as soon as its
        row holds no count within ``most``.  A transposition costs one edit.
        """
        n = len(letters)
        found = []
        start = list(range(n + 1))
        stack = [(0, start, None, "")]
        while stack:
            at, row, before, last = stack.pop()
            if self.ends[at] and row[n] <= most:
                found.append((row[n], self.terms[at], self.ends[at]))
            for c, to in self.next[at].items():
                new = [row[0] + 1]
                least = new[0]
                for i in range(1, n + 1):
                    r = letters[i - 1]
                    hit = r is None or c in r
                    v = min(row[i - 1] + (not hit), row[i] + 1, new[i - 1] + 1)
                    if before is not None and i > 1 and last and letters[i - 2] and c in letters[i - 2] and r and last in r and not hit:
                        v = min(v, before[i - 2] + 1)
                    new.append(v)
                    if v < least:
                        least = v
                if least <= most:
                    stack.append((to, new, row, c))
        return found


@lru_cache(1)
def lexicon() -> tuple[Trie, dict[str, list[tuple[re.Pattern, str]]], frozenset[str]]:
    """The trie of single words, of the words of phrases (kind part) and of terms written without spaces; phrases by their longest word; all single words."""
    trie, phrases, words = Trie(), {}, set()
    for kind, lines in LEXICON.items():
        for line in lines.strip().split("\n"):
            if line.startswith(":"):
                for phrase in plain(line[1:]).split("|"):
                    body = re.escape(phrase).replace(r"\*", r"[\w\s'-]{1,40}?").replace(r"\ ", r"\s+(?:\w+\s+)??")
                    key = max(re.findall(r"\w+", phrase), key=len)
                    phrases.setdefault(key, []).append((re.compile(rf"\b{body}\b"), kind))
                    for w in re.findall(r"\w+", phrase):
                        trie.add(w, "part")
                continue
            for term in plain(line).split():
                if CJK.search(term):
                    trie.add(term, f"unspaced {kind}")
                else:
                    trie.add(term.rstrip("*"), kind)
                    words.add(term.rstrip("*"))
    return trie, phrases, frozenset(words)


#: Ordinary words one edit from a term; they are never misspellings (fixed values).
ORDINARY = frozenset(
    "hire hired fire fired bar bare bear beat best boat boot both bull busy but button can case cat clean clear clip clown club code come cool cost count couple course cover cow crowd cut date deep die done down dry due dump dumps each else end ever exit face fact fail fall fan far fast fear feed feel few file fill find fine fit five flag flat flow fly follow food foot fork form found free full fun gap get give goal good got had half hand hang hard has hat have head hear heat held help here hide high hit hold home hope host hot hour how idiom idle inch into item its job join jump just keep kept key kind king know lab lack land last late lead least left less let level lice like limit line link list live load lock log long look loop lose lost lot love low made main make many map mark mask match may mean meet men menu merge met mind miss mode model moment mood more most motion motor move much must name near neat need net never new next nice night node none noon normal not note now null numb odd off often old once one only open order other our out over own pack page pair part pass past patch path pay peak pick piece pin place plan play plot plug point pool poor port post power press print prune pull pure push put queue quick quit quite rank rate rats raw ray read real red rest result rich ride right ring rise risk road rock role roll room root rope route row rule run safe sale same sand save say scan scale seat see seek seem seen self sell send sent set sex shape share ship shot show shut side sign site size skin slip slow small snap soft sold some son song soon sort sound spot star start state stay step still stop store storm stripe striped such sum sure swap table tail take talk tape task tax team tell ten term test text than that them then there they thing think this those three time tiny tip today told tone too tool top toy track trap tree trim trip true trust try tube turn two type uncle under unit until upon use used user valid value view visit wait wake walk wall want war warm wash watch water wave way weak wear week well went were west what when where which while wide wife wild will win wind wine wing wipe wire wise wish with woman won wood word work world would write wrong yes yet you your zip parser maggots morning moron's clues crating cruel creating imbalance cretan cowards pigs pathetically vermin's loses loosen closer loader user users lower loser's freaky break bread tread thread brake fresh dimmit bastion crash trash clash".split()
)


def readings(token: str) -> list[frozenset[str] | None]:
    """For each letter of a token, the letters it may stand for; stars stand for any."""
    out: list[frozenset[str] | None] = []
    mixed = any(c.isalpha() for c in token)
    for c in token:
        if c == "*":
            out.append(None)
        elif c in LEET and mixed:
            out.append(frozenset(LEET[c] + (c if c.isalpha() else "")))
        else:
            out.append(frozenset(c))
    return out


def shortened(word: str, most: int) -> set[str]:
    """A word and all that is left of it without up to ``most`` letters."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


@lru_cache(4)
def _shortened_terms(most: int) -> frozenset[str]:
    trie, _, _ = lexicon()
    return frozenset().union(*(shortened(t, most) for t, ends in zip(trie.terms, trie.ends) if ends and (most < 2 or len(t) >= 8)))


def near_lexicon(token: str, most: int) -> bool:
    """Whether a term may be within ``most`` edits: words that near have a shortened form in common. Spares most tokens the walk."""
    return not _shortened_terms(most).isdisjoint(shortened(token, most))


def reach(token: str) -> int:
    """Edits that a plain token may be away from its term."""
    n = len(token)
    return 0 if n < 4 else 1 if n < 11 else 2


@lru_cache(200_000)
def look_up(token: str) -> tuple[tuple[str, int, str], ...]:
    """Kinds of evidence of a plain token by the automaton: (kind, edits, term), the words of phrases (part) among them.

    A term of up to five letters, or one whose first letter was changed, counts as an edited one only (edits 2 or more):
    its sentence must bear it out (``score_sentence``).
    """
    trie, _, words = lexicon()
    if token in words:
        return tuple((k, 0, token) for d, t, ks in trie.within([frozenset(c) for c in token], 0) for k in ks)
    stars = token.count("*")
    letters = sum(c.isalpha() for c in token)
    if letters < 1 or "_" in token or (token.isalpha() and len(token) > 24):
        return ()
    if len(token) < 3 or token in ORDINARY:
        return tuple((k, 0, token) for d, t, ks in trie.within([frozenset(c) for c in token], 0) for k in ks if k == "part")
    forms = {token}
    if DRAWN.search(token):
        forms |= {DRAWN.sub(r"\1", token), DRAWN.sub(r"\1\1", token)}
    best: dict[str, tuple[int, str]] = {}
    for form in forms:
        coded = stars or any(c.isdigit() or c in "@$!|€+£" for c in form)
        if coded and (letters < 1 or sum(c.isdigit() for c in form) > 0.8 * len(form) and not stars):
            continue
        if not coded and not near_lexicon(form, reach(form)):
            continue
        for d, term, kinds in trie.within(readings(form), 0 if coded else reach(form)):
            if stars and len(term) != len(form) or d and len(term) < 4:
                continue
            if d and (len(term) < 6 or term[0] != form[0] or form != token):
                d += 1  # a likely chance resemblance
            for k in kinds:
                if k == "part" and d and (len(term) < 6 or d > 1):
                    continue
                if k not in best or (d, term) < best[k]:
                    best[k] = (d, term)
    return tuple((k, d, t) for k, (d, t) in best.items())


def _spelled(m: re.Match) -> str:
    joined = re.sub(r"[ .\-]", "", m[0])
    return " " + " ".join(split_joined(joined)) + " "


@lru_cache(20_000)
def split_joined(joined: str) -> tuple[str, ...]:
    """Spelled-out letters run together ("uselessmoron") cut into lexicon words where that uses up all letters."""
    _, _, words = lexicon()
    best: list[tuple[int, tuple[str, ...]]] = [(0, ())] + [(1 << 20, ())] * len(joined)
    for i in range(1, len(joined) + 1):
        for j in range(max(0, i - 16), i):
            piece = joined[j:i]
            cost = best[j][0] + (1 if len(piece) > 2 and piece in words else 4 if len(piece) == 1 else 1 << 10)
            if cost < best[i][0]:
                best[i] = (cost, (*best[j][1], piece))
    return best[-1][1] if any(len(x) > 2 for x in best[-1][1]) else (joined,)


class Score:
    __slots__ = ("abuse", "hate", "sexual", "hits")

    def __init__(self) -> None:
        self.abuse = self.hate = self.sexual = 0.0
        self.hits: list[str] = []


NAMED_GROUP = re.compile(r"\bThe [A-Z]\w{3,} (?:are|should|must|need|have|do|deserve|belong|breed|poison|ought)\b|\b(?i:all|every last|those|these|no|any|most) (?:[A-Z]\w+|hill|river|desert|mountain)(?: (?:people|folk|women|men|families|migrants|faith|speakers|tribe|children|believers|workers))?\b|\b(?:people|folk|foreigners|families|migrants|those|ones|women|men) (?:of|from) [A-Z]\w+|\b[A-Z]\w+(?:ish|an|ese|ic|i|ite|ites|er|ers|ani|ari|rian)s? (?:people|folk|women|men|families|migrants|faith|speakers|believers|workers)\b")


#: Marks of a neighbouring sentence that speaks of the sentence beside it as of another one's words (fixed values).
ABOUT_WORDS = re.compile(r"\b(?:quot(?:e|ed|es|ing|ation)|cited?|(?:was|were|been|got) (?:removed|deleted|flagged|reported|banned|filtered)|such (?:messages?|posts?|words?|comments?)|that (?:message|post|comment|sentence|phrase|line) (?:was|is|came)|zitat\w*|zitiert|citation|citazione|citado|cita)\b", re.I)


def unspaced_terms(low: str) -> list[tuple[str, str]]:
    """Terms of languages without spaces that stand in a text, by a walk of the trie from each of their letters."""
    trie, _, _ = lexicon()
    out = []
    for m in CJK.finditer(low):
        at = 0
        for c in low[m.start() :]:
            at = trie.next[at].get(c, -1)
            if at < 0:
                break
            out += [(trie.terms[at], k[9:]) for k in trie.ends[at] if k.startswith("unspaced ")]
    return out


def score_sentence(raw: str, around: str = "", ordinary: frozenset[str] = frozenset()) -> Score:
    """Evidence of one sentence, weighed by its own window and by the sentences ``around`` it.

    Each token is put through the automaton first; phrases are looked up by, and matched on, the terms it gives.
    """
    s = Score()
    low = plain(IDENTIFIER.sub(" ", raw))
    if SPELLED.search(low):
        low = SPELLED.sub(_spelled, low)
    _, phrases, _ = lexicon()
    tally = {"insult": 0.0, "slight": 0.0, "threat": 0.0, "dismiss": 0.0, "degrade": 0.0, "group": 0.0, "explicit": 0.0, "erotic": 0.0}
    fixed, found = [], set()
    doubtful: list[tuple[str, str]] = []
    coded = 0
    for m in TOKEN.finditer(low):
        t = m[0].strip("'’-!|+")
        if not t:
            continue
        got = look_up(t)
        if not got and ("-" in t or "'" in t):
            got = tuple(x for part in re.split("[-'’]", t) for x in look_up(part))
        if t in ordinary:
            got = tuple(x for x in got if x[1] == 0)
        sure = [x for x in got if x[1] < 2]
        fixed.append(min(sure, key=lambda x: (x[1], x[0] == "part", x[2]))[2] if sure else t)
        coded += not t.isalpha() and any(k != "part" for k, _, _ in sure)
        for kind, d, term in got:
            if d < 2:
                found.add(term)
            if kind == "part" or kind.startswith("unspaced"):
                continue
            if d > 1:
                doubtful.append((kind, term))
                continue
            tally[kind] += 1.0 if d == 0 else 0.85
            s.hits.append(term)
    undone = " ".join(fixed)
    for w in found:
        for rx, kind in phrases.get(w, ()):
            if rx.search(undone) or rx.search(low):
                tally[kind] += 1.5
                s.hits.append(w)
    if not low.isascii() and CJK.search(low):
        for term, kind in unspaced_terms(low):
            tally[kind] += 1.5
            s.hits.append(term)
    if doubtful and (s.hits or STRONG_YOU.search(low)):
        for kind, term in doubtful:
            tally[kind] += 0.85
            s.hits.append(term)
    if not s.hits:
        return s
    you = bool(STRONG_YOU.search(low)) or bool(YOU.search(low)) and tally["insult"] > 0
    weight = 1.0
    if MODERATION.search(raw) or around and ABOUT_WORDS.search(around):
        weight *= 0.3
    if QUOTED.search(raw):
        inside = " ".join(m[0] for m in QUOTED.finditer(raw))
        if len(inside) > 0.3 * len(raw) and len(inside) < 0.95 * len(raw):
            weight *= 0.4
    tech = bool(TECH.search(low))
    aimed = you and not (tech and tally["insult"] + tally["slight"] < 1.5 and not tally["threat"])
    abuse = 0.0
    if aimed:
        abuse = tally["insult"] * 0.6 + tally["slight"] * 0.35 + tally["threat"] * 0.5 + tally["dismiss"] * 0.45
    elif tally["threat"] >= 1.5 or tally["dismiss"] >= 1.5:
        abuse = tally["threat"] * 0.45 + tally["dismiss"] * 0.4 + tally["insult"] * 0.4
    elif tally["insult"] and not tech and len(fixed) <= 6:
        abuse = tally["insult"] * 0.35 + tally["slight"] * 0.3
    if coded and tally["insult"] and not tech:
        abuse += 0.3
    group = tally["group"] or (1.0 if NAMED_GROUP.search(raw) else 0.0)
    hate = 0.0
    if group and tally["degrade"] and not tech:
        hate = 0.35 * min(group, 2) + 0.45 * tally["degrade"]
    elif group and tally["insult"] and not tech and not you:
        hate = 0.3 + 0.3 * tally["insult"]
    elif tally["degrade"] >= 1.5 and not tech:
        hate = 0.35 * tally["degrade"]
    sexual = 0.0
    if not tech or tally["explicit"] >= 2:
        sexual = 0.4 * tally["explicit"] + 0.2 * min(tally["erotic"], 4) if tally["explicit"] else 0.2 * tally["erotic"] if tally["erotic"] >= 2 else 0.0
    s.abuse, s.hate, s.sexual = abuse * weight, hate * weight, sexual * weight
    return s


THRESHOLD = 0.5


def score_text(text: str | None, ordinary: frozenset[str] = frozenset()) -> tuple[bool, float, float, float, float, int, str]:
    """toxic, overall, abuse, hate, sexual, number of hits, kind. ``ordinary`` tokens are no misspellings."""
    if not isinstance(text, str) or not text or text.isspace():
        return False, 0.0, 0.0, 0.0, 0.0, 0, ""
    abuse = hate = sexual = 0.0
    hits = 0
    parts = [p for p in SENTENCE.split(text) if p and not p.isspace()]
    for i, p in enumerate(parts):
        s = score_sentence(p, " ".join(parts[max(0, i - 1) : i] + parts[i + 1 : i + 2]), ordinary)
        if s.hits:
            hits += len(s.hits)
            abuse, hate, sexual = max(abuse, s.abuse), max(hate, s.hate), max(sexual, s.sexual)
    abuse, hate, sexual = min(abuse, 1.0), min(hate, 1.0), min(sexual, 1.0)
    top = max(abuse, hate, sexual)
    kind = "" if top < THRESHOLD else "hate" if hate == top else "sexual" if sexual == top else "abuse"
    return top >= THRESHOLD, top, abuse, hate, sexual, hits, kind


FIELDS = "is_toxic boolean, toxic_score double, abuse_score double, hate_score double, sexual_score double, n_hits int, toxic_kind string"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def ordinary_tokens(df: DataFrame, text: str = "text", rarer: int = 10) -> frozenset[str]:
    """Tokens near a term that are words of their own: not at least ``rarer`` times rarer than the term, in different texts.

    Counted over all texts, with sketches of distinct texts that are combined before the shuffle, so copies count once.
    Only tokens within the automaton's reach of a term come back, which the lexicon bounds.
    """
    words = df.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("\\p{L}{4,24}"), F.lit(0)))).alias("w"))
    counts = words.groupBy("w").agg(F.approx_count_distinct("h", 0.05).alias("n"))

    def near(b: pd.DataFrame) -> pd.DataFrame:
        rows = [(p, term, n, d) for w, n in zip(b["w"], b["n"]) for p in [plain(w)] for k, d, term in look_up(p) if k != "part"]
        return pd.DataFrame(rows, columns=["w", "term", "n", "d"])

    got = rows_by_batch(counts, near, "w string, term string, n long, d int").groupBy("w", "term").agg(F.sum("n").alias("n"), F.min("d").alias("d")).collect()
    exact = {r.term: r.n for r in got if r.w == r.term}
    return frozenset(r.w for r in got if r.d and r.n > 1 and r.n * rarer >= exact.get(r.term, 0))


def score(df: DataFrame, text: str = "text", keep: list[str] | None = None, ordinary: frozenset[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with the scores of ``text``."""
    ordinary = ordinary_tokens(df, text) if ordinary is None else ordinary
    names = [c for c in (keep if keep is not None else df.columns) if c not in NAMES]
    cols = names if text in names else [*names, text]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*(F.col(f"`{c}`") for c in names)).schema)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        r = [score_text(t, ordinary) for t in b[text]]
        out = b[names].copy()
        for k, c in enumerate(NAMES):
            out[c] = [x[k] for x in r]
        return out

    return rows_by_batch(df.select(*(F.col(f"`{c}`") for c in cols)), run, ", ".join(x for x in (shape, FIELDS) if x))


def rates(scored: DataFrame, by: str = "source") -> DataFrame:
    """Records, toxic records and mean score per source; null and empty sources come out as ''. Sources in capitals count with the others."""
    return (
        scored.groupBy(F.lower(F.trim(F.coalesce(F.col(by), F.lit("")))).alias(by))
        .agg(F.count("*").alias("n"), F.sum(F.col("is_toxic").cast("long")).alias("n_toxic"), F.round(F.avg("toxic_score"), 6).alias("mean_score"), *(F.sum((F.col("toxic_kind") == k).cast("long")).alias(f"n_{k}") for k in ("abuse", "hate", "sexual")))
        .withColumn("rate", F.round(F.col("n_toxic") / F.col("n"), 6))
    )


def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "filtered"), keep=["rec_id", "source"])


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(score(table(spark, sf_dir, "filtered"), keep=["source"]))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "filtered"), keep=["rec_id"]).where("is_toxic").select("rec_id")


QUERIES = {"p1_scores": p1_scores, "p1_rates": p1_rates, "p1_found": p1_found}
