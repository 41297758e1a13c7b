"""Training of the personal-information tagger: labelled spans, back-propagation and Adam in numpy.

``python -m millrace.llm.pii_train [STEPS]`` writes the weights beside the tagger.  The labelled spans are drawn from the
patterns below with invented names, streets and numbers; sentences around them are drawn from the lists below.
"""

from __future__ import annotations

import random
import sys
import time

import numpy as np

from millrace.llm.pii import KINDS, LABELS, N_CODES, PAD, WEIGHTS, WIDTH, Tagger, encode

GIVEN = "Ingrid Lucia Maya Dario Elin Greta Anton Rafael Yara Stefan Jonas Priya Samuel Hanna Nadia Emil Felix Tomas Viktor Marta Aiko Oskar Kofi Leila Pavel Hugo Sunita Marco Clara Chiara Naomi Amira Ruben Bruno Diego Salma Anna Peter Maria John Laura David Sofia Paul Julia Karl Elena Ivan Olga Pedro Carlos Ana Luis Pierre Marie Jean Claire Giulia Paolo Lars Nils Eva Mia Noah Liam Emma Omar Fatima Chen Wei Yuki Kenji Raj Anita Zoe Adam Boris Nina Igor Vera Tara Owen Ruth Iris Hector Amelie Björn Zofia José André".split()
HEAD = "Lind Varn Old Pell Wender Brack Thorn Sorren Mar Ash Quill Kesten Drover Tarrow Hollin Grim Cald Ester Vell Ruddle Har Stone Wood Black White Green Berg Falk Holm Sand Nor West East Fair Win Row Hart Lang Stein Roth Kess Mill Ox Fen Hay Cor Dun Bell Haw Ever".split()
TAIL = "ham ström berg feld ford dale grove wick court brook field ani etti ski son stad ova mere er mann ley ton well wood stone hart man sen sson low ridge ini elli ez ov".split()
SURNAMES = "Smith Jones Garcia Müller Schmidt Rossi Silva Dubois Martin Lopez Novak Kowalski Tanaka Suzuki Patel Khan Nguyen Santos Ferreira Moreau Weber Fischer Ricci Conti Meyer Ivanov O'Brien McDonald".split()
STREETS = "Hemlow Ravenhurst Millstow Wendle Larchmont Copperby Saltmarsh Tarnfield Oxlode Bracken Quillmoor Elm Oak Maple Church Station Mill Park Hill Garden Lime Birch Castle Bridge King Queen Market Harbour Chestnut Foxglove".split()
DOMAINS = "ovelgrid tindervale hollinforge quillmoor kestenby brackwater sornfeld marlowe greenfern bluepeak northgate example acme datahub openlab".split()
TLDS = "example invalid test com org net de fr io co.uk".split()
SYL = "zor vel tra kor nel hal mor fen gri lor pel sa mi ba ro da ti ver wen tal rin sel qua jo".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def pick(self, xs):
        return xs[int(self.r.random() * len(xs))]

    def ident(self) -> str:
        w = lambda: "".join(self.pick(SYL) for _ in range(self.r.randint(1, 3)))
        return self.pick([f"{w()}_{w()}", f"{w()}{w().title()}", f"{w()}_{w()}{self.r.randint(1, 99)}", f"{w()}_{w()}".upper(), w().title(), w().title()])

    def path(self) -> str:
        return f"{self.pick(['src', 'lib', 'conf', 'pkg', 'tools'])}/{self.pick(SYL)}{self.pick(SYL)}/{self.pick(['patch', 'window', 'cache'])}.{self.pick(['py', 'rs', 'go', 'md', 'yml'])}"

    def surname(self) -> str:
        one = lambda: self.pick(SURNAMES) if self.r.random() < 0.12 else self.pick(HEAD) + self.pick(TAIL)
        return f"{one()}-{one()}" if self.r.random() < 0.13 else one()

    def name(self) -> str:
        g, s = self.pick(GIVEN), self.surname()
        u = self.r.random()
        mid = f" {self.pick('ABCDEFGHJKLMNPRSTW')}." if self.r.random() < 0.15 else ""
        out = f"{s}, {g}{mid}" if u < 0.22 else f"{g}{mid} {s}"
        return out.upper() if self.r.random() < 0.1 else out

    def digits(self, n: int) -> str:
        return "".join(self.pick("0123456789") for _ in range(n))

    def email(self) -> str:
        g, s = self.pick(GIVEN).lower(), (self.pick(HEAD) + self.pick(TAIL)).lower()
        user = self.pick([f"{g}.{s}", f"{s}.{g[0]}", f"{g[0]}{s}", f"{g}_{s}{self.r.randint(1, 99)}", f"{g}{self.r.randint(1950, 2005)}", f"{g}+{self.pick(['route', 'lexer', 'gateway', 'span'])}", g, f"{s}"])
        host = self.pick(["", "", "mail.", "corp.", "post."]) + self.pick(DOMAINS) + "." + self.pick(TLDS)
        u = self.r.random()
        if u < 0.62:
            out = f"{user}@{host}"
        elif u < 0.7:
            out = f"{user} @ {host}"
        elif u < 0.8:
            out = f"{user} {self.pick(['(at)', '[at]'])} {host}"
        else:
            a, d = self.pick([("[at]", "[dot]"), ("(at)", "(dot)"), ("at", "dot"), ("AT", "DOT")])
            out = f"{user} {a} {f' {d} '.join(host.split('.'))}"
        return out.upper() if self.r.random() < 0.06 else out

    def phone(self) -> str:
        d = self.digits
        a, b, c = self.pick(["415", "202", "734", "617", "312", "828", d(3)]), self.pick(["555", d(3)]), d(4)
        return self.pick([
            f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1{a}{b}{c}", f"+1{a}{b}{c}", f"+44 20 7946 0{d(3)}", f"020 7946 0{d(3)}", f"+44 (0)20 7946{d(4)}", f"+49 (30) 23125-{d(3)}", f"+49 30 23125{d(3)}", f"030 23125 {d(3)}", f"030/23125-{d(3)}", f"030 23125{d(3)}",
            f"+33 1 99 00 {d(2)} {d(2)}", f"01 99 00 {d(2)} {d(2)}", f"0199.00.{d(2)}.{d(2)}", f"01.99.00.{d(2)}.{d(2)}", f"+33199{d(6)}", f"+34 91{d(1)} {d(3)} {d(3)}", f"+39 06 {d(4)} {d(4)}", f"+351 21 {d(3)} {d(4)}",
        ])

    def idnum(self) -> str:
        d = self.digits
        a, b, c = self.pick(["9" + d(2), d(3)]), d(2), d(4)
        l2 = self.pick(["QQ", "QQ", "AB", "JK", "TN"])
        return self.pick([f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}{b}{c}", f"{a}-{b}-{c}", f"{l2}{d(6)}{self.pick('ABCD')}", f"{l2} {d(2)} {d(2)} {d(2)} {self.pick('ABCD')}", f"{self.pick(['0', '1', '8'])}{d(1)} {d(3)} {d(3)} {d(3)}", f"0{d(10)}"])

    def town(self) -> str:
        return self.pick(HEAD) + self.pick(["ham", "ford", "ton", "by", "haven", "dale", "bury", "mouth"])

    def address(self) -> str:
        r, n, s, z = self.r, self.r.randint(1, 3999), self.pick(STREETS), self.digits(5)
        kind = r.random()
        if kind < 0.6:
            way = self.pick("Street Street St. St Avenue Avenue Ave. Ave Drive Drive Lane Lane Road Rd. Way Way Court Blvd Boulevard Place".split())
            line = f"{n} {self.pick(['', '', '', 'N. ', 'West ', 'S. '])}{s} {way}"
            if r.random() < 0.35:
                line += f", {self.pick(['Apt', 'Apt', 'Unit', 'Suite'])} {self.pick([str(r.randint(1, 40)), self.pick('ABCDE')])}"
            u = r.random()
            t = self.town()
            out = line if u < 0.25 else f"{line}, {t}" if u < 0.45 else f"{line}, {t} {z}" if u < 0.7 else f"{line}, {t}, {z}" if u < 0.82 else f"{line}\n{t} {z}" if u < 0.92 else f"{line} {t} {z}"
        elif kind < 0.72:
            out = f"{n}{self.pick(['', '', ' bis', ','])} {self.pick(['rue de ', 'rue ', 'boulevard ', 'avenue de ', 'allée de '])}{s}{self.pick([f', {z} {self.town()}', f', {z} {self.town()}', '', f' {z} {self.town()}'])}"
        elif kind < 0.85:
            out = f"{self.pick(['Calle ', 'Calle ', 'C/ ', 'C/ ', 'Avenida ', 'Rua ', 'Via '])}{s} {n}{self.pick([f', {z} {self.town()}', f', {z} {self.town()}', '', f', {self.town()}'])}"
        else:
            out = f"{s}{self.pick(['str.', 'str.', 'straße', 'strasse', 'weg', 'gasse'])} {n}{self.pick([f', {z} {self.town()}', f', {z} {self.town()}', f', {self.town()}', ''])}"
        return out.upper() if r.random() < 0.04 else out

    def filler(self) -> str:
        i, j, p, n, c = self.ident(), self.ident(), self.path(), self.r.randint(1, 3999), self.pick(["retry queue", "lock manager", "test runner", "parser", "event loop", "index reader"])
        return self.pick([
            f"Since version {n % 9}.{n % 20}.{n % 12}, the {c} no longer needs {i}.", f"We saw that the {c} drops about {n} rows when two clients connect at once, and nobody could say why.", f"In {i}, the {c} keeps {n} entries and throws the oldest one away.", f"Our team moved the {c} from {i} to a plain file called {p}.",
            f"The new default of {n} was chosen because most people run the {c} after the first retry.", f"Set {i} to {n} if the {c} feels slow.", f"The build id is {self.digits(2)}-{self.digits(5)}-{self.digits(3)}.", f"Row {self.digits(5)}, column {self.digits(2)} holds the checksum {self.digits(12)}.", f"It listens on 10.{self.digits(2)}.{self.digits(2)}.{self.digits(2)}, port {self.digits(4)}.",
            f"The job ran at 2024-0{n % 9 + 1}-{n % 20 + 10} {n % 14 + 10}:{n % 50 + 10} and wrote {self.digits(7)} bytes.", f"Version {self.digits(2)}.{self.digits(2)}.{self.digits(2)} replaces {self.digits(2)}.{self.digits(2)}.{self.digits(2)}.", f"Pin {i.lower()}@{n % 9}.{n % 50}.{n % 7} in the manifest.", f"Clone it with git@{self.pick(DOMAINS)}.test:{i}/{j}.git first.", f"Commit {self.pick('0123456789abcdef')}{self.digits(4)}a{self.digits(3)}b{self.digits(1)} touched {n % 90} files.",
            f"@{self.pick(['dataclass', 'cached', 'app.route', 'property', 'staticmethod'])}\ndef {i.lower()}(path):", f"Project {self.pick(SYL).title()}{self.pick(SYL)} {self.pick(['Bridge', 'Drive', 'Court', 'Way', 'Field'])} is the successor.", f"The driver of {n % 99} Drive units needs firmware {n}.", f"Step {n % 9} Main loop starts, then step {n % 80}.", f"Thanks to {i}, the {c} now recovers under heavy load.",
            f"Anyone who has used {i} before will know the {c} from its older name, {j}.", f"Dank {i} läuft jetzt alles wieder von selbst.", f"Unser Team hat die Konfigurationsdatei nach {i} verschoben.", f"Die Datei {p} wird nur einmal gelesen und danach geschlossen.", f"Notre équipe a déplacé la base de données vers {i} sans redémarrer le service.", f"Desde la versión {n % 9}.{n % 20}.1 ya no hace falta {i}.",
            f"Hello everyone, {i} is fine.", f"A nossa equipa passou tudo para {i} durante a noite.", f"Est. {n % 2024} by the Main Street Bridge group.", f"import {i}\nfrom {j} import x", f"CREATE TABLE {i} (\n  {j} BIGINT PRIMARY KEY\n);", f"What happens to the {c} after the first retry is still an open question.", f"See chapter {n % 40} of the {self.pick(STREETS)} Guide.", f"Call {i} twice, then {j}.", f"The total is {n}.{self.digits(2)} for {n % 77} items.",
            f"#[derive({self.pick(['Debug, Clone', 'Clone, Debug', 'Debug, Clone, Copy', 'Default, Debug'])})]\nstruct {i} {{", f"{self.pick(self.NOUNS)} {self.pick(['schreibt den Wert von', 'liest', 'braucht', 'liefert'])} {i} nach {p}.", f"{self.pick(self.GREETINGS)} {self.pick(['Seit Version', 'Die Datei', 'Wir haben', 'The', 'Desde la', 'Nous avons', 'Thanks to', self.pick(self.NOUNS)])} {i} {n}.",
            f"{self.pick(self.GREETINGS)}\n{self.pick(self.NOUNS)} {i}.", f"{n % 500 + 100} {self.pick(['Bad Gateway', 'Not Found', 'Service Unavailable', 'Gateway Timeout', 'Internal Server Error'])}. {i}", f"Put @{self.pick(['event', 'route', 'cached', 'command'])} above {i}.", f"{self.pick(self.CAPITALS)} {self.pick(['is', 'needs', 'and', 'with'])} {i}.", f"We use {self.pick(self.CAPITALS)} for {i}.", f"= {self.pick(['Notes on', 'Setup of', 'Changes in', 'Hinweise zu', 'Notas sobre'])} {i}\n{self.pick(self.NOUNS)} {j}",
            f"{self.pick(['Graças a', 'Gracias a', 'Grazie a', 'Grâce à'])} {i}, {self.pick(['agora', 'ahora', 'adesso', 'maintenant'])} {c}.", f"'{i}', '{j}': {self.digits(9)}{self.digits(n % 4)}", f"id {self.digits(10)}-{self.digits(2)}", f"let {i.lower()} = {self.digits(3)};\nclass {self.pick(['Cursor', 'Store'])} {{",
            f"SELECT a.x_id, count(*) AS {i}\nFROM {j}", f"Error {n % 500}: {self.pick(['Bad Gateway', 'Not Found', 'Internal Server Error'])}", f"Order {self.digits(8)} left on 12.{n % 10}.2023.", f"Reference: {self.digits(6)}-{self.digits(3)}", f"0x{self.digits(8)} {self.digits(10)} {self.digits(4)}", f"Home | Docs | Login", f"{i} {self.pick(['Setup', 'Notes', 'Changes'])} in {j}",
        ])

    NOUNS = "Die Fehlermeldung|Das Build-Skript|Die Konfigurationsdatei|Das Verzeichnis|Die Schnittstelle|Der Test|Das Modul|Die Befehlszeile|Seit Version|Unser Team|Die Sitzungsverwaltung|Der Hintergrundprozess|Die Testumgebung|Das Programm|Ein Fehler|Diese Anleitung|Jeder Aufruf|La Base|El Archivo|Le Fichier|O Ficheiro|Il File|Main Loop|Garbage Collector|Access Control|Read Me".split("|")
    GREETINGS = "Guten Tag,|Hallo zusammen,|Hola a todos:|Olá a todos,|Bonjour à tous,|Hello everyone,|Hi all,|Hey,|Buenas,|Ciao a tutti,|Quick question:|Dear all,".split("|")
    CAPITALS = "Visual Studio|Spring Boot|Hello World|New York|Open Source|Pull Request|Code Review|Apache Spark|Google Cloud|Los Angeles|United States|World Wide Web|Monday Morning|Read Committed|Project Manager|Release Notes|Home Page|Null Pointer|Type Error|Value Error|North America|Linux Kernel|Data Lake|Bridge Court|Field Drive|Park Way".split("|")
    #: Patterns: a letter in braces stands for a thing of that kind.
    PATTERNS = [
        "I left the spare keys with {n} next door.", "My name is {n} and I maintain this module.", "Je m'appelle {n} et j'habite {a}.", "Thanks to {n} for the patch!", "@channel: {n} is on call, {p}", "Ship the board to {n} at {a}.", "Ich heiße {n} und wohne hier: {a}.", "You can reach {n} at {p} after nine.", "Puedes llamar a {n} al {p}.", "Me llamo {n} y vivo en {a}.",
        "# copied from the ticket of {n}, ssn {i}", "-- copied from the ticket of {n}, ssn {i}", "// maintainer {n}, {p}", "Vous pouvez joindre {n} au {p}.", "Cordialement,\n{n}", "Viele Grüße\n{n}", "Regards,\n{n}", "Saludos,\n{n}", "Ask {n} from the build team about it.", "Parcel label: {n}, {a}, tel. {p}", "{n} ist unter {p} zu erreichen.", "user record 17 | {n} | {e} | {i}", "{n} wrote on Monday:",
        "Reviewed-by: {n} <{e}>", "Signed-off-by: {n} <{e}>", "Contact: {n} <{e}>", "From: {n}\nTo: {e}", "I met {n} and {n} at the meetup.", '{ "owner": "{n}", "email": "{e}", "ssn": "{i}" }', "id card {i}, issued to {n}", "The old office was at {a}.", "Please delete my record: national insurance number {i}, living at {a}.", "Please delete my record: social security number {i}, living at {a}.", "# ship to {a}", "// ship to {a}", "-- ship to {a}",
        "Send the signed form to {a}.", "Das Formular geht an: {a}.", "Le formulaire est à envoyer au {a}.", "El formulario se envía a {a}.", "tax id {i}", "The test account still holds the SSN {i} of a colleague.", "The sample row shows a social security number ({i}), which should not be there.", "The form asks for the insurance number; mine is {i}.", "Número de identidad {i}, correo {e}.", "Numéro d'identité {i}, courriel {e}.", "Steuernummer {i}, Mail {e}.",
        "Bei Fragen bitte an {e} schreiben.", "Écrivez à {e} si cela recommence.", "Escribe a {e} si vuelve a fallar.", "If it breaks again, write to {e}.", "Call {p} or mail {e}.", "text me on {p}", "Fax and voice: {p}.", "# mail {e} before changing this", "cc {e}, {e}", "owner={n};mail={e};phone={p}", "{n}\n{a}\n{p}", "-- \n{n}\n{a}\n{p}", "{n}, {a}, tel. {p}", "{a}\n{p}", "{p}", "{e}", "{n}", "{a}", "Tel. {p}, {e}", "name: {n}\nphone: {p}",
        "Mi chiamo {n} e abito in {a}.", "Chamo-me {n} e moro na {a}.", "Scrivete a {e} o chiamate {p}.", "Codice fiscale {i}, {n}.", "Número de contribuinte {i}, {n}.", "Meeting with {n} ({e}) on Friday.", "assigned to {n}", "Author: {n}", "Written by {n}, reviewed by {n}.", "{n} said that {n} lives at {a}.", "mobile {p} / office {p}", "Zustellung an {n}, {a}.", "Rufen Sie {n} an: {p}", "我的邮箱是{e}，电话{p}。", "連絡先は{n}（{e}）です。",
    ]

    def sample(self) -> tuple[str, list[tuple[str, int, int]]]:
        """A window's text and its spans."""
        kind = {"n": ("name", self.name), "e": ("email", self.email), "p": ("phone", self.phone), "i": ("idnum", self.idnum), "a": ("address", self.address)}
        parts: list[tuple[str, str | None]] = []
        for _ in range(self.r.randint(1, 3)):
            if self.r.random() < 0.55:
                parts.append((self.filler(), None))
            else:
                pat = self.pick(self.PATTERNS)
                i = 0
                while i < len(pat):
                    if pat[i] == "{" and i + 2 < len(pat) and pat[i + 2] == "}" and pat[i + 1] in kind:
                        k, f = kind[pat[i + 1]]
                        parts.append((f(), k))
                        i += 3
                    else:
                        j = pat.find("{", i + 1)
                        j = len(pat) if j < 0 else j
                        parts.append((pat[i:j], None))
                        i = j
            parts.append((self.pick([" ", "\n", "\n\n", " "]), None))
        text, spans = "", []
        for s, k in parts:
            if k:
                spans.append((k, len(text), len(text) + len(s)))
            text += s
        return text, spans

    def window(self) -> tuple[np.ndarray, np.ndarray]:
        text, spans = self.sample()
        y = np.zeros(len(text), np.uint8)
        for k, a, b in spans:
            c = 1 + 2 * KINDS.index(k)
            y[a:b] = c + 1
            y[a] = c
        x = encode(text)
        if len(x) > WIDTH:
            at = self.r.randint(0, len(x) - WIDTH)
            x, y = x[at : at + WIDTH], y[at : at + WIDTH]
        out = np.full(WIDTH, PAD, np.uint8)
        lab = np.zeros(WIDTH, np.uint8)
        out[: len(x)], lab[: len(y)] = x, y
        return out, lab


def init(hidden: int, dims: int, seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    k = len(LABELS)
    w = {"e": r.normal(0, 0.3, (N_CODES, dims)), "vf": r.normal(0, 0.1, (hidden, k)), "vb": r.normal(0, 0.1, (hidden, k)), "c": np.zeros(k), "a": np.zeros((k, k)), "s": np.zeros(k)}
    for d in "fb":
        w["x" + d] = r.normal(0, 1 / np.sqrt(dims), (dims, 4 * hidden))
        w["u" + d] = r.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        w["b" + d] = np.zeros(4 * hidden)
        w["b" + d][hidden : 2 * hidden] = 1.0
    return {n: v.astype(np.float32) for n, v in w.items()}


def lstm(x: np.ndarray, w: dict, d: str) -> tuple[np.ndarray, tuple]:
    """x: T x B x E. Hidden states and what back-propagation needs."""
    u, b = w["u" + d], w["b" + d]
    h = u.shape[0]
    t_, n, _ = x.shape
    pre = x @ w["x" + d] + b
    hid, cell = np.zeros((t_ + 1, n, h), np.float32), np.zeros((t_ + 1, n, h), np.float32)
    gates = np.empty((t_, n, 4 * h), np.float32)
    tc = np.empty((t_, n, h), np.float32)
    for t in range(t_):
        z = pre[t] + hid[t] @ u
        g = gates[t]
        g[:, : 3 * h] = 0.5 + 0.5 * np.tanh(0.5 * z[:, : 3 * h])
        g[:, 3 * h :] = np.tanh(z[:, 3 * h :])
        cell[t + 1] = g[:, h : 2 * h] * cell[t] + g[:, :h] * g[:, 3 * h :]
        tc[t] = np.tanh(cell[t + 1])
        hid[t + 1] = g[:, 2 * h : 3 * h] * tc[t]
    return hid[1:], (x, hid, cell, gates, tc)


def lstm_back(dh: np.ndarray, mem: tuple, w: dict, d: str, grad: dict) -> np.ndarray:
    x, hid, cell, gates, tc = mem
    u = w["u" + d]
    h = u.shape[0]
    dz = np.empty_like(gates)
    nh, nc = np.zeros_like(hid[0]), np.zeros_like(cell[0])
    for t in range(len(x) - 1, -1, -1):
        g = gates[t]
        i, f, o, c = g[:, :h], g[:, h : 2 * h], g[:, 2 * h : 3 * h], g[:, 3 * h :]
        a = dh[t] + nh
        dc = nc + a * o * (1 - tc[t] ** 2)
        z = dz[t]
        z[:, :h] = dc * c * i * (1 - i)
        z[:, h : 2 * h] = dc * cell[t] * f * (1 - f)
        z[:, 2 * h : 3 * h] = a * tc[t] * o * (1 - o)
        z[:, 3 * h :] = dc * i * (1 - c**2)
        nc = dc * f
        nh = z @ u.T
    flat = dz.reshape(-1, 4 * h)
    grad["u" + d] = hid[:-1].reshape(-1, h).T @ flat
    grad["x" + d] = x.reshape(-1, x.shape[2]).T @ flat
    grad["b" + d] = flat.sum(0)
    return dz @ w["x" + d].T


def crf(emit: np.ndarray, y: np.ndarray, a: np.ndarray, s: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of label paths (T x B), and gradients for emissions, transitions and starts."""
    t_, n, k = emit.shape
    alpha = np.empty((t_, n, k), np.float64)
    alpha[0] = emit[0] + s
    ea = np.exp(a.astype(np.float64))
    for t in range(1, t_):
        m = alpha[t - 1].max(1, keepdims=True)
        alpha[t] = emit[t] + m + np.log(np.exp(alpha[t - 1] - m) @ ea + 1e-300)
    beta = np.zeros((t_, n, k), np.float64)
    for t in range(t_ - 2, -1, -1):
        v = emit[t + 1] + beta[t + 1]
        m = v.max(1, keepdims=True)
        beta[t] = m + np.log(np.exp(v - m) @ ea.T + 1e-300)
    m = alpha[-1].max(1)
    z = m + np.log(np.exp(alpha[-1] - m[:, None]).sum(1))
    p = np.exp(alpha + beta - z[None, :, None])
    rows = np.arange(n)
    gold = emit[0][rows, y[0]] + s[y[0]]
    da = np.zeros_like(a, np.float64)
    for t in range(1, t_):
        gold = gold + emit[t][rows, y[t]] + a[y[t - 1], y[t]]
    for t in range(1, t_):
        m0 = alpha[t - 1].max(1, keepdims=True)
        left = np.exp(alpha[t - 1] - m0)
        right = np.exp(emit[t] + beta[t] + m0 - z[:, None])
        da += ea * (left.T @ right)
    np.subtract.at(da, (y[:-1].ravel(), y[1:].ravel()), 1.0)
    de = p.copy()
    np.subtract.at(de, (np.arange(t_)[:, None], rows[None, :], y), 1.0)
    return float((z - gold).mean()), (de / n).astype(np.float32), (da / n).astype(np.float32), (de[0].sum(0) / n).astype(np.float32)


def fold(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Weights as the tagger takes them: embeddings folded into input tables, sigmoid gates at half scale."""
    h = w["uf"].shape[0]
    scale = np.r_[np.full(3 * h, 0.5), np.ones(h)].astype(np.float32)
    out = {k: w[k] for k in ("vf", "vb", "c", "a", "s")}
    for d in "fb":
        out["t" + d] = (w["e"] @ w["x" + d] + w["b" + d]) * scale
        out["u" + d] = w["u" + d] * scale
    return out


def train(steps: int = 1500, batch: int = 64, hidden: int = 28, dims: int = 20, rate: float = 6e-3, seed: int = 5, seconds: float = 1e9) -> dict[str, np.ndarray]:
    w = init(hidden, dims, seed)
    maker = Maker(seed)
    m1, m2 = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    began = time.time()
    for step in range(1, steps + 1):
        done = max((step - 1) / steps, (time.time() - began) / seconds)
        if done >= 1:
            break
        got = [maker.window() for _ in range(batch)]
        x = np.stack([g[0] for g in got]).T
        y = np.stack([g[1] for g in got]).T.astype(int)
        emb = w["e"][x]
        hf, mf = lstm(emb, w, "f")
        hb, mb = lstm(emb[::-1], w, "b")
        hb = hb[::-1]
        emit = hf @ w["vf"] + hb @ w["vb"] + w["c"]
        loss, de, da, ds = crf(emit, y, w["a"], w["s"])
        grad = {"a": da, "s": ds, "c": de.sum((0, 1))}
        k = de.shape[2]
        grad["vf"] = hf.reshape(-1, hidden).T @ de.reshape(-1, k)
        grad["vb"] = np.ascontiguousarray(hb).reshape(-1, hidden).T @ de.reshape(-1, k)
        dx = lstm_back(de @ w["vf"].T, mf, w, "f", grad)
        dx = dx + lstm_back((de @ w["vb"].T)[::-1], mb, w, "b", grad)[::-1]
        grad["e"] = np.zeros_like(w["e"])
        np.add.at(grad["e"], x.ravel(), dx.reshape(-1, dims))
        norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
        cut = min(1.0, 5.0 / (norm + 1e-6))
        lr = rate * min(1.0, step / 30) * max(0.02, 1 - done)
        for n, g in grad.items():
            g = g * cut
            m1[n] += 0.1 * (g - m1[n])
            m2[n] += 0.001 * (g * g - m2[n])
            w[n] -= (lr * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        if step % 100 == 0:
            print(step, round(loss, 3), round(time.time() - began), flush=True)
    return fold(w)


if __name__ == "__main__":
    weights = train(int(sys.argv[1]) if len(sys.argv) > 1 else 1500, seconds=float(sys.argv[2]) if len(sys.argv) > 2 else 1e9)
    Tagger(weights)
    np.savez_compressed(WEIGHTS, **weights)
