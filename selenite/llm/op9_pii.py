"""Personal data in whole texts: four base patterns, and a linear-chain conditional random field for more.

The field labels every token of a text from the shapes of the tokens around it and from cue words. It
is trained by maximum likelihood on a small labelled table and decoded by Viterbi, many sequences in
one numpy array. Features of a token depend on five neighbouring codes and the last cue only, so they
are summed once for each such window that a worker meets. Where a window speaks so much for outside that
no best path can be anything else there, whatever comes before and after (a bound from the transitions'
weights), the text is cut into sequences, which changes no result.

Defined results: a null text is an empty one; a text without spans has an empty span list; an empty
table gives an empty one; texts of any length are decoded whole; base spans stay, and a span of the field
that overlaps one is dropped; spans of the field never overlap one another; of equally good labellings
the one with the labels that come first in LABELS is taken; repeated rows get equal results; other
columns are ignored, and redact() keeps them whatever their names.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import beside, map_rows, plain
from .common import table

BASE, ADDED = ("email", "ip", "card", "phone"), ("name", "ssn", "iban", "birth", "passport")
ORDER = {k: i for i, k in enumerate(BASE + ADDED)}
#: Rows of a labelled table that training takes at most.
TRAIN_ROWS = 5000
#: Padded places of the sequences that are decoded together; characters whose tokens are split at once.
CELLS, PIECE = 1 << 17, 1 << 20

# Base patterns ------------------------------------------------------------------------------------

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
# a start within a run of digits fails as the run's first digit does, so only those are tried
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(t: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, t.find("@")
    while at >= 0:
        stop = at + 1
        if m := DOMAIN.match(t, at):
            before = t[last:at]
            if run := len(before) - len(before.rstrip(LOCAL)):
                out.append((at - run, stop := m.end()))
        last, at = stop, t.find("@", stop)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(t: str) -> list[tuple[int, str, int]]:
    """(start, kind, end), by start and then kind as listed."""
    out = [(a, "email", b) for a, b in emails(t)] if "@" in t else []
    if DIGIT.search(t):
        for m in IP.finditer(t):
            if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m.groups()):
                out.append((m.start(), "ip", m.end()))
        for m in CARD.finditer(t):
            if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), "card", m.end()))
        if "+" in t:
            for m in PHONE.finditer(t):
                if 9 <= len(DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda s: (s[0], ORDER[s[1]], s[2]))


# Labelled table -----------------------------------------------------------------------------------

TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Mlle", "Sra", "Señor")
#: Groups of cue words, lower-case.
CUES = {
    "title": {x.lower() for x in TITLES} | {"miss", "sir", "madame", "monsieur", "señora", "doctor", "herrn"},
    "named": {"name", "named", "names", "heißt", "heiße", "llamo", "nombre", "appelle", "nom", "signed", "signature"},
    "ssn": {"ssn", "social", "security"}, "iban": {"iban", "account", "konto", "cuenta", "compte", "bank"},
    "born": {"born", "birth", "dob", "birthday", "geboren", "geburtsdatum", "nacido", "nacida", "nacimiento", "née", "naissance"},
    "passport": {"passport", "reisepass", "pasaporte", "passeport"},
    "month": set("january february march april june july august september october november december januar februar märz juni juli oktober dezember enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()),
    "number": {"nr", "number", "nummer", "número", "numéro"},
}
FRAMES = (
    "please call {title}. {name} about the order", "{title} {name} wrote on page {n} of the file", "Dear {title}. {name}, thank you", "the chair was {title} {name} until then",
    "{word} {title} {name}, {word}", "{word} {word} {title} {name}.", "{Word} {title} {name} {word} {word}", "{title} {name} {word} {word}",
    "my name is {name} and {word}", "Name: {name}\n{Word} {word}", "signed {name}\n", "ich heiße {name}. {Word}", "me llamo {name}, {word}",
    "her SSN is {ssn} as filed", "social security number {ssn}.", "SSN: {ssn}, seen by {title}. {name}", "id {ssn} was checked", "{word} {ssn} {word}", "{n} {n} {ssn}, {n} {n}",
    "IBAN {iban} is open", "pay to {iban} by Friday", "account IBAN: {iban}.", "Konto {iban} und mehr", "{n} {iban} {n}",
    "was born on {birth} in {Word}", "date of birth: {birth}\n", "DOB {birth}, {word}", "geboren am {birth} in {Word}", "nacida el {birth}. {Word}", "née le {birth} à {Word}",
    "passport {passport} was lost", "passport no. {passport}, {word}", "Reisepass Nr. {passport} und", "passport number: {passport}.",
)
PLAIN = (
    "the year {n} had {n} days and {n}.{n} more", "token = \"{hex}\" stands here", "call {phone} or {card}", "from {ip} to {ip} at {n}:{n}", "see {word} {word} {n}-{n} of {word}",
    "mail {word}.{n}@{word}.com now", "{Word} {word} the {word}. {Word} {n}", "version {n}.{n}.{n} of {Word}", "on {date} {Word} {word}", "Title {Word} {word}. Drive {Word} {n}",
    "{hex} {n} {Word}{n}", "| {word} | {n} | {Word} |", "{card} and {n} {word}", "Mrs and Mr are titles, {n} of them", "the dr {word} said {n}",
    "{word} {n}. {Word} {word}. {Word} {word}", "{word}. {Word}. {Word} {word}, {word} {n}", "{Word} {Word} {Word} License, version {n}. {Word}", "{word} {card} {word}. {Word} {word} {Word}", "A. {Word}. {Word}, {Word} {n}",
    "{prose}", "{prose}\n{prose}", "{Word} {Word}, {Word}. {prose}", "{Word}. {Word}, {word} {word}", "{Word} {Word} {Word} {Word} {Word} {Word}", "{word} {word}.\n{Word} {Word} {Word}. {Word} {Word}.",
    "{up} {up}, {up}. {up} {up} {up}.!! {up}", "{up}. {up}, {up} {Word}\n{up} {up}", "{word}. {Word} {word}.\n{Word}. {Word}, {word}", "{word} {date}. {prose}", "the name of the {word} is {word}. {Word}", "name the {word} and sign", "born in {Word}, {word}", "a born {word} {n}", "the {word} on {date} was {word}", "{Word} {word} of {date} {word} {word}", "{word} in {date}, {word}", "Der Name des {Word} ist {word}. {Word}", "der Name {word} {Word} {word}", "the name of {word} {Word}",
    "the passport was {word} in {n}", "account number {n} of {word}", "bank of {Word} {n}", "in March {n} {word} {word}", "{word} on {n} March {n}", "signed by all {word}. {Word} {word}", "social {word} and security. {Word} {word}", "Dr. {word} {word}",
    "{n} {n} {n} {n} {n} {n} {n} {n}", "{n}-{n}-{n}-{n} {word}", "id {hex} no. {n}, {word}", "key {Word}{n}{word}{n}", "{n}, {n}, {n}; {n}", "{phone}", "{up} {n} {up}", "{up}-{n} {word} {up}{n}", "{date} {n}:{n}:{n} {up} {word}={n}",
)


def labelled_rows(n: int = 900, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """A small labelled table made from sentence frames: texts with (start, end, kind)."""
    r = random.Random(seed)
    syllables = "an er in on ti la mo re na vi so be ka lu den mar".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    months = sorted(CUES["month"])

    def date():
        d, m, y = r.randint(1, 31), r.randint(1, 12), r.randint(1900, 2030)
        return r.choice((f"{d:02}.{m:02}.{y}", f"{y}-{m:02}-{d:02}", f"{m}/{d}/{y}", f"{d} {r.choice(months).capitalize()} {y}", f"{r.choice(months).capitalize()} {d}, {y}", f"{d}. {r.choice(months).capitalize()} {y}"))

    make = {
        "title": lambda: r.choice(TITLES), "word": word, "Word": lambda: word().capitalize(), "n": lambda: digits(r.randint(1, 4)), "up": lambda: word().upper(),
        "name": lambda: " ".join(word().capitalize() for _ in range(r.randint(1, 3))) if r.random() < 0.9 else f"{word().capitalize()}-{word().capitalize()}",
        "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", "date": date, "birth": date, "passport": lambda: r.choice((word()[0].upper() + digits(8), digits(9), word()[:2].upper() + digits(7))),
        "iban": lambda: r.choice(("DE", "FR", "ES", "GB", "NL", "IT")) + digits(2) + r.choice(("", " ")).join(["", *(["".join(r.choice("ABCDEFGHKLMNPRSTUWXZ") for _ in range(4))] * (r.random() < 0.3)), *(digits(4) for _ in range(r.randint(3, 5))), r.choice((digits(r.randint(1, 3)), f"{digits(2)}M{digits(2)}"))]),
        "hex": lambda: f"{r.getrandbits(160):040x}", "card": lambda: digits(16), "ip": lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)),
        "phone": lambda: f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}",
        "prose": lambda: " ".join(" ".join([word().capitalize(), *(word() + "," * (r.random() < 0.1) for _ in range(r.randint(2, 9)))]) + "." for _ in range(r.randint(1, 2))),
    }
    rows = []
    for i in range(n):
        text, spans = r.choice(("", word() + " ", word() + ". ", "\n")), []
        for part in re.split(r"(\{\w+\})", r.choice(FRAMES if i % 2 else PLAIN)):
            if part.startswith("{"):
                kind, part = part[1:-1], make[part[1:-1]]()
                if kind in ADDED:
                    spans.append((len(text), len(text) + len(part), kind))
            text += part
        rows.append((text + " " + word(), spans))
    return rows


# Tokens and their windows -------------------------------------------------------------------------

LABELS = ["O", *(f"{x}-{k}" for k in ADDED for x in "BI")]
#: A token with the white space before it, so that lengths add up to places.
TOKEN = re.compile(r"\s*(?:[0-9]+|[^\W0-9_]+|\S)")
#: Where white space begins.
BREAK = re.compile(r"(?<=\S)\s")
MARKS = ".,:;-/+@#()\"'_=|<>&"
SHAPES = ["", *(f"d{n}" for n in range(1, 10)), "year", *MARKS, "p", "X", "x", "X2", "XX", "Xx", "xx", "o"]
SHAPE = {x: i for i, x in enumerate(SHAPES)}
CUE_OF = {w: i for i, ws in enumerate(CUES.values(), 1) for w in ws}
#: Space before a token: none, on the line, a line's end.
N_CUES, GAPS = len(CUES) + 1, 3
CODES = len(SHAPES) * N_CUES * GAPS
#: Tokens after a cue within which it is remembered.
MEMORY = 8


def shape(w: str) -> str:
    if w[0] in "0123456789":
        return "year" if len(w) == 4 and w[:2] in ("19", "20") else f"d{min(len(w), 9)}"
    if not w[0].isalpha():
        return w if w in MARKS else "p"
    if len(w) == 1:
        return "X" if w.isupper() else "x" if w.islower() else "o"
    if w.isupper():
        return "X2" if len(w) == 2 else "XX"
    return "Xx" if w[0].isupper() else "xx" if w[0].islower() else "o"


def code(token: str) -> int:
    w = token.lstrip()
    gap = 0 if len(w) == len(token) else 2 if "\n" in token else 1
    return (SHAPE[shape(w)] * N_CUES + CUE_OF.get(w.lower(), 0)) * GAPS + gap


class Coder:
    """Codes of a text's tokens; those of tokens met before are kept."""

    KEPT = 400_000

    def __init__(self):
        self.known: dict[str, int] = {}

    def tokens(self, text: str) -> list[str]:
        """All tokens in order; long texts are split at white space first."""
        if len(text) <= PIECE:
            return TOKEN.findall(text)
        out, at = [], 0
        while at < len(text):
            m = BREAK.search(text, at + PIECE)
            stop = m.start() if m else len(text)
            out += TOKEN.findall(text, at, stop)
            at = stop if stop > at else len(text)
        return out

    def __call__(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.KEPT:
            known.clear()
        for w in set(tokens):
            if w not in known:
                known[w] = code(w)
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))


def windows(codes: np.ndarray) -> np.ndarray:
    """For each token one integer: its code, two before and two after it (CODES beyond the ends), and the last cue before it."""
    n, step = len(codes), CODES + 1
    x = np.concatenate([[CODES, CODES], codes, [CODES, CODES]])
    key = np.zeros(n, np.int64)
    for k in range(5):
        key = key * step + x[k : n + k]
    cue = codes // GAPS % N_CUES
    last = np.maximum.accumulate(np.where(cue > 0, np.arange(n), -MEMORY - 1)) if n else np.zeros(0, np.int64)
    last = np.concatenate([[-MEMORY - 1], last[:-1]])[:n]
    return key * N_CUES + np.where(np.arange(n) - last <= MEMORY, cue[np.maximum(last, 0)], 0)


def features(window: int) -> list[str]:
    window, memory = divmod(int(window), N_CUES)
    parts = []
    for _ in range(5):
        window, c = divmod(window, CODES + 1)
        parts.append(("^", 0, 0) if c == CODES else (SHAPES[c // GAPS // N_CUES], c // GAPS % N_CUES, c % GAPS))
    (s4, c4, g4), (s3, c3, g3), (s2, c2, g2), (s1, c1, g1), (s0, c0, g0) = parts  # s2 is the token itself
    return [
        f"0{s2}", f"-{s1}|{g2}", f"+{s3}|{g3}", f"-2{s0}", f"+2{s4}", f"-0{s1}|{s2}|{g2}", f"0+{s2}|{s3}|{g3}", f"all{s0}|{s1}|{s2}", f"mid{s1}|{s2}|{s3}|{g2}{g3}", f"next{s2}|{s3}|{s4}|{g3}{g4}",
        f"w{c2}", f"w-{c1}|{s2}", f"w-2{c0}|{s1}|{s2}", f"w+{c3}", f"m{memory}|{s2}", f"m-{memory}|{s1}|{s2}", f"m+{memory}|{s2}|{s3}|{g3}",
    ]


# The field ----------------------------------------------------------------------------------------


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], steps: int = 60, l2: float = 0.02) -> dict:
    """Weights by maximum likelihood: forward-backward over padded sequences, Adam on all rows at once."""
    seqs, gold, index, coder = [], [], {}, Coder()
    for text, spans in rows:
        toks = coder.tokens(text)
        if not toks:
            continue
        start = np.cumsum([len(w) for w in toks]) - [len(w.lstrip()) for w in toks]
        y = [0] * len(toks)
        for a, b, kind in spans:
            for n, i in enumerate(np.flatnonzero((a <= start) & (start < b))):
                y[i] = LABELS.index(("I-" if n else "B-") + kind)
        seqs.append([[index.setdefault(f, len(index)) for f in features(w)] for w in windows(coder(toks))])
        gold.append(y)
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))  # so that those still running are the first ones
    seqs, gold = [seqs[i] for i in order], [gold[i] for i in order]
    n, t, k, L = len(seqs), max(map(len, seqs)), len(seqs[0][0]), len(LABELS)
    lens = np.array([len(s) for s in seqs])
    running = [int((lens > j).sum()) for j in range(t)]
    x, y, on = np.full((n, t, k), len(index)), np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, s in enumerate(seqs):
        x[i, : len(s)], y[i, : len(s)], on[i, : len(s)] = s, gold[i], True
    w, tr = np.zeros((len(index) + 1, L)), np.zeros((L, L))
    both = on[:, 1:] & on[:, :-1]
    gold_tr = np.zeros((L, L))
    np.add.at(gold_tr, (y[:, :-1][both], y[:, 1:][both]), 1)
    eye, used = np.eye(L), x[on]
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)]
    for step in range(1, steps + 1):
        e = np.zeros((n, t, L))
        e[on] = w[used].sum(1)
        a, b = np.zeros((n, t, L)), np.zeros((n, t, L))
        a[:, 0] = e[:, 0]
        for j in range(1, t):
            m = running[j]
            a[:m, j] = _logsum(a[:m, j - 1, :, None] + tr, 1) + e[:m, j]
        z = _logsum(a[np.arange(n), lens - 1], 1)
        for j in range(t - 2, -1, -1):
            m = running[j + 1]
            b[:m, j] = _logsum(tr + (e[:m, j + 1] + b[:m, j + 1])[:, None, :], 2)
        p = np.exp(a + b - z[:, None, None])
        place = np.broadcast_to(z[:, None], both.shape)[both][:, None, None]
        edge = np.exp(a[:, :-1][both][:, :, None] + tr + (e + b)[:, 1:][both][:, None, :] - place).sum(0)
        diff = (p - eye[y])[on]
        gw = np.stack([sum(np.bincount(used[:, j], diff[:, c], len(w)) for j in range(k)) for c in range(L)], 1)
        gw, gt = (gw + l2 * w) / n, (edge - gold_tr + l2 * tr) / n
        gw[-1] = 0
        for v, g, i in ((w, gw, 0), (tr, gt, 2)):
            state[i] = 0.9 * state[i] + 0.1 * g
            state[i + 1] = 0.99 * state[i + 1] + 0.01 * g * g
            v -= 0.3 * (state[i] / (1 - 0.9**step)) / (np.sqrt(state[i + 1] / (1 - 0.99**step)) + 1e-4)
    return {"index": index, "w": w, "tr": tr}


def trained(labelled: DataFrame) -> dict:
    """From a labelled table with columns text and spans (array of struct start, end, kind); TRAIN_ROWS of its rows by a hash at most."""
    rows = labelled.where("text is not null").orderBy(F.xxhash64("text"), "text").limit(TRAIN_ROWS).collect()
    return train([(r["text"], [(s["start"], s["end"], s["kind"]) for s in r["spans"] or []]) for r in rows])


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "text string, spans array<struct<start int, end int, kind string>>")


def viterbi(e: np.ndarray, tr: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Best labels of padded sequences, e[sequence, place, label]."""
    n, t, L = e.shape
    back = np.zeros((n, t, L), np.int8)
    s = e[:, 0]
    for j in range(1, t):
        c = s[:, :, None] + tr
        back[:, j] = c.argmax(1)
        s = np.where((j < lens)[:, None], c.max(1) + e[:, j], s)
    y = np.zeros((n, t), np.int64)
    now = s.argmax(1)
    rows = np.arange(n)
    for j in range(t - 1, -1, -1):
        y[:, j] = np.where(j < lens, now, 0)
        now = np.where((j < lens) & (j > 0), back[rows, j, now], now)
    return y


class Field:
    #: Windows whose sums a worker keeps at most.
    KEPT = 500_000
    def __init__(self, model: dict):
        self.index, self.w, self.tr, self.coder = model["index"], model["w"], model["tr"], Coder()
        tr = self.tr
        # the most that a label can gain over outside by the transitions to it and from it
        self.gain = np.maximum((tr - tr[:, :1]).max(0), 0) + np.maximum((tr - tr[:1]).max(1), 0)
        self.clear()

    def clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.table = np.zeros((1 << 12, len(LABELS)))
        self.certain = np.zeros(1 << 12, bool)

    def sums(self, keys: np.ndarray) -> np.ndarray:
        none = len(self.w) - 1
        out = np.empty((len(keys), len(LABELS)))
        for i in range(0, len(keys), 4096):
            out[i : i + 4096] = self.w[[[self.index.get(f, none) for f in features(k)] for k in keys[i : i + 4096]]].sum(1)
        return out

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the table, which has the sums of each window and whether it is outside for certain."""
        distinct, where = np.unique(keys, return_inverse=True)
        if len(self.rows) > self.KEPT:
            self.clear()
        rows = self.rows
        if new := [k for k in distinct.tolist() if k not in rows]:
            n = len(rows)
            while n + len(new) > len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
                self.certain = np.concatenate([self.certain, np.zeros_like(self.certain)])
            e = self.table[n : n + len(new)] = self.sums(np.array(new))
            self.certain[n : n + len(new)] = (e - e[:, :1] + self.gain)[:, 1:].max(1) < 0
            rows |= zip(new, range(n, n + len(new)))
        return np.fromiter(map(rows.__getitem__, distinct.tolist()), np.int64, len(distinct))[where]

    @staticmethod
    def parts(certain: np.ndarray) -> list[tuple[int, int]]:
        """Sequences (from, to) that are decoded by themselves: what isn't certain, with a certain place on either side."""
        edges = np.flatnonzero(np.diff(np.concatenate([[True], certain, [True]]).astype(np.int8)))
        return [(max(a - 1, 0), min(b + 1, len(certain))) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]

    def spans(self, texts: list[str], taken: list[list[tuple[int, str, int]]]) -> list[list[tuple[int, str, int]]]:
        """For each text the field's spans that overlap none of those taken."""
        out: list[list[tuple[int, str, int]]] = [[] for _ in texts]
        held, size = [], 0
        for k, t in enumerate(texts):
            codes = self.coder(self.coder.tokens(t))
            held.append((k, windows(codes)))
            size += len(codes)
            if size > CELLS or k == len(texts) - 1:
                self._decode(held, texts, taken, out)
                held, size = [], 0
        return out

    def _decode(self, held: list, texts: list[str], taken: list, out: list) -> None:
        rows = self.look_up(np.concatenate([keys for _, keys in held]))
        seqs, at = [], 0
        for k, keys in held:
            own, at = rows[at : at + len(keys)], at + len(keys)
            seqs += [(k, a, own[a:b]) for a, b in self.parts(self.certain[own])]
        seqs.sort(key=lambda s: len(s[2]))
        found: dict[int, list] = {}
        i = 0
        while i < len(seqs):
            n = 1
            while i + n < len(seqs) and (n + 1) * len(seqs[i + n][2]) <= CELLS:
                n += 1
            part, i = seqs[i : i + n], i + n
            lens = np.array([len(s[2]) for s in part])
            on = np.arange(int(lens.max()))[None] < lens[:, None]
            e = np.zeros((*on.shape, len(LABELS)))
            own = np.concatenate([s[2] for s in part])
            e[on] = np.where(self.certain[own, None] & (np.arange(len(LABELS)) > 0), -1e9, self.table[own])
            best = viterbi(e, self.tr, lens)
            for j in np.flatnonzero(best.any(1)):
                found.setdefault(part[j][0], []).append((part[j][1], best[j, : lens[j]]))
        for k, ys in found.items():
            toks = self.coder.tokens(texts[k])
            y = np.zeros(len(toks), np.int64)
            for a, labels in ys:
                y[a : a + len(labels)] = np.maximum(y[a : a + len(labels)], labels)
            out[k] = self._read(toks, y, taken[k])

    @staticmethod
    def _read(toks: list[str], y: np.ndarray, taken: list) -> list[tuple[int, str, int]]:
        ends = np.cumsum([len(w) for w in toks])
        found, i, at = [], 0, np.flatnonzero(y)
        for i in at.tolist():
            label = LABELS[y[i]]
            if label[0] != "B":
                continue
            j = i + 1
            while j < len(toks) and LABELS[y[j]] == f"I-{label[2:]}":
                j += 1
            a, b = int(ends[i]) - len(toks[i].lstrip()), int(ends[j - 1])
            if not any(x < b and a < z for x, _, z in taken):
                found.append((a, label[2:], b))
        return found


def listed(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def _finder(model):
    field = Field(model)

    def find(texts):
        base = [base_spans(t) for t in texts]
        more = field.spans(texts, base)
        return base, [sorted(b + m, key=lambda s: (s[0], ORDER[s[1]], s[2])) if m else b for b, m in zip(base, more)]

    return find


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = spark.sparkContext.broadcast(trained(labelled_table(spark)))

    def make():
        find = _finder(model.value)

        def f(cols):
            base, every = find([t or "" for t in cols["text"]])
            counts = [[sum(k == kind for _, k, _ in b) for b in base] for kind in BASE]
            return [cols["doc_id"], *counts, [hashlib.sha256(listed(b).encode()).hexdigest() for b in base], [listed(s) for s in every]]

        return f

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return map_rows(docs, make, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each span replaced by its kind; overlapping ones become the first one's."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """All documents, with personal data in their texts replaced; n_chars follows where it is a column."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(trained(labelled_table(spark)))
    own, names = plain(docs.columns), docs.columns

    def make():
        find = _finder(model.value)

        def f(cols):
            _, every = find([t or "" for t in cols["text"]])
            return [[redacted(t, s) if s else t for t, s in zip(cols["text"], every)]]

        return f

    out = beside(docs, ["text"], make, "redacted string", ("text",))
    new = {"text": F.col("redacted")}
    if "n_chars" in names:
        new["n_chars"] = F.length("redacted").cast(docs.schema["n_chars"].dataType)
    return out.select(*[(new[b] if b in new else F.col(a)).alias(a) for a, b in zip(own, names)]).toDF(*names)
