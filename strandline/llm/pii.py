"""Personal data: fixed patterns, and a linear-chain conditional random field for what patterns can't tell.

The base finds emails, IPv4 addresses, payment cards and telephone numbers by pattern and check. The field adds names, street addresses and account
numbers. It reads a line as a chain of tokens (words, numbers, marks) with features of word shape and of known words at the token, before
and after it; emissions are sums of looked-up weights. It is trained on the driver from ``EXAMPLES``, a small labelled table, by gradient ascent on the
exact likelihood (forward and backward sums in numpy), with lines of noise by rule beside the table, and decoded by Viterbi, all chains of a batch side by side. A chain is a whole line, however
long; the way back takes a byte for each token and label. Where a span of the field overlaps one of the base, the base's is listed;
``scrub`` replaces both as one.

Null text counts as empty. Rows are independent: repeated rows, null ids and other columns do no harm, and an empty table gives no rows. Offsets are
code points. A batch holds about a MiB, or one text that is longer, and takes about 300 bytes for each of its tokens.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import _common

BASE, ADDED = ("email", "ip", "card", "phone"), ("name", "address", "account")
KINDS = (*BASE, *ADDED)
LABELS = ["O", *(f"{p}-{k}" for k in ADDED for p in "BI")]
Span = tuple[int, int, int]  # kind, start, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match can only begin where a run of digits does
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")

#: The labelled table: words of a person's name, a street address and an account number stand in brackets with their kind.
EXAMPLES = """
my name is [name:Anna Schmidt] and i live here
My name is [name:John Miller] .
his name is [name:Peter van Dyke] , she said
name : [name:Maria Lopez]
Name : [name:Li Wei]
contact [name:Carlos Ruiz] at the office
Contact : [name:Emma Dubois]
Mr . [name:Brown] wrote the letter
Mr [name:Otto Weber] wrote to us
Mrs . [name:Helen Clark] came late
Ms [name:Sara Lind] agreed
Dr . [name:Ivan Petrov] is in
dear [name:Julia] , thank you
Dear [name:Tom Baker] , we thank you
signed by [name:Paul Moreau] on monday
regards , [name:Nina Rossi]
Regards , [name:Max Keller]
je m'appelle [name:Claire Martin] et
ich heiße [name:Lukas Braun] und
me llamo [name:Diego Torres] y
he lives at [address:12 Oak Street] in town
address : [address:221 Baker Street]
Address : [address:7 Hill Road] , upstairs
ship to [address:45 Long Avenue] please
she moved to [address:9 Park Lane] last year
our office is at [address:1600 Lake Drive] .
visit us at [address:88 Main Street] , room 4
wohnt in der [address:Hauptstraße 12] und
Adresse : [address:Gartenweg 5]
they live at [address:318 Maple Street] now
he lives at [address:41 Birch Road] with us
send it to [address:6 Orchard Lane] , thank you
he works at [address:72 Queen Avenue] .
the shop is at [address:540 Forest Drive] , floor 3
meet me at [address:15 Mill Road] today
our address is [address:1021 Cedar Street]
home address : [address:28 Church Lane]
ship the parcel to [address:93 Sunset Avenue] please
ship to [address:3 Bridge Lane] today
visit us at [address:207 Garden Drive] near the park
I grew up at [address:667 Valley Drive] in the north
wohnhaft in der [address:Lindenallee 31] .
Mr . [name:Turner] agreed
Mrs . [name:Bishop] said so
Dr . [name:Long] was late
Mr . [name:Adler] and the others left
account number [account:4465758382] is closed
account : [account:00123456789]
Account no . [account:99887766554]
the iban [account:DE89370400440532013000] was given
IBAN : [account:GB82WEST12345698765432]
passport no . [account:X1234567] expired
passport number [account:C01X00T47] is lost
ssn [account:123-45-6789] on file
SSN : [account:987-65-4321]
social security number [account:111-22-3333] .
tax id [account:12345678901]
token = " [account:9f86d081884c7d659a2feaa0c55ad015a3bf4f1b] "
token : [account:5e884898da28047151d0e56f8dc62927]
api key = [account:AKX7TQ29ZLM40PRW8BND]
the secret is [account:sk1f3a9c0d8e7b6a5f4e3d2c1b] , keep it
password = " [account:hunter2X9qLm] "
the street was long and the road was wide
The Street Was Long and the Avenue was Wide .
in 2021 the 12 people met at 4 places
name of the rose is a book
the name was not given
the account is open
An account of the war and its end .
she wrote a letter to the office in Paris
La casa es grande . El perro come .
Der Hund ist da . Die Katze auch .
Le chat est la . Un chien aussi .
On monday we met the team of the Bank of Ireland .
version 3.4.5 of the tool has 10 parts
price is 4,500 or 1200 for 30 days
call 555 or write to us today
see page 12 and table 7 for more
the number 4465758382 is large
Total 99887766554 units were made
Monday Tuesday Wednesday | Thursday | Friday
THE WHOLE LINE IS IN CAPITAL LETTERS !!
copyright 2020 all rights reserved under the license
id 4411 of part B12 in box 9
a road of 12 miles and a street of 5
at 9 we go to the park and to the lake
Word Other Third Fourth , Fifth Sixth . Seventh and Eighth of Ninth .
Licensed under the Apache License , Version 2.0 of the GNU General Public License , version 3
Permission is granted under the MIT License . The Software and the Copyright Holders .
B12 and C01X00T47 in X77 , ER2 , of A1B2C3 . is DE89 on 3F
"""
#: Lines of noise that training adds to the table, all of them without personal data.
NOISE = 120
_classes: list[np.ndarray] = []


def noise(lines: int = NOISE, seed: int = 5) -> list[str]:
    """Lines of made-up words, capitalized at random, between marks and numbers: shapes alone, without a cue, are no personal data.

    Words are letters of the table's own plain lines, drawn one by one, so that no word of it comes about but by chance.
    """
    rng = np.random.default_rng(seed)
    letters = np.array([c for line in EXAMPLES.split("\n") if "[" not in line for c in line.lower() if c.isalpha()])
    short = sorted({w for line in EXAMPLES.split("\n") if "[" not in line for w in line.split() if w.isalpha() and len(w) < 4})
    # A cue behind which a sentence ends is none, save where the table has a stop between the two, as behind a title.
    cues = [(w.lower(), dot, kind) for w, dot, kind in re.findall(r"(\w+) (\. )?\[(\w+):", EXAMPLES)]
    stops = sorted({w for w, _, kind in cues} - {w for w, dot, kind in cues if dot and kind == "name"})
    out = []
    for n in range(lines):
        line, capital, mark, number = [], *rng.choice([0.05, 0.2, 0.5, 0.9], 3).tolist()
        if n % 2:
            line = [str(rng.choice(letters)) * 2, stops[n // 2 % len(stops)] + ".", "".join(rng.choice(letters, int(rng.integers(2, 9)))).capitalize()]
        for _ in range(int(rng.integers(8, 22))):
            kind = rng.random()
            if kind < 0.25 * number:
                word = "".join(rng.choice(list("0123456789"), int(rng.integers(1, 13))))
            elif kind < 0.3 * number:
                word = "".join(rng.choice(list("ABCDEFGHJKLMNPRTUVXYZ0123456789"), int(rng.integers(2, 10))))
            else:
                word = str(rng.choice(short)) if rng.random() < 0.4 else "".join(rng.choice(letters, int(rng.integers(1, 10))))
                word = word.capitalize() if rng.random() < capital else word
            line.append(word)
            if rng.random() < 0.4 * mark:
                sign = str(rng.choice(list(".,;:!?|()-#*%&$")))
                line[-1:] = [line[-1] + sign * int(rng.integers(1, 4))] if rng.random() < 0.7 else [line[-1], sign]
        out.append(" ".join(line))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base, by kind and then start. Each kind: leftmost matches that don't overlap, less those that fail their check."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:  # an email needs an @ with local characters before it; the match begins at the first of these
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        free = m.end() if m else at + 1
        if m:
            out.append((0, start, free))
        at = text.find("@", free)
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _kinds_of_points() -> np.ndarray:
    """For each code point: 0 white space, 1 small letter, 2 capital letter, 3 digit, 4 mark."""
    if not _classes:
        def kind(c: str) -> int:
            return 0 if c.isspace() else 3 if "0" <= c <= "9" else (2 if c.isupper() else 1) if c.isalpha() else 4

        _classes.append(np.fromiter((kind(chr(i)) for i in range(0x110000)), np.int8, 0x110000))
    return _classes[0]


_ODD = 0x9E3779B97F4A7C15


class Tokens:
    """The tokens of texts: start and end in the joined text, shape, hash of the letters, and the chain that each belongs to."""

    SHAPES = 1 + 5 * 4 + 12 + 64 + 8

    def __init__(self, texts: list[str]):
        from strandline.llm.quality import _power

        joined = "\n".join(texts) + "\n"
        self.first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        kind = _kinds_of_points()[points]
        group = np.where(kind == 2, 1, kind)
        # a token is a run of letters and digits, or one mark
        word = (group == 1) | (group == 3)
        begins = np.empty(len(points), bool)
        begins[0], begins[1:] = kind[0] != 0, (word[1:] & ~word[:-1]) | (kind[1:] == 4)
        self.start = np.flatnonzero(begins)
        ends = np.flatnonzero(word & ~np.append(word[1:], False)) + 1
        marks = np.flatnonzero(kind == 4) + 1
        self.end = np.sort(np.concatenate([ends, marks]))
        n = self.end - self.start
        add = lambda x: np.concatenate([[0], np.cumsum(x)])
        inside = lambda x: (c := add(x))[self.end] - c[self.start]
        small, large, digit = inside(kind == 1), inside(kind == 2), inside(kind == 3)
        mark = kind[self.start] == 4
        cap = (kind[self.start] == 2) & (large == 1) & (small > 0) & (digit == 0)
        form = np.select([small == n, large == n, cap, digit == 0], [0, 1, 2, 3], 4)
        shape = 1 + form * 4 + np.minimum(3, n - 1)
        shape = np.where(digit == n, 21 + np.minimum(11, n - 1), shape)
        sign = points[self.start]
        self.shape = np.where(mark, np.where(sign < 128, 33 + sign % 64, 97 + sign % 8), shape).astype(np.int64)
        up, down = _power(len(points) + 1)
        lower = np.where((points >= 65) & (points <= 90), points + 32, points).astype(np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((lower + np.uint64(1)) * up[:-1])])
        self.hash = (sums[self.end] - sums[self.start]) * down[self.start]
        lines = add(points == 10)[self.start]
        new = np.flatnonzero(np.concatenate([[True], lines[1:] != lines[:-1]])) if len(lines) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(new, len(lines)))
        self.chain, self.sizes = new, sizes  # the tokens that begin a chain (a line), and its tokens


class Field:
    """Weights: shapes and known words at offsets -2 to 1, times labels; transitions between labels."""

    OFFSETS = (-2, -1, 0, 1)

    def __init__(self, known: np.ndarray):
        self.known, n = known, len(LABELS)  # sorted hashes of the words of the examples
        self.shape = np.zeros((len(self.OFFSETS), Tokens.SHAPES, n))
        self.word = np.zeros((len(self.OFFSETS), len(known) + 1, n))
        self.step, self.begin = np.zeros((n, n)), np.zeros(n)

    def ids(self, tokens: Tokens) -> np.ndarray:
        """Number of each token's word; 0 if it isn't known."""
        at = np.minimum(np.searchsorted(self.known, tokens.hash), len(self.known) - 1)
        return np.where(self.known[at] == tokens.hash, at + 1, 0)

    def moved(self, tokens: Tokens, x: np.ndarray, d: int) -> np.ndarray:
        """``x`` at distance d within the chain; -1 beyond its ends."""
        owner = np.repeat(np.arange(len(tokens.chain)), tokens.sizes)
        at = np.arange(len(x)) + d
        ok = (at >= tokens.chain[owner]) & (at < tokens.chain[owner] + tokens.sizes[owner])
        return np.where(ok, x[np.clip(at, 0, len(x) - 1)], -1)

    def emissions(self, tokens: Tokens) -> np.ndarray:
        ids, out = self.ids(tokens), np.zeros((len(tokens.start), len(LABELS)))
        for o, d in enumerate(self.OFFSETS):
            shape, word = self.moved(tokens, tokens.shape, d), self.moved(tokens, ids, d)
            out += np.where(shape[:, None] >= 0, self.shape[o][shape], 0.0)
            rare = np.flatnonzero(word > 0)
            out[rare] += self.word[o][word[rare]]
        return out

    def seen(self, tokens: Tokens) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Shapes and known words of the tokens at each offset."""
        ids = self.ids(tokens)
        return tuple([self.moved(tokens, x, d) for d in self.OFFSETS] for x in (tokens.shape, ids))

    def likelihood(self, tokens: Tokens, gold: np.ndarray, seen: tuple | None = None) -> tuple[float, list[np.ndarray]]:
        """Logarithm of the probability of the labels, and its gradient by each group of weights: forward and backward sums over all chains at once."""
        shapes, words = seen or self.seen(tokens)
        n, longest, chains = len(LABELS), int(tokens.sizes.max()), len(tokens.chain)
        mask = np.arange(longest)[None, :] < tokens.sizes[:, None]
        at = np.where(mask, tokens.chain[:, None] + np.arange(longest)[None, :], 0)
        lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        scores = self.emissions(tokens)
        e = scores[at]
        alpha, beta = np.zeros((longest, chains, n)), np.zeros((longest, chains, n))
        alpha[0] = e[:, 0] + self.begin
        for i in range(1, longest):
            new = lse(alpha[i - 1][:, :, None] + self.step, 1) + e[:, i]
            alpha[i] = np.where(mask[:, i, None], new, alpha[i - 1])
        for i in range(longest - 2, -1, -1):
            new = lse(self.step[None] + (e[:, i + 1] + beta[i + 1])[:, None, :], 2)
            beta[i] = np.where(mask[:, i + 1, None], new, beta[i + 1])
        total = lse(alpha[-1], 1)
        expected = np.exp(alpha + beta - total[None, :, None]).transpose(1, 0, 2)[mask]
        wanted = np.eye(n)[gold] - expected
        grads = [np.zeros_like(w) for w in (self.shape, self.word, self.step, self.begin)]
        for o in range(len(self.OFFSETS)):
            for g, x, least in ((grads[0], shapes[o], 0), (grads[1], words[o], 1)):
                ok = np.flatnonzero(x >= least)
                np.add.at(g[o], x[ok], wanted[ok])
        for i in range(1, longest):
            pair = np.exp(alpha[i - 1][:, :, None] + self.step + (e[:, i] + beta[i])[:, None, :] - total[:, None, None])
            grads[2] -= pair[mask[:, i]].sum(0)
        inner = np.ones(len(gold), bool)
        inner[tokens.chain] = False
        later = np.flatnonzero(inner)
        np.add.at(grads[2], (gold[later - 1], gold[later]), 1)
        grads[3] += wanted[tokens.chain].sum(0)
        value = scores[np.arange(len(gold)), gold].sum() + self.begin[gold[tokens.chain]].sum() + self.step[gold[later - 1], gold[later]].sum() - total.sum()
        return float(value), grads

    def decode(self, tokens: Tokens) -> np.ndarray:
        """The best label of each token."""
        scores, n = self.emissions(tokens), len(LABELS)
        out = np.zeros(len(scores), np.int64)
        if not len(scores):
            return out
        order = np.argsort(-tokens.sizes, kind="stable")
        start, size = tokens.chain[order], tokens.sizes[order]
        best = scores[start] + self.begin
        back = np.zeros((len(scores), n), np.int8)
        longer = np.searchsorted(-size, -np.arange(int(size[0])), side="left").tolist()  # how many chains have a token at each place
        for i in range(1, int(size[0])):
            live = longer[i]
            paths, at = best[:live, :, None] + self.step, start[:live] + i
            back[at] = paths.argmax(1)
            best[:live] = paths.max(1) + scores[at]
        label = best.argmax(1)
        for i in range(int(size[0]) - 1, 0, -1):
            live = longer[i]
            at = start[:live] + i
            out[at] = label[:live]
            label[:live] = back[at, label[:live]]
        out[start] = label
        return out

    def spans(self, tokens: Tokens) -> list[tuple[int, Span]]:
        """(text, span) in the texts' own code points."""
        labels = self.decode(tokens)
        owner = np.searchsorted(tokens.first, tokens.start, side="right") - 1
        begins = np.zeros(len(labels), bool)
        begins[tokens.chain] = True
        out: list[tuple[int, Span]] = []
        for t in np.flatnonzero(labels).tolist():
            kind, inner = (int(labels[t]) - 1) // 2, (int(labels[t]) - 1) % 2
            text, s, e = int(owner[t]), int(tokens.start[t] - tokens.first[owner[t]]), int(tokens.end[t] - tokens.first[owner[t]])
            if inner and out and not begins[t] and labels[t - 1] > 0 and (int(labels[t - 1]) - 1) // 2 == kind:
                out[-1] = (text, (out[-1][1][0], out[-1][1][1], e))
            else:
                out.append((text, (len(BASE) + kind, s, e)))
        return out


def parse(examples: str = EXAMPLES) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """Sentences, and the spans (kind of ADDED, start, end) in each."""
    texts, marks = [], []
    for line in examples.strip().split("\n"):
        text, spans, at = "", [], 0
        for m in re.finditer(r"\[(\w+):([^\]]*)\]", line):
            text += line[at : m.start()]
            spans.append((ADDED.index(m[1]), len(text), len(text) + len(m[2])))
            text, at = text + m[2], m.end()
        texts.append(text + line[at:])
        marks.append(spans)
    return texts, marks


def train(examples: str = EXAMPLES, rounds: int = 200, rate: float = 0.15, decay: float = 0.02) -> Field:
    """The field that maximizes the likelihood of the examples' labels, less a penalty on squared weights (Adam steps)."""
    texts, marks = parse(examples)
    more = noise()
    texts, marks = texts + more, marks + [[] for _ in more]
    tokens = Tokens(texts)
    field, n, owner = Field(np.unique(tokens.hash)), len(LABELS), np.searchsorted(tokens.first, tokens.start, side="right") - 1
    gold = np.zeros(len(tokens.start), np.int64)
    for t in range(len(gold)):
        for kind, s, e in marks[owner[t]]:
            at = tokens.start[t] - tokens.first[owner[t]]
            if s <= at < e:
                gold[t] = 1 + 2 * kind + (at > s)
    # Only words that stand right before or after a span, and those of addresses, are known to the field; all others, names too, are told by
    # their shape and surroundings alone, so that a word which the table lacks is no evidence.
    near = np.flatnonzero(gold)
    near = np.unique(np.clip(near[:, None] + np.array([-2, -1, 1]), 0, len(gold) - 1))
    field = Field(np.union1d(tokens.hash[near[gold[near] == 0]], tokens.hash[gold == 1 + 2 * ADDED.index("address") + 1]))
    weights = [field.shape, field.word, field.step, field.begin]
    first, second, seen = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], field.seen(tokens)
    for r in range(1, rounds + 1):
        _, grads = field.likelihood(tokens, gold, seen)
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            g -= decay * w
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w += rate * (1 - r / (rounds + 1)) * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    for i in range(n):  # an inside label can't follow another kind
        for j in range(2, n, 2):
            if i not in (j, j - 1):
                field.step[i, j] = -1e9
    field.begin[2::2] = -1e9
    return field


def every(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """For each text the spans of the base, and those of the field, by kind and then start; they may overlap."""
    extra: list[list[Span]] = [[] for _ in texts]
    for i, span in field.spans(Tokens(texts)):
        extra[i].append(span)
    return [(base_spans(t), sorted(x)) for t, x in zip(texts, extra, strict=True)]


def apart(spans: list[Span], others: list[Span]) -> list[Span]:
    """The spans that overlap none of the others, which are laid together and searched."""
    edges: list[int] = []
    for _, s, e in sorted(others, key=lambda x: x[1:]):
        if edges and s <= edges[-1]:
            edges[-1] = max(edges[-1], e)
        else:
            edges += [s, e]
    # a span meets none of the stretches if it begins outside of them and the next one begins no earlier than it ends
    return [x for x in spans if (i := bisect.bisect_right(edges, x[1])) % 2 == 0 and (i == len(edges) or edges[i] >= x[2])]


def find(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """For each text the spans of the base, and all spans, by kind and then start."""
    return [(base, base + apart(extra, base)) for base, extra in every(texts, field)]


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with its kind in brackets in place of each span; spans that overlap are replaced as one, by the kind of the longest (of equal ones the first kind)."""
    joined: list[tuple[int, int, Span]] = []
    for span in sorted(spans, key=lambda x: x[1:]):
        if joined and span[1] < joined[-1][1]:
            s, e, longest = joined.pop()
            joined.append((s, max(e, span[2]), min(longest, span, key=lambda x: (x[1] - x[2], x[0]))))
        else:
            joined.append((span[1], span[2], span))
    out, at = [], 0
    for s, e, longest in joined:
        out += [text[at:s], f"[{KINDS[longest[0]].upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def detect(spark: SparkSession, docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, counts of the base's kinds, base_sha256 and spans of every document. The broadcast field has a fixed size."""
    shared = spark.sparkContext.broadcast(field or train())
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]

    def run(batches):
        for b in _common.slices(batches):
            rows = []
            for base, spans in find(_common.texts_of(b.column("text")), shared.value):
                n = [0] * len(BASE)
                for k, _, _ in base:
                    n[k] += 1
                rows.append((*n, hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans)))
            kinds = [pa.int64()] * len(BASE) + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _common.texts(slim).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def scrub(spark: SparkSession, docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with personal data replaced in the text; a null text stays null."""
    shared = spark.sparkContext.broadcast(field or train())
    names = docs.columns

    def run(batches):
        for b in _common.slices(batches):
            texts = _common.texts_of(b.column("text"))
            clean = [redact(t, base + extra) for t, (base, extra) in zip(texts, every(texts, shared.value), strict=True)]
            valid = b.column("text").is_valid().to_pylist()
            new = pa.array([t if ok else None for t, ok in zip(clean, valid, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new if n == "text" else b.column(n) for n in names], names=names)

    return _common.texts(docs).mapInArrow(run, docs.schema)
