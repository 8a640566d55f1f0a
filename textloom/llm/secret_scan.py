"""Secrets in documents, by a character convolutional network over candidates and their context.

1. Candidates: every run of at least MIN_RUN characters of the alphabets that keys use which holds a digit (or
   four capitals and no digit, from MIN_LETTERS characters), every value of at least MIN_VALUE characters that is assigned to a name or stands in a URL as a parameter or password, and every private key
   header. A document may hold any number, one may lie within another, and each text is searched by itself.
2. Network: characters of the candidate and of CONTEXT bytes on either side are embedded, convolved, and reduced by a
   maximum over the candidate and one over the context; a hidden layer gives a logit. It is numpy throughout. Candidates
   longer than WINDOW are scored in overlapping windows that cover them whole, and the highest counts.
3. Training: on labelled findings (text, start, end, kind, secret). Without a table of findings, findings() makes them from a seed: keys,
   tokens and passwords of many formats, and what looks like them (digests, ids, addresses, versions, dates, names of files), in sentences.
4. Calibration on findings held out: logits are divided by a temperature that minimises log loss; the threshold of each kind
   of candidate is the highest up to one half that keeps recall of at least RECALL. A secret that is no candidate counts as missed.

Documents are scored where they are read; nothing is shuffled.

Defined results: missing and empty texts hold no secrets. Repeated rows are reported each, rows without id as well, and so is a secret that occurs twice, by its
character offset. Of reported spans that lie within another reported one the outer stays. Very long texts and candidates are scored whole. Columns other than the id and the text play no part, whatever
their names. Findings without candidates of both labels raise ValueError.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrow_text import runs, slices

MIN_RUN, MIN_LETTERS, MIN_VALUE, WINDOW, CONTEXT, RECALL = 16, 20, 3, 64, 24, 0.995
#: What a candidate is: a value assigned to a name, a bare run, a private key header.
KINDS = ("assigned", "bare", "header")
FINDINGS, SEED = 12_000, 7
EMBED, FILTERS, TAPS, HIDDEN = 12, 40, 7, 24

_KEY = np.zeros(256, bool)
_KEY[[ord(c) for c in string.ascii_letters + string.digits + "_+/-"]] = True
_KEY[ord(".")] = True
_ALPHA, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_ALPHA[[ord(c) for c in string.ascii_letters]] = True
_DIGIT[48:58] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_ASSIGNED = re.compile(rb"(?<=[A-Za-z0-9_\"' ])(?::=|=>|[:=])[ \t]{0,3}[\"']?([^\s\"'<>,;()\[\]{}]{3,})")
#: Inside a URL: a parameter, or a password before @, but no port.
_IN_URL = re.compile(rb"(?<=[A-Za-z0-9_/])(?:=([^\s\"'<>,;()\[\]{}&#]{3,})|:(?!\d{1,5}(?:[/?#]|$))([^\s\"'<>,;()\[\]{}/?#]{3,}(?=@)|[^\s\"'<>,;()\[\]{}&#@/]{3,}))")
_HEADER = re.compile(rb"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----")

#: Symbols of the network: 0 outside the text, then classes of characters, case and digits kept apart.
_SYMBOL = np.ones(256, np.int64)
for _i, _c in enumerate(string.ascii_lowercase):
    _SYMBOL[ord(_c)] = 2 + _i
for _i, _c in enumerate(string.ascii_uppercase):
    _SYMBOL[ord(_c)] = 28 + _i
for _i, _c in enumerate(string.digits):
    _SYMBOL[ord(_c)] = 54 + _i
for _i, _c in enumerate(" \t\n\"'=:;,._-/+@#$%&*()<>[]{}!?\\|~`^"):
    _SYMBOL[ord(_c)] = 64 + _i
_SYMBOL[128:] = 64 + 37
SYMBOLS = 64 + 38


def candidates(raw: bytes, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and kinds of all candidates of the texts, in order; none is listed twice."""
    starts, ends = runs(_KEY[data], offs)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    ends = ends - (last == ord("."))
    keep = ends - starts >= MIN_RUN
    starts, ends = starts[keep], ends[keep]
    letters, digits, capitals = (np.concatenate([[0], np.cumsum(x[data])]) for x in (_ALPHA, _DIGIT, _CAPITAL))
    keep = (digits[ends] > digits[starts]) | ((letters[ends] > letters[starts]) & (capitals[ends] - capitals[starts] > 3) & (ends - starts >= MIN_LETTERS))
    spans = [(a, b, 1) for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]
    for low, high in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        part = raw[low:high]
        found = [(*m.span(), 2) for m in _HEADER.finditer(part)]
        for m in _ASSIGNED.finditer(part):
            a, b = m.span(1)
            if part[a : a + 2] == b"//":  # the rest of a URL
                found += [(*x.span(x.lastindex), 0) for x in _IN_URL.finditer(part[:b], a + 2)]
            else:
                found.append((a, b, 0))
        spans += [(low + a, low + b, kind) for a, b, kind in found if b - a >= MIN_VALUE]
    kinds: dict[tuple[int, int], int] = {}
    for a, b, kind in spans:
        if kinds.get((a, b), 1) == 1:  # a name tells more than none
            kinds[a, b] = kind
    out = [(a, b, kinds[a, b]) for a, b in sorted(kinds)]
    x = np.array(out, np.int64).reshape(-1, 3)
    return x[:, 0], x[:, 1], x[:, 2]


def windows_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate, first and last byte of the windows that cover each candidate, half a window apart."""
    step = WINDOW // 2
    n = np.maximum(1, -(-(ends - starts - WINDOW) // step) + 1)
    who = np.repeat(np.arange(len(starts)), n)
    k = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    first = starts[who] + k * step
    return who, first, np.minimum(first + WINDOW, ends[who])


def encode(data: np.ndarray, offs: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the candidate (padded to WINDOW) and of its surroundings (before, after), 0 beyond the text."""
    if not len(data):
        return np.zeros((0, WINDOW), np.int64), np.zeros((0, 2 * CONTEXT), np.int64)
    text = np.searchsorted(offs, first, side="right") - 1
    low, high = offs[text], offs[text + 1]

    def take(at: np.ndarray, ok: np.ndarray) -> np.ndarray:
        return np.where(ok, _SYMBOL[data[np.clip(at, 0, len(data) - 1)]], 0)

    at = first[:, None] + np.arange(WINDOW)
    inside = take(at, at < last[:, None])
    before = first[:, None] - CONTEXT + np.arange(CONTEXT)
    after = last[:, None] + np.arange(CONTEXT)
    around = np.concatenate([take(before, before >= low[:, None]), take(after, after < high[:, None])], axis=1)
    return inside, around


def _unfold(x: np.ndarray) -> np.ndarray:
    """[n, length, e] to [n, length, TAPS * e], zeros beyond the ends."""
    pad = TAPS // 2
    y = np.pad(x, ((0, 0), (pad, pad), (0, 0)))
    return np.concatenate([y[:, i : i + x.shape[1]] for i in range(TAPS)], axis=2)


class Network:
    """Two convolutions (candidate, context) with maxima over their positions, a hidden layer and a logit."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        w = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"e": rng.normal(size=(SYMBOLS, EMBED)).astype(np.float32) * np.float32(0.5), "c1": w(TAPS * EMBED, FILTERS), "b1": np.zeros(FILTERS, np.float32), "c2": w(TAPS * EMBED, FILTERS), "b2": np.zeros(FILTERS, np.float32), "h": w(3 * FILTERS + len(KINDS), HIDDEN), "bh": np.zeros(HIDDEN, np.float32), "o": w(HIDDEN, 1), "bo": np.zeros(1, np.float32)}
        self.p["e"][0] = 0

    def forward(self, inside: np.ndarray, around: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.p
        x1, x2 = _unfold(p["e"][inside]), _unfold(p["e"][around])
        a1, a2 = np.maximum(x1 @ p["c1"] + p["b1"], 0), np.maximum(x2 @ p["c2"] + p["b2"], 0)
        real = (inside > 0)[:, :, None]
        n = np.maximum(real.sum(axis=1), 1).astype(np.float32)
        top1, mean1, top2 = (a1 * real).max(axis=1), (a1 * real).sum(axis=1) / n, a2.max(axis=1)
        f = np.concatenate([top1, mean1, top2, np.eye(len(KINDS), dtype=np.float32)[kind]], axis=1)
        h = np.maximum(f @ p["h"] + p["bh"], 0)
        return (h @ p["o"] + p["bo"])[:, 0], (x1, x2, a1, a2, real, n, f, h)

    def logits(self, inside: np.ndarray, around: np.ndarray, kind: np.ndarray, batch: int = 1024) -> np.ndarray:
        parts = [self.forward(inside[i : i + batch], around[i : i + batch], kind[i : i + batch])[0] for i in range(0, len(kind), batch)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def gradients(self, inside: np.ndarray, around: np.ndarray, kind: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        logit, (x1, x2, a1, a2, real, n, f, h) = self.forward(inside, around, kind)
        d = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)[:, None]
        g = {"o": h.T @ d, "bo": d.sum(axis=0)}
        dh = (d @ p["o"].T) * (h > 0)
        g["h"], g["bh"] = f.T @ dh, dh.sum(axis=0)
        df = dh @ p["h"].T
        rows = np.arange(len(y))[:, None]
        columns = np.arange(FILTERS)[None, :]
        d1 = real * (df[:, None, FILTERS : 2 * FILTERS] / n[:, None, :])
        d1[rows, (a1 * real).argmax(axis=1), columns] += df[:, :FILTERS]
        d1 = d1 * (a1 > 0) * real
        d2 = np.zeros_like(a2)
        d2[rows, a2.argmax(axis=1), columns] = df[:, 2 * FILTERS : 3 * FILTERS]
        d2 *= a2 > 0
        g["e"] = np.zeros_like(p["e"])
        for c, b, dx, x, symbols in (("c1", "b1", d1, x1, inside), ("c2", "b2", d2, x2, around)):
            flat = dx.reshape(-1, FILTERS)
            g[c], g[b] = x.reshape(-1, x.shape[2]).T @ flat, flat.sum(axis=0)
            back = (flat @ p[c].T).reshape(*symbols.shape, TAPS, EMBED)
            for i in range(TAPS):
                shift, length = i - TAPS // 2, symbols.shape[1]
                to = slice(max(0, shift), length + min(0, shift))
                own = slice(max(0, -shift), length + min(0, -shift))
                s = symbols[:, to].ravel()
                for e in range(EMBED):
                    g["e"][:, e] += np.bincount(s, back[:, own, i, e].ravel(), minlength=SYMBOLS).astype(np.float32)
        g["e"][0] = 0
        return g

    def train(self, inside: np.ndarray, around: np.ndarray, kind: np.ndarray, y: np.ndarray, steps: int = 450, batch: int = 128, rate: float = 3e-3, seed: int = SEED) -> None:
        """Adam over whole epochs, six at least and as many as make the steps; order and start follow from the seed."""
        epochs = max(6, -(-steps * batch // len(y)))
        rng, m, v, t = np.random.default_rng(seed), {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                at = order[i : i + batch]
                t += 1
                for k, g in self.gradients(inside[at], around[at], kind[at], y[at]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= np.float32(rate * 0.6 ** (6 * epoch / epochs)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)


@dataclass
class Model:
    network: Network
    temperature: float
    threshold: np.ndarray  # a probability for each kind

    def scores(self, data: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Calibrated probability of each candidate."""
        who, first, last = windows_of(starts, ends)
        out = np.full(len(starts), -np.inf)
        for i in range(0, len(who), 4096):
            w = who[i : i + 4096]
            np.maximum.at(out, w, self.network.logits(*encode(data, offs, first[i : i + 4096], last[i : i + 4096]), kind[w]))
        return 1 / (1 + np.exp(-np.clip(out / self.temperature, -500, 500)))


def findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """(text, start, end, secret): labelled findings of many formats in sentences of made-up words."""
    rng = np.random.default_rng(seed)
    hexes, lower, upper, digits, b64 = "0123456789abcdef", string.ascii_lowercase, string.ascii_uppercase, string.digits, string.ascii_letters + string.digits + "+/"
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    some = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(len(alphabet), size=k))
    word = lambda: "".join(pick("the an er on in re ti es or st en at ed nd ha ou th ly sh wh ion ing ble ée aux schei ción eau über ña il de".split()) for _ in range(int(rng.integers(1, 5))))
    words = lambda k: " ".join(word() + pick(["", "", "", "", ".", ",", "."]) for _ in range(k))
    upnum = upper + digits

    def secret() -> tuple[str, str, str]:
        value = lambda: pick([lambda: some(hexes, int(rng.integers(12, 65))), lambda: some(string.ascii_letters + digits, int(rng.integers(12, 60))), lambda: some(b64, int(rng.integers(16, 60))) + pick(["", "=", "=="])])()
        phrase = lambda: pick([lambda: word() + some(digits, int(rng.integers(2, 6))) + pick(["", "!", "#", "$"]), lambda: some(string.ascii_letters + digits + "!#$%&*", int(rng.integers(8, 24))), value])()
        name = pick(["token", "api_key", "apikey", "API_KEY", "secret", "access_token", "auth_token", "client_secret", "SECRET_KEY", "private_key", "aws_secret_access_key", "bearer", "api-key", "key", "TOKEN"])
        pw = pick(["password", "passwd", "pwd", "pass", "db_password", "PASSWORD", "MYSQL_PASSWORD", "passphrase"])
        q = pick(["", '"', "'", '"'])
        return pick(
            [
                lambda: (f"{name}{pick([' = ', '=', ': ', ' : ', ' := '])}{q}", value(), q),
                lambda: (f"{name}{pick([' = ', '=', ': '])}{q}", some(hexes, int(rng.choice([32, 40, 48, 64]))), q),
                lambda: (f"{pw}{pick(['=', ' = ', ': '])}{q}", phrase(), q),
                lambda: (f"{pw}=", some(hexes, int(rng.integers(8, 33))), ""),
                lambda: (f"{pick(['pin', 'PIN', 'passcode', 'otp'])}{pick(['=', ' = ', ': '])}{q}", some(digits, int(rng.integers(4, 9))), q),
                lambda: (f"{pw}{pick(['=', ' = ', ': '])}{q}", some(lower, int(rng.integers(3, 6))) + some(digits, int(rng.integers(2, 5))), q),
                lambda: (f"{pick(['postgres', 'mysql', 'redis', 'https', 'amqp', 'ftp'])}://{word()}:", pick([phrase, lambda: some(string.ascii_letters + digits, int(rng.integers(5, 16)))])(), f"@{word()}.example:{some(digits, 4)}/{word()}"),
                lambda: (f"https://{word()}.example/{word()}?id={some(digits, 2)}&{pick([name, pw])}=", pick([value, lambda: some(string.ascii_letters + digits, int(rng.integers(6, 20)))])(), pick(["", "&page=2", "#top"])),
                lambda: (pick(["", "aws_access_key_id = ", "key "]), pick(["AKIA", "ASIA"]) + some(upper + "234567" + digits, 16), ""),
                lambda: ("", "AKIA" + some(upnum, 16), ""),
                lambda: ("", pick(["ghp_", "gho_", "ghs_", "glpat-", "npm_", "hf_"]) + some(string.ascii_letters + digits, int(rng.integers(20, 41))), ""),
                lambda: ("", pick(["sk-", "sk_live_", "rk_live_", "sk_test_", "SG.", "xoxb-", "xoxp-"]) + some(string.ascii_letters + digits, int(rng.integers(24, 50))), ""),
                lambda: ("", "AIza" + some(string.ascii_letters + digits + "-_", 35), ""),
                lambda: (pick(["", "Bearer ", "Authorization: Bearer ", "jwt "]), "eyJ" + some(string.ascii_letters + digits, 30) + ".eyJ" + some(string.ascii_letters + digits, int(rng.integers(30, 120))) + "." + some(string.ascii_letters + digits + "-_", 43), ""),
                lambda: ("", f"-----BEGIN {pick(['', 'RSA ', 'EC ', 'OPENSSH ', 'ENCRYPTED '])}PRIVATE KEY-----", "\n" + some(b64, 40)),
            ]
        )()

    def harmless() -> tuple[str, str, str]:
        uuid = lambda: "-".join(some(hexes, k) for k in (8, 4, 4, 4, 12))
        host = lambda: f"{pick(['www.', 'mail', 'm.', 'cdn.'])}{some(digits, int(rng.integers(0, 3)))}{word()}.example.{pick(['com', 'org', 'net'])}"
        date = f"20{some(digits, 2)}-0{pick('123456789')}-1{pick(digits)}"
        return pick(
            [
                lambda: (pick(["commit ", "sha256: ", "sha1 = ", "md5=", "digest: ", "checksum = ", "revision ", "etag: ", "hash=", "integrity: sha512-"]), some(hexes, int(rng.choice([32, 40, 64]))), ""),
                lambda: (pick(["id: ", "id=", "uuid ", "request_id = ", "trace: ", "session: ", "doc "]), uuid(), ""),
                lambda: (pick(["", "see ", "mail ", "to: "]), f"{word()}.{some(digits, 2)}@{host()}", ""),
                lambda: (pick(["", "at "]), f"{pick(['http', 'https'])}://{host()}/{word()}/{some(digits, 4)}?page={some(digits, 2)}&ref={word()}", ""),
                lambda: (pick(["version: ", "release = ", "built ", ""]), f"{pick(digits)}.{some(digits, 2)}.{some(digits, 2)}-{pick(['beta', 'rc', 'alpha'])}{pick(digits)}.{date}", ""),
                lambda: (pick(["date = ", "updated: ", "time="]), f"{date}T1{pick(digits)}:{pick('012345')}{pick(digits)}:00Z", ""),
                lambda: (pick(["file: ", "path=", "src = ", "in "]), f"{word()}/{word()}_{some(digits, 3)}/{word()}-{some(digits, 4)}.{pick(['png', 'txt', 'jpg', 'py'])}", ""),
                lambda: (pick(["isbn: ", "order: ", "invoice = ", "ref=", "phone: ", "card: ", "iban: "]), pick([lambda: some(digits, 16), lambda: some(upper, 2) + some(digits, 20), lambda: f"+{some(digits, 2)}-{some(digits, 3)}-{some(digits, 7)}", lambda: f"{some(upper, 3)}-{some(digits, 10)}"])(), ""),
                lambda: (f"{pick(['password', 'token', 'secret', 'api_key', 'pwd'])}{pick(['=', ': ', ' = '])}", pick(["required", "changeme", "<your-token>", "********", "string", "undefined", "os.environ", "getpass()", "xxxxxxxxxxxx", "${TOKEN}", "$PASSWORD", "config.get", "null-value", "example", "your_password_here", "process.env.TOKEN"]), ""),
                lambda: (f"{pick(['the password', 'a token', 'secrets', 'note', 'title', 'name', 'color', 'total', 'width'])}: ", pick([word() + word(), word() + word() + ".", some(digits, 6), "#" + some(hexes, 6)]), ""),
                lambda: (f"{pick(['pages', 'count', 'age', 'year', 'total', 'n', 'width', 'size', 'lines', 'score', 'tel', 'at', 'nr'])}{pick([': ', '=', ' = ', ':'])}", pick([lambda: some(digits, int(rng.integers(3, 8))), lambda: f"{some(digits, 2)}.{some(digits, 2)}", lambda: some(digits, 2) + pick(["px", "kg", "km", "th", "mm"]), lambda: f"1{pick(digits)}:{some(digits, 2)}"])(), pick(["", ".", ","])),
                lambda: (f"{word()}{pick([': ', ':', ' : '])}", pick([word, lambda: word()[:4], lambda: word() + pick([".", "!", "?"])])(), ""),
                lambda: (f"{word()} {word()}: ", pick([lambda: word()[: int(rng.integers(3, 7))], word, lambda: some(lower, int(rng.integers(3, 8)))])(), pick(["", " " + some(digits, 5), ","])),
                lambda: ("", some(digits, int(rng.integers(16, 30))), ""),
                lambda: (pick(["", "class ", "def ", "x = "]), f"{word()}_{word()}_{word()}_{some(digits, 2)}", ""),
                lambda: ("", f"{word()}-{word()}-{word()}-{some(digits, 4)}-{word()}", ""),
                lambda: ("", "".join(word() for _ in range(int(rng.integers(2, 7)))).upper().encode("ascii", "ignore").decode(), pick(["!!", "", ".", "###"])),
                lambda: ("", "".join(word().title() for _ in range(int(rng.integers(3, 8)))).encode("ascii", "ignore").decode(), pick(["", "()", "."])),
                lambda: ("", word() + "." + word().title() + word() + some(digits, 1) + "/" + word(), ""),
            ]
        )()

    out = []
    for i in range(n):
        positive = i % 2 == 0
        lead, value, tail = secret() if positive else harmless()
        before = words(int(rng.integers(0, 9)))
        before = before + pick([" ", "\n", " "]) if before else ""
        after = pick([" ", "\n", ", ", ". ", ""]) + words(int(rng.integers(0, 7)))
        if rng.random() < 0.1:  # shouted text
            before, after = (x.upper().replace(" ", pick([" ", "!! ", "### ", "*** "])) for x in (before, after))
        start = len(before) + len(lead)
        out.append((before + lead + value + tail + after, start, start + len(value), int(positive)))
    return out


def _examples(labelled: list[tuple[str, int, int, int]]) -> tuple[np.ndarray, ...]:
    """Symbols, kind, label and finding of every candidate of the findings' texts; one that overlaps the finding has its label, others are harmless."""
    none = np.zeros(0, np.int64)
    parts = [(*encode(np.zeros(0, np.uint8), none, none, none), none, none, none)]
    for i, (text, start, end, label) in enumerate(labelled):
        raw = text.encode()
        data, offs = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
        if not len(data):
            continue
        a, b = len(text[:start].encode()), len(text[:end].encode())
        starts, ends, kind = candidates(raw, data, offs)
        who, first, last = windows_of(starts, ends)
        inside, around = encode(data, offs, first, last)
        y = (label * ((starts < b) & (ends > a)))[who]
        parts.append((inside, around, kind[who], y, np.full(len(who), i)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def fit(labelled: list[tuple[str, int, int, int]] | None = None, recall: float = RECALL, seed: int = SEED) -> Model:
    """A model from labelled findings (text, start, end, secret); those of findings() where none are given. A fifth is held out."""
    known = findings(seed=seed) if labelled is None else labelled
    inside, around, kind, y, finding = _examples(known)
    if not 0 < y.sum() < len(y):
        raise ValueError("labelled findings must hold candidates that are secrets and others")
    # findings() alternates between secret and harmless
    out = np.arange(len(known)) // 2 % 5 == 0 if labelled is None else np.random.default_rng(seed).random(len(known)) < 0.2
    held = out[finding]
    network = Network(seed)
    network.train(inside[~held], around[~held], kind[~held], y[~held].astype(np.float32), seed=seed)
    logit = network.logits(inside[held], around[held], kind[held]).astype(np.float64)
    true, own = y[held], kind[held]
    threshold, temperature = np.full(len(KINDS), 0.5), 1.0
    if len(true):
        temperatures = np.exp(np.linspace(-1.5, 2.5, 81))
        loss = [np.mean(np.logaddexp(0, np.where(true > 0, -1, 1) * logit / t)) for t in temperatures]
        temperature = float(temperatures[int(np.argmin(loss))])
        p = 1 / (1 + np.exp(-np.clip(logit / temperature, -500, 500)))
        secrets = np.flatnonzero(out & np.array([x[3] > 0 for x in known]))
        missed = len(np.setdiff1d(secrets, finding[held][true > 0]))
        for k in range(len(KINDS)):
            good = np.sort(p[(own == k) & (true > 0)])
            if len(good):
                threshold[k] = min(0.5, good[max(0, int(len(good) * (1 - recall)) - missed)])
    return Model(network, temperature, threshold)


def outermost(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of different spans lie in no other one."""
    order = np.lexsort((-ends, starts))
    reach = np.maximum.accumulate(np.concatenate([[-1], ends[order]]))[:-1]
    keep = np.zeros(len(starts), bool)
    keep[order] = ends[order] > reach
    return keep


def find_secrets(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, n_chars, kind, probability) of every secret; start counts characters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch, data, offs in slices(batches, "text"):
            starts, ends, kind = candidates(data.tobytes(), data, offs)
            if not len(starts):
                continue
            p = own.scores(data, offs, starts, ends, kind)
            keep = np.flatnonzero(p >= own.threshold[kind])
            keep = keep[outermost(starts[keep], ends[keep])]
            starts, ends, kind, p = starts[keep], ends[keep], kind[keep], p[keep]
            row = np.searchsorted(offs, starts, side="right") - 1
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            first, n = chars[starts] - chars[offs[row]], chars[ends] - chars[starts]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array([KINDS[k] for k in kind], pa.string()), pa.array(p)], ["doc_id", "start", "n_chars", "kind", "probability"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[doc_id]}, start long, n_chars long, kind string, probability double")
