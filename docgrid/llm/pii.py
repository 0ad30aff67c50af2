"""Personal data: base patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, frugal, ids_of, keyed, private, small_batches

KINDS = ("email", "ip", "card", "phone", "contact", "secret", "identity")
STATES = ("other", "contact", "secret", "identity")
#: Ordinary words on either side in the sentences of the labelled table.
CONTEXT = 4
#: Different tokens whose scores are remembered, and characters of texts that are scored at once.
TOKENS, GROUP = 1 << 17, 1 << 18
#: Times that certain places are looked for before the rest is decoded.
ROUNDS = 3
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")
#: Characters at a word's ends that its features leave out.
_ENDS = ".,;:!?\"'"
#: Those that end a part of a sentence, which shapes leave out.
_STOPS = ".,;:!?"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses; looks left and right of each @, so the time is linear in the text."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the four base kinds, by start and then kind as listed."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=_order)


def _order(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def shape(token: str) -> str:
    """Letters as a and A, digits as 0, runs of more than four shortened to their length class; other characters stay."""
    out, i = [], 0
    while i < len(token):
        c = token[i]
        kind = "0" if c in "0123456789" else "A" if c.isupper() else "a" if c.isalpha() else c
        j = i
        while j < len(token) and (token[j] == c if kind == c and kind not in "0Aa" else ("0" if token[j] in "0123456789" else "A" if token[j].isupper() else "a" if token[j].isalpha() else "") == kind):
            j += 1
        n = j - i
        out.append(kind * n if n <= 4 else kind + ("5" if n < 8 else "8" if n < 16 else "16" if n < 32 else "32") + "+")
        i = j
    return "".join(out)


def coarse(token: str) -> str:
    """What kinds of characters a token has, in a few words."""
    d = sum(c in "0123456789" for c in token)
    u, low = any(c.isupper() for c in token), any(c.islower() for c in token)
    size = "s" if len(token) < 4 else "m" if len(token) < 12 else "l" if len(token) < 18 else "x"
    return f"{size}{'d' if d else ''}{'D' if 2 * d >= len(token) else ''}{'U' if u else ''}{'w' if low else ''}{'@' if '@' in token else ''}{'=' if '=' in token else ''}{'-' if '-' in token else ''}{'(' if '(' in token else ''}{'.' if '.' in token[:-1] else ''}"


def word_of(token: str) -> str:
    """A short token without digits in small letters, without marks at its ends; empty for others."""
    return token.lower().strip(_ENDS) if len(token) < 14 and not any(c in "0123456789" for c in token) else ""


def prefix_of(token: str) -> str:
    """What a token begins with up to its first =, _ or -, in small letters, if that is short; else empty."""
    for i, c in enumerate(token[:9]):
        if c in "=_-":
            return token[: i + 1].lower()
    return ""


def token_features(tokens: list[str]) -> list[list[str]]:
    """Word-shape features of each token and its neighbours."""
    shapes, kinds = [shape(t.rstrip(_STOPS)) for t in tokens], [coarse(t) for t in tokens]
    words = [word_of(t) for t in tokens]
    out = []
    for i in range(len(tokens)):
        f = ["bias", f"s={shapes[i]}", f"c={kinds[i]}"]
        if words[i]:
            f.append(f"w={words[i]}")
        if prefix := prefix_of(tokens[i]):
            f.append(f"p={prefix}")
        if i:
            f += [f"c-={kinds[i - 1]}", f"w-={words[i - 1]}", f"c-c={kinds[i - 1]}|{kinds[i]}"]
        if i > 1:
            f.append(f"w--={words[i - 2]}")
        if i + 1 < len(tokens):
            f += [f"c+={kinds[i + 1]}", f"w+={words[i + 1]}"]
        if i + 2 < len(tokens):
            f.append(f"w++={words[i + 2]}")
        out.append(f)
    return out


def labelled_table(rows: int = 1000, seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """The small labelled table: sentences made by rule, with the state of each token."""
    r = random.Random(seed)
    syllables = "an er in th on re st ou le ti che ung que cion mente lich eau des und the of".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    code = lambda n, abc: "".join(r.choice(abc) for _ in range(n))
    hexa, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

    def entity() -> list[tuple[str, int]]:
        k = r.choice([*range(24), 2, 3, 21, 21])
        if k == 22:
            return [(r.choice([*"xyzEnkF", word()]), 0), (r.choice(["=", "==", ":"]), 0), (r.choice([digits(r.randint(1, 3)), word(), "mc2", "ma", f"{r.randint(1, 9)};"]), 0)]
        if k == 23:
            return [(f"{digits(r.randint(1, 3))}{r.choice('-:/x')}{digits(r.randint(1, 3))}", 0)]
        if k == 20:
            return [(word(), 1), (r.choice(["(dot)", "[dot]"]), 1), (r.choice(["com", "org", "net"]), 1)]
        if k == 21:
            return [(r.choice([word(), r.choice("abcdxyz")]), 0), (r.choice(["(dot)", "[dot]", "dot", "at", "[at]", "(at)"]), 0), (r.choice([word(), r.choice("abcdxyz")]), 0)]
        if k == 0:
            return [(r.choice(["AKIA", "ASIA"]) + code(16, r.choice([upper, upper[:26]])), 2)]
        if k == 1:
            return [(r.choice(["password=", "passwd=", "pwd=", "secret=", "api_key="]) + code(r.randint(10, 24), r.choice([hexa, hexa, hexa[10:]])), 2)]
        if k == 2:
            mark = r.choice("\"\"'")
            return [(r.choice(["token", "secret", "key", "api_key"]), 2), (r.choice(["=", ":"]), 2), (mark + code(r.choice([12, 16, 24, 32, 40]), r.choice([hexa, hexa, hexa[10:]])) + mark, 2)]
        if k == 3:
            return [(r.choice(["ghp_", "sk-", "xoxb-"]) + code(r.randint(20, 36), r.choice([hexa, hexa + "ABCDEFXYZ"])), 2)]
        if k == 4:
            return [(f"{word()}.{digits(2)}@{word()}.example.com", 1)]
        if k == 5:
            return [(word(), 1), (r.choice(["[at]", "(at)", "[AT]"]), 1), (word(), 1), (r.choice(["[dot]", "(dot)"]), 1), (r.choice(["com", "org", "net"]), 1)]
        if k == 6:
            return [("+1", 1), (f"({digits(3)})", 1), (f"{digits(3)}-{digits(4)}", 1)]
        if k == 7:
            return [(f"({digits(3)})", 1), (f"{digits(3)}-{digits(4)}", 1)]
        if k == 8:
            return [(f"{digits(3)}-{digits(3)}-{digits(4)}", 1)]
        if k == 9:
            return [(f"{digits(3)}-{digits(2)}-{digits(4)}", 3)]
        if k == 10:
            return [("IBAN", 0), (r.choice(["DE", "FR", "ES", "GB"]) + digits(20), 3)]
        if k == 11:
            return [(f"{digits(2)}.{digits(3)}.{digits(3)}.{digits(2)}", 0)]
        if k == 12:
            return [(digits(16), 3)]
        if k == 13:
            return [(r.choice(["version", "Version", "Apache", "NC"]), 0), (f"{r.randint(1, 9)}.{r.choice(['', '0', '0.'])}", 0)]
        if k == 14:
            return [(r.choice([str(r.randint(1, 300)), str(r.randint(1900, 2030)), f"{r.randint(1, 99)}%", f"${digits(2)}.{digits(2)}", f"x={r.randint(0, 9)}", f"{digits(1)},{digits(3)}", f"{r.randint(1, 12)}:{digits(2)}"]), 0)]
        if k == 15:
            return [(word().upper() + r.choice(["!!", "!", "", ".!!"]), 0) for _ in range(r.randint(2, 6))]
        if k in (16, 17):
            bar = r.choice(["|", "|", "-", "•", "::", "*", "#", "##", ">", "~~", "$", "&", "%", "&amp;"])
            long = lambda: word() + word() + word() if r.random() < 0.2 else word()
            return [(t, 0) for _ in range(r.randint(2, 5)) for t in (word().capitalize() if r.random() < 0.2 else long() + r.choice(["", "", ",", "."]), bar)]
        if k == 18:
            return [(word().capitalize() + r.choice(["", ".", ",", "'s", "-" + word()]), 0) for _ in range(r.randint(1, 4))]
        return [(r.choice(["a=b", "@", "=", "==", "#1", "v2", "A4", "2nd", "CO2", "MP3", f"{word()}{r.randint(1, 9)}"]), 0)]

    out = []
    for _ in range(rows):
        line = [(word(), 0) for _ in range(r.randint(0, CONTEXT))] + entity() + [(word(), 0) for _ in range(r.randint(0, CONTEXT))]
        if r.random() < 0.3:
            line += entity() + [(word(), 0)]
        end = r.choice(["", "", ".", ","])
        tokens = [t for t, _ in line]
        tokens[-1] += end
        out.append((tokens, [s for _, s in line]))
    return out


class Crf:
    """A linear-chain CRF: emission weights by feature, transition weights by state pair."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move

    def emissions(self, rows: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, place, state) scores padded to the longest sequence, and the lengths."""
        n = np.array([len(x) for x in rows])
        out = np.zeros((len(rows), int(n.max()), len(STATES)))
        get = self.names.get
        for i, x in enumerate(rows):
            for t, f in enumerate(x):
                out[i, t] = self.emit[[k for k in map(get, f) if k is not None]].sum(axis=0)
        return out, n

    def viterbi(self, rows: list[list[list[str]]]) -> list[np.ndarray]:
        """The best state sequence of each row of a batch."""
        return self.best(*self.emissions(rows))

    def best(self, e: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        """The best state sequence by (sequence, place, state) scores, all sequences a step at a time; n: their lengths."""
        best = e[:, 0]
        back = np.zeros(e.shape, dtype=np.int8)
        for t in range(1, e.shape[1]):
            s = best[:, :, None] + self.move[None]
            back[:, t] = s.argmax(axis=1)
            new = s.max(axis=1) + e[:, t]
            best = np.where((t < n)[:, None], new, best)
        state = best.argmax(axis=1)
        out = np.zeros(e.shape[:2], dtype=np.int8)
        for t in range(e.shape[1] - 1, -1, -1):
            out[:, t] = state
            state = np.where(t < n, back[np.arange(len(n)), t, state], state) if t else state
        return [out[i, : n[i]] for i in range(len(n))]


def train(table: list[tuple[list[str], list[int]]], steps: int = 150, rate: float = 0.5, ridge: float = 1e-3) -> Crf:
    """Maximum likelihood by forward-backward over the padded table, with AdaGrad steps."""
    rows = [token_features(t) for t, _ in table]
    names: dict[str, int] = {}
    for x in rows:
        for f in x:
            for k in f:
                names.setdefault(k, len(names))
    s = len(STATES)
    n = np.array([len(x) for x in rows])
    b, length = len(rows), int(n.max())
    where, which = [], []
    for i, x in enumerate(rows):
        for t, f in enumerate(x):
            where += [i * length + t] * len(f)
            which += [names[k] for k in f]
    where, which = np.array(where), np.array(which)
    gold = np.zeros((b, length), dtype=np.int64)
    for i, (_, y) in enumerate(table):
        gold[i, : len(y)] = y
    live = np.arange(length)[None] < n[:, None]
    true = np.eye(s)[gold] * live[..., None]
    moves = np.zeros((s, s))
    np.add.at(moves, (gold[:, :-1][live[:, 1:]], gold[:, 1:][live[:, 1:]]), 1)
    emit, move = np.zeros((len(names), s)), np.zeros((s, s))
    se, sm = np.full(emit.shape, 1e-6), np.full(move.shape, 1e-6)
    for _ in range(steps):
        e = np.zeros((b * length, s))
        np.add.at(e, where, emit[which])
        e = e.reshape(b, length, s)
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for t in range(1, length):
            f = np.logaddexp.reduce(forward[:, t - 1, :, None] + move[None], axis=1) + e[:, t]
            forward[:, t] = np.where(live[:, t, None], f, forward[:, t - 1])
        z = np.logaddexp.reduce(forward[:, -1], axis=1)
        for t in range(length - 2, -1, -1):
            g = np.logaddexp.reduce(move[None] + (e[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(live[:, t + 1, None], g, 0)
        p = np.exp(forward + backward - z[:, None, None]) * live[..., None]
        pair = np.exp(forward[:, :-1, :, None] + move + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
        diff = (true - p).reshape(b * length, s)
        ge = np.zeros_like(emit)
        np.add.at(ge, which, diff[where])
        ge = ge / b - ridge * emit
        gm = (moves - pair.sum(axis=(0, 1))) / b - ridge * move
        se += ge**2
        sm += gm**2
        emit += rate * ge / np.sqrt(se)
        move += rate * gm / np.sqrt(sm)
    return Crf(names, emit, move)


@lru_cache(maxsize=1)
def model() -> Crf:
    """The chain trained from the labelled table, once a process; operators train it on the driver and send it, a few thousand weights."""
    return train(labelled_table())


class Scores:
    """Emission scores of whole texts, put together from those of their tokens.

    A token adds one row of scores to its own place and one to each of the two
    places after and before it; pairs of neighbours add one by their kinds.  Rows depend on a token's shape, kinds of characters
    and, if the chain knows it, its word, so that nearly all tokens share rows.
    """

    def __init__(self, crf: Crf) -> None:
        self.crf = crf
        self.words = {k.partition("=")[2] for k in crf.names if k.startswith(("w=", "w-=", "w--=", "w+=", "w++="))} - {""}
        self.prefixes = {k[2:] for k in crf.names if k.startswith("p=")}
        kinds = sorted({x for k in crf.names if k.startswith("c-c=") for x in k[4:].split("|")})
        self.kinds = {k: i for i, k in enumerate(kinds, 1)}  # 0 stands for the others
        self.pairs = np.zeros((len(kinds) + 1, len(kinds) + 1, len(STATES)))
        for k, i in crf.names.items():
            if k.startswith("c-c="):
                x, y = k[4:].split("|")
                self.pairs[self.kinds[x], self.kinds[y]] = crf.emit[i]
        self.pairs = self.pairs.reshape(-1, len(STATES))
        # what the moves to and from a state can gain it over the first one: by whether the state before is known to be the first, any, or none is there, and the same after
        into = {"first": crf.move[:1] - crf.move[0, 0], "any": crf.move - crf.move[:, :1], "none": np.zeros((1, len(STATES)))}
        out = {"first": (crf.move[:, 0] - crf.move[0, 0])[None], "any": (crf.move - crf.move[0]).T, "none": np.zeros((1, len(STATES)))}
        base = crf.move[0, 0]
        self.move_in = crf.move.max(axis=0)[1:] - base
        self.ends = max((crf.move[0, 1:] - base - self.move_in).max(), -self.move_in.min()) + max((crf.move[1:, 0] - base).max(), 0.0)
        self.gain = {(x, y): into[x].max(axis=0) + out[y].max(axis=0) for x in into for y in out}
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.by_kind: dict[tuple, int] = {}
        self.by_form: dict[tuple, int] = {}
        self.rows: list[np.ndarray] = []
        self.kind_of: list[int] = []
        self.tables: list[np.ndarray] = []
        self.kind = np.zeros(0, dtype=np.int64)

    def _learn(self, token: str) -> int:
        core = token.rstrip(_ENDS)
        key = None
        if core.isalpha() and (core.islower() or core[:1].isupper() and core[1:].islower()):  # what its rows depend on, without looking at each character
            low = core.lower()
            short = len(token) < 14
            key = core[:1].isupper(), len(core), token[len(core) :], low if short and low in self.words else short
            at = self.by_form.get(key)
            if at is not None:
                self.ids[token] = at
                return at
        form, word, kind, prefix = shape(token.rstrip(_STOPS)), word_of(token), coarse(token), prefix_of(token)
        own = form, kind, word if not word or word in self.words else None, prefix if prefix in self.prefixes else ""
        at = self.by_kind.get(own)
        if at is None:
            get, emit = self.crf.names.get, self.crf.emit

            def sums(*names: str) -> np.ndarray:
                return emit[[k for k in map(get, names) if k is not None]].sum(axis=0)

            here = ("bias", f"s={form}", f"c={kind}", *((f"w={word}",) if word else ()), *((f"p={prefix}",) if prefix else ()))
            at = self.by_kind[own] = len(self.rows)
            self.rows.append(np.stack([sums(*here), sums(f"c-={kind}", f"w-={word}"), sums(f"w--={word}"), sums(f"c+={kind}", f"w+={word}"), sums(f"w++={word}")]))
            self.kind_of.append(self.kinds.get(kind, 0))
        if key is not None:
            self.by_form[key] = at
        self.ids[token] = at
        return at

    def emissions(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all places of some texts' tokens, one text after the other, and where each begins."""
        tokens = [t for own in texts for t in own]
        found = list(map(self.ids.get, tokens))
        if None in found:
            ids, learn = self.ids, self._learn
            found = [(ids[t] if t in ids else learn(t)) if i is None else i for t, i in zip(tokens, found)]
        if len(self.rows) > len(self.kind):
            every = np.stack(self.rows)
            self.tables, self.kind = [np.ascontiguousarray(every[:, k]) for k in range(5)], np.array(self.kind_of)
        at, begin = np.array(found, dtype=np.int64), np.cumsum([0, *map(len, texts)])
        if not len(at):
            return np.zeros((0, len(STATES))), begin
        own, after, two_after, before, two_before = self.tables
        edge = begin[:-1][np.diff(begin) > 0]
        e = own.take(at, axis=0)
        kind = self.kind.take(at)
        part = after.take(at[:-1], axis=0) + self.pairs.take(kind[:-1] * (len(self.kinds) + 1) + kind[1:], axis=0)
        part[edge[1:] - 1] = 0
        e[1:] += part
        for there, part in ((e[2:], two_after.take(at[:-2], axis=0)), (e[:-2], two_before.take(at[2:], axis=0))):
            for k in (edge[1:] - 1, edge[1:] - 2):  # pairs of places that lie in two texts
                part[k[(k >= 0) & (k < len(part))]] = 0
            there += part
        part = before.take(at[1:], axis=0)
        part[edge[1:] - 1] = 0
        e[:-1] += part
        if len(self.ids) > TOKENS:
            self.clear()
        return e, begin

    def states(self, texts: list[list[str]]) -> list[np.ndarray | None]:
        """The best state of each token of each text, as decoding the whole text gives them; None for texts all of whose tokens are ordinary.

        Where the first state beats every other by more than the moves to and
        from it could make up for, it is on the best path whatever comes before
        and after.  Such places cut a text into runs that are decoded on their
        own, between neighbours of the first state.
        """
        e, begin = self.emissions(texts)
        n = len(e)
        out: list[np.ndarray | None] = [None] * len(texts)
        if not n:
            return out
        lead = e[:, :1] - e[:, 1:]
        some = np.diff(begin) > 0
        start, end = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        start[begin[:-1][some]], end[begin[1:][some] - 1] = True, True
        # what a run of other states can gain at most over as many of the first: sums of the best that each place can give, over all runs that hold a place
        most = (self.move_in - lead).max(axis=1)
        sums = np.cumsum(most)
        upto = sums - np.minimum.accumulate(np.append(0.0, sums[:-1]))
        onward = np.maximum.accumulate(sums[::-1])[::-1] - (sums - most)
        sure = (lead > self.gain["any", "any"][1:] + 1e-9).all(axis=1) | (upto + onward - most + self.ends < -1e-6)
        doubt = np.flatnonzero(~sure)
        for _ in range(ROUNDS if len(doubt) else 0):  # neighbours that are sure leave less to gain
            left, right = np.append(True, sure[:-1])[doubt], np.append(sure[1:], True)[doubt]
            need = np.empty((len(doubt), len(STATES)))
            for x, chosen in (("none", start[doubt]), ("first", ~start[doubt] & left), ("any", ~start[doubt] & ~left)):
                for y, also in (("none", end[doubt]), ("first", ~end[doubt] & right), ("any", ~end[doubt] & ~right)):
                    need[chosen & also] = self.gain[x, y]
            now = (lead[doubt] > need[:, 1:] + 1e-9).all(axis=1)
            sure[doubt[now]] = True
            doubt = doubt[~now]
        if not len(doubt):
            return out
        every = np.zeros(n, dtype=np.int8)
        is_start = np.zeros(n + 1, dtype=bool)
        is_start[begin] = True
        new = np.ones(len(doubt), dtype=bool)
        new[1:] = (np.diff(doubt) > 1) | is_start[doubt[1:]]
        first = doubt[new]
        last = np.append(doubt[np.flatnonzero(new)[1:] - 1], doubt[-1])
        runs = sorted(zip(first.tolist(), last.tolist()), key=lambda r: r[1] - r[0])
        at = 0
        while at < len(runs):
            stop = at + 1  # runs of like length, some 20,000 tokens at once
            while stop < len(runs) and (stop - at) * (runs[stop][1] - runs[stop][0] + 1) < 20_000:
                stop += 1
            part = runs[at:stop]
            size = np.array([b - a + 1 for a, b in part])
            padded = np.zeros((len(part), int(size.max()), len(STATES)))
            for i, (a, b) in enumerate(part):
                padded[i, : size[i]] = e[a : b + 1]
                if not is_start[a]:
                    padded[i, 0] += self.crf.move[0]
                if not is_start[b + 1]:
                    padded[i, size[i] - 1] += self.crf.move[:, 0]
            for (a, b), s in zip(part, self.crf.best(padded, size)):
                every[a : b + 1] = s
            at = stop
        for k in np.unique(np.searchsorted(begin, np.flatnonzero(every), side="right") - 1).tolist():
            out[k] = every[begin[k] : begin[k + 1]]
        return out


def _shape_of_marks(marks: str) -> str:
    return shape(marks) if marks else ""


@lru_cache(maxsize=1)
def _own_scores() -> Scores:
    return Scores(model())


def found_spans(texts: list[str], whole: bool = False, scores: Scores | None = None) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, whose tokens are all decoded; whole: by one pass of the chain over each whole text, at many times the cost, to compare with."""
    scores = scores or _own_scores()
    out: list[tuple[list, list]] = []
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (size < GROUP or stop == at):
            size += len(texts[stop])
            stop += 1
        group = texts[at:stop]
        tokens = [t.split() for t in group]
        if whole:
            states = [scores.crf.viterbi([token_features(own)])[0] if own else None for own in tokens]
        else:
            states = scores.states(tokens)
        out += [_spans(t, s) for t, s in zip(group, states)]
        at = stop
    return out


def _spans(text: str, states: np.ndarray | None) -> tuple[list, list]:
    """Base spans of a text, and these with what the states of its tokens add where no base span lies."""
    own = base_spans(text)
    if states is None or not states.any():
        return own, own
    w = [m.span() for m in _TOKEN.finditer(text)]
    starts = np.array([a for a, _, _ in own])
    ends = np.maximum.accumulate([b for _, b, _ in own]) if own else np.zeros(0, int)
    free = []
    i = 0
    while i < len(w):
        j = i
        while j < len(w) and states[j] == states[i]:
            j += 1
        if states[i]:
            a, b = w[i][0], w[j - 1][1]
            while b > a + 1 and text[b - 1] in ".,;:!?":
                b -= 1
            k = int(np.searchsorted(starts, b, "left"))  # base spans that begin before the end
            if not k or ends[k - 1] <= a:
                free.append((a, b, STATES[states[i]]))
        i = j
    return own, sorted(own + free, key=_order)


def _said(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more``.

    The counts and the digest are of the base patterns over the whole text;
    spans adds what the chain finds apart from them, as kinds contact, secret
    and identity (``kind:start:end`` by start and kind, in code points, end
    exclusive).  All tokens of all texts are decoded; whole does so in one plain
    pass over each text, to compare with.  Null and empty texts have no spans,
    and their digest is that of an empty string; repeated rows give a row each.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model())

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = Scores(sent.value)
        for b in batches:
            found = found_spans(b["text"].tolist(), whole, scores)
            out = {"doc_id": ids_of(b)}
            for kind in KINDS[:4]:
                out[f"n_{kind}"] = [sum(s[2] == kind for s in own) for own, _ in found]
            out["base_sha256"] = [hashlib.sha256(_said(own).encode()).hexdigest() for own, _ in found]
            out["spans"] = [_said(every) for _, every in found]
            out["n_more"] = [len(every) - len(own) for own, every in found]
            yield pd.DataFrame(out)

    return keyed(docs, id_col, text_col).mapInPandas(frugal(find), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_more long")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one, by the first one's kind."""
    out, at = [], 0
    i = 0
    while i < len(spans):
        a, b, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b = max(b, spans[i][1])
            i += 1
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def without_personal_data(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in the text, and n_chars counted anew where the text changed; all rows and columns stay."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model())

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores = Scores(sent.value)
        for b in batches:
            texts = b.fillna("").tolist()
            found = [masked(t, every) for t, (_, every) in zip(texts, found_spans(texts, scores=scores))]
            yield pd.Series([None if n else t for t, n in zip(found, b.isna())], dtype=object)
        freed()

    new = private(docs, "masked")
    both = docs.withColumn(new, mask(F.col("text")))
    size = F.when(F.col("text").eqNullSafe(F.col(new)), F.col("n_chars")).otherwise(F.length(new).cast("long")) if "n_chars" in docs.columns else None
    put = {"text": F.col(new), "n_chars": size}
    return both.select(*(put.get(c, F.col(c)).alias(c) if c in ("text", "n_chars") else F.col(f"`{c}`") for c in docs.columns))
