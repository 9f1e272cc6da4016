"""Personal data in whole texts: fixed patterns, and a skip-chain conditional random field that adds what they miss.

``base_spans`` finds e-mail addresses, IPv4 addresses, payment cards and phone numbers by pattern.  The
field's nodes are the words of lines that hold a digit, an @ or a bracketed "at", and their neighbours.  Chain
edges join neighbouring words.  Words of a document that repeat each other, or are the same but for
separators or letter case, are joined by skip edges to a node of their own that stands for what they
all are; a group of n words has n edges, not a pair for each two.  So a number that a cue names once is labelled
alike wherever it comes again, and one that is an order number once is left alone.

Sum-product messages pass along all edges at once, a fixed number of rounds, so a result depends on its document alone.
Weights are trained on generated labelled texts (``labelled_texts``) with the same messages: the gradient is
observed minus expected features, node, chain and skip.  What is labelled becomes a span where
an exact check of its kind holds (number of digits, checksum, form) and no pattern has matched.

A task reads a text line by line, and passes messages for the nodes of many texts at once.

Edge cases: a null or empty text has no spans; ties between labels fall to the earlier label of LABELS; repeated rows are rows each;
an empty table gives an empty result; further columns stay, but for those whose names the result uses.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Rounds of messages, how much of an old message stays, and nodes whose messages pass together.
ROUNDS, KEPT, TOGETHER = 12, 0.3, 20_000

# -- patterns ---------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: All characters of the patterns of numbers; each match lies within one such run.
_NUMBERS = re.compile(r"[0-9+][0-9+(). -]*")
# possessive, and only from the first digit of a run: no run is read again and again
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    values = [int(d) for d in digits[::-1]]
    return (sum(values[::2]) + sum(v * 2 - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        done = found.end() if found else at + 1
        if found:
            yield start, done
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) of every match, by start and kind."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for run in _NUMBERS.finditer(text):
        if run.end() - run.start() < 7:
            continue
        chunk, at = run[0], run.start()
        if chunk.count(".") > 2:
            out += [(at + m.start(), 1, at + m.end()) for m in _IP.finditer(chunk) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(chunk):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((at + m.start(), 2, at + m.end()))
        if "+" in chunk:
            out += [(at + m.start(), 3, at + m.end()) for m in _PHONE.finditer(chunk) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# -- nodes ------------------------------------------------------------------------

_SEED = re.compile(r"[0-9@]")
_AT = re.compile(r"[\[({<] ?(?:at|AT|At) ?[\])}>]")
_WORD = re.compile(r"[\[({<] (?:at|AT|At|dot|DOT) [\])}>]|[^\x20\x09-\x0D\xA0]+")
_TELLS = re.compile(r"[0-9@]|^[\[({<] ?(?:at|AT|At|dot|DOT) ?[\])}>]")
_MARK = re.compile(r"[\[({<] ?(?:at|AT|At|dot|DOT) ?[\])}>]")
_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_SIX = re.compile(r"(?=[^:]*:[^:]*:)[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}")
_CUES = {
    "phone": "tel telephone phone call mobile cell fax dial ring telefon anruf handy teléfono téléphone portable móvil whatsapp sms",
    "card": "card visa mastercard amex credit debit karte kreditkarte tarjeta carte pan cc",
    "email": "mail email e-mail correo courriel contact write mailto",
    "ip": "ip ipv4 ipv6 host server address node gateway dns ping peer",
    "other": "order invoice isbn version page year id ref number no nr nummer token hash key code chapter item article part room line section since vol build serial account total eur usd model zip",
}
_CUE = {w: kind for kind, words in _CUES.items() for w in words.split()}
_EDGE = "\"'`,;:!?|[]{}<>"
_STEPS = (1, 3, 5, 6, 7, 9, 12, 13, 16, 17, 20)


def _class(word: str | None) -> str:
    """What a word says as a neighbour."""
    if word is None:
        return "edge"
    core = word.strip(_EDGE + "().").lower()
    if core in _CUE:
        return _CUE[core]
    if _TELLS.search(word):
        return "tell" if _SEED.search(word) else "mark"
    return "symbol" if not core else "word"


def _size(n: int) -> int:
    return sum(n >= s for s in _STEPS)


@dataclass
class Node:
    start: int
    end: int
    after: bool  # joined to the node before
    names: list[str]
    key: str | None
    base: int  # 1 + place in KINDS of a match that covers it, else 0


def _features(word: str, near: list[str | None], core: str, base: int) -> list[str]:
    """``near``: the third, second and first word before, and the next."""
    near = [_class(w) for w in near]
    cue = next((c for c in near[2::-1] if c in _CUES), "no cue")
    out = ["always", f"before {near[2]}", f"second before {near[1]}", f"third before {near[0]}", f"after {near[3]}"]
    if base:
        return [*out, f"matched {KINDS[base - 1]}"]
    n = sum("0" <= c <= "9" for c in core)
    own = _CUE.get(core.lower().strip(":."))
    if not n and "@" not in core and _TELLS.search(word):
        kind = "mark"
    elif "@" in core:
        name, _, host = core.rpartition("@")
        kind = "handle" if not name else "no host" if not host else "address" if host[0].isalnum() else "odd @"
    elif _QUAD.fullmatch(core):
        kind = "quad" if all(int(p) < 256 for p in core.split(".")) else "no quad"
    elif n and _SIX.fullmatch(core):
        kind = "six" if core.count(":") > 2 or "::" in core else "time"
    elif n and any(c.isalpha() for c in core):
        kind = f"mixed {min(n, 4)}"
    elif n >= 12:
        kind = f"long {_size(n)} {luhn(_digits(core))}"
    elif n:
        signs = "".join(sorted({c if c in "+-.()/:" else "?" for c in core if not "0" <= c <= "9"}))
        kind = f"number {_size(n)} {signs}"
    else:
        kind = f"cue {own}" if own else "dotted" if "." in core[1:-1] else "word"
    return [*out, kind, f"{kind}, {cue}", f"{kind}, after {near[3]}", f"{kind}, before {near[2]}"]


def _key(core: str) -> str | None:
    """Equal for words that say the same."""
    digits = _digits(core)
    if "@" in core:
        name = core.partition("@")[0].lower()
        return f"a {name}" if len(name) > 3 else None
    if len(digits) >= 5:
        return f"d {digits}"
    return f"a {core.lower()}" if len(core) > 4 else None


def nodes(text: str, base: list[tuple[int, int, int]]) -> Iterator[Node]:
    """The nodes of a text, in order."""
    at, place = 0, 0
    seed, mark = _SEED.search(text), _AT.search(text)
    while seed or mark:
        first = min(m.start() for m in (seed, mark) if m)
        start, end = text.rfind("\n", at, first) + 1 or at, text.find("\n", first)
        end = len(text) if end < 0 else end
        window: deque[tuple[int, str, bool] | None] = deque([None] * 5, 5)  # three words before, the word, the next
        joined = False
        for m in itertools.chain(_WORD.finditer(text, start, end), [None]):
            window.append(m and (m.start(), m[0], bool(_TELLS.search(m[0]))))
            word = window[3]
            if not word or not any(w and w[2] for w in (window[2], word, window[4])):
                joined = False
                continue
            s, whole, tells = word
            core = whole.strip(_EDGE).rstrip(".")
            if "(" not in core or ")" not in core:
                core = core.strip("()")
            core = whole if _MARK.fullmatch(whole) else core or whole
            s += whole.find(core)
            e = s + len(core)
            while place < len(base) and base[place][2] <= s:
                place += 1
            covered = base[place][1] + 1 if place < len(base) and base[place][0] < e else 0
            named = tells or "." in core[1:-1]
            yield Node(s, e, joined, _features(whole, [w and w[1] for w in (window[0], window[1], window[2], window[4])], core, covered), _key(core) if named else None, covered)
            joined = True
        at = end + 1
        seed, mark = (m if m is None or m.start() >= at else pattern.search(text, at) for m, pattern in ((seed, _SEED), (mark, _AT)))


# -- the field ----------------------------------------------------------------------


@dataclass
class Graph:
    """Nodes and edges of many texts; nodes from ``count`` on stand for groups of words."""

    count: int = 0
    feature: array = field(default_factory=lambda: array("i"))
    owner: array = field(default_factory=lambda: array("i"))
    place: array = field(default_factory=lambda: array("q"))  # start, end, joined to the node before, base of each node
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)

    def add(self, some: Iterator[Node], places: dict[str, int]) -> list[list[int]]:
        """Add a text; the groups of its nodes that skip edges are to join."""
        groups: dict[str, list[int]] = {}
        for node in some:
            for name in node.names:
                if (f := places.get(name)) is not None:
                    self.feature.append(f)
                    self.owner.append(self.count)
            self.place.extend((node.start, node.end, node.after, node.base))
            if node.after:
                self.chain.append((self.count - 1, self.count))
            if node.key is not None:
                groups.setdefault(node.key, []).append(self.count)
            self.count += 1
        return [g for g in groups.values() if len(g) > 1]

    def link(self, groups: list[list[int]]) -> int:
        """Join each group to a node of its own; the number of all nodes."""
        for k, group in enumerate(groups):
            self.skip += [(i, self.count + k) for i in group]
        return self.count + len(groups)


@dataclass
class Model:
    places: dict[str, int]
    weights: np.ndarray  # features x labels
    chain: np.ndarray  # label of a word x label of the next
    skip: np.ndarray  # label of a word x label of its group


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis)


def _share(a: np.ndarray) -> np.ndarray:
    """Probabilities from logarithms, each row by itself."""
    axes = tuple(range(1, a.ndim))
    e = np.exp(a - a.max(axis=axes, keepdims=True))
    return e / e.sum(axis=axes, keepdims=True)


def passed(model: Model, graph: Graph, total: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of nodes, of chain edges and of skip edges after ``rounds`` of messages."""
    own = np.zeros((total, len(LABELS)))
    np.add.at(own, np.array(graph.owner), model.weights[np.array(graph.feature)])
    edges = np.array(graph.chain + graph.skip, int).reshape(-1, 2)
    u, v, n = edges[:, 0], edges[:, 1], len(graph.chain)
    pair = np.concatenate([np.broadcast_to(model.chain, (n, *model.chain.shape)), np.broadcast_to(model.skip, (len(graph.skip), *model.skip.shape))])
    there, back = np.zeros((len(u), len(LABELS))), np.zeros((len(u), len(LABELS)))
    for _ in range(rounds + 1):
        belief = own.copy()
        np.add.at(belief, v, there)
        np.add.at(belief, u, back)
        a, b = belief[u] - back, belief[v] - there
        onward, backward = _log_sum(a[:, :, None] + pair, 1), _log_sum(b[:, None, :] + pair, 2)
        there = KEPT * there + (1 - KEPT) * (onward - _log_sum(onward, 1)[:, None])
        back = KEPT * back + (1 - KEPT) * (backward - _log_sum(backward, 1)[:, None])
    both = _share(a[:, :, None] + pair + b[:, None, :])
    return _share(belief), both[:n], both[n:]


def fitted(texts: list[tuple[str, list[tuple[int, int, int]]]], steps: int = 45, rate: float = 0.4, l2: float = 2e-3) -> Model:
    """A model of labelled texts, by gradient steps with a rate of its own for each weight."""
    made, gold, groups, graph = [], [], [], Graph()
    for text, spans in texts:
        some = list(nodes(text, base_spans(text)))
        made.append(some)
        gold += [next((k + 1 for s, k, e in spans if s < n.end and n.start < e), 0) for n in some]
    places = {name: k for k, name in enumerate(sorted({name for some in made for n in some for name in n.names}))}
    for some in made:
        groups += graph.add(some, places)
    total = graph.link(groups)
    gold += [max(set(x := [gold[i] for i in g]), key=x.count) for g in groups]
    n = len(LABELS)
    seen, owner, feature = np.eye(n)[gold], np.array(graph.owner), np.array(graph.feature)
    pairs = [np.zeros((n, n)), np.zeros((n, n))]
    for out, edges in zip(pairs, (graph.chain, graph.skip), strict=True):
        for i, j in edges:
            out[gold[i], gold[j]] += 1
    model = Model(places, np.zeros((len(places), n)), np.zeros((n, n)), np.zeros((n, n)))
    squares = [np.full_like(w, 1e-6) for w in (model.weights, model.chain, model.skip)]
    for _ in range(steps):
        share, chain, skip = passed(model, graph, total, 6)
        slope = np.zeros_like(model.weights)
        np.add.at(slope, feature, (seen - share)[owner])
        slopes = [slope, pairs[0] - chain.sum(axis=0), pairs[1] - skip.sum(axis=0)]
        for w, g, q in zip((model.weights, model.chain, model.skip), slopes, squares, strict=True):
            g = g / len(texts) - l2 * w
            q += g * g
            w += rate * g / np.sqrt(q)
    return model


# -- spans --------------------------------------------------------------------------


def _holds(kind: int, text: str) -> bool:
    """The exact check of a kind."""
    n = len(_digits(text))
    if kind == 0:
        return "@" in text.strip("@") or any(m.start() and m.end() < len(text) for m in _AT.finditer(text))
    if kind == 1:
        return _SIX.fullmatch(text) is not None or bool(_QUAD.fullmatch(text)) and all(int(p) < 256 for p in text.split("."))
    return (13 <= n <= 19 and luhn(_digits(text))) if kind == 2 else 7 <= n <= 15


def added(text: str, places: list[tuple[int, int, int, int]], share: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of neighbouring nodes of one label that no match covers; ``places`` as in a graph."""
    out, k = [], 0
    label = np.where([p[3] for p in places], 0, share.argmax(axis=1)).tolist()
    while k < len(label):
        last = k
        while label[k] not in (0, 2) and last + 1 < len(label) and places[last + 1][2] and label[last + 1] == label[k]:
            last += 1
        start, end = places[k][0], places[last][1]
        if label[k] and _holds(label[k] - 1, text[start:end]):
            out.append((start, label[k] - 1, end))
        k = last + 1
    return out


Spans = list[tuple[int, int, int]]


def all_spans(texts: list[str], model: Model) -> Iterator[tuple[Spans, Spans]]:
    """(matches, matches and what the field adds) of each text, in order."""
    held: list[tuple[str, Spans, int, int]] = []
    graph, groups = Graph(), []

    def decided() -> Iterator[tuple[Spans, Spans]]:
        share, _, _ = passed(model, graph, graph.link(groups))
        for text, base, first, last in held:
            places = np.array(graph.place[4 * first : 4 * last]).reshape(-1, 4).tolist()
            yield base, sorted(base + added(text, places, share[first:last])) if places else base

    for text in texts:
        base, first = base_spans(text), graph.count
        groups += graph.add(nodes(text, base), model.places)
        held.append((text, base, first, graph.count))
        if graph.count >= TOGETHER:
            yield from decided()
            held, graph, groups = [], Graph(), []
    yield from decided()


def found(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` without the text, with n_email, n_ip, n_card, n_phone, base_sha256 and spans."""
    model = model or default_model()
    counts = [f"n_{k}" for k in KINDS]
    others = [c for c in docs.columns if c not in (text, *counts, "base_sha256", "spans")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, spans in all_spans([t or "" for t in batch.column(0).to_pylist()], model):
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(len(KINDS))), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            columns = list(zip(*rows, strict=True)) or [[] for _ in range(6)]
            arrays = [*(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *arrays], names=[*others, *counts, "base_sha256", "spans"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others] + [f"{c} long" for c in counts] + ["base_sha256 string", "spans string"])
    return docs.select(F.col(text), *others).mapInArrow(find, schema)


# -- labelled texts -----------------------------------------------------------------

_SYLLABLES = "an be co da el fi go ha in ka lo me no or pa re sa ti un ve wa zu ing tion keit ción ment".split()


def _filler(r: random.Random, n: int) -> list[str]:
    words = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(n)]
    return [w.capitalize() if r.random() < 0.1 else w + r.choice([",", "."]) if r.random() < 0.1 else w for w in words]


def _d(r: random.Random, n: int) -> str:
    return "".join(r.choices("0123456789", k=n))


def _card(r: random.Random, valid: bool = True) -> str:
    head = r.choice("3456") + _d(r, 14)
    return next(head + c for c in "0123456789" if luhn(head + c)) if valid else next(head + c for c in r.sample("0123456789", 10) if not luhn(head + c))


def _cued(r: random.Random, kind: str) -> str:
    cue = r.choice(_CUES[kind].split())
    return r.choice([cue, cue.capitalize()]) + r.choice(["", ":", ":"]) + r.choice([" ", " ", " " + r.choice(["me", "is", "at", "us"]) + " "])


def _mention(r: random.Random) -> tuple[int | None, str, str, str]:
    """(kind or None, cue, mention, mention again): what matches don't find, or what looks like it and is none."""
    digits = r.choice([f"{_d(r, 3)}-{_d(r, 4)}", f"({_d(r, 3)}) {_d(r, 3)}-{_d(r, 4)}", f"0{_d(r, 3)} {_d(r, 6)}", f"0{_d(r, 9)}", f"{_d(r, 3)}.{_d(r, 3)}.{_d(r, 4)}", f"0{_d(r, 3)}/{_d(r, 7)}"])
    name = r.choice(["".join(r.choices(_SYLLABLES, k=2)) + r.choice([".", "_", ""]) + "".join(r.choices(_SYLLABLES, k=2))])
    host = "".join(r.choices(_SYLLABLES, k=2))
    x = r.random()
    if x < 0.2:
        return 3, _cued(r, "phone"), digits, digits.split(" ")[-1] if digits.startswith("(") else digits
    if x < 0.35:
        return None, _cued(r, "other"), digits, digits
    if x < 0.45:
        card = _card(r)
        return 2, _cued(r, "card"), card, card
    if x < 0.52:
        card = _card(r, False)
        return None, r.choice([_cued(r, "other"), ""]), card, card
    if x < 0.62:
        mark = r.choice(["[at]", "(at)", "{at}", "[ at ]"])
        address = r.choice([f"{name} {mark} {host}.org", f"{name}@{host}", f"{name}ö@{host}ü.de"])
        return 0, r.choice([_cued(r, "email"), ""]), address, address
    if x < 0.67:
        return None, "", r.choice([f"@{name}", f"{name} @ {_d(r, 2)}"]), f"@{name}"
    if x < 0.75:
        six = ":".join(f"{r.randrange(1, 65536):x}" for _ in range(3)) + r.choice(["::", ":0:"]) + f"{r.randrange(10, 65536):x}"
        return 1, r.choice([_cued(r, "ip"), ""]), six, six
    other = r.choice([f"{r.randint(1900, 2030)}", f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1, 23)}:{_d(r, 2)}", f"${_d(r, 2)},{_d(r, 3)}.{_d(r, 2)}", f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"978-3-{_d(r, 2)}-{_d(r, 6)}-{_d(r, 1)}", f"{_d(r, r.randint(1, 6))}", f"{r.randint(256, 999)}.{_d(r, 2)}.{_d(r, 2)}.{_d(r, 3)}", f'"{r.randbytes(10).hex()}"', f"{_d(r, 2)}:{_d(r, 2)}:{_d(r, 2)}", f"{_d(r, 8)}", f"{_d(r, 10)}"])
    return None, r.choice([_cued(r, "other"), "", ""]), other, other


def labelled_texts(count: int = 500, seed: int = 23) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with the spans of what is personal in them, the matches of the patterns included."""
    out = []
    for k in range(count):
        r = random.Random(f"{seed}:{k}")
        parts, spans, at = [], [], 0

        def put(text: str) -> None:
            nonlocal at
            parts.append(text)
            at += len(text)  # noqa: B023

        later: list[tuple[int | None, str]] = []
        for _ in range(r.randint(1, 5)):
            put(" ".join(_filler(r, r.randint(2, 8))) + " ")
            if r.random() < 0.25:
                put(r.choice([f"+{_d(r, 2)} ({_d(r, 3)}) {_d(r, 3)}-{_d(r, 4)}", f"{''.join(r.choices(_SYLLABLES, k=3))}@{''.join(r.choices(_SYLLABLES, k=2))}.net", ".".join(str(r.randrange(256)) for _ in range(4)), _card(r)]) + r.choice([" ", "\n"]))
                continue
            kind, cue, text, again = _mention(r)
            put(cue or " ".join(_filler(r, 2)) + " ")
            if kind == 2 and r.random() < 0.7:
                put(_d(r, 2) + " ")  # spoils the match
            if kind is not None:
                spans.append((at, kind, at + len(text)))
            put(text + r.choice([" ", ". ", "\n"]))
            later += [(kind, again)] * r.choice([0, 1, 1, 2])
        r.shuffle(later)
        for kind, text in later:
            put(" ".join(_filler(r, r.randint(3, 9))) + " ")
            if kind == 2:
                put(_d(r, 1) + " ")
            if kind is not None:
                spans.append((at, kind, at + len(text)))
            put(text + r.choice([" ", "\n"]))
        put(" ".join(_filler(r, 3)))
        whole = "".join(parts)
        out.append((whole, sorted(spans + [b for b in base_spans(whole) if not any(s < b[2] and b[0] < e for s, _, e in spans)])))
    return out


@functools.cache
def default_model(texts: int = 500) -> Model:
    return fitted(labelled_texts(texts))
