r"""Personal data (operator 10): base patterns, and a skip-chain conditional random field over mentions.

The base patterns find e-mail addresses, IP addresses, card and phone numbers. The field adds what they miss: a later mention
of the same number without its sign or spacing, or of an address's name alone. Its nodes are mentions (number
groups and name-like words); neighbours in the text share chain potentials, and mentions with the same or a similar
content, however far apart, share skip potentials. Loopy belief propagation makes labels agree over a
document. Potentials are learned by gradient ascent of the pseudo-likelihood on a bounded sample: open mentions that no base span
explains are "other", and each base span gets a planted repeat, in the form in which repeats come, that carries its kind. Base
spans are observed and never change.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.llm.common import only

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"\+?[0-9](?:[\x20().-]{0,2}[0-9])*+")
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*+")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the four patterns: leftmost, not overlapping within a kind; failing matches are dropped, without retries.

    Each pattern is run in time that grows with the text alone, also over very long runs of its signs.
    """
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    at = end = text.find("@")
    end = 0
    while at != -1:
        begin = at
        while begin > end and _LOCAL.match(text[begin - 1]):
            begin -= 1
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            out["email"].append((begin, m.end()))
            end = m.end()
        else:
            end = max(end, begin)
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m.group())
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out["card"].append(m.span())
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out["phone"].append(m.span())
    return out


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _number_keys(digits: str) -> tuple[list[str], list[str]]:
    """Keys of an equal number, with or without its country's code, and of one with equal last digits."""
    return [f"d:{digits}", *([f"d:{digits[-10:]}"] if len(digits) > 10 else [])], [f"t:{digits[-8:]}"] if len(digits) >= 8 else []


def _name_keys(name: str) -> tuple[list[str], list[str]]:
    """Keys of an equal name, and of one with equal letters however they are parted and numbered."""
    letters = "".join(c for c in name.lower() if c.isalpha())
    return [f"n:{name.lower()}"], [f"l:{letters}"] if len(letters) >= 6 else []


def entity_keys(kind: str, value: str) -> tuple[list[str], list[str]]:
    """What an equal mention of the entity would share with it, and what a similar one would."""
    if kind == "email":
        local = value.split("@")[0]
        return _name_keys(local) if len(local) >= 5 and any(c.isdigit() or c == "." for c in local) else ([], [])
    if kind == "ip":
        return [f"p:{'.'.join(re.findall('[0-9]+', value))}"], []
    return _number_keys(_digits(value))


def mention_keys(text: str) -> list[tuple[int, int, str, tuple[list[str], list[str]]]]:
    """(start, end, shape, keys of equal and of similar mentions) of each mention that could be personal data."""
    out = []
    for m in _NUMBER.finditer(text):
        digits = _digits(m.group())
        if len(digits) >= 7:
            parts = re.findall("[0-9]+", m.group())
            equal, similar = _number_keys(digits)
            if len(parts) == 4 and all(len(p) <= 3 for p in parts):
                equal.append(f"p:{'.'.join(parts)}")
            out.append((*m.span(), f"number{min(len(digits), 20)}", (equal, similar)))
    for m in _NAME.finditer(text):
        word = m.group().rstrip(".%+-_")
        if len(word) >= 5 and any(c.isdigit() or c in "._" for c in word) and any(c.isalpha() for c in word):
            shape = "".join(sorted({"a" if c.isalpha() else "9" if c.isdigit() else c for c in word}))
            out.append((m.start(), m.start() + len(word), f"name:{shape}", _name_keys(word)))
    return sorted(out)


def repeats(kind: str, value: str) -> list[tuple[str, int]]:
    """(shape, kind of skip edge) of the forms in which an entity is mentioned again: bare, and similar."""
    digits = _digits(value)
    bare = {"email": value.split("@")[0], "ip": " ".join(re.findall("[0-9]+", value))}.get(kind, digits)
    forms = [(bare, 0), (digits[-8:] if kind in ("card", "phone") else "", 1), (f"{bare}_1" if kind == "email" else "", 1)]
    return [(found[0][2], edge) for form, edge in forms if (found := mention_keys(form)) and any(entity_keys(kind, value))]


@dataclass
class Field:
    """Log potentials: of all mentions, of a mention's shape, of neighbours, and of equal and of similar mentions."""

    common: np.ndarray = field(default_factory=lambda: np.zeros(5))
    unary: dict[str, np.ndarray] = field(default_factory=dict)
    chain: np.ndarray = field(default_factory=lambda: np.zeros((5, 5)))
    skip: np.ndarray = field(default_factory=lambda: np.zeros((2, 5, 5)))

    @classmethod
    def learn(cls, texts: list[str], rounds: int = 200, rate: float = 0.1, decay: float = 1e-4) -> Field:
        """Maximise the pseudo-likelihood, the product of each label's probability given its neighbours' labels.

        An open mention that a skip edge ties to a base span has no known label: it gives no term, and counts as that span's kind where
        it is a neighbour. All other open mentions are "other". Each base span also stands as a planted repeat in its own place, with a
        skip edge to the span, and as a mention of that form without one, which is "other": a form alone is no evidence. The likelihood is concave; Adam climbs it with all terms at once, and ``decay`` keeps it bounded.
        """
        shapes: dict[str, int] = {}
        terms: list[tuple[int, int, np.ndarray]] = []
        for text in texts:
            nodes, edges = graph(text)
            near = np.zeros((len(nodes), 4, 5))
            labels = [x[4] for x in nodes]
            for a, b, _ in edges:
                for i, j in ((a, b), (b, a)):
                    if nodes[i][4] == 0 and nodes[j][4]:
                        labels[i] = nodes[j][4]
            for k in range(len(nodes) - 1):
                near[k + 1, 0, labels[k]] += 1
                near[k, 1, labels[k + 1]] += 1
            for a, b, kind in edges:
                near[a, 2 + kind, labels[b]] += 1
                near[b, 2 + kind, labels[a]] += 1
            for k, (begin, end, shape, _, label) in enumerate(nodes):
                if label:
                    for form, kind in repeats(LABELS[label], text[begin:end]):
                        alone = near[k].copy()
                        alone[2:] = 0
                        tied = alone.copy()
                        tied[2 + kind, label] = 1
                        terms += [(shapes.setdefault(form, len(shapes)), label, tied), (shapes[form], 0, alone)]
                elif not labels[k]:
                    terms.append((shapes.setdefault(shape, len(shapes)), 0, near[k]))
        if not terms:
            return cls(common=np.array([1.0, 0, 0, 0, 0]))
        shape, label, around = (np.array(x) for x in zip(*terms))
        goal = np.eye(5)[label]
        w = [np.zeros(5), np.zeros((len(shapes), 5)), np.zeros((5, 5)), np.zeros((2, 5, 5))]
        m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
        for t in range(1, rounds + 1):
            z = w[0] + w[1][shape] + around[:, 0] @ w[2] + around[:, 1] @ w[2].T + around[:, 2] @ w[3][0] + around[:, 3] @ w[3][1]
            p = np.exp(z - z.max(1, keepdims=True))
            g = (goal - p / p.sum(1, keepdims=True)) / len(terms)
            up = [g.sum(0), np.zeros_like(w[1]), around[:, 0].T @ g + g.T @ around[:, 1], np.stack([around[:, 2 + k].T @ g for k in (0, 1)])]
            np.add.at(up[1], shape, g)
            up[3] = up[3] + up[3].transpose(0, 2, 1)  # a skip edge has no direction
            for k in range(4):
                up[k] = up[k] - decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * up[k]
                v[k] = 0.999 * v[k] + 0.001 * up[k] ** 2
                w[k] = w[k] + rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return cls(w[0], {s: w[1][k] for s, k in shapes.items()}, w[2], w[3])

    def infer(self, nodes: list, edges: list[tuple[int, int, int]]) -> np.ndarray:
        """Marginals of each node by loopy belief propagation until the messages stand still; observed nodes are clamped.

        Each round goes half the way to the new messages. Loops can keep messages turning, so the step is halved after
        every hundred rounds, which ends any such turning.
        """
        n = len(nodes)
        local = np.array([self.common + self.unary.get(x[2], 0.0) for x in nodes])
        for k, x in enumerate(nodes):
            if x[4]:
                local[k] = -np.inf  # no number of neighbours may outvote it
                local[k, x[4]] = 0.0
        links = [(k, k + 1, self.chain) for k in range(n - 1)] + [(a, b, self.skip[kind]) for a, b, kind in edges]
        source = np.array([x for a, b, _ in links for x in (a, b)], np.int64)
        target = np.array([x for a, b, _ in links for x in (b, a)], np.int64)
        weight = np.array([x for _, _, w in links for x in (w, w.T)]).reshape(-1, 5, 5)
        back = np.arange(len(source)) ^ 1
        messages = np.zeros((len(source), 5))
        step, rounds, change = 0.5, 0, np.inf
        while change > 1e-4:
            belief = local.copy()
            np.add.at(belief, target, messages)
            out = belief[source] - messages[back]
            out = out[:, :, None] + weight
            top = out.max(1)
            out = top + np.log(np.exp(out - top[:, None, :]).sum(1))
            move = step * (out - out.max(1, keepdims=True) - messages)
            messages += move
            change = np.abs(move).max(initial=0.0)
            rounds += 1
            if rounds % 100 == 0:
                step /= 2
        belief = local.copy()
        np.add.at(belief, target, messages)
        belief = np.exp(belief - belief.max(1, keepdims=True))
        return belief / belief.sum(1, keepdims=True)


def graph(text: str, base: dict | None = None) -> tuple[list, list[tuple[int, int, int]]]:
    """Nodes (start, end, shape, keys, observed label) and skip edges (node, node, 0 for equal mentions or 1 for similar ones).

    Mentions with a key in common are linked to the first observed one of each label, equal ones to the very first where none is
    observed, so evidence is one edge away however many mentions there are, and edges grow with the mentions. A mention
    inside a base span is that span's node.
    """
    base = base_spans(text) if base is None else base
    observed = sorted((a, b, LABELS.index(k)) for k in KINDS for a, b in base[k])
    nodes = []
    at, reached = 0, 0
    for a, b, shape, keys in mention_keys(text):
        while at < len(observed) and observed[at][1] <= a:
            reached = max(reached, observed[at][1])
            at += 1
        if any(x < b and a < y for x, y, _ in observed[max(0, at - 2) : at + 3]) or a < reached:
            continue
        nodes.append((a, b, shape, keys, 0))
    for a, b, label in observed:
        kind = LABELS[label]
        nodes.append((a, b, f"base:{kind}", entity_keys(kind, text[a:b]), label))
    nodes.sort()
    edges: dict[tuple[int, int], int] = {}
    for kind in (0, 1):
        members: dict[str, list[int]] = defaultdict(list)
        for k, x in enumerate(nodes):
            for key in dict.fromkeys(x[3][kind]):
                members[key].append(k)
        for ks in members.values():
            hubs = {nodes[k][4]: k for k in reversed(ks) if nodes[k][4]} or ({} if kind else {0: ks[0]})
            for h in hubs.values():
                for k in ks:
                    if k != h and not nodes[k][4]:
                        edges.setdefault((min(h, k), max(h, k)), kind)
    return nodes, sorted((a, b, kind) for (a, b), kind in edges.items())


def spans(text: str, model: Field) -> tuple[dict, dict]:
    """(base spans, all spans) of a text.

    Only where no skip edge leads to an open mention is nothing inferred.
    """
    base = base_spans(text)
    every = {k: list(v) for k, v in base.items()}
    nodes, edges = graph(text, base)
    if edges:
        best = model.infer(nodes, edges).argmax(1)
        for x, label in zip(nodes, best.tolist()):
            if x[4] == 0 and label:
                every[LABELS[label]].append((x[0], x[1]))
    return base, every


def learn(docs: DataFrame, rows: int = 2000) -> Field:
    """Fit the potentials on ``rows`` documents (a bounded sample, by the order of a hash).

    The number of texts gives a limit of the hash below which about twice as many lie, so tasks hand on few texts however
    many there are. A table without texts gives a field that adds nothing.
    """
    texts = only(docs, "doc_id", "text").filter(F.col("text").rlike("[0-9]")).withColumn("_h", F.xxhash64("text", "doc_id"))
    n = texts.count()
    if n > 4 * rows:
        texts = texts.filter(F.col("_h") < int(2**64 * 2 * rows / n) - 2**63)
    return Field.learn([r.text for r in texts.orderBy("_h", F.length("text")).limit(rows).toLocalIterator()])


def find(docs: DataFrame, model: Field) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each whole text.

    Numbers and digest are of base spans; ``spans`` lists all, those of the field included, as kind:start:end.
    A null text counts as empty and has none. Repeated rows get repeated results.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)  # a row for each shape, of which there are few

    def run(batches):
        for pdf in batches:
            found = [spans(t or "", handle.value) for t in pdf["text"]]
            counts = {f"n_{k}": [len(b[k]) for b, _ in found] for k in KINDS}
            digest = [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found]
            yield pdf[["doc_id"]].assign(**counts, base_sha256=digest, spans=[joined(e) for _, e in found])

    rows = only(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def identify(docs: DataFrame) -> DataFrame:
    return find(docs, learn(docs))


def redact(docs: DataFrame, model: Field) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; null texts stay null, empty ones empty.

    Where spans overlap, the one that begins first names the kind, and what the others cover beyond it goes as well.
    Other columns are handed through.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def hidden(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for a, b, k in sorted((a, b, k) for k, v in spans(text, handle.value)[1].items() for a, b in v):
                if a >= at:
                    out += [text[at:a], f"[{k}]"]
                    at = b
                else:
                    at = max(at, b)
            return "".join(out) + text[at:]

        return texts.map(one, na_action="ignore")

    return docs.withColumn("text", hidden(F.col("text")))
