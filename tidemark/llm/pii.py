"""Personal data by patterns and a skip-chain conditional random field.

Patterns with checks (address octets, Luhn, digit counts) give the base spans, and an assignment to a name like token or password gives secrets. Both are
observed. The field decides on the tokens that patterns don't recognise but that are alike to an observed one, anywhere in the document:

* candidates share a key with an observed token: the same digits, the same letters and digits whatever the case and punctuation, or the name of an address; a number
  may be split by blanks or written in another format;
* node potentials come from the token's shape; chain edges join neighbouring tokens that show a digit or an @;
* skip edges join a candidate to the token with its key before it and to the nearest observed one, so n alike tokens have 2 n edges at most and not n * n.

Weights are fitted by pseudo-likelihood on a bounded sample of documents (`SAMPLE`, and `SAMPLE_BYTES` of text). A repeated observed token is taught once more with its label hidden: it
shows its coarse shape only, and its neighbours over skip edges have to tell what it is, which is what the gain over a skip edge is learned from. `VIRTUAL` agreeing
pairs of each kind stand for what is known before. At inference loopy sum-product messages run over one document at a time, so no document's marginals depend on
others. A token is added when its marginal reaches `SURE` and an observed token joined to it by a skip edge has the same label.

Defined results: a null or empty text has no spans; rows are answered one by one, so ties and repeated rows need no rule; a very long text is held by one task, with
some hundred bytes for each of its candidates; a row without doc_id is answered; an empty table gives no rows; columns besides doc_id and text are not read.
"""

import re
from bisect import bisect_left

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import answered, table, within
from ._text import buffers

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
NAMES = (*KINDS, SECRET)
LABELS = 1 + len(NAMES)  # 0: none
SAMPLE, SAMPLE_BYTES = 1000, 32 << 20
SURE, ROUNDS, VIRTUAL = 0.8, 20, 4.0

_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EVIDENCE = re.compile(r"[0-9@]")
_NUMBERS = re.compile(r"[0-9](?:[\x20()./-]{0,3}[0-9])+")
_NO_DIGIT = re.compile("[^0-9]+")
#: What is assigned to a name that says so. All repetitions but the last are bounded, so a search is linear in the text.
_ASSIGNED = re.compile(r"(?:token|secret|key|passw(?:or)?d|pwd|credential)[A-Za-z0-9_]{0,32}[\"']?[\x20\t]{0,8}[:=][\x20\t]{0,8}[\"']?([A-Za-z0-9_+/=-]{16,})", re.I)
_TRIM = "()[]{}<>\"'.,;:!?"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d += d * (i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and then start. Each search is linear in the text."""
    out = []
    if "@" in text:
        for run in _RUN.finditer(text):
            at, free = text.find("@", run.start(), run.end()), run.start()
            while at >= 0:
                if at > free and (m := _DOMAIN.match(text, at)):
                    out.append((0, free, m.end()))
                    free = m.end()
                    at = text.find("@", free, run.end())
                else:
                    free = at + 1
                    at = text.find("@", free, run.end())
    if "." in text:
        for chain in _DOTTED.finditer(text):
            if chain[0].count(".") < 3:
                continue
            parts, at = chain[0].split("."), chain.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                size = sum(map(len, four)) + 3
                if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                    out.append((1, at, at + size))
                at += size + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def secrets(text: str) -> list[tuple[int, int, int]]:
    """(label - 1, start, end) of assigned values with a digit and a letter."""
    if "=" not in text and ":" not in text:
        return []
    at = [m.span(1) for m in _ASSIGNED.finditer(text)]
    return [(len(KINDS), a, b) for a, b in at if any("0" <= c <= "9" for c in text[a:b]) and any(c.isalpha() for c in text[a:b])]


FEATURES = 31
#: Of shape(): what a token shows whatever its format.
COARSE = frozenset({*range(8), 18, 23, 24, 25})


def shape(word: str) -> list[int]:
    """The numbers of the features that a token has."""
    digits = sum("0" <= c <= "9" for c in word)
    letters = sum(c.isalpha() for c in word)
    out = [0, 1 + min(6, int(np.searchsorted((1, 4, 7, 9, 13, 20), digits, "right")))]
    out.append(8 + min(4, word.count(".")))
    out.append(13 + min(4, int(np.searchsorted((4, 9, 17, 33), len(word), "right"))))
    if "@" in word:
        out.append(18)
        if "." in word.partition("@")[2]:
            out.append(19)
    out += [20] * word.startswith("+") + [21] * ("(" in word or ")" in word) + [22] * ("-" in word)
    out.append(23 + (letters > 0) + (letters > digits))
    out += [26] * ("=" in word) + [27] * (not letters and digits + word.count(".") == len(word)) + [28] * (digits == len(word))
    out += [29] * (len(word) >= 16 and letters > 0 and digits > 0) + [30] * (len(word) >= 16 and all(c in "0123456789abcdefABCDEF" for c in word))
    return out


def keys(word: str) -> set[str]:
    """What similar tokens share."""
    found = set()
    plain = "".join(c for c in word.casefold() if c.isalnum())
    digits = "".join(c for c in word if "0" <= c <= "9")
    if len(plain) >= 5:
        found.add(plain)
    if len(digits) >= 7:
        found.add(digits)
    if "@" in word and len(name := "".join(c for c in word.partition("@")[0].casefold() if c.isalnum())) >= 5:
        found.add(name)
    return found


def _places(text: str, digits: set[str]):
    """(digits, start, end) wherever one of the numbers is found among the digits of a run, whatever blanks and marks divide it; places of one number don't overlap. One pass over the text."""
    if not digits:
        return
    known = ahocorasick.Automaton()
    for d in digits:
        known.add_word(d, d)
    known.make_automaton()
    for m in _NUMBERS.finditer(text):
        place, free = None, {}
        plain = _NO_DIGIT.sub("", m[0])
        for last, d in known.iter(plain):
            first = last - len(d) + 1
            if first >= free.get(d, 0):
                free[d] = last + 1
                place = place or [m.start() + i for i, c in enumerate(m[0]) if "0" <= c <= "9"]
                yield d, place[first], place[last] + 1


class Document:
    """Tokens of one text, by place: spans, labels (0 where not observed) and the keys of those alike to another; chain and skip edges between them."""

    def __init__(self, text: str, observed: list[tuple[int, int, int]], evidence: bool):
        """evidence: with all tokens that show a digit or an @, as for training; else only with candidates and what they touch."""
        self.text = text
        taken = sorted((a, b, k + 1) for k, a, b in observed)
        starts = [a for a, _, _ in taken]
        reach = np.maximum.accumulate([b for _, b, _ in taken]).tolist() if taken else []
        free = lambda a, b: not ((i := bisect_left(starts, b)) and reach[i - 1] > a)
        nodes = {(a, b): (k, keys(text[a:b])) for a, b, k in taken}
        wanted = set().union(*(k for _, k in nodes.values())) if nodes else set()
        shown, near = [], {}
        for i, m in enumerate(_WORD.finditer(text)) if wanted or evidence else ():
            a, b = m.span()
            has = _EVIDENCE.search(text, a, b) is not None
            if not has and b - a < 5:
                continue
            core = m[0].strip(_TRIM) or m[0]
            a += m[0].index(core)
            b = a + len(core)
            if not free(a, b):
                continue
            own = keys(core)
            if own & wanted:
                nodes[a, b] = (0, own)
            elif has and evidence:
                nodes[a, b] = (0, own)
            if has:
                shown.append((i, a, b))
                near[a, b] = own
        digits = {d for label, own in nodes.values() if label for d in own if d.isdigit() and d.isascii()}
        for d, a, b in _places(text, digits):
            if free(a, b) and (a, b) not in nodes:
                nodes[a, b] = (0, {d})
        if not evidence:
            # candidates feel their neighbours too
            for (i, *x), (j, *y) in zip(shown, shown[1:], strict=False):
                if j == i + 1 and (tuple(x) in nodes) != (tuple(y) in nodes):
                    for z in (tuple(x), tuple(y)):
                        nodes.setdefault(z, (0, near[z]))
        self.spans = sorted(nodes)
        self.label = np.array([nodes[s][0] for s in self.spans], np.int64)
        at = {s: k for k, s in enumerate(self.spans)}
        self.chain = [(at[tuple(x)], at[tuple(y)]) for (i, *x), (j, *y) in zip(shown, shown[1:], strict=False) if j == i + 1 and tuple(x) in at and tuple(y) in at]
        by_key: dict[str, list[int]] = {}
        for k, s in enumerate(self.spans):
            for key in nodes[s][1]:
                by_key.setdefault(key, []).append(k)
        skip = set()
        for group in by_key.values():
            seen = [k for k in group if self.label[k]]
            for before, k in zip(group, group[1:], strict=False):
                if evidence or not (self.label[before] and self.label[k]):
                    skip.add((before, k))
            for k in group if seen else ():
                if not self.label[k]:
                    i = bisect_left(seen, k)
                    other = min(seen[max(0, i - 1) : i + 1], key=lambda x: abs(x - k))
                    skip.add((min(k, other), max(k, other)))
        self.skip = sorted(skip)

    def candidates(self) -> np.ndarray:
        """True where a token isn't observed but joined to an observed one by a skip edge."""
        out = np.zeros(len(self.spans), bool)
        for a, b in self.skip:
            out[a] |= not self.label[a] and self.label[b] > 0
            out[b] |= not self.label[b] and self.label[a] > 0
        return out

    def matrix(self, coarse: np.ndarray) -> np.ndarray:
        """The features of every token; of those of the mask only the coarse ones."""
        x = np.zeros((len(self.spans), FEATURES))
        for i, (a, b) in enumerate(self.spans):
            own = shape(self.text[a:b])
            x[i, [f for f in own if f in COARSE] if coarse[i] else own] = 1
        return x


def _pairs(edges) -> np.ndarray:
    return np.array(edges, np.int64).reshape(-1, 2)


class SkipChain:
    """node: FEATURES x LABELS, chain: LABELS x LABELS, skip: the gain of equal labels over a skip edge."""

    def __init__(self):
        self.node, self.chain, self.skip = np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), 0.0

    def fit(self, docs: list[Document], steps: int = 300, decay: float = 1e-3) -> "SkipChain":
        """By gradient ascent on the pseudo-likelihood: each label given the token and the labels of its neighbours."""
        first = np.concatenate(([0], np.cumsum([len(d.spans) for d in docs]))).astype(np.int64)
        one = np.eye(LABELS)
        y = np.concatenate([d.label for d in docs] + [np.zeros(0, np.int64)])
        n = len(y)
        chain, skip = (np.concatenate([_pairs(e) + f for e, f in zip(edges, first, strict=False)] + [_pairs([])]) for edges in ([d.chain for d in docs], [d.skip for d in docs]))
        near = np.zeros((n, LABELS))
        np.add.at(near, skip[:, 0], one[y[skip[:, 1]]])
        np.add.at(near, skip[:, 1], one[y[skip[:, 0]]])
        # what is alike to an observed token but not observed is what the field is to decide: it teaches nothing
        taught = (y > 0) | (near[:, 1:].sum(1) == 0)
        hidden = np.flatnonzero(taught & (near.sum(1) > 0))
        full = np.concatenate([d.matrix(np.zeros(len(d.spans), bool)) for d in docs] + [np.zeros((0, FEATURES))])
        coarse = full * np.isin(np.arange(FEATURES), list(COARSE))
        virtual = np.arange(1, LABELS)
        bias = np.zeros((len(virtual), FEATURES))
        bias[:, 0] = 1
        # rows: every token as it is, repeated ones with their labels hidden, virtual pairs
        x, y_all, near_all = np.concatenate([full, coarse[hidden], bias]), np.concatenate([y, y[hidden], virtual]), np.concatenate([near, near[hidden], one[virtual]])
        weight = np.concatenate([taught / max(1, n), np.ones(len(hidden)) / (len(hidden) + VIRTUAL * len(virtual)), np.full(len(virtual), VIRTUAL) / (len(hidden) + VIRTUAL * len(virtual))])[:, None]
        parts = [self.node, self.chain, np.zeros(1)]
        m, v = ([np.zeros_like(p) for p in parts] for _ in range(2))
        for t in range(1, steps + 1):
            logits = x @ parts[0] + parts[2][0] * near_all
            np.add.at(logits, chain[:, 1], parts[1][y[chain[:, 0]]])
            np.add.at(logits, chain[:, 0], parts[1][:, y[chain[:, 1]]].T)
            p = np.exp(logits - logits.max(1, keepdims=True))
            rest = (one[y_all] - p / p.sum(1, keepdims=True)) * weight
            pair = np.zeros_like(parts[1])
            np.add.at(pair, y[chain[:, 0]], rest[chain[:, 1]])
            np.add.at(pair.T, y[chain[:, 1]], rest[chain[:, 0]])
            for k, slope in enumerate((x.T @ rest, pair, np.array([(rest * near_all).sum()]))):
                slope = slope - decay * parts[k]
                m[k] += 0.1 * (slope - m[k])
                v[k] += 0.01 * (slope**2 - v[k])
                parts[k] += 0.1 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        self.node, self.chain, self.skip = parts[0], parts[1], float(max(0.0, parts[2][0]))
        return self

    def marginals(self, d: Document, rounds: int = ROUNDS) -> np.ndarray:
        """Beliefs after loopy sum-product with the labels of observed tokens given."""
        unary = d.matrix(d.candidates()) @ self.node
        given = np.flatnonzero(d.label)
        unary[given] = -1e3
        unary[given, d.label[given]] = 0
        chain, skip = _pairs(d.chain), _pairs(d.skip)
        c, e = len(chain), len(chain) + len(skip)
        one = np.concatenate([chain, skip])
        source, target = np.concatenate([one[:, 0], one[:, 1]]), np.concatenate([one[:, 1], one[:, 0]])
        back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
        of_skip = np.concatenate([np.arange(2 * e) % e >= c]) if e else np.zeros(0, bool)
        forward, backward = np.exp(self.chain), np.exp(self.chain.T)
        message = np.zeros((2 * e, LABELS))
        for _ in range(rounds if e else 0):
            belief = unary.copy()
            np.add.at(belief, target, message)
            out = belief[source] - message[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = out.sum(1, keepdims=True) + np.expm1(self.skip) * out
            new[:c], new[e : e + c] = out[:c] @ forward, out[e : e + c] @ backward
            new = np.log(np.maximum(new, 1e-300))
            new -= new.max(1, keepdims=True)
            change = np.abs(new - message).max()
            message = 0.5 * message + 0.5 * new
            if change < 1e-6:
                break
        belief = unary.copy()
        np.add.at(belief, target, message)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def added(self, d: Document, sure: float = SURE) -> list[tuple[int, int, int]]:
        """(label - 1, start, end) of the tokens that the field adds; of two that overlap the surer one."""
        if not d.candidates().any():
            return []
        p = self.marginals(d)
        best, top = p.argmax(1), p.max(1)
        held = {k for a, b in d.skip for k, o in ((a, b), (b, a)) if not d.label[k] and d.label[o] and best[k] == d.label[o] and top[k] >= sure}
        out: list[tuple[int, int, int]] = []
        last = 0
        for k in sorted(held, key=lambda k: (d.spans[k][0], -top[k])):
            a, b = d.spans[k]
            if a >= last:
                out.append((int(best[k]) - 1, a, b))
                last = b
        return sorted(out)


def train(docs: DataFrame, size: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> SkipChain:
    """A field fitted on the first `size` documents with evidence by a hash of their ids, but for those that would bring their texts over `most_bytes`: these are skipped one by one."""
    text = F.col("text").cast("string")
    some = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("h"), F.xxhash64(text).alias("t"), text.alias("text")).where(text.rlike("[0-9@]"))
    # only hashes and sizes go to the driver from every task, then the texts of the chosen documents
    first = some.select("h", "t", F.octet_length("text").alias("size")).orderBy("h", "t").limit(size).collect()
    chosen = within(first, most_bytes)
    if not chosen:
        return SkipChain().fit([])
    keys = F.broadcast(docs.sparkSession.createDataFrame([(r.h, r.t) for r in chosen], "h long, t long").distinct())  # `size` rows at most
    rows = some.join(keys, ["h", "t"], "left_semi").dropDuplicates(["h", "t"])
    return SkipChain().fit([Document(r.text, base_spans(r.text) + secrets(r.text), True) for r in rows.orderBy("h", "t").collect()])


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first one counts."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"<{NAMES[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, model: SkipChain | None = None, row: bool = False) -> DataFrame:
    """doc_id, base, spans and secrets (arrays of kind, start and end) of every row, and redacted, the text with all of them replaced, null if there are none; if row, a struct of all columns instead of doc_id."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model or train(docs))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    named = lambda s: [{"kind": NAMES[k], "start": a, "end": b} for k, a, b in s]

    evidence = np.zeros(256, bool)
    evidence[[*range(0x30, 0x3A), 0x40]] = True

    def answers(texts):
        data, offsets = buffers(texts)
        total = np.concatenate(([0], np.cumsum(evidence[data[offsets[0] : offsets[-1]]], dtype=np.int64)))
        base, spans, hidden = ([[] for _ in range(len(texts))] for _ in range(3))
        changed: list = [None] * len(texts)
        for k in np.flatnonzero(np.diff(total[offsets - offsets[0]])).tolist():
            text = data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")
            found, values = base_spans(text), secrets(text)
            more = shared.value.added(Document(text, found + values, False)) if found or values else []
            every = sorted(found + [x for x in more if x[0] < len(KINDS)])
            values = sorted(values + [x for x in more if x[0] == len(KINDS)])
            base[k], spans[k], hidden[k] = named(found), named(every), named(values)
            changed[k] = redacted(text, every + values) if every or values else None
        return {"base": pa.array(base, span), "spans": pa.array(spans, span), "secrets": pa.array(hidden, span), "redacted": pa.array(changed, pa.string())}

    kinds = "array<struct<kind: string, start: long, end: long>>"
    return answered(docs, answers, f"base {kinds}, spans {kinds}, secrets {kinds}, redacted string", row)


def listed(spans):
    """Column: kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number(spans, kind: str):
    """Column: how many of the spans are of this kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    counts = [number(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    size = lambda c: F.size(c).cast("long")
    return found.select(
        "doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        (size("spans") - size("base")).alias("n_added"), listed(F.col("secrets")).alias("secrets"), (size("spans") + size("secrets")).alias("n_found"),
    )
