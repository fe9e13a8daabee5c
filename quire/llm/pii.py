"""Personal data: exact base patterns and a skip-chain conditional random field.

The base finds e-mail addresses, IP addresses, payment cards and phone numbers by
rule.  The field labels every word that carries a digit or an at sign (any other
word can't be personal data of these kinds: its other labels have probability 0).
Neighbouring words share chain potentials; equal or similar words of a document,
however distant, share skip potentials, so that an entity named once with context
and once without it gets one label.  Skip edges link each word to the next one with
the same key, so their number is linear in the text.  Marginals come from loopy
belief propagation; weights are learned here by pseudo-likelihood on generated
sentences.

Null and empty texts have no spans.  Repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import map_batches
from quire.llm.text import buffers

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_DOTTED = re.compile(r"[0-9.]{7,}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base spans in order of kind and start; linear in the text."""
    out: list[Span] = []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
        floor = found.end() if found else at + 1
        at = text.find("@", floor)
    for run in _DOTTED.finditer(text):
        if text.count(".", run.start(), run.end()) >= 3:
            for m in _IP.finditer(text, run.start(), run.end()):
                if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m.group().split(".")):
                    out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _DIGITS.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGITS.sub("", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# ---- the field ---------------------------------------------------------------------------

_CUES = {
    "email": frozenset("mail email e-mail contact write reply correo courriel".split()),
    "ip": frozenset("ip host server address addr from client".split()),
    "card": frozenset("card visa mastercard credit debit tarjeta carte karte account".split()),
    "phone": frozenset("phone tel call fax mobile dial telephone telefon teléfono cell".split()),
}
FEATURES = (
    "bias", "in_email", "in_ip", "in_card", "in_phone", "at", "at_domain", "quad", "quad_port", "plus", "paren", "hyphen_groups",
    "d1_3", "d4_7", "d8_15", "d16_19", "d20", "luhn", "letters", "hex", "slash_colon", "money", "cue_email", "cue_ip", "cue_card",
    "cue_phone", "group3", "group4", "next_group", "prev_group", "phone_groups", "date",
)
_TEN = re.compile(r"(?:\+?1[-.])?\(?[0-9]{3}\)?[-.][0-9]{3}[-.][0-9]{4}")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{2,4}")
_GROUPS = re.compile(r"\(?[0-9]{2,4}\)?(?:[-.][0-9]{2,4})*")


def nodes(text: str, base: list[Span]) -> tuple[list[tuple[int, int, int]], np.ndarray, list[str]]:
    """((word number, start, end), features, similarity key) of each word with a digit or at sign."""
    found, cues = [], []
    before = ("", "")
    for i, m in enumerate(_WORD.finditer(text)):
        w = m.group()
        if w.isalpha():
            before = (before[1], w.lower())
            continue
        if "@" in w or any("0" <= c <= "9" for c in w):
            left, right = 0, len(w)
            while left < right and not (w[left].isalnum() or w[left] in "+("):
                left += 1
            while right > left and not (w[right - 1].isalnum() or w[right - 1] == ")"):
                right -= 1
            if left < right:
                found.append((i, m.start() + left, m.start() + right))
                cues.append(before)
        before = (before[1], w.lower().strip(".,:;()"))
    x = np.zeros((len(found), len(FEATURES)))
    keys = []
    spans = sorted(base, key=lambda s: s[1])
    k = 0
    for j, (_, a, b) in enumerate(found):
        w = text[a:b]
        digits = _DIGITS.sub("", w)
        n = len(digits)
        f = x[j]
        f[0] = 1
        while k < len(spans) and spans[k][2] <= a:
            k += 1
        for kind, s, e in spans[k : k + 4]:
            if s < b and a < e:
                f[1 + KINDS.index(kind)] = 1
        if "@" in w:
            f[5] = 1
            f[6] = "." in w.rpartition("@")[2] and not w.startswith("@")
        parts = re.split(r"[.:/]", w)
        quad = len(parts) >= 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts[:4])
        f[7], f[8] = quad and len(parts) == 4, quad and len(parts) > 4
        f[9], f[10] = w.startswith("+"), w[:1] == "("
        groups = bool(_GROUPS.fullmatch(w))
        f[11] = groups and "-" in w
        f[12:17] = (n <= 3, 4 <= n <= 7, 8 <= n <= 15, 16 <= n <= 19, n >= 20)
        f[17] = 16 <= n <= 19 and luhn(digits)
        letters = sum(c.isalpha() for c in w)
        f[18] = letters > 0
        f[19] = letters > 0 and n > 3 and all(c in "0123456789abcdefABCDEF" for c in w)
        f[20], f[21] = "/" in w or ":" in w, "$" in w or "%" in w or "," in w
        for q, kind in enumerate(KINDS):
            f[22 + q] = bool(_CUES[kind].intersection(cues[j]))
        f[26], f[27] = groups and n == 3, groups and n == 4
        f[30], f[31] = _TEN.fullmatch(w) is not None, _DATE.fullmatch(w) is not None
        keys.append(digits if n >= 6 else w.lower())
    for j in range(len(found)):
        if j + 1 < len(found) and found[j + 1][0] == found[j][0] + 1:
            x[j, 28], x[j + 1, 29] = x[j + 1, 26] or x[j + 1, 27] or x[j + 1, 11], x[j, 26] or x[j, 27] or x[j, 9]
    return found, x, keys


def edges(found: list[tuple[int, int, int]], keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Chain edges between neighbouring words and skip edges to the next equal or similar word."""
    chain = [(j - 1, j) for j in range(1, len(found)) if found[j][0] == found[j - 1][0] + 1]
    last: dict[str, int] = {}
    skip = []
    for j, key in enumerate(keys):
        if key in last and last[key] != j - 1:
            skip.append((last[key], j))
        last[key] = j
    return np.array(chain, int).reshape(-1, 2), np.array(skip, int).reshape(-1, 2)


def marginals(unary: np.ndarray, chain: np.ndarray, skip: np.ndarray, pair: np.ndarray, tie: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Loopy sum-product with damped, normalised log messages along both kinds of edges."""
    links = np.concatenate([chain, skip])
    if not len(links):
        z = unary - unary.max(1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(1, keepdims=True)
    pots = np.concatenate([np.repeat(pair[None], len(chain), 0), np.repeat(tie[None], len(skip), 0)])
    src = np.concatenate([links[:, 0], links[:, 1]])
    dst = np.concatenate([links[:, 1], links[:, 0]])
    pots = np.concatenate([pots, pots.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
    msg = np.zeros((len(src), unary.shape[1]))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        out = (belief[src] - msg[back])[:, :, None] + pots
        top = out.max(1, keepdims=True)
        new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
        new -= new.max(1, keepdims=True)
        if np.abs(new - msg).max() < 1e-4:
            msg = new
            break
        msg = 0.5 * msg + 0.5 * new
    belief = unary.copy()
    np.add.at(belief, dst, msg)
    belief -= belief.max(1, keepdims=True)
    p = np.exp(belief)
    return p / p.sum(1, keepdims=True)


def _generated(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Sentences with personal data in many spellings, and with harmless numbers."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))

    def card() -> str:
        body = pick("3456") + num(14)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    def entity() -> tuple[str, str]:
        kind = pick(KINDS)
        if kind == "email":
            return kind, pick(["anna", "j.doe", "info", "m_k", "ünal"]) + pick(["", num(2)]) + "@" + pick(["mail", "example", "a-b"]) + pick([".com", ".org", ".co.uk", num(1) + ".example.com"])
        if kind == "ip":
            return kind, ".".join(str(int(v)) for v in rng.integers(1, 256, 4)) + pick(["", "", ":" + num(4)])
        if kind == "card":
            c = card()
            return kind, pick([c, " ".join(c[i : i + 4] for i in range(0, 16, 4)), "-".join(c[i : i + 4] for i in range(0, 16, 4))])
        return kind, pick([f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(7)}", f"1-{num(3)}-{num(3)}-{num(4)}"])

    def harmless() -> str:
        return pick([num(4), num(2), num(16), num(15), f"{num(1)}.{num(1)}", f"{num(1)}.{num(1)}.{num(1)}", f"{num(2)}/{num(2)}/{num(4)}", f"${num(2)},{num(3)}", f"{num(2)}%", "".join(pick("0123456789abcdef") for _ in range(32)), f"v{num(1)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", f"{num(3)} {num(3)}", "a" + num(3), "@" + "user", num(22), f"{num(4)}-{num(4)}"])

    filler = "the of and from with report data on was in at for section version paid page item order".split()
    out = []
    for _ in range(n):
        text, spans, seen = "", [], []
        for _ in range(int(rng.integers(3, 9))):
            text += " ".join(pick(filler) for _ in range(int(rng.integers(1, 6)))) + " "
            if rng.random() < 0.5:
                kind, value = pick(seen) if seen and rng.random() < 0.4 else entity()
                seen.append((kind, value))
                if rng.random() < 0.4:
                    text += pick(sorted(_CUES[kind])) + " "
                spans.append((kind, len(text), len(text) + len(value)))
                text += value + pick([" ", ". ", ", "])
            else:
                text += harmless() + " "
        out.append((text, spans))
    return out


@lru_cache(maxsize=4)
def train(sentences: int = 1000, seed: int = 7, steps: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unary weights, chain potentials, skip potentials) by pseudo-likelihood; deterministic."""
    xs, ys, chains, skips, base = [], [], [], [], 0
    for text, spans in _generated(sentences, seed):
        found, x, keys = nodes(text, base_spans(text))
        y = np.zeros(len(found), int)
        for j, (_, a, b) in enumerate(found):
            for kind, s, e in spans:
                if s < b and a < e:
                    y[j] = LABELS.index(kind)
        c, s = edges(found, keys)
        xs.append(x), ys.append(y), chains.append(c + base), skips.append(s + base)
        base += len(found)
    x, y, c, s = np.concatenate(xs), np.concatenate(ys), np.concatenate(chains), np.concatenate(skips)
    one = np.eye(len(LABELS))[y]
    w, pair, tie = np.zeros((x.shape[1], len(LABELS))), np.zeros((len(LABELS),) * 2), np.zeros((len(LABELS),) * 2)

    def beside(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many neighbours of each label every word has, behind it and before it."""
        after, before = np.zeros_like(one), np.zeros_like(one)
        np.add.at(after, links[:, 0], one[links[:, 1]])
        np.add.at(before, links[:, 1], one[links[:, 0]])
        return after, before

    sides = (beside(c), beside(s))
    velocity = [np.zeros_like(v) for v in (w, pair, tie)]
    for _ in range(steps):
        z = x @ w
        for (after, before), pot in zip(sides, (pair, tie)):
            z += after @ pot.T + before @ pot
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (one - p) / len(y)
        grads = [x.T @ g - 1e-4 * w]
        for (after, before), pot in zip(sides, (pair, tie)):
            d = g.T @ after + before.T @ g
            grads.append((d + d.T) / 2 - 1e-4 * pot)
        for v, grad, param in zip(velocity, grads, (w, pair, tie)):
            v *= 0.9
            v += grad
            param += 2.0 * v
    return w, pair, tie


def field_spans(text: str, base: list[Span], model: tuple[np.ndarray, np.ndarray, np.ndarray], threshold: float = 0.8) -> list[Span]:
    """Spans the field adds: runs of neighbouring words with one label, apart from base spans."""
    found, x, keys = nodes(text, base)
    if not found:
        return []
    w, pair, tie = model
    p = marginals(x @ w, *edges(found, keys), pair, tie)
    label = np.where(p[:, 1:].max(1) >= threshold, p[:, 1:].argmax(1) + 1, 0)
    taken = sorted((s, e) for _, s, e in base)
    out: list[Span] = []
    run: tuple[int, int, int, int] | None = None
    for (i, a, b), k in [*zip(found, label), ((1 << 60, 0, 0), 0)]:
        if run and k == run[0] and i == run[3] + 1 and k in (3, 4):
            run = (run[0], run[1], b, i)
            continue
        if run:
            out.append((KINDS[run[0] - 1], run[1], run[2]))
        run = (k, a, b, i) if k else None
    free = []
    starts = [s for s, _ in taken]
    ends = np.maximum.accumulate([e for _, e in taken]) if taken else []
    for kind, s, e in out:
        j = int(np.searchsorted(starts, e)) if taken else 0
        n = sum("0" <= c <= "9" for c in text[s:e])
        fits = "@" in text[s:e] if kind == "email" else 16 <= n <= 19 if kind == "card" else 7 <= n <= 15 if kind == "phone" else 4 <= n
        if fits and (j == 0 or ends[j - 1] <= s):
            free.append((kind, s, e))
    return free


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
_EMPTY = hashlib.sha256(b"").hexdigest()


def find_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans with the field's.

    Map-only: reads two columns and shuffles nothing.  Null or empty texts give zero
    counts and no spans; repeated rows are kept; any doc_id, null too, is passed on.
    """
    model = train()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        body, offsets = buffers(batch.column(1))
        mark = np.zeros(len(body) + 1, np.int64)
        np.cumsum(((body >= 48) & (body <= 57)) | (body == 64), out=mark[1:])
        live = np.flatnonzero(mark[offsets[1:]] > mark[offsets[:-1]])
        n = batch.num_rows
        counts = np.zeros((n, 4), np.int64)
        digests, all_spans = [_EMPTY] * n, [""] * n
        texts = batch.column(1).take(pa.array(live)).to_pylist()
        for j, t in zip(live.tolist(), texts):
            base = base_spans(t)
            for kind, _, _ in base:
                counts[j, KINDS.index(kind)] += 1
            if base:
                digests[j] = hashlib.sha256(joined(base).encode()).hexdigest()
            all_spans[j] = joined(base + field_spans(t, base, model, threshold))
        cols = [batch.column(0).cast(pa.int64()), *(pa.array(counts[:, i]) for i in range(4)), pa.array(digests, pa.string()), pa.array(all_spans, pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return map_batches(docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text"), run, OUT)
