"""Personal data: patterns find the plain mentions, a skip-chain conditional random field the ones like them.

Mentions of a document are the nodes of a graph: number groups of seven digits or more,
dotted groups of four numbers, and tokens with an at sign or a bracketed "at". Neighbours
in the text share a chain potential; mentions with the same digits or letters, however far
apart, share a skip potential, and mentions alike in part (the last digits, the name before
the at sign, the network of an address) share another.
Loopy belief propagation makes labels agree across the document, so an entity that a
pattern finds once is also found where it is written another way.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from webgrain.llm.common import map_rows, numbered, pick

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
Span = tuple[int, int, str]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match always starts where a run of digits starts, so inner digits needn't be tried.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub(r"[^0-9]+", "", text)


def _byte(part: str) -> bool:
    """Whether digits, zeros in front or not, are at most 255."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def emails(text: str) -> list[Span]:
    """Matches of the e-mail pattern, found from their at signs: each run of local characters is read once."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        free = found.end() if found else at + 1
        if found:
            out.append((start, free, "email"))
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind, by start and then kind; failing matches are dropped."""
    out = emails(text)
    if any(c in text for c in "0123456789"):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(_byte(p) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


_NUMBER = re.compile(r"[+(]*[0-9](?:[ ().,/\[\]_-]{0,3}[0-9])+")
_TOKEN = re.compile(r"[^\s<>\"',;|]*")


#: Four numbers of up to three digits with the same separator, which has a dot.
_QUAD = re.compile(r"(?<![0-9])([0-9]{1,3})([ (\[]?\.[ )\]]?)([0-9]{1,3})\2([0-9]{1,3})\2([0-9]{1,3})(?![0-9])(?!\2[0-9])")
_GAP = re.compile(r"[^0-9]+")


def _gap_rank(gap: str) -> tuple[int, int]:
    """Which separators part mentions first: the wider, of equal ones a comma, then a space, then a slash."""
    return len(gap), 3 * ("," in gap) or 2 * (" " in gap) or int("/" in gap)


def _numbers(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Number groups of seven to nineteen digits, and dotted quads of any number of them.

    Groups are cut at the edges of base spans and of dotted quads. One with more digits is
    cut at all its widest separators, and again while a part has too many.
    """
    quads = [m.span() for m in _QUAD.finditer(text) if all(int(m[g]) <= 255 for g in (1, 3, 4, 5))] if "." in text else []
    whole = set(quads)
    edges_ = sorted({at for a, b in quads for at in (a, b)} | {at for a, b, _ in base for at in (a, b)})
    out, k = [], 0
    for m in _NUMBER.finditer(text):
        while k < len(edges_) and edges_[k] <= m.start():
            k += 1
        cuts = [m.start()]
        while k < len(edges_) and edges_[k] < m.end():
            # An edge between two digits parts no number.
            if not (text[edges_[k] - 1].isdigit() and text[edges_[k]].isdigit()):
                cuts.append(edges_[k])
            k += 1
        todo = list(zip(cuts, [*cuts[1:], m.end()], strict=True))[::-1]
        while todo:
            a, b = todo.pop()
            if (a, b) in whole:
                out.append((a, b))
                continue
            if (a, b) != m.span():
                # A part begins with a digit, or the plus and brackets before it, and ends with a digit.
                found = re.search(r"[+(]*[0-9]", text[a:b])
                if not found:
                    continue
                a += found.start()
                while not text[b - 1].isdigit():
                    b -= 1
            n = len(digits_of(text[a:b]))
            if 7 <= n <= 19:
                out.append((a, b))
            elif n > 19:
                gaps = [(a + g.start(), a + g.end(), _gap_rank(g[0])) for g in _GAP.finditer(text[a:b]) if g.start()]
                if gaps:
                    top = max(g[2] for g in gaps)
                    wide = [g for g in gaps if g[2] == top]
                    # Brackets and plus signs of the separator stay with the number after it.
                    todo += list(zip([a, *(g[0] for g in wide)], [*(g[0] for g in wide), b], strict=True))[::-1]
    return out


#: "at" and "dot" written out in brackets, and what may stand behind such an "at".
_AT = re.compile(r"[\[({<] ?at ?[\])}>]", re.IGNORECASE)
_DOT = re.compile(r" ?[\[({<] ?(?:dot|\.) ?[\])}>] ?", re.IGNORECASE)
_HOST = re.compile(r" ?[A-Za-z0-9-]+(?:(?:\.| ?[\[({<] ?(?:dot|\.) ?[\])}>] ?)[A-Za-z0-9-]+)*", re.IGNORECASE)
_BREAKS = frozenset("<>\"',;|")


def _at_tokens(text: str) -> list[tuple[int, int]]:
    """Tokens around at signs and around bracketed "at"s, each read once."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and not text[start - 1].isspace() and text[start - 1] not in _BREAKS:
            start -= 1
        free = _TOKEN.match(text, at).end()
        tail = _DOT.match(text, free)
        while tail and (host := _HOST.match(text, tail.end())):
            free = host.end()
            tail = _DOT.match(text, free)
        # Brackets and stops that close what stands around the token are not of it.
        end = free
        while end > at + 1 and not text[end - 1].isalnum():
            end -= 1
        out.append((start, end))
        at = text.find("@", max(free, at + 1))
    free = 0
    for m in _AT.finditer(text):
        start = m.start() - (m.start() > 0 and text[m.start() - 1] == " ")
        stop = start
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        host = _HOST.match(text, m.end())
        if host and start < stop:
            free = host.end()
            out.append((start, free))
    return out


def mentions(text: str, base: list[Span] = ()) -> list[tuple[int, int]]:
    """Number groups and tokens with an at, in order and not overlapping; ``base`` are the text's base spans."""
    out = _numbers(text, base) if any(c in text for c in "0123456789") else []
    if "@" in text or _AT.search(text):
        out += _at_tokens(text)
    out.sort(key=lambda s: (s[0], -s[1]))
    kept: list[tuple[int, int]] = []
    for s in out:
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
    return kept


#: Names of a mention's features; the last len(KINDS) say which pattern covers it.
FEATURES = ("bias", "at", "spelled", "letters", "plus", "parens", "dots", "four parts", "luhn", "7", "8-9", "10", "11-13", "14-19", "plain digits", *KINDS)


def _quad(mention: str) -> tuple[int, ...] | None:
    parts = [p for p in re.split(r"[^0-9]+", mention) if p]
    return tuple(map(int, parts)) if len(parts) == 4 and all(map(_byte, parts)) else None


def node_features(mention: str, covered: str | None) -> np.ndarray:
    d = digits_of(mention)
    spelled = bool(_AT.search(mention))
    named = "@" in mention or spelled
    n = 0 if named else len(d)
    found = {
        "bias": True,
        "at": "@" in mention,
        "spelled": spelled or bool(_DOT.search(mention)),
        "letters": any(c.isalpha() for c in mention),
        "plus": mention[:1] == "+",
        "parens": "(" in mention,
        "dots": "." in mention,
        "four parts": not named and _quad(mention) is not None,
        "luhn": 14 <= n <= 19 and luhn(d),
        "7": n == 7,
        "8-9": 8 <= n <= 9,
        "10": n == 10,
        "11-13": 11 <= n <= 13,
        "14-19": 14 <= n,
        "plain digits": mention == d,
    }
    return np.array([float(found.get(f, f == covered)) for f in FEATURES])


def alike(mention: str) -> tuple[str, str | None]:
    """Two keys: mentions of the same first one say the same, those of the same second one are alike in part."""
    plain = _DOT.sub(".", re.sub(rf" ?{_AT.pattern} ?", "@", mention, flags=re.IGNORECASE)).lower()
    if "@" in plain:
        name = re.sub(r"[^a-z0-9]+", "", plain.partition("@")[0])
        return "@" + re.sub(r"[^a-z0-9]+", "", plain), "@" + name + "@" if name else None
    if (quad := _quad(mention)) is not None:
        return "." + ".".join(map(str, quad)), "." + ".".join(map(str, quad[:3])) + "."
    d = digits_of(mention)
    return ("#" if len(d) < 14 else "##" + d[:-10]) + d[-10:], ("7#" if len(d) < 14 else "8#") + d[-7 - (len(d) > 13) :]


def edges(text: str, found: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chain edges of mentions within 40 characters, and skip edges from each mention to the last one that says the same, and to the last one alike in part; linear in number."""
    chain = [(i - 1, i) for i in range(1, len(found)) if found[i][0] - found[i - 1][1] <= 40]
    last: dict[str, int] = {}
    same, part = [], []
    for i, (a, b) in enumerate(found):
        whole, half = alike(text[a:b])
        if whole in last:
            same.append((last[whole], i))
        if half is not None:
            # What says the same is linked already.
            if half in last and last.get(whole) != last[half]:
                part.append((last[half], i))
            last[half] = i
        last[whole] = i
    return tuple(np.array(e, int).reshape(-1, 2) for e in (chain, same, part))


class SkipChain:
    """Log potentials: features by label, and label pairs of each kind of edge (chain, same, alike in part)."""

    def __init__(self, unary: np.ndarray, *pair: np.ndarray):
        self.unary, self.pair = unary, pair

    def marginals(self, x: np.ndarray, *ends_by_kind: np.ndarray, rounds: int = 200, still: float = 1e-5) -> np.ndarray:
        """Label probabilities of each mention by damped loopy message passing, until messages stand still.

        Exact where the graph has no loop.
        """
        k = len(LABELS)
        node = x @ self.unary
        ends = np.concatenate(ends_by_kind)
        if len(ends):
            tables = np.concatenate([np.repeat(p[None], len(e), 0) for p, e in zip(self.pair, ends_by_kind, strict=True)])
            source, target = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
            tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(ends)) + len(ends), np.arange(len(ends))])
            messages = np.zeros((len(source), k))
            for _ in range(rounds):
                belief = node.copy()
                np.add.at(belief, target, messages)
                out = (belief[source] - messages[back])[:, :, None] + tables
                top = out.max(1)
                new = top + np.log(np.exp(out - top[:, None]).sum(1))
                new = 0.5 * messages + 0.5 * (new - new.max(1, keepdims=True))
                moved = np.abs(new - messages).max()
                messages = new
                if moved < still:
                    break
            np.add.at(node, target, messages)
        p = np.exp(node - node.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _entity(rng: np.random.Generator, kind: str) -> list[str]:
    """Spellings of a made entity: first those that a pattern finds, one of them, then others."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    one = lambda *s: s[rng.integers(len(s))]
    if kind == "email":
        a, b, c = f"{one('ann', 'bo', 'c.d', 'eve')}{one('', '.', '_')}{d(2)}", f"host{d(1)}", one("org", "com", "net")
        l, r = one("[]", "()", "{}", "<>")
        dot = one(".", f"{l}.{r}", f" {l}dot{r} ")
        return [f"{a}@{b}.{c}", one(f"{a}@{b}{l}.{r}{c}", f"{a} {l}at{r} {b}{dot}{c}", f"{a}{l}at{r}{b}{dot}{c}", f"{a}@{b} {l}dot{r} {c}")]
    if kind == "ip":
        q = [str(v) for v in rng.integers(0, 256, 4)]
        return [".".join(q), one("[.]", "(.)", " . ", ". ").join(q)]
    if kind == "card":
        body = "4" + d(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        quarters = [body[i : i + 4] for i in range(0, 16, 4)]
        return [one(" ", "", "-").join(quarters), one(".", "/", "_", ", ", " / ").join(quarters)]
    a, b, c = d(3), d(3), d(4)
    return [one(f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"+1.{a}.{b}.{c}"), one(f"({a}) {b}-{c}", f"{a}.{b}.{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"001 {a} {b} {c}", f"{a}/{b}/{c}", f"{b}-{c}")]


def _example(rng: np.random.Generator) -> tuple[str, list[tuple[str, str]]]:
    """A made document: entities in plain spellings and others, entities in other spellings alone, and numbers that mean nothing."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    parts: list[tuple[str, str]] = []
    for _ in range(rng.integers(0, 4)):
        kind = KINDS[rng.integers(4)]
        plain, other = _entity(rng, kind)
        parts += [(plain, kind)] * rng.integers(1, 3)
        parts += [(other, kind)] * (rng.random() < 0.8)
        if kind == "ip" and rng.random() < 0.2:  # of the same network
            parts.append((plain.rpartition(".")[0] + f".{rng.integers(0, 256)}", kind))
    for _ in range(rng.integers(0, 5)):
        # What only looks like an entity, and has no plain spelling in this document, is none.
        alone = _entity(rng, KINDS[rng.integers(4)])[1]
        noise = (d(8), d(16), d(7), d(10), f"20{d(2)}-0{1 + rng.integers(9)}-1{d(1)}", f"{d(3)}.{d(3)}.{d(4)}", f"@{d(2)}x", alone, alone, alone)
        parts.append((noise[rng.integers(len(noise))], "none"))
    parts = [parts[i] for i in rng.permutation(len(parts))]
    fill = ("words between", "and more of the same kind here", "then", "no. of the")
    return "".join(f"{p} {' '.join(fill[i] for i in rng.integers(0, len(fill), rng.integers(1, 4)))} " for p, _ in parts), parts


@lru_cache(maxsize=1)
def trained() -> SkipChain:
    """Potentials learned by gradient descent on the pseudo-likelihood of made documents (fixed seed).

    A number that looks like personal data, but that no pattern supports anywhere in its
    document, is labelled none there, so clean documents stay as they are.
    """
    rng = np.random.default_rng(11)
    xs, ys, near = [], [], []
    for _ in range(1000):
        text, parts = _example(rng)
        base = base_spans(text)
        found = mentions(text, base)
        if not found:
            continue
        at, places = 0, []
        for p, kind in parts:
            at = text.index(p, at)
            places.append((at, at + len(p), kind))
            at += len(p)
        covered = covers(found, base)
        y = np.array([LABELS.index(c or next((k for s, e, k in places if s < b and e > a), "none")) for (a, b), c in zip(found, covered, strict=True)])
        around = np.zeros((len(found), 3, len(LABELS)))
        for which, pairs in enumerate(edges(text, found)):
            for i, j in pairs:
                around[i, which, y[j]] += 1
                around[j, which, y[i]] += 1
        xs.append(np.array([node_features(text[a:b], c) for (a, b), c in zip(found, covered, strict=True)]))
        ys.append(y)
        near.append(around)
    x, y, around = np.concatenate(xs), np.concatenate(ys), np.concatenate(near)
    k = len(LABELS)
    unary, pair = np.zeros((x.shape[1], k)), np.zeros((3, k, k))
    want = np.eye(k)[y]
    for step in range(1000):
        z = x @ unary + sum(around[:, side] @ pair[side] for side in range(3))
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g, rate = (p - want) / len(x), 4.0 / (1 + step / 500)
        unary -= rate * (x.T @ g + 1e-4 * unary)
        for side in range(3):
            half = around[:, side].T @ g + 1e-4 * pair[side]
            pair[side] -= rate * (half + half.T) / 2
    return SkipChain(unary, *pair)


def covers(found: list[tuple[int, int]], base: list[Span]) -> list[str | None]:
    """For each mention the kind of the first base span that it overlaps; both lists ascend."""
    ends = np.maximum.accumulate(np.array([e for _, e, _ in base], int)) if base else np.empty(0, int)
    out = []
    for a, b in found:
        k = int(np.searchsorted(ends, a, side="right"))
        while k < len(base) and base[k][0] < b and base[k][1] <= a:
            k += 1
        out.append(base[k][2] if k < len(base) and base[k][0] < b else None)
    return out


def added_spans(text: str, base: list[Span], model: SkipChain, sure: float = 0.9) -> list[Span]:
    """Mentions that the field labels with at least this probability and that no base span overlaps."""
    found = mentions(text, base)
    if not found:
        return []
    covered = covers(found, base)
    x = np.array([node_features(text[a:b], c) for (a, b), c in zip(found, covered, strict=True)])
    p = model.marginals(x, *edges(text, found))
    out = []
    for (a, b), c, row in zip(found, covered, p, strict=True):
        best = int(row.argmax())
        if c is None and best and row[best] >= sure:
            out.append((a, b, LABELS[best]))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def find_personal_data(df: DataFrame, text: str = "text", key: str = "doc_id", sure: float = 0.9) -> DataFrame:
    """``key``, numbers of base spans by kind, ``base_sha256`` of them, and all ``spans`` of each whole text.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and kind. Null
    texts are empty texts: no spans, the digest of nothing. One row a row.
    """
    model = trained()

    def start():
        def apply(x: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
            for text in x["text"]:
                base = base_spans(text or "")
                for k in KINDS:
                    out[f"n_{k}"].append(sum(s[2] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(base + added_spans(text or "", base, model, sure)))
            return out | {"key": x["key"]}

        return apply

    rows = pick(df, key=key, text=text)
    kind = rows.schema["key"].dataType.simpleString()
    return map_rows(rows, f"key {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string", start).withColumnRenamed("key", key)


def redact(df: DataFrame, text: str = "text", key: str = "doc_id", sure: float = 0.9) -> DataFrame:
    """The table with each span of each text replaced by its kind in brackets, as ``[EMAIL]``; of overlapping spans the first.

    All other columns stay; a null text stays null. A column ``n_chars``, where the table has it, is counted anew.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.types import StringType

    model = trained()

    def clean(texts):
        import pandas as pd

        out = []
        for t in texts:
            if t is not None:
                base = base_spans(t)
                parts, at = [], 0
                for a, b, k in sorted(base + added_spans(t, base, model, sure), key=lambda s: (s[0], -s[1])):
                    if a >= at:
                        parts += [t[at:a], f"[{k.upper()}]"]
                        at = b
                    elif b > at:
                        at = b
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pd.Series(out, dtype=object)

    plain, at = numbered(df)
    # The udf is not asked twice for one text.
    done = plain.withColumn(at(text), F.pandas_udf(clean, StringType()).asNondeterministic()(F.col(at(text))))
    if "n_chars" in df.columns:
        done = done.withColumn(at("n_chars"), F.length(at(text)).cast(plain.schema[at("n_chars")].dataType))
    return done.toDF(*df.columns)
