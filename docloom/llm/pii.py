"""Personal data by a semi-Markov conditional random field over whole spans.

Fixed patterns give the base spans. The random field adds the spans that are written otherwise
(numbers without a plus, other separators, masked at signs). It cuts an island of text, a run of
words with digits or an at sign, into segments: single tokens outside of anything, or entities of up to
MAX_TOKENS tokens. A segment's score adds the weights of features of the whole span and of its
neighbours; dynamic programming finds the best cut and types together. Weights are fitted here by
stochastic gradient ascent on islands whose segments the base spans tell.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.samples import share_of

KINDS = ["email", "ip", "card", "phone"]
OUTSIDE = len(KINDS)
MAX_TOKENS = 20
MAX_DIGITS = 19
ISLAND_CHARS = 400  # islands above are not learnt from
SPAN = "array<struct<kind: string, start: int, end: int, is_base: boolean>>"

Span = tuple[int, int, int]  # kind, start, end in code points

# Possessive runs that begin at the first character of a run: linear, also in one-character texts.
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local@host: the local part is what stands before the sign, back to the last match."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield 0, start, host.end()
        free = host.end() if host else at + 1
        at = text.find("@", free)


def _small_parts(ip: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in ip.split("."))


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns that pass their checks, by kind, then start; kinds may overlap each other."""
    found = list(_emails(text))
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _small_parts(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _DIGITS.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m.group())) <= 15]
    return found


# --- islands and their segments --------------------------------------------------------

_SIGNS = re.compile(r"[0-9@]|[\[(]at[\])]")
_CHUNK = re.compile(r"\S*")
_TOKENS = re.compile(r"[\[(](?:at|dot)[\])]|[A-Za-z]+|[0-9]+|.", re.S)


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Runs of words that hold a digit or an at sign, one space apart. Entities lie inside of them."""
    first = last = -1
    sign = _SIGNS.search(text)
    while sign:
        start, floor = sign.start(), max(last, 0)
        while start > floor and not text[start - 1].isspace():
            start -= 1
        end = _CHUNK.match(text, sign.end()).end()
        if start - last == 1 and last >= 0 and text[last] == " ":
            last = end
        else:
            if first >= 0:
                yield first, last
            first, last = start, end
        sign = _SIGNS.search(text, end)
    if first >= 0:
        yield first, last


def tokens_of(island: str) -> tuple[list[str], list[int]]:
    """Tokens and their bounds: runs of letters, of digits, masked at signs and dots, single others."""
    tokens = _TOKENS.findall(island)
    bounds = [0]
    for t in tokens:
        bounds.append(bounds[-1] + len(t))
    return tokens, bounds


def _role(token: str) -> str:
    if token[0].isdigit() and token.isascii():
        return "d"
    if token[0].isalpha() and token.isascii():
        return "a"
    return "@" if token[1:3] == "at" else "." if token[1:4] == "dot" else token if token.isascii() else "u"


def segments(roles: list[str], tokens: list[str]) -> Iterator[tuple[int, int]]:
    """Token ranges that can be an entity.

    They begin with a letter, digit, plus or bracket, end with a letter, digit or bracket, hold a
    digit group or one at sign, letters only beside an at sign, MAX_DIGITS digits at most where there is
    none, and no two spaces in a row.
    """
    n = len(tokens)
    for i in range(n):
        if roles[i] not in "ad+(":
            continue
        signs = letters = digits = 0
        for j in range(i, min(n, i + MAX_TOKENS)):
            r = roles[j]
            if r in "@a":
                signs += r == "@"
                letters += r == "a"
                if signs > 1:
                    break
            elif r == "d":
                digits += len(tokens[j])
                if digits > MAX_DIGITS and not signs and not letters:
                    break
            elif r == " ":
                if letters or signs or tokens[j - 1] == " ":
                    break
            elif r not in ".+-()/_%:":
                break
            if r in "ad)" and (signs and j > i or digits and not letters and not signs):
                yield i, j + 1


def _shape(roles: list[str], tokens: list[str], i: int, j: int) -> str:
    """The span with each run of digits as its length and each run of letters as one sign."""
    return "".join(f"{len(tokens[t])}" if roles[t] == "d" else "a" if roles[t] == "a" else roles[t] for t in range(i, j))


def features(roles: list[str], tokens: list[str], i: int, j: int) -> tuple[str, ...]:
    """Names of what holds for the span of tokens i to j as a whole, and beside it."""
    span, n = roles[i:j], len(tokens)
    before = roles[i - 1] if i else "^"
    after = roles[j] if j < n else "$"
    inner = "".join(sorted(set(span)))
    if "@" in span:
        at = span.index("@")
        dots = min(span[at:].count("."), 3)
        left = span[at - 1] if at else "^"
        return (
            "sign", f"dots:{dots}", f"ends:{span[0]}{span[-1]}", f"left:{left}", f"before:{before}@", f"after:{after}@",
            f"masked:{len(tokens[i + at]) > 1}", f"odd:{bool(set(inner) - set('@.ad-_+%'))}", f"long:{len(tokens[j - 1]) >= 2}",
        )
    groups = [tokens[t] for t in range(i, j) if roles[t] == "d"]
    digits = "".join(groups)
    between = "".join(sorted(set(span) - {"d"}))
    small = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    checked = 13 <= len(digits) <= 19 and luhn(digits)
    shape = _shape(roles, tokens, i, j)
    beyond = (j + 1 < n and after in ".- " and roles[j + 1] == "d") + 2 * (i > 1 and before in ".- " and roles[i - 2] == "d")
    return (
        "digits", f"n:{min(len(digits), 20)}", f"groups:{min(len(groups), 7)}", f"between:{between}", f"octets:{small}:{between}",
        f"luhn:{checked}", f"shape:{shape}" if len(shape) <= 16 else "shape", f"first:{span[0]}", f"before:{before}",
        f"after:{after}", f"beyond:{beyond}", f"luhn:{checked}:{between}:{before}{after}",
    )


@dataclass
class Model:
    names: dict[str, int]
    weights: np.ndarray  # feature x kind
    moves: np.ndarray  # from kind or outside, to kind or outside

    def __post_init__(self):
        self.known: dict[tuple[str, ...], list[float]] = {}

    def scores(self, names: tuple[str, ...]) -> list[float]:
        """The weights of a span for each kind; kept for spans of the same features, up to a fixed number."""
        found = self.known.get(names)
        if found is None:
            rows = [self.names[x] for x in names if x in self.names]
            found = self.weights[rows].sum(axis=0).tolist()
            if len(self.known) >= 100_000:
                self.known.clear()
            self.known[names] = found
        return found


def decode(text: str, model: Model, start: int = 0, end: int | None = None) -> list[Span]:
    """The best cut of one island into outside tokens and entities: kinds and places of the entities.

    Scores of the last MAX_TOKENS places are held, and one step back for each place and kind.
    """
    tokens, bounds = tokens_of(text[start:end])
    roles = [_role(t) for t in tokens]
    moves, n, states = model.moves.tolist(), len(tokens), len(KINDS) + 1
    best: list[list[float] | None] = [None] * (MAX_TOKENS + 1)  # ring of places
    best[0] = [-1e300] * OUTSIDE + [0.0]
    pending: dict[int, list[tuple[int, list[float]]]] = {}
    steps = array("q", bytes(8 * states))  # length and previous kind of the segment that ends here
    ahead = segments(roles, tokens)
    item = next(ahead, None)
    for j in range(1, n + 1):
        while item is not None and item[0] == j - 1:  # segments that begin where the last place ended
            i, e = item
            pending.setdefault(e, []).append((i, model.scores(features(roles, tokens, i, e))))
            item = next(ahead, None)
        here, step = [-1e300] * states, [0] * states
        before = best[(j - 1) % (MAX_TOKENS + 1)]
        for p in range(states):
            value = before[p] + moves[p][OUTSIDE]
            if value > here[OUTSIDE]:
                here[OUTSIDE], step[OUTSIDE] = value, states + p
        for i, scores in pending.pop(j, ()):
            before = best[i % (MAX_TOKENS + 1)]
            for p in range(states):
                if before[p] > -1e299:
                    for y in range(OUTSIDE):
                        value = before[p] + moves[p][y] + scores[y]
                        if value > here[y]:
                            here[y], step[y] = value, (j - i) * states + p
        best[j % (MAX_TOKENS + 1)] = here
        steps.extend(step)
    last = best[n % (MAX_TOKENS + 1)]
    y, j, found = max(range(states), key=last.__getitem__), n, []
    while j > 0:
        size, p = divmod(steps[j * states + y], states)
        if y != OUTSIDE:
            found.append((y, start + bounds[j - size], start + bounds[j]))
        j, y = j - size, p
    return found[::-1]


def spans(text: str | None, model: Model) -> list[tuple[int, int, int, bool]]:
    """Base spans, and the random field's spans that overlap none of them; by kind, then start."""
    if not text:
        return []
    base = base_spans(text)
    found = [(*s, True) for s in base]
    taken = sorted((a, b) for _, a, b in base)
    at = 0
    for first, last in islands(text):
        for kind, a, b in decode(text, model, first, last):
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if all(x >= b or y <= a for x, y in _near(taken, at, b)):
                found.append((kind, a, b, False))
    return sorted(found)


def _near(taken: list[tuple[int, int]], at: int, end: int) -> Iterator[tuple[int, int]]:
    while at < len(taken) and taken[at][0] < end:
        yield taken[at]
        at += 1


# --- fitting ------------------------------------------------------------------------------


def _rewritten(text: str, labelled: list[Span], ways: dict, keep: bool) -> tuple[str, list[Span]] | None:
    """The island with the entities of some kinds written otherwise, and its labels: these kinds stay or become outside."""
    out, moved, done, length = [], [], 0, 0
    for kind, a, b in sorted(labelled, key=lambda s: s[1]):
        if a < done:
            return None  # overlapping entities are left as they are
        new = ways[kind](text[a:b]) if kind in ways else text[a:b]
        length += a - done
        if keep or kind not in ways:
            moved.append((kind, length, length + len(new)))
        length += len(new)
        out += [text[done:a], new]
        done = b
    return "".join([*out, text[done:]]), moved


def variants(text: str, labelled: list[Span]) -> Iterator[tuple[str, list[Span]]]:
    """The island; e-mails and phones in it as the patterns miss them; cards and addresses that fail their checks, as outside."""
    yield text, labelled
    masked = {0: lambda s: s.replace("@", "[at]"), 3: lambda s: re.sub(r"^\+[0-9]{1,3}[ .-]?", "", s)}
    spelt = {0: lambda s: s.replace("@", "(at)").replace(".", "(dot)"), 3: lambda s: re.sub(r"[ ()]+", "-", s.lstrip("+")).strip("-")}
    wrong = {1: lambda s: s[: s.rindex(".") + 1] + str(256 + len(s) * 37 % 700), 2: lambda s: s[:-1] + str((int(s[-1]) + 1) % 10)}
    kinds = {kind for kind, _, _ in labelled}
    for ways, keep in ((masked, True), (spelt, True), (wrong, False)):
        if kinds & set(ways) and (made := _rewritten(text, labelled, ways, keep)):
            yield made


@dataclass
class Lattice:
    """One island ready for fitting: its segments with feature numbers, and which of them are right."""

    n: int
    ends: dict[int, list[tuple[int, np.ndarray]]]
    right: list[tuple[int, int, int]]  # begin, end, kind; outside tokens included


def lattice(text: str, labelled: list[Span], names: dict[str, int]) -> Lattice | None:
    """None where an entity is not a segment, for example because it overlaps another."""
    tokens, bounds = tokens_of(text)
    roles = [_role(t) for t in tokens]
    place = {b: k for k, b in enumerate(bounds)}
    ends: dict[int, list[tuple[int, np.ndarray]]] = {}
    known = set()
    for i, j in segments(roles, tokens):
        rows = [names.setdefault(x, len(names)) for x in features(roles, tokens, i, j)]
        ends.setdefault(j, []).append((i, np.array(rows)))
        known.add((i, j))
    right, at = [], 0
    for kind, a, b in sorted(labelled, key=lambda s: s[1]):
        i, j = place.get(a, -1), place.get(b, -1)
        if i < at or (i, j) not in known:
            return None
        right += [(t, t + 1, OUTSIDE) for t in range(at, i)] + [(i, j, kind)]
        at = j
    return Lattice(len(tokens), ends, right + [(t, t + 1, OUTSIDE) for t in range(at, len(tokens))])


def _gradient(lat: Lattice, weights: np.ndarray, moves: np.ndarray, into: np.ndarray, into_moves: np.ndarray) -> None:
    """Adds right minus expected counts of features and moves: the gradient of the island's log likelihood."""
    states = OUTSIDE + 1
    scores = {j: [(i, rows, weights[rows].sum(axis=0)) for i, rows in found] for j, found in lat.ends.items()}
    outward, within = moves[:, OUTSIDE], moves[:, :OUTSIDE]
    alpha = np.full((lat.n + 1, states), -np.inf)
    alpha[0, OUTSIDE] = 0.0
    for j in range(1, lat.n + 1):
        alpha[j, OUTSIDE] = np.logaddexp.reduce(alpha[j - 1] + outward)
        for i, _, s in scores.get(j, ()):
            reach = np.logaddexp.reduce(alpha[i][:, None] + within, axis=0) + s
            alpha[j, :OUTSIDE] = np.logaddexp(alpha[j, :OUTSIDE], reach)
    beta = np.full((lat.n + 1, states), -np.inf)
    beta[lat.n] = 0.0
    total = np.logaddexp.reduce(alpha[lat.n])
    for j in range(lat.n, 0, -1):
        flow = moves[:, OUTSIDE] + beta[j, OUTSIDE]
        into_moves[:, OUTSIDE] -= np.exp(alpha[j - 1] + flow - total)
        beta[j - 1] = np.logaddexp(beta[j - 1], flow)
        for i, rows, s in scores.get(j, ()):
            flow = within + (s + beta[j, :OUTSIDE])[None, :]
            chance = np.exp(alpha[i][:, None] + flow - total)
            into_moves[:, :OUTSIDE] -= chance
            into[rows] -= chance.sum(axis=0)
            beta[i] = np.logaddexp(beta[i], np.logaddexp.reduce(flow, axis=1))
    before = OUTSIDE
    by_place = {(i, j): rows for j, found in lat.ends.items() for i, rows in found}
    for i, j, kind in lat.right:
        into_moves[before, kind] += 1
        if kind != OUTSIDE:
            into[by_place[i, j], kind] += 1
        before = kind


def fit(rows: list[tuple[str, list[Span]]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """A model of labelled islands, by stochastic gradient ascent with a step size for each weight."""
    names: dict[str, int] = {}
    lattices = [lat for t, s in rows for u, v in variants(t, s) if (lat := lattice(u, v, names)) and lat.ends]
    shape, states = (max(len(names), 1), len(KINDS)), OUTSIDE + 1
    weights, moves = np.zeros(shape), np.zeros((states, states))
    moves[:, :OUTSIDE] = -1.0  # an entity needs evidence
    seen, seen_moves = np.full(shape, 1e-8), np.full((states, states), 1e-8)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for at in order.permutation(len(lattices)):
            lat = lattices[at]
            used = np.unique(np.concatenate([rows for found in lat.ends.values() for _, rows in found]))
            step, step_moves = np.zeros(shape), np.zeros((states, states))
            _gradient(lat, weights, moves, step, step_moves)
            g = step[used] - decay * weights[used]
            seen[used] += g * g
            weights[used] += rate * g / np.sqrt(seen[used])
            g = step_moves - decay * moves
            seen_moves += g * g
            moves += rate * g / np.sqrt(seen_moves)
    return Model(names, weights, moves)


def labelled_islands(text: str | None) -> list[tuple[str, str, str]]:
    """Island, its base spans as text (kind:start:end), and the kinds in it; of islands up to ISLAND_CHARS."""
    if not text:
        return []
    base, found = sorted(base_spans(text), key=lambda s: s[1]), []
    for a, b in islands(text):
        while base and base[0][1] < a:
            base.pop(0)
        inside = []
        while base and base[0][1] < b:
            inside.append(base.pop(0))
        if b - a <= ISLAND_CHARS and all(e <= b for _, _, e in inside):
            kinds = ",".join(KINDS[k] for k in sorted({k for k, _, _ in inside}))
            found.append((text[a:b], ",".join(f"{k}:{s - a}:{e - a}" for k, s, e in inside), kinds))
    return found


def train(docs: DataFrame, sample_docs: int = 20_000, per_kind: int = 250) -> Model:
    """A model of the base spans in a sample of docs (doc_id, text).

    About sample_docs rows are chosen by hash. Of their different islands at most per_kind of each set
    of kinds (sixteen sets) reach the driver, chosen by hash too. Whole islands are learnt from, none above
    ISLAND_CHARS. Without islands the model adds nothing.
    """
    n = docs.count()
    chosen = docs.filter(share_of(F.struct("doc_id", "text"), n, sample_docs)).select("text")
    kind = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("island", "spans", "kinds")]))

    @F.pandas_udf(kind)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("island", "spans", "kinds"), x, strict=True)) for x in labelled_islands(t)] for t in texts])

    different = chosen.select(F.explode(found("text")).alias("i")).select("i.*").distinct()
    order = Window.partitionBy("kinds").orderBy(F.xxhash64("island"), "island")
    few = different.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_kind)
    rows = few.select("island", "spans").orderBy("island").collect()  # sixteen times per_kind rows
    read = lambda s: [tuple(map(int, x.split(":"))) for x in s.split(",") if x]
    return fit([(r["island"], read(r["spans"])) for r in rows])


def personal_data(text: Column, model: Model, spark) -> Column:
    """Spans of each whole text (kind, start, end in code points, is_base), by kind as listed, then start.

    Null and empty texts have none. Base spans always stay, also where kinds overlap. The model is
    broadcast; its size is bounded by the sample it was fitted on.
    """
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf(SPAN)
    def of_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = held.value
        for texts in batches:
            yield pd.Series(
                [[{"kind": KINDS[k], "start": a, "end": b, "is_base": own} for k, a, b, own in spans(t, known)] for t in texts]
            )

    return of_texts(text)
