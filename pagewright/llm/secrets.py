"""Secret scans by patterns and a linear-chain conditional random field.

The patterns of three kinds are always reported. The random field tags the pieces of a
text as secret begin, inside or outside (B, I, O), from their shapes, the neighbouring
words and features of the whole file, and decodes with Viterbi; what it finds beside
the patterns' matches is reported as kind ``crf``.

Ordinary words (letters in one of the usual cases, short numbers, punctuation) are
constrained to O. A path through a constrained piece splits there, so decoding the runs
between ordinary words gives the same path as decoding the whole text.

The weights are trained in numpy, by gradient descent on the likelihood, on lines made
from templates with a fixed seed: they depend neither on the corpus nor on its size.
"""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_column

#: Fixed patterns and least lengths of the base kinds, in the order of the report.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "crf")
#: One of these is in every lower-cased text that ASSIGN matches.
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: A longer word isn't ordinary; it is below every least length of a bare match.
ORDINARY = 20
PLAIN = re.compile(r"[\W_]*(?:(?P<word>[^\W\d_]+(?:['’-][^\W\d_]+)*)|\d{1,8}(?:[.,:/-]\d{1,8}){0,3})?[\W_]*")
PIECE = re.compile(r"[A-Za-z0-9+/_-]+|[^\sA-Za-z0-9+/_-]")
WORD = re.compile(r"[a-z_]+")
CACHE = 200_000
#: Hashed features, tags, and the training's lines, steps and rate.
SLOTS, B, I, O = 1 << 15, 0, 1, 2  # noqa: E741
LINES, EPOCHS, RATE, SEED, LONGEST = 3000, 8, 0.2, 11, 32
#: A decoded span has at least this many characters, and at least one digit or both cases.
LEAST_CRF = 12


def ordinary(token: str) -> bool:
    """Whether a token between white space is constrained to O."""
    if len(token) >= ORDINARY:
        return False
    found = PLAIN.fullmatch(token)
    if not found:
        return False
    word = found["word"]
    return word is None or word.islower() or word.isupper() or word[1:].islower() or "-" in word or "'" in word or "’" in word


def base_spans(text: str, bare: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds' matches; ``bare`` off skips access and hex."""
    spans = []
    low = text.lower()
    if any(h in low for h in HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if bare:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(spans)


@lru_cache(100_000)
def shape(piece: str) -> tuple[str, ...]:
    """Features of a piece alone."""
    n = len(piece)
    lower = sum(c in string.ascii_lowercase for c in piece)
    upper = sum(c in string.ascii_uppercase for c in piece)
    digit = sum(c in string.digits for c in piece)
    size = next((i for i, most in enumerate((1, 3, 7, 11, 15, 19, 31, 47)) if n <= most), 8)
    kinds = f"{int(lower > 0)}{int(upper > 0)}{int(digit > 0)}{int(lower + upper + digit < n)}"
    turns = sum((a.isdigit() != b.isdigit()) or (a.isupper() != b.isupper()) for a, b in zip(piece, piece[1:], strict=False))
    mixed = min(4, turns * 8 // n)
    variety = min(9, len(set(piece)) * 10 // n) if n > 3 else -1
    word = f"w={piece.lower()}" if n <= 3 or not digit else "w=*"
    return ("bias", f"n={size}", f"k={kinds}", f"nk={size},{kinds}", f"m={mixed},{size}", f"v={variety},{size}", f"p={piece[:3]}", word)


def slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (SLOTS - 1)


@lru_cache(200_000)
def slots_of(features: tuple[str, ...]) -> tuple[int, ...]:
    return tuple(slot(f) for f in features)


def features(pieces: list[str], before: list[str], file: str) -> list[tuple[int, ...]]:
    """Slots for each piece of a run; ``before``: the words ahead of it, nearest last."""
    out, words = [], [w.lower() for w in before[-2:]]
    for i, piece in enumerate(pieces):
        near = words[-1] if words else "^"
        far = words[-2] if len(words) > 1 else "^"
        last = pieces[i - 1][:12] if i else "^"
        after = pieces[i + 1][:1] if i + 1 < len(pieces) else "$"
        own = shape(piece)
        out.append(
            slots_of(own) + slots_of((f"b={near}", f"bb={far}", f"l={last if len(last) < 2 else '*'}", f"a={after}", f"{own[3]},b={near}", f"{own[1]},f={file}"))
        )
        if found := WORD.findall(piece.lower()):
            if piece.isalpha() or "_" in piece or "-" in piece:
                words.append(found[-1].strip("_"))
    return out


def file_features(text: str) -> str:
    """A coarse class of the whole text: its length and how much looks like code."""
    n = len(text)
    code = sum(text.count(c) for c in "{};=<>") * 100 // max(1, n)
    return f"{min(6, n.bit_length() // 3)},{min(3, code)}"


def made_lines() -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with secrets and without, and the secrets' spans."""
    rng = np.random.default_rng(SEED)
    pick = lambda x: x[int(rng.integers(len(x)))]
    word = lambda: "".join(pick("bcdfglmnprst") + pick("aeiou") for _ in range(int(rng.integers(1, 5)))) + pick(["", "n", "s", "tion"])
    some = lambda alphabet, low, high: "".join(pick(alphabet) for _ in range(int(rng.integers(low, high + 1))))
    every = string.ascii_letters + string.digits
    secret = (
        lambda: some(every, 16, 48), lambda: some(every + "+/", 20, 64), lambda: some(every + "_-", 20, 44),
        lambda: some("0123456789abcdef", 24, 64), lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16, 16),
        lambda: pick(["ghp_", "gho_", "sk_live_", "sk-", "xoxb-", "glpat-", "pk_test_"]) + some(every, 20, 40),
        lambda: "eyJ" + some(every, 16, 30) + "." + some(every, 20, 40) + "." + some(every + "_-", 20, 40),
        lambda: some(string.ascii_lowercase + string.digits, 16, 32), lambda: some(string.ascii_uppercase + string.digits, 16, 32),
    )
    name = lambda: pick(["pwd", "pass", "auth", "auth_key", "access_key", "client_secret", "private_key", "bearer", "credential", "key", "api_key", "token", "secret", "password", "sig"])
    clean = (
        lambda: f"{word()} {int(rng.integers(1, 10**6))} {word()}", lambda: f"https://{word()}.{pick(['com', 'org', 'net'])}/{word()}/{int(rng.integers(9999))}?{word()}={word()}",
        lambda: f"{word()}.{word()}@{word()}.com", lambda: f"20{some(string.digits, 2, 2)}-{some('01', 1, 1)}{some('12', 1, 1)}-{some('012', 1, 1)}{some('123', 1, 1)}T10:{some('012345', 2, 2)}:00Z",
        lambda: f"v{int(rng.integers(9))}.{int(rng.integers(20))}.{int(rng.integers(20))}", lambda: f"+{some(string.digits, 1, 2)} {some(string.digits, 3, 3)}-{some(string.digits, 3, 3)}-{some(string.digits, 4, 4)}",
        lambda: word() + word().capitalize() + word().capitalize(), lambda: f"{word()}_{word()}={word()}", lambda: f"{word()}-{word()}-{word()}-{word()}-{word()}", lambda: word() * 4,
        lambda: "".join(word() for _ in range(6)), lambda: "/".join(word() for _ in range(5)) + ".py", lambda: f"{word().upper()}!!{word().upper()}!!", lambda: f"|{word()}|{word()}|", lambda: some(string.digits, 9, 19),
        lambda: f"{name()}={word()}", lambda: f"192.168.{int(rng.integers(255))}.{int(rng.integers(255))}", lambda: f"{word()}{int(rng.integers(99))}", lambda: "-".join(some(string.digits, 4, 4) for _ in range(4)),
    )
    out = []
    for _ in range(LINES):
        line, spans = " ".join(word() for _ in range(int(rng.integers(3)))), []
        for _ in range(int(rng.integers(1, 4))):
            line += pick([" ", ". ", ", ", "\n"])
            if rng.random() < 0.45:
                q = pick(["", "", '"', "'"])
                line += pick([f"{name()}={q}", f"{name()}: {q}", f"{name()} {q}", f"{name().upper()}={q}", f"{q}{name()}{q}: {q}", f"Authorization: Bearer {q}", f"{word()} {q}", f"{q}"])
                value = pick(secret)()
                spans.append((len(line), len(line) + len(value)))
                line += value + q + pick(["", "", ",", ";", "."])
            else:
                line += pick(clean)()
            line += " " + word()
        out.append((line, spans))
    return out


def runs(text: str, odd: set[str]) -> list[tuple[list[tuple[int, int]], list[str]]]:
    """Runs of tokens that aren't ordinary: the spans of their pieces, and the two words ahead."""
    out: list[tuple[list[tuple[int, int]], list[str]]] = []
    before: list[str] = []
    inside = False
    for m in re.finditer(r"\S+", text):
        token = m[0]
        if token in odd:
            if not inside:
                out.append(([], before[-2:]))
                inside = True
            at = m.start()
            out[-1][0].extend((at + p.start(), at + p.end()) for p in PIECE.finditer(token))
        else:
            inside = False
        before = [*before[-1:], token.strip(string.punctuation)]
    return out


@lru_cache(1)
def train() -> tuple[np.ndarray, np.ndarray]:
    """Weights (SLOTS, 3) and transitions (3, 3), by AdaGrad on the log-likelihood of made lines."""
    sequences = []
    for line, spans in made_lines():
        odd = {t for t in line.split() if not ordinary(t)}
        for places, before in runs(line, odd):
            places = places[:LONGEST]
            tags = [O] * len(places)
            for a, b in spans:
                own = [i for i, (s, e) in enumerate(places) if s < b and e > a]
                for i in own:
                    tags[i] = I if i != own[0] else B
            sequences.append((features([line[a:b] for a, b in places], before, file_features(line)), tags))
    width = max(len(f) for s, _ in sequences for f in s)
    n = len(sequences)
    feats, tags, mask = np.zeros((n, LONGEST, width), np.int64), np.full((n, LONGEST), O), np.zeros((n, LONGEST), bool)
    for i, (f, t) in enumerate(sequences):
        feats[i, : len(f)], tags[i, : len(t)], mask[i, : len(f)] = f, t, True
    w, trans = np.zeros((SLOTS, 3)), np.zeros((3, 3))
    forbidden = np.zeros((3, 3))
    forbidden[O, I] = -1e4
    gw, gt = np.full((SLOTS, 3), 1e-4), np.full((3, 3), 1e-4)
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, 128):
            pick = order[at : at + 128]
            f, y, live = feats[pick], tags[pick], mask[pick]
            length = int(live.sum(1).max())
            f, y, live = f[:, :length], y[:, :length], live[:, :length]
            emit = w[f].sum(2)
            emit[:, 0, I] -= 1e4
            t = trans + forbidden
            alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
            alpha[:, 0] = emit[:, 0]
            for k in range(1, length):
                step = np.logaddexp.reduce(alpha[:, k - 1, :, None] + t, axis=1) + emit[:, k]
                alpha[:, k] = np.where(live[:, k, None], step, alpha[:, k - 1])
            for k in range(length - 2, -1, -1):
                step = np.logaddexp.reduce(t + (emit[:, k + 1] + beta[:, k + 1])[:, None, :], axis=2)
                beta[:, k] = np.where(live[:, k + 1, None], step, 0)
            z = np.logaddexp.reduce(alpha[:, -1], axis=1)
            p = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
            error = p - (np.eye(3)[y] * live[:, :, None])
            grad = np.zeros_like(w)
            np.add.at(grad, f.reshape(-1, width), np.repeat(error.reshape(-1, 1, 3), width, 1) / len(pick))
            pair = np.zeros((3, 3))
            for k in range(1, length):
                both = alpha[:, k - 1, :, None] + t + (emit[:, k] + beta[:, k])[:, None, :] - z[:, None, None]
                pair += (np.exp(np.minimum(both, 0)) * live[:, k, None, None]).sum(0)
                np.add.at(pair, (y[:, k - 1][live[:, k]], y[:, k][live[:, k]]), -1)
            pair /= len(pick)
            grad += 1e-5 * w
            gw += grad**2
            gt += pair**2
            w -= RATE * grad / np.sqrt(gw)
            trans -= RATE * pair / np.sqrt(gt)
    return w, trans + forbidden


def viterbi(emit: np.ndarray, trans: np.ndarray) -> list[int]:
    """The best tags of a run whose neighbours are outside."""
    score = (emit[0] + trans[O]).tolist()
    t = trans.tolist()
    back = []
    for e in emit[1:].tolist():
        best = [max((score[a] + t[a][b], a) for a in range(3)) for b in range(3)]
        back.append([x[1] for x in best])
        score = [x[0] + y for x, y in zip(best, e, strict=True)]
    end = [s + t[i][O] for i, s in enumerate(score)]
    tags = [end.index(max(end))]
    for b in reversed(back):
        tags.append(b[tags[-1]])
    return tags[::-1]


class Scanner:
    """Finds all spans of texts; keeps what it learned about frequent words."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray) -> None:
        self.weights, self.trans = weights, trans
        self.plain: set[str] = set()

    def odd(self, text: str) -> set[str]:
        """The text's tokens that aren't ordinary."""
        out = set()
        for token in set(text.split()) - self.plain:
            if not ordinary(token):
                out.add(token)
            elif len(self.plain) < CACHE:
                self.plain.add(token)
        return out

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) by start, then kind."""
        odd = self.odd(text)
        spans = base_spans(text, any(len(t) >= ORDINARY for t in odd))
        if odd:
            spans = sorted(spans + self.tagged(text, odd, spans))
        return spans

    def tagged(self, text: str, odd: set[str], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out, file = [], file_features(text)
        taken = sorted((a, b) for a, _, b in base)
        at = 0
        for places, before in runs(text, odd):
            if max((b - a for a, b in places), default=0) < 8:
                continue  # every piece is too short to begin a secret
            emit = self.weights[np.array(features([text[a:b] for a, b in places], before, file))].sum(1)
            tags = viterbi(emit, self.trans)
            found: list[list[int]] = []
            for (a, b), tag in zip(places, tags, strict=True):
                if tag == B or tag == I and not found:
                    found.append([a, b])
                elif tag == I:
                    found[-1][1] = b
            for a, b in found:
                value = text[a:b]
                if b - a < LEAST_CRF or not (any(c.isdigit() for c in value) or value.lower() != value != value.upper()):
                    continue
                while at < len(taken) and taken[at][1] <= a:
                    at += 1
                if not any(s < b and e > a for s, e in taken[max(0, at - 2) : at + 3]):
                    out.append((a, 3, b))
        return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id, counts of the base kinds, base_sha256, spans) for each row.

    A null text counts as empty and has no spans. Offsets are code points, ends are
    exclusive. Rows that repeat an id keep their own rows. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col), F.col(text_col).alias("a text"))
    model = train()

    def make():
        scanner = Scanner(*model)

        def of(batch: list) -> list[list]:
            found = [scanner.spans(t or "") for t in batch]
            base = [[s for s in f if s[1] < 3] for f in found]
            counts = [[sum(s[1] == k for s in b) for b in base] for k in range(3)]
            return [*counts, [hashlib.sha256(joined(b).encode()).hexdigest() for b in base], [joined(f) for f in found]]

        return of

    return by_column(texts, "a text", make, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of the text replaced by ``mark``. A null text stays null."""
    bounded_batches(docs.sparkSession)
    model = train()

    def clean(scanner: Scanner, text: str | None) -> str | None:
        if not text or not (spans := scanner.spans(text)):
            return text
        out, at = [], 0
        for a, _, b in spans:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches):
        import pyarrow as pa

        scanner = Scanner(*model)
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            done = pa.array([clean(scanner, t) for t in batch.column(i).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([done if k == i else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
