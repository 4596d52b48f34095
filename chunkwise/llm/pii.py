"""Personal data by a linear-chain conditional random field over word-shape features.

The field is trained here from a small labelled table and decoded by Viterbi in numpy, many sequences in lockstep. A token
may carry a label other than O only if it or one of its NEAR neighbours gives a hint: a digit of any script, an at sign, a
word that announces a secret before a colon or an equals sign, or a long run of small and capital letters; this is part of the model,
in training as in decoding. Hence a text falls apart, exactly, at its other tokens, and only the stretches between
them are decoded.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "SSN", "IBAN", "SECRET")
#: O, then B and I of each kind.
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
T = len(TAGS)
#: Rows of the labelled table, hashed features, passes of training, tokens on either side of a digit that may be labelled.
EXAMPLES, SLOTS, PASSES, NEAR, SEED = 1600, 1 << 15, 80, 2, 23
TOKEN = re.compile(r"[^\s,;|<>\"'!#$%&*={}\[\]`~^]+")
#: Letters of a run that is a hint if small ones are followed by capital ones.
LONG = 24
HINT = re.compile(rf"[\d@]|(?<![^\W_])(?:[Pp]ass(?:word|wd|phrase|code)?|PASS(?:WORD|WD)?|[Pp]wd|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Cc]redentials?|(?:[Aa]pi[_ -]?|API[_ -]?)?(?:[Kk]ey|KEY))(?=[\s\"']{{0,3}}[:=])|(?<![A-Za-z])(?=[A-Za-z]{{{LONG}}})[A-Za-z]*?[a-z][A-Z]")
LEAD, TAIL = "-.:/\\)?_", ".:?-/\\(_"
SCHEMA = "doc_id long, kind string, start_char int, end_char int"
SPANS = "text string, spans array<struct<start_char:int,end_char:int,kind:string>>"
_CLASSES = str.maketrans({c: "9" for c in "0123456789"} | {chr(c): "A" for c in range(65, 91)} | {chr(c): "a" for c in range(97, 123)})
_RUN, _DIGITS, _LETTERS = re.compile(r"(.)\1*", re.DOTALL), re.compile(r"[0-9]+"), re.compile(r"[^\W\d_]+")


def tokens(text: str) -> list[tuple[int, int]]:
    """Where tokens begin and end: what separators part, without marks at the edges."""
    out = []
    for m in TOKEN.finditer(text):
        a, b = m.span()
        if text[a : a + 7].lower() == "mailto:":
            a += 7
        while a < b and text[a] in LEAD:
            a += 1
        while a < b and text[b - 1] in TAIL:
            b -= 1
        if b - a > 6 and text[a] == "(" and text[b - 1] == ")":
            a, b = a + 1, b - 1
        if b > a and text[b - 1] == ")" and "(" not in text[a:b]:
            b -= 1
        if b > a and text[a] == "(" and ")" not in text[a:b]:
            a += 1
        if a < b:
            out.append((a, b))
    return out


def _describe(word: str) -> list[str]:
    """Shapes of one token."""
    shape = "".join("a" if c.isalpha() and c not in "aA" else c for c in word.translate(_CLASSES))
    short = _RUN.sub(r"\1", shape)
    runs = _RUN.sub(lambda m: f"{m[1]}{min(len(m[0]), 24)}" if m[1] == "9" else m[1], shape)
    digits = shape.count("9")
    hexed = len(word) >= 16 and all(c in "0123456789abcdefABCDEF" for c in word)
    return [
        f"s{short[:24]}", f"r{runs[:48]}", f"d{min(digits, 24)}{'@' * ('@' in word)}", f"n{len(word) if len(word) < 8 else 8 + min(len(word) // 8, 8)}",
        f"@{word.count('@')}.{'.' in word.rpartition('@')[2]}", f"h{hexed}{min(len(word) // 8, 8) if hexed else 0}",
        f"p{shape[:2]}", f"q{shape[-2:]}", f"o{len(parts) == 4 and all(int(p) < 256 for p in parts)}" if len(parts := _DIGITS.findall(word)) == 4 and all(len(p) < 4 for p in parts) and short.count(".") == 3 else "o-",
        f"m{short.count('.')}{short.count('-')}{'/' in short}{':' in short}{'+' in short}{'(' in short}", f"x{digits * 4 // max(len(word), 1)}",
    ]


def _gap(text: str, a: int, b: int) -> str:
    gap = text[max(a, b - 12) : b]
    return ("=" if "=" in gap or ":" in gap else "") + ('"' if '"' in gap or "'" in gap else "") + ("\n" if "\n" in gap else "") + ("," if "," in gap or ";" in gap else "") + (" " if " " in gap else "")


_slots: dict[str, int] = {}


def _slot(feature: str) -> int:
    k = _slots.get(feature)
    if k is None:
        if len(_slots) > 200_000:
            _slots.clear()
        k = _slots[feature] = zlib.crc32(feature.encode("utf-8", "surrogatepass")) % SLOTS
    return k


#: Features of a token; all have as many, so a sequence is a matrix.
WIDTH = 25


def features(text: str, spans: list[tuple[int, int]], first: int, last: int) -> np.ndarray:
    """A row of WIDTH slots for each of the tokens first to last."""
    around = {}
    for k in range(max(0, first - 2), min(len(spans), last + 3)):
        a, b = spans[k]
        around[k] = _describe(text[a:b])
    edge, rows = ["edge"] * 11, []
    for k in range(first, last + 1):
        a, b = spans[k]
        own, prev, after, far = around[k], around.get(k - 1, edge), around.get(k + 1, edge), around.get(k - 2, edge)
        word = lambda j: text[spans[j][0] : spans[j][1]].lower()[:14] if 0 <= j < len(spans) and not HINT.search(text, *spans[j]) else "9"
        left = _gap(text, spans[k - 1][1] if k else 0, a)
        right = _gap(text, b, spans[k + 1][0] if k + 1 < len(spans) else len(text))
        row = ["bias", *own, f"-1{prev[1]}", f"+1{after[1]}", f"-1{prev[0]}|{own[0]}", f"+1{after[0]}|{own[0]}", f"-2{far[1]}", f"-1{prev[1]}{own[1]}", f"+1{after[1]}{own[1]}", f"w-1{word(k - 1)}", f"w{word(k)}", f"w+1{word(k + 1)}", f"g{left}", f"G{right}", f"g{left}{own[5]}w{word(k - 1)}"]
        rows.append([_slot(f) for f in row])
    return np.array(rows, np.int32)


def stretches(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """First and last token of each run of tokens that may be labelled; the tokens beside a run are O."""
    ends, out = [b for _, b in spans], []
    for m in HINT.finditer(text):
        k = bisect_left(ends, m.start() + 1)
        if k == len(spans) or m.start() < spans[k][0]:
            continue
        a, b = max(0, k - NEAR), min(len(spans) - 1, k + NEAR)
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@dataclass
class Field:
    """Emission weights by slot and tag, and transition weights; a sequence begins and ends beside O."""

    emit: np.ndarray
    move: np.ndarray

    def unary(self, rows: np.ndarray) -> np.ndarray:
        return self.emit[rows].sum(axis=-2)

    def viterbi(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each sequence, in lockstep over those of similar lengths. Ties go to the lower tag."""
        out: list = [None] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        at = 0
        while at < len(order):
            long = len(sequences[order[min(at + 2047, len(order) - 1)]])
            some = order[at : at + max(1, min(2048, 200_000 // long))]
            at += len(some)
            lengths = np.array([len(sequences[i]) for i in some])
            wide = int(lengths.max())
            score = self.move[0] + self.unary(np.stack([sequences[i][0] for i in some]))
            back = np.zeros((wide, len(some), T), np.int8)
            for t in range(1, wide):
                live = np.flatnonzero(lengths > t)
                options = score[live][:, :, None] + self.move
                back[t, live] = options.argmax(axis=1)
                score[live] = options.max(axis=1) + self.unary(np.stack([sequences[some[i]][t] for i in live]))
            tag = (score + self.move[:, 0]).argmax(axis=1)
            paths = np.zeros((len(some), wide), np.int8)
            for t in range(wide - 1, -1, -1):
                live = lengths > t
                paths[live, t] = tag[live]
                tag = np.where(live, back[t, np.arange(len(some)), tag], tag)
            for j, i in enumerate(some):
                out[i] = paths[j, : lengths[j]]
        return out


def _legal() -> np.ndarray:
    """Moves that BIO allows: I only after B or I of its kind."""
    ok = np.ones((T, T), bool)
    for j, tag in enumerate(TAGS):
        if tag[0] == "I":
            ok[:, j] = [t[1:] == tag[1:] and t[0] in "BI" for t in TAGS]
    return ok


def _posteriors(u: np.ndarray, lengths: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of tags (sequence, position, tag), and expected moves, by forward and backward recursions in lockstep."""
    n, wide = u.shape[:2]
    e = np.exp(u - u.max(axis=2, keepdims=True))
    alpha, a = np.zeros_like(u), np.broadcast_to(w[0], (n, T))
    for t in range(wide):
        a = (a if t == 0 else a @ w) * e[:, t]
        a = alpha[:, t] = a / np.maximum(a.sum(axis=1, keepdims=True), 1e-300)
    beta, b = np.zeros_like(u), np.zeros((n, T))
    for t in range(wide - 1, -1, -1):
        b = np.where((lengths == t + 1)[:, None], w[:, 0], (b * e[:, t + 1]) @ w.T if t < wide - 1 else 0)
        b = beta[:, t] = b / np.maximum(b.max(axis=1, keepdims=True), 1e-300)
    p = alpha * beta
    p /= np.maximum(p.sum(axis=2, keepdims=True), 1e-300)
    moves = np.zeros((T, T))
    for t in range(1, wide):
        live = np.flatnonzero(lengths > t)
        ahead = e[live, t] * beta[live, t]
        total = np.maximum(((alpha[live, t - 1] @ w) * ahead).sum(axis=1, keepdims=True), 1e-300)
        moves += w * (alpha[live, t - 1].T @ (ahead / total))
    moves[0] += p[:, 0].sum(axis=0)
    moves[:, 0] += p[np.arange(n), lengths - 1].sum(axis=0)
    return p, moves


def train(sequences: list[np.ndarray], tags: list[np.ndarray], passes: int = PASSES, penalty: float = 0.02) -> Field:
    """Maximum likelihood by Adam on all sequences at once, those of like lengths in lockstep."""
    legal = _legal()
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
    sequences, tags = [sequences[i] for i in order], [tags[i] for i in order]
    lengths, edges = np.array([len(s) for s in sequences]), [0]
    for i, n in enumerate(lengths):
        if n > 1.5 * lengths[edges[-1]] + 2:
            edges.append(i)
    groups = [(a, b, np.arange(lengths[b - 1]) < lengths[a:b, None]) for a, b in zip(edges, [*edges[1:], len(sequences)])]
    starts = np.concatenate(([0], np.cumsum(lengths)))
    used, rows = np.unique(np.concatenate(sequences), return_inverse=True)
    rows, seen = rows.reshape(-1, WIDTH), np.concatenate(tags)
    emit, move = np.zeros((len(used), T)), np.zeros((T, T))
    gold_move, gold = np.zeros((T, T)), np.zeros((len(used), T))
    before = np.concatenate(([0], seen[:-1]))
    before[starts[:-1]] = 0
    np.add.at(gold_move, (before, seen), 1)
    np.add.at(gold_move, (seen[starts[1:] - 1], 0), 1)
    np.add.at(gold, (rows.ravel(), np.repeat(seen, WIDTH)), 1)
    state = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(move), np.zeros_like(move)]
    by_slot = np.argsort(rows.ravel(), kind="stable")
    cuts = np.flatnonzero(np.diff(np.concatenate(([-1], rows.ravel()[by_slot]))))
    owner = by_slot // WIDTH
    for step in range(1, passes + 1):
        unary, w = emit[rows].sum(axis=1), np.where(legal, np.exp(move), 0)
        p, expected = np.zeros_like(unary), np.zeros((T, T))
        for a, b, inside in groups:
            u = np.zeros((*inside.shape, T))
            u[inside] = unary[starts[a] : starts[b]]
            own, moves = _posteriors(u, lengths[a:b], w)
            p[starts[a] : starts[b]] = own[inside]
            expected += moves
        soft = np.add.reduceat(p[owner], cuts, axis=0)
        for k, (weights, g) in enumerate(((emit, soft - gold + penalty * emit), (move, expected - gold_move + penalty * move))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            weights -= 0.25 / (1 + 2 * step / passes) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    full = np.zeros((SLOTS, T), np.float32)
    full[used] = emit
    return Field(full, np.where(legal, move, -1e6).astype(np.float32))


def labelled_rows(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """A small labelled table, made anew each time alike: invented sentences with personal data, and numbers that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    hexes = lambda k, s="0123456789abcdef": "".join(pick(s) for _ in range(k))
    letters = lambda a, b: "".join(pick("aeiounrstlhdmcpéäöñ") for _ in range(int(rng.integers(a, b))))
    plain = lambda a, b: "".join(pick("abcdefghilmnoprstuvwz") for _ in range(int(rng.integers(a, b))))
    octet = lambda: str(int(rng.integers(0, 256)))
    host = lambda: pick([f"mail{digits(1)}.example.com", f"{plain(3, 9)}.{pick(['com', 'org', 'net', 'de', 'co.uk', 'edu', 'io'])}", f"{plain(2, 6)}-{plain(2, 6)}.{pick(['com', 'fr', 'es'])}", f"{plain(1, 3)}.{pick(['org', 'de', 'com'])}", f"{plain(3, 7)}.{plain(3, 9)}.{pick(['org', 'com', 'net'])}"])
    make = {
        "EMAIL": lambda: pick([f"{plain(2, 9)}.{digits(2)}", f"{plain(2, 8)}.{plain(2, 9)}", plain(3, 10), f"{plain(2, 8)}_{digits(int(rng.integers(1, 4)))}", f"{plain(2, 6)}+{plain(2, 5)}", f"{letters(2, 7)}.{digits(2)}", f"{plain(2, 8).upper()}", digits(int(rng.integers(1, 7)))]) + "@" + host(),
        "PHONE": lambda: pick([f"+1 ({digits(3)}) 555-{digits(4)}", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{pick(['33', '34', '44', '49'])} {digits(int(rng.integers(1, 4)))} {digits(3)} {digits(int(rng.integers(3, 5)))}", f"+1-{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(11)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"+1 {digits(3)} {digits(3)} {digits(4)}", f"0{digits(2)}/{digits(6)}", f"0{digits(3)} {digits(7)}"]),
        "IP": lambda: ".".join(octet() for _ in range(4)),
        "CARD": lambda: pick([digits(16), digits(16), digits(16), f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}", "-".join(digits(4) for _ in range(4)), digits(15)]),
        "SSN": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "IBAN": lambda: pick(["DE", "FR", "ES", "GB", "IT"]) + digits(2) + pick([digits(18), "".join(" " + digits(4) for _ in range(4)) + " " + digits(2), "".join(" " + digits(4) for _ in range(5))]),
        "SECRET": lambda: pick(["ey" + hexes(int(rng.integers(30, 220)), "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789") + "." + hexes(40, "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789-"), hexes(40), hexes(32), hexes(64), "sk-" + hexes(32, "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"), "AKIA" + hexes(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), "ghp_" + hexes(36, "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789")]),
    }
    bare = lambda: pick([plain(8, 20), plain(8, 14).capitalize(), hexes(int(rng.integers(24, 48)), "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ")])
    none = [
        lambda: plain(20, 34), lambda: f"{pick(['key', 'token', 'secret', 'password'])} {plain(3, 9)}", lambda: f"{pick(['Key', 'keys', 'Secret'])}: ", 
        lambda: f"{digits(1)}.{digits(1)}", lambda: f"Version {digits(1)}.{digits(1)}.", lambda: f"version {digits(1)}.", lambda: f"v{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"CC BY-NC {digits(1)}.0.", lambda: f"{pick(['19', '20'])}{digits(2)}", lambda: f"20{digits(2)}-0{pick('123456789')}-1{digits(1)}",
        lambda: f"1{digits(1)}.0{pick('123456789')}.20{digits(2)}", lambda: f"1{digits(1)}:{pick('012345')}{digits(1)}", lambda: f"{digits(1)},{digits(3)}.{digits(2)}", lambda: f"${digits(3)}", lambda: digits(int(rng.integers(1, 6))), lambda: digits(8), lambda: f"{digits(2)}%", lambda: f"{pick('123456789')}th",
        lambda: f"ISBN 978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", lambda: f"{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"0x{hexes(8)}", lambda: f"commit {hexes(40)}", lambda: f"@{plain(3, 9)}", lambda: f"{plain(2, 6)} @ {plain(2, 6)}", lambda: f"[{digits(2)}]", lambda: f"{digits(2)}/{digits(2)}/{digits(2)}", lambda: f"{digits(3)}-{digits(3)}", lambda: digits(20), lambda: f"§ {digits(3)}", lambda: f"{digits(1)} {digits(1)} {digits(2)}",
    ]
    lead = {"SECRET": lambda: pick(['token = "{}"', 'api_key: "{}"', "password={}", "secret = '{}'", 'key = "{}"', "token: {}", 'access_token="{}"', "API key {}"])}
    rows = []
    for _ in range(n):
        text, spans = "", []
        noisy = rng.random() < 0.2
        loud = rng.random() < 0.1
        for _ in range(int(rng.integers(4, 24))):
            mark = pick(["###", "***", "%%%", "$$$", "&&&", "!!"]) if noisy and rng.random() < 0.6 else pick(["", "", "", "", "", ",", ".", ".\n", " |", ";", ":"])
            if rng.random() < 0.22:
                kind = pick(KINDS)
                value, frame = make[kind](), lead.get(kind, lambda: "{}")()
                if kind == "SECRET" and rng.random() < 0.45:
                    value, frame = bare(), pick(["password={}", "Password: {}", 'password = "{}"', "passwd: {}", "secret = '{}'", 'token = "{}"', "api_key={}", "PASSWORD={}"])
                front = pick(["", "", "", "", "(" if kind != "PHONE" else "", '"', "mailto:" if kind == "EMAIL" else ""]) if frame == "{}" else frame.partition("{}")[0]
                text += front
                spans.append((len(text), len(text) + len(value), kind))
                text += value + frame.partition("{}")[2] + {"(": ")", '"': '"'}.get(front, "")
            elif rng.random() < 0.3:
                text += pick(none)()
            else:
                word = letters(1, 11)
                text += word.upper() if loud else word.capitalize() if rng.random() < 0.15 else word
            text += mark + " "
        rows.append((text, spans))
    return rows


def labelled_table(spark: SparkSession, n: int = EXAMPLES, seed: int = SEED) -> DataFrame:
    """labelled_rows() as a table of texts and their spans."""
    return spark.createDataFrame(labelled_rows(n, seed), SPANS)


_fitted: dict[int, Field] = {}


def fit(rows) -> Field:
    """A field from rows of (text, spans); spans are (start_char, end_char, kind). Null texts are left out, null spans are none.

    The same rows give the same field, which this process trains once.
    """
    key = hash(tuple((text, tuple(map(tuple, spans or ()))) for text, spans in rows))
    if key not in _fitted:
        _fitted.clear()
        _fitted[key] = _fit(rows)
    return _fitted[key]


def _fit(rows) -> Field:
    sequences, tags = [], []
    for text, spans in rows:
        if text is None:
            continue
        at = tokens(text)
        named = np.zeros(len(at), np.int64)
        for start, end, kind in spans or ():
            inside = [k for k, (a, b) in enumerate(at) if a < end and b > start]
            for j, k in enumerate(inside):
                named[k] = TAGS.index(f"{'I' if j else 'B'}-{kind}")
        for a, b in stretches(text, at):
            sequences.append(features(text, at, a, b))
            tags.append(named[a : b + 1])
    if not sequences:
        return Field(np.zeros((SLOTS, T), np.float32), np.where(_legal(), 0, -1e6).astype(np.float32))
    return train(sequences, tags)


def find(texts: list[str | None], field: Field) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of each text's personal data, in order."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    sequences, places = [], []
    for i, text in enumerate(texts):
        if not text or not HINT.search(text):
            continue
        at = tokens(text)
        for a, b in stretches(text, at):
            sequences.append(features(text, at, a, b))
            places.append((i, at[a : b + 1]))
    for (i, at), tags in zip(places, field.viterbi(sequences) if sequences else ()):
        start = None
        for k, tag in enumerate([*tags.tolist(), 0]):
            if start is not None and not (tag and TAGS[tag][0] == "I"):
                out[i].append((TAGS[tags[start]][2:], at[start][0], at[k - 1][1]))
                start = None
            if tag and TAGS[tag][0] == "B":
                start = k
    return out


def _finder(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find(batch.column(1).to_pylist(), sent.value)
            rows = [(d, *x) for d, own in zip(batch.column(0).to_pylist(), found) for x in own]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32())
            columns = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "kind", "start_char", "end_char"])

    return run


def personal_data(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Every stretch of personal data: (doc_id, kind, start_char, end_char), in characters, the end exclusive.

    The values themselves are not copied. `labelled` is a small table (text, spans) to train on, labelled_table() if none is given.
    Null and empty texts have none; a null id is reported as null. Repeated rows report as often as they occur. Texts of
    any length are read whole. Other columns are ignored. An empty table gives an empty result; an empty labelled table finds nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = [(r[0], r[1]) for r in labelled.select("text", "spans").collect()] if labelled is not None else labelled_rows()
    sent = spark.sparkContext.broadcast(fit(rows))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return docs.mapInArrow(_finder(sent), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents", "doc_id", "text"), labelled_table(spark))
