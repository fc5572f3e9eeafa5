"""Secret scanning with a linear-chain conditional random field.

Tokens (runs without white space) are tagged outside, begin or inside by their shape, their neighbours' shapes and
words, and features of the whole file; Viterbi decoding finds the best tags. The field is trained on windows that
three fixed patterns label, together with windows around other unusual tokens. So that it does not merely learn the
patterns, three labelled windows of four hide something of what makes them match: the words that announce a secret, or the
spelling of the secret's tokens. Tokens that look like a secret without a label are no negative examples: windows that hold one
are left out. Spans of the patterns are always reported; the field adds spans that they miss.

Decoding is exact and still cheap: a token whose lead for "outside" exceeds all that transitions could ever gain is
outside on the best path, so only the runs between such tokens need the recursion.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import string
from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lotwise.llm.common import WordCache, id_and_text, share
from lotwise.session import cut_lineage

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
FEATURES = 1 << 14  # hashed feature weights per label
SAMPLE_WINDOWS = 1500  # training windows of each kind: secret, unusual token, ordinary text
REACH = 8  # tokens on either side of a window's centre
PRIOR = 10.0  # weight for "outside" with which links and addresses start

KINDS = ("assign", "access", "hex", "crf")
# Fixed patterns of the contract; lengths are checked on the greedy match.
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")  # one of them is in every match
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # greedy runs of 24 and more
TRIGGERS = ("password", "passwd", "secret", "token", "apikey", "api_key", "key", "bearer", "auth", "credential")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    low, found = text.lower(), []
    if any(w in low for w in ASSIGN_WORDS):
        found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_CLASSES = [(re.compile(p), c) for p, c in ((r"[A-Z]+", "A"), (r"[a-z]+", "a"), (r"[0-9]+", "0"), (r"[^\x00-\x7f]+", "u"))]
_PLAIN = re.compile(r"(?:[A-Z]?[a-zÀ-ɏ]*|[A-ZÀ-ɏ]*)[^\w\s=:]*")  # a word with punctuation after it
_CORE = re.compile(r"[A-Za-z0-9+/_.=-]+")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
_TRIGGER = re.compile("|".join(TRIGGERS), re.IGNORECASE)
QUOTES = "\"'`"


def triggers(token: str) -> list[str]:
    """Words that announce a secret: that there is one, and which."""
    return ["trigger", *(f"trigger:{t}" for t in TRIGGERS if t in token.lower())] if _TRIGGER.search(token) else []


def looks_secret(token: str) -> bool:
    """A long run of letters and digits without much repetition, no link and no address."""
    core = max(_CORE.findall(token), key=len, default="")
    if len(core) < 16 or "://" in token or "@" in token or not (_DIGIT.search(core) and _LETTER.search(core)):
        return False
    return len(set(core)) >= 8


def token_features(token: str) -> list[str]:
    """Shape features of a token by itself."""
    if len(token) < 25 and _PLAIN.fullmatch(token):
        return ["plain", f"len:{len(token) // 4}", *triggers(token)]
    shape = token
    for pattern, c in _CLASSES:
        shape = pattern.sub(c, shape)
    core = max(_CORE.findall(token), key=len, default="")
    n = len(core)
    counts = Counter(core)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0
    digits, upper, lower = (sum(map(f, core)) for f in (str.isdigit, str.isupper, str.islower))
    return [
        f"shape:{shape[:12]}", f"core:{min(n // 4, 12)}", f"entropy:{int(entropy * 2)}",
        f"mix:{digits > 0}{upper > 0}{lower > 0}", f"mixcore:{digits > 0}{upper > 0}{lower > 0}:{min(n // 6, 6)}",
        f"digits:{int(4 * digits / n) if n else 0}:{min(n // 8, 4)}", f"hex:{bool(re.fullmatch('[0-9a-f]+', core))}:{min(n // 8, 4)}",
        f"ascii:{token.isascii()}", f"assign:{'=' in token}{':' in token}", f"at:{'@' in token}",
        f"link:{'://' in token}", f"quote:{token[:1] in QUOTES or token[-1:] in QUOTES}",
        *triggers(token),
    ]


def neighbour_features(token: str) -> list[str]:
    """What a token tells about the one beside it."""
    own = ["word:" + token.lower()] if len(token) <= 2 else []
    return [*own, f"plain:{bool(_PLAIN.fullmatch(token))}", f"ends:{token[-1:] if token[-1:] in '=:' else ''}",
            *triggers(token)]


def file_features(text: str) -> list[str]:
    """Size class and marks of the whole text."""
    return ["file", f"file:assign:{'=' in text}", f"file:code:{'{' in text or ';' in text}",
            f"file:size:{min(int(math.log10(len(text) + 1)), 6)}"]


def hashed(names: list[str], role: str) -> list[int]:
    return [crc32(f"{role}|{n}".encode("utf-8", "surrogatepass")) % FEATURES for n in names]


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class SecretField:
    weights: np.ndarray  # features x labels
    moves: np.ndarray  # labels x labels, from -> to; both ends of a text count as outside

    @classmethod
    def fit(cls, windows: list[tuple[list[list[int]], list[int]]], rounds: int = 60, penalty: float = 1e-4) -> SecretField:
        """Penalised likelihood by AdaGrad. A window is (feature ids per token, labels); ends count as outside."""
        weights, moves = np.zeros((FEATURES, 3)), np.zeros((3, 3))
        weights[hashed(["link:True", "at:True"], "own"), OUTSIDE] = PRIOR  # a corpus may hold few links and addresses
        if not windows:
            weights[hashed(["file"], "file")[0], OUTSIDE] = 1.0  # nothing learned: everything is outside
            return cls(weights, moves)
        n, longest = len(windows), max(len(w[1]) for w in windows)
        token = np.concatenate([[i * longest + t] * len(f) for i, w in enumerate(windows) for t, f in enumerate(w[0])])
        token, feature = token.astype(np.int64), np.concatenate([f for w in windows for f in w[0]]).astype(np.int64)
        gold = np.full((n, longest), -1)
        for i, w in enumerate(windows):
            gold[i, : len(w[1])] = w[1]
        real = gold >= 0
        last = real.sum(axis=1)
        empirical, moved = np.zeros((n * longest, 3)), np.zeros((3, 3))
        at = np.flatnonzero(real.ravel())
        empirical[at, gold.ravel()[at]] = 1
        for w in windows:
            for a, b in zip([OUTSIDE, *w[1]], [*w[1], OUTSIDE]):
                moved[a, b] += 1
        g_weights, g_moves = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
        for _ in range(rounds):
            score = np.zeros((n * longest, 3))
            for k in range(3):
                score[:, k] = np.bincount(token, weights[feature, k], n * longest)
            score = score.reshape(n, longest, 3)
            ahead, back = np.zeros_like(score), np.zeros_like(score)
            ahead[:, 0] = moves[OUTSIDE] + score[:, 0]
            for t in range(1, longest):
                step = log_sum(ahead[:, t - 1, :, None] + moves[None], 1) + score[:, t]
                ahead[:, t] = np.where(real[:, t, None], step, ahead[:, t - 1])
            for t in range(longest - 1, -1, -1):
                end = np.broadcast_to(moves[:, OUTSIDE], (n, 3))
                if t == longest - 1:
                    back[:, t] = end
                else:
                    step = log_sum(moves[None] + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
                    back[:, t] = np.where((last == t + 1)[:, None], end, step)
            total = log_sum(ahead[np.arange(n), last - 1] + moves[:, OUTSIDE], 1)
            marginal = np.exp(ahead + back - total[:, None, None]) * real[..., None]
            expected = np.zeros((3, 3))
            expected[OUTSIDE] += marginal[:, 0].sum(axis=0)
            expected[:, OUTSIDE] += marginal[np.arange(n), last - 1].sum(axis=0)
            for t in range(1, longest):
                both = real[:, t]
                pair = ahead[both, t - 1, :, None] + moves[None] + (score[both, t] + back[both, t])[:, None, :]
                expected += np.exp(pair - total[both, None, None]).sum(axis=0)
            gap = empirical - marginal.reshape(-1, 3)
            up = np.stack([np.bincount(feature, gap[token, k], FEATURES) for k in range(3)], axis=1) / n
            up -= penalty * weights
            g_weights += up**2
            weights = weights + 0.3 * up / np.sqrt(g_weights)
            up = (moved - expected) / n - penalty * moves
            g_moves += up**2
            moves = moves + 0.3 * up / np.sqrt(g_moves)
        return cls(weights, moves)

    def token_row(self, token: str, plain_rows: dict[int, bytes]) -> bytes:
        """Label scores a token adds to itself, to the token after it and to the token before it.

        Plain words of three letters and more without a trigger differ by their length class alone."""
        if 2 < len(token) < 25 and _PLAIN.fullmatch(token) and not _TRIGGER.search(token):
            if len(token) // 4 not in plain_rows:
                plain_rows[len(token) // 4] = self.feature_row(token)
            return plain_rows[len(token) // 4]
        return self.feature_row(token)

    def feature_row(self, token: str) -> bytes:
        own, neighbour = token_features(token), neighbour_features(token)
        row = np.concatenate([
            self.weights[hashed(own, "own")].sum(axis=0), self.weights[hashed(neighbour, "before")].sum(axis=0),
            self.weights[hashed(neighbour, "after")].sum(axis=0),
        ])
        return row.astype(np.float32).tobytes()

    def best_path(self, scores: np.ndarray) -> np.ndarray:
        """Best labels of a whole text: exact, see the module's docstring."""
        labels = np.zeros(len(scores), np.int8)
        sure = scores[:, OUTSIDE] - scores[:, 1:].max(axis=1) > 2 * (self.moves.max() - self.moves.min())
        open_ = np.flatnonzero(~sure)
        if len(open_):
            for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
                labels[run] = self.viterbi(scores[run])
        return labels

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """Best labels of a run with outside on both ends."""
        moves, came = self.moves, np.zeros((len(scores), 3), np.int8)
        best = moves[OUTSIDE] + scores[0]
        for t in range(1, len(scores)):
            step = best[:, None] + moves
            came[t] = step.argmax(axis=0)
            best = step.max(axis=0) + scores[t]
        label = int((best + moves[:, OUTSIDE]).argmax())
        path = [label]
        for t in range(len(scores) - 1, 0, -1):
            label = int(came[t, label])
            path.append(label)
        return np.array(path[::-1], np.int8)


_TOKEN = re.compile(r"\S+")


def token_labels(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[str], list[int]]:
    """Tokens and their labels: a token that a span begins in or covers belongs to it."""
    matches = list(_TOKEN.finditer(text))
    labels, k, merged = [OUTSIDE] * len(matches), 0, []
    for _, a, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        while k < len(matches) and matches[k].end() <= a:
            k += 1
        first = True
        while k < len(matches) and matches[k].start() < b:
            labels[k] = BEGIN if first and not labels[k] else INSIDE
            first = False
            k += 1
    return [m.group() for m in matches], labels


HIDE = ("nothing", "triggers", "shapes", "both")  # what a labelled window keeps back


def respelled(token: str, seed: int) -> str:
    """A secret-like token with other letters of either case, cut to some length; digits stay."""
    rng, core = random.Random(seed), max(_CORE.findall(token), key=len)
    new = "".join(rng.choice(string.ascii_letters) if c.isalpha() else c for c in core[: rng.randint(16, len(core))])
    return token.replace(core, new, 1)


def masked(tokens: list[str], labels: list[int], hide: str, seed: int) -> tuple[list[str], list[int]]:
    """A labelled window without the words that announce its secrets, or with the secrets spelled otherwise, or both. What
    announces are the labelled tokens that do not look like a secret; the first of a secret's other tokens begins it."""
    core = [bool(y) and looks_secret(w) for w, y in zip(tokens, labels)]
    if hide in ("shapes", "both"):
        tokens = [respelled(w, seed + t) if c else w for t, (w, c) in enumerate(zip(tokens, core))]
    if hide in ("triggers", "both") and any(core):
        kept = [t for t, y in enumerate(labels) if not y or core[t]]
        tokens, labels = [tokens[t] for t in kept], [labels[t] for t in kept]
        labels = [BEGIN if y and not before else y for y, before in zip(labels, [OUTSIDE, *labels])]
    return tokens, labels


def window_features(tokens: list[str], at: int, text_features: list[int]) -> list[int]:
    found = hashed(token_features(tokens[at]), "own") + text_features
    if at:
        found += hashed(neighbour_features(tokens[at - 1]), "before")
    if at + 1 < len(tokens):
        found += hashed(neighbour_features(tokens[at + 1]), "after")
    return found


def train_secret_field(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SecretField:
    """Field from at most SAMPLE_WINDOWS windows of each kind, drawn by a hash over all rows; the bound is per kind:
    around pattern matches, around other tokens with a digit or 20 and more characters, and around any token. Windows
    travel as hashed features, so tokens of any length cost the same."""

    def run(batches):
        kept: dict[str, list] = defaultdict(list)  # the windows with the smallest keys
        order = count()
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                if not text:
                    continue
                spans, seed = base_spans(text), f"{doc_id}|{len(text)}|{crc32(text[-99:].encode('utf-8', 'surrogatepass'))}"
                if not spans and crc32(seed.encode()) % 8:
                    continue  # windows without a secret come from one row in eight
                tokens, labels = token_labels(text, spans)
                about = hashed(file_features(text), "file")
                places = {
                    "secret": [t for t, y in enumerate(labels) if y == BEGIN],
                    "odd": [t for t, w in enumerate(tokens) if not labels[t] and (len(w) >= 20 or _DIGIT.search(w))],
                    "any": [t for t, y in enumerate(labels) if not y],
                }
                for kind, found in places.items():
                    if not found:
                        continue
                    centre = found[crc32(f"{kind}|{seed}".encode()) % len(found)]
                    a, b = max(0, centre - REACH), min(len(tokens), centre + REACH + 1)
                    if labels[a] == INSIDE or b < len(tokens) and labels[b] == INSIDE:
                        continue  # cut through a secret
                    if any(not y and looks_secret(w) for w, y in zip(tokens[a:b], labels[a:b])):
                        continue
                    key = crc32(f"{kind}|{seed}|key".encode())
                    seen, wanted = masked(tokens[a:b], labels[a:b], HIDE[key // 7 % 4] if kind == "secret" else "nothing", key)
                    item = (-key, next(order), [window_features(seen, t, about) for t in range(len(seen))], wanted)
                    if len(kept[kind]) < SAMPLE_WINDOWS:
                        heapq.heappush(kept[kind], item)
                    else:
                        heapq.heappushpop(kept[kind], item)
        for kind, items in kept.items():
            yield pa.record_batch(
                [pa.array([kind] * len(items), pa.string()), pa.array([-i[0] for i in items], pa.int64()),
                 pa.array([i[2] for i in items], pa.list_(pa.list_(pa.int32()))),
                 pa.array([i[3] for i in items], pa.list_(pa.int32()))],
                names=["kind", "key", "features", "labels"],
            )

    drawn = cut_lineage(
        id_and_text(docs, id_col, text_col).mapInArrow(
            run, "kind string, key long, features array<array<int>>, labels array<int>"
        ),
        "windows",
    )
    windows = []
    for kind in ("secret", "odd", "any"):
        kept = drawn.where(F.col("kind") == kind)
        n = kept.count()
        if not n:
            continue
        # a bound on the wanted keys first, so that no task sends more than its part of the sample
        share_kept = min(1.0, 1.2 * SAMPLE_WINDOWS / n)
        bound = kept.agg(F.percentile_approx("key", share_kept, 100_000)).first()[0]
        rows = kept.where(F.col("key") <= bound).orderBy("key", "features", "labels").limit(SAMPLE_WINDOWS).collect()
        windows += [(r["features"], r["labels"]) for r in rows]
    return SecretField.fit(windows)


def span_finder(field: SecretField):
    """`find(text) -> (base spans, all spans)`."""
    plain_rows: dict[int, bytes] = {}
    cache = WordCache(lambda tokens: [field.token_row(t, plain_rows) for t in tokens])

    def find(text: str) -> tuple[list, list]:
        base = base_spans(text)
        tokens = text.split()
        if not tokens:
            return base, base
        rows = np.frombuffer(b"".join(map(cache.fetch(tokens).__getitem__, tokens)), np.float32).reshape(-1, 9)
        scores = rows[:, :3] + field.weights[hashed(file_features(text), "file")].sum(axis=0)
        scores[1:] += rows[:-1, 3:6]
        scores[:-1] += rows[1:, 6:]
        labels = field.best_path(scores)
        if not labels.any():
            return base, base
        places = [m.span() for m in _TOKEN.finditer(text)]
        added, t = [], 0
        while t < len(labels):
            if labels[t]:
                first = t
                while t + 1 < len(labels) and labels[t + 1] == INSIDE:
                    t += 1
                a, b = places[first][0], places[t][1]
                while a < b and text[a] in "\"'`([{<,;":
                    a += 1
                while b > a and text[b - 1] in "\"'`)]}>,;.!?":
                    b -= 1
                if a < b and not any(x < b and a < y for _, x, y in base):
                    added.append(("crf", a, b))
            t += 1
        return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))

    return find


def scan_secrets(docs: DataFrame, field: SecretField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf. Null texts count as empty."""
    shared = share(docs.sparkSession, field, span_finder)  # FEATURES x 3 floats

    def run(batches):
        find = shared()
        for batch in batches:
            out = []
            for value in batch.column(1):
                base, spans = find(value.as_py() or "")
                n = Counter(k for k, _, _ in base)
                out.append((n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(),
                            joined(spans), len(spans) - len(base)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
            yield pa.record_batch(
                [batch.column(0), *columns],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"
    )


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones taken together, replaced by one mark."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, field: SecretField, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All rows and columns of `docs` with secrets replaced in the text; `length_col`, if given and present, follows
    the new text where the text changed. Null texts stay null."""
    shared = share(docs.sparkSession, field, span_finder)
    place = docs.columns.index(text_col)
    size = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches):
        find = shared()
        for batch in batches:
            texts, columns, changed = [], list(batch.columns), {}
            for k, value in enumerate(batch.column(place)):
                text = value.as_py()
                spans = find(text)[1] if text else []
                texts.append(redact(text, spans) if spans else text)
                if spans:
                    changed[k] = len(texts[-1])
            columns[place] = pa.array(texts, columns[place].type)
            if size is not None and changed:
                lengths = columns[size].to_pylist()
                columns[size] = pa.array([changed.get(k, v) for k, v in enumerate(lengths)], columns[size].type)
            yield pa.record_batch(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
