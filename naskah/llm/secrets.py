"""Secret scan: pattern candidates, false positives removed by a random forest.

Candidates are long mixed strings, values assigned to names such as ``token`` or ``password``, and
private-key blocks. Each is described by length, character make-up and transitions, dictionary
coverage, its place in a path or address, and neighbouring words. The forest is trained on
labelled findings: strings of known kinds, secret or not, planted between words of the corpus
(the tables hold no labels for secrets). Character transitions and the dictionary come from all
documents.

Defined results: null or empty text has no findings and stays as it is. Repeated rows give
repeated findings. Texts are scanned whole, one at a time; other columns are ignored.
"""

from __future__ import annotations

import base64
import math
import random
import re
import string
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from naskah.llm import text as T
from naskah.session import materialize

THRESHOLD = 0.5
DICTIONARY_SHARE = 100_000  # a dictionary word makes up at least one in so many words, counted over all documents
EXAMPLES = 8000
TREES = 40
DEPTH = 9
MASK = "[SECRET]"
NEAR = 64  # characters of context on either side

_NAME = (
    r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_\-]?key|access[_\-]?key|auth|credentials?)"
    r"[\"']?\s{0,3}(?:=|:|=>|:=)\s{0,3}[\"']?"
)
_VALUE = r"((?:(?!&[A-Za-z_][\w\-]*=)[^\s\"'<>,;]){8,})"  # up to the next parameter of an address
CANDIDATE = re.compile(
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?<![A-Za-z0-9+/=_\-])(?=[A-Za-z+/=_\-]*\d)[A-Za-z0-9+/=_\-.]{16,}"
    r"|" + _NAME + _VALUE, re.S
)
NAME, VALUE = re.compile(_NAME), re.compile(_VALUE)
ASSIGNED = re.compile(r"[A-Za-z][A-Za-z0-9_.\-]*=(?=[^=])")
LONG = re.compile(r"(?=[A-Za-z+/=_\-.]*\d).{16,}")
WORD = re.compile(r"[^\W\d_]+")
SECRET_WORDS = frozenset(
    "token secret password passwd pwd passphrase key apikey api access auth authorization bearer credential "
    "credentials private client signing login".split()
)
OTHER_WORDS = frozenset(
    "commit sha md5 checksum hash digest etag revision uuid guid id session trace request order invoice card iban "
    "phone tel isbn version build image png jpeg example sample placeholder test dummy fake integrity".split()
)
PLACEHOLDER = re.compile(r"(?i)your|example|placeholder|change.?me|xxx|todo|dummy|sample|redacted|\*\*\*|<|>|\$\{|\{\{|(.)\1{5}")
PREFIX = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_|github_pat_|sk_(?:live|test)_|xox[abprs]-|AIza|eyJ|glpat-|npm_|SG\.|-----BEGIN")
UUID = re.compile(r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
KINDS = np.zeros(256, np.int8)
KINDS[[*range(48, 58)]] = 1
KINDS[[*range(97, 123)]] = 2
KINDS[[*range(65, 91)]] = 3


class Profile(NamedTuple):
    """What the documents tell: log-probability of byte pairs and frequent words."""

    pairs: np.ndarray  # 256 x 256 float32
    words: frozenset[str]


class Forest(NamedTuple):
    feature: np.ndarray  # trees x nodes, -1 at leaves
    cut: np.ndarray
    value: np.ndarray  # share of secrets at leaves


class Model(NamedTuple):
    profile: Profile
    forest: Forest


def _byte_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at]))


def profile(docs: DataFrame, text: str = "text") -> Profile:
    """Byte pairs and frequent words of all documents.

    Every word of four bytes or more is counted, block by block; Spark adds up, so that no task holds the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, total = np.zeros(65536, np.int64), 0
        for batch in batches:
            for b in T.blocks(batch.column(0)):
                low = T.LOWER[b.data]
                if len(low) > 1:
                    pairs += np.bincount(low[:-1].astype(np.int32) * 256 + low[1:], minlength=65536)
                w = T.words(b)
                total += len(w.hashes)
                long = np.flatnonzero(w.ends - w.starts >= 4)
                if len(long):
                    _, at, n = np.unique(w.hashes[long], return_index=True, return_counts=True)
                    words = _byte_strings(low, w.starts[long[at]], w.ends[long[at]])
                    yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], names=["k", "n"])
        used = np.flatnonzero(pairs)
        keys = ["\t-1", *(f"\t{i}" for i in used)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([total, *pairs[used].tolist()], pa.int64())], names=["k", "n"]
        )

    bare = F.when(F.col("k").startswith("\t"), F.col("k")).otherwise(F.btrim("k", F.lit(string.punctuation)))
    counts = docs.select(text).mapInArrow(run, "k string, n long").groupBy(bare.alias("k")).agg(F.sum("n").alias("n"))
    # single words are below every share
    counts = materialize(counts.where(F.col("k").startswith("\t") | ((F.length("k") >= 4) & (F.col("n") >= 2))), "profile")
    is_pair = F.col("k").startswith("\t")
    # at most 65,536 pairs and DICTIONARY_SHARE words reach the driver
    pair_rows = {int(r["k"]): r["n"] for r in counts.where(is_pair).collect()}
    least = max(2, pair_rows.pop(-1, 0) / DICTIONARY_SHARE)
    word_rows = counts.where(~is_pair & (F.col("n") >= least)).collect()
    table = np.full((256, 256), 0.5)
    for i, n in pair_rows.items():
        table[i >> 8, i & 255] += n
    return Profile(np.log(table / table.sum(1, keepdims=True)).astype(np.float32), frozenset(r["k"] for r in word_rows))


def _coverage(value: str, words: frozenset[str]) -> float:
    """Share of characters covered greedily by dictionary words."""
    low, at, covered = value.lower(), 0, 0
    while at < len(low):
        for size in range(min(16, len(low) - at), 3, -1):
            if low[at : at + size] in words:
                covered += size
                at += size
                break
        else:
            at += 1
    return covered / max(1, len(low))


def features(text: str, start: int, end: int, p: Profile) -> list[float]:
    value = text[start:end]
    raw = np.frombuffer(value.encode(), np.uint8)
    kinds = KINDS[raw]
    share = np.bincount(kinds, minlength=4) / len(raw)
    counts = np.bincount(raw)
    freq = counts[counts > 0] / len(raw)
    low = T.LOWER[raw]
    pair = float(p.pairs[low[:-1], low[1:]].mean()) if len(low) > 1 else 0.0
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    near = [w.lower() for w in WORD.findall(before)[-4:]]
    last = near[-1] if near else ""
    follows = [w.lower() for w in WORD.findall(after)[:2]]
    tail = before.rstrip("\"' ")
    return [
        len(value), share[1], share[2], share[3], share[0], float(-(freq * np.log2(freq)).sum()),
        float((kinds[1:] != kinds[:-1]).mean()) if len(raw) > 1 else 0.0, pair, _coverage(value, p.words),
        value.count("/") + value.count("."), float("://" in before[-24:] + value or tail.endswith(("/", "\\", "@"))),
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", value))), float(bool(PREFIX.match(value))),
        float(bool(UUID.match(value))), float(bool(PLACEHOLDER.search(value))),
        float(last in SECRET_WORDS), sum(w in SECRET_WORDS for w in near),
        sum(w in OTHER_WORDS for w in [*near, *follows]), float(tail.endswith(("=", ":"))),
        float(before.endswith(("\"", "'"))), float(value.isdigit()), value.count("-") + value.count("_"),
    ]


def labelled_findings(words: list[str], n: int, seed: int = 7) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): strings of known kinds between words of the corpus."""
    r = random.Random(seed)
    pick = r.choice
    words = words or ["lorem", "ipsum", "dolor"]

    def chars(alphabet: str, size: int) -> str:
        return "".join(pick(alphabet) for _ in range(size))

    hexes, alnum = string.digits + "abcdef", string.ascii_letters + string.digits

    def hexa(size: int) -> str:
        value = chars(hexes, size)
        return value.upper() if r.random() < 0.25 else value

    def named(value: str) -> tuple[str, str, str]:
        name = pick(["token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "client_secret", "passwd", "private_key"])
        name = pick([name, name.upper(), name.title()])
        quote = pick(["\"", "'", ""])
        return f"{name}{pick([' = ', '=', ': ', ' := '])}{quote}", value, quote

    def plain(value: str) -> tuple[str, str, str]:
        return "", value, ""

    def kind(label: int) -> tuple[str, str, str]:
        if label:
            return pick([
                lambda: named(hexa(pick([32, 40, 64]))), lambda: named(hexa(pick([32, 40, 64]))),
                lambda: named(chars(alnum, r.randint(20, 64))), lambda: named(chars(alnum + "+/", 40)),
                lambda: named(chars(alnum + "!@#$%^&*", r.randint(10, 20))), lambda: plain("AKIA" + chars(string.ascii_uppercase + string.digits, 16)),
                lambda: plain("ghp_" + chars(alnum, 36)), lambda: plain(f"sk_live_{chars(alnum, 24)}"),
                lambda: plain(f"xoxb-{chars(string.digits, 12)}-{chars(alnum, 24)}"), lambda: plain("AIza" + chars(alnum + "_-", 35)),
                lambda: ("Authorization: Bearer ", chars(alnum, r.randint(24, 60)), ""),
                lambda: plain(".".join(["eyJ" + chars(alnum, 20), "eyJ" + chars(alnum, 40), chars(alnum + "_-", 43)])),
                lambda: plain(f"-----BEGIN RSA PRIVATE KEY-----\n{chars(alnum + '+/', 64)}\n-----END RSA PRIVATE KEY-----"),
            ])()
        return pick([
            lambda: plain(chars(string.digits, r.randint(16, 19))), lambda: plain(str(uuid.UUID(int=r.getrandbits(128)))),
            lambda: (pick(["commit ", "sha1: ", "sha256:", "md5 = ", "etag: \"", "checksum ", "integrity="]), hexa(pick([32, 40, 64])), ""),
            lambda: plain("-".join([*(pick(words) for _ in range(r.randint(2, 5))), chars(string.digits, 4)])),
            lambda: (f"https://{pick(words)}.example.com/", "/".join(pick(words) for _ in range(3)) + f"/{r.randint(1, 9999)}", ""),
            lambda: plain(f"/{pick(words)}/{pick(words)}/{pick(words)}{r.randint(1, 99)}.txt"),
            lambda: ("data:image/png;base64,", base64.b64encode(r.randbytes(90)).decode(), ""),
            lambda: named(pick(["your_api_key_here", "xxxxxxxxxxxxxxxx", "changeme123", "${SECRET_TOKEN}", "example-token-0000", "REDACTED_VALUE", "<your-token-1>"])),
            lambda: named("".join(pick(words) for _ in range(2))), lambda: plain("".join(pick(words).title() for _ in range(3)) + str(r.randint(0, 99))),
            lambda: plain(f"{r.randint(2000, 2030)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T10:00:00.000"),
            lambda: (pick(["order id ", "request_id=", "session ", "build "]), hexa(24), ""),
            lambda: plain(pick(words).upper() * 2 + "_" + chars(string.digits, 6)),
        ])()

    out = []
    for i in range(n):
        left = " ".join(pick(words) for _ in range(r.randint(0, 6)))
        before, value, after = kind(i % 2)
        start = len(left) + (1 if left else 0) + len(before)
        text = f"{left}{' ' if left else ''}{before}{value}{after} " + " ".join(pick(words) for _ in range(3))
        out.append((text, start, start + len(value), i % 2))
    return out


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> Forest:
    """Random forest on bootstrap rows, a random third of the features at each node."""
    rng = np.random.default_rng(seed)
    nodes = 2 ** (depth + 1)
    feature, cut = np.full((trees, nodes), -1, np.int16), np.zeros((trees, nodes))
    value = np.zeros((trees, nodes))
    tries = max(2, x.shape[1] // 3)

    def split(t: int, node: int, rows: np.ndarray) -> None:
        labels = y[rows]
        value[t, node] = labels.mean()
        if 2 * node + 1 >= nodes or len(rows) < 8 or labels.min() == labels.max():
            return
        best = (1e-9, -1, 0.0)
        base = value[t, node] * (1 - value[t, node])
        for f in rng.choice(x.shape[1], tries, replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, s = x[rows[order], f], np.cumsum(labels[order])
            ends = np.flatnonzero(v[1:] > v[:-1])
            if not len(ends):
                continue
            n = ends + 1.0
            left, right = s[ends] / n, (s[-1] - s[ends]) / (len(v) - n)
            gain = base - (n * left * (1 - left) + (len(v) - n) * right * (1 - right)) / len(v)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), int(f), float((v[ends[k]] + v[ends[k] + 1]) / 2))
        if best[1] >= 0:
            feature[t, node], cut[t, node] = best[1], best[2]
            low = x[rows, best[1]] <= best[2]
            split(t, 2 * node, rows[low])
            split(t, 2 * node + 1, rows[~low])

    for t in range(trees):
        split(t, 1, rng.integers(0, len(x), len(x)))
    return Forest(feature, cut, value)


def forest_score(forest: Forest, x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for feature, cut, value in zip(*forest):
        node = np.ones(len(x), int)
        while (inner := feature[node] >= 0).any():
            high = x[np.arange(len(x)), feature[node]] > cut[node]
            node = np.where(inner, 2 * node + high, node)
        total += value[node]
    return total / len(forest.feature)


def train(docs: DataFrame, text: str = "text", examples: int = EXAMPLES) -> Model:
    """Profile of all documents and a forest of ``examples`` labelled findings."""
    p = profile(docs, text)
    findings = labelled_findings(sorted(p.words), examples)
    x = np.array([features(t, *_as_scanned(t, s, e), p) for t, s, e, _ in findings])
    return Model(p, grow_forest(x, np.array([f[3] for f in findings], float)))


def spans_of(text: str) -> list[tuple[int, int]]:
    """Candidate spans in order, without the names that values are assigned to."""
    out: list[tuple[int, int]] = []
    at = 0
    while m := CANDIDATE.search(text, at):
        s, e = m.span(1) if m.group(1) else m.span()
        at = m.end()
        if m.group(1) is None and not m.group().startswith("-----BEGIN"):
            name = NAME.search(text, s, e)
            value = VALUE.match(text, name.end()) if name else None
            if value:
                lead = ASSIGNED.match(text, s, name.start())
                first = lead.end() if lead else s
                if LONG.fullmatch(text, first, name.start()):
                    out.append((first, name.start()))
                s, e = value.span(1)
                at = e
            elif (name := ASSIGNED.match(text, s, e)) and LONG.fullmatch(text, name.end(), e):
                s = name.end()
        out.append((s, e))
    return out


def _as_scanned(text: str, start: int, end: int) -> tuple[int, int]:
    """The span under which a scan finds text[start:end]."""
    shared, span = max(((min(e, end) - max(s, start), (s, e)) for s, e in spans_of(text)), default=(0, (start, end)))
    return span if shared > 0 else (start, end)


def findings(text: str, model: Model) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Candidate spans (code points) and their scores."""
    spans = spans_of(text)
    if not spans:
        return [], np.zeros(0)
    x = np.array([features(text, s, e, model.profile) for s, e in spans])
    return spans, forest_score(model.forest, x)


def scan(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end (code points), secret, score, is_secret: one row per candidate."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, value in enumerate(batch.column(1)):
                t = value.as_py() or ""
                for (s, e), score in zip(*findings(t, shared.value)):
                    rows.append(i)
                    out.append((s, e, t[s:e], float(score), int(score >= THRESHOLD)))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=[key, "start", "end", "secret", "score", "is_secret"],
            )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start int, end int, secret string, score double, is_secret int"
    return docs.select(key, text).mapInArrow(run, schema)


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``MASK``; all rows and columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        spans, scores = findings(t, shared.value)
        for (s, e), score in sorted(zip(spans, scores), reverse=True):
            if score >= THRESHOLD:
                t = t[:s] + MASK + t[e:]
        return t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cleaned = pa.array([clean(x.as_py()) for x in batch.column(at)], pa.string())
            yield batch.set_column(at, text, cleaned)

    return docs.mapInArrow(run, docs.schema)
