"""Secret scans: three fixed patterns, and a character convolutional network over every candidate.

The patterns' spans always stay. Candidates of the network are all runs of 8 or more characters of [A-Za-z0-9+/_=.-],
but for those that can't be told from prose: words in small or capital letters, joined by hyphens, dots or slashes or
not, and numbers, unless they stand behind a colon or an equals sign. Candidates inside the patterns' spans are scored as well; what is found there
is in the list already. A candidate is seen in steps of 40 characters, each with the 24 characters before it and the 16
behind it, whatever these are, and the mean of the steps' outputs counts. The network has an embedding-free first layer (a
filter weight for each character class and place), a second layer, the maximum and the mean over places, and a logistic
output, all in numpy. It is trained on labelled findings that `findings()` draws from a seeded generator (on all their
steps; the rest are names, hashes, identifiers, embedded data and other long runs), calibrated by Platt's method on a
held-out part, and its threshold is the largest at which recall on another held-out part is at least RECALL.

Null texts count as empty; texts without findings give zero counts, an empty span list and the digest of the empty
string. Spans are in code points, end exclusive; ties in start go by the order of KINDS; a score equal to the threshold is
a finding. Repeated rows and other columns change nothing, ids may be null; an empty table gives an empty result. Each text
is scanned whole, in time linear in its length; memory follows the longest text."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fitted, pieces

KINDS = ("assign", "access", "hex", "net")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{8,}")
PROSE = re.compile(r"[A-Z]*+[a-z]*+(?:[-./=]++[A-Z]*+[a-z]*+)*+|[0-9+/_=.-]*+")  # possessive: runs may be very long
GIVEN = re.compile(r"""[:=]\s?["'`(]?\Z""")
#: What a text must hold for each scan to find anything; RE2 looks at whole columns.
HINTS = (r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", "AKIA[A-Z0-9]{12}", "[0-9a-f]{32}", "[A-Za-z0-9+/_=.-]{8}")
BEFORE, CORE, BEHIND, RECALL = 24, 40, 16, 0.95
WIDTH = BEFORE + CORE + BEHIND

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=.-:;,'\"@ \n"
OTHER, NONE = len(ALPHABET), len(ALPHABET) + 1
CODE = np.full(128, OTHER, np.uint8)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def base_spans(text: str, scans=(True, True, True)) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in order."""
    out = []
    if scans[0]:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if scans[1]:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if scans[2]:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        if not PROSE.fullmatch(m[0]) or GIVEN.search(text, max(0, m.start() - 3), m.start()):
            out.append(m.span())
    return out


def views(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The coded steps of candidates, a row each: context before, up to 40 of its characters, context behind; and the
    candidate of each."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.full(len(raw) + 1, NONE, np.uint8)  # the last place stands for what is outside the text
    code[:-1] = np.where(raw < 128, CODE[np.minimum(raw, 127)], OTHER)
    steps = [(i, s, e) for i, (a, e) in enumerate(spans) for s in range(a, e, CORE)]
    of, start, end = (np.array(x, np.int64) for x in zip(*steps, strict=True)) if steps else (np.zeros(0, np.int64),) * 3
    at = start[:, None] + np.arange(-BEFORE, CORE)
    at[:, BEFORE:][at[:, BEFORE:] >= end[:, None]] = len(raw)
    behind = np.minimum(end, start + CORE)[:, None] + np.arange(BEHIND)
    at = np.concatenate([at, behind], axis=1)
    return code[np.where((at < 0) | (at > len(raw)), len(raw), at)], of


# training


def findings(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labelled findings: the steps of all, the finding of each, and for each finding 1 for a secret, 0 for none."""
    rng = np.random.default_rng(seed)
    pick = lambda a: a[int(rng.integers(len(a)))]
    draw = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    size = lambda a, b: int(rng.integers(a, b))
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    upper, alnum, hexa = lower.upper(), lower + lower.upper() + digits, "0123456789abcdef"
    b64 = alnum + "+/"
    parts = "con tion ing str er al pre ment com pro ex ter in un able ist graph log sch land weg ung eau ois ción dad own th qu ck ll sp".replace("ó", "o").split()
    word = lambda: "".join(pick(parts) if rng.random() < 0.4 else draw("bcdfghjklmnprstvwyz", 1) + draw("aeiouy", 1) + pick(["", "", draw("nrstlm", 1)]) for _ in range(size(1, 5)))
    noise = lambda: pick([draw("áéíóúäöüßñçèê", size(1, 5)), draw(digits, size(1, 9)), draw("()[]{}#*$%&|<>", 2), word().upper(), "and", "the", draw(alnum, 12), f"{size(1, 255)}.{size(1, 255)}.7.9"])
    words = lambda k: " ".join(word() if rng.random() < 0.8 else noise() for _ in range(k))
    name = lambda: word().capitalize() + word().capitalize() + pick(["", word().capitalize(), str(size(1, 99))])
    short = lambda: pick([word() + draw(digits, size(1, 5)), word() + pick("-_.") + word() + draw(digits, size(1, 4)), draw(alnum, size(8, 16)), word().capitalize() + draw(digits, size(2, 5)), word() + word(), draw(lower + digits, size(8, 16)), draw(upper + digits, size(8, 16))])
    long_secrets = [
        lambda: draw(hexa, size(16, 32)), lambda: draw(hexa.upper(), pick([32, 40, 64])), lambda: draw(b64, size(20, 64)) + pick(["", "=", "=="]), lambda: draw(alnum, size(18, 48)), lambda: draw(alnum + "_-", size(20, 60)), lambda: draw(upper + digits, size(20, 40)), lambda: draw(lower + digits, size(18, 44)),
        lambda: draw(lower, size(2, 5)) + pick("_-") + draw(alnum, size(20, 44)), lambda: draw(lower, size(2, 4)) + "_" + draw(lower, 4) + "_" + draw(alnum, size(20, 36)), lambda: draw(lower, 4) + "-" + draw(digits, size(10, 13)) + "-" + draw(alnum, size(16, 32)), lambda: draw(upper, 2) + draw(lower, 2) + draw(alnum + "_-", 35),
        lambda: "eyJ" + draw(alnum, size(15, 40)) + ".eyJ" + draw(alnum, size(20, 90)) + "." + draw(alnum + "_-", size(27, 43)), lambda: draw(upper, 2) + "." + draw(alnum + "_-", 22) + "." + draw(alnum + "_-", 43), lambda: draw(b64, 64), lambda: draw(b64, size(70, 200)) + pick(["", "=", "=="]),
    ]
    leads = ["password is ", "passcode: ", "pwd=", "pass: ", "pw: ", "PWD: ", "credential ", "credentials: admin ", "auth = ", "key: ", "access key ", "private key = ", "Bearer ", "Basic ", "Authorization: ", "client: '", "sig=", "pin code: ", f"//{word()}:", "login with ", "AccountKey=", "signing key "]
    loose = ["", "", "", "class ", "call ", "request ", "write to ", "unpack ", "line ", "about ", "import ", "set ", "was ", "of ", "see ", "id ", "the ", "at ", "in ", "value: ", "name = ", "ref: ", "file: "]
    others = [
        lambda: f"mail{size(0, 10)}.example.com", lambda: f"{word()}{pick('._-')}{size(1, 99)}@mail{size(0, 9)}.{word()}.com", lambda: f"www.{word()}.com/{word()}/{size(1, 9999)}.html", lambda: f"{word()}-{word()}-{word()}-{size(1, 99)}", lambda: f"{word()}_{word()}_{word()}_v{size(1, 20)}.{size(0, 9)}", lambda: f"{word()}_{word()}_{word()}",
        lambda: f"{size(1990, 2030)}-{size(10, 12)}-{size(10, 28)}T{size(10, 23)}-utc", lambda: f"/usr/lib/{word()}{size(2, 9)}/{word()}.so.{size(1, 9)}", lambda: word() + word() + word() + word() + str(size(0, 99)), lambda: f"{word()}.{word()}.py-{size(1, 400)}", lambda: word().upper() + "_" + word().upper() + pick(["", "_" + word().upper()]),
        lambda: (word() + word() + word()).upper(), lambda: (word() + word()).upper() + str(size(1, 9)) + word(), lambda: pick("0123456789aAxXzZ-_=.") * size(9, 90), lambda: f"ISBN-{size(100, 999)}-{size(1000, 9999)}-{size(1000, 9999)}", lambda: f"v{size(1, 9)}.{size(0, 20)}.{size(0, 20)}-beta.{word()}{word()}",
        lambda: f"{size(1990, 2030)}-{size(10, 13)}-{size(10, 29)}T{size(10, 24)}:{size(10, 60)}:{size(10, 60)}{pick(['Z', '.5Z', '+01:00', f'.{size(100, 999)}Z'])}", lambda: f"{word()}.{word()}{size(1, 99)}@{word()}.{word()}.com", lambda: "/".join(word() for _ in range(size(2, 6))) + f"/{name()}.{pick(['java', 'py', 'md', 'html', 'jpg'])}",
        lambda: f"https://{word()}.{word()}.org/{size(1990, 2030)}/{size(10, 13)}/{word()}-{word()}-{word()}.html", lambda: f"{word()}.{word()}.{name()}", lambda: word().capitalize() + word() + word().capitalize() + word(),
        lambda: name() + name(), lambda: word() + name() + name(), lambda: f"get{name()}By{name()}", lambda: f"{name()}.{word()}{name()}", lambda: "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: word().upper() + str(size(1, 99)) + "-" + word(), lambda: f"{word()}/{word()}{size(1, 99)}/{word()}-{size(1, 999)}.jpg", lambda: f"{size(1, 99999)}x{size(1, 9999)}px",
        lambda: f"{word().capitalize()}{size(1900, 2030)}-{word()}", lambda: (word() + " ").strip() * size(2, 6) + str(size(1, 9)), lambda: short(), lambda: short(), lambda: f"{draw(upper, 2)}{draw(digits, size(8, 14))}", lambda: draw(digits, size(4, 9)) + "-" + draw(digits, size(4, 9)) + draw(lower, 1),
    ]
    blobs = [("data:image/png;base64,", lambda: "iVBORw0KGgo" + draw(b64, size(100, 700)) + pick(["", "=", "=="])), ("data:font/woff2;base64,", lambda: "d09GMgAB" + draw(b64, size(100, 700))), ('integrity="', lambda: pick(["sha256-", "sha384-", "sha512-"]) + draw(b64, size(43, 86)) + "="), ("sha256:", lambda: draw(hexa.upper(), 64)), ("commit ", lambda: draw(hexa, size(8, 20))), ("checksum ", lambda: draw(hexa + "ABCDEF", size(16, 64)))]
    xs, of, ys = [], [], []
    while len(ys) < n:
        label = int(rng.random() < 0.5)
        lead = ""
        if label:
            weak = rng.random() < 0.35  # short values are secrets by their context only
            value, lead = (short(), pick(leads)) if weak else (pick(long_secrets)(), pick(leads) if rng.random() < 0.5 else pick(loose))
        elif rng.random() < 0.2:
            lead, blob = pick(blobs)
            value = blob()
        else:
            value, lead = pick(others)(), pick(loose)
        before = words(size(0, 6)) + pick([" ", " ", "\n", ". ", ", "]) + lead
        text = before + value + pick(["", " ", ".", ",", ", ", '"', "\n", "@", ") ", "'", ";"]) + words(size(0, 5))
        found = [(s, e) for s, e in candidates(text) if s <= len(before) < e]
        if found:
            x, _ = views(text, found)
            xs.append(x)
            of += [len(ys)] * len(x)
            ys.append(label)
    return np.concatenate(xs).astype(np.int64), np.array(of), np.array(ys, float)


class Net:
    """conv 5 x 24 over one-hot characters, conv 3 x 24, max and mean over places, logistic output."""

    WIDE, FILTERS = (5, 3), 24

    def __init__(self, seed: int = 3):
        rng, n = np.random.default_rng(seed), self.FILTERS
        shape = {"a": (5, NONE + 1, n), "ab": (n,), "c": (3, n, n), "cb": (n,), "d": (2 * n,), "db": (1,)}
        self.w = {k: rng.normal(0, 0.3 if k == "a" else 0.15, s).astype(np.float32) if len(k) == 1 else np.zeros(s, np.float32) for k, s in shape.items()}
        self.scale, self.shift, self.limit = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray):
        w, a = self.w, 0
        for k in range(5):
            a = a + w["a"][k][x[:, k : WIDTH - 4 + k]]
        a = np.maximum(a + w["ab"], 0)
        m = a.shape[1] - 2
        c = np.maximum(sum(a[:, k : m + k] @ w["c"][k] for k in range(3)) + w["cb"], 0)
        top = c.argmax(axis=1)
        p = np.concatenate([c.max(axis=1), c.mean(axis=1)], axis=1)
        return a, c, top, p, p @ w["d"] + w["db"][0]

    def gradient(self, x, y):
        w, n = self.w, self.FILTERS
        a, c, top, p, z = self.forward(x)
        dz = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)
        g = {"d": p.T @ dz, "db": dz.sum(keepdims=True)}
        dp = dz[:, None] * w["d"]
        dc = np.repeat(dp[:, None, n:] / c.shape[1], c.shape[1], axis=1)
        rows, cols = np.arange(len(x))[:, None], np.arange(n)[None]
        dc[rows, top, cols] += dp[:, :n]
        dc *= c > 0
        m, da = c.shape[1], np.zeros_like(a)
        g["c"] = np.stack([np.tensordot(a[:, k : m + k], dc, ((0, 1), (0, 1))) for k in range(3)])
        g["cb"] = dc.sum((0, 1))
        for k in range(3):
            da[:, k : m + k] += dc @ w["c"][k].T
        da *= a > 0
        flat = da.reshape(-1, n)
        g["ab"], g["a"] = flat.sum(0), np.zeros_like(w["a"])
        for k in range(5):
            ids = x[:, k : WIDTH - 4 + k].ravel()
            hot = np.zeros((len(ids), NONE + 1), np.float32)
            hot[np.arange(len(ids)), ids] = 1
            g["a"][k] = hot.T @ flat
        return g

    def fit(self, x, y, rounds: int = 8, batch: int = 128, rate: float = 4e-3, seed: int = 5):
        rng, m, v, t = np.random.default_rng(seed), {}, {}, 0
        for _ in range(rounds):
            order = rng.permutation(len(x))
            for s in range(0, len(x), batch):
                i, t = order[s : s + batch], t + 1
                for k, g in self.gradient(x[i], y[i]).items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                    self.w[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def outputs(self, x: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """The mean output of each candidate's steps."""
        z = np.concatenate([self.forward(x[i : i + 512].astype(np.int64))[-1] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)
        return np.bincount(of, weights=z, minlength=n) / np.maximum(np.bincount(of, minlength=n), 1)

    def calibrate(self, x, of, y):
        """Platt: a logistic fit of the labels on the network's output, by Newton steps."""
        z, s, b = self.outputs(x, of, len(y)), 1.0, 0.0
        soft = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(s * z + b, -30, 30)))
            r, h = p - soft, np.maximum(p * (1 - p), 1e-6)
            grad = np.array([(r * z).sum(), r.sum()])
            hess = np.array([[(h * z * z).sum(), (h * z).sum()], [(h * z).sum(), h.sum()]]) + 1e-3 * np.eye(2)
            step = np.linalg.solve(hess, grad)
            s, b = s - step[0], b - step[1]
        self.scale, self.shift = float(s), float(b)

    def score(self, x: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.outputs(x, of, n) + self.shift, -30, 30)))


@lru_cache(maxsize=2)
def trained(n: int = 12000, seed: int = 11, recall: float = RECALL) -> Net:
    x, of, y = findings(n, seed)
    net = Net().fit(x, y[of], rounds=4)
    net.calibrate(*findings(n // 4, seed + 1))
    x, of, y = findings(n // 4, seed + 2)
    scores = np.sort(net.score(x, of, len(y))[y > 0])
    net.limit = float(scores[int((1 - recall) * len(scores))])
    return net


@lru_cache(maxsize=2)
def ready(spark: SparkSession) -> Net:
    """The trained network, from the shared folder where it was trained before."""

    def fit():
        n = trained()
        return n.w | {"scale": np.array(n.scale), "shift": np.array(n.shift), "limit": np.array(n.limit)}

    kept, net = fitted(spark, "secrets", trained.__wrapped__.__defaults__, fit), Net()
    net.w = {k: kept[k] for k in net.w}
    net.scale, net.shift, net.limit = (float(kept[k]) for k in ("scale", "shift", "limit"))
    return net


def scan(column: pa.Array, net: Net) -> list[list[tuple[int, int, int]]]:
    """All spans (start, kind number, end) of each text."""
    column = pc.fill_null(column, "")
    hints = [pc.match_substring_regex(column, pattern=h).to_numpy(zero_copy_only=False) for h in HINTS]
    spans: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
    seen, steps, owners = [], [], []

    def judge():
        x, of = np.concatenate(seen), np.concatenate(steps)
        for (i, s, e), p in zip(owners, net.score(x, of, len(owners)), strict=True):
            if p >= net.limit and not any(a <= s and e <= b for a, k, b in spans[i] if k < 3):
                spans[i].append((s, 3, e))
        seen.clear(), steps.clear(), owners.clear()

    for i in np.flatnonzero(np.logical_or.reduce(hints)).tolist():
        text = column[i].as_py()
        spans[i] = base_spans(text, [h[i] for h in hints[:3]])
        if hints[3][i] and (found := candidates(text)):
            x, of = views(text, found)
            seen.append(x)
            steps.append(of + len(owners))
            owners += [(i, s, e) for s, e in found]
            if sum(map(len, seen)) > 50_000:
                judge()
    if owners:
        judge()
    return [sorted(x) for x in spans]


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, net: Net | None = None) -> DataFrame:
    """doc_id, counts by kind, the digest of the patterns' spans, and all spans as text."""
    net = net or ready(docs.sparkSession)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_net"]

    def run(batches):
        for b in batches:
            for c in pieces(b, "text", 4 << 20):
                found = scan(c["text"], net)
                base = [[x for x in f if x[1] < 3] for f in found]
                count = lambda k: pa.array([sum(x[1] == k for x in f) for f in found], pa.int64())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([c["doc_id"], count(0), count(1), count(2), pa.array([hashlib.sha256(listed(x).encode()).hexdigest() for x in base], pa.string()), pa.array([listed(x) for x in found], pa.string()), count(3)], names)

    df = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return df.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_net long")


def redact(docs: DataFrame, mark: str = "[SECRET]", net: Net | None = None) -> DataFrame:
    """docs with every span replaced by `mark`; overlapping spans become one. A null text stays null."""
    net, at = net or ready(docs.sparkSession), docs.columns.index("text")

    def clean(text, spans):
        out, done = [], 0
        for s, _, e in spans:
            if s >= done:
                out += [text[done:s], mark]
            done = max(done, e)
        return "".join([*out, text[done:]])

    def run(batches):
        for b in batches:
            for c in pieces(b, "text", 4 << 20):
                texts = c["text"].to_pylist()
                new = [clean(t, f) if f else t for t, f in zip(texts, scan(c["text"], net), strict=True)]
                yield c.set_column(at, c.schema.field(at), pa.array(new, c.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op6_secret_scan(docs: DataFrame) -> DataFrame:
    return find_secrets(docs)
