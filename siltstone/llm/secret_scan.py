"""Secrets in texts, with a random forest against false positives (operator 9).

Patterns propose candidates in the whole text. A random forest decides on each from
its length, characters and their transitions, how far dictionary words cover it, the
path it stands in and the words beside it. The dictionary is the fixed list WORDS and the
LEXICON words that most documents of the corpus hold; transitions are counted on it. The
path is the document's, from a column path, or else the last path or file name in the
AROUND characters before the candidate. The forest is trained from labelled findings
(candidate, before, after, path, label); those of labelled_findings(), made by a seeded
generator from formats of keys and of harmless look-alikes, are the default. At most
SAMPLE findings are used, in the order given.

How it runs: the corpus' words are counted once, combined before the shuffle; the
detector is some megabytes, bounded by TREES, DEPTH and LEXICON, and is broadcast;
scanning and redacting are one pass over the input without a shuffle.

Cases: null and empty texts have no candidates; texts and candidates of any length are
scanned and measured whole; the forest judges the candidates of all patterns, also of
those within others; secrets that overlap are one finding from the first character to the
last, with kind and score of the earliest, then longest; of harmless candidates those that
overlap no secret are left, the earlier, then the longer one; words that equally many
documents hold go into the dictionary in their own order; repeated rows are scanned each;
an empty table has no findings, and WORDS alone for a dictionary; extra columns,
whatever their names, pass through redact() unchanged, and a column named path, if there
is one, is a feature.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from siltstone.llm.shared import columns_of, most_frequent, rest_of, small_batches, tidy

SAMPLE = 20_000
TREES, DEPTH, LEAF, BINS = 40, 9, 4, 32
THRESHOLD = 0.5
NEAR = 48
#: Characters before a candidate in which a path is looked for, and words counted from the corpus.
AROUND = 300
LEXICON = 20_000
MASK = "[SECRET]"

#: What the candidates of two patterns begin with or stand behind; a candidate may hold it again.
HEADS = {
    "prefixed": r"(?<![A-Za-z0-9])(?:gh[opsur]_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|AIza|npm_|hf_|SG\.)",
    "assigned": r"(?i)(?:api[_\-]?key|secret|token|passwd|password|pwd|credential|auth)[a-z_\-]{0,12}[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']?",
}
#: Fixed patterns of candidates; the group named x, if there is one, is the candidate.
PATTERNS = {
    "private_key": r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----(?:[ \t]*\r?\n[A-Za-z][A-Za-z0-9\-]*+:[^\r\n]*+)*+[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{0,32}PRIVATE KEY-----)?",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "prefixed": HEADS["prefixed"] + r"[A-Za-z0-9_.\-]{16,}",
    "jwt": r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{4,}",
    "assigned": HEADS["assigned"] + r"(?P<x>[^\s\"'<>,;]{8,})",
    "random": r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/=_\-]*[0-9])(?=[0-9+/=_\-]*[A-Za-z])[A-Za-z0-9+/_\-]{20,}={0,2}",
}
#: Fixed lists of words that tell about a candidate beside or inside which they stand.
ASKS = "key secret token password passwd pwd credential auth bearer apikey private login access signature".split()
EASES = "sha sha1 sha256 sha512 md5 hash commit checksum digest uuid guid etag revision integrity version build id trace request session font image href src".split()
FILLS = "example sample dummy changeme placeholder your insert xxxx fake redacted todo none null lorem test default 12345 abcd".split()
WORDS = (
    "about access account action active address admin again agent alert allow answer apache application archive array article asset author avatar average background backup "
    "balance banner basic before begin between binary block border bottom branch bucket budget buffer build button cache calendar camera cancel capital carbon center change channel "
    "chapter check child choose circle class clean client cloud cluster code collection color column comment common company complete component config connect console contact content control "
    "copy count country course cover create current custom data database debug decimal default delete deploy design detail device dialog digital direct display document domain double download draft driver "
    "early east edit editor email empty enable engine english enter entry error event example export extra factor failed family feature field figure file filter final find first fixed focus folder font footer "
    "force form format forward frame free from front full function gallery game gateway general global graph green group guide handle header health height hello help hidden history home host hotel house image "
    "import index info inner input insert install item java journal json language large last launch layout leader learn left level library license light limit line link list live load local location login "
    "main manager market master match media medium member memory menu merge message meta method minute mobile model module month mouse music name native network next night node normal north note number object "
    "offer office online open option order other output owner package page panel parent part patch path payment people person phone photo picture place plain plan player plugin point policy popular port post "
    "power press preview price primary print private process product profile program project public query queue quick random range reader record region release remote report request reset resource response result "
    "review right role root route router rule safe sample save scale schedule schema school score screen script search second section secure select send server service session setting share shop short side sign "
    "simple single site size small snapshot social software source south space special spring stack staff stage standard start state static status step stock store stream string strong style submit summary support "
    "switch system table target task team template term test text theme thread ticket time title today tool topic total track trade train transfer tree trust type under unique unit update upload user value vendor "
    "version video view visit volume wait watch water week welcome west white width window wizard word work world write year yellow young zone"
).split()

_FINDERS = {k: re.compile(p) for k, p in PATTERNS.items()}
_HEADS = {k: re.compile(p) for k, p in HEADS.items()}
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_PATH = re.compile(r"[A-Za-z0-9_.\-]*(?:[/\\][A-Za-z0-9_.\-]+)+|[A-Za-z0-9_\-]+\.(?:py|js|ts|java|go|rb|json|ya?ml|toml|ini|cfg|conf|env|md|txt|sh|xml|html?)\b")


class Dictionary:
    """Words, and log P(next letter | letter) over a-z among them."""

    def __init__(self, words: Iterable[str]):
        every = sorted({*WORDS, *words})
        self.words = frozenset(w for w in every if len(w) >= 4)
        self.longest = max(map(len, self.words))
        table = np.full((26, 26), 0.5)
        for w in every:
            codes = [ord(c) - 97 for c in w]
            for a, b in zip(codes, codes[1:], strict=False):
                table[a, b] += 1
        self.transitions = np.log(table / table.sum(axis=1, keepdims=True))

    def coverage(self, candidate: str) -> float:
        """The part of the characters that words cover, found greedily from the left, longest first."""
        low, k, covered = candidate.lower(), 0, 0
        while k < len(low):
            for n in range(min(self.longest, len(low) - k), 3, -1):
                if low[k : k + n] in self.words:
                    covered += n
                    k += n
                    break
            else:
                k += 1
        return covered / max(1, len(low))


def corpus_words(docs: DataFrame, n: int = LEXICON) -> list[str]:
    """The n runs of 4 to 16 letters a-z that most documents hold, lower-cased, ties in their own order."""
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?<![\p{L}\p{N}])([a-z]{4,16})(?![\p{L}\p{N}])"), F.lit(1))
    counted = docs.select(F.explode(F.array_distinct(found)).alias("word")).groupBy("word").agg(F.count("*").alias("docs")).where("docs > 1")
    with tidy():
        return [r.word for r in most_frequent(counted, "word", "docs", n).collect()]


def nearest_path(before: str) -> str:
    """The last path or file name in the characters before a candidate."""
    found = ""
    for m in _PATH.finditer(before):
        found = m.group()
    return found


def _beside(text: str, words: list[str]) -> float:
    low = re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text).lower())
    return float(any(w in low for w in words) or any(len(w) > 4 and any(w in x for x in low) for w in words))


def features(candidate: str, before: str, after: str, path: str, kind: str, known: Dictionary) -> list[float]:
    """What the forest sees of a candidate."""
    c = candidate
    n = max(1, len(c))
    classes = ["d" if x.isdigit() else "u" if x.isupper() else "l" if x.islower() else "s" for x in c]
    counts = Counter(c)
    letters = [ord(x) - 97 for x in c.lower() if "a" <= x <= "z"]
    pairs = [known.transitions[a, b] for a, b in zip(letters, letters[1:], strict=False)]
    run = best = 1
    for a, b in zip(c, c[1:], strict=False):
        run = run + 1 if a == b or ord(b) == ord(a) + 1 else 1
        best = max(best, run)
    whole = before[-1:] + c + after[:1]
    return [
        math.log(len(c) + 1),
        classes.count("d") / n, classes.count("u") / n, classes.count("l") / n, classes.count("s") / n,
        sum(a != b for a, b in zip(classes, classes[1:], strict=False)) / n,
        -sum(v / n * math.log2(v / n) for v in counts.values()),
        len(counts) / n,
        sum(pairs) / len(pairs) if pairs else -5.0,
        known.coverage(c),
        float(all(x in "0123456789abcdefABCDEF" for x in c)), float(len(c) in (32, 40, 64)),
        float(bool(_UUID.fullmatch(c))),
        best / n,
        c.count("/") / n, c.count(".") / n, c.count("-") / n,
        float("://" in before[-24:] or before[-1:] == "/" or bool(re.search(r"\.[a-z]{2,4}$", c))),
        float(any(w in path.lower() for w in ("test", "example", "fixture", "sample", "doc"))),
        _beside(before, ASKS), _beside(before, EASES), _beside(after, EASES),
        float(bool(re.search(r"[:=]\s*[\"']?$", before))), float(whole[0] in "\"'`" and whole[-1] in "\"'`"),
        float(any(w in c.lower() for w in FILLS)),
        *[float(kind == k) for k in PATTERNS],
    ]


class Forest:
    """Trees as flat arrays: column, threshold, left child (right is next) and mean of each node."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]):
        self.trees = trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(9)
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
        some = max(1, int(math.sqrt(x.shape[1])) + 1)
        trees = []
        for _ in range(TREES):
            nodes: list[list] = [[-1, 0.0, 0, 0.0]]
            todo = [(0, rng.integers(0, len(y), len(y)), 0)]
            while todo:
                k, rows, depth = todo.pop()
                t = y[rows]
                nodes[k][3] = float(t.mean())
                if depth == DEPTH or len(rows) < 2 * LEAF or t.min() == t.max():
                    continue
                best = (1e-9, None, None)
                for j in rng.choice(x.shape[1], some, replace=False):
                    if not len(edges[j]):
                        continue
                    n = np.bincount(bins[rows, j], minlength=len(edges[j]) + 1).cumsum()[:-1]
                    s = np.bincount(bins[rows, j], weights=t, minlength=len(edges[j]) + 1).cumsum()[:-1]
                    ok = (n >= LEAF) & (len(t) - n >= LEAF)
                    if ok.any():
                        gain = np.where(ok, s**2 / np.maximum(n, 1) + (t.sum() - s) ** 2 / np.maximum(len(t) - n, 1) - t.sum() ** 2 / len(t), -1)
                        if gain.max() > best[0]:
                            best = (gain.max(), j, int(gain.argmax()))
                if best[1] is None:
                    continue
                _, j, cut = best
                low = bins[rows, j] <= cut
                nodes[k][:3] = [int(j), float(edges[j][cut]), len(nodes)]
                nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
                todo += [(len(nodes) - 2, rows[low], depth + 1), (len(nodes) - 1, rows[~low], depth + 1)]
            trees.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))
        return cls(trees)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for column, edge, left, mean in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = column[at] >= 0
                step = left[at] + (x[every, np.maximum(column[at], 0)] > edge[at])
                at = np.where(inner, step, at)
            total += mean[at]
        return total / max(1, len(self.trees))


def labelled_findings(n: int = 6000, extra: Sequence[str] = ()) -> list[tuple[str, str, str, str, int]]:
    """(candidate, before, after, path, label): half keys of many formats, half look-alikes; extra words stand among those of WORDS."""
    rng = np.random.default_rng(99)
    vocabulary = [*WORDS, *extra]
    draw = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    one = lambda xs: xs[int(rng.integers(0, len(xs)))]
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexes, mixed = dig + "abcdef", low + up + dig
    prose = lambda k: " ".join(one(vocabulary) for _ in range(k))
    size = lambda a, b: int(rng.integers(a, b))
    kinds = ["", "RSA ", "EC ", "DSA ", "OPENSSH ", "ENCRYPTED "]
    lines = lambda k: "\n".join([*(draw(mixed + "+/", 64) for _ in range(k)), draw(mixed + "+/", size(4, 60)) + one(["", "=", "=="])])
    block = lambda kind, head: f"-----BEGIN {kind}PRIVATE KEY-----\n{head}{lines(size(1, 50))}\n-----END {kind}PRIVATE KEY-----"
    keys = [
        lambda: block(one(kinds), ""), lambda: block(one(kinds[:4]), f"Proc-Type: 4,ENCRYPTED\nDEK-Info: {one(['AES-128-CBC', 'AES-256-CBC', 'DES-EDE3-CBC'])},{draw(hexes, 32).upper()}\n\n"),
        lambda: draw(hexes, one([32, 40, 40, 48, 64])), lambda: draw(hexes, size(12, 65)), lambda: draw(mixed, size(20, 64)), lambda: draw(mixed + "+/", size(24, 60)) + one(["", "=", "=="]),
        lambda: "AKIA" + draw(up + dig, 16), lambda: one(["ghp_", "gho_", "npm_", "hf_"]) + draw(mixed, 36), lambda: "sk-" + draw(mixed, size(32, 48)),
        lambda: one(["xoxb-", "xoxp-"]) + draw(dig, 11) + "-" + draw(mixed, 24), lambda: "AIza" + draw(mixed + "_-", 35), lambda: "eyJ" + draw(mixed, 24) + "." + draw(mixed, 48) + "." + draw(mixed + "_-", 43),
        lambda: draw(mixed + "!@#%^&*", size(10, 24)), lambda: draw(mixed + "_-", size(20, 44)), lambda: one(vocabulary).title() + draw(dig, size(2, 5)) + one(list("!@#%")) + one(["", one(vocabulary)]),
    ]
    names = ["api_key", "apikey", "secret", "token", "password", "auth_token", "client_secret", "access_key", "SECRET_KEY", "private_key", "credential", "bearer token"]
    harmless = [
        lambda: (f"-----BEGIN {one(kinds)}PRIVATE KEY-----" + one([" ", "\n"]) + one([prose(size(2, 20)), "x" * size(8, 64), one(FILLS).upper()]), prose(4) + " ", one([". ", "... ", ", "]) + prose(3)),
        lambda: (draw(hexes, 40), prose(3) + " commit ", " " + prose(2)), lambda: (draw(hexes, 64), one(["sha256:", "sha256 = ", "digest ", "checksum: "]), " " + prose(2)), lambda: (draw(hexes, 32), one(["md5 ", "etag \"", "hash: "]), one(["", "\""])),
        lambda: ("-".join(draw(hexes, k) for k in (8, 4, 4, 4, 12)), one(["uuid ", "id = \"", "request id ", prose(2) + " "]), " " + prose(2)),
        lambda: ("".join(one(vocabulary).title() for _ in range(size(3, 6))) + draw(dig, size(1, 3)), prose(4) + " ", " " + prose(3)), lambda: ("-".join(one(vocabulary) for _ in range(size(3, 7))) + "-" + draw(dig, size(1, 5)), one(["href=\"/", "https://www.", "/"]), one(["\"", "/", " "])),
        lambda: ("/".join(one(vocabulary) for _ in range(size(3, 6))) + "/" + draw(dig, size(1, 4)), one(["https://", "/", "path "]), " " + prose(2)), lambda: ("_".join(one(vocabulary) for _ in range(size(3, 6))) + draw(dig, 2), prose(3) + " ", "(" + one(vocabulary)),
        lambda: (one(FILLS) + "_" + one(["key", "token", "secret"]) + "_" + draw(dig, 3), one(names) + " = \"", "\""), lambda: ("x" * size(12, 40), one(names) + "=", " "), lambda: ("1234567890" * size(2, 4) + "abcdef", one(names) + ": ", " " + prose(2)),
        lambda: ("".join(one(vocabulary) for _ in range(size(2, 5))), one(names) + ": ", " " + prose(3)), lambda: (draw(dig, size(20, 30)) + one(["kg", "ms", "px", "th"]), prose(3) + " ", " " + prose(2)), lambda: (one(vocabulary) + "." + one(vocabulary) + "." + one(vocabulary) + "()", one(names) + " = ", " " + prose(2)),
        lambda: ("get" + one(vocabulary).title() + one(vocabulary).title() + "FromRequest", one(["token = ", "auth: ", "password="]), ";"), lambda: (draw(hexes, 20) + ".chunk.js", "src=\"", "\""),
    ]
    out = []
    for k in range(n):
        path = one(["", "", "", "src/app.py", "config/settings.yml", "tests/fixtures/data.json", "docs/example.md"])
        if k % 2:
            quote = one(["\"", "'", ""])
            plain = rng.random() < 0.15
            before = prose(size(1, 6)) + (" " if plain else " " + one(names) + one([" = ", "=", ": ", " "]) + quote)
            out.append((one(keys)(), before, ("" if plain else quote) + " " + prose(size(0, 4)), path, 1))
        else:
            candidate, before, after = one(harmless)()
            out.append((candidate, before, after, path, 0))
    return out


def kind_of(candidate: str, before: str) -> str:
    """The first pattern that proposes the candidate where it stands; random if none does."""
    text = before + candidate
    for kind, finder in _FINDERS.items():
        for m in finder.finditer(text, max(0, len(before) - NEAR)):
            if (m.start("x") if "x" in finder.groupindex else m.start()) == len(before):
                return kind
    return "random"


class Detector(NamedTuple):
    forest: Forest
    known: Dictionary


def train(findings: list[tuple[str, str, str, str, int]] | None = None, words: Sequence[str] = ()) -> Detector:
    """A forest from labelled findings, with WORDS and more words as its dictionary."""
    rows = (labelled_findings(extra=words) if findings is None else findings)[:SAMPLE]
    if not rows:
        raise ValueError("the forest needs labelled findings")
    known = Dictionary(words)
    x = np.array([features(c, b[-NEAR:], a[:NEAR], p or nearest_path(b[-AROUND:]), kind_of(c, b), known) for c, b, a, p, _ in rows])
    return Detector(Forest.fit(x, np.array([r[-1] for r in rows], float)), known)


def _spans(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """The pattern's candidates; one that holds the head of others is followed by those, each up to the next head."""
    finder = _FINDERS[kind]
    group = "x" if "x" in finder.groupindex else 0
    for m in finder.finditer(text):
        start, end = m.span(group)
        yield start, end
        if kind in _HEADS:
            heads = [h.start() for h in _HEADS[kind].finditer(text, start, end) if h.start() > m.start()]
            for head, stop in zip(heads, [*heads[1:], end], strict=False):
                if inner := finder.match(text, head, stop):
                    yield inner.span(group)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the candidates of every pattern, the earlier and longer first; equal ones are of the first pattern."""
    found: dict[tuple[int, int], str] = {}
    for kind in PATTERNS:
        for span in _spans(kind, text):
            found.setdefault(span, kind)
    return [(a, b, found[a, b]) for a, b in sorted(found, key=lambda s: (s[0], -s[1]))]


def _settled(scored: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score), none overlapping: unions of secrets, and the harmless candidates beside them."""
    secrets: list[tuple[int, int, str, float]] = []
    for start, end, kind, score in scored:
        if score < THRESHOLD:
            continue
        if secrets and start < secrets[-1][1]:
            first = secrets[-1]
            secrets[-1] = (first[0], max(first[1], end), *first[2:])
        else:
            secrets.append((start, end, kind, score))
    out, k, at = list(secrets), 0, 0
    for one in scored:
        start, end, _, score = one
        while k < len(secrets) and secrets[k][1] <= start:
            k += 1
        if score < THRESHOLD and start >= at and (k == len(secrets) or end <= secrets[k][0]):
            out.append(one)
            at = end
    return sorted(out)


def scan_text(text: str, path: str, detector: Detector) -> list[tuple[int, int, str, float]]:
    """(start, length, kind, score) of the findings, in code points, none overlapping."""
    found = candidates(text)
    if not found:
        return []
    at = lambda a: path or nearest_path(text[max(0, a - AROUND) : a])
    x = np.array([features(text[a:b], text[max(0, a - NEAR) : a], text[b : b + NEAR], at(a), k, detector.known) for a, b, k in found])
    settled = _settled([(a, b, k, float(s)) for (a, b, k), s in zip(found, detector.forest.score(x), strict=True)])
    return [(a, b - a, k, s) for a, b, k, s in settled]


def _paths(batch: pa.RecordBatch) -> list[str]:
    names = batch.schema.names
    return [str(p or "") for p in batch.column(names.index("path")).to_pylist()] if "path" in names else [""] * len(batch)


def scan(docs: DataFrame, detector: Detector) -> DataFrame:
    """(doc_id, start, length, kind, score, is_secret): the findings in docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(detector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *f) for d, t, p in zip(batch.column(0).to_pylist(), batch.column(1), _paths(batch), strict=True) for f in scan_text(t.as_py() or "", p, shared.value)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "kind", "score"])

    extra = ["path"] if "path" in docs.columns else []
    found = docs.select(F.col("doc_id").cast("long"), "text", *extra).mapInArrow(run, "doc_id long, start long, length long, kind string, score double")
    return found.withColumn("is_secret", F.col("score") >= THRESHOLD)


def redact(docs: DataFrame, detector: Detector) -> DataFrame:
    """docs with every secret in text replaced by MASK; n_chars follows the text if it is there."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(detector)

    def clean(text: str | None, path: str) -> str | None:
        at, parts = 0, []
        for start, length, _, score in scan_text(text or "", path, shared.value):
            if score >= THRESHOLD:
                parts += [text[at:start], MASK]
                at = start + length
        return "".join([*parts, text[at:]]) if parts else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([clean(t.as_py(), p or "") for t, p in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["row", "text"])

    row, field = rest_of(docs, "text")
    path = F.col("path").cast("string") if "path" in docs.columns else F.lit(None).cast("string")
    out = docs.select(row, "text", path.alias("path")).mapInArrow(run, StructType([field, StructField("text", StringType())]))
    return out.select(*columns_of("row", docs.columns, text=F.col("text"), n_chars=F.length("text").cast("long")))
