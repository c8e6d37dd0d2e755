"""Secret scan: pattern candidates, then a random forest that removes false positives.

Candidates are known key formats, values of six characters or more assigned to a name (with or without quotes, up
to white space), and long runs of key characters with a digit. Whether one is a secret is left to the forest. The
forest sees the candidate's length, character classes and transitions, the share covered by dictionary
words, its path (the source name) and neighbouring words. It is trained from labelled findings:
(candidate, before, after, path, label) rows. Findings may be given as a table; at most SAMPLE of
them are fitted. Without one, a documented generator writes findings of both kinds from public key formats.

Each text is scanned whole, in one pass; a document's findings are bounded by its own text.

Defined cases. Null and empty texts have no candidates. A null path is the empty path. Repeated
candidates in a text each count. The key column keeps its type. Extra columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .text import slices, utf8

SAMPLE = 20_000
TREES, DEPTH, LEAST = 32, 9, 4
THRESHOLD = 0.5
AROUND = 40

KEYWORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private_key", "client_secret", "key")
_FORMATS = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
CANDIDATE = re.compile(rf"(?P<format>{_FORMATS})|(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{{16,}}={{0,2}}(?![A-Za-z0-9+/_=-])")
ASSIGNED = re.compile(r"""(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|client[_-]?secret|credential)["']?\s{0,3}(?:=>|=|:)\s{0,3}(?:"(?P<double>[^"\s]{6,})"|'(?P<single>[^'\s]{6,})'|(?P<bare>[^"'\s][^\s]{5,}))""")
_DIGIT = re.compile(r"[0-9]")
#: Common words; the share of a candidate that they cover tells names from keys.
WORDS = frozenset("the and for that with this from have are was were will would there their what about which when make like time just know take people into year your good some could them other than then look only come over think also back after work first well even want because any these give day most file name path class function index value table column data user test example version update config default module import return public static string number object array image page link http https www com org net html json text line list item group order date length width height color style content header footer button input form".split())
PATHS = ("test", "example", "sample", "doc", "mock", "fixture", "config", "env", "prod", "src")


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Spans in order, without overlaps."""
    found = {m.span(m.lastgroup) for m in ASSIGNED.finditer(text)}
    found |= {m.span() for m in CANDIDATE.finditer(text) if m["format"] or _DIGIT.search(m[0])}
    end = -1
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        if a >= end:
            yield a, b
            end = b


def features(value: str, before: str, after: str, path: str) -> list[float]:
    n = len(value)
    kinds = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in value]
    moves = [0.0] * 16
    for a, b in zip(kinds, kinds[1:], strict=False):
        moves[4 * a + b] += 1 / max(1, n - 1)
    counts = [value.count(c) / n for c in set(value)]
    runs = re.findall(r"[a-z]{3,}", value.lower())
    covered = sum(len(r) for r in runs if r in WORDS)
    digits = sum(k == 0 for k in kinds)
    hexes = sum(c in "0123456789abcdefABCDEF" for c in value)
    near = before.lower()
    tail = near.rstrip(" \t\"'=:>")
    named = max((len(k) for k in KEYWORDS if tail.endswith(k)), default=0)
    assigned = float(bool(re.search(r"[=:]>?\s{0,3}[\"']?$", before)))
    quoted = float(before[-1:] in "\"'" and before != "" and after[:1] in "\"'" and after != "")
    known = float(bool(re.fullmatch(_FORMATS, value)))
    grouped = float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value)))
    where = path.lower()
    return [
        n, math.log2(n + 1), -sum(p * math.log2(p) for p in counts), digits / n, hexes / n, sum(k == 3 for k in kinds) / n, *moves,
        covered / n, max((len(r) for r in runs), default=0) / n, named, assigned, quoted, known, grouped,
        float("commit" in near or "sha" in near or "checksum" in near or "uuid" in near or "id" in near.split()[-1:]),
        float(sum(k in near for k in KEYWORDS)), *(float(p in where) for p in PATHS),
    ]


def _formatted(pick, r: random.Random) -> dict[str, str]:
    """A key of each known format, by the format's name."""
    upper, alnum = string.ascii_uppercase, string.ascii_letters + string.digits
    url = alnum + "-_"
    return {
        "access": "AKIA" + pick(upper + r.choice(["", string.digits]), 16),
        "forge": "gh" + r.choice("pousr") + "_" + pick(alnum, 36),
        "chat": "xox" + r.choice("abprs") + "-" + r.choice([f"{pick(string.digits, 11)}-{pick(alnum, 24)}", pick(alnum + "-", r.randint(10, 60)), pick(upper, r.randint(10, 24)), pick(string.ascii_lowercase + string.digits, r.randint(10, 24))]),
        "payment": "sk_live_" + pick(r.choice([alnum, string.ascii_letters, string.ascii_lowercase, string.ascii_lowercase + string.digits]), r.randint(16, 32)),
        "cloud": "AIza" + pick(url, 35),
        "claims": ".".join(["eyJ" + pick(url, r.randint(8, 40)), pick(url, r.randint(8, 120)), pick(url, r.randint(8, 60))]),
        "private": "-----BEGIN " + r.choice(["", "RSA ", "EC ", "DSA ", "OPENSSH ", "ENCRYPTED "]) + "PRIVATE KEY-----",
    }


def _chosen(pick, words: list[str], r: random.Random) -> str:
    """A password as people choose them: words, digits and marks."""
    return r.choice([
        lambda: r.choice(words) + pick(string.digits, r.randint(1, 4)) + r.choice(words),
        lambda: pick(string.ascii_lowercase, r.randint(4, 7)) + pick(string.digits, r.randint(1, 4)) + r.choice(["", "!", "#", pick(string.ascii_lowercase, 6)]),
        lambda: "".join(x.replace("o", "0").replace("e", "3").replace("a", "4") for x in (r.choice(words), r.choice(words))) + pick(string.digits, 2),
        lambda: pick(string.ascii_letters + string.digits + "!@#$%", r.randint(8, 16)),
    ])()


def _stand_in(words: list[str], r: random.Random) -> str:
    """What stands where a value would be: a variable, a call, a plain word."""
    a, b, c = (r.choice(words) for _ in range(3))
    return r.choice([f"{a}.{b}", f"get_{a}()", f"${{{a}_{b}}}".upper(), f"${a}_{b}", f"<{a}-{b}>", f"{a}_{b}", f"{a}[{b}]", f"{{{{{a}.{b}}}}}", f"{a}{b},", f"{a}-{b}-{c}", f"self.{a}.{b}", "required", "invalid", "********", "xxxxxxxx"])


def generated_findings(n: int = 6000, seed: int = 17) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings: keys of all public formats, alone or assigned, random keys and chosen passwords assigned with
    or without quotes (1); and look-alikes, among them variables and placeholders where a value would be (0)."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    words = sorted(WORDS)
    prose = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 6))) + " "
    paths = ["", "src/app", "config/prod.env", "docs/page", "web", "src0", "src7", "tests/data"]
    out = []
    for i in range(n):
        if i % 5 > 2:  # known formats and assignments without quotes
            before, after = prose(), r.choice(["", " ", "\n", " " + prose()])
            name = r.choice(["", "", "db_", "my-", "app."]) + r.choice(KEYWORDS[:-1])
            assigned = r.choice([str, str.upper, str.capitalize])(name) + r.choice(["=", ": ", " = ", " => "])
            kind = r.choice(["formatted", "formatted", "random", "chosen"]) if i % 2 else "stand-in"
            if kind == "formatted":
                key = r.choice(list(_formatted(pick, r).values()))
                before += r.choice(["", "", assigned, "key "])
            else:
                key = {"random": lambda: pick(r.choice([hexa, alnum, string.ascii_letters]), r.randint(16, 48)), "chosen": lambda: _chosen(pick, words, r), "stand-in": lambda: _stand_in(words, r)}[kind]()
                before += assigned
            out.append((key, before[-AROUND:], after[:AROUND], r.choice(paths), i % 2))
            continue
        case = lambda x: x.upper() if r.random() < 0.15 else x
        if i % 2:
            key = r.choice([lambda: case(pick(hexa, r.choice([32, 40, 64]))), lambda: pick(alnum, r.randint(20, 48)), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(alnum, 36), lambda: "sk_live_" + pick(alnum, 24), lambda: pick(alnum + "+/", 40), lambda: pick(alnum + "!@#", r.randint(8, 16))])()
            name = case(r.choice(KEYWORDS[:-1]))
            mark = r.choice(['"', "'"])
            formatted = key.startswith(("AKIA", "ghp_", "sk_live_"))
            if formatted and r.random() < 0.4:
                before, after = prose(), " " + prose()
            else:
                before, after = prose() + name + r.choice([" = ", "=", ": ", " => "]) + mark, mark + " " + prose()
        else:
            key = r.choice([lambda: pick(string.digits, r.choice([16, 16, 18, 20])), lambda: "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: pick(hexa, r.choice([32, 40, 64])), lambda: "_".join(r.choice(words) for _ in range(4)) + str(r.randint(0, 99)), lambda: "/".join(r.choice(words) for _ in range(4)) + "/" + str(r.randint(0, 9999)), lambda: r.choice(words) + pick(string.ascii_lowercase, 12) + str(r.randint(0, 9)), lambda: r.choice(["changeme", "password", "example1", "your_token_here1", "placeholder-key-1"])])()
            before = prose() + r.choice(["", "", "commit ", "sha1 ", "checksum: ", "uuid=", "id: ", "version "])
            after = r.choice([" ", ". ", ""]) + prose()
            if key.isalpha() or key.startswith(("your", "place", "example")):
                before, after = prose() + 'password = "', '" ' + prose()
        out.append((key, before[-AROUND:], after[:AROUND], r.choice(paths), i % 2))
    return out


class Forest:
    """Random forest in arrays: bootstrap rows, sqrt of the features at each split, Gini impurity."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]) -> None:
        self.trees = trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, seed: int = 5) -> Forest:
        rng, trees = np.random.default_rng(seed), []
        for _ in range(TREES):
            rows = rng.integers(0, len(x), len(x))
            nodes: list[list[float]] = []

            def grow(own: np.ndarray, depth: int, nodes=nodes) -> int:
                at = len(nodes)
                nodes.append([-1, 0.0, -1, -1, float(y[own].mean())])
                if depth == DEPTH or len(own) < 2 * LEAST or y[own].min() == y[own].max():
                    return at
                best = None
                for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1]))), replace=False):
                    order = np.argsort(x[own, f], kind="stable")
                    v, ones = x[own[order], f], np.cumsum(y[own[order]])
                    k = np.arange(1, len(own))
                    ok = (v[1:] > v[:-1]) & (k >= LEAST) & (len(own) - k >= LEAST)
                    if not ok.any():
                        continue
                    a, b = ones[:-1], ones[-1] - ones[:-1]
                    cost = np.where(ok, a - a * a / k + b - b * b / (len(own) - k), np.inf)
                    i = int(cost.argmin())
                    if best is None or cost[i] < best[0]:
                        best = cost[i], int(f), (v[i] + v[i + 1]) / 2
                if best is None:
                    return at
                left = x[own, best[1]] <= best[2]
                nodes[at][0], nodes[at][1] = best[1], best[2]
                nodes[at][2] = grow(own[left], depth + 1)
                nodes[at][3] = grow(own[~left], depth + 1)
                return at

            grow(rows, 0)
            m = np.array(nodes)
            trees.append((m[:, 0].astype(np.int64), m[:, 1], m[:, 2].astype(np.int64), m[:, 3].astype(np.int64), m[:, 4]))
        return cls(trees)

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                at = np.where(f < 0, at, np.where(x[rows, np.maximum(f, 0)] <= cut[at], left[at], right[at]))
            total += value[at]
        return total / len(self.trees)


def train(findings: DataFrame | None = None, sample: int = SAMPLE) -> Forest:
    """A forest from findings (candidate, before, after, path, label), the first `sample` by hash."""
    if findings is None:
        rows = generated_findings()
    else:
        some = findings.filter("candidate is not null and candidate <> '' and label is not null")
        some = some.orderBy(F.xxhash64("candidate", "before", "after", "path"), "candidate", "before").limit(sample)
        rows = [(r.candidate, r.before or "", r.after or "", r.path or "", int(r.label)) for r in some.collect()]
    return Forest.fit(np.array([features(*r[:4]) for r in rows]), np.array([r[4] for r in rows], np.float64))


_FINDING = "array<struct<start:int,length:int,score:double,secret:boolean>>"


def scan(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, findings (start and length in code points, score, secret) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(path_col).alias("path"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64()), ("secret", pa.bool_())]))

    def apply(batches):
        model = shared.value
        for batch in batches:
            for a, b in slices(utf8(batch.column(1))[1], 4 << 20):
                part = batch.slice(a, b - a)
                spans, x = [], []
                for text, path in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    own = list(candidates(text)) if text else []
                    spans.append(own)
                    x += [features(text[i:j], text[max(0, i - AROUND) : i], text[j : j + AROUND], path or "") for i, j in own]
                p = model.predict(np.array(x)).tolist() if x else []
                at, found = 0, []
                for own in spans:
                    found.append([{"start": i, "length": j - i, "score": s, "secret": s >= threshold} for (i, j), s in zip(own, p[at : at + len(own)], strict=True)])
                    at += len(own)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["doc_id", "findings"])

    return rows.mapInArrow(apply, StructType([rows.schema["doc_id"], *StructType.fromDDL(f"findings {_FINDING}")]))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_candidates, n_secrets, secrets (their spans)."""
    out = scan(docs, train())
    secrets = F.filter("findings", lambda f: f["secret"])
    spans = F.transform(secrets, lambda f: F.struct(f["start"].alias("start"), f["length"].alias("length")))
    return out.select("doc_id", F.size("findings").cast("long").alias("n_candidates"), F.size(secrets).cast("long").alias("n_secrets"), spans.alias("secrets"))
