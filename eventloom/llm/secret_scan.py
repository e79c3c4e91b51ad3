"""Secret scans: candidates by pattern, false positives removed by a random forest.

Everything on the data's way is a Catalyst expression within the row: one regular expression marks the candidates, the
marked text is split, each odd part becomes an array of features, and the forest, shipped as three literal arrays, is
walked level by level. There is no shuffle and no state, for scanning as for redacting, and the work on a text is linear
in its length (finding the offsets of k candidates takes k times the root of k).

Before that, ``learn_words`` counts the words of the whole corpus with map-side aggregation. From them come the
log-likelihoods of neighbouring characters and the dictionary (the commonest ``words`` words). The forest is trained on
the driver from labelled findings, (value, before, after, path, label) rows of a bounded number. The tables hold no
labelled findings, so ``labelled_findings`` makes ``rows`` of them by rule, with neighbouring words and paths of the
corpus; pass findings of your own to ``learn`` instead.

Defined results: null and empty texts have no candidates; the control characters used as marks count as ordinary
characters in a text; repeated rows are scanned alike; a null path has no path features; extra columns stay untouched,
whatever their names; an empty corpus gives an even character table and an empty dictionary. Offsets are code points,
ends exclusive.
"""

from __future__ import annotations

import base64
import math
import random
import string
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.durable import durable
from eventloom.llm.sqltext import let

OPEN, CLOSE, AWAY = "\x01", "\x02", "\x03"
#: Words before a value that is assigned.
KEY_WORDS = "passwords?|passwd|passphrase|pwd|secrets?|tokens?|api[_ -]?keys?|access[_ -]?keys?|private[_ -]?keys?|client[_ -]?secret|auth(?:orization)?|credentials?|bearer"
_PEM = r"[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
#: Shapes of well-known credentials, each as its first signs and the rest. A private key goes on through its
#: END line; if there is none before the next key or the end of the text, through the header and key lines that follow.
_SHAPES = {
    "aws_key": ("(?:AKIA|ASIA)", "[0-9A-Z]{16}"),
    "git_token": ("gh[pousr]_", "[A-Za-z0-9]{36,}"),
    "chat_token": ("xox[abprs]-", "[A-Za-z0-9-]{10,}"),
    "pay_key": ("[sr]k_(?:live|test)_", "[A-Za-z0-9]{16,}"),
    "map_key": ("AIza", "[0-9A-Za-z_-]{35}"),
    "jwt": ("eyJ", r"[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "private_key": (
        "-----BEGIN ",
        rf"{_PEM}(?:(?>[\s\S]*?(?=-----BEGIN |-----END ))-----END {_PEM}"
        r"|(?:\s{1,4}[A-Za-z-]{1,40}:[^\n]*)*+(?:(?:\s|\\[nr]){0,4}[A-Za-z0-9+/=]{32,})*+(?:(?:\s|\\[nr]){1,4}[A-Za-z0-9+/=]+(?=\s*\z))?)",
    ),
}
SHAPES = {name: first + rest for name, (first, rest) in _SHAPES.items()}
_TOKEN = "A-Za-z0-9+/_-"
_ASSIGNED = rf"(?:{KEY_WORDS})[\"']?[\x20\t]{{0,3}}(?:=>|:=|=|:)[\x20\t]{{0,3}}[\"']?"
#: What stands before the password of a connection address.
_LOGIN = r"://[^\s/:@\"'\x01\x02]*+:"
#: The candidates: assigned values, passwords of addresses, known shapes, and tokens of letters and digits.
CANDIDATE = (
    rf"((?i:{_ASSIGNED}))({SHAPES['private_key']}|[^\s\"'\x01\x02]{{6,}})"
    rf"|({_LOGIN})([^\s/@\"'\x01\x02]{{3,}}+)(?=@)"
    rf"|({'|'.join(SHAPES.values())})"
    rf"|(?<![{_TOKEN}])((?=[{_TOKEN}]*[0-9])(?=[{_TOKEN}]*[A-Za-z])[{_TOKEN}]{{20,}}={{0,2}})"
)
#: A text with none of these signs has no candidate: assigned values and addresses hold = or :, other tokens a digit.
NEEDED = "[0-9=:]|" + "|".join(first for first, _ in _SHAPES.values())

#: Words that stand for a value, and words whose nearness speaks for or against one.
STAND_INS = "example|sample|dummy|fake|placeholder|change.?me|your|here|password|passwd|secret|token|admin|default|null|none|true|false|foo|bar|todo|xxxx+|\\*{3,}|1234+|[<>{}$]|\\.get|environ|config"
FOR_WORDS = "password|passwd|pwd|passphrase|secret|token|api|key|access|auth|credential|bearer|private|login|aws"
AGAINST_WORDS = "example|sample|sha|sha1|sha256|sha512|md5|checksum|digest|hash|commit|revision|uuid|guid|etag|integrity|fingerprint|build|isbn|doi|id|version|placeholder|dummy|fake|test"
AGAINST_PATH = "test|example|sample|fixture|mock|spec|doc|readme|tutorial|lock"
FOR_PATH = "\\.env|\\.pem|\\.key|\\.ya?ml|\\.ini|\\.cfg|\\.conf|\\.tf|config|secret|deploy"
#: Code points of a value's neighbourhood that the forest sees on either side.
BEFORE, AFTER = 60, 40

FEATURES = (
    "length", "digits", "uppers", "changes", "transitions", "distinct", "hex", "longest", "dictionary", "stand_ins", "assigned", "login", "shaped",
    "near_for", "near_against", "path_for", "path_against", "separators",
)

#: Characters that are told apart in transitions; all others are one class, 0. Digits are one class, too.
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + "0"
_CLASSES = len(ALPHABET) + 1
#: Words of the dictionary.
WORDS = 3000
#: Labelled findings that are made for training.
FINDINGS = 9000


@dataclass(frozen=True)
class Language:
    """Log-likelihood of a character after another, row by row, and the commonest words of the corpus."""

    transitions: tuple[float, ...]
    words: tuple[str, ...]


def learn_words(docs: DataFrame, text: str = "text", words: int = WORDS) -> Language:
    """The language of all texts: one aggregation by word, written once, then two small ones over the words."""
    counts = durable(docs.select(F.explode(F.split(F.col(text), "[^A-Za-z]+")).alias("w")).where(F.length("w") > 1).groupBy("w").agg(F.count("*").alias("n")))
    low = durable(counts.where(F.length("w") > 2).groupBy(F.lower("w").alias("w")).agg(F.sum("n").alias("n")))
    # the least count that leaves about as many words as are wanted, so that few rows are sorted for the exact ones
    level = F.floor(F.log2("n") * 8).cast("int")
    left, least = words, 0
    for r in low.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        left, least = left - r["count"], r.level
        if left <= 0:
            break
    top = low.where(level >= least).orderBy(F.desc("n"), "w").limit(words)
    ends = F.transform(F.split("w", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = counts.select("n", ends.alias("c")).select("n", F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: a * _CLASSES + b)).alias("p"))
    pairs = pairs.groupBy("p").agg(F.sum("n").alias("n"))
    # at most ``words`` and 2,704 rows
    rows = top.select("w", "n").unionByName(pairs.select(F.col("p").cast("string").alias("w"), "n")).collect()
    table = np.ones((_CLASSES, _CLASSES))
    found = []
    for w, n in rows:
        if w[0].isdigit():
            table[divmod(int(w), _CLASSES)] += n
        else:
            found.append((-n, w))
    logs = np.log(table[1:, 1:] / table[1:, 1:].sum(1, keepdims=True))
    out = np.full((_CLASSES, _CLASSES), float(logs.mean()))
    out[1:, 1:] = logs
    return Language(tuple(out.round(3).ravel().tolist()), tuple(w for _, w in sorted(found)))


def _literal(values: Sequence, kind: str) -> Column:
    """An array of numbers as one literal; the optimiser folds it."""
    return F.split(F.lit(" ".join(map(str, values))), " ").cast(f"array<{kind}>")


def features(value: Column, before: Column, after: Column, path: Column, language: Language) -> Column:
    """The forest's view of a candidate: doubles in order of FEATURES."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    near = F.lower(F.concat_ws(" ", before, after))
    classes = F.transform(F.split(F.translate(value, "123456789", "000000000"), ""), lambda c: F.instr(F.lit(ALPHABET), c))
    table = _literal(language.transitions, "double")
    steps = lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.get(table, a * _CLASSES + b))
    likely = let(classes, lambda c: F.when(F.size(c) > 1, F.aggregate(steps(c), F.lit(0.0), lambda s, x: s + x) / (F.size(c) - 1)))
    own = F.split(F.lower(F.regexp_replace(value, "([a-z])([A-Z])", "$1 $2")), "[^a-z]+")
    known = F.aggregate(F.filter(own, lambda w: w.isin(*(language.words or ("",)))), F.lit(0), lambda s, w: s + F.length(w))
    columns = {
        "length": n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "changes": share("[a-z][A-Z0-9]|[A-Z][a-z0-9]|[0-9][A-Za-z]"),
        "transitions": likely,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "hex": flag(F.rlike(value, F.lit("^[0-9a-fA-F]+$"))),
        "longest": F.array_max(F.transform(F.split(value, "[^A-Za-z]+"), F.length)) / n,
        "dictionary": known / n,
        "stand_ins": (n - F.length(F.regexp_replace(F.lower(value), STAND_INS, ""))) / n,
        "assigned": flag(F.rlike(before, F.lit(rf"(?i)(?:{_ASSIGNED})$"))),
        "login": flag(F.rlike(before, F.lit(rf"{_LOGIN}$")) & F.startswith(after, F.lit("@"))),
        "shaped": flag(F.rlike(value, F.lit("^(?:" + "|".join(SHAPES.values()) + ")"))),
        "near_for": flag(F.rlike(near, F.lit(rf"(?<![a-z])(?:{FOR_WORDS})(?![a-z])"))),
        "near_against": flag(F.rlike(near, F.lit(rf"(?<![a-z])(?:{AGAINST_WORDS})(?![a-z])"))),
        "path_for": flag(F.rlike(F.lower(path), F.lit(FOR_PATH))),
        "path_against": flag(F.rlike(F.lower(path), F.lit(AGAINST_PATH))),
        "separators": share("[/_.:-]"),
    }
    return F.array(*[F.coalesce(columns[k], F.lit(0.0)).cast("double") for k in FEATURES])


#: Words around values in findings that are made.
_KEYS = ("password", "token", "api_key", "secret", "Password", "access_key", "client_secret", "auth", "passwd", "Authorization")
_SAID = ("commit", "sha256", "checksum", "digest", "uuid", "md5", "integrity", "build", "etag", "revision")
_STAND_INS = ("changeme123", "your_password_here", "example_password", "xxxxxxxxxxxx", "********", "password123", "test_token_value", "dummy-secret-1234", "YOUR_API_KEY_HERE", "placeholder", "<your-token>", "${PASSWORD}", "none-default", "null-value", "os.environ", "config.get(name)")
_PATHS = ("config/prod.env", "deploy/app.yml", "server/settings.py", "web/crawl", "tests/fixtures/a.json", "docs/readme.md", "examples/app.py", "src/main.py", None)


def labelled_findings(words: Sequence[str] = (), paths: Sequence[str | None] = (), rows: int = FINDINGS, seed: int = 7) -> list[tuple]:
    """``rows`` of (value, before, after, path, label), secrets and look-alikes by rule, amid the given words and paths."""
    rng = random.Random(seed)
    words = list(words) or ["the", "over", "tion", "ing", "ment", "les", "ver"]
    paths = [*_PATHS, *paths]
    letters, upper = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    some = lambda signs, a, b: "".join(rng.choices(signs, k=rng.randint(a, b)))
    hexes = lambda a, b: some("0123456789abcdef", a, b)
    packed = lambda a, b: base64.b64encode(rng.randbytes(rng.randint(a, b))).decode()
    word = lambda: rng.choice(words)
    prose = lambda: " ".join(word() for _ in range(rng.randint(2, 8)))
    keyed = lambda: f"{prose()} {rng.choice(_KEYS)}{rng.choice(['=', ': ', ' = ', '=' + chr(34), ': ' + chr(39), ' := '])}"
    plain = lambda: f"{prose()} "
    said = lambda: f"{prose()} {rng.choice(_SAID)}{rng.choice([' ', ': ', '=', '-'])}"
    named = lambda: f"{prose()} {rng.choice(['key', 'bearer', 'secret', 'token', 'Bearer', 'login with', 'AWS key'])} "
    login = lambda: f"{prose()} {rng.choice(['postgres', 'mysql', 'https', 'amqp', 'redis'])}://{rng.choice(['admin', 'root', word(), 'app_' + word(), ''])}:"
    strong = lambda: rng.choice([word() + rng.choice("!#_-.$") + str(rng.randint(10, 9999)) + some(upper, 0, 3), some(letters, 8, 20), some(letters + "!#%&*+?^~", 8, 24), some(string.ascii_lowercase, 9, 20), word() + str(rng.randint(0, 99)) + rng.choice(["secret", "pass", "admin", "Secret!", "key"]), word().title() + word() + str(rng.randint(0, 999)) + rng.choice("!?#")])

    def pem() -> str:
        kind, body = rng.choice(["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "]), packed(120, 900)
        lines = "\n".join(body[i : i + 64] for i in range(0, len(body), 64))
        return f"-----BEGIN {kind}PRIVATE KEY-----\n{lines}" + rng.choice([f"\n-----END {kind}PRIVATE KEY-----", ""])

    shaped = (
        lambda: rng.choice(["AKIA", "ASIA"]) + rng.choice([some(upper, 16, 16), some(string.ascii_uppercase, 16, 16), "".join(sorted(rng.sample(string.ascii_uppercase, 16)))]),
        lambda: f"gh{rng.choice('pousr')}_" + some(rng.choice([letters, string.ascii_letters]), 36, 60),
        lambda: f"xox{rng.choice('abprs')}-" + rng.choice([some(letters, 12, 40), some(string.ascii_lowercase, 12, 30), "-".join([some(string.digits, 10, 12), some(string.digits, 10, 12), some(letters, 24, 24)])]),
        lambda: f"{rng.choice('sr')}k_live_" + some(rng.choice([letters, string.ascii_letters, string.ascii_lowercase]), 16, 40),
        lambda: "AIza" + some(letters + "_-", 35, 35),
        lambda: "eyJ" + ".".join(some(rng.choice([letters + "_-", string.ascii_letters]), a, b) for a, b in ((8, 60), (8, 600), (8, 60))),
        pem,
    )
    assigned = (
        lambda: hexes(12, 64), lambda: packed(9, 48).rstrip("="), lambda: packed(80, 600), strong, strong,
        lambda: f"eyJ{some(letters, 20, 60)}.{some(letters, 60, 500)}.{some(letters, 43, 43)}",
    )
    secrets = (
        *[(value, (plain, keyed, named, said)) for value in shaped],
        *[(value, (keyed,)) for value in assigned],
        (strong, (login,)),
        (strong, (login,)),
        (lambda: some(letters, 28, 64), (named,)),
    )
    false = (
        (lambda: hexes(40, 40), (said, said, plain)),
        (lambda: hexes(64, 64), (said,)),
        (lambda: hexes(32, 32), (said,)),
        (lambda: "-".join(hexes(k, k) for k in (8, 4, 4, 4, 12)), (plain, said)),
        (lambda: rng.choice(_STAND_INS), (keyed, login)),
        (lambda: rng.choice(["AKIA" + "X" * 16, "AKIAEXAMPLE" + some(upper, 9, 9), "ghp_" + "x" * 36, "sk_test_" + "1234" * 6, "xoxb-your-token-here", "xoxb-example-" + word() + "-token", "AIza" + "x" * 35]), (plain, keyed, named)),
        (lambda: f"{word()}_{word()}_{rng.randint(0, 99)}_{word()}_{word()}", (plain,)),
        (lambda: f"{word()}/{word()}/{word()}-{word()}-{rng.randint(0, 3000)}", (plain, said)),
        (lambda: "-".join(word() for _ in range(12)) + f"-{rng.randint(0, 3000)}", (plain,)),
        (lambda: f"20{rng.randint(10, 35)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}-" + "-".join(word() for _ in range(3)), (plain,)),
        (lambda: "".join(word().title() for _ in range(rng.randint(3, 6))) + str(rng.randint(1, 9)), (plain, named)),
        (lambda: (word() + word())[: rng.randint(6, 14)] + rng.choice([",", ".", "", ";"]), (keyed,)),
        (lambda: f"{word()}.{word()}({word()})", (keyed,)),
        (lambda: f"{word()}_{word()}", (keyed, login)),
    )
    out = []
    for i in range(rows):
        cases, label = (secrets, 1.0) if i % 2 else (false, 0.0)
        value, contexts = cases[(i // 2) % len(cases)]
        around = rng.choice(contexts)
        head, tail = around(), f" {prose()}"
        if around is login:
            tail = f"@{word()}.{word()}/{word()} {prose()}"
        elif head[-1] in "\"'":
            tail = head[-1] + tail
        out.append((value(), head[-BEFORE:], tail[:AFTER], rng.choice(paths), label))
    return out


@dataclass(frozen=True)
class Forest:
    """Full binary trees of one depth, one after the other: the feature and threshold of each inner node, the share of
    secrets of each leaf. A value beyond the threshold goes right."""

    depth: int
    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    leaf: tuple[float, ...]

    def score(self, view: Column) -> Column:
        inner, leaves = 2**self.depth - 1, 2**self.depth
        trees = len(self.leaf) // leaves
        feature, threshold, leaf = _literal(self.feature, "int"), _literal(self.threshold, "double"), _literal(self.leaf, "double")

        def of(tree: Column, v: Column) -> Column:
            right = lambda i: (F.get(v, F.get(feature, tree * inner + i)) > F.get(threshold, tree * inner + i)).cast("int")
            end = F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(0), lambda i, _: 2 * i + 1 + right(i))
            return F.get(leaf, tree * leaves + end - inner)

        return let(view, lambda v: F.aggregate(F.sequence(F.lit(0), F.lit(trees - 1)), F.lit(0.0), lambda s, t: s + of(t, v)) / float(trees))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 7, seed: int = 7, share: float = 0.5, least: int = 5, bins: int = 32) -> Forest:
    """A random forest: each tree on a bootstrap sample, each node on the best Gini split of a random share of features."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    inner, tried = 2**depth - 1, max(1, round(share * x.shape[1]))
    feature, threshold, leaf = [], [], []
    for _ in range(trees):
        drawn = rng.integers(0, len(y), len(y))
        rows, f, t, p = {0: drawn}, [0] * inner, [1e300] * inner, [0.0] * (2 * inner + 1)
        for node in range(2 * inner + 1):
            own = rows.pop(node, drawn[:0])
            p[node] = float(y[own].mean()) if len(own) else p[(node - 1) // 2] if node else 0.0
            if node >= inner:
                continue
            best, at = 0.0, None
            if len(own) >= 2 * least and 0 < p[node] < 1:
                for j in rng.choice(x.shape[1], tried, replace=False):
                    n = np.bincount(codes[own, j], minlength=bins)[:-1].cumsum()
                    good = np.bincount(codes[own, j], weights=y[own], minlength=bins)[:-1].cumsum()
                    other, rest = len(own) - n, y[own].sum() - good
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = good**2 / n + (n - good) ** 2 / n + rest**2 / other + (other - rest) ** 2 / other
                    gain[(n < least) | (other < least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, at = float(gain[k]), (int(j), k)
            if at is None or best <= len(own) * (p[node] ** 2 + (1 - p[node]) ** 2) + 1e-9:
                rows[2 * node + 1] = own  # every value goes left
                continue
            f[node], t[node] = at[0], float(edges[at[0]][min(at[1], len(edges[at[0]]) - 1)])
            left = codes[own, at[0]] <= at[1]
            rows[2 * node + 1], rows[2 * node + 2] = own[left], own[~left]
        feature += f
        threshold += t
        leaf += p[inner:]
    return Forest(depth, tuple(feature), tuple(threshold), tuple(round(v, 5) for v in leaf))


@dataclass(frozen=True)
class Scanner:
    language: Language
    forest: Forest


_FINDING = "value string, before string, after string, path string, label double"


def views(findings: DataFrame, language: Language) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of labelled findings, on the driver."""
    rows = findings.select(features(F.col("value"), F.col("before"), F.col("after"), F.col("path"), language).alias("v"), "label").collect()
    return np.array([r.v for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.label for r in rows])


def learn(spark: SparkSession, language: Language, findings: DataFrame | None = None, **how) -> Scanner:
    """The scanner of labelled findings (value, before, after, path, label), made ones unless some are given; the caller
    bounds their number."""
    if findings is None:
        findings = spark.createDataFrame(labelled_findings(language.words), _FINDING)
    return Scanner(language, grow(*views(findings, language), **how))


def learn_from(docs: DataFrame, text: str = "text") -> Scanner:
    """The scanner whose language is that of the documents."""
    return learn(docs.sparkSession, learn_words(docs, text))


def _marked_parts(text: Column) -> Column:
    """The text in parts: plain at even places, candidates at odd ones. Marks of its own are written another way meanwhile."""
    away = {AWAY: AWAY + "\x04", OPEN: AWAY + "\x05", CLOSE: AWAY + "\x06"}  # with signs that no token has
    raw = F.coalesce(text, F.lit(""))

    def away_from(t: Column) -> Column:
        own = t
        for sign, name in away.items():
            own = F.replace(own, F.lit(sign), F.lit(name))
        return F.when(F.rlike(t, F.lit(f"[{OPEN}{CLOSE}{AWAY}]")), own).otherwise(t)

    def back(part: Column) -> Column:
        for sign, name in reversed(away.items()):
            part = F.replace(part, F.lit(name), F.lit(sign))
        return part

    def parts_of(marked: Column) -> Column:
        parts = F.split(marked, f"[{OPEN}{CLOSE}]", -1)
        return F.when(F.contains(marked, F.lit(AWAY)), F.transform(parts, back)).otherwise(parts)

    marked = let(away_from(raw), lambda t: F.regexp_replace(t, CANDIDATE, f"$1$3{OPEN}$2$4$5$6{CLOSE}"))
    return F.when(F.rlike(raw, F.lit(NEEDED)), let(marked, parts_of)).otherwise(F.array(raw))


def _starts(parts: Column):
    """What gives the code point at which part i starts: sums of blocks of about root-many parts, then of single ones."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    sizes, block = F.transform(parts, F.length), F.ceil(F.sqrt(F.size(parts))).cast("int")
    whole = lambda n, b: F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / b).cast("int")), lambda j: total(F.slice(n, j * b + 1, b)))
    heads = lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda j: total(F.slice(s, F.lit(1), j)))
    both = let(F.struct(sizes.alias("n"), block.alias("b")), lambda x: F.struct(x.n.alias("n"), x.b.alias("b"), let(whole(x.n, x.b), heads).alias("h")))
    return both, lambda x, i: F.get(x.h, F.floor(i / x.b).cast("int")) + total(F.slice(x.n, F.floor(i / x.b).cast("int") * x.b + 1, i % x.b))


def _kind(value: Column, assigned: Column) -> Column:
    out = F.when(assigned > 0, "assigned").otherwise("token")
    for name, shape in reversed(SHAPES.items()):
        out = F.when(F.rlike(value, F.lit("^" + shape)), name).otherwise(out)
    return out


def _scored(parts: Column, i: Column, path: Column, scanner: Scanner) -> Column:
    """kind, score of the candidate at part i."""
    value, before, after = F.get(parts, i), F.right(F.get(parts, i - 1), F.lit(BEFORE)), F.left(F.get(parts, i + 1), F.lit(AFTER))
    at = {name: k for k, name in enumerate(FEATURES)}
    view = features(value, before, after, path, scanner.language)
    return let(view, lambda v: F.struct(_kind(value, F.greatest(v[at["assigned"]], v[at["login"]])).alias("kind"), scanner.forest.score(v).alias("score")))


def findings(text: Column, path: Column, scanner: Scanner, threshold: float = 0.5) -> Column:
    """Array of (start, end, kind, score, is_secret), one for each candidate in order."""

    def all_of(parts: Column) -> Column:
        places, start = _starts(parts)

        def one(i: Column, x: Column) -> Column:
            at = start(x, i)
            return F.struct(at.alias("start"), (at + F.length(F.get(parts, i))).alias("end"), _scored(parts, i, path, scanner).alias("s"))

        odd = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i % 2 == 1)
        found = let(places, lambda x: F.transform(odd, lambda i: one(i, x)))
        return F.transform(found, lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.s.kind.alias("kind"), x.s.score.alias("score"), (x.s.score >= threshold).alias("is_secret")))

    return let(_marked_parts(text), all_of)


def scan(docs: DataFrame, scanner: Scanner, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """doc_id, start, end, kind, score, is_secret: one row for each candidate of each row."""
    at = docs.select(F.col(doc_id).alias("doc_id"), F.explode(findings(F.col(text), F.col(path), scanner)).alias("f"))
    return at.select("doc_id", "f.*")


def redacted(text: Column, path: Column, scanner: Scanner, mark: str = "<SECRET>", threshold: float = 0.5) -> Column:
    """The text with every secret replaced by the mark; null stays null."""
    hide = lambda parts: F.array_join(F.transform(parts, lambda x, i: F.when((i % 2 == 1) & (_scored(parts, i, path, scanner).score >= threshold), F.lit(mark)).otherwise(x)), "")
    return F.when(F.rlike(text, F.lit(NEEDED)), let(_marked_parts(text), hide)).otherwise(text)


def redact(docs: DataFrame, scanner: Scanner, text: str = "text", path: str = "source", mark: str = "<SECRET>") -> DataFrame:
    """docs with every secret of the text replaced by the mark."""
    return docs.withColumn(text, redacted(F.col(text), F.col(path), scanner, mark))
