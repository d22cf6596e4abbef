"""Secret scanning with a random forest that removes false positives, as SQL expressions.

Candidates are all runs of 16 or more key characters, with digits or without, and tokens in dotted
parts that begin as such tokens do. Each is described by its length,
character shares and transitions, dictionary coverage, its path and the words around it. A random
forest trained on labelled findings scores it. The forest is fitted on the driver on a bounded number of
labelled rows and becomes one constant of arrays that a higher-order expression walks, so scanning is
a projection: no shuffle, no Python.

The words around a candidate are the text before and after it in its word, three words before and two
behind; of a longer stretch the NEAR characters nearest to the candidate.

Defined cases: a null or empty text has no candidates; a null path is an unknown path; repeated rows
are scanned each; a word may hold several candidates; extra columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most so many labelled rows are fitted, whatever is given.
FIT_ROWS = 4000
#: How far each stretch of text about a candidate reaches.
NEAR = 200
RUN = r"(?:\b(?:SG|eyJ[A-Za-z0-9_-]{3,})\.[A-Za-z0-9_.-]{15,}[A-Za-z0-9_-]|[A-Za-z0-9_+/-]{16,}={0,2})"
FEATURES = ("length", "digits", "uppers", "lowers", "signs", "transitions", "variety", "hex", "coverage", "vowels", "known_prefix", "telling_words", "harmless_words", "test_path", "assigned", "quoted")
# Fragments of identifiers, paths and prose that cover a candidate which is no key.
DICTIONARY = "access account action address admin api app array auth batch block body button cache change client cloud code com common config connect content core create custom data date debug default delete demo doc document down edit email enable error example file filter fold for form function get handler hash hello home host html http import index insert java json key label last link load local lock login make manager map menu message method model module name native next not null number object old option output package page param parent parse password path pattern permission player plugin port position post print private process product profile program project property public query queue random range read record ref remove render replace report request reset resource response result return root sample save scan schema scope script search second section secret select self send sequence server service session setting share show simple source space start static status store stream string style system table target task temp template test text theme this title token tool type update url user version view window with word work write xml your".split()
TELLING = "api_?key|apikey|access_?key|secret|token|passw(or)?d|pwd|auth|bearer|credential|private|client_secret|signature"
HARMLESS = "example|sample|dummy|placeholder|changeme|uuid|guid|commit|revision|sha-?[0-9]*|md5|checksum|digest|etag|integrity|version|card|order|invoice|tracking|isbn|phone|issue|build"
TESTS = "test|example|sample|fixture|mock|docs?/|demo|spec"
KNOWN = "^(AKIA|ASIA|ghp_|gho_|ghs_|glpat-|xox[abp]-|sk_live_|rk_live_|AIza|SG\\.|npm_|pypi-|eyJ)"


@dataclass(frozen=True)
class Forest:
    trees: tuple[dict[str, list], ...]

    def score(self, x: Column) -> Column:
        """The mean leaf value of an array of features."""
        kind = "array<struct<f:array<int>,v:array<double>,l:array<int>,r:array<int>,p:array<double>,d:int>>"
        trees = F.from_json(F.lit(json.dumps(self.trees)), kind)

        def leaf(t: Column) -> Column:
            def down(n: Column, _: Column) -> Column:
                return F.when(t["f"][n] < 0, n).when(x[F.greatest(t["f"][n], F.lit(0))] <= t["v"][n], t["l"][n]).otherwise(t["r"][n])

            return t["p"][F.aggregate(F.sequence(F.lit(1), t["d"]), F.lit(0), down)]

        return F.aggregate(F.transform(trees, leaf), F.lit(0.0), lambda a, p: a + p) / len(self.trees)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def features(candidate: Column, around: Column, path: Column) -> Column:
    """The array of FEATURES of a candidate; around: the words about it, path: where it was found."""
    size = F.greatest(F.char_length(candidate), F.lit(1)).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(candidate, F.lit(pattern)) / size

    shape = candidate
    for pattern, sign in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "9"), ("[^aA9]+", "-")):
        shape = F.regexp_replace(shape, pattern, sign)
    low, words, place = F.lower(candidate), F.lower(F.coalesce(around, F.lit(""))), F.lower(F.coalesce(path, F.lit("")))
    longest_first = "|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w)))
    flags = [candidate.rlike("^[0-9a-fA-F-]+$"), candidate.rlike(KNOWN), words.rlike(TELLING), words.rlike(rf"\b({HARMLESS})\b"), place.rlike(TESTS), words.rlike("[=:]"), words.rlike("[\"'`]")]
    hexed, known, telling, harmless, tested, assigned, quoted = (f.cast("double") for f in flags)
    return F.array(
        size, share("[0-9]"), share("[A-Z]"), share("[a-z]"), share("[^A-Za-z0-9]"), (F.char_length(shape) - 1) / size,
        F.size(F.array_distinct(F.split(low, ""))) / size, hexed, 1 - F.char_length(F.regexp_replace(low, longest_first, "")) / size,
        share("[aeiouAEIOU]"), known, telling, harmless, tested, assigned, quoted,
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, path, word_no, place in the word, candidate and the words around it."""
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").rlike(RUN))
    df = _once(df, words=F.split("text", r"[ \t\n\x0B\f\r]+")).drop("text")
    found = F.filter(F.transform("words", lambda w, i: F.when((F.char_length(w) >= 16) & w.rlike(RUN), i)), lambda i: i.isNotNull())
    df = df.select("doc_id", "path", "words", F.explode(found).alias("word_no"))
    word = F.col("words")[F.col("word_no")]
    before = F.transform(F.slice("words", F.greatest(F.col("word_no") - 2, F.lit(1)), F.least(F.lit(3), F.col("word_no"))), lambda w: F.right(w, F.lit(NEAR)))
    behind = F.transform(F.slice("words", F.col("word_no") + 2, F.lit(2)), lambda w: F.left(w, F.lit(NEAR)))
    # the k-th run stands between the k-th gap and the next; a run has 16 characters or more, so a few cover NEAR
    df = _once(df, runs=F.regexp_extract_all(word, F.lit(f"({RUN})"), F.lit(1)), gaps=F.split(word, RUN, -1), before=before, behind=behind).drop("words")
    df = _once(df, pieces=F.zip_with("gaps", "runs", lambda g, r: F.concat(g, F.coalesce(r, F.lit("")))))
    most = NEAR // 16 + 1

    def found_at(run: Column, i: Column) -> Column:
        left = F.concat(F.array_join(F.slice("pieces", F.greatest(i - most, F.lit(0)) + 1, F.least(i, F.lit(most))), ""), F.col("gaps")[i])
        right = F.array_join(F.slice("pieces", i + 2, F.lit(most + 1)), "")
        return F.struct(run.alias("candidate"), F.concat_ws(" ", F.col("before"), F.right(left, F.lit(NEAR)), F.left(right, F.lit(NEAR)), F.col("behind")).alias("around"))

    df = df.select("doc_id", "path", "word_no", F.posexplode(F.transform("runs", found_at)).alias("nth", "found"))
    return df.select("doc_id", "path", "word_no", "found.around", "nth", "found.candidate")


def scan_secrets(docs: DataFrame, forest: Forest | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", least: float = 0.5) -> DataFrame:
    """Every candidate of every document with its score; is_secret at a score of `least` or more."""
    model = forest or default_forest(docs.sparkSession)
    df = _once(candidates(docs, id_col, text_col, path_col), x=features(F.col("candidate"), F.col("around"), F.col("path")))
    df = _once(df, score=F.round(model.score(F.col("x")), 6))
    return df.select("doc_id", "word_no", "nth", F.char_length("candidate").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", (F.col("score") >= least).alias("is_secret"), "candidate", "around", "path")


def train_forest(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 7, leaf: int = 4, seed: int = 7) -> Forest:
    """Bootstrap samples, a square-root draw of features at each node, Gini splits."""
    rng = np.random.default_rng(seed)
    x, y = np.asarray(x, float)[:FIT_ROWS], np.asarray(y, float)[:FIT_ROWS]
    draw = max(1, round(x.shape[1] ** 0.5))
    out = []
    for _ in range(trees):
        tree: dict[str, list] = {"f": [], "v": [], "l": [], "r": [], "p": []}

        def grow(rows: np.ndarray, level: int) -> int:
            at = len(tree["f"])  # noqa: B023
            for k, v in zip("fvlrp", (-1, 0.0, 0, 0, float(y[rows].mean())), strict=True):
                tree[k].append(v)  # noqa: B023
            if level == depth or len(rows) < 2 * leaf or y[rows].min() == y[rows].max():
                return at
            best = None
            for f in rng.choice(x.shape[1], draw, replace=False):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                values, ones = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(rows))
                a, b = ones[:-1], ones[-1] - ones[:-1]
                cost = a * (1 - a / n) + b * (1 - b / (len(rows) - n))
                cost[(values[1:] == values[:-1]) | (n < leaf) | (len(rows) - n < leaf)] = np.inf
                k = int(np.argmin(cost))
                if np.isfinite(cost[k]) and (best is None or cost[k] < best[0]):
                    best = (cost[k], int(f), float((values[k] + values[k + 1]) / 2))
            if best is None:
                return at
            low = x[rows, best[1]] <= best[2]
            left, right = grow(rows[low], level + 1), grow(rows[~low], level + 1)
            tree["f"][at], tree["v"][at], tree["l"][at], tree["r"][at] = best[1], best[2], left, right  # noqa: B023
            return at

        grow(rng.integers(0, len(x), len(x)), 0)
        out.append(tree | {"d": depth})
    return Forest(tuple(out))


def labelled_findings(n: int = 3000, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """(candidate, words around, path, is a secret): findings as reviewers label them, drawn from their usual forms."""
    rng = random.Random(seed)
    hexes, upper, both = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    letters = both[:52]
    drawn = lambda signs, k: "".join(rng.choice(signs) for _ in range(k))
    prose = "the of and to in is that for on with as it by was are from this be or an la de que en und der die".split()
    words = lambda k: " ".join(rng.choice(prose) for _ in range(k))
    name = lambda: rng.choice(["token", "api_key", "secret", "password", "access_key", "auth_token", "client_secret", "private_key", "apikey"])
    source = lambda: rng.choice(["src/app.py", "config/prod.yml", "deploy/.env", "lib/client.go", "web/main.js", ""])
    quiet = lambda: rng.choice(["tests/test_app.py", "docs/example.md", "fixtures/sample.json", "src/app.py", "lib/util.go", "README.md", ""])
    sign = lambda: rng.choice([' = " "', ": ", " = ' '", "= ", ' := " "'])
    spoken = lambda: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") + rng.choice(["", "", "n", "s", "t"]) for _ in range(rng.randint(2, 5)))
    beside = lambda: f"{words(1)} {name()}{sign()}{words(2)}" if rng.random() < 0.4 else words(5)
    cased = lambda ws: rng.choice([lambda: "_".join(ws), lambda: "-".join(ws), lambda: "/".join(ws), lambda: "".join(ws), lambda: "".join(w.title() for w in ws), lambda: "_".join(ws).upper()])()
    out = []
    for _ in range(n):
        if rng.random() < 0.5:
            body = rng.choice([lambda: drawn(hexes, rng.choice([32, 40, 40, 64])), lambda: drawn(both, rng.randint(20, 64)), lambda: "AKIA" + drawn(upper, 16), lambda: "ghp_" + drawn(both, 36), lambda: "sk_live_" + drawn(both, 24), lambda: drawn(both + "+/", 43) + "=", lambda: f"SG.{drawn(both, 22)}.{drawn(both, 43)}", lambda: f"eyJ{drawn(both, rng.randint(15, 40))}.eyJ{drawn(both, rng.randint(20, 80))}.{drawn(both, 43)}", lambda: drawn(letters, rng.randint(16, 48)), lambda: drawn(rng.choice([letters[:26], letters[26:]]), rng.randint(16, 40)), lambda: "AKIA" + drawn(upper[:26], 16)])()
            around = f"{words(1)} {name()}{sign()}{words(2)}" if rng.random() < 0.93 else words(4)
            out.append((body, around, source(), 1))
        else:
            kind = rng.randrange(14)
            body, around = [
                lambda: (drawn("0123456789", rng.choice([16, 16, 19, 20])), words(5)),
                lambda: ("-".join(drawn(hexes, k) for k in (8, 4, 4, 4, 12)), f"{rng.choice(['uuid', 'id', 'request', 'guid'])}: {words(3)}"),
                lambda: (drawn(hexes, 40), f"{words(2)} {rng.choice(['commit', 'revision', 'sha1', 'checksum'])} {words(2)}"),
                lambda: (drawn(hexes, rng.choice([32, 64])), f"{rng.choice(['md5', 'sha256', 'digest', 'etag', 'integrity'])}: {words(3)}"),
                lambda: ("_".join(rng.choice(DICTIONARY) for _ in range(rng.randint(3, 6))) + rng.choice(["_2", "1", "_v3", "_id0"]), f"{words(3)} {rng.choice(['=', '', ':'])} {words(2)}"),
                lambda: ("/" + "/".join(rng.choice(DICTIONARY) for _ in range(rng.randint(3, 6))) + str(rng.randint(0, 99)), f"{words(4)}"),
                lambda: (rng.choice(["your", "example", "sample", "test", "dummy"]) + rng.choice(["_", "-"]) + name() + "_" + "x" * rng.randint(6, 16) + str(rng.randint(0, 9)), f"{name()}{sign()}{words(2)}"),
                lambda: (rng.choice("xX0aA1") * rng.randint(16, 40) + str(rng.randint(0, 9)), f"{name()}{sign()}{words(1)}"),
                lambda: ("".join(rng.choice(prose) for _ in range(rng.randint(5, 9))).ljust(16, "a") + rng.choice(["", "1", "20"]) + rng.choice(["", "2024"]) + str(rng.randint(0, 9)), words(5)),
                lambda: (rng.choice("-_+/") * rng.randint(16, 80), beside()),
                lambda: (cased([rng.choice(DICTIONARY) for _ in range(rng.randint(4, 7))]).ljust(16, "s"), beside()),
                lambda: (cased([spoken() for _ in range(rng.randint(2, 4))]).ljust(16, "e"), beside()),
                lambda: (cased([rng.choice([*prose, *DICTIONARY, spoken()]) for _ in range(rng.randint(4, 7))]).ljust(16, "e"), beside()),
                lambda: (rng.choice("xXaA") * rng.randint(16, 40), beside()),
            ][kind]()
            out.append((body, around, quiet(), 0))
    return out


def fit(spark: SparkSession, findings: list[tuple[str, str, str, int]], **options) -> Forest:
    """A forest from labelled findings; the features are those of scanning, and at most FIT_ROWS rows are fitted."""
    rows = [dict(zip("cwpy", f, strict=True)) for f in findings[:FIT_ROWS]]
    df = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<c:string,w:string,p:string,y:int>>")))
    got = df.select(features(F.col("c"), F.col("w"), F.col("p")).alias("x"), "y").collect()
    return train_forest(np.array([r["x"] for r in got]), np.array([r["y"] for r in got]), **options)


_DEFAULT: list[Forest] = []


def default_forest(spark: SparkSession) -> Forest:
    if not _DEFAULT:
        _DEFAULT.append(fit(spark, labelled_findings()))
    return _DEFAULT[0]
