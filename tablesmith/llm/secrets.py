"""Secret scans: candidate strings in texts, and a random forest that removes false findings.

Everything here is DataFrame and SQL functions. Candidates, their features, the forest's votes and the
redaction are expressions over a row's own text, so a scan is one narrow projection whatever the skew.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: A private key: its block from BEGIN to END, or, where no END follows, its head and the lines of base64 after it.
_KEY = "[A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
BLOCK = rf"-----BEGIN {_KEY}(?:(?:(?!-----)[\s\S])*+-----END {_KEY}|(?:(?:\s|\\[nr])++[A-Za-z0-9+/=]{{16,}}+)*+)"
#: A value after a word that names secrets, and the password in a URL: of any length and with any signs. The short tests
#: before a long one keep it from being made at every character.
_BETWEEN = r"""[\s"'`]"""
VALUE = rf"""(?<=[\s"'`=:])(?<=[=:]{_BETWEEN}{{0,3}})(?<=(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|credential)["']?\s{{0,2}}[=:]{_BETWEEN}{{0,3}})[^\s"'`<>,;(){{}}\[\]]{{6,}}+"""
IN_URL = r"(?<=:)(?<=://[^\s:/@]{1,40}:)[^\s/@]{4,}+(?=@)"
#: What may be a secret: a private key, such a value, or a run of 16 or more characters that doesn't continue either way.
#: In a run '=' is only taken where it ends it, so that in NAME=value the value is a candidate of its own.
CANDIDATE = rf"{BLOCK}|{VALUE}|{IN_URL}|(?<![A-Za-z0-9_+/~-])[A-Za-z0-9_+/~-]{{16,}}+(?:=++(?![A-Za-z0-9_+/~-]))?"
#: Runs of letters alone are taken only after a word of NAMES.
PLAIN = r"^[A-Za-z]+$"
#: Characters looked at before and after a candidate.
BESIDE = 48
#: Labelled findings that the forest is fitted on at most, its trees and their depth.
MOST_FINDINGS = 6000
TREES, DEPTH, SEED = 15, 6, 17
#: Votes, of all trees, from which a finding is a secret.
LEAST = 0.5
MASK = "[SECRET]"
#: Candidates whose lengths are added up together.
BLOCK_SIZE = 128

# Words that name secrets, words beside what only looks like one, words of paths that hold
# samples, formats with a known head, and frequent letter groups by which a dictionary's coverage is taken.
NAMES = ["token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private", "key"]
FALSE_WORDS = ["commit", "sha", "md5", "checksum", "digest", "hash", "uuid", "guid", "etag", "revision", "example", "sample", "dummy", "placeholder", "test", "order", "invoice", "tracking", "isbn", "serial"]
SAMPLE_PATHS = ["test", "example", "fixture", "sample", "mock", "docs", "demo"]
HEADS = ["AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "sk-", "AIza", "ya29", "eyJ", "npm_", "SG.", "-----BEGIN"]
DICTIONARY = ["tion", "ing", "the", "and", "ent", "ion", "her", "for", "tha", "nth", "int", "ere", "ter", "est", "ers", "ati", "hat", "ate", "all", "eth", "hes", "ver", "his", "oft", "ith", "fth", "sth", "oth", "res", "ont", "file", "name", "data", "user", "test", "list", "page", "key", "value", "your", "here", "example", "token", "secret", "password", "change", "default", "config", "class", "function", "index", "content", "document", "version", "service"]

FEATURES = ["length", "transitions", "digits", "uppers", "others", "distinct", "pairs", "covered", "hex", "decimal", "uuid", "repeats", "head", "named", "false_word", "sample_path", "assigned", "in_url", "names"]


def _any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words)).cast("double")


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def features(token: Column, before: Column, after: Column, path: Column) -> Column:
    """A struct of FEATURES, all doubles, of a candidate between the texts ``before`` and ``after`` at ``path``."""
    low, near = F.lower(token), F.lower(before)
    turns = F.regexp_count(token, F.lit(r"(?<=[a-z])(?=[0-9A-Z_+/=~-])|(?<=[A-Z])(?=[0-9a-z_+/=~-])|(?<=[0-9])(?=[A-Za-z_+/=~-])"))
    pairs = F.regexp_count(low, F.lit(r"(?<=[aeiouy])(?=[bcdfghjklmnpqrstvwxz])|(?<=[bcdfghjklmnpqrstvwxz])(?=[aeiouy])"))
    values = {
        "length": F.length(token),
        "transitions": turns / F.greatest(F.length(token), F.lit(1)),
        "digits": _share(token, "[0-9]"),
        "uppers": _share(token, "[A-Z]"),
        "others": _share(token, "[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(token, ""))) / F.least(F.greatest(F.length(token), F.lit(1)), F.lit(62)),
        "pairs": pairs / F.greatest(F.length(token), F.lit(1)),
        "covered": 1 - F.length(F.regexp_replace(low, "|".join(DICTIONARY), "")) / F.greatest(F.length(token), F.lit(1)),
        "hex": token.rlike("^[0-9a-fA-F]+$"),
        "decimal": token.rlike("^[0-9]+$"),
        "uuid": token.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"),
        "repeats": F.length(token) - F.length(F.regexp_replace(token, r"(.)\1+", "$1")),
        "head": token.rlike("^(" + "|".join(re.escape(h) for h in HEADS) + ")"),
        "named": _any(near, NAMES),
        "false_word": _any(F.concat(near, F.lit(" "), F.lower(after)), FALSE_WORDS),
        "sample_path": _any(F.lower(path), SAMPLE_PATHS),
        "assigned": before.rlike("[=:]\\s*[\"'`]?$"),
        "in_url": before.rlike("://[^\\s:/@]{1,40}:$") & after.rlike("^@"),
        "names": after.rlike("^=+[^=\\s]"),
    }
    return F.struct(*[values[n].cast("double").alias(n) for n in FEATURES])


def labelled_findings(spark: SparkSession, n: int = MOST_FINDINGS, first: int = 0) -> DataFrame:
    """``n`` labelled findings (before, token, after, path, label) made by rule from the numbers ``first`` on: secrets of
    known formats beside words that name them, passwords, in URLs too, long ones, key blocks, NAME=value and some without
    a name, and digests, identifiers, numbers, paths, words, names, references, embedded data and samples that aren't secrets."""
    digest = F.sha2(F.concat(F.lit("finding:"), F.col("id").cast("string")), 512)
    draw = lambda k, m: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(m)).cast("int")
    pick = lambda k, words: F.element_at(F.array(*map(F.lit, words)), draw(k, len(words)) + 1)
    code = F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", "")
    mixed = F.base64(F.unhex(digest))
    upper = F.upper(F.regexp_replace(code, "[^A-Za-z0-9]", ""))
    words = F.concat_ws("", *[pick(f"w{i}", DICTIONARY) for i in range(6)])
    number = F.regexp_replace(digest, "[a-f]", "")
    named = F.concat(pick("n", ["my ", "the ", "set ", "", "export ", "of "]), pick("k", NAMES), pick("o", [" = \"", "=", ": ", ": \"", " = '", " "]))
    prose = pick("p", ["commit ", "sha256: ", "checksum=", "md5 ", "revision ", "digest: ", "see ", "of ", "the ", "etag: \"", "order ", "invoice no. ", "tracking ", "was ", "in "])
    shift = draw("s", 3)
    blob = F.concat(*[F.base64(F.unhex(F.sha2(F.concat(F.lit(f"part{i}:"), F.col("id").cast("string")), 384))) for i in range(16)])
    long = F.substr(F.regexp_replace(blob, "[+/=]", ""), F.lit(1), F.lit(80) + draw("long", 900))
    kind_of_key = pick("pem", ["RSA ", "EC ", "OPENSSH ", ""])
    lines = F.concat_ws("\n", *[F.substr(blob, F.lit(64 * i + 1), F.lit(64)) for i in range(8)])
    block = F.concat(F.lit("-----BEGIN "), kind_of_key, F.lit("PRIVATE KEY-----\n"), lines, F.lit("\n-----END "), kind_of_key, F.lit("PRIVATE KEY-----"))
    glued = F.concat(pick("g", ["", "API_", "export MY_", "https://a.b/c?", "DB_"]), F.when(draw("case", 2) == 0, F.upper(pick("k", NAMES))).otherwise(pick("k", NAMES)), F.lit("="))
    word = F.initcap(F.concat(pick("x1", DICTIONARY), pick("x2", DICTIONARY)))
    password = F.concat(word, draw("x3", 1000).cast("string"), pick("x4", ["!", "$", "&", "#", "%", "@", "-", "_", "*"]), F.substr(code, F.lit(1), draw("x5", 10)), pick("x6", ["", "!", "?", "7", "x"]))
    unnamed = pick("u", ["k: \"", "x = \"", "value: ", "v='", "set a = \"", "c=", "opt: \""])
    secrets = [
        F.substr(digest, F.lit(1), F.lit(40)), F.substr(digest, F.lit(1), F.lit(32) + 8 * shift), F.substr(code, F.lit(1), F.lit(24) + 8 * shift), F.concat(F.lit("ghp_"), F.substr(code, F.lit(1), F.lit(36))),
        F.concat(F.lit("AKIA"), F.substr(upper, F.lit(1), F.lit(16))), F.concat(F.lit("sk_live_"), F.substr(code, F.lit(1), F.lit(24))), F.substr(mixed, F.lit(1), F.lit(40)), F.concat(F.lit("eyJ"), F.substr(code, F.lit(1), F.lit(60))), F.upper(F.substr(digest, F.lit(1), F.lit(40))),
        long, block, F.substr(mixed, F.lit(1), F.lit(8) + draw("short", 9)), password, F.concat(F.substr(code, F.lit(1), F.lit(6) + draw("short", 14)), pick("u1", ["!", "$", "#", "", "%"])),
    ]
    calm = pick("calm", ["required", "optional", "string", "password", "changeme", "undefined", "disabled", "enabled", "unknown", "missing", "nothing", "default", "received", "expired", "invalid", "forgotten"])
    reference = F.concat(pick("r1", ["os.environ", "config.", "process.env.", "settings.", "self.", "args.", "user_", "request.", "options."]), pick("r2", ["password", "token", "PASSWORD", "API_KEY", "get", "secret_name", "SECRET_KEY", "credentials"]))
    dashed = F.concat_ws("-", *[F.substr(digest, F.lit(a), F.lit(k)) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    others = [
        F.substr(digest, F.lit(1), F.lit(40)), F.substr(digest, F.lit(1), F.lit(32)), digest.substr(1, 64), dashed, F.substr(number, F.lit(1), F.lit(16) + shift), words, F.concat_ws("_", *[pick(f"v{i}", DICTIONARY) for i in range(5)]),
        F.concat(F.lit("src/"), words, F.lit("/"), pick("f", DICTIONARY)), F.repeat(pick("r", ["x", "0", "-", "=", "ab", "_"]), 18), F.concat(pick("y", ["YOUR_", "my_", "INSERT_"]), F.upper(pick("z", NAMES)), F.lit("_GOES_HERE")),
        F.substr(blob, F.lit(1), F.lit(40) + draw("blob", 900)), F.concat(pick("y2", ["MY_SERVICE_", "PRODUCTION_", "INTERNAL_CLIENT_"]), F.upper(pick("z", NAMES)), pick("y3", ["_FOR_DEPLOY", "_OF_SERVICE", "_NUMBER_ONE"])), calm, reference, F.concat(calm, pick("c9", [".", "!", "?", ":"])),
    ]
    label = draw("label", 2)
    drawn = spark.range(first, first + n).select(
        "id", label.alias("label"), draw("kind", len(others)).alias("kind"), F.element_at(F.array(*secrets), draw("kind", len(secrets)) + 1).alias("secret"), F.element_at(F.array(*others), draw("kind", len(others)) + 1).alias("other"),
        named.alias("named"), prose.alias("prose"), glued.alias("glued"), unnamed.alias("unnamed"), F.concat(pick("a1", ["my ", "the ", "", "export ", "DB_"]), pick("a2", ["password", "passwd", "pwd", "secret", "token", "api_key", "credential", "PASSWORD"]), pick("a3", [" = \"", "=", ": ", ": \"", " = '", ":"])).alias("assigned"), F.substr(code, F.lit(1), F.lit(30)).alias("value"),
    )
    label, kind, secret = F.col("label"), F.col("kind"), F.col("secret")
    filler, embedded, naming, calm_value, in_url = kind.isin(8, 9), kind == 10, kind == 11, kind.isin(12, 13, 14), draw("url", 4) == 0
    blob_before = pick("b", ["data:image/png;base64,", "src=\"data:font/woff;base64,", "integrity sha: \"", "digest: ", "checksum=", "the ", "\n"])
    bare = (draw("bare", 6) == 0) & secret.rlike("^(ghp_|AKIA|sk_live_|eyJ|-----)")
    form = draw("form", 6)
    mixed_in = secret.rlike("[a-z]") & secret.rlike("[A-Z]") & secret.rlike("[0-9]")
    short, url = F.length(secret) < 24, pick("url", ["postgres://admin:", "https://user:", "redis://:x:", "amqp://svc:"])
    secret_before = F.when(short & in_url, url).when(short, F.col("assigned")).when(bare, F.lit("use ")).when((form == 0) & mixed_in, F.col("unnamed")).when(form <= 2, F.col("glued")).otherwise(F.col("named"))
    other_before = F.when(calm_value, F.col("assigned")).when(filler, F.col("named")).when(embedded, blob_before).when(naming, pick("nb", ["export ", "\n", "set ", ""])).otherwise(F.col("prose"))
    return drawn.select(
        F.when(label == 1, secret_before).otherwise(other_before).alias("before"),
        F.when(label == 1, secret).otherwise(F.col("other")).alias("token"),
        F.when((label == 0) & naming, F.concat(F.lit("="), F.col("value"))).when((label == 1) & short & in_url, pick("host", ["@db.example", "@host:5432/x", "@10.0.0.1"])).otherwise(pick("after", ["\" and", " of", "\"", "'", " the", ""])).alias("after"),
        F.when(label == 1, pick("path", ["src/app", "config", "deploy", "web"])).otherwise(pick("path", ["src/app", "config", "tests/example", "docs/sample", "web", "deploy"])).alias("path"),
        label.cast("double").alias("label"),
    )


class Forest:
    """A random forest as an expression: the share of trees that vote for a secret."""

    def __init__(self, model: RandomForestClassificationModel):
        self.trees = [_parse(t.toDebugString) for t in model.trees]

    def votes(self, values: Column) -> Column:
        # Bound by a lambda, so that the features are worked out once and not in each node.
        return F.transform(F.array(values), lambda v: sum((_expression(t, v) for t in self.trees), F.lit(0.0)) / max(1, len(self.trees)))[0]


def _parse(text: str):
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines()[1:] if x.strip()]

    def node(at: int):
        _, line = lines[at]
        if line.startswith("Predict"):
            return float(line.split(":")[1]), at + 1
        feature, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        yes, at = node(at + 1)
        no, at = node(at + 1)
        return (FEATURES[int(feature)], float(bound), yes, no), at

    return node(0)[0]


def _expression(tree, values: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    name, bound, yes, no = tree
    return F.when(values[name] <= bound, _expression(yes, values)).otherwise(_expression(no, values))


def fitted(findings: DataFrame) -> tuple[RandomForestClassificationModel, DataFrame]:
    """MLlib's forest learned from at most MOST_FINDINGS labelled findings (before, token, after, path, label), and its table."""
    rows = findings.where("token is not null and label is not null").limit(MOST_FINDINGS)
    flat = rows.select(features(F.col("token"), *[F.coalesce(c, F.lit("")) for c in ("before", "after", "path")]).alias("f"), "label").select("f.*", "label")
    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(flat)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(table.select("features", "label")), table


def train(findings: DataFrame) -> Forest:
    return Forest(fitted(findings)[0])


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, and not at each place that uses it within a lambda."""
    return F.transform(F.array(value), body)[0]


def _judged(text: Column, path: Column, forest: Forest) -> Column:
    """(pieces, found): what is between the candidates of a text, and (start, token, likely, votes) of all of these.

    Starts are sums of the lengths before, taken by blocks of BLOCK_SIZE, so the work grows little faster than the text.
    """
    split = F.struct(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("t"), F.split(text, CANDIDATE, -1).alias("p"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)

    def measured(s: Column) -> Column:
        return F.struct(s["t"].alias("t"), s["p"].alias("p"), F.zip_with(s["t"], s["p"], lambda t, p: (F.coalesce(F.length(t), F.lit(0)) + F.length(p)).cast("long")).alias("l"))

    def summed(s: Column) -> Column:
        ends = F.transform(F.sequence(F.lit(0), F.floor(F.size(s["l"]) / BLOCK_SIZE).cast("int")), lambda k: total(F.slice(s["l"], k * BLOCK_SIZE + 1, BLOCK_SIZE)))
        return F.struct(s["t"].alias("t"), s["p"].alias("p"), s["l"].alias("l"), ends.alias("e"))

    def prefixed(s: Column) -> Column:
        return F.struct(s["t"].alias("t"), s["p"].alias("p"), s["l"].alias("l"), F.transform(s["e"], lambda x, k: total(F.slice(s["e"], 1, k))).alias("e"))

    def found(s: Column) -> Column:
        def begin(i: Column) -> Column:
            k = F.floor(i / BLOCK_SIZE).cast("int")
            return F.get(s["e"], k) + total(F.slice(s["l"], k * BLOCK_SIZE + 1, i - k * BLOCK_SIZE)) + F.length(F.get(s["p"], i))

        # The three candidates on either side, with what is between; candidates are mostly long, so this holds BESIDE or nearly so.
        piece, token = (lambda i: F.coalesce(F.get(s["p"], i), F.lit(""))), (lambda i: F.coalesce(F.get(s["t"], i), F.lit("")))
        before = lambda i: F.right(F.concat(*[F.right(x, F.lit(BESIDE)) for k in (3, 2, 1) for x in (token(i - k), piece(i - k + 1))]), F.lit(BESIDE))
        after = lambda i: F.left(F.concat(*[F.left(x, F.lit(BESIDE)) for k in (1, 2, 3) for x in (piece(i + k), token(i + k))]), F.lit(BESIDE))
        near = F.transform(s["t"], lambda t, i: F.struct(begin(i).alias("start"), t.alias("token"), before(i).alias("before"), after(i).alias("after")))
        likely = lambda c: ~c["token"].rlike(PLAIN) | (_any(F.lower(c["before"]), NAMES) > 0)
        sure = lambda c: forest.votes(features(c["token"], c["before"], c["after"], F.coalesce(path, F.lit(""))))
        judged = F.transform(near, lambda c: F.struct(c["start"].alias("start"), c["token"].alias("token"), likely(c).alias("likely"), F.when(likely(c), sure(c)).otherwise(0.0).alias("votes")))
        return F.struct(s["p"].alias("pieces"), judged.alias("found"))

    return _bound(split, lambda s: _bound(measured(s), lambda m: _bound(summed(m), lambda e: _bound(prefixed(e), found))))


def scan(docs: DataFrame, forest: Forest) -> DataFrame:
    """A row per candidate of ``docs`` (doc_id, text, source): doc_id, start, length, token, votes, is_secret.

    A null or empty text has no candidates; a null source is an empty path; texts of any length are searched whole. Rows
    that repeat a document repeat its findings, other columns are ignored, and an empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", "source").where(F.col("text").rlike(CANDIDATE))
    rows = rows.select("doc_id", F.explode(_judged(F.col("text"), F.col("source"), forest)["found"]).alias("f")).where("f.likely")
    return rows.select("doc_id", "f.start", F.length("f.token").alias("length"), "f.token", "f.votes", (F.col("f.votes") >= LEAST).alias("is_secret"))


def redact(docs: DataFrame, forest: Forest) -> DataFrame:
    """``docs`` with MASK in place of each secret; n_chars, where there, is counted anew.

    Rows without a secret, with a null or an empty text stay as they are; texts of any length are searched whole, repeated
    rows are treated alike, other columns pass through whatever their names, and an empty table gives no rows.
    """
    text = F.col("text")
    marked = lambda j: F.zip_with(j["pieces"], j["found"], lambda p, c: F.concat(p, F.when(c["votes"] >= LEAST, F.lit(MASK)).otherwise(F.coalesce(c["token"], F.lit("")))))
    clean = _bound(_judged(text, F.col("source"), forest), lambda j: F.array_join(marked(j), ""))
    out = docs.withColumn("text", F.when(text.rlike(CANDIDATE), clean).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def built_in(spark: SparkSession) -> Forest:
    # Kept, so that making findings and taking their features aren't one expression, too large to compile.
    return train(cut(labelled_findings(spark)))
