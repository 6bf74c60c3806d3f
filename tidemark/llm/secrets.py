"""Secret scans with a random forest that removes false positives.

Candidates of whole texts are long runs that look like keys, every value assigned inside a word, passwords inside URLs, and
the whole word where a secret is assigned to it; a word gives each of its candidates once. A forest over candidate
length, character transitions, dictionary coverage, path and neighbouring words, trained from labelled findings, tells
secrets from digests, ids, placeholders and the like. The trained trees become one SQL expression, so each row is
scanned, scored and redacted where it lies: no shuffle, no join, no Python on the executors.

Training rows are bounded by LABELLED: a given table of findings is used up to that many rows (least hash first), and
where none is given the findings of ``labelled_findings`` are, which come from a seeded rule. Nothing else is sampled.

Defined results: a null or empty text has no candidates; a null path counts as empty; rows are scanned one by one, so
repeated rows repeat their findings and null ids need no rule; an empty table gives an empty result; ``redact`` passes
all other columns through; ``scan`` takes a column named as its ``keep`` away.
"""

from __future__ import annotations

import base64
import random
import re
import string
import uuid

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.columns import WHITE, let, text_of, word_array

#: Most labelled findings that a forest is fitted on.
LABELLED = 20_000
TREES, DEPTH, SEED = 16, 6, 7
#: Probability from which a candidate counts as a secret.
THRESHOLD = 0.5
MASK = "[SECRET]"

KEYWORD = r"(?i)(api.?key|token|secret|passw(or)?d|passphrase|pwd|credential|auth|private.?key|access.?key)"
BENIGN = r"(?i)(sha\d*|commit|md5|checksum|digest|uuid|guid|hash|revision|version|etag|isbn|order|invoice|phone|card|account|build|ref|object|file|image|integrity)\b"
PREFIX = r"^(AKIA|ASIA|gh[pousr]_|xox[abprs]-|eyJ|sk_live_|rk_live_|AIza|glpat-|npm_)"
PLACEHOLDER = r"(?i)(.)\1{4,}|12345|abcdef|xxxx|example|your|changeme|placeholder|dummy|sample|redacted"
#: A password in the authority of a URL, and what stands before one.
AUTHORITY = r"(?i)[a-z][a-z0-9+.\-]*://[^\s:/@\"']*:([^\s@/\"']{6,})@"
IN_AUTHORITY = r"(?i)[a-z][a-z0-9+.\-]*://[^\s:/@\"']*:$"
TESTING = r"(?i)(test|example|sample|fixture|mock|docs?/|spec|\.lock|readme)"
#: Words whose letters count as covered by the dictionary.
DICTIONARY = "about access account admin after api auth backend bearer before build cache change client cluster config content controller data database default demo develop document element example file first frontend general group handler header image index input insert internal item key library local login main manager message method model module name network number object output page params password path placeholder private product project public query release remote render report request resource response result sample schema section secret server service session setting simple source static status storage stream string style system table template test text time token update upload user value version view widget your".split()
#: Letter pairs that are common in prose.
PAIRS = "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur".split()

FEATURES = (
    "length", "transitions", "digits", "capitals", "distinct", "prose_pairs", "dictionary", "hexadecimal", "uuid", "prefix", "keyword_before", "benign_before", "test_path", "placeholder",
    "assigned", "separators", "digits_only", "long_lower_run", "in_authority",
)


def features(secret: Column, before: Column, path: Column) -> Column:
    """The FEATURES of a candidate as an array of doubles."""
    n = F.greatest(F.length(secret), F.lit(1))
    share = lambda pattern: F.regexp_count(secret, F.lit(pattern)) / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    low = F.lower(secret)
    values = {
        "length": F.length(secret),
        "transitions": F.length(F.regexp_replace(secret, "[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+", "x")) / n,
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "distinct": F.size(F.array_distinct(F.split(secret, ""))) / n,
        "prose_pairs": F.regexp_count(low, F.lit(f"(?={'|'.join(PAIRS)})")) / n,
        "dictionary": 1 - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / n,
        "hexadecimal": flag(secret.rlike("^[0-9a-fA-F]+$")),
        "uuid": flag(low.rlike("^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$")),
        "prefix": flag(secret.rlike(PREFIX)),
        "keyword_before": flag(before.rlike(KEYWORD)),
        "benign_before": flag(before.rlike(BENIGN)),
        "test_path": flag(path.rlike(TESTING)),
        "placeholder": flag(secret.rlike(PLACEHOLDER)),
        "assigned": flag(before.rlike(r"[=:][\"']?$")),
        "separators": share("[/_.-]"),
        "digits_only": flag(secret.rlike("^[0-9]+$")),
        "long_lower_run": flag(secret.rlike("[a-z]{9,}")),
        "in_authority": flag(before.rlike(IN_AUTHORITY)),
    }
    return F.array(*(values[k].cast("double") for k in FEATURES))


def labelled_findings(rows: int = 4_000, seed: int = SEED) -> list[tuple[str, str, str, int]]:
    """(words before, candidate, path, 1 for a secret) by a seeded rule: half of them secrets."""
    r = random.Random(seed)
    some = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    mixed, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    live = ["src/app/config.py", "deploy/prod.env", "settings.yaml", "main.go", "src3", "src11", "web", "", "notes.txt"]
    tests = ["tests/test_auth.py", "docs/readme.md", "examples/demo.py", "fixtures/mock.json", "package.lock", "spec/login.rb"]
    keys = ["token =", "api_key =", "secret:", "password:", "API_TOKEN =", "auth =", "access_key:", 'private_key = "', "passwd =", "client secret =", 'token = "']
    harmless = ["commit", "sha256", "md5:", "checksum =", "uuid:", "etag =", "revision", "order", "invoice", "integrity:", "object file", "image", "hash ="]
    prose = ["and then", "the of", "le de la", "", "und der", "de los", "see", "with"]
    out = []
    for k in range(rows):
        if k % 2:
            kind = r.randrange(10)
            secret = (
                some(hexa, r.choice((32, 40, 64))), "AKIA" + some(string.ascii_uppercase + string.digits, 16), "gh" + r.choice("pousr") + "_" + some(mixed, 36),
                "xoxb-" + some(string.digits, 11) + "-" + some(mixed, 24), "eyJ" + some(mixed, 60), base64.b64encode(r.randbytes(r.choice((24, 30, 48)))).decode(), some(mixed + "!@%^", r.randint(8, 24)),
                r.choice(DICTIONARY + PAIRS) + r.choice(PAIRS) + some(string.digits, r.randint(1, 4)) + some(mixed + "!@#", r.randint(1, 4)),
                r.choice((some(mixed, r.randint(8, 20)), r.choice(DICTIONARY).title() + some(string.digits, r.randint(1, 3)) + some(mixed, r.randint(2, 6)))),
                some(string.ascii_lowercase, r.randint(3, 7)) + r.choice("-_.!@&") + some(string.ascii_lowercase, r.randint(3, 7)) + r.choice(("", "!", "?", "#")),
            )[kind]
            known = kind in (1, 2, 3, 4)
            before = r.choice(prose) + " " + (r.choice(keys) if not known or r.random() < 0.6 else r.choice(prose))
            if kind == 8:
                before = f"{r.choice(prose)} {r.choice(('postgres', 'https', 'amqp', 'redis', 'mongodb+srv', 'mysql'))}://{r.choice(DICTIONARY)}:"
            out.append((before, secret, r.choice(live), 1))
        else:
            kind = r.randrange(10)
            word = lambda: r.choice(DICTIONARY)
            secret = (
                some(hexa, r.choice((32, 40, 64))), str(uuid.UUID(bytes=r.randbytes(16))), some(string.digits, r.choice((16, 18, 20))), "/".join(word() for _ in range(r.randint(3, 6))) + str(r.randint(1, 99)),
                "_".join(word() for _ in range(r.randint(2, 5))) + str(r.randint(1, 2024)), r.choice(("your_api_key_12345", "xxxxxxxxxxxxxxxx1234", "changeme123456789", "example_token_12345", "00000000000000000000")),
                some(hexa, 40), "".join(r.choice(PAIRS) for _ in range(r.randint(8, 14))) + str(r.randint(0, 99)), base64.b64encode(r.randbytes(30)).decode(),
                r.choice(("password", "secret", "username", "changeme", "your_password", "example1")),
            )[kind]
            if kind == 9:
                out.append((f"{r.choice(prose)} {r.choice(('postgres', 'https', 'mysql'))}://user:" if r.random() < 0.5 else r.choice(prose) + " " + r.choice(keys), secret, r.choice(live + tests), 0))
            elif kind in (0, 8):
                out.append((r.choice(prose) + " " + r.choice(harmless), secret, r.choice(live + tests), 0))
            elif kind == 6:
                out.append((r.choice(prose) + " " + r.choice(keys), secret, r.choice(tests), 0))
            else:
                out.append((r.choice(prose) + " " + r.choice(keys + harmless + prose * 2 if kind == 5 else harmless + prose * 2), secret, r.choice(live + tests), 0))
    return out


#: The model of labelled_findings, once it has been fitted.
_own: list[str] = []


def train(spark: SparkSession, labelled: DataFrame | None = None) -> str:
    """SQL of a secret's probability given an array ``f`` of FEATURES, from findings (before, secret, path, label)."""
    if labelled is None:
        if not _own:
            _own.append(train(spark, spark.createDataFrame(labelled_findings(), "before string, secret string, path string, label int")))
        return _own[0]
    rows = labelled.where("label is not null").orderBy(F.xxhash64("before", "secret", "path", "label")).limit(LABELLED)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = rows.select(array_to_vector(features(text("secret"), text("before"), text("path"))).alias("features"), F.col("label").cast("double")).coalesce(1)
    # a regression tree on 0 and 1 splits as a Gini tree does, and its leaves are the shares of secrets
    forest = RandomForestRegressor(labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=5, featureSubsetStrategy="onethird").fit(rows)
    return forest_sql(forest.toDebugString)


def forest_sql(described: str) -> str:
    """The mean of the described trees as SQL over an array ``f``."""
    trees: list[list[str]] = []
    for line in described.splitlines():
        if re.match(r"\s*Tree \d+", line):
            trees.append([])
        elif trees and line.strip():
            trees[-1].append(line.strip())

    def grow(lines: list[str]) -> str:
        line = lines.pop(0)
        if m := re.fullmatch(r"Predict: (\S+)", line):
            return f"{float(m[1]):.6f}D"
        feature, threshold = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = grow(lines)
        lines.pop(0)  # Else
        return f"CASE WHEN f[{feature}] <= {float(threshold)!r}D THEN {low} ELSE {grow(lines)} END"

    return "(" + " + ".join(grow(t) for t in trees) + f") / {len(trees)}D"


def candidates(text: Column, path: Column) -> Column:
    """Array of (word, secret, f) of a whole text: word is the place of the candidate's word, from 0; f its features."""
    shaped = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
    inline = r"(?i)(?:key|token|secret|passw(?:or)?d|pwd)[\"']?[=:][\"']?([^\s\"']{6,})"
    joined = inline.replace("[^\\s\\\"']", "[^\\s\\\"'&;,]")  # the same with values cut at what joins assignments

    def looked_at(w: Column) -> Column:
        at = lambda i, back: F.coalesce(F.get(w, i - back), F.lit(""))
        assigned = lambda i: F.right(at(i, 1), F.lit(1)).isin("=", ":") & F.concat_ws(" ", at(i, 2), at(i, 1)).rlike(KEYWORD)
        long = lambda x: (F.octet_length(x) >= 16) & x.rlike("[0-9]") & x.rlike(shaped)
        url = lambda x: x.contains("://") & x.rlike(AUTHORITY)
        hit = lambda i: (F.octet_length(F.get(w, i)) >= 6) & (long(F.get(w, i)) | assigned(i) | ((F.octet_length(F.get(w, i)) >= 10) & (F.get(w, i).rlike(inline) | url(F.get(w, i)))))
        bare = lambda x: F.regexp_replace(x, r"^[\"'(\[{]+|[\"')\]},;.]+$", "")

        def strings(i: Column) -> Column:
            x = F.get(w, i)
            all_of = lambda pattern: F.regexp_extract_all(x, F.lit(pattern), F.lit(1))
            runs = F.filter(all_of(f"({shaped})"), lambda c: c.rlike("[0-9]"))
            whole = F.when(assigned(i), F.array(bare(x))).otherwise(F.array().cast("array<string>"))
            found = F.filter(F.array_distinct(F.concat(all_of(inline), all_of(joined), F.when(x.contains("://"), all_of(AUTHORITY)).otherwise(F.array().cast("array<string>")), whole, runs)), lambda c: F.length(c) >= 6)
            return F.when(F.size(found) > 0, found).otherwise(F.array(bare(x)))

        def described(i: Column, c: Column) -> Column:
            before = F.concat_ws(" ", at(i, 3), at(i, 2), at(i, 1), F.call_function("substring_index", F.get(w, i), c, F.lit(1)))
            f = features(c, F.rtrim(before), path)
            return F.struct(i.alias("word"), c.alias("secret"), f.alias("f"))

        places = F.filter(F.sequence(F.lit(0), F.size(w) - 1), hit)
        each = F.transform(places, lambda i: F.transform(F.filter(strings(i), lambda c: F.length(c) >= 6), lambda c: described(i, c)))
        return F.when(F.size(w) == 0, F.array().cast("array<struct<word:int,secret:string,f:array<double>>>")).otherwise(F.flatten(each))

    return let(word_array(text), looked_at)


def scan(docs: DataFrame, path: str = "source", labelled: DataFrame | None = None, keep: str = "_findings") -> DataFrame:
    """docs with ``keep``: array of (word, secret, probability, is_secret) of each row's candidates."""
    model = train(docs.sparkSession, labelled)
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    found = docs.withColumn(keep, candidates(text_of(), where))
    score = f"transform({keep}, c -> transform(array(c.f), f -> {model})[0])"
    judged = f"zip_with({keep}, {score}, (c, p) -> named_struct('word', c.word, 'secret', c.secret, 'probability', p, 'is_secret', p >= {THRESHOLD}D))"
    return found.withColumn(keep, F.expr(judged))


def masked(text: Column, hits: Column) -> Column:
    """text with the ``secret`` of each of hits replaced by MASK in the word of its place; white space stays as it is."""
    space = r"([\x20\x09-\x0D]+)"
    # all secrets of a word at once, longer ones first, so that no mask is looked into again
    quoted = lambda x: F.concat(F.lit("\\Q"), F.replace(x["secret"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    longest = lambda x: F.array_sort(x, lambda a, b: F.length(b["secret"]) - F.length(a["secret"]))

    def word(x: Column, i: Column) -> Column:
        here = F.filter(hits, lambda h: h["word"] == i)
        cut = let(here, lambda h: F.regexp_replace(x, F.array_join(F.transform(longest(h), quoted), "|"), F.lit(MASK)))
        return F.when(F.exists(hits, lambda h: h["word"] == i), cut).otherwise(x)

    gaps = F.regexp_extract_all(F.btrim(text, F.lit(WHITE)), F.lit(space), F.lit(1))
    edge = lambda pattern: F.regexp_extract(text, pattern, 1)
    inner = F.array_join(F.zip_with(F.transform(word_array(text), word), gaps, lambda x, g: F.concat(x, F.coalesce(g, F.lit("")))), "")
    return F.concat(edge("^" + space), inner, edge(space + r"\z"))


def redact(docs: DataFrame, path: str = "source", labelled: DataFrame | None = None) -> DataFrame:
    """docs with each secret replaced by MASK in the words where it was found; n_chars, if there, follows; other columns as they are."""
    # the row goes as one column, so that no column of docs can clash with ours
    where = F.col(path) if path in docs.columns else F.lit("")
    found = scan(docs.select(F.struct(*docs.columns).alias("_row"), "text", where.alias("path")), "path", labelled, "_findings")
    hits = F.filter("_findings", lambda x: x["is_secret"])
    clean = let(hits, lambda h: F.when(F.size(h) == 0, F.col("text")).otherwise(let(text_of(), lambda t: masked(t, h))))
    found = found.withColumn("_clean", clean)
    made = {c: F.col("_row")[c] for c in docs.columns} | {"text": F.col("_clean")}
    if "n_chars" in made:
        made["n_chars"] = F.when(F.col("_clean") != F.col("text"), F.length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(made["n_chars"])
    return found.select(*(made[c].alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: all candidates of all documents, and which are secrets."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = found.select(F.col("doc_id").cast("long"), F.explode("_findings").alias("x"))
    return rows.select(
        "doc_id", F.col("x.word").cast("long").alias("word_index"), F.length("x.secret").cast("long").alias("length"), F.sha2(F.col("x.secret"), 256).alias("secret_sha256"),
        F.round("x.probability", 6).alias("probability"), "x.is_secret",
    )
