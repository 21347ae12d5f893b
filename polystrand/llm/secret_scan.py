"""Secret scans: patterns propose candidates, a random forest removes false positives.

DataFrame expressions only, and no shuffle of texts: candidates are found, judged and masked
within their row. A candidate is a key block of any length, with or without header lines, the
value assigned after a secret word, whatever its characters (a quoted one as a whole), or a
run of 16 or more key characters with a digit in it. The forest sees its length, character
transitions, dictionary coverage, path and the neighbouring words, and is trained from
labelled findings: a table of the candidate with the text before and after it, its place
and a label. ``labelled_findings`` makes such a table by rule, for users without one. The
dictionary and the transitions between letters are counted over all documents.

Defined cases: null and empty texts have no findings; a secret that occurs twice is two
findings; repeated rows, and rows without a doc_id, give their findings each, and are masked
each on its own; texts and candidates of any length are read whole; ties of the score do not
matter, as each candidate is judged alone; columns of any name pass through the mask; an
empty table gives no row.
"""

from __future__ import annotations

import json
import math
import string
import uuid
from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_name, quoted, remove, shared_dir, staged

KEY = r"[A-Za-z0-9_+/=\-]"
BLOCK = r"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----(?:[^-]++|-(?!----))*+-----END [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
SECRET_WORDS = r"(?:token|secret|passwor?d|passwd|pwd|api[_ -]?key|apikey|access[_ -]?key|private[_ -]?key|auth|bearer|credential)"
#: The places right after a secret word and = or :, within quotes or without; the first
#: lookbehind is a cheap one.
QUOTED = rf"(?<=[\"'])(?<=(?i:{SECRET_WORDS})[\"']?\s{{0,4}}[:=]\s{{0,4}}[\"'])"
BARE = rf"(?<=[:=]|[:=]\s)(?<=(?i:{SECRET_WORDS})[\"']?\s{{0,4}}[:=]\s?)"
ASSIGNED = rf"{QUOTED}[^\"'\r\n]++(?=[\"'])|{BARE}[^\s\"']++"
PATTERN = rf"{BLOCK}|{ASSIGNED}|(?<!{KEY})(?=[A-Za-z_+/=\-]{{0,400}}[0-9]){KEY}{{16,}}+"
#: Characters looked at before and after a candidate.
AROUND = 40
MASK = "[SECRET]"
SURE = 0.5
#: Words of identifiers and placeholders, which join the corpus' own in the dictionary.
IDENTIFIERS = ["password", "passwd", "token", "secret", "example", "sample", "dummy", "test", "your", "here", "change", "placeholder", "default", "value", "name", "user", "data", "file", "index", "page", "version", "build", "image", "content", "commit", "branch", "release", "number", "order", "invoice", "ticket", "session", "model", "table", "column", "function", "class", "method", "config", "setting", "server", "client", "service", "region", "email", "mail", "http", "https", "html", "json", "python", "java", "spark", "node", "main", "init", "article", "chapter", "section", "report", "draft", "final", "copy", "summary", "github", "docs", "null", "none", "true", "false"]
#: Words of a dictionary at most, and the documents of a thousand that a word must be in.
DICTIONARY, PER_MILLE = 4096, 1
OTHER_WORDS = r"(?:commit|sha-?1|sha-?256|md5|hash|checksum|digest|uuid|guid|revision|version|build|order|invoice|tracking|isbn|etag|session id|serial|call|phone|card|account)"
FAKE_WORDS = r"(?:example|sample|dummy|placeholder|fake|your[_ -]|xxxx|changeme|0123456789|1234567890|abcdef)"
FEATURES = ["length", "changes", "transitions", "variety", "digits", "uppers", "hexadecimal", "coverage", "worded", "path", "prefix", "before_secret", "before_assign", "inside_assign", "before_other", "fake", "quoted"]
#: Candidates of one text whose places are summed at once.
CHUNK = 1024


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def constant(value: object, kind: str) -> Column:
    """A large literal, which the optimiser folds."""
    return F.from_json(F.lit(json.dumps({"x": value})), f"x {kind}")["x"]


class Lexicon:
    """The dictionary and the letter transitions of a corpus."""

    def __init__(self, words: list[tuple[str, int]]):
        pairs = [[1.0] * 27 for _ in range(27)]
        place = {c: i for i, c in enumerate(string.ascii_lowercase, 1)}
        for word, n in [*words, *((w, 1) for w in IDENTIFIERS)]:
            for a, b in zip(f" {word}", f"{word} ", strict=True):
                pairs[place.get(a, 0)][place.get(b, 0)] += n
        logs = [round(math.log2(x / sum(row)), 4) for row in pairs for x in row]
        self.words = constant(sorted({*(w for w, _ in words), *IDENTIFIERS}), "array<string>")
        self.logs = constant(logs, "array<double>")

    def transitions(self, value: Column) -> Column:
        """The mean log probability of the transitions from letter to letter, 0 if none."""
        codes = F.transform(F.filter(F.split(F.lower(value), ""), lambda c: c != ""), lambda c: F.when(c.between("a", "z") & (F.length(c) == 1), F.ascii(c) - 96).otherwise(0))
        steps = lambda c: F.filter(F.transform(c, lambda x, i: F.when((x > 0) & (F.get(c, i + 1) > 0), F.get(self.logs, 27 * x + F.get(c, i + 1)))), lambda x: x.isNotNull())
        mean = lambda s: F.when(F.size(s) > 0, F.aggregate(s, F.lit(0.0), lambda n, x: n + x) / F.size(s)).otherwise(0.0)
        return let(codes, lambda c: let(steps(c), mean))

    def coverage(self, value: Column) -> Column:
        """The share of characters that are in dictionary words; a word starts at a capital."""
        words = F.split(F.lower(F.regexp_replace(value, "(?<=[a-z])(?=[A-Z])", " ")), "[^a-z]+")
        covered = F.aggregate(F.filter(words, lambda w: F.array_contains(self.words, w)), F.lit(0), lambda n, w: n + F.length(w))
        return covered / F.greatest(F.length(value), F.lit(1))


def lexicon(docs: DataFrame) -> Lexicon:
    """The words of four letters or more that the most documents hold, over all documents."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit("(?<![a-z])[a-z]{4,20}(?![a-z])"), F.lit(0)))
    counts = docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    total = docs.count()
    top = counts.where(F.col("n") * 1000 >= PER_MILLE * total).orderBy(F.desc("n"), "w").limit(DICTIONARY).collect()  # bounded
    return Lexicon([(r["w"], r["n"]) for r in top])


def features(secret: Column, before: Column, after: Column, place: Column, known: Lexicon) -> Column:
    """The forest's inputs for a candidate between two stretches of text, in a document
    from ``place``: an array in the order of ``FEATURES``."""
    value = F.regexp_replace(F.regexp_replace(secret, rf"^(?i:{SECRET_WORDS})\s*=", ""), "^=+|=+$", "")
    return let(value, lambda v: F.array(*(x.cast("double") for x in feature_list(v, secret, before, after, place, known))))


def feature_list(value: Column, secret: Column, before: Column, after: Column, place: Column, known: Lexicon) -> list[Column]:
    n = F.greatest(F.length(value), F.lit(1))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "b"), "[0-9]", "c"), "[^abc]", "d")
    runs = F.regexp_replace(kinds, r"(.)\1*+", "x")
    share = lambda pattern: F.length(F.regexp_replace(value, pattern, "")) / n
    number = lambda condition: F.coalesce(condition, F.lit(False)).cast("double")
    lowered, ahead = F.lower(F.substring(secret, 1, AROUND)), F.lower(before)
    return [
        F.log(n.cast("double")),
        (F.length(runs) - 1) / n,
        known.transitions(value),
        F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(64)),
        share("[^0-9]"),
        share("[^A-Z]"),
        number(value.rlike("^(?:[0-9a-f]++|[0-9A-F]++)$")),
        known.coverage(value),
        F.length(F.regexp_replace(F.lower(value), "[^a-z]|(?<![a-z])[a-z]{1,4}(?![a-z])", "")) / n,
        # the body of a key block is base64, where a slash is no path
        number(value.contains("/") & ~value.startswith("-----BEGIN ") | before.rlike(r"(?:[:/.@]|www)\S{0,30}$") & ~before.rlike(r"[:=]$") | after.rlike(r"^(?:/|\.[a-z]|@)") | F.lower(place).rlike("test|example|fixture|mock")),
        number(value.rlike(r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|sk-|sk_live_|rk_live_|xox[abprs]-|AIza|glpat-|eyJ|-----BEGIN)")),
        number(ahead.rlike(rf"{SECRET_WORDS}\W{{0,6}}$")),
        number(before.rlike(r"[:=]\s*[\"']?$")),
        number(lowered.rlike(rf"^{SECRET_WORDS}\s*=")),
        number(ahead.rlike(rf"{OTHER_WORDS}\W{{0,12}}$")),
        number(F.lower(secret).rlike(FAKE_WORDS) | ahead.rlike(rf"{FAKE_WORDS}\W{{0,12}}$")),
        number(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
    ]


def labelled_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """secret, before, after, place, label: findings as reviewers would have labelled them,
    made by rule from row numbers, half of them true."""
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    letters = F.regexp_replace(F.base64(F.unhex(F.concat(digest("a"), digest("b")))), "[+/=\\s]", "")
    capitals = F.translate(F.upper(letters), "0189", "XYZW")
    hexes = digest("h")
    syllables = F.array(*(F.lit(x) for x in ("er", "on", "ti", "tion", "ment", "que", "ver", "ge", "ci", "an", "le", "sh", "re", "and", "ing", "os")))
    syllable = lambda k: F.element_at(syllables, (F.pmod(F.xxhash64(F.lit(k), F.col("id")), F.lit(16)) + 1).cast("int"))
    word = lambda k: F.concat(syllable(k), syllable(k + 1), syllable(k + 2))
    prose = F.concat_ws(" ", word(0), word(3), word(6), word(9))
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x) if isinstance(x, str) else x for x in xs)), (F.pmod(F.xxhash64(F.lit(77), F.col("id")), F.lit(len(xs))) + 1).cast("int"))
    named = pick("token", "secret", "api_key", "password", "access_key", "auth_token")
    digits = F.regexp_replace(F.conv(F.substring(hexes, 1, 15), 16, 10), "^", "4")
    blank = F.lit(" ")
    cases = [
        # true: the candidate, what stands before it, what stands after it
        (F.substring(hexes, 1, 40), F.concat(prose, F.lit(" "), named, pick(' = "', "='", ': "', ' = "')), pick('" ', "' ", '", ', '"\n'), 1),
        (F.concat(named, F.lit("="), F.expr("substring(sha2(concat('p', id), 256), 1, 18)")), F.concat(prose, blank), pick(" ", "\n", ". "), 1),
        (F.concat(F.lit("AKIA"), F.substring(capitals, 1, 16)), F.concat(prose, pick(" ", "\n", ": ", ' "')), pick(" ", ". ", ",", '"'), 1),
        (F.concat(pick("ghp_", "sk-", "xoxb-", "AIza", "sk_live_", "glpat-"), F.substring(letters, 1, 36)), F.concat(prose, pick(" ", ": ", '="', " Bearer ")), pick(" ", '"', "\n"), 1),
        (F.expr("1").cast("string"), F.concat(prose, blank, named, pick('="', ": ", " = '")), pick('"', " ", "'"), 1),
        (F.concat(F.lit("-----BEGIN "), pick("RSA ", "", "EC ", "OPENSSH "), F.lit("PRIVATE KEY-----\n"), F.repeat(F.concat(letters, F.lit("\n")), (3 + F.pmod("id", F.lit(60))).cast("int")), F.lit("-----END PRIVATE KEY-----")), F.concat(prose, pick(" ", "\n", ": ", ' "')), pick("\n", " ", '"'), 1),
        (F.substring(F.translate(letters, "aeiouAEIOU", "!#$%&*?@^~"), F.lit(1), (6 + F.pmod("id", F.lit(12))).cast("int")), F.concat(prose, blank, named, pick('="', ': "', " = '", "=", ": ")), pick('"', " ", "'", "\n"), 1),
        # false
        (pick(F.substring(hexes, 1, 40), hexes, F.substring(hexes, 1, 32)), F.concat(prose, blank, pick("commit ", "sha256: ", "md5 ", "checksum=", "revision ", "etag: ")), pick(" ", "\n", ". "), 0),
        (F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12)), F.concat(prose, pick(" uuid ", " id ", " ", "/")), pick(" ", "/", "\n"), 0),
        (F.concat(pick("your-api-key-here-", "example_token_value_", "changeme-default-password-", "dummy-secret-"), F.col("id").cast("string")), F.concat(prose, blank, named, pick(" = ", "=", ': "')), pick(" ", '"'), 0),
        (F.concat_ws("/", word(0), word(3), word(6), F.col("id").cast("string")), F.concat(prose, pick(" https:/", " http://www.", " ", " src/")), pick(".html", " ", "/", "?"), 0),
        (F.concat(word(0), pick("_", "-", ""), word(3), word(6), pick("_v", "-", ""), F.col("id").cast("string")), F.concat(prose, blank), pick(" ", ". ", "()", ","), 0),
        (F.concat_ws("_", pick("test", "get", "reset", "is", "make"), pick("password", "token", "secret", "api_key", "user"), word(0), word(3), F.pmod("id", F.lit(100)).cast("string")), F.concat(prose, pick(" def ", " self.", " ", " new ")), pick("(", ":", " ", "()"), 0),
        (F.concat(F.initcap(word(0)), F.initcap(word(3)), F.initcap(word(6)), F.pmod("id", F.lit(10)).cast("string")), F.concat(prose, pick(" com.", " org.a.", " ", " class ")), pick(" ", ".", "(", "<"), 0),
        (pick(F.substring(hexes, 1, 16), F.substring(letters, 1, 64), hexes), F.concat(prose, pick(" app.", " main-", " sha512-", " image@sha256:", " sha256-")), pick(".js", ".min.css", " ", ".png"), 0),
        (F.concat(pick("1Z", "RB", "LX"), F.upper(F.substring(hexes, 1, 2)), F.substring(digits, 1, 12)), F.concat(prose, pick(" number ", " parcel ", " tracking ", " ref ")), pick(" ", ". ", ","), 0),
        (pick(F.substring(digits, 1, 16), F.concat(digits, digits)), F.concat(prose, pick(" ", " order ", " invoice ", " tracking ", " call ", "")), pick(" ", ". ", "\n"), 0),
    ]
    # seven true kinds and ten false ones, each half of the rows
    case = F.pmod(F.xxhash64(F.lit(3), F.col("id")), F.lit(2 * 7 * 10))
    which = F.when(case < 70, F.pmod(case, F.lit(7))).otherwise(7 + F.pmod(case, F.lit(10)))
    columns = []
    for k, (secret, before, after, label) in enumerate(cases):
        if k == 4:
            secret = F.expr("substring(regexp_replace(base64(unhex(concat(sha2(concat('a', id), 256), sha2(concat('b', id), 256)))), '[+/=\\\\s]', ''), 1, cast(20 + pmod(id, 30) as int))")
        columns.append(F.struct(secret.alias("secret"), F.right(before, F.lit(AROUND)).alias("before"), after.alias("after"), F.lit("web").alias("place"), F.lit(float(label)).alias("label")))
    return spark.range(rows, numPartitions=4).select(F.element_at(F.array(*columns), (which + 1).cast("int")).alias("x")).select("x.*")


class Judge:
    """A fitted forest as an expression, so that a candidate is judged within its row."""

    def __init__(self, model: RandomForestClassificationModel, known: Lexicon, folder: str):
        self.known, path = known, f"{folder}/forest-{uuid.uuid4().hex}"
        model.write().save(path)
        # the saved form has a row a node: numTrees * 2 ** (maxDepth + 1) rows at most
        nodes = SparkSession.active().read.parquet(f"{path}/data")
        rows = nodes.select("treeID", "nodeData.id", "nodeData.impurityStats", "nodeData.leftChild", "nodeData.rightChild", F.col("nodeData.split.featureIndex").alias("feature"), F.col("nodeData.split.leftCategoriesOrThreshold").alias("cut")).orderBy("treeID", "id").collect()
        remove(SparkSession.active(), path)
        trees: dict[int, list] = {}
        for r in rows:
            leaf = r["leftChild"] < 0
            node = {"f": 0 if leaf else r["feature"], "c": 0.0 if leaf else r["cut"][0], "l": r["id"] if leaf else r["leftChild"], "r": r["id"] if leaf else r["rightChild"], "p": r["impurityStats"][1] / sum(r["impurityStats"])}
            trees.setdefault(r["treeID"], []).append(node)
        self.count, self.depth = len(trees), max(t.depth for t in model.trees)
        self.trees = constant([trees[k] for k in sorted(trees)], "array<array<struct<f:int,c:double,l:int,r:int,p:double>>>")

    def score(self, x: Column) -> Column:
        """The share of the trees' votes for a true secret."""
        step = lambda tree: lambda node, _: F.when(F.get(x, F.get(tree, node)["f"]) <= F.get(tree, node)["c"], F.get(tree, node)["l"]).otherwise(F.get(tree, node)["r"])
        leaf = lambda tree: F.get(tree, F.aggregate(F.sequence(F.lit(1), F.lit(max(self.depth, 1))), F.lit(0), step(tree)))["p"]
        return F.aggregate(self.trees, F.lit(0.0), lambda total, tree: total + leaf(tree)) / self.count


def fit(findings: DataFrame, known: Lexicon) -> RandomForestClassificationModel:
    """The forest over labelled findings (secret, before, after, place, label)."""
    x = array_to_vector(features(F.col("secret"), F.col("before"), F.col("after"), F.col("place"), known))
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=40, maxDepth=8, seed=2)
    rows = staged(findings.select(x.alias("x"), "label"), "findings")  # read several times
    model = forest.fit(rows)
    discard(rows)
    return model


def judge_of(docs: DataFrame, findings: DataFrame | None = None) -> Judge:
    spark, known = docs.sparkSession, lexicon(docs)
    return Judge(fit(labelled_findings(spark) if findings is None else findings, known), known, shared_dir(spark))


def candidates(text: Column) -> Column:
    """Array of (rest, found, before, after): the text between candidates, the candidate that
    follows it (null at the end), and its neighbours."""
    zipped = F.arrays_zip(F.split(text, PATTERN, -1).alias("rest"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("found"))

    def placed(every: Column) -> Column:
        none = F.lit("")
        of = lambda x, name: F.coalesce(x[name], none)
        last = lambda s: F.right(s, F.lit(AROUND))
        first = lambda s: F.substring(s, 1, AROUND)

        def one(x: Column, i: Column) -> Column:
            back, on = F.get(every, i - 1), F.get(every, i + 1)
            before = last(F.concat(last(of(back, "rest")), last(of(back, "found")), last(of(x, "rest"))))
            after = first(F.concat(first(of(on, "rest")), first(of(on, "found"))))
            return F.struct(x["rest"].alias("rest"), x["found"].alias("found"), before.alias("before"), after.alias("after"))

        return F.transform(every, one)

    return let(zipped, placed)


def judged(text: Column, place: Column, judge: Judge) -> Column:
    """Array of (rest, found, x, score) of a text; empty without a candidate."""

    def one(c: Column) -> Column:
        x = features(c["found"], c["before"], c["after"], place, judge.known)
        return let(F.when(c["found"].isNotNull(), x), lambda x: F.struct(c["rest"].alias("rest"), c["found"].alias("found"), x.alias("x"), F.when(x.isNotNull(), judge.score(x)).alias("score")))

    return F.transform(candidates(text), one)


def starts(pieces: Column) -> Column:
    """Where each candidate starts, in characters: sums within chunks, then over these."""
    width = lambda x: (F.length(x["rest"]) + F.coalesce(F.length(x["found"]), F.lit(0))).cast("long")
    state = lambda kind: F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("starts"))
    inner = lambda acc, x: F.struct((acc["at"] + width(x)).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + F.length(x["rest"]))).alias("starts"))
    outer = lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / CHUNK).cast("int")), lambda c: F.aggregate(F.slice(pieces, c * CHUNK + 1, F.lit(CHUNK)), state(0), inner))
    bases = lambda cs: F.aggregate(cs, state(0), outer)["starts"]
    return let(chunks, lambda cs: let(bases(cs), lambda bs: F.flatten(F.transform(cs, lambda c, i: F.transform(c["starts"], lambda s: s + F.get(bs, i))))))


def place_of(docs: DataFrame) -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")


def find_secrets(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """doc_id, start, length, kind, secret and score of every finding that the forest
    confirms."""
    judge, text = judge_of(docs, findings), F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), place_of(docs).alias("place"))
    rows = rows.where(text.rlike(PATTERN)).select("doc_id", judged(text, F.col("place"), judge).alias("pieces"))
    rows = rows.where(F.exists("pieces", lambda p: p["score"] >= SURE))
    each = rows.select("doc_id", F.explode(F.arrays_zip(starts(F.col("pieces")).alias("start"), F.col("pieces").alias("piece"))).alias("x")).where(F.col("x.piece.score") >= SURE)
    secret, x = F.col("x.piece.found"), lambda name: F.col("x.piece.x")[FEATURES.index(name)]
    kind = F.when(secret.startswith("-----BEGIN"), "key block").when(x("prefix") == 1, "key with a known prefix").when((x("inside_assign") == 1) | (x("before_secret") == 1), "assigned value").otherwise("key-like run")
    return each.select("doc_id", F.col("x.start").alias("start"), F.length(secret).cast("long").alias("length"), kind.alias("kind"), secret.alias("secret"), F.col("x.piece.score").alias("score"))


def masked(text: Column, place: Column, judge: Judge) -> Column:
    """A text with every confirmed secret replaced, wherever it occurs; a short one, which may
    be a common word, only where it is a candidate."""

    def put(pieces: Column) -> Column:
        secrets = F.array_distinct(F.transform(F.filter(pieces, lambda p: p["score"] >= SURE), lambda p: p["found"]))

        def whole(own: Column) -> Column:
            out = F.array_join(F.transform(pieces, lambda p: F.concat(p["rest"], F.when(F.array_contains(own, p["found"]), MASK).otherwise(F.coalesce(p["found"], F.lit(""))))), "")
            # the longest first, so that a secret within another leaves no rest
            long = F.transform(F.sort_array(F.transform(F.filter(own, lambda s: F.length(s) >= 16), lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))), asc=False), lambda v: v["s"])
            return F.when(F.size(own) == 0, text).otherwise(F.aggregate(long, out, lambda t, s: F.replace(t, s, F.lit(MASK))))

        return let(secrets, whole)

    return F.when(text.rlike(PATTERN), let(judged(text, place, judge), put)).otherwise(text)


def mask_secrets(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """``docs`` with every confirmed secret replaced by a mask, and n_chars (if there) the
    new length where the text has changed. No document goes, and no row moves."""
    judge, text = judge_of(docs, findings), F.col("text")
    new = masked(text, place_of(docs), judge)
    if "n_chars" not in docs.columns:
        return docs.withColumn("text", new)
    both = let(new, lambda t: F.struct(t.alias("text"), F.when(t.eqNullSafe(text), F.col("n_chars")).otherwise(F.length(t)).cast(docs.schema["n_chars"].dataType).alias("n_chars")))
    free = free_name(docs, "masked")
    rows = docs.withColumn(free, both)
    return rows.withColumns({"text": F.col(free)["text"], "n_chars": F.col(free)["n_chars"]}).select(*map(quoted, docs.columns))
