"""Operator 5: secret scans, whose candidates a random forest accepts or drops.

One pattern marks candidates in a text: values assigned to a name that has a secret-like word in it
(DB_PASSWORD, dbPassword, auth_token, SECRET_KEY_BASE), keys of known shapes, private key blocks, and long runs of key letters with a digit. Each candidate is described by
its length, character transitions, dictionary coverage, the document's path and the words
beside it; a random forest, trained from labelled findings, gives the probability that it is a secret.
The dictionary is the first words of a public vocabulary, and some that keys in code are made of.
The findings to learn from are made by rule in labelled_findings() and can be replaced by a table
of the same columns. The fitted trees become one Column, so scanning is a projection: no Python runs
on executors, nothing is shuffled for it, and hot sources or copies are spread as the input is.

Defined cases: null or empty texts and empty tables have no findings; a null path is an empty path;
repeated rows are scanned each; very long texts are scanned whole; the control signs U+0001 and U+0002 count as blanks; columns other than
those named are not read by scan() and are kept by redact().
"""

from __future__ import annotations

import json
from functools import cache

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tokenizer_path, unused

OPEN, CLOSE, THRESHOLD, TREES, DEPTH, FINDINGS = "\x01", "\x02", 0.5, 20, 6, 3000
_KEYS = "api|access|private|signing|client|secret|encryption|master"
NAMES = rf"pass(?:word|wd|phrase)?|pwd|secret|token|credentials?|auth(?:orization)?|bearer|(?:{_KEYS})[_ -]?(?:key|secret|token)"
#: The same as one hump of a camel-case name.
HUMPS = r"Pass(?:[Ww]ord|[Ww]d|[Pp]hrase)?|Pwd|PWD|Secret|Token|Credentials?|Auth(?:orization)?|Bearer|(?:Api|API|Access|Private|Signing|Client|Encryption|Master)Key"
_LETTERS = r"A-Za-z0-9+/_\-"
_IN_NAME = r"[A-Za-z0-9_.\-]"
_ASSIGN = r"[\"']?\]?\s{0,3}(?::=|=>|={1,3}|:)\s{0,3}[\"']?"
#: A whole identifier that is assigned and has one of NAMES anywhere in it, or two words such as 'api key'. What is possessive here keeps the search linear.
_NAMED = rf"(?<!{_IN_NAME})(?=(?:(?i:{_KEYS})[ ])?{_IN_NAME}++{_ASSIGN})(?=(?i:{_IN_NAME}*?(?:{NAMES})))(?:(?i:{_KEYS})[ ](?i:key|secret|token))?{_IN_NAME}*+{_ASSIGN}(?i:bearer\s)?"
_HEADER, _FOOTER = (rf"-----{x} [A-Z0-9 ]{{0,40}}PRIVATE KEY(?: BLOCK)?-----" for x in ("BEGIN", "END"))
#: A block up to its END line, whatever is between; one that is cut off ends with its key letters.
_BLOCK = rf"{_HEADER}(?:(?:(?!-----BEGIN )[\s\S])*?{_FOOTER}|(?=(?:\s|\\[nr]){{1,4}}[A-Za-z0-9+/]{{40}})[A-Za-z0-9+/=\s\\]*+)?"
_SIGNED = r"eyJ[0-9A-Za-z_-]{10,}(?:\.[0-9A-Za-z_-]*){0,3}\.[0-9A-Za-z_-]+"
_PLAIN = r"(?!-----BEGIN )(?:(?<=\")[^\s\"\x01\x02]{8,}|(?<=')[^\s'\x01\x02]{8,}|[^\s\"'<>\x01\x02]{8,})"
PATTERN = (
    rf"((?<![{_LETTERS}]){_SIGNED}|{_BLOCK})"
    rf"|({_NAMED})({_BLOCK}|{_PLAIN})"
    rf"|((?<![{_LETTERS}])(?=[A-Za-z+/_\-]*+[0-9])[{_LETTERS}]{{20,}}={{0,2}})"
)
KINDS = {"private_key": r"^-----BEGIN ", "cloud_key_id": r"^(?:AKIA|ASIA)[0-9A-Z]{16}$", "forge_token": r"^gh[pousr]_[0-9A-Za-z]{30,}$", "signed_token": r"^eyJ[0-9A-Za-z_-]{10,}\."}
#: Words that fill keys that are none, and names in code.
DICTIONARY = "your example sample dummy placeholder changeme change insert replace enter value here secret password passwd token key api access client user admin test testing demo fake mock default null none todo get set name file path index list item data type id handler service request response config version main java src lib com org http https www html json page image static assets build the and for with from".split()
#: Words taken from the public vocabulary, in its order, and the letters that a word has at least.
VOCABULARY_WORDS, WORD_LETTERS = 4000, 4
BESIDE_HASH = r"(?i)(?:commit|revision|rev|sha-?\d*|md5|crc|checksum|digest|hash|etag|uuid|guid|build|version|fingerprint|card|order|invoice|phone|id)\W{0,4}(?:\w{0,12}\W{1,4})?$"
BESIDE_EXAMPLE = r"(?i)example|sample|dummy|placeholder|for instance|replace|fake|your"
PATH_TEST, PATH_CONFIG = r"(?i)test|spec|example|sample|fixture|doc|readme", r"(?i)\.env|config|settings|secret|deploy|prod|\.ya?ml|\.ini|\.tf"


@cache
def vocabulary(path: str | None = None, most: int = VOCABULARY_WORDS) -> str:
    """Whole words of a public vocabulary and those of DICTIONARY, each between blanks."""
    with open(path or tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    words = [w[:-4] for w in sorted(ids, key=ids.get) if w.endswith("</w>")]
    words = [w for w in words if len(w) >= WORD_LETTERS and w.isascii() and w.isalpha()]
    return f" {' '.join(dict.fromkeys([*words[:most], *DICTIONARY]))} "


def worded(c: Column, n: Column) -> Column:
    """The share of a candidate's letters in runs or humps that are words of the vocabulary."""
    parts = F.filter(F.split(F.regexp_replace(c, F.lit("(?<=[a-z])(?=[A-Z])"), F.lit(" ")), "[^A-Za-z]+"), lambda p: F.length(p) >= WORD_LETTERS)
    known = F.filter(parts, lambda p: F.contains(F.lit(vocabulary()), F.concat(F.lit(" "), F.lower(p), F.lit(" "))))
    return F.length(F.array_join(known, "")) / n


def features(c: Column, left: Column, right: Column, path: Column) -> list[Column]:
    """The description of one candidate, as doubles."""
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    count = lambda p: F.regexp_count(c, F.lit(p)).cast("double")
    flag = lambda x: x.cast("double")
    words = "|".join(sorted(DICTIONARY, key=lambda w: -len(w)))
    return [
        n,
        count("[0-9]") / n,
        count("[A-Z]") / n,
        count("[^A-Za-z0-9]") / n,
        count(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / n,
        F.size(F.array_distinct(F.split(F.substring(c, 1, 64), ""))) / F.least(n, F.lit(64.0)),
        1.0 - F.length(F.regexp_replace(F.lower(c), F.lit(words), F.lit(""))) / n,
        worded(c, n),
        count(r"(.)\1\1") / n,
        flag(F.lower(c).rlike("1234|abcd|0123|qwerty")),
        flag(c.rlike("^(?:[0-9a-f]{20,}|[0-9A-F]{20,})$")),
        flag(c.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-")),
        flag(c.rlike("|".join(KINDS.values()))),
        flag(left.rlike(rf"(?i)(?:{NAMES}){_IN_NAME}*+{_ASSIGN}(?:bearer\s)?$")),
        flag(left.rlike(rf"(?:(?<![A-Za-z])(?i:{NAMES})|(?<![A-Z])(?:{HUMPS}))s?(?![a-z]){_IN_NAME}*+{_ASSIGN}(?i:bearer\s)?$")),
        flag(left.rlike(rf"(?i)\b(?:{NAMES})\b")),
        flag(left.rlike(BESIDE_HASH)),
        flag(left.rlike(BESIDE_EXAMPLE) | right.rlike(BESIDE_EXAMPLE)),
        flag(path.rlike(PATH_TEST)),
        flag(path.rlike(PATH_CONFIG)),
    ]


def labelled_findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """candidate, left_words, right_words, path, label, and the number of the rule that made it (kind): findings whose truth is known as they are made by rule.

    A bounded table of one partition, so that the forest's draws do not depend on the cluster.
    """
    h = F.sha2(F.concat(F.lit("finding "), F.col("id").cast("string")), 256)
    b = F.base64(F.unhex(h))
    plain = F.regexp_replace(b, "[^A-Za-z0-9]", "")
    long_ = F.concat(plain, F.regexp_replace(F.base64(F.unhex(F.sha2(h, 256))), "[^A-Za-z0-9]", ""))
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.pmod(F.xxhash64("id", F.lit(len(x))), F.lit(len(x))) + 1).cast("int"))
    name = pick("token = \"", "token: ", "api_key = '", "secret=", "password: ", "PASSWORD=\"", "access_token => ", "client_secret = ", "auth: ", "TOKEN = \"", "API_KEY=")
    word = pick("the value is ", "in which ", "und die ", "para que ", "dans les ", "set as follows: ", "THE LAST ", "")
    number = F.conv(F.substring(h, 1, 12), 16, 10)
    hex40, up40 = F.substring(h, 1, 40), F.upper(F.substring(h, 1, 40))
    dashed = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    within = pick("DB_PASSWORD=", "auth_token=", "dbPassword: \"", "SECRET_KEY = \"", "smtp.password=", "MYSQL_ROOT_PASSWORD: ", "userPassword = '", "\"clientSecret\": \"", "aws_secret_access_key = ", "x-api-key: ", "SECRET_KEY_BASE=", "sessionToken: '", "REDIS_PWD=")
    other = pick("author: ", "Authors = ", "compass: ", "passage: \"", "secretary: ", "tokenizer = \"", "authority: ", "bypass=", "passenger: ", "author=\"", "passed: ", "encompasses: ")
    mark = pick("!", "&", "@", "#", "$", "%", "^", "*", "?")
    more = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.col("id") % 47 + 2), lambda i: F.base64(F.unhex(F.sha2(F.concat(h, i.cast("string")), 256)))), "")
    hashed = pick("commit ", "sha1: ", "md5 = ", "checksum ", "revision ", "digest: ", "uuid: ", "etag ", "build ")
    kinds = [
        (1, hex40, F.concat(word, name)),
        (1, up40, F.concat(word, name)),
        (1, F.substring(long_, 1, 32), F.concat(word, name)),
        (1, b, F.concat(word, name)),
        (1, F.concat(F.lit("AKIA"), F.upper(F.substring(plain, 1, 16))), word),
        (1, F.concat(F.lit("ghp_"), F.substring(long_, 1, 36)), word),
        (1, F.concat(F.lit("eyJ"), F.substring(long_, 1, 30), F.lit("."), F.substring(long_, 20, 30)), F.concat(word, pick("", "token: ", "Authorization: Bearer "))),
        (1, F.concat(F.substring(plain, 1, 10), pick("!", "#7", "_9", "@2")), F.concat(word, pick("password: ", "pwd=", "passwd = \""))),
        (1, F.lit("-----BEGIN RSA PRIVATE KEY-----"), word),
        (1, F.substring(h, F.lit(1), (F.col("id") % 17 + 10).cast("int")), F.concat(word, pick("password=", "passwd: ", "pwd = \"", "secret=", "token=", "PASSWORD="))),
        (1, F.translate(F.substring(h, 3, 18), "abcd", "4703"), F.concat(word, pick("password=", "pwd: ", "secret = '", "token=", "PASSWORD="))),
        (1, F.substring(plain, F.lit(1), (F.col("id") % 13 + 10).cast("int")), F.concat(word, name)),
        (1, F.concat(F.substring(plain, F.lit(1), (F.col("id") % 6 + 6).cast("int")), mark, F.substring(plain, F.lit(20), (F.col("id") % 5 + 1).cast("int"))), F.concat(word, within)),
        (1, F.substring(plain, F.lit(1), (F.col("id") % 13 + 9).cast("int")), F.concat(word, within)),
        (1, F.concat(pick("Tr", "xK", "summer", "Winter", "blue", "q", "Dragon"), F.substring(h, 1, 3), pick("door", "Fox", "rain", "k", "ship"), mark, (F.col("id") % 90 + 10).cast("string"), pick("x", "Z", "", "!")), F.concat(word, pick("password: ", "pwd=", "DB_PASSWORD=", "dbPassword: \"", "\"password\": \"", "ADMIN_PASS="))),
        (1, more, F.concat(word, within)),
        (1, F.regexp_replace(more, "[^A-Za-z0-9]", ""), F.concat(word, name)),
        (1, F.concat(F.lit("eyJ"), F.substring(long_, 1, 20), F.lit("."), F.regexp_replace(more, "[^A-Za-z0-9]", ""), F.lit("."), F.substring(long_, 20, 30)), F.concat(word, pick("", "token: ", "Authorization: Bearer ", "id_token=\""))),
        (1, F.concat(F.lit("-----BEGIN "), pick("RSA ", "", "ENCRYPTED ", "EC "), F.lit("PRIVATE KEY-----"), pick("\n", "\\n", "\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,00\n\n"), more, pick("\n", "\\n"), F.lit("-----END PRIVATE KEY-----")), F.concat(word, pick("", "\"private_key\": \"", "private_key = \"", "key: "))),
        (0, hex40, F.concat(word, hashed)),
        (0, F.substring(h, 1, 32), F.concat(word, hashed)),
        (0, dashed, F.concat(word, pick("id: ", "uuid = ", "request ", ""))),
        (0, F.concat(pick("your_api_key_here_", "example_token_", "insert-token-here-", "changeme_password_", "dummy_secret_value_"), (F.col("id") % 97).cast("string")), F.concat(word, name)),
        (0, F.concat(pick("password", "changeme", "example", "placeholder", "test_token"), (F.col("id") % 9).cast("string")), F.concat(word, name)),
        (0, F.concat(F.lit("src/main/java/com/"), F.substring(h, 1, 3), pick("/service/handler", "/config/version", "/index/list")), word),
        (0, F.repeat(pick("/assets/image", "data-list-item/", "get_user_by_name,", "function(request);"), (F.col("id") % 40 + 4).cast("int")), F.concat(word, pick("author: ", "auth_path=", "", "token: "))),
        (0, F.concat(number, number), F.concat(word, pick("card ", "order ", "", "phone "))),
        (0, F.repeat(F.substring(h, 1, 1), 24), F.concat(word, name)),
        (0, F.concat(F.lit("1234567890abcdef"), pick("1234567890abcdef", "12345678", "0000")), F.concat(word, name)),
        (0, F.concat(pick("get_user_by_name_", "list_all_items_in_", "request_handler_for_"), (F.col("id") % 50).cast("string"), pick("_version", "_test", "_data")), word),
        (0, F.concat(F.lit("https/www/static/assets/"), F.substring(h, 1, 6), F.lit("/image/page")), word),
        (0, F.concat(pick("Christopher", "Elisabeth", "northwest", "Department", "Alexandria", "function", "Katharina", "government", "something", "Fernandez"), pick("", ",", ".", "-Smith", ";")), F.concat(word, other)),
        (0, pick("required", "optional,", "undefined;", "forgotten", "somebody", "incorrect.", "expired,", "request.body.password", "process.env.DB_PASSWORD", "getpass.getpass()", "os.environ.get(", "password_hash", "function(request)", "string,", "encrypted."), F.concat(word, pick("password: ", "token: ", "secret = ", "PASSWORD=", "dbPassword: ", "auth: ", "auth_token = "))),
        (0, F.concat(pick("/usr/share/", "http://www.", "/etc/", "lib/modules."), pick("document/", "common.", "words/"), pick("overview", "settings.page", "introduction")), F.concat(word, pick("passage: ", "auth_path=", "token_file = \"", "author: ", "secret_dir="))),
        (0, hex40, pick("the tree ", "see ", "at object ", "parent ", "merged ")),
    ]
    one = lambda i: F.element_at(F.array(*[k[i] if isinstance(k[i], Column) else F.lit(k[i]) for k in kinds]), (F.col("id") % len(kinds) + 1).cast("int"))
    path = pick("", "src", "app/config.yaml", "deploy/.env", "docs/readme", "tests/test_app", "web", "crawl")
    return spark.range(0, rows, 1, 1).select(one(1).alias("candidate"), one(2).alias("left_words"), pick("\" and", " ,", "'", "", "\"!!").alias("right_words"), path.alias("path"), one(0).cast("double").alias("label"), (F.col("id") % len(kinds)).alias("kind"))


class Forest:
    """A fitted random forest as a Column."""

    def __init__(self, findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 7):
        described = findings.select("label", array_to_vector(F.array(*features(*map(F.col, ("candidate", "left_words", "right_words", "path"))))).alias("features"))
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64).fit(described)
        self.model = model
        self.trees = [self._node(t._call_java("rootNode")) for t in model.trees]

    def _node(self, node) -> tuple | float:
        if not node.subtreeDepth():
            stats = list(node.impurityStats().stats())
            return stats[1] / max(sum(stats), 1e-9)
        return node.split().featureIndex(), node.split().threshold(), self._node(node.leftChild()), self._node(node.rightChild())

    def probability(self, x: Column) -> Column:
        """Mean probability over the trees, of features x (an array)."""

        def of(node: tuple | float) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, threshold, left, right = node
            return F.when(x[feature] <= threshold, of(left)).otherwise(of(right))

        total = of(self.trees[0])
        for tree in self.trees[1:]:
            total = total + of(tree)
        return total / len(self.trees)


_forests: dict[str, Forest] = {}


def forest(spark: SparkSession) -> Forest:
    """The forest of the findings made by rule, fitted once for each application."""
    key = spark.sparkContext.applicationId
    if key not in _forests:
        _forests[key] = Forest(labelled_findings(spark))
    return _forests[key]


def _segments(text: Column) -> Column:
    """The text cut before each candidate; all but the first begin with a candidate that ends at CLOSE."""
    clean = F.translate(text, OPEN + CLOSE, "  ")
    return F.split(F.regexp_replace(clean, F.lit(PATTERN), F.lit(f"$2{OPEN}$1$3$4{CLOSE}")), OPEN)


def _candidate(segment: Column) -> Column:
    return F.substring_index(segment, CLOSE, 1)


def _rest(segment: Column) -> Column:
    """What follows the candidate; the first segment has no candidate."""
    return F.when(F.instr(segment, CLOSE) > 0, F.substring(segment, F.instr(segment, CLOSE) + F.lit(1), F.length(segment))).otherwise(segment)


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _score(trees: Forest, before: Column, segment: Column, path: Column) -> Column:
    rest = _rest(before)
    left = F.substring(rest, F.greatest(F.lit(1), F.length(rest) - 59), F.lit(60))
    x = F.array(*features(_candidate(segment), left, F.substring(_rest(segment), 1, 40), path))
    return _let(x, trees.probability)


def scan(docs: DataFrame, trees: Forest | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, nth (of the row's candidates), start, length, kind, score and digest of each candidate; start counts characters from 0."""
    trees = trees or forest(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _segments(F.col(text_col)).alias("segments"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"))
    rows = rows.where(F.size("segments") > 1).withColumn("row", F.monotonically_increasing_id())
    both = F.transform(F.sequence(F.lit(2), F.size("segments")), lambda i: F.struct(F.element_at("segments", i - 1).alias("before"), F.element_at("segments", i).alias("segment")))
    each = rows.select("row", "doc_id", "path", F.posexplode(both).alias("nth", "s"))
    c = _candidate(F.col("s.segment"))
    kind = F.coalesce(*[F.when(c.rlike(p), F.lit(k)) for k, p in KINDS.items()], F.lit("value"))
    found = each.select("row", "doc_id", "nth", F.length(_rest(F.col("s.before"))).alias("gap"), F.length(c).alias("length"), kind.alias("kind"), _score(trees, F.col("s.before"), F.col("s.segment"), F.col("path")).alias("score"), F.sha2(c, 256).alias("digest"))
    ahead = F.expr("sum(gap + length) over (partition by row order by nth rows between unbounded preceding and current row) - length")
    return found.select("doc_id", "nth", ahead.cast("long").alias("start"), F.col("length").cast("long").alias("length"), "kind", "score", "digest")


def secrets(docs: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The candidates that the forest takes for secrets."""
    return scan(docs, **options).where(F.col("score") >= threshold)


def redact(docs: DataFrame, trees: Forest | None = None, text_col: str = "text", path_col: str = "source", threshold: float = THRESHOLD, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret in the text replaced by mark; texts without one are unchanged."""
    trees = trees or forest(docs.sparkSession)
    path = F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    parts = unused("segments", docs)
    segments = docs.withColumn(parts, _segments(F.col(text_col)))

    def cleaned(s: Column) -> Column:
        kept = lambda i: F.when(_score(trees, F.element_at(s, i - 1), F.element_at(s, i), path) >= threshold, F.lit(mark)).otherwise(_candidate(F.element_at(s, i)))
        return F.array_join(F.concat(F.slice(s, 1, 1), F.transform(F.sequence(F.lit(2), F.size(s)), lambda i: F.concat(kept(i), _rest(F.element_at(s, i))))), "")

    text = F.when(F.size(parts) > 1, cleaned(F.col(parts))).otherwise(F.col(text_col))
    return segments.withColumn(text_col, text).drop(parts)
