"""Secret scans: candidates by pattern, false positives removed by a random forest compiled into one SQL expression (DataFrame functions only)."""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of token characters of this length or more is a candidate; so is a value of SHORTEST or more assigned to a secret name.
LEAST, SHORTEST = 16, 6
#: Characters of the line before and after a candidate that the forest sees.
BEFORE, AFTER = 40, 24
#: Words of names that hold credentials, what may follow them in a name, and words that stand before things that look like them.
SECRET_WORDS = ("token", "secret", "pass", "passwd", "password", "passphrase", "passcode", "pwd", "apikey", "auth", "bearer", "credential", "credentials", "creds", "private", "access", "sas", "dsn", "pin")
NAME_ENDS = ("key", "value", "string", "hash", "code", "prod", "dev", "live", "base64", "new", "old")
KEY_OWNERS = ("api", "access", "private", "secret", "account", "storage", "azure", "aws", "gcp", "heroku", "stripe", "twilio", "sendgrid", "signing", "encryption", "master", "service", "app", "client", "session", "admin", "license", "ssh", "deploy", "webhook", "shared", "subscription")
PLAIN_WORDS = ("sha256", "sha1", "sha512", "md5", "checksum", "commit", "uuid", "guid", "hash", "digest", "http", "path", "file", "example", "version", "test", "dummy", "sample", "href", "src", "image", "build", "revision", "integrity")
#: How public formats of keys begin, and whole forms of some.
KNOWN = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xapp-", "sk_live_", "rk_live_", "sk-proj-", "AIza", "ya29.", "eyJ", "SG.", "npm_", "pypi-", "hf_", "dckr_pat_", "shpat_", "sq0csp-", "GOCSPX-", "-----BEGIN")
KNOWN_FORMS = (r"(SK|AC)[0-9a-f]{32}", r"key-[0-9a-f]{32}", r"[MNO][A-Za-z0-9]{23,25}\.[\w-]{6}\.[\w-]{27,38}", r"\d{8,10}:AA[\w-]{33}")
#: What stands in for a secret in examples.
STAND_INS = ("example", "placeholder", "changeme", "your", "xxxx", "0000", "1234", "dummy", "sample", "redacted", "insert", "none", "null", "true", "false", "string", "required", "environ", "getenv", "process", "config", "${", "{{", "<", "***", "...")
#: Frequent pairs of letters in English, German, French and Spanish words.
PAIRS = ("th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "ve", "co", "me", "de", "hi", "ri", "ro", "ic", "ne", "ea", "ra", "ce", "li", "ch", "ll", "be", "ma", "si", "om", "ur", "us", "qu", "ie", "ei", "la", "ta", "el", "no", "un", "et", "os", "do", "em", "id", "ec", "ac", "il", "em", "ss", "pa", "lo")
#: Frequent fragments of words, for dictionary coverage.
FRAGMENTS = ("tion", "ing", "the", "and", "ent", "ment", "ver", "con", "pro", "com", "test", "file", "name", "data", "user", "index", "main", "page", "home", "info", "list", "item", "type", "time", "date", "code", "path", "http", "www", "org", "net", "html", "json", "mail", "example", "ist", "ers", "ate", "ess", "ion", "ous", "able", "ich", "ein", "der", "sch", "que", "ado", "mente", "ción", "token", "secret", "key", "service", "client", "manager", "module", "report", "server", "config", "build", "image", "render", "letter", "winter", "garden", "string", "value")

_TOKEN = r"A-Za-z0-9+/_.\-"
_RUN = rf"(?<![{_TOKEN}])[{_TOKEN}]{{{LEAST},}}={{0,2}}"
# A name by whole words: of letters between signs, digits and capitals; what is ``author`` or counts tokens is no such name.
_WORDS = "|".join(sorted(SECRET_WORDS, key=len, reverse=True))
_ENDS = "|".join(NAME_ENDS)
_TAIL = rf"(?:[_\-.]?(?:{_ENDS}|[0-9]{{1,3}}))?" * 2  # a look-behind allows no repeated group
_NAMES = rf"(?:(?<![A-Za-z])(?i:{_WORDS})|(?<=[a-z])(?:{'|'.join(w.capitalize() for w in SECRET_WORDS)})|(?i:{'|'.join(KEY_OWNERS)})[_\-.]?(?i:key))(?i:{_TAIL})(?![A-Za-z0-9_\-])"
# A look-behind of one character goes before each long one, which is tried at few places then.
_ASSIGNED = rf"""(?<=[:= \t"'])(?<={_NAMES}["']?[ \t]{{0,3}}[:=]{{1,2}}[ \t]{{0,3}}["']?)(?<![{_TOKEN}])[^\s"',;<>:=]{{{SHORTEST},}}"""
_IN_URL = rf"(?<=:)(?<=://[^\s:/@]{{1,64}}:)[^\s@/]{{{SHORTEST},}}(?=@)"
_HEADER = r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"
CANDIDATE = rf"{_HEADER}|{_IN_URL}|{_ASSIGNED}|{_RUN}"
#: What a line without any candidate lacks, in cheap tests.
_HINT = rf"{_NAMES}[\"']?[ \t]{{0,3}}[:=]|://"
#: With the text before and after; a look-behind tries its shortest text first, so each length is anchored.
_AROUND = rf"(?<![A-Za-z0-9])(?=\S)(?<=(^(?s:.{{0,{BEFORE - 1}}})|(?s:.{{{BEFORE}}})))({CANDIDATE})(?=((?s:.{{0,{AFTER}}})))"
FEATURES = (
    "length", "digits", "uppers", "lowers", "others", "class_changes", "distinct", "vowels", "fragments", "slashes", "dots", "dashes", "hexes", "known", "stand_in",
    "pairs", "secret_word", "plain_word", "secret_near", "secret_name", "secret_after", "plain_after", "assigned", "quoted", "in_path", "in_url", "run_of_same",
)


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per candidate: key, line_no (from 0), nth (place among its line's candidates), token, before, after.

    Candidates are runs of 16 or more token characters with a digit and a letter, values of 6 or more characters assigned to
    a name with a secret word, passwords in addresses, and headers of private keys. ``before`` and ``after`` are the 40 and 24
    characters around the token on its line, whatever they are. Lines are scanned apart and whole; null and empty
    texts have none.
    """
    lines = docs.select(F.col(key).alias("_key"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))
    line = F.col("line")  # the cheap tests come first: prose has few digits, colons and equals signs
    hint = line.rlike("[0-9]") & line.rlike(f"[{_TOKEN}]{{{LEAST}}}") | (F.contains(line, F.lit(":")) | F.contains(line, F.lit("="))) & line.rlike(_HINT) | F.contains(line, F.lit("-----BEGIN "))
    found = lines.where((F.length("line") >= SHORTEST) & hint)
    part = lambda g: F.regexp_extract_all("line", F.lit(_AROUND), F.lit(g))
    got = found.select("_key", "line_no", F.posexplode(F.arrays_zip(part(2).alias("token"), part(1).alias("before"), part(3).alias("after"))).alias("nth", "c"))
    got = got.select("_key", "line_no", "nth", "c.token", "c.before", "c.after")
    plain = F.col("token").rlike(f"^[{_TOKEN}]{{{LEAST},}}=*$")
    got = got.where(~plain | F.col("token").rlike("[0-9]") & F.col("token").rlike("[A-Za-z]") | F.col("before").rlike(f"""{_NAMES}["']?[ \\t]{{0,3}}[:=]{{1,2}}[ \\t]{{0,3}}["']?$"""))
    return got.select(F.col("_key").alias(key), "line_no", "nth", "token", "before", "after")


def with_features(found: DataFrame) -> DataFrame:
    """``found`` (token, before, after) with one double column per feature: length, character classes and their changes, dictionary coverage, path and neighbouring words."""
    t, b, a = F.col("token"), F.lower("before"), F.lower("after")
    n = F.length(t).cast("double")
    share = lambda keep: F.length(F.regexp_replace(t, f"[^{keep}]", "")) / n
    shape = t
    for sign, kept in (("9", "0-9"), ("A", "A-Z"), ("a", "a-z"), ("_", "^9Aa")):
        shape = F.regexp_replace(shape, f"[{kept}]+", sign)
    covered = F.lower(t)
    for f in sorted(FRAGMENTS, key=len, reverse=True):
        covered = F.replace(covered, F.lit(f), F.lit(""))
    any_of = lambda where, words: F.greatest(*[F.contains(where, F.lit(w)).cast("double") for w in words])
    named = lambda where, end: where.rlike(_NAMES + end).cast("double")
    letters = F.split(F.lower(t), "")
    pairs = F.zip_with(letters, F.slice(letters, F.lit(2), F.greatest(F.size(letters) - 1, F.lit(0))), lambda x, y: F.concat(x, y))
    frequent = F.size(F.filter(pairs, lambda x: F.coalesce(x.isin(*PAIRS), F.lit(False)))) / n
    return found.withColumns({
        "length": n, "digits": share("0-9"), "uppers": share("A-Z"), "lowers": share("a-z"), "others": share("^A-Za-z0-9"), "class_changes": F.length(shape) / n,
        "distinct": F.size(F.array_distinct(F.split(F.substring(t, 1, 64), ""))) / F.least(n, F.lit(64.0)), "vowels": share("aeiouAEIOU"), "fragments": 1 - F.length(covered) / n,
        "slashes": share("/"), "dots": share("."), "dashes": share(r"_\-"), "hexes": share("0-9a-fA-F"),
        "pairs": frequent, "known": F.greatest(*[F.startswith(t, F.lit(w)).cast("double") for w in KNOWN], t.rlike("^(" + "|".join(KNOWN_FORMS) + ")").cast("double")), "stand_in": any_of(F.lower(t), STAND_INS),
        "secret_word": named(F.col("before"), ""), "plain_word": any_of(b, PLAIN_WORDS), "secret_near": named(F.substring("before", -22, 22), ""),
        "secret_name": named(F.col("before"), """["']?[ \\t]{0,3}[:=]{1,2}[ \\t]{0,3}["']?$"""), "secret_after": named(F.col("after"), ""), "plain_after": any_of(a, PLAIN_WORDS),
        "assigned": b.rlike("[:=]\\s*[\"']?$").cast("double"), "quoted": b.rlike("[\"']$").cast("double"),
        "in_path": (b.rlike("[/\\\\]$") | F.startswith(a, F.lit("/"))).cast("double"), "in_url": F.contains(b, F.lit("://")).cast("double"), "run_of_same": t.rlike(r"(.)\1{3}").cast("double"),
    })


#: Lines that hold a secret {v}, and lines that hold something else; {K} is a name of a secret, {P} a plain name, {w} a word.
TRUE_LINES = (
    '{K} = "{v}"', "{K}={v}", "{K}: {v}", '"{K}": "{v}",', "export {K}={v}", "{w} {w} {K} = '{v}' {w}", "Authorization: Bearer {v}", "curl -H 'X-Api-Key: {v}' https://{w}.example.org/{w}",
    "postgres://{w}:{v}@{w}.internal:5432/{w}", "{w} {w} {w} {K} {v} {w}", "  {K}: '{v}'  # {w}", "set {K} {v}", "{w}.{K} := \"{v}\";", "<{K}>{v}</{K}>", "{w}, {w} {K} = \"{v}\" {w} {w}.",
)
KNOWN_LINES = ("{w} {w} {v} {w}", "{w}: {v}", "{v}", '{w} = "{v}"', "{w}({v})", "https://{w}.example.org/?{w}={v}")
FALSE_LINES = (
    "{P} {v}", "{P}: {v}", '{P} = "{v}"', "{w} {w} {v} {w}", "{w}-{w} {v}, {w}", 'href="/{w}/{v}"', "{P}={v}", "see {v} for {w}", "{w} {v}", '"{P}": "{v}",', "{w} = {v}", "import {v}", "git checkout {v}", "https://{w}.example.org/{w}/{v}",
)
#: Values under names that only resemble those of secrets.
COUNT_LINES = ("token_count = {v}", "max_tokens: {v}", "author: {v}", "key: {v}", "{w}_tokens={v}", "passed = {v}", "pinned: {v}", "accession={v}", '"tokenizer": "{v}"', "authors = {v}", "keyboard: {v}", "{w} key {v}", "passenger: {v}", "primary_key={v}", "monkey = {v}")
TRAP_LINES = ("{K}: {v}", '{K} = "{v}"', "{K}={v}", '"{K}": "{v}"', "{w} {K} {v}")
SECRET_NAMES = ("db_pass", "pass", "smtp.passphrase", "AZURE_KEY", "account-key", "dbPassword", "SAS", "dsn", "HEROKU_API_KEY", "storageKey", "PIN", "token", "secret", "password", "passwd", "api_key", "apikey", "AWS_SECRET_ACCESS_KEY", "DB_PASSWORD", "MY_SERVICE_PROD_TOKEN2", "client_secret", "auth_token", "private_key", "access-key", "pwd", "GITHUB_TOKEN", "credentials", "SECRET")
STAND_IN_VALUES = (
    "xxxx-xxxx-000000000000", "your-token-goes-here1", "example_key_1234567890", "changeme", "required", "os.environ[1]", "${API_TOKEN_V1}", "<your-password>", "process.env.API_TOKEN1", "string", "********",
    "placeholder123456", "tokenizer_config_v2.json", "getenv(DB_PASS1)", "{{secret_name1}}",
)
WORDS = ("thing", "render", "outer", "index", "module", "report", "winter", "server", "garden", "letter", "the", "and", "with", "für", "nicht", "que", "est", "para", "stone", "river")


def sample_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """Labelled candidates (token, before, after, label) of ``n`` generated lines: a stand-in where no reviewed findings exist.

    True ones are keys and passwords of public formats in code, configuration, addresses and prose; false ones are digests,
    identifiers, paths, host names, versions and data, and stand-ins and code behind the names of secrets.
    """
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    at = lambda values, k: f"element_at(array({', '.join(values)}), CAST(pmod(xxhash64({k}, id), {len(values)}) AS INT) + 1)"
    pick = lambda words, k: at([quote(w) for w in words], k)
    word = lambda k: pick(WORDS[:10], k)
    number = lambda k, m: f"CAST(pmod(xxhash64({k}, id), {m}) AS STRING)"
    hexes = lambda k, m: f"substring(sha2(concat('{k}-', CAST(id AS STRING)), 512), 1, {m})"
    raw64 = lambda k, m: f"substring(translate(base64(unhex(sha2(concat('{k}-', CAST(id AS STRING)), 512))), '=\\r\\n', ''), 1, {m})"
    b64 = lambda k, m: f"translate({raw64(k, m)}, '+/', 'Zq')"
    join = lambda *parts: f"concat({', '.join(parts)})"
    known = [
        join("'AKIA'", f"upper({b64(1, 16)})"), join("'ghp_'", b64(2, 36)), join("'xoxb-'", number(3, 10**12), "'-'", b64(4, 24)), join("'sk_live_'", b64(5, 24)), join("'AIza'", b64(6, 35)),
        join("'SK'", hexes(140, 32)), join("'MTk'", b64(141, 21), "'.'", b64(142, 6), "'.'", b64(143, 27)), join("'hf_'", b64(144, 34)), join("'key-'", hexes(145, 32)), join("'GOCSPX-'", b64(146, 28)),
        join("'eyJ'", b64(7, 33), "'.'", b64(8, 60), "'.'", b64(9, 43)), join("'glpat-'", b64(10, 20)), "'-----BEGIN RSA PRIVATE KEY-----'",
    ]
    secret = [
        hexes(11, 40), hexes(12, 32), hexes(13, 64), raw64(14, 40), b64(15, 32), b64(16, 24), b64(17, 20), join(raw64(18, 43), "'='"), hexes(80, 18), join(f"initcap({word(19)})", number(20, 9999), "'!'"),
        join(b64(21, 5), pick("!@#%&", 22), b64(23, 6)), join(word(24), "'_'", f"upper({word(25)})", number(26, 99), "'$'"), join(number(27, 10**10), "':'", b64(28, 35)), b64(29, 9),
        join(raw64(80, 64), raw64(81, 22), "'=='"), join(word(82), word(83), word(84)), f"concat_ws('-', {word(85)}, {word(86)}, {word(87)}, {number(88, 99)})", f"concat_ws('-', {hexes(89, 8)}, {hexes(90, 4)}, {hexes(91, 4)}, {hexes(92, 4)}, {hexes(93, 12)})", join(b64(94, 3), number(95, 99), pick("!@#%&", 96), b64(97, 3)),
    ]
    false = [
        hexes(31, 40), hexes(32, 64), hexes(33, 32), f"concat_ws('-', {hexes(34, 8)}, {hexes(35, 4)}, {hexes(36, 4)}, {hexes(37, 4)}, {hexes(38, 12)})", join(word(39), "'/'", word(40), "'/'", word(41), number(42, 97), "'.html'"),
        join(word(43), "'.'", number(44, 97), "'.mail'", number(45, 9), "'.example.com'"), join(*[f"initcap({word(k)})" for k in (46, 47, 48)], number(49, 1000)), join(f"concat_ws('_', {word(50)}, {word(51)}, {word(52)})", "'_v'", number(53, 9)),
        join("'2024-0'", number(54, 9), "'-1'", number(55, 9), "'T1'", number(56, 9), "'-30-00Z'"), join("'iVBORw0KGgoAAAANSUhEUgAA'", raw64(57, 86)), join(number(58, 10**9), number(59, 10**9)), join(f"concat_ws('.', {word(60)}, {word(61)}, {word(62)}, {word(63)})", number(64, 9)),
        join("'sha256-'", raw64(65, 43), "'='"), join("'build-'", number(66, 999), "'-'", hexes(67, 8), "'-x86_64'"), join(word(68), "'@'", word(69), number(70, 9), "'.example.com'"),
    ]
    trap = [quote(x) for x in STAND_IN_VALUES] + [join(word(71), "'.get_secret_value'"), join(word(72), "'_manager_client_v1beta'", number(73, 9)), join(word(74), word(75)), join(word(76), "'-'", word(77))]
    counted = [number(150, 10**8), number(151, 10**7), join(word(152), word(153), number(154, 3000)), join(f"initcap({word(155)})", f"initcap({word(156)})"), join(word(157), "'_'", word(158)), f"concat_ws('.', {word(159)}, {word(160)}, {number(161, 99)})", hexes(162, 16), f"concat_ws('/', {word(163)}, {word(164)}, {word(165)}, {number(166, 9)})"]
    # Kinds of lines: the secrets, the known formats, what is neither (twice as often), and traps.
    kinds = [(TRUE_LINES, secret, True), (KNOWN_LINES + TRUE_LINES, known, True), (FALSE_LINES, false, False), (TRAP_LINES, trap, False), (FALSE_LINES, false, False), (COUNT_LINES, counted, False)]
    kind = f"CAST(pmod(xxhash64(99, id), {len(kinds)}) AS INT)"
    parts = {"v": "CASE " + " ".join(f"WHEN {kind} = {j} THEN {at(values, 100 + j)}" for j, (_, values, _) in enumerate(kinds)) + " END"}
    parts |= {"K": pick(SECRET_NAMES, 201), "P": pick(PLAIN_WORDS, 202)} | {f"w{j}": pick(WORDS, 210 + j) for j in range(6)}

    def filled(form: str) -> str:
        pieces, words = [], 0
        for x in re.split(r"(\{[KPvw]\})", form):
            if x == "{w}":
                x, words = f"w{words % 6}", words + 1
            pieces.append(x if x in parts else x[1:-1] if x[1:-1] in parts else quote(x))
        return join(*pieces)

    text = "CASE " + " ".join(f"WHEN {kind} = {j} THEN {at([filled(x) for x in forms], 300 + j)}" for j, (forms, _, _) in enumerate(kinds)) + " END"
    made = spark.range(n).select("id", *[F.expr(x).alias(c) for c, x in parts.items()])
    made = made.select("id", F.expr(text).alias("text"), F.col("v").alias("value"), F.expr(f"{kind} < {sum(t for _, _, t in kinds)}").alias("true"))
    found = candidates(made, "id", "text").join(made.select("id", "value", "true"), "id")
    hit = F.contains("value", F.col("token")) | F.contains("token", F.col("value"))
    return found.select("token", "before", "after", (F.col("true") & hit).cast("double").alias("label"))


def train(findings: DataFrame, trees: int = 24, depth: int = 9, seed: int = 7):
    """A random forest fitted on labelled findings (token, before, after, label)."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(findings)).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def compile_forest(model) -> Column:
    """Mean vote of the trees for a true finding, as one expression over the feature columns.

    The features are bound to one struct first, so that each is computed once and not in every test of every tree.
    """
    votes = []
    for tree in model.trees:
        lines = [x.strip() for x in tree.toDebugString.splitlines()[1:] if x.strip()]
        at = 0

        def node() -> str:
            nonlocal at
            line = lines[at]
            at += 1
            if line.startswith("Predict"):
                return str(float(line.split(":")[1])) + "D"
            name, bound = re.match(r"If \(feature (\d+) <= ([-\d.eE]+)\)", line).groups()
            low = node()
            at += 1  # Else
            return f"CASE WHEN x.{FEATURES[int(name)]} <= {float(bound)!r}D THEN {low} ELSE {node()} END"

        votes.append(node())
    forest = "(" + " + ".join(f"({v})" for v in votes) + f") / {len(votes)}D"
    return F.expr(f"get(transform(array(struct({', '.join(FEATURES)})), x -> {forest}), 0)")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", findings: DataFrame | None = None, threshold: float = 0.5, model=None) -> DataFrame:
    """Findings of every whole text: key, line_no, nth, token, before, after, score (mean vote), for scores of ``threshold`` or more.

    ``model`` is a forest that ``train`` has fitted. Without one, it is fitted on ``findings`` or else ``sample_findings``; the rows it
    learns from are bounded by that parameter, the scan covers everything. Empty tables and null texts give no findings; repeated rows repeat theirs; other
    columns are left out, and the key may have any name.
    """
    model = model or train(findings if findings is not None else sample_findings(docs.sparkSession))
    d = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    d = with_features(candidates(d, "_key", "_text")).withColumn("score", compile_forest(model))
    return d.where(F.col("score") >= threshold).select(F.col("_key").alias(key), "line_no", "nth", "token", "before", "after", "score")
