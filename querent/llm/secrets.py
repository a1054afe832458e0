"""Secret scans: candidates by pattern, then a random forest that takes out false positives. DataFrame operations alone.

Candidates: what follows a secret keyword with = or : (three characters or more), the engine's known forms of secrets, and
runs of 16 or more key characters with a digit or a change from lower to upper case. Features: length, character
transitions (log-probability of letter pairs, counted over the words of all documents; changes between letters, digits and cases),
digit, upper-case and distinct-character shares, entropy, coverage by dictionary words (words of at least DICTIONARY_TEXTS
documents, counted over all of them), separators and path marks, and neighbouring words. The forest is trained on labelled
findings; train() takes any number. labelled_findings() makes a bounded set from a table: keys of several kinds, hashes,
paths, numbers, placeholders and compounds built from the words of its documents, each in a context drawn by a hash, so
that no label follows from a single feature. Findings of the table itself are never labelled by rule.

Without labelled findings of both kinds nothing is taken out: every candidate is a finding. Null text has no candidates
and stays null. Offsets are code points. Rows are told apart by doc_id (null like any other) and text; equal rows are
treated alike. Very long texts are scanned whole. Further columns are kept and not looked at, whatever their names. An
empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querent.operators import guardrails

from .common import sent_if_small, stored

# Words that stand beside secrets, words that stand beside other long tokens, and prefixes of keys.
KEYWORDS = "password|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential|private[_-]?key"
OTHERS = "commit|revision|sha1|sha256|md5|checksum|uuid|guid|isbn|invoice|order|card|phone|build|version|path|file|url|http"
PREFIXES = "^(AKIA|ASIA|ghp_|gho_|sk_live_|sk-|xox[abp]-|AIza|eyJ|-----BEGIN)"
_ASSIGNED = rf"(?i:{KEYWORDS})[\"']?\s{{0,5}}[=:]\s{{0,5}}[\"']?"
_KEY = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*(?:[0-9]|[a-z][A-Z]))[A-Za-z0-9+/_\-]{16,}={0,2}"
CANDIDATE = "|".join([rf"{_ASSIGNED}[^\s\"'<>,;]{{3,}}", *(pattern for _, pattern in guardrails.SECRETS), _KEY])
#: What stands before the secret itself in a match.
BEFORE = rf"^(?:{_ASSIGNED}|Bearer\s+)"
MASK = "[SECRET]"
LEFT, RIGHT = 60, 40
DICTIONARY_TEXTS = 20
#: Labelled findings are built from the first words of at most this many documents.
LABEL_DOCS = 1500
TREES, TREE_DEPTH, SEED, THRESHOLD = 30, 7, 42, 0.5
#: Parts that labelled findings are dealt into for training.
TRAIN_PARTS = 8
#: Candidates of the documents whose marks are broadcast at most.
SENT_MARKS = 1_000_000
FEATURES = ("length", "changes", "transitions", "digits", "letter_digit", "digit_letter", "cases", "uppers", "distinct", "entropy", "words", "slashes", "joins", "marks", "keyword", "direct", "quoted", "prefixed", "other", "numeric")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("version", F.xxhash64("text"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, version, number, candidate, its neighbourhood and its span, of each candidate of each distinct row."""
    rows = _keyed(docs).where(F.col("text").rlike(CANDIDATE))
    # arrays are zipped and not looked up, so that a text with very many candidates takes time in proportion
    ends = F.transform(F.split("text", CANDIDATE, -1), lambda x: F.struct(F.right(x, F.lit(LEFT)).alias("left"), F.left(x, F.lit(RIGHT)).alias("right"), F.length(x).alias("gap")))
    found = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    found = F.zip_with(F.zip_with(found, ends, lambda m, e: F.struct(m.alias("match"), e.alias("before"))), F.slice(ends, 2, F.size(ends)), lambda x, e: F.struct(x.alias("m"), e["right"].alias("right")))
    rows = rows.select("doc_id", "version", F.posexplode(found).alias("k", "x")).where("x.m.match is not null").select("doc_id", "version", "k", "x.m.match", "x.m.before", "x.right")
    head = F.regexp_extract("match", BEFORE, 0)
    rows = rows.select(
        "doc_id",
        "version",
        "k",
        F.substring("match", F.length(head) + 1, F.length("match")).alias("candidate"),
        F.right(F.concat("before.left", head), F.lit(LEFT)).alias("left"),
        "right",
        (F.col("before.gap") + F.length("match")).alias("passed"),
    ).distinct()
    rows = rows.withColumn("end", F.sum("passed").over(Window.partitionBy("doc_id", "version").orderBy("k")))
    return rows.withColumn("start", F.col("end") - F.length("candidate")).drop("passed")


def _share(c: Column, pattern: str) -> Column:
    return (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))) / F.length(c)


def _chunks(c: Column) -> Column:
    return F.expr("regexp_extract_all(lower(candidate), '[a-z]{3,}', 0)")


def dictionary(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of the wanted words that at least DICTIONARY_TEXTS documents hold."""
    wanted = sent_if_small(stored(wanted.distinct(), "chunks"))
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("word"))
    counts = words.join(wanted, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("texts"))
    return stored(counts.where(F.col("texts") >= DICTIONARY_TEXTS).select("word"), "dictionary")


def _sampled_words(docs: DataFrame, label_docs: int) -> DataFrame:
    """id, hash and first words (no whole text is sent on) of at most label_docs documents."""
    rows = docs.where(F.length("text") > 40).select(F.col("doc_id").cast("string").alias("id"), F.left(F.col("text").cast("string"), F.lit(400)).alias("head"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("h"))
    # the hash bound lets through about twice as many, so that no task gathers a share of all documents
    share = min(1.0, 2 * label_docs / max(1, docs.count()))
    rows = rows.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).orderBy("h", "id", "head").limit(label_docs)
    return rows.select(F.coalesce("id", F.lit("")).alias("id"), "h", F.expr("filter(split(lower(head), '[^a-z]+'), w -> length(w) > 2)").alias("w")).where("size(w) >= 6")


def letter_transitions(docs: DataFrame) -> str:
    """Log-probability of each letter after each letter, in the words of three letters or more of all documents; one more of
    each pair is counted. Words are counted first, so that pairs are made once for a word and not for each place of it.
    A character for each pair (tenths below zero, from `!` on), so that plans that hold the table stay small."""
    words = docs.select(F.explode(F.split(F.lower(F.col("text").cast("string")), "[^a-z]+")).alias("w")).where("length(w) > 2")
    word = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).select("n", F.split("w", "").alias("c"))
    pairs = word.select("n", F.explode(F.zip_with(F.col("c"), F.expr("slice(c, 2, size(c))"), lambda a, b: F.concat(a, b))).alias("pair")).where("length(pair) = 2")
    counts = [[1] * 26 for _ in range(26)]
    for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 676 rows at most
        counts[ord(r["pair"][0]) - 97][ord(r["pair"][1]) - 97] += r["n"]
    return "".join(chr(33 + min(93, round(-10 * math.log(n / sum(row))))) for row in counts for n in row)


def with_features(found: DataFrame, words: DataFrame, transitions: str) -> DataFrame:
    """Adds the features to rows with candidate, left and right."""
    c, n = F.col("candidate"), F.length("candidate")
    chunks = found.select("candidate").distinct().select("candidate", F.explode(_chunks(c)).alias("word"))
    covered = chunks.join(sent_if_small(words), "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("covered"))
    chars = F.array_distinct(F.split(c, ""))
    part = lambda ch: (n - F.length(F.replace(c, ch, F.lit("")))) / n
    entropy = F.aggregate(F.filter(chars, lambda ch: ch != ""), F.lit(0.0), lambda s, ch: s - part(ch) * F.log2(part(ch)))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    every, table = F.split(F.lower(c), ""), F.lit(transitions)
    letter = lambda x: x.between("a", "z")
    after = lambda a, b: F.when(letter(a) & letter(b), (33 - F.ascii(F.substring(table, (F.ascii(a) - 97) * 26 + F.ascii(b) - 96, F.lit(1)))) / 10)
    known = F.array_compact(F.zip_with(every, F.slice(every, 2, F.size(every)), lambda a, b: F.when(b.isNotNull(), after(a, b))))
    likely = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)).otherwise(math.log(1 / 26))
    times = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    values = {
        "length": n.cast("double"),
        "changes": (F.regexp_count(c, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+")) - 1) / n,
        "transitions": likely,
        "digits": _share(c, "[0-9]"),
        "letter_digit": times("[A-Za-z](?=[0-9])"),
        "digit_letter": times("[0-9](?=[A-Za-z])"),
        "cases": times("[a-z](?=[A-Z])"),
        "uppers": _share(c, "[A-Z]"),
        "distinct": F.size(F.filter(chars, lambda ch: ch != "")) / n,
        "entropy": entropy,
        "words": F.coalesce("covered", F.lit(0)) / n,
        "slashes": _share(c, "/"),
        "joins": _share(c, "[-_.]"),
        "marks": _share(c, "[^A-Za-z0-9+/=_.\\-]"),
        "keyword": flag(F.col("left").rlike(rf"(?i)({KEYWORDS})")),
        "direct": flag(F.col("left").rlike(r"[=:]\s*[\"']?$")),
        "quoted": flag(F.col("left").rlike("[\"'`]$")),
        "prefixed": flag(c.rlike(PREFIXES)),
        "other": flag(F.concat_ws(" ", "left", "right").rlike(rf"(?i)\b({OTHERS})\b")),
        "numeric": flag(c.rlike("^[0-9]+$")),
    }
    return found.join(covered, "candidate", "left").select(*found.columns, *[values[k].cast("double").alias(f"f_{k}") for k in FEATURES])


# Findings that labels are made of: label (1.0: a secret), kind of candidate, the contexts that it stands in.
_MADE = (
    *((1.0, kind, ("keyed",)) for kind in ("hex40", "hex18", "hex32", "short")),
    *((1.0, kind, ("keyed", "loose")) for kind in ("akia", "base64", "mixed", "sk", "xoxb", "ghp")),
    (1.0, "pem", ("loose",)),
    *((0.0, kind, ("named",)) for kind in ("hex40", "hex32", "hex64")),
    *((0.0, kind, ("named", "loose")) for kind in ("dashed", "path", "number", "uuid", "camel")),
    (0.0, "joined", ("loose", "keyed")),
    *((0.0, kind, ("keyed",)) for kind in ("exes", "word", "stop", "variable", "call", "stars")),
)
# What may stand before a candidate; {5} and {6} are words of the document.
_CONTEXTS = {
    "keyed": tuple("{5} {6} " + k for k in ('token = "', "password=", "secret: ", "api_key='", "passwd: ", "auth=", 'access_key": "')),
    "named": tuple("{5} {6} " + k for k in ("commit ", "md5 checksum: ", "sha256 ", "revision ", "uuid ", "build ", "file ")),
    "loose": ("{5} {6} ", "{5} {6} (", '{5} {6} is "', "{5} {6} = ", "{5} and ", "{6}: "),
}


def labelled_findings(sampled: DataFrame) -> DataFrame:
    """candidate, left, right, label (1.0: a secret) and the hash of their document, built from sampled words. Each row is
    made from one digest of its document, kind and context; the plan has each kind and each context once."""
    word = lambda k: F.element_at("w", k)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    head = lambda c, n: F.left(F.col(c), F.lit(n))
    number = lambda n: F.conv(head("x", n), 16, 10)
    pick = lambda options: F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod("drawn", F.lit(len(options))) + 1).cast("int"))
    made = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(kind).alias("kind"), F.lit(place).alias("place")) for label, kind, places in _MADE for place in places])
    rows = sampled.select("h", "id", "w", F.explode(made).alias("m")).select("h", "id", "w", "m.*")
    rows = rows.withColumn("x", F.sha2(F.concat_ws(" ", F.col("h").cast("string"), "id", F.col("label").cast("string"), "kind", "place"), 256))
    rows = rows.withColumn("b", F.base64(F.unhex(head("x", 60)))).withColumn("drawn", F.xxhash64("x"))
    rows = rows.withColumn("m", F.regexp_replace("b", "[+/=]", "x"))
    candidates_of = {
        "hex18": head("x", 18), "hex32": head("x", 32), "hex40": head("x", 40), "hex64": F.col("x"), "base64": head("b", 32), "mixed": head("m", 24),
        "short": text(F.initcap(F.left(word(1), F.lit(4))), number(2), pick("&!#$%*?"), head("m", 4)), "akia": text("AKIA", F.translate(F.upper(head("x", 16)), "018", "QRS")),
        "sk": text("sk_live_", head("m", 24)), "xoxb": text("xoxb-", number(8), "-", F.substring("m", 11, 10)), "ghp": text("ghp_", head("m", 36)), "pem": F.lit("-----BEGIN RSA PRIVATE KEY-----"),
        "dashed": F.concat_ws("-", word(1), word(2), word(3), word(4), number(3)), "path": text("/", F.concat_ws("/", word(1), word(2), word(3), number(3), word(4))),
        "number": text(number(12), "4242"), "uuid": F.regexp_replace(head("x", 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
        "camel": text(word(1), F.initcap(word(2)), F.initcap(word(3)), F.initcap(word(4))), "joined": text(word(1), "_", word(2), "_", word(3), number(3)),
        "exes": text("xxxxxxxxxxxx", number(3)), "word": word(1), "stop": text(word(1), "."), "variable": text("${", F.upper(word(1)), "}"), "call": text("get", F.initcap(word(1)), "()"), "stars": F.lit("********"),
    }
    chosen, before = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, candidate in candidates_of.items():
        chosen = F.when(F.col("kind") == kind, candidate).otherwise(chosen)
    for place, options in _CONTEXTS.items():
        before = F.when(F.col("place") == place, pick(options)).otherwise(before)
    before = F.replace(F.replace(before, F.lit("{5}"), word(5)), F.lit("{6}"), word(6))
    return rows.select(chosen.alias("candidate"), before.alias("left"), text(" ", word(3), " ", word(4)).alias("right"), "label", "h")


def train(labelled: DataFrame):
    """A forest over rows with features and label; None where a label is missing."""
    from pyspark.ml.classification import RandomForestClassifier

    if labelled.select("label").distinct().count() < 2:
        return None
    rows = stored(_vectors(labelled).select("features", "label", "candidate", "left"), "labelled")
    # dealt and sorted, so that the forest is the same each time
    rows = rows.repartition(TRAIN_PARTS, "candidate", "left").sortWithinPartitions("candidate", "left", "label").select("features", "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=TREE_DEPTH, seed=SEED, featuresCol="features", labelCol="label").fit(rows)


def _vectors(rows: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(rows)


def scored(rows: DataFrame, model) -> DataFrame:
    """Adds score (0 to 1): how surely a candidate is a secret."""
    from pyspark.ml.functions import vector_to_array

    if model is None:
        return rows.withColumn("score", F.lit(1.0))
    return model.transform(_vectors(rows)).withColumn("score", F.element_at(vector_to_array("probability"), 2)).select(*rows.columns, "score")


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, version, k, candidate, start, end, score of every candidate."""
    found = stored(candidates(docs), "candidates")
    sampled = stored(_sampled_words(docs, LABEL_DOCS), "words")
    labelled = stored(labelled if labelled is not None else labelled_findings(sampled), "findings")
    wanted = found.select("candidate").union(labelled.select("candidate")).distinct().select(F.explode(_chunks(F.col("candidate"))).alias("word"))
    words, transitions = dictionary(docs, wanted), letter_transitions(docs)
    model = train(with_features(labelled, words, transitions))
    return scored(with_features(found, words, transitions), model).select("doc_id", "version", "k", "candidate", "start", "end", "score")


def held_out_quality(docs: DataFrame, threshold: float = THRESHOLD, one_in: int = 5) -> dict[str, float]:
    """Precision and recall on labelled findings of documents that the forest is not trained on (one in `one_in`)."""
    sampled = stored(_sampled_words(docs, LABEL_DOCS), "words")
    labelled = stored(labelled_findings(sampled), "findings")
    words = dictionary(docs, labelled.select("candidate").distinct().select(F.explode(_chunks(F.col("candidate"))).alias("word")))
    rows = with_features(labelled, words, letter_transitions(docs))
    held = F.pmod("h", F.lit(one_in)) == 0
    judged = scored(rows.where(held), train(rows.where(~held)))
    said, true = F.col("score") >= threshold, F.col("label") == 1
    r = judged.agg(F.count_if(said & true).alias("both"), F.count_if(said).alias("said"), F.count_if(true).alias("true"), F.count(F.lit(1)).alias("n")).first()
    return {"precision": r["both"] / max(1, r["said"]), "recall": r["both"] / max(1, r["true"]), "n": r["n"]}


def _with_marks(docs: DataFrame, found: DataFrame) -> DataFrame:
    marks = found.groupBy("doc_id", "version").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.sort_array(F.collect_list(F.struct("k", "start", "end", (F.col("score") >= THRESHOLD).alias("hit")))).alias("marks"),
    )
    marks = stored(marks, "marks")
    size = marks.agg(F.sum("n_candidates")).first()[0] or 0
    if size <= SENT_MARKS:  # counted; beyond it the texts are shuffled
        marks = F.broadcast(marks)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("version"))
    return rows.join(marks, same, "left").select("row", "n_candidates", F.filter("marks", lambda m: m["hit"]).alias("hits"), F.transform("marks", lambda m: m["hit"]).alias("flags"))


def _masked() -> Column:
    text = F.col("row.text").cast("string")
    parts, found = F.split(text, CANDIDATE, -1), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    put = F.zip_with(found, "flags", lambda c, f: F.when(f, F.concat(F.regexp_extract(c, BEFORE, 0), F.lit(MASK))).otherwise(c))
    whole = F.array_join(F.zip_with(parts, put, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")
    return F.when(F.coalesce(F.array_size("hits"), F.lit(0)) == 0, text).otherwise(whole)


def secrets_masked(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The same rows and columns; secrets in text are replaced by MASK."""
    found = _with_marks(docs, scan(docs, labelled))
    return found.select(*[_masked().alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, candidates, secrets with their spans, and the digest of the masked text, of every row."""
    found = _with_marks(docs.select("doc_id", "text"), scan(docs))
    spans = F.coalesce(F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["start"].cast("string"), h["end"].cast("string"))), ","), F.lit(""))
    return found.select(
        "row.doc_id",
        F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"),
        F.coalesce(F.array_size("hits"), F.lit(0)).cast("long").alias("n_secrets"),
        spans.alias("secrets"),
        F.sha2(F.encode(F.coalesce(_masked(), F.lit("")), "UTF-8"), 256).alias("masked_sha256"),
    )
