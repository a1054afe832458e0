"""Line deduplication with a log-template tree, in DataFrame operations alone.

The tree has a fixed depth: a line goes by its number of tokens and its first DEPTH tokens, in which those with a digit
are variable fields. Within a leaf the token that most lines have at a place belongs to the template if at least half
of the leaf's lines have it; other places are variable fields too. A line follows its leaf's template if it has the
template's tokens at ALIKE of its places or more. A template that lines of MIN_TEXTS different texts follow is
recurring: its lines are dropped, except in the document of the smallest doc_id. This is the rule of op6's query, which its
SQL twin holds (recurring_lines). line_deduplicated() and the pipeline keep several templates for each leaf and drop only
lines that agree at every fixed place (repeated_lines).

Documents of equal text count once, so copies alone make no template. Lines are split at line feeds; blank lines are
kept and never counted. Null text stays null (no lines). Rows with null doc_id count for templates, but are left as
they are. Equal rows are treated alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sent_if_small, stored

DEPTH, MIN_TEXTS = 4, 5
#: Places out of a hundred that must agree with the template.
ALIKE = 60
FIELD = "<*>"
#: Lines up to the last dropped one that are broadcast with their documents at most.
SENT_LINES = 2_000_000
#: Templates (of a line's length each) that are broadcast at most.
MOST_TEMPLATES = 20_000
_GAP = "[ \\t\\r\\f\\x0B]+"
_ENDS = " \t\r\f\x0b"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("version", F.xxhash64("text"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, version, line number, tokens and leaf of every line that isn't blank."""
    rows = docs.select("doc_id", "version", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    rows = rows.select("doc_id", "version", "line", F.btrim("raw", F.lit(_ENDS)).alias("raw")).where("raw <> ''")
    rows = rows.select("doc_id", "version", "line", F.split("raw", _GAP).alias("tokens"))
    lead = F.transform(F.slice("tokens", 1, DEPTH), lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))
    return rows.withColumn("leaf", F.xxhash64(F.size("tokens"), F.array_join(lead, " ")))


def recurring_lines(docs: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """doc_id, version and number of each line that follows a recurring template outside its first document."""
    docs = _keyed(docs)
    lines = _lines(docs)
    # texts of a leaf are counted without gathering them: first once for each leaf and text, then for each leaf
    often = lines.select("leaf", "version").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= min_texts)
    often = stored(often.select("leaf"), "leaves")
    found = stored(lines.join(often, "leaf", "left_semi"), "lines")
    # one line for each leaf and text says which tokens are usual, so copies count once here too
    once = found.groupBy("leaf", "version", "tokens").agg(F.count(F.lit(1)).alias("n")).drop("n")
    usual = once.select("leaf", F.posexplode("tokens").alias("place", "token")).groupBy("leaf", "place", "token").agg(F.count(F.lit(1)).alias("n"))
    usual = usual.groupBy("leaf", "place").agg(F.max(F.struct("n", "token")).alias("top"), F.sum("n").alias("total"))
    usual = usual.select("leaf", F.struct("place", F.when(F.expr("2 * top.n >= total"), F.col("top.token")).alias("token")).alias("part"))
    # templates and verdicts are stored, so that a leaf that holds many of all lines can be split where lines meet them
    template = usual.groupBy("leaf").agg(F.sort_array(F.collect_list("part")).alias("parts")).select("leaf", F.col("parts.token").alias("template"))
    template = sent_if_small(stored(template, "templates"), MOST_TEMPLATES)
    agree = F.size(F.filter(F.zip_with("tokens", "template", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    follows = found.join(template, "leaf").where(agree * 100 >= F.size("tokens") * ALIKE).select("leaf", "doc_id", "version", "line")
    follows = stored(follows, "follows")
    recurring = follows.select("leaf", "version", "doc_id").groupBy("leaf", "version").agg(F.min("doc_id").alias("doc_id"))
    recurring = recurring.groupBy("leaf").agg(F.count(F.lit(1)).alias("texts"), F.min("doc_id").alias("first")).where(F.col("texts") >= min_texts)
    recurring = sent_if_small(stored(recurring.select("leaf", "first"), "recurring"))
    return follows.join(recurring, "leaf").where("doc_id > first").select("doc_id", "version", "line")


def _templates(lines: DataFrame, words: DataFrame, kept: DataFrame, min_texts: int) -> DataFrame:
    """leaf, same and template of the distinct lines whose kept words make one, and in which each word field varies."""
    masks = kept.groupBy("leaf", "same").agg(F.bit_xor("code").alias("mask"), F.count(F.lit(1)).alias("n")).join(lines, ["leaf", "same"])
    masks = masks.where(F.col("n") * 100 >= F.col("size") * ALIKE)
    masks = stored(masks.select("leaf", "same", F.col("mask").bitwiseXOR(F.col("base")).alias("template")), "masks")
    fields = words.join(kept.select("leaf", "same", "place"), ["leaf", "same", "place"], "left_anti").join(masks, ["leaf", "same"])
    values = fields.select("leaf", "template", "place", "code").distinct().groupBy("leaf", "template", "place").agg(F.count(F.lit(1)).alias("values"))
    steady = values.where(F.col("values") < min_texts).select("leaf", "template").distinct()
    return stored(masks.join(sent_if_small(stored(steady, "steady")), ["leaf", "template"], "left_anti"), "templates")


def repeated_lines(docs: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """doc_id, version and number of each line of a recurring template outside its first document, with several templates
    for each leaf.

    Tokens with a digit are fields. A word is fixed if min_texts texts of the leaf have it at this place, unless min_texts
    such words or more stand there in lines that are the same otherwise; other words are fields. Lines with the same fixed
    words and fields at the same places are one template, if ALIKE of the places are fixed and min_texts different words or
    more stand at each place that is a word's field; else only equal lines are. So a line agrees with its template at every
    fixed place, and a text counts once for each template."""
    lines = _lines(_keyed(docs))
    often = lines.select("leaf", "version").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= min_texts)
    often = stored(often.select("leaf"), "leaves")
    words = F.array_compact(F.transform("tokens", lambda t, i: F.when(~t.rlike("[0-9]"), F.struct(i.alias("place"), F.xxhash64(i, t).alias("code")))))
    base = F.aggregate(F.transform("tokens", lambda t, i: F.when(t.rlike("[0-9]"), F.xxhash64(i, F.lit(FIELD))).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
    found = lines.join(often, "leaf", "left_semi").select("leaf", "doc_id", "version", "line", F.xxhash64("tokens").alias("same"), F.size("tokens").alias("size"), base.alias("base"), words.alias("words"))
    found = stored(found, "lines")
    # words are counted for each text, then masks are made once for each distinct line; no group is gathered
    seen = found.groupBy("leaf", "same", "version").agg(F.first("words").alias("words")).select("leaf", "version", F.explode("words.code").alias("code"))
    fixed = seen.distinct().groupBy("leaf", "code").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= min_texts)
    fixed = sent_if_small(stored(fixed.select("leaf", "code"), "fixed"))
    distinct = stored(found.groupBy("leaf", "same").agg(F.first("size").alias("size"), F.first("base").alias("base"), F.first("words").alias("words")), "distinct")
    words = stored(distinct.select("leaf", "same", F.explode("words").alias("x")).select("leaf", "same", "x.place", "x.code"), "words")
    distinct = distinct.drop("words")
    usual = stored(words.join(fixed, ["leaf", "code"], "left_semi"), "usual")
    masks = usual.groupBy("leaf", "same").agg(F.bit_xor("code").alias("mask")).join(distinct, ["leaf", "same"])
    rests = usual.join(masks.select("leaf", "same", F.col("mask").bitwiseXOR(F.col("base")).alias("mask")), ["leaf", "same"])
    rests = stored(rests.withColumn("rest", F.col("mask").bitwiseXOR(F.col("code"))).drop("mask"), "rests")
    varied = rests.select("leaf", "rest", "place", "code").distinct().groupBy("leaf", "rest", "place").agg(F.count(F.lit(1)).alias("values"))
    varied = sent_if_small(stored(varied.where(F.col("values") >= min_texts).select("leaf", "rest", "place"), "varied"))
    kept = stored(rests.join(varied, ["leaf", "rest", "place"], "left_anti").drop("rest"), "kept")
    templates = _templates(distinct, words, kept, min_texts)
    # lines that are left without a template try again with all usual words
    alone = lambda rows: rows.join(templates.select("leaf", "same"), ["leaf", "same"], "left_anti")
    templates = templates.select("leaf", "same", "template").union(_templates(distinct, alone(words), alone(usual), min_texts).select("leaf", "same", "template"))
    follows = found.select("leaf", "doc_id", "version", "line", "same").join(sent_if_small(templates), ["leaf", "same"], "left")
    follows = stored(follows.select("leaf", F.coalesce("template", "same").alias("template"), "doc_id", "version", "line"), "follows")
    recurring = follows.groupBy("leaf", "template", "version").agg(F.min("doc_id").alias("doc_id"))
    recurring = recurring.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("texts"), F.min("doc_id").alias("first")).where(F.col("texts") >= min_texts)
    recurring = sent_if_small(stored(recurring.select("leaf", "template", "first"), "recurring"))
    return follows.join(recurring, ["leaf", "template"]).where("doc_id > first").select("doc_id", "version", "line")


def _with_gone(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of docs as `row`, the lines of the text as `parts`, and for each line up to the last that is dropped whether
    it is (`gone`)."""
    lists = stored(dropped.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("line")).alias("at")), "at")
    # spelled out for every line, so that a document with very many dropped lines takes time in proportion
    before = F.concat(F.array(F.lit(-1)), F.expr("slice(at, 1, size(at) - 1)"))
    flags = F.flatten(F.zip_with("at", before, lambda a, b: F.concat(F.array_repeat(F.lit(False), a - b - 1), F.array(F.lit(True)))))
    lists = stored(lists.select("doc_id", "version", flags.alias("gone")), "dropped")
    size = lists.agg(F.sum(F.size("gone"))).first()[0] or 0
    if size <= SENT_LINES:  # counted; beyond it the texts are shuffled
        lists = F.broadcast(lists)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    same = (F.col("row.doc_id").cast("long") == F.col("doc_id")) & (F.col("hash") == F.col("version"))
    return rows.join(lists, same, "left").select("row", F.split(F.col("row.text").cast("string"), "\n").alias("parts"), "gone")


def _kept():
    text = F.array_join(F.zip_with("parts", "gone", lambda x, g: F.when(~F.coalesce(g, F.lit(False)), x)), "\n")
    return F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(text)


def line_deduplicated(docs: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """The same rows and columns, lines of recurring templates dropped (repeated_lines)."""
    found = _with_gone(docs, repeated_lines(docs, min_texts))
    return found.select(*[_kept().alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, lines in all and dropped, and the digest of what is kept, of every row."""
    found = _with_gone(docs.select("doc_id", "text"), recurring_lines(docs))
    n_lines = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.size("parts")).cast("long")
    n_dropped = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size(F.filter("gone", lambda g: g))).cast("long")
    return found.select("row.doc_id", n_lines.alias("n_lines"), n_dropped.alias("n_dropped"), F.sha2(F.encode(F.coalesce(_kept(), F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH keyed AS (SELECT doc_id, text FROM documents),
cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM keyed),
raw AS (SELECT doc_id, text, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS line FROM cut),
toks AS (SELECT doc_id, md5(text) AS version, line, regexp_split_to_array(trim(raw, ' ' || chr(9) || chr(13) || chr(12) || chr(11)), '[ \\t\\r\\f\\v]+') AS tokens
  FROM raw WHERE trim(raw, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) <> ''),
lined AS (SELECT *, len(tokens) || ' ' || array_to_string(list_transform(tokens[1:{DEPTH}], lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '{FIELD}' ELSE t END), ' ') AS leaf FROM toks),
often AS (SELECT leaf FROM lined GROUP BY leaf HAVING count(DISTINCT version) >= {MIN_TEXTS}),
found AS (SELECT * FROM lined WHERE leaf IN (SELECT leaf FROM often)),
once AS (SELECT DISTINCT leaf, version, tokens FROM found),
places AS (SELECT leaf, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM once),
counted AS (SELECT leaf, place, token, count(*) AS n FROM places GROUP BY ALL),
usual AS (SELECT leaf, place, CASE WHEN 2 * max(n) >= sum(n) THEN max({{'n': n, 'token': token}}).token END AS token FROM counted GROUP BY leaf, place),
template AS (SELECT leaf, list(token ORDER BY place) AS template FROM usual GROUP BY leaf),
follows AS (SELECT f.* FROM found f JOIN template t USING (leaf)
  WHERE 100 * len(list_filter(list_zip(f.tokens, t.template), lambda x: coalesce(x[1] = x[2], false))) >= {ALIKE} * len(f.tokens)),
recurring AS (SELECT leaf, min(doc_id) AS first FROM follows GROUP BY leaf HAVING count(DISTINCT version) >= {MIN_TEXTS}),
gone AS (SELECT doc_id, version, list(DISTINCT line) AS lines FROM follows JOIN recurring USING (leaf) WHERE doc_id > first GROUP BY ALL),
kept AS (SELECT c.doc_id, c.text, coalesce(len(c.parts), 0) AS n_lines, coalesce(len(g.lines), 0) AS n_dropped, g.lines, c.parts
  FROM cut c LEFT JOIN gone g ON c.doc_id = g.doc_id AND md5(c.text) = g.version)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped,
  sha256(CASE WHEN lines IS NULL THEN coalesce(text, '') ELSE
    array_to_string(list_transform(list_filter(list_zip(parts, range(len(parts))), lambda x: NOT list_contains(lines, x[2])), lambda x: x[1]), chr(10)) END) AS kept_sha256
FROM kept
"""
